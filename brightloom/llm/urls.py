"""URL filters: suffix and prefix rules, and a logistic regression on hashed character n-grams of host and path.

Everything here is DataFrame and SQL functions. The regression is trained inside one expression on a small labelled URL
table (at most MAX_LABELLED rows, a stated bound): its rows become one array, and full-batch gradient steps run over it.
The weights are one row of 2 ** BITS doubles, a fixed size, so that row is broadcast.

Defined results: a null url, or one without `://`, has an empty host and path, fits no rule and is judged by the
regression's bias alone. Rules compare whole labels of the host. Of the rules that fit, the one with the longest text
wins. Repeated rows are judged alike; other columns pass through unless they are named host, path, rule, score or verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 9
N = 3
EPOCHS = 60
RATE = 4.0
DECAY = 1e-3
MAX_LABELLED = 2_000

#: Fixed values: (verdict, host, path) rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: A small labelled table; 1 is to be kept.
LABELLED = (
    ("https://news.example.net/en/politics/report-on-water", 1),
    ("https://www.example.net/fr/article/histoire-du-jardin", 1),
    ("http://library.example.net/books/reading-list", 1),
    ("https://docs.example.net/guide/getting-started", 1),
    ("https://en.example.net/wiki/Geology", 1),
    ("http://m.example.net/en/42?page=2", 1),
    ("https://science.example.com/journal/issue/7", 1),
    ("https://blog.example.com/2020/05/notes-on-soil", 1),
    ("http://school.example.com/lessons/history", 1),
    ("https://www.example.com/en/310", 1),
    ("https://museum.example.com/es/exposicion/pintura", 1),
    ("https://forum.example.com/thread/repairing-a-clock", 1),
    ("http://city.example.net/council/minutes", 1),
    ("https://recipes.example.net/soup/onion", 1),
    ("https://maths.example.edu/course/algebra", 1),
    ("https://archive.example.edu/letters/1870", 1),
    ("http://free-casino-bonus.example.net/win/jackpot", 0),
    ("https://cheap-pills.example.net/buy/now", 0),
    ("http://xxx-cams.example.com/live/adult", 0),
    ("https://click.example.com/track/redirect?ad=1", 0),
    ("http://ads.example.com/banner/popup", 0),
    ("https://slots-poker.example.com/bet/free-spins", 0),
    ("http://warez-crack.example.net/download/keygen", 0),
    ("https://login-verify.example.com/account/password/reset", 0),
    ("http://payday-loan.example.net/apply/fast-cash", 0),
    ("https://replica-watches.example.com/shop/cart/checkout", 0),
    ("http://seo-links.example.net/buy/backlinks", 0),
    ("https://adult-dating.example.net/signup/free", 0),
    ("http://torrent-free.example.com/download/crack", 0),
    ("https://tracker.example.net/pixel/ad/click", 0),
)


def host_of(url: Column) -> Column:
    rest = F.substring_index(F.substring_index(F.substring_index(_after(url), "/", 1), "?", 1), "#", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = _after(url)
    return F.regexp_replace(F.regexp_replace(rest, r"^[^/?#]*", ""), r"(?s)[?#].*$", "")


def _after(url: Column) -> Column:
    """What follows the first `://`; empty without one."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, suffix, prefix = rule
    return ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)


def features(host: Column, path: Column) -> Column:
    """Hashed n-grams of `^host/path$`, host and path kept apart by different salts."""

    def grams(text: Column, salt: str) -> Column:
        framed = F.concat(F.lit("^"), text, F.lit("$$"))
        return F.transform(F.sequence(F.lit(1), F.length(framed) - (N - 1)), lambda i: F.pmod(F.hash(F.lit(salt), F.substring(framed, i, F.lit(N))), F.lit(1 << BITS)))

    return F.concat(grams(host, "h"), grams(path, "p"))


def train(labelled: DataFrame) -> DataFrame:
    """One row: _weights array<double> of 2 ** BITS and, last, the bias. labelled: url string, keep int (1 or 0)."""
    rows = labelled.where(F.col("keep").isNotNull()).orderBy("url", "keep").limit(MAX_LABELLED)
    x = rows.select(F.struct(features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), F.col("keep").cast("double").alias("y")).alias("x"))
    zero = F.array_repeat(F.lit(0.0), (1 << BITS) + 1)
    size = F.greatest(F.size("xs"), F.lit(1))

    def step(w: Column, _: Column) -> Column:
        # residual / n-gram count, for each example
        err = F.transform("xs", lambda e: F.struct(e["f"].alias("f"), ((e["y"] - _probability(w, e["f"])) / F.sqrt(F.size(e["f"]))).alias("r")))
        flat = F.flatten(F.transform(err, lambda e: F.transform(e["f"], lambda k: F.struct(k.alias("k"), e["r"].alias("r")))))
        by = F.aggregate(flat, zero, lambda g, kr: F.concat(F.slice(g, 1, kr["k"]), F.array(F.element_at(g, kr["k"] + 1) + kr["r"]), F.slice(g, kr["k"] + 2, 1 << BITS)))
        bias = F.aggregate(err, F.lit(0.0), lambda a, e: a + e["r"] * F.sqrt(F.size(e["f"])))
        full = F.concat(F.slice(by, 1, 1 << BITS), F.array(bias))
        return F.zip_with(w, full, lambda a, g: a + F.lit(RATE) * (g / size - F.lit(DECAY) * a))

    packed = x.groupBy().agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return packed.select(F.aggregate(F.sequence(F.lit(1), F.lit(EPOCHS)), zero, step).alias("_weights"))


def _probability(w: Column, f: Column) -> Column:
    z = F.aggregate(f, F.lit(0.0), lambda a, k: a + F.element_at(w, k + 1)) / F.sqrt(F.size(f)) + F.element_at(w, -1)
    return 1 / (1 + F.exp(-z))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(LABELLED), "url string, keep int")


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES) -> DataFrame:
    """pages with host, path, rule, score (the regression's probability of keeping) and verdict."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    kept = pages.drop("host", "path", "rule", "score", "verdict")
    parts = kept.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    host, path = F.col("host"), F.col("path")
    rule = F.coalesce(*[F.when(fits(host, path, r), F.lit(r[1] + r[2])) for r in ordered], F.lit(None).cast("string"))
    ruled = F.coalesce(*[F.when(fits(host, path, r), F.lit(r[0])) for r in ordered], F.lit(None).cast("string"))
    model = train(labelled)
    return (
        parts.withColumn("rule", rule)
        .join(F.broadcast(model))
        .withColumn("score", _probability(F.col("_weights"), features(host, path)))
        .withColumn("verdict", F.coalesce(ruled, F.when(F.col("score") >= 0.5, "allow").otherwise("block")))
        .drop("_weights")
    )
