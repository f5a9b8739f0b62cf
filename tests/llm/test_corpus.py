"""The corpus operators against brute force, round trips and edge cases, on small made-up tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import components, htmltext, jaccard, langid, lmscore, media, mixing, pieces, queries, rptrees, suffixes, urls

R = random.Random(4)
WORDS = {"en": "the of and that with from house water light night right".split(), "de": "der die und nicht auch straße schule wasser licht über".split(), "fr": "le la les dans une avec maison lumière été forêt eau".split(), "es": "el los una con para casa agua niño mañana señor".split()}


def words(n, lang="en"):
    return " ".join(R.choice(WORDS[lang]) + R.choice(["", "", "s", "er"]) + str(R.randint(0, 60)) * R.randint(0, 1) for _ in range(n))


def made_texts():
    base = [words(R.randint(5, 260), R.choice(list(WORDS))) for _ in range(60)]
    near = []
    for t in base[:12]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(w) // R.choice([60, 40, 12]))):
                v[R.randrange(len(v))] = f"new{R.randint(0, 999)}"
            near.append(" ".join(v))
    passage = words(80)
    shared = [f"{words(30)} {passage} {words(40)}" for _ in range(5)]
    edge = [None, "", "   \t\n", "one", "two words", "12 34 ,,, !!", "é", "A B C D", "a b c d", words(6000), "x" * 900, "\x00\x00 a"]
    return base + near + base[:6] + shared + edge + [None, ""]


@pytest.fixture(scope="module")
def rows():
    return [(i * 3 + 1, t, R.choice(["en", "de", None]), R.choice(["a", "b", None, "c"]), len(t or "")) for i, t in enumerate(made_texts())]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# 7 ----------------------------------------------------------------------------------------------------------------


def shingle_set(text, n):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100), (2, 50, 100)])
def test_jaccard_components_and_links(docs, rows, n, num, den):
    joined = jaccard.join(docs, n, num, den)
    sets = {r[0]: shingle_set(r[1], n) for r in rows}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]]
    want = union_find(sets, linked)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joined.result().collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_jaccard_edges(docs, none, rows, spark):
    assert jaccard.join(none).result().count() == 0
    twice = docs.unionAll(docs).withColumn("n", F.lit("clash")).withColumn("gram", F.lit(1))
    assert jaccard.join(twice).result().count() == 2 * len(rows)
    kept = jaccard.representatives(docs.unionAll(docs))
    assert kept.columns == docs.columns
    assert kept.count() == kept.select("doc_id").distinct().count()


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (None, 3), (1001, 1000)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long").repartition(5)).collect()}
    assert {got[i] for i in range(101)} == {0} and {got[500 + i] for i in range(60)} == {500} and got[1001] == got[1000] == 1000
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5 ----------------------------------------------------------------------------------------------------------------


def marked(data, length):
    """Which bytes lie in a string of `length` bytes that also starts elsewhere."""
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\x01" * length
        yield gone


def removed(texts, length=400, short=256, over=50):
    """(n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes, text without repeats and passages)."""
    data = [(t or "").encode() for t in texts]
    out = []
    for d, gone, part in zip(data, marked(data, length), marked(data, short), strict=True):
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        runs = [m.span() for m in re.finditer(rb"\x01+", bytes(part)) if len(re.findall(rb"[^\x20\x09-\x0D]+", d[m.start() : m.end()])) > over]
        both = bytearray(gone)
        for x, y in runs:
            both[x:y] = b"\x01" * (y - x)
        rest = bytes(x for x, g in zip(d, both, strict=True) if not g).decode(errors="ignore")
        out.append((len(d), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest(), len(runs), sum(y - x for x, y in runs), rest))
    return out


def test_suffix_removal(docs, rows):
    want = {r[0]: w[:6] for r, w in zip(rows, removed([r[1] for r in rows]), strict=True)}
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.removal(docs).collect()}
    assert got == want
    assert sum(w[1] for w in want.values()) > 2000
    assert sum(w[4] > 0 and w[1] == 0 for w in want.values()) >= 1


def test_suffix_removal_with_hot_cores(docs, rows, monkeypatch):
    """Cores dealt over several blocks meet by hash."""
    monkeypatch.setattr(suffixes, "SHARE", 2)
    want = {r[0]: w[:6] for r, w in zip(rows, removed([r[1] for r in rows]), strict=True)}
    assert {r["doc_id"]: tuple(r)[1:] for r in suffixes.removal(docs).collect()} == want


def test_planted_passages(spark):
    """Passages of 51 to 80 words that documents share go, whatever their bytes; all else stays as it is."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (51, 52, 55, 60, 70, 80)]
    shorter = prose(30)
    plain = [prose(r.randint(20, 300)) for _ in range(40)]
    texts = plain + [f"{prose(60)} {p} {prose(60)}" for p in passages for _ in range(3)] + [f"{prose(60)} {shorter} {prose(60)}" for _ in range(4)]
    table = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x for x in suffixes.cleaned(table).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        planted = [p for p in passages if p in t]
        if planted:
            assert planted[0][5:-5] not in got[i]["text"] and 700 < got[i]["n_chars"] == len(got[i]["text"]) < len(t) - 250
        else:
            assert got[i]["text"] == t
    assert [x["doc_id"] for x in suffixes.removal(table).where("n_passages > 0").orderBy("doc_id").collect()] == list(range(40, 58))


def test_suffix_edges(docs, rows, none):
    assert suffixes.removal(none).count() == 0
    assert suffixes.cleaned(none).count() == 0
    left = suffixes.cleaned(docs.withColumns({"k1": F.lit(7), "k2": F.col("doc_id"), "n": F.lit("x")}))
    assert left.columns == [*docs.columns, "k1", "k2", "n"]
    want = {}
    for r, w in zip(rows, removed([r[1] for r in rows]), strict=True):
        if w[6] == (r[1] or "") or re.search(r"[^\x20\x09-\x0D]", w[6]):
            want[r[0]] = r[1] if w[6] == (r[1] or "") else w[6]
    got = {x["doc_id"]: x for x in left.collect()}
    assert {i: x["text"] for i, x in got.items()} == want
    assert all(x["k1"] == 7 and x["k2"] == i and x["n"] == "x" for i, x in got.items())


def test_suffix_null_and_shared_ids(spark):
    text = " ".join(f"w{i}" for i in range(200))
    table = spark.createDataFrame([(None, "a " + text), (None, "b " + text), (4, "c " + text), (4, "short")], "doc_id long, text string")
    got = sorted((tuple(x) for x in suffixes.removal(table).collect()), key=lambda x: x[1])
    assert [(x[0], x[1], x[2], x[3]) for x in got][:1] == [(4, 5, 0, 0)]
    assert all(x[2] == len(text) + 1 and x[3] == 1 and x[5] == 1 for x in got[1:])


@pytest.mark.parametrize("trial", range(40))
def test_two_stage_sort(trial):
    r = random.Random(trial)
    text = np.array([r.randrange(r.choice([1, 2, 4, 250])) + r.choice([0, 3]) for _ in range(r.randint(1, 300))], np.uint8)
    depth, wanted = r.choice([2, 5, 16]), np.array([r.random() < 0.7 for _ in text])
    array = suffixes.two_stage(text, wanted, depth)
    padded = text.tobytes() + b"\0\xff" + bytes(depth + 8)
    keys = [padded[i : i + depth] for i in array]
    assert keys == sorted(keys) and sorted(array.tolist()) == np.flatnonzero(wanted).tolist()


# 8 ----------------------------------------------------------------------------------------------------------------


def test_mixing(docs, rows, none):
    got = mixing.mix(docs.withColumn("size", F.lit("clash"))).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    by = Counter()
    for r in rows:
        by[r[3]] += size[r[0]]
    weight = dict(zip(sorted([s for s in by if s is not None]) + [None] * (None in by), itertools.cycle([1, 2, 3])))
    target, open_, total = {}, set(by), sum(by.values())
    while True:
        share = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * by[s]}
        if not over:
            break
        target |= {s: 3 * by[s] for s in over}
        open_ -= over
    target |= {s: share * weight[s] for s in open_}
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[source[r["doc_id"]]] and r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        assert math.isclose(r["target"], target[source[r["doc_id"]]], rel_tol=1e-9)
        taken[source[r["doc_id"]]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 0.25 * target[s] + 300 for s in by), (taken, target, by)
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("trial", range(2))
def test_balancing_sources_and_values(spark, trial):
    """Newton's duals against proportional fitting, which has the same solution where no rate is cut."""
    r = random.Random(trial)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(1, 60))), r.choice(["en", "en", "de", None]), r.choice("aabcd")) for i in range(600)]
    cell = Counter()
    for _, t, v, s in rows:
        cell[s, v] += len(t.split())
    total, sources, values = sum(cell.values()), sorted({s for s, _ in cell}), [None, "de", "en"]
    target = {s: x for s, x in zip(sources, (0.9, 1.1, 1.2, 1.0), strict=True)}
    of = {s: sum(w for (x, _), w in cell.items() if x == s) for s in sources}
    scale = total / sum(target[s] * of[s] for s in sources)
    target = {s: target[s] * of[s] * scale for s in sources}
    share = {"en": 0.5, "de": 0.3, None: 0.2}
    rate = dict.fromkeys(cell, 1.0)
    for _ in range(2000):
        for s in sources:
            f = target[s] / sum(rate[c] * w for c, w in cell.items() if c[0] == s)
            rate |= {c: x * f for c, x in rate.items() if c[0] == s}
        for v in values:
            f = share[v] * total / sum(rate[c] * w for c, w in cell.items() if c[1] == v)
            rate |= {c: x * f for c, x in rate.items() if c[1] == v}
    assert max(rate.values()) < mixing.MOST
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = mixing.sized(docs, "lang")
    table = spark.createDataFrame([(s, of[s], 1, target[s]) for s in sources], "source string, source_size long, n long, target double")
    solved, duals = mixing.balanced(sizes, table, {v: share[v] * total for v in values})
    dual = {x["source"]: x["dual"] for x in solved.collect()}
    for (s, v), x in rate.items():
        assert math.isclose(math.exp(dual[s] + duals[v]), x, rel_tol=1e-7)
    taken = Counter()
    for x in mixing.mixed(docs, column="lang", values={v: share[v] * total for v in values}).collect():
        taken[x["lang"]] += len(x["text"].split())
    assert all(abs(taken[v] - share[v] * total) < 0.06 * total for v in values)


def test_mixing_shared_and_missing_ids(spark):
    rows = [(None, f"a b {i}", "s") for i in range(300)] + [(7, f"c {i} d e", "t") for i in range(300)] + [(7, "c 1 d e", "t")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source, size in ((900, 3), (1212, 4)):
        part = [x for x in got if x["source_size"] == source]
        assert all(x["size"] == size for x in part) and abs(sum(x["taken"] for x in part) - part[0]["target"]) < 30
    assert {x["source"] for x in mixing.mixed(docs).collect()} == {"s", "t"}
    assert mixing.mixed(docs).columns == docs.columns


# 3 ----------------------------------------------------------------------------------------------------------------


def test_language(spark, none):
    rows = [(i, words(R.randint(8, 60), lang), lang) for i in range(120) for lang in ["en", "de", "fr", "es"]]
    table = spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.fit(table.where("doc_id % 5 <> 2"))
    out = langid.identify(table.where("doc_id % 5 = 2").withColumn("score", F.lit("clash")), model)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    assert {a for _, a, _ in model.pairs} and model.groups.keys() == {"germanic", "romance"}
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "ß"), (5, "the water " * 30000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd, model).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", 0.0)] * 3 and got[4][0] != "und" and got[5][0] == "en"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.identify(odd, langid.fit(none)).where("lang_pred <> 'und'").count() == 0


# 4 ----------------------------------------------------------------------------------------------------------------


def plain_unfilter(kinds, rows):
    """The filters of the PNG specification, sample by sample."""
    out = [[0] * (len(rows[0]) + 1)]
    for kind, row in zip(kinds, rows, strict=True):
        line = [0]
        for c, v in enumerate(row, 1):
            a, b, d = line[c - 1], out[-1][c], out[-1][c - 1]
            p = a + b - d
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
            line.append((v + [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        out.append(line)
    return [line[1:] for line in out[1:]]


def test_png_round_trip_of_all_filters():
    for kinds in [(), (0,), (1,), (2,), (3,), (4,), (0, 1, 2, 3, 4)]:
        data = media.padded(bytes(R.randrange(256) for _ in range(R.choice([1, 64, 1000]))))
        png = media.encode_png(data, kinds=kinds)
        assert media.decode_png(png).tobytes() == data
    with pytest.raises(ValueError, match="checksum"):
        media.decode_png(png[:40] + bytes([png[40] ^ 1]) + png[41:])
    with pytest.raises(ValueError, match="signature"):
        media.decode_png(b"GIF89a")
    with pytest.raises(ValueError, match="ends inside"):
        media.decode_png(png[:15])


@pytest.mark.parametrize("trial", range(10))
def test_unfiltering_against_plain_form(trial):
    r = np.random.default_rng(trial)
    shapes = [(int(r.integers(1, 40)), int(r.choice([1, 7, 64]))) for _ in range(6)]
    images = [(r.integers(0, 5, h).astype(np.uint8), r.integers(0, 256, (h, w)).astype(np.uint8)) for h, w in shapes]
    for (kinds, rows), got in zip(images, media.unfiltered(images), strict=True):
        assert got.tolist() == plain_unfilter(kinds.tolist(), rows.tolist())


def test_filters_are_chosen_by_least_sum(monkeypatch):
    text = media.padded(words(3000).encode())
    kinds, rows = media.inflated(media.encode_png(text))
    assert len(set(kinds.tolist())) >= 2
    for forced in range(5):
        _, other = media.inflated(media.encode_png(text, kinds=(forced,)))
        size = lambda x: np.abs(x.view(np.int8).astype(int)).sum(1)
        assert (size(np.ascontiguousarray(rows)) <= size(np.ascontiguousarray(other))).all()
    monkeypatch.setattr(media, "TOGETHER", 500)
    assert media.decode_png(media.encode_png(text)).tobytes() == text


def test_media(docs, rows, none):
    images = media.stored(docs.withColumns({"media": F.lit(1), "hash": F.lit(1)}))
    assert dict(images.dtypes)["media"] == "binary"
    got = {r["doc_id"]: r for r in media.described(images).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert len(r["hash"]) == 8
    same = {}
    for i, t, *_ in rows:
        assert same.setdefault(t or "", got[i]["hash"]) == got[i]["hash"]
    assert media.described(media.stored(none)).count() == 0
    twice = media.described(media.stored(docs.unionAll(docs)))
    assert twice.count() == 2 * len(rows) and twice.distinct().count() == len(rows)
    assert [tuple(r)[2:] for r in media.described(images.limit(1).withColumn("media", F.lit(None).cast("binary"))).collect()] == [(None,) * 6]


# 10 ---------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = [(1, "http://A.Example.ORG/es/1?x=/y"), (2, "https://example.org/en/12#t"), (3, "https://notexample.org/es/"), (4, "http://x.com/fr/a"), (5, "http://com/de/"), (6, None), (7, "no scheme"), (8, "http://h?q"), (9, "x://a.net#f"), (10, "http://free-casino-bonus.example.net/win/jackpot"), (10, "http://free-casino-bonus.example.net/win/jackpot"), (11, "http://docs.example.net/guide/reading")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(table, urls.labelled_urls(spark)).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("notexample.org", "/es/", "org/", "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert [got[i][:3] for i in (6, 7)] == [("", "", None)] * 2
    assert got[8][:3] == ("h", "", None) and got[9][:3] == ("a.net", "", None)
    assert got[10][3] == "block" and got[11][3] == "allow"
    assert urls.judge(table.where("false"), urls.labelled_urls(spark)).count() == 0
    learned = urls.judge(urls.labelled_urls(spark), urls.labelled_urls(spark), rules=())
    assert learned.where("(verdict = 'allow') = (keep = 1)").count() == len(urls.LABELLED)


# 2 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return htmltext.train(htmltext.labelled_pages())


def test_html_on_held_out_pages(field):
    pages = htmltext.labelled_pages(99, 60)
    right = sum(x == y for page, labels in pages for x, y in zip(field.labels(htmltext.blocks(page), {}), labels, strict=True))
    assert right >= 0.98 * sum(len(labels) for _, labels in pages)


def test_html_rows(spark, field):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Menu<li><a href=/b>More</ul></nav><script>var x='</p>';</script>"
        "<article><h1>A &amp; B&nbsp;&eacute;</h1><p>First <b>bold</b>  text\n here.<p>Second&#33; part &lt;x&gt;<br>line.<div class='ad'>Buy this now, cheap.</div></article>"
        "<div class=comments><h3>Comments</h3><p>I agree with all of this, thank you.</p></div><footer>&copy; 2020 all rights reserved</footer>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p"), (5, "x", "<article><p>" + "long text here " * 20000 + "</p>")]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)), field).collect()}
    assert got[1]["text"] == "A & B é First bold text here. Second! part <x> line."
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and got[5]["n_chars"] == 15 * 20000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


# 6 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.Vocabulary.load(queries.PIECES))


def every_way(encoder, text):
    chars = pieces._chars(" " + text)
    ways = {0: [(0.0, ())]}
    for b, into in enumerate(encoder.edges(chars)):
        if b:
            ways[b] = [(s0 + s, i0 + ids) for a, s, ids in into for s0, i0 in ways[a]]
    return sorted(ways[len(chars)], key=lambda w: -w[0])


@pytest.mark.parametrize("trial", range(60))
def test_nbest_is_exact(encoder, trial):
    r = random.Random(trial)
    text = "".join(r.choice("the an,. \nonß▁²") for _ in range(r.randint(1, 8)))
    packed, score, best = encoder.encode(text, 5)
    want = every_way(encoder, text)[:5]
    assert [round(s, 8) for s, _ in best] == [round(s, 8) for s, _ in want]
    assert math.isclose(score, want[0][0]) and encoder.decode(packed) == text


@pytest.mark.parametrize("trial", range(30))
def test_nbest_ids_are_every_way(encoder, trial):
    r = random.Random(trial)
    text = "".join(r.choice("the an,. \nonß▁²") for _ in range(r.randint(1, 6)))
    want = every_way(encoder, text)
    score = {pieces._packed(ids): s for s, ids in want}
    for n in (1, 4, 9):
        packed, _, best = encoder.encode(text, n)
        assert best[0][1] == packed and len({ids for _, ids in best}) == len(best) == min(n, len(want))
        assert all(math.isclose(s, score[ids]) and encoder.decode(ids) == text for s, ids in best)


def test_equal_ways_are_all_returned():
    byte = list(range(256))
    vocabulary = pieces.Vocabulary.of({p: (256 + i, -1.0) for i, p in enumerate(["▁", "a", "b", "c", "ab", "bc"])}, byte, [bytes([b]) for b in byte] + [b" ", b"a", b"b", b"c", b"ab", b"bc"])
    for text in ("abc", "abc abc", "abc b abc"):
        e = pieces.Encoder(vocabulary)
        want = every_way(e, text)
        _, _, best = e.encode(text, 4)
        assert [s for s, _ in best] == [s for s, _ in want[:4]]
        assert len({ids for _, ids in best}) == min(4, len(want)) and {ids for _, ids in best} <= {pieces._packed(ids) for _, ids in want}


def test_words_measured_together(encoder):
    r = random.Random(6)
    words = {"".join(r.choice("the an,. \nonß▁²é日\U0001f600\x00") for _ in range(r.randint(1, 64))) for _ in range(3000)} | {" " * k for k in range(1, 65)}
    alone = pieces.Encoder(encoder.v)
    assert encoder.lattices.measured(list(words)) == {w: alone.word(w) for w in words}


def test_query_returns_nbest_ids(spark, tiny, encoder):
    got = queries.op6_sentencepiece(spark, tiny).collect()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    for r in got:
        ways = [pieces._packed(tuple(ids)) for ids in r["nbest_ids"]]
        assert len(set(ways)) == len(ways) == len(r["nbest_scores"]) and len(ways[0]) == 4 * r["n_pieces"]
        assert hashlib.sha256(ways[0]).hexdigest() == r["ids_sha256"] and {encoder.decode(w) for w in ways} == {text[r["doc_id"]]}


def test_pieces(docs, rows, none):
    got = {r["doc_id"]: r for r in pieces.encode(docs, queries.PIECES, nbest=3).collect()}
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) and r["nbest_scores"] == sorted(r["nbest_scores"], reverse=True) for r in got.values())
    assert got[next(r[0] for r in rows if r[1] is None)]["n_pieces"] == 0
    assert pieces.encode(none, queries.PIECES).count() == 0


# 1 ----------------------------------------------------------------------------------------------------------------


def test_embeddings(spark):
    r = np.random.default_rng(1)
    centre = r.standard_normal((40, 16))
    rows = [(i, (centre[i % 40] + 0.16 * r.standard_normal(16)).tolist(), i % 3) for i in range(1500)]
    rows += [(2000 + i, rows[5][1], rows[5][2]) for i in range(4)] + [(2100, rows[5][1], None)]
    rows += [(2200, None, 1), (2201, [], 1), (2202, [0.0] * 16, 1), (2203, [float("nan")] * 16, 1), (2204, [1.0] * 15 + [None], 1), (2205, [1.0, 2.0], 1), (2205, [1.0, 2.0], 1), (2206, [float("inf")] * 16, 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    good = {i: (np.array(v, np.float32).astype(float), k) for i, v, k in rows if v and k is not None and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    degree = Counter(x for p in links for x in p)
    got = rptrees.near_duplicates(table).collect()
    assert len(got) == len(rows)
    found = {r["vec_id"]: r for r in got}
    assert all(found[i]["n_links"] <= degree[i] for i in found)
    assert sum(r["n_links"] for r in found.values()) >= 0.97 * 2 * len(links) > 1000
    assert all(found[i]["n_links"] == 0 and found[i]["component_id"] == i for i in (2100, 2200, 2201, 2202, 2203, 2204, 2205, 2206))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert rptrees.near_duplicates(table.where("false")).count() == 0


def test_embeddings_in_large_leaves(spark, monkeypatch):
    """Leaves split in rounds, and groups that no split divides in pairs of blocks."""
    for name, value in (("LARGE", 60), ("BLOCK", 20), ("SAMPLE", 50)):
        monkeypatch.setattr(rptrees, name, value)
    r = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + 0.02 * r.standard_normal(8)).tolist(), 0) for i in range(150)] + [(200 + i, r.standard_normal(8).tolist(), 0) for i in range(150)]
    got = {x["vec_id"]: x for x in rptrees.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[i]["n_links"] >= 149 and got[i]["component_id"] == 0 for i in range(150))


def test_embeddings_edges(spark):
    """Scales far from 1, string labels, null ids, clashing columns."""
    rows = [(1, [1e-200, 0.0], "a"), (2, [0.0, 1e-200], "a"), (3, [2e200, 1e150], "a"), (4, [1.0, 0.0], "b"), (None, [1.0, 0.0], "a"), (5, [5.0, 0.0], "a"), (5, [5.0, 0.0], "a")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({"node": F.lit(1), "leaf": F.lit(2), "v": F.lit(3)})
    got = sorted((tuple(x) for x in rptrees.near_duplicates(table).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (2, 0, 2, True), (3, 2, 1, False), (4, 0, 4, True), (None, 0, None, None), (5, 2, 1, False), (5, 2, 1, False)], key=str)


@pytest.mark.parametrize("trial", range(5))
def test_block_comparison(trial):
    """Degrees of pairs that meet here first, and roots, against loops."""
    r = np.random.default_rng(trial)
    x = rptrees.unit(r.standard_normal((60, 3)))
    node, size = r.permutation(1000)[:60], r.integers(1, 4, 60)
    lists = [sorted(r.choice(12, 3, replace=False).tolist() + [9]) for _ in range(60)]
    ids, owner = np.array([i for v in lists for i in v]), np.repeat(np.arange(60), 4)
    before = rptrees._met_before(9, owner, ids, 60)
    cut = trial % 2 * 25
    left, right = (np.arange(60),) * 2 if not cut else (np.arange(cut), np.arange(cut, 60))
    got = rptrees.compared(x[left], x[right], node[left], node[right], (before[left], before[right]), (size[left], size[right]), 0.9)
    pairs = [(a, b) for a in left for b in right if a != b and x[a] @ x[b] >= 0.9]
    first = [(a, b) for a, b in pairs if min(set(lists[a]) & set(lists[b])) == 9]
    assert got[0].tolist() == [sum(size[b] for a, b in first if a == i) for i in left]
    assert got[1].tolist() == [sum(size[a] for a, b in first if b == i) for i in right]
    root = union_find(node.tolist(), [(int(node[a]), int(node[b])) for a, b in pairs])
    for own, found in ((left, got[2]), (right, got[3])):
        assert [int(v) for v in found] == [root[int(node[i])] for i in own]


# 9 ----------------------------------------------------------------------------------------------------------------


def test_scores(docs, rows, none):
    got = {r["doc_id"]: r for r in lmscore.score(docs.withColumn("chunk", F.lit("clash"))).collect()}
    held = {r[0]: zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows}
    toks = {r[0]: re.findall(rb"[^\x20\x09-\x0D]+", (r[1] or "").encode().lower()) + ["end"] for r in rows}
    c = Counter(x for i, t in toks.items() if not held[i] for x in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(t), sum(x in c for x in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel_tol=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] > 0
    assert lmscore.score(none).count() == 0


# the pipeline ----------------------------------------------------------------------------------------------------


def test_pipeline(spark, tmp_path, rows, docs):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out and all(r["round_trip"] for r in out.values())
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[i] and re.search(r"[^\W\d_]", texts[i]) for i in out)
    sets = {i: shingle_set(texts[i], 5) for i in out}
    assert all(100 * len(sets[a] & sets[b]) < 80 * len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2))


def test_pipeline_against_plain_form(spark, rows, docs):
    """Which documents and texts reach each stage: letters, near groups, repeated bytes and passages, copies of the mix."""
    from brightloom.llm import stages

    of = dict(stages.STAGES)
    kept = of["language"](spark, docs, "")
    texts = {r[0]: r[1] for r in rows if re.search(r"[^\W\d_]", r[1] or "")}
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == texts

    near = of["near_copies"](spark, kept, "")
    sets = {i: shingle_set(t, 5) for i, t in texts.items()}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = union_find(list(texts), pairs)
    texts = {i: t for i, t in texts.items() if root[i] == i}
    assert {r["doc_id"]: r["text"] for r in near.collect()} == texts

    unique = of["repeated_passages"](spark, near, "")
    left = {i: w[6] for (i, _), w in zip(texts.items(), removed(list(texts.values())), strict=True)}
    left = {i: t if t != texts[i] else texts[i] for i, t in left.items() if t == texts[i] or re.search(r"[^\x20\x09-\x0D]", t)}
    assert {r["doc_id"]: r["text"] for r in unique.collect()} == left
    assert sum(left[i] != texts[i] for i in left) >= 3

    mixture = of["source_mix"](spark, unique, "")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(unique).collect()}
    assert Counter((r["doc_id"], r["text"]) for r in mixture.collect()) == Counter({(i, left[i]): c for i, c in copies.items() if c})

    out = of["encoded"](spark, mixture, "").collect()
    encoder = pieces.Encoder(pieces.Vocabulary.load(queries.PIECES))
    assert Counter(r["doc_id"] for r in out) == Counter({i: c for i, c in copies.items() if c})
    for r in out:
        assert encoder.decode(pieces._packed(tuple(r["ids"]))) == left[r["doc_id"]]


# comparison SQL ----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, tiny, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    result = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    df = queries.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(result.fetchall())
