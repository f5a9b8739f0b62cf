"""Similarity self-join on word n-grams by vertical partitioning.

Every document is the set of its hashed n-grams. A global order of n-grams (rarest first, judged by a fixed-size table of
counts over all documents; ties by hash) is cut into fragments. Documents that share an n-gram in the part of the order
where similar sets must meet are candidates; for each candidate pair, the overlap inside each fragment is counted
separately and the counts are summed per pair. Only pairs whose sum reaches the threshold are links.

Groups never cause all their pairs. Equal sets are one class, of which the smallest doc_id stands for all. Candidates come in
two rounds: first, each document in the list of an n-gram is compared with the one before it and with the first, the list being
sorted so that the least changed of near copies lead; links found contract documents into components. Then every pair of a list that lies in two components is a candidate,
leaving out only pairs already known to be connected. So components are exact, whatever the groups. Before whole sets
travel, a pair must share enough n-grams in the prefixes to reach the threshold with all that follows them.

Defined results: null or empty texts, and texts of white space, have an empty set and link with nothing; a text with fewer
words than n is one n-gram of all its words; equal texts are linked; rows that share a doc_id are the same node; a null
doc_id gets no links. Sets are compared by 64-bit hashes of n-grams and classes by 128 bits. Other columns are dropped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _SPACE, Powers, checked, chunked, discard, files_for, mixed, saved, utf8, word_hashes
from .components import components

COUNT_BITS = 18
FRAGMENTS = 4
#: Ids up to which a candidate table is broadcast (16 bytes each); above, texts are joined with a shuffle.
BROADCAST_IDS = 1_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingles(data: np.ndarray, at: np.ndarray, n: int, powers: Powers) -> Iterator[np.ndarray]:
    """The distinct n-gram hashes of each whole text (bytes at[i] to at[i + 1]), in order of hash."""
    for a, b in chunked(at):
        h, start = word_hashes(data[at[a] : at[b]], powers)
        # a word that runs on over the end of its text is cut there: texts that end in a word are hashed alone
        cut = np.searchsorted(start, at[a : b + 1] - at[a])
        inner = at[a + 1 : b] - at[a]
        joined = inner[(inner > 0) & (inner < at[b] - at[a])]
        part = data[at[a] : at[b]]
        if len(joined) and (~_SPACE[part[joined - 1]] & ~_SPACE[part[joined]]).any():
            each = [word_hashes(data[at[i] : at[i + 1]], powers)[0] for i in range(a, b)]
            h = np.concatenate(each)
            cut = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        with np.errstate(over="ignore"):
            total = h * _FACTORS[0]
            for i in range(1, n):
                total[: len(h) - i] += h[i:] * _FACTORS[i]
            total = mixed(total)
            for i, j in itertools.pairwise(cut.tolist()):
                if j - i >= n:
                    s = np.sort(total[i : j - n + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])]
                elif j > i:
                    one = np.uint64(j - i)
                    for v in h[i:j]:
                        one = one * _FACTORS[0] + v
                    yield mixed(np.array([one], np.uint64))
                else:
                    yield h[:0]


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    with np.errstate(over="ignore"):
        pairs = [(s.sum(dtype=np.uint64), mixed(s ^ _FACTORS[2]).sum(dtype=np.uint64)) for s in sets]
    return np.array(pairs, np.uint64).reshape(-1, 2).astype(np.int64)


def _slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _parts(batch, n: int, powers: Powers):
    """(doc_id column, n-gram sets) for pieces of a batch of bounded size."""
    data, at = utf8(batch.column("text"))
    for a in range(0, batch.num_rows, 1000):
        b = min(a + 1000, batch.num_rows)
        yield batch.column("doc_id").slice(a, b - a), list(shingles(data, at[a : b + 1], n, powers))


def _sets(n: int):
    """doc_id, n, k1, k2 for each text; at the end of a partition its n-gram counts as rows with n = -1."""

    def run(batches):
        import pyarrow as pa

        powers, count, names = Powers(), np.zeros(1 << COUNT_BITS, np.int64), ["doc_id", "n", "k1", "k2"]
        for batch in batches:
            for docs, sets in _parts(batch, n, powers):
                k = _keys(sets)
                count += np.bincount(_slots(np.concatenate(sets)), minlength=1 << COUNT_BITS)
                yield pa.RecordBatch.from_arrays([docs, pa.array([len(s) for s in sets], pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1])], names=names)
        full = np.flatnonzero(count)
        for a in range(0, len(full), 10_000):
            part = full[a : a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part), pa.int64()), pa.array(np.full(len(part), -1)), pa.array(part), pa.array(count[part])], names=names)

    return run


def _ordered(s: np.ndarray, count: np.ndarray) -> np.ndarray:
    """n-grams in the global order: rarest first, ties by hash."""
    return s[np.argsort(count[_slots(s)], kind="stable")]


def prefix_length(n: int, num: int, den: int) -> int:
    """Sets with a similarity of num / den or more meet in this many first n-grams."""
    return n - (num * n + den - 1) // den + 1


def _lists(pa, lists: list[np.ndarray]):
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(lists).astype(np.int64)))


def _prefixes(n: int, num: int, den: int, sent):
    def run(batches):
        import pyarrow as pa

        powers, count = Powers(), np.frombuffer(sent.value, np.uint32)
        for batch in batches:
            for docs, sets in _parts(batch, n, powers):
                k = _keys(sets)
                first = [_ordered(s, count)[: prefix_length(len(s), num, den) if len(s) else 0] for s in sets]
                yield pa.RecordBatch.from_arrays([docs, pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([len(s) for s in sets], pa.int32()), _lists(pa, first)], names=["doc_id", "k1", "k2", "n", "grams"])

    return run


def _segments(n: int, sent, cuts: np.ndarray):
    """doc, grams: a set cut at the fragments of the global order, a list for each."""

    def run(batches):
        import pyarrow as pa

        powers, count, m = Powers(), np.frombuffer(sent.value, np.uint32), len(cuts) + 1
        for batch in batches:
            for docs, sets in _parts(batch, n, powers):
                at = [np.searchsorted(cuts, count[_slots(s)], side="right") for s in sets]
                inner = _lists(pa, [s[x == f] for s, x in zip(sets, at, strict=True) for f in range(m)])
                outer = pa.array(np.arange(0, m * len(sets) + 1, m, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([docs, pa.ListArray.from_arrays(outer, inner)], names=["doc", "grams"])

    return run


_LISTED = "gram long, doc long, n int, pos int, p_doc long, p_n int, p_pos int, l_doc long, l_n int, l_pos int"


def _neighbours(batches):
    """Of entries sorted by (gram, pos): those whose gram has another entry, with the entry before and the list's first entry.

    The first and last entries of a partition always stay, as their list may go on in another one.
    """
    import pyarrow as pa

    names = ["gram", "doc", "n", "pos"]
    held = None  # the last two rows so far; of the second, the successor isn't known
    first = True
    head = None  # of the list that the first held row is in

    def out(cols, keep, same):
        before = np.concatenate([[False], same])
        at = np.maximum.accumulate(np.where(before, 0, np.arange(len(before))))
        arrays = [pa.array(cols[c][keep]) for c in names]
        arrays += [pa.array(np.concatenate([cols[c][:1], cols[c][:-1]])[keep], mask=~before[keep]) for c in names[1:]]
        heads = {c: np.where(at == 0, head[c], cols[c][at]).astype(cols[c].dtype) if head else cols[c][at] for c in names[1:]}
        arrays += [pa.array(heads[c][keep], mask=~before[keep]) for c in names[1:]]
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in _LISTED.split(", ")]), {c: v[-2:-1] for c, v in heads.items()}

    for batch in batches:
        cols = {c: batch.column(c).to_numpy() for c in names}
        if held is not None:
            cols = {c: np.concatenate([held[c], cols[c]]) for c in names}
        if len(cols["gram"]) < 3:
            held = cols
            continue
        same = cols["gram"][1:] == cols["gram"][:-1]
        keep = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        if not first:
            keep[0] = False  # it came out, or not, with the batch before
        keep[-1] = False
        made, head = out(cols, keep, same)
        yield made
        held = {c: cols[c][-2:] for c in names}
        first = False
    if held is not None:
        keep = np.ones(len(held["gram"]), bool)
        keep[0] = first
        yield out(held, keep, held["gram"][1:] == held["gram"][:-1])[0]


@dataclass
class Joined:
    """sets: doc_id, n, k1, k2. classes: k1, k2, n, rep. links: a, b, overlap (classes' representatives, a < b), with overlap / union at or above the threshold."""

    sets: DataFrame
    classes: DataFrame
    links: DataFrame
    groups: DataFrame

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id for each document."""
        named = self.classes.join(self.groups, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
        named = saved(named, "jaccard-classes")
        full = self.sets.where("n > 0").join(named, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
        empty = self.sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return full.unionAll(empty)


def join(docs: DataFrame, words: int = 4, num: int = 85, den: int = 100) -> Joined:
    """Links documents whose sets have a Jaccard similarity of num / den or more."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = saved(texts.mapInArrow(_sets(words), "doc_id long, n long, k1 long, k2 long"), "sets")
    sets = both.where("n >= 0")
    count = np.zeros(1 << COUNT_BITS, np.uint32)
    for k, v in both.where("n < 0").groupBy("k1").agg(F.sum("k2").alias("c")).toLocalIterator():
        count[k] = min(v, 0xFFFFFFFF)
    sent = spark.sparkContext.broadcast(count.tobytes())  # 1 MB whatever the corpus
    order = np.sort(count)
    mass = np.cumsum(order, dtype=np.float64)
    cuts = np.unique(order[np.searchsorted(mass, mass[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS).clip(max=len(order) - 1)])

    classes = saved(sets.where("n > 0").groupBy("k1", "k2").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep")).where("rep is not null"), "classes")
    key = classes.select(F.col("rep").alias("doc_id"), "k1", "k2")
    prefix = texts.mapInArrow(_prefixes(words, num, den, sent), "doc_id long, k1 long, k2 long, n int, grams array<long>")
    prefixes = saved(prefix.join(key, ["doc_id", "k1", "k2"]).select("doc_id", "n", "grams"), "prefixes")
    entries = prefixes.select(F.col("doc_id").alias("doc"), "n", F.posexplode("grams").alias("pos", "gram")).select("gram", "doc", "n", "pos")
    # sorted by position, a list begins with the document that has the fewest rarer n-grams: of near copies, the least changed
    order = ["gram", "pos", F.xxhash64("gram", "doc"), "doc"]
    lists = entries.repartitionByRange(*order).sortWithinPartitions(*order)
    listed = saved(lists.mapInArrow(_neighbours, _LISTED), "lists")

    beside = [listed.select("doc", "n", "pos", F.col(f"{k}_doc").alias("p_doc"), F.col(f"{k}_n").alias("p_n"), F.col(f"{k}_pos").alias("p_pos")) for k in "pl"]
    near = beside[0].unionAll(beside[1]).where("p_doc is not null and p_doc != doc").where(_meets(num, den))
    pairs = saved(near.select(F.least("doc", "p_doc").alias("a"), F.greatest("doc", "p_doc").alias("b")).distinct(), "near")
    left = prefixes.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grams").alias("x"))
    right = prefixes.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("y"))
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("x", "y")).alias("shared"))
    pairs = saved(counted.where(_reaches(num, den)).select("a", "b"), "near-enough")
    links = _verified(texts, pairs, words, sent, cuts, num, den)

    known = saved(components(links).coalesce(files_for(2 * links.count())), "known")
    side = saved(listed.select("gram", "doc", "n", "pos").distinct().join(known, F.col("doc") == F.col("node"), "left").select("gram", "doc", "n", "pos", F.coalesce("component", "doc").alias("c")), "sides")
    discard(prefixes, listed)
    # of each list, the component with most entries need not be held against itself
    parts = side.groupBy("gram", "c").count()
    main = saved(parts.groupBy("gram").agg(F.max(F.struct("count", "c"))["c"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("gram", "main"), "main")
    inner = saved(side.join(main, "gram"), "open")
    # of a document's entries in these lists, k in all and i before this one: what two documents can share lies in both
    mine = Window.partitionBy("doc")
    placed = inner.withColumn("k", F.count("*").over(mine)).withColumn("i", F.row_number().over(mine.orderBy("pos", "gram")) - 1)
    open_lists = saved(placed, "open-lists")
    one = open_lists.where("c != main").select("gram", *[F.col(x).alias(f"p_{x}") for x in ("doc", "n", "pos", "c", "k", "i")])
    cross = open_lists.join(one, "gram").where("c != p_c and (p_doc < doc or c = main)").where(_meets(num, den)).where(_reaches(num, den, "(least(i, p_i) + least(k - i, p_k - p_i))", "n", "p_n"))
    # two documents in different components meet once in each list that both are in
    first = F.col("doc") < F.col("p_doc")
    pick = lambda x: (F.when(first, F.col(x)).otherwise(F.col(f"p_{x}")), F.when(first, F.col(f"p_{x}")).otherwise(F.col(x)))
    (a, b), (na, nb) = pick("doc"), pick("n")
    counted = cross.select(a.alias("a"), b.alias("b"), na.alias("na"), nb.alias("nb")).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    pairs = saved(counted.where(_reaches(num, den)).select("a", "b"), "cross-enough")
    links = links.unionAll(_verified(texts, pairs, words, sent, cuts, num, den))
    return Joined(sets, classes, links, saved(components(links).coalesce(files_for(2 * links.count())), "groups"))


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one document of each group of near copies: its smallest doc_id; of rows that share a doc_id, that of the least text, then hash."""
    joined = join(docs, words, num, den)
    gone = saved(joined.result().where("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    kept = docs.join(checked(gone, BROADCAST_IDS), "doc_id", "left_anti").select(*docs.columns)
    twice = saved(joined.sets.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    if twice.isEmpty():
        return kept
    again = checked(twice, BROADCAST_IDS)
    shared = kept.join(again, "doc_id", "left_semi").select(*docs.columns)
    least = F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns)))
    one = shared.groupBy("doc_id").agg(least.alias("_row")).select("_row.*")
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionAll(one)


def _meets(num: int, den: int) -> str:
    """Can sets of n and p_n n-grams reach the threshold that share an n-gram at pos and p_pos? All before and after may be shared."""
    most = "(least(pos, p_pos) + least(n - pos, p_n - p_pos))"
    return f"{den}L * least(n, p_n) >= {num}L * greatest(n, p_n) and {num + den}L * {most} >= {num}L * (n + p_n)"


def _reaches(num: int, den: int, shared: str = "shared", na: str = "na", nb: str = "nb") -> str:
    """Can two sets of na and nb n-grams, `shared` of them in both prefixes, reach the threshold?

    What follows the prefix that ends first in the order adds at most all of its set's other n-grams.
    """
    rest = lambda n: f"(({num}L * {n} + {den - 1}) div {den} - 1)"
    return f"{num + den}L * ({shared} + greatest({rest(na)}, {rest(nb)})) >= {num}L * ({na} + {nb})"


def _verified(texts: DataFrame, pairs: DataFrame, words: int, sent, cuts, num: int, den: int) -> DataFrame:
    """Of candidate pairs (a, b) the links: overlaps counted in each fragment, summed per pair."""
    n = files_for(2 * pairs.count())
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct().coalesce(n), "candidates")
    few = ids.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    segments = saved(chosen.mapInArrow(_segments(words, sent, cuts), "doc long, grams array<array<long>>"), "segments")
    left = segments.select(F.col("doc").alias("a"), F.col("grams").alias("x"))
    right = segments.select(F.col("doc").alias("b"), F.col("grams").alias("y"))
    met = pairs.join(left, "a").join(right, "b")
    total = lambda parts: F.aggregate(parts, F.lit(0).cast("long"), lambda s, k: s + k)
    partial = F.zip_with("x", "y", lambda p, q: F.size(F.array_intersect(p, q)))
    size = lambda c: total(F.transform(c, F.size))
    summed = met.select("a", "b", total(partial).alias("overlap"), (size("x") + size("y")).alias("both"))
    links = summed.where(f"{num + den}L * overlap >= {num}L * both").select("a", "b", "overlap").dropDuplicates(["a", "b"])
    out = saved(links.coalesce(files_for(pairs.count(), 5_000)), "links")
    discard(segments, ids)
    return out
