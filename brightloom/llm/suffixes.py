"""Removal of byte strings that occur more than once, by suffix arrays.

Two rules name bytes. A string of LENGTH bytes that also starts elsewhere is a repeat. A passage is a run of bytes covered by
strings of SHORT bytes that also start elsewhere, if it holds over WORDS words (counted in its own bytes). SHORT is below
what 50 words take in a written language, so a repeated passage of over WORDS words is found unless its words have
less than four letters on average. `removal` removes repeats and counts passages beside them; `cleaned` removes both.

Comparing all suffixes of a corpus in one array isn't possible, so starts are first brought together: each start of a
window of SHORT bytes belongs to the window's anchor (its least scrambled 64-byte substring) and to the anchor's
distance, in steps; equal windows have equal anchors, so they agree on the hash of a core that all windows of the step
contain. Only cores seen twice go on, with their bytes, into blocks.

A block is sorted in two stages: suffixes smaller than their successors are sorted directly; all others are induced by
scanning the buckets of first bytes in order. Neighbours whose common prefix has SHORT bytes are parts of passages, and of
those with LENGTH bytes left, neighbours that share all of them are repeats. A core with very many occurrences is dealt
over several blocks; windows single in their block then meet by hash.

Defined results: a null or empty text has no bytes and nothing to remove; a text shorter than SHORT keeps all; equal texts
of at least LENGTH bytes, or over WORDS words, are repeated whole; rows with the same doc_id, or none, are separate
documents. `removal` drops other columns; `cleaned` keeps them all, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, mixed, saved, utf8

LENGTH = 400
#: A passage has more than so many words; the windows by which it is found have so many bytes.
WORDS, SHORT = 50, 256
GRAM = 64
STEP = 128
#: Starts that are scanned at once; positions in it take 20 bits.
SEGMENT = 1 << 20
#: Occurrences of a core that one block takes.
SHARE = 128
BLOCK = 3 << 17
#: Texts up to which their keys are broadcast (32 bytes each) as a filter; above, texts are joined with a shuffle.
BROADCAST_KEYS = 500_000
_P = 0x9E3779B97F4A7C15


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    with np.errstate(over="ignore"):
        out[1:] = np.cumprod(np.full(n - 1, base % 2**64, np.uint64))
    return out


class Scanner:
    """The runs of window starts of a text: (core hash, first start, number of starts)."""

    def __init__(self, length: int):
        self.length, self.core = length, length - STEP + 1
        self.up = self.down = np.ones(1, np.uint64)

    def runs(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [self._segment(text[a : a + SEGMENT + self.length - 1], a) for a in range(0, len(text) - self.length + 1, SEGMENT)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))

    def _segment(self, b: np.ndarray, base: int):
        n = len(b)
        if n > len(self.up):
            self.up, self.down = _powers(max(n, 1 << 16), _P), _powers(max(n, 1 << 16), pow(_P, -1, 2**64))
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
            low = np.uint64(2**21 - 1)
            least = mixed((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1]) & ~low | np.arange(n - GRAM + 1, dtype=np.uint64)
            width, done = self.length - GRAM + 1, 1
            while done < width:
                by = min(done, width - done)
                least = np.minimum(least[:-by], least[by:])
                done += by
            anchor = (least & low).astype(np.int64)
            start = np.arange(n - self.length + 1)
            core = anchor - (anchor - start) // STEP * STEP
            first = np.flatnonzero(np.diff(core, prepend=-1) != 0)
            many = np.diff(first, append=len(start))
            at = core[first]
            key = mixed((total[at + self.core] - total[at]) * self.down[at])
        return key.astype(np.int64), (first + base).astype(np.int32), many.astype(np.int32)


def two_stage(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes that start where `wanted` holds, sorted by their first `depth` bytes at least.

    A suffix is of type S if it is smaller than its successor, else L. Types and orders count zero bytes after the end.
    """
    n = len(text)
    t = np.concatenate([text, np.array([0, 255], np.uint8), np.zeros(depth + 8, np.uint8)])
    m = n + 1  # position n is of type S, so each chain of successors ends in one
    differs = t[:m] != t[1 : m + 1]
    nxt = np.minimum.accumulate(np.where(differs, np.arange(m, dtype=np.int32), np.int32(m))[::-1])[::-1]
    small = (t[:m] < t[1 : m + 1])[nxt]
    # a wanted suffix needs its successors up to the next of type S
    s_at = np.flatnonzero(small)
    want = np.flatnonzero(wanted)
    until = s_at[np.searchsorted(s_at, want)]
    change = np.zeros(m + 1, np.int32)
    np.add.at(change, want, 1)
    np.add.at(change, until + 1, -1)
    active = np.cumsum(change[:m]) > 0
    # stage one: sort type S directly, by 8 bytes and, among ties, by all
    pos = np.flatnonzero(active & small)
    word = np.ndarray((m,), ">u8", t, strides=(1,))[pos].astype(np.uint64)
    order = np.argsort(word, kind="stable")
    pos, word = pos[order], word[order]
    equal = word[1:] == word[:-1]
    tied = np.flatnonzero(np.concatenate([equal, [False]]) | np.concatenate([[False], equal])) if len(pos) else pos
    if len(tied):
        rank = np.cumsum(np.concatenate([[True], ~equal]))[tied]
        rows = np.empty((len(tied), depth + 4), np.uint8)
        rows[:, :4] = rank.astype(">u4").view(np.uint8).reshape(-1, 4)
        rows[:, 4:] = np.ndarray((m, depth), np.uint8, t, strides=(1, 1))[pos[tied]]
        pos[tied] = pos[tied][np.argsort(rows.view(f"S{depth + 4}").ravel(), kind="stable")]
        del rows
    # stage two: scan the buckets in order; each suffix induces its predecessor if that is of type L
    edge = np.searchsorted(t[pos], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        mine = induced[c]
        k = 0
        while k < len(mine):  # runs of one byte induce inside their own bucket
            before = mine[k] - 1
            before = before[(before >= 0)]
            before = before[active[before] & (t[before] == c)]
            if len(before):
                mine.append(before)
            k += 1
        bucket = np.concatenate([*mine, pos[edge[c] : edge[c + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[active[before] & (t[before] > c)]
        if len(before):
            byte = t[before]
            by = np.argsort(byte, kind="stable")
            before, byte = before[by], byte[by]
            cut = np.flatnonzero(np.diff(byte)) + 1
            for part in np.split(before, cut):
                induced[t[part[0]]].append(part)
    full = np.concatenate(out) if out else pos
    keep = np.zeros(m, bool)
    keep[want] = True
    return full[keep[full]]


def words_in(text: np.ndarray) -> int:
    """Maximal runs of bytes that aren't white space."""
    return int(np.count_nonzero(np.diff(_SPACE[text].astype(np.int8), prepend=1) == -1)) if len(text) else 0


def shared_prefix(text: np.ndarray, array: np.ndarray, depth: int) -> np.ndarray:
    """Does the common prefix of each suffix of a suffix array and the one before it reach `depth` bytes?"""
    same = np.zeros(len(array), bool)
    if len(array) < 2:
        return same
    first, second = array[:-1], array[1:]
    if depth >= 8:  # most pairs differ in their last bytes
        word = np.ndarray((len(text) - 7,), np.uint64, text, strides=(1,))
        pairs = np.flatnonzero(word[first + (depth - 8)] == word[second + (depth - 8)])
    else:
        pairs = np.arange(len(first))
    rows = np.ndarray((len(text) - depth + 1,), f"S{depth}", text, strides=(1,))
    for a in range(0, len(pairs), 20_000):
        some = pairs[a : a + 20_000]
        same[some + 1] = rows[first[some]] == rows[second[some]]
    return same


def _scan(length: int):
    def run(batches):
        import pyarrow as pa

        scanner = Scanner(length)
        for batch in batches:
            data, at = utf8(batch.column("text"))
            found = [scanner.runs(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)]
            offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
            cols = [np.concatenate([f[j] for f in found]) if found else np.zeros(0, np.int64) for j in range(3)]
            words = pa.array([words_in(data[at[i] : at[i + 1]]) for i in range(batch.num_rows)], pa.int64())
            runs = pa.StructArray.from_arrays([pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32))], names=["key", "s", "m"])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("k1"), batch.column("k2"), batch.column("n"), words, pa.ListArray.from_arrays(pa.array(offsets), runs)], names=["doc_id", "k1", "k2", "n", "words", "runs"])

    return run


def _twice(batches):
    """Of rows sorted by key: those whose key has another row. A partition's first and last rows always stay."""
    import pyarrow as pa

    held, first = None, True
    for batch in batches:
        part = pa.Table.from_batches([batch])
        if held is not None:
            part = pa.concat_tables([held, part])
        if part.num_rows < 3:
            held = part
            continue
        key = part.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[first], same]) | np.concatenate([same, [False]])
        keep[-1] = False
        if not first:
            keep[0] = False  # it came out, or not, with the batch before
        yield from part.filter(pa.array(keep)).combine_chunks().to_batches()
        held, first = part.slice(part.num_rows - 2), False
    if held is not None:
        yield from held.slice(0 if first else 1).combine_chunks().to_batches()


def _pieces(batches, rows: int = 500):
    """Batches in slices, as lists of runs take much more memory in Python than in Arrow."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _cut(length: int):
    """Slices of the wanted runs of each text: as many bytes as windows of `length` cover, as far as the text goes."""

    def run(batches):
        import pyarrow as pa

        for batch in _pieces(batches):
            data, at = utf8(batch.column("text"))
            k1, k2 = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            rows: list[tuple] = []
            size = 0
            for i, runs in enumerate(batch.column("runs").to_pylist()):
                text = data[at[i] : at[i + 1]]
                for r in runs:
                    piece = text[r["s"] : r["s"] + r["m"] + length - 1].tobytes()
                    salt = hash((k1[i], r["s"])) % r["parts"] if r["parts"] > 1 else 0
                    rows.append((r["key"], salt, r["parts"], k1[i], k2[i], r["s"], r["m"], piece))
                    size += len(piece)
                    if size > 1 << 20:
                        yield _slices(pa, rows)
                        rows, size = [], 0
            if rows:
                yield _slices(pa, rows)

    return run


_SLICE = "key long, salt int, parts int, k1 long, k2 long, s int, m int, piece binary"


def _slices(pa, rows):
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _SLICE.split(", ")])


_FOUND = "kind int, w int, h1 long, h2 long, k1 long, k2 long, s int, m int"


def _blocks(length: int, short: int):
    """Suffix arrays over blocks of whole groups (key, salt), for windows of w bytes: `short` and `length`.

    kind 0: repeated starts; 1: a single start, and 2: a repeat, of a group dealt over several blocks.
    """

    def sort(rows):
        import pyarrow as pa
        import xxhash

        raw = b"".join(r[7] for r in rows)
        text = np.frombuffer(raw, np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r[7]) for r in rows])])
        many = np.array([r[6] for r in rows])
        dealt = np.array([r[2] > 1 for r in rows])
        owner = np.repeat(np.arange(len(rows)), many)
        shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        starts = at[owner] + shift
        wanted = np.zeros(len(text), bool)
        wanted[starts] = True
        slot = np.full(len(text), -1)
        slot[starts] = np.arange(len(starts))
        ends = at[1:][owner]
        array = two_stage(text, wanted, length)
        col = {j: np.array([r[j] for r in rows]) for j in (3, 4, 5)}
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = [x.split()[0] for x in _FOUND.split(", ")]

        def found(kind, w, which, many, hashed=None):
            """Rows for the starts with these numbers."""
            n, own = len(which), owner[which]
            zero = np.zeros(n, np.int64)
            h = np.frombuffer(b"".join(hashed), np.int64).reshape(n, 2) if hashed else np.stack([zero, zero], 1)
            there = (zero, zero, zero) if kind == 2 else (col[3][own], col[4][own], col[5][own] + shift[which])
            values = (np.full(n, kind), np.full(n, w), h[:, 0], h[:, 1], *there, many)
            return pa.RecordBatch.from_arrays([pa.array(v.astype(k.to_pandas_dtype())) for v, k in zip(values, kinds, strict=True)], names=names)

        def hashes(where, w):
            return [xxhash.xxh3_128_digest(raw[p : p + w]) for p in where.tolist()]

        for w in sorted({short, length}):
            fits = ends - starts >= w
            mine = array[fits[slot[array]]]
            same = shared_prefix(text, mine, w)
            twice = same | np.append(same[1:], False)
            hit = np.zeros(len(starts), bool)
            hit[slot[mine[twice]]] = True
            on = np.flatnonzero(hit)
            fresh = np.flatnonzero(np.concatenate([[True], (np.diff(on) != 1) | (np.diff(owner[on]) != 0)])[: len(on)])
            yield found(0, w, on[fresh], np.diff(fresh, append=len(on)))
            if dealt.any():
                single = np.flatnonzero(dealt[owner] & fits & ~hit)
                head = slot[mine[twice & ~same]]
                head = head[dealt[owner[head]]]
                yield found(1, w, single, np.ones(len(single)), hashes(starts[single], w))
                yield found(2, w, head, np.zeros(len(head)), hashes(starts[head], w))

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > BLOCK and r[:2] != rows[-1][:2]:
                    yield from sort(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield from sort(rows)

    return run


def keys(docs: DataFrame) -> DataFrame:
    """doc_id, text and two hashes of the text that name it."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("second"), text).alias("k2"), F.octet_length(text).cast("long").alias("n"))


def repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT) -> tuple[DataFrame, DataFrame]:
    """(texts that occur in several rows, with k1, k2, n, words; repeated windows of others: k1, k2, rep, spans array<struct<s, m, w>> of starts)."""
    named = keys(docs)
    raw = named.mapInArrow(_scan(short), "doc_id long, k1 long, k2 long, n long, words long, runs array<struct<key: long, s: int, m: int>>")
    texts = saved(raw.groupBy("k1", "k2").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("words").alias("words"), F.min("doc_id").alias("rep"), F.first("runs").alias("runs")), "texts")
    whole = texts.where(F.col("c") > 1).select("k1", "k2", "n", "words")
    runs = texts.select("k1", "k2", F.inline("runs")).select("key", "k1", "k2", "s", "m")
    lists = runs.repartitionByRange("key", "k1").sortWithinPartitions("key", "k1", "s")
    seen = saved(lists.mapInArrow(_twice, "key long, k1 long, k2 long, s int, m int"), "seen")
    hot = saved(seen.groupBy("key").count().where(F.col("count") > SHARE).select("key", F.ceil(F.col("count") / SHARE).cast("int").alias("parts")), "hot-cores")
    wanted = seen.join(hot, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    grouped = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("key", "s", "m", "parts")).alias("runs"))
    wants = saved(grouped.join(texts.select("k1", "k2", "rep"), ["k1", "k2"]), "wants")
    source = _of(named, wants.select("k1", "k2", "rep")).join(wants, ["k1", "k2"]).select("text", "k1", "k2", "runs")
    slices = source.mapInArrow(_cut(length), _SLICE)
    blocks = slices.repartition("key", "salt").sortWithinPartitions("key", "salt")
    found = saved(blocks.mapInArrow(_blocks(length, short), _FOUND), "found")
    loose = found.where("kind > 0")
    met = saved(loose.groupBy("h1", "h2", "w").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2", "w"), "met")
    more = found.where("kind = 1").join(met, ["h1", "h2", "w"]).select("k1", "k2", "s", "m", "w")
    starts = found.where("kind = 0").select("k1", "k2", "s", "m", "w").unionAll(more)
    spans = starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "m", "w")).alias("spans"))
    spans = spans.join(wants.select("k1", "k2", "rep"), ["k1", "k2"]).join(whole.select("k1", "k2"), ["k1", "k2"], "left_anti")
    return whole, saved(spans, "spans")


def _of(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of named for each wanted text (k1, k2, rep): by a broadcast filter while there are few, else left to the join that follows."""
    right = wanted.select(F.col("k1").alias("w1"), F.col("k2").alias("w2"), F.col("rep").alias("w_rep"))
    few = wanted.count() <= BROADCAST_KEYS
    on = (F.col("k1") == F.col("w1")) & (F.col("k2") == F.col("w2")) & F.col("doc_id").eqNullSafe(F.col("w_rep"))
    return named.join(F.broadcast(right) if few else right, on, "left_semi")


def covered(n: int, spans: list, w: int) -> np.ndarray:
    """Which of n bytes lie in a window of w bytes with one of the starts."""
    change = np.zeros(n + 1, np.int64)
    for r in spans:
        if r["w"] == w:
            change[r["s"]] += 1
            change[min(n, r["s"] + r["m"] - 1 + w)] -= 1
    return np.cumsum(change[:n]) > 0


def passages(text: np.ndarray, gone: np.ndarray, words: int) -> list[tuple[int, int]]:
    """The maximal runs of marked bytes that hold more than so many words."""
    edge = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2).tolist()
    return [(a, b) for a, b in edge if words_in(text[a:b]) > words]


_LEFT = "k1 long, k2 long, n_removed long, n_spans long, n_passages long, passage_bytes long, kept "


def _left(length: int, short: int, words: int, both: bool):
    """What each text with repeats loses, and its kept bytes; if `both`, passages go as well, and characters cut in two."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _LEFT.split(", ")]
        for batch in _pieces(batches):
            data, at = utf8(batch.column("text"))
            cols: list[list] = [[] for _ in names[2:]]
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[at[i] : at[i + 1]]
                gone = covered(len(text), spans, length)
                found = passages(text, covered(len(text), spans, short), words)
                if both:
                    gone = gone.copy()
                    for a, b in found:
                        gone[a:b] = True
                rest = text[~gone].tobytes()
                runs = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                values = (int(gone.sum()), runs, len(found), sum(b - a for a, b in found), rest.decode(errors="ignore") if both else rest)
                for col, v in zip(cols, values, strict=True):
                    col.append(v)
            kinds = [pa.int64()] * 4 + [pa.string() if both else pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return run


def changed(docs: DataFrame, length: int, short: int, words: int, both: bool) -> tuple[DataFrame, DataFrame]:
    """(texts that are repeated whole: k1, k2, n, words; texts that are in part: see _LEFT)."""
    whole, spans = repeats(docs, length, short)
    named = keys(docs)
    part = _of(named, spans.select("k1", "k2", "rep")).join(spans, ["k1", "k2"]).select("text", "k1", "k2", "spans")
    left = part.mapInArrow(_left(length, short, words, both), _LEFT + ("string" if both else "binary")).dropDuplicates(["k1", "k2"])
    return whole, left


def removal(docs: DataFrame, length: int = LENGTH, short: int = SHORT, words: int = WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, passage_bytes for each document."""
    whole, left = changed(docs, length, short, words, both=False)
    part = left.select("k1", "k2", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha"), "n_passages", "passage_bytes")
    all_of = F.col("n") >= length
    told = (F.col("n") >= short) & (F.col("words") > words)
    one = lambda c, v: F.when(c, v).otherwise(F.lit(0)).cast("long")
    full = whole.where(all_of | told).select(
        "k1", "k2", one(all_of, F.col("n")).alias("n_removed"), one(all_of, F.lit(1)).alias("n_spans"), F.when(all_of, F.sha2(F.lit(""), 256)).alias("sha"), one(told, F.lit(1)).alias("n_passages"), one(told, F.col("n")).alias("passage_bytes")
    )
    results = saved(part.unionAll(full), "results")
    rows = keys(docs).select("doc_id", "n", "k1", "k2", F.sha2("text", 256).alias("own"))
    counted = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans", "n_passages", "passage_bytes")]
    return rows.join(results, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_bytes"), *counted[:2], F.coalesce("sha", "own").alias("kept_sha256"), *counted[2:])


def cleaned(docs: DataFrame, length: int = LENGTH, short: int = SHORT, words: int = WORDS) -> DataFrame:
    """docs with repeats and passages removed from text; characters cut in two go as well, and so do documents of which only white space is left.

    The columns are kept; n_chars, where it exists, is counted anew for texts that changed.
    """
    whole, left = changed(docs, length, short, words, both=True)
    new = left.where("n_removed > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("kept").alias("_new"))
    gone = whole.where((F.col("n") >= length) | (F.col("n") >= short) & (F.col("words") > words)).select("k1", "k2", F.lit(""))
    all_new = saved(new.unionAll(gone), "new-texts")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({"_k1": F.xxhash64(text), "_k2": F.xxhash64(F.lit("second"), text)})
    out = rows.join(all_new, ["_k1", "_k2"], "left")
    put = {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        put["n_chars"] = F.when(F.col("_new").isNull(), F.col("n_chars")).otherwise(F.length("_new")).cast(docs.schema["n_chars"].dataType)
    return out.where(F.col("_new").isNull() | F.col("_new").rlike(r"[^\x20\x09-\x0D]")).withColumns(put).select(*docs.columns)
