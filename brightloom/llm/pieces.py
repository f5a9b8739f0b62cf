"""SentencePiece encoding and decoding with n-best segmentation.

A text is a lattice of vocabulary pieces. Forward Viterbi scores give, for each position, the best way from the start;
they are exact heuristics for an A-star search that goes backward from the end and yields segmentations best first.

No piece of usual vocabularies crosses from another character to a space mark, nor between letters and other characters, so
the lattice of a text falls into those of its words and of what stands between; the vocabulary is tested for both, and texts
with one of its exceptions are divided at spaces only. The best segmentation of a text
joins its words'; its next ones change the few words that lose least. Words are remembered in each task up to a bound; the
new ones of some megabytes of text are measured together in arrays, long ones by themselves.

Scores of a unigram model are log-probabilities and taken as they are. A byte-pair model has ranks instead; they become
log-probabilities by Zipf's law. A character without a piece is spelled in byte pieces; so is a literal space mark,
so decoding gives back every text exactly. Control pieces never match text.

Defined results: a null text is the empty text, which has no pieces and score 0; texts are encoded whole; equal texts
have equal results, rows that repeat or share a doc_id each have their own. Of equally good ways through a word, the best has
the longest last piece, then the longest before it, and so on; the next ones of a word come by fewer pieces, then ids, those of
a text by the first word that changes. No two of the n best have the same ids; a text with fewer ways has them all. The vocabulary is read on the driver from a
path given as a parameter and travels with the tasks. Input columns other than doc_id and text are dropped.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunked, utf8

MARK = "▁"
#: Words of one generation that a task remembers; the generation before it stays as well.
REMEMBERED = 350_000
#: Letters, or other characters, with the spaces before them.
_RUN = re.compile(r" *[^\W\d_]+| *(?:(?![^\W\d_])[^ ])+| +")
_WORD = re.compile(r" *[^ ]+| +")


@dataclass
class Vocabulary:
    """ids: text of a piece to (id, log-probability); byte: ids of the 256 byte pieces or unknown; shown: bytes of each id."""

    ids: dict[str, tuple[int, float]]
    byte: list[int]
    byte_score: float
    shown: list[bytes]
    dummy_prefix: bool = True
    starts: dict[str, tuple[int, float] | None] = field(default_factory=dict)
    pairs: set[str] = field(default_factory=set)
    splits: bool = True
    crossing: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in byte):
            raise ValueError("the vocabulary has no byte pieces, so not every text can be decoded")
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        if all(s == int(s) for s in scores.values()):
            order = sorted(plain, key=lambda i: (-scores[i], i))
            total = sum(1 / k for k in range(1, len(order) + 2))
            scores = {i: -math.log(k * total) for k, i in enumerate(order, 1)}
        shown = [bytes([byte.index(i)]) if sp.is_byte(i) else names[i].replace(MARK, " ").encode() if i in scores else b"" for i in range(n)]
        prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        return cls.of({names[i]: (i, s) for i, s in scores.items()}, byte, shown, prefix)

    @classmethod
    def of(cls, ids: dict[str, tuple[int, float]], byte: list[int], shown: list[bytes], prefix: bool = True) -> Vocabulary:
        out = cls(ids, byte, min(s for _, s in ids.values()) - 1.0, shown, prefix)
        for piece in ids:
            out.starts.update((piece[:k], ids.get(piece[:k])) for k in range(1, len(piece) + 1))
            out.pairs.update(a + b for a, b in itertools.pairwise(piece))
        out.splits = not any(p[1] == MARK and p[0] != MARK for p in out.pairs)
        letter = re.compile(r"[^\W\d_]").match
        out.crossing = sorted(p for p in out.pairs if p[0] != MARK and (letter(p[0]) is None) != (letter(p[1]) is None))
        return out


class Lattices:
    """The vocabulary as a trie in arrays: measures many short words at once, with the numbers that Encoder.word gives one by one."""

    #: Characters of a word, and of all words together times the longest piece.
    LONGEST, CELLS = 64, 2_000_000
    #: Slots of the table that leads from a node and a character to the next node, at least.
    BITS = 19

    def __init__(self, v: Vocabulary):
        self.v, self.depth, self.BITS = v, max(map(len, v.ids)), max(self.BITS, len(v.starts).bit_length() + 1)
        chars = sorted({c for p in v.ids for c in p})
        self.kinds, kind = np.zeros(0x110000, np.int32), {c: i for i, c in enumerate(chars, 1)}
        self.kinds[list(map(ord, chars))] = np.arange(1, len(chars) + 1)
        number, self.width = {p: i for i, p in enumerate(v.starts, 1)} | {"": 0}, len(chars) + 1
        keys = np.fromiter((number[p[:-1]] * self.width + kind[p[-1]] for p in v.starts), np.int64, len(v.starts))
        self.keys, self.child = np.full(1 << self.BITS, -1, np.int64), np.zeros(1 << self.BITS, np.int64)
        self.tries, left, slot = 0, np.arange(len(keys)), self._slots(keys)
        while len(left):
            self.tries += 1
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]
            mine = self.keys[slot] == keys[left]
            self.child[slot[mine]] = left[mine] + 1
            left, slot = left[~mine], (slot[~mine] + 1) % len(self.keys)
        self.ids = np.array([-1] + [-1 if hit is None else hit[0] for hit in v.starts.values()], np.int32)
        self.scores = np.array([-math.inf] + [-math.inf if hit is None else hit[1] for hit in v.starts.values()])
        self.bytes = np.array(v.byte, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _after(self, node: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The nodes that follow by characters of these kinds; 0: none."""
        keys = node * self.width + kind
        slot = self._slots(keys)
        out = np.where(self.keys[slot] == keys, self.child[slot], 0)
        left = np.flatnonzero((out == 0) & (self.keys[slot] >= 0))
        for k in range(1, self.tries):
            if not len(left):
                break
            at = (slot[left] + k) % len(self.keys)
            hit = self.keys[at] == keys[left]
            out[left[hit]] = self.child[at[hit]]
            left = left[~hit & (self.keys[at] >= 0)]
        return out

    def measured(self, words: list[str]) -> dict[str, tuple[bytes, float, float]]:
        """What Encoder.word returns, for words of at most LONGEST characters."""
        words = sorted(words, key=len, reverse=True)
        out, most = {}, max(1, self.CELLS // self.depth)
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))])
        for a, b in chunked(at, most):
            out.update(zip(words[a:b], self._measured(words[a:b], np.diff(at[a : b + 1])), strict=True))
        return out

    def _measured(self, words: list[str], n: np.ndarray):
        """Words come longest first; a word of n characters has n + 1 places, the first `depth` places belong to none."""
        codes = np.frombuffer(_chars("".join(words)).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        base = self.depth + np.cumsum(n + 1) - (n + 1)
        size = self.depth + int((n + 1).sum())
        place = np.arange(len(codes)) + self.depth + np.repeat(np.arange(len(n)), n)
        kind = np.zeros(size, np.int32)
        kind[place] = self.kinds[codes]
        score, piece = np.full((self.depth, size), -math.inf), np.full((self.depth, size), -1, np.int32)
        # all starts walk down the trie together; kind 0 ends a walk, at a word's end too
        start, node = place, np.zeros(len(place), np.int64)
        for k in range(min(self.depth, int(n[0]))):
            node = self._after(node, kind[start + k])
            on = node > 0
            start, node = start[on], node[on]
            score[k, start], piece[k, start] = self.scores[node], self.ids[node]
        length = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        raw = np.isneginf(score[0, place])
        score[0, place[raw]] = self.v.byte_score * length[raw]

        forward, came, flat = np.full(size, -math.inf), np.zeros(size, np.int64), score.ravel()
        forward[base] = 0.0
        longer = np.searchsorted(-n, -np.arange(int(n[0]) + 1), side="right")
        for j in range(1, int(n[0]) + 1):
            q, by = base[: longer[j]] + j, np.arange(min(j, self.depth), 0, -1)[:, None]
            ways = forward[q - by] + flat[(by - 1) * size + q - by]
            first = ways.argmax(0)
            forward[q], came[q] = ways[first, np.arange(len(q))], by[first, 0]
        end = base + n
        taken, at, since = np.zeros(size, np.int64), end, base
        while len(at):
            a = at - came[at]
            taken[a] = came[at]
            at, since = a[a > since], since[a > since]
        backward, second = np.full(size, -math.inf), np.full(len(n), -math.inf)
        backward[end] = 0.0
        for j in range(1, int(n[0]) + 1):
            m = longer[j]
            p, by = end[:m] - j, np.arange(1, min(j, self.depth) + 1)[:, None]
            ways = flat[(by - 1) * size + p] + backward[p + by]
            backward[p] = ways.max(0)
            ways += forward[p]
            best = np.flatnonzero(taken[p])
            ways[taken[p[best]] - 1, best] = -math.inf
            np.maximum(second[:m], ways.max(0), out=second[:m])

        p = np.flatnonzero(taken)
        ids = piece[taken[p] - 1, p]
        char = np.zeros(size, np.int64)
        char[place] = np.arange(len(codes))
        count = np.where(ids < 0, length[char[p]], 1)
        spelled = "".join(map(chr, codes[char[p[ids < 0]]])).replace(_LITERAL, MARK).encode()
        ids = np.repeat(ids, count)
        ids[ids < 0] = self.bytes[np.frombuffer(spelled, np.uint8)]
        cuts = (4 * np.append(np.concatenate([[0], np.cumsum(count)])[np.searchsorted(p, base)], len(ids))).tolist()
        packed = ids.tobytes()
        best = forward[end]
        return zip([packed[a:b] for a, b in itertools.pairwise(cuts)], best.tolist(), np.maximum(best - second, 0.0).tolist(), strict=True)


class Encoder:
    """Best and n-best segmentations; remembers words up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, tuple[bytes, float, float]] = {}
        self.lattices = Lattices(vocabulary)
        self.known: dict[tuple[str, int], list[tuple[float, bytes, bool]]] = {}
        self.old_words: dict[str, tuple[bytes, float, float]] = {}

    @functools.cached_property
    def trie(self) -> dict:
        out: dict = {}
        for piece, hit in self.v.ids.items():
            node = out
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = hit
        return out

    def spelled(self, char: str) -> tuple[int, ...]:
        return tuple(self.v.byte[x] for x in (MARK if char == _LITERAL else char).encode())

    def edges(self, chars: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, the pieces that end there: (start, score, ids). In chars, a space is a mark and a literal mark is \\0's stand-in."""
        v, n = self.v, len(chars)
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        starts, ids = v.starts, v.ids
        for a in range(n):
            for b in range(a + 1, n + 1):
                hit = starts.get(chars[a:b], False)
                if hit:
                    into[b].append((a, hit[1], (hit[0],)))
                elif hit is False:
                    break
            if chars[a] not in ids:
                raw = self.spelled(chars[a])
                into[a + 1].append((a, v.byte_score * len(raw), raw))
        return into

    def search(self, chars: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations, best first: forward Viterbi, then A-star backward from the end with its scores as heuristic."""
        into = self.edges(chars)
        best = [0.0] * len(into)
        for b in range(1, len(into)):
            best[b] = max(best[a] + s for a, s, _ in into[b])
        out: list[tuple[float, tuple[int, ...]]] = []
        heap = [(-best[-1], 0, (), len(into) - 1, 0.0)]
        while heap and len(out) < n:
            total, count, ids, at, done = heapq.heappop(heap)
            if at == 0:
                out.append((-total, ids))
                continue
            for a, s, new in into[at]:
                heapq.heappush(heap, (-(best[a] + s + done), count + len(new), new + ids, a, s + done))
        return out

    def word(self, word: str) -> tuple[bytes, float, float]:
        """(packed ids, score, what the second best loses) of a part of a text that pieces don't leave.

        The second best uses an edge off the best way, so it is the best way through such an edge: forward and backward
        Viterbi scores give it without a search.
        """
        found = self.old_words.get(word)
        if found is None:
            chars = _chars(word)
            n, root, ids_of = len(chars), self.trie, self.v.ids
            forward, came, edges = [0.0] + [-math.inf] * n, [(0, ())] * (n + 1), []
            for a in range(n):
                here, node, b = forward[a], root, a
                for c in chars[a:]:
                    node = node.get(c)
                    if node is None:
                        break
                    b += 1
                    hit = node.get("")
                    if hit is not None:
                        s = hit[1]
                        edges.append((a, b, s))
                        if here + s > forward[b]:
                            forward[b], came[b] = here + s, (a, hit[:1])
                if chars[a] not in ids_of:
                    raw = self.spelled(chars[a])
                    s = self.v.byte_score * len(raw)
                    edges.append((a, a + 1, s))
                    if here + s > forward[a + 1]:
                        forward[a + 1], came[a + 1] = here + s, (a, raw)
            ids, at, on = (), n, set()
            best = forward[n]
            while at:
                a, new = came[at]
                on.add((a, at))
                ids, at = new + ids, a
            backward, second = [-math.inf] * n + [0.0], -math.inf
            for a, b, s in reversed(edges):
                t = s + backward[b]
                if t > backward[a]:
                    backward[a] = t
                if t + forward[a] > second and (a, b) not in on:
                    second = t + forward[a]
            found = (_packed(ids), best, max(0.0, best - second))
        if len(self.words) >= REMEMBERED:
            self.old_words, self.words = self.words, {}
        self.words[word] = found
        return found

    def learn(self, words: list[str]) -> list[tuple[bytes, float, float]]:
        """What word returns, for each of some different words; the short ones that are new are measured together."""
        if len(self.words) + len(words) > REMEMBERED:
            self.old_words, self.words = self.words, {}
        known, old = self.words, self.old_words
        short = [w for w in words if w not in known and w not in old and len(w) <= self.lattices.LONGEST]
        if short:
            known.update(self.lattices.measured(short))
        return [self.words.get(w) or self.word(w) for w in words]

    def ways(self, word: str, own: bytes, n: int) -> list[tuple[float, bytes, bool]]:
        """(what it loses, packed ids, whether they decode to the same bytes) of the n - 1 segmentations of a word that follow its best, `own`.

        A few words are remembered, as texts often lose least in the same ones.
        """
        found = self.known.get((word, n))
        if found is None:
            if len(self.known) >= REMEMBERED // 10:
                self.known.clear()
            # of equal ways the search may find another one first
            ways, shown = self.search(_chars(word), n), self.shown(own)
            others = [(ways[0][0] - s, _packed(ids)) for s, ids in ways]
            found = self.known[word, n] = [(s, ids, self.shown(ids) == shown) for s, ids in others if ids != own][: n - 1]
        return found

    def split(self, text: str) -> list[str]:
        text = f" {text}" if self.v.dummy_prefix and text else text
        if not self.v.splits:
            return [text] * bool(text)
        # where a piece could join letters to other characters, words stay whole
        joined = len(self.v.crossing) > 20 or any(p in text for p in self.v.crossing)
        return (_WORD if joined else _RUN).findall(text)

    def encode(self, text: str, n: int = 1) -> tuple[bytes, float, list[tuple[float, bytes]]]:
        """(packed ids, score, the n best as (score, packed ids)) of a whole text."""
        return next(self.encoded([text], n))[:3]

    def encoded(self, texts: list[str], n: int):
        """For each text what encode returns, and whether all of its n best decode to the same bytes."""
        split = [self.split(t) for t in texts]
        words = list(itertools.chain.from_iterable(split))
        place = {w: i for i, w in enumerate(set(words))}
        found = self.learn(list(place))
        code = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
        each = [f[0] for f in found]
        size = np.fromiter(map(len, each), np.int64, len(each)) // 4
        since, many = (np.cumsum(size) - size)[code], size[code]
        at = np.concatenate([[0], np.cumsum(many)])
        ids = np.frombuffer(b"".join(each), np.int32)[np.repeat(since - at[:-1], many) + np.arange(at[-1])].tobytes()
        scores, losses = np.array([f[1] for f in found])[code].tolist(), np.array([f[2] for f in found])[code]
        at, a = (4 * at).tolist(), 0
        for own in split:
            b = a + len(own)
            score, packed, begin = sum(scores[a:b], 0.0), ids[at[a] : at[b]], at[a]
            best, same = [], True
            for loss, changes in self._next(own, ids, at, a, losses[a:b], n):
                parts, done = [], 0
                for i, _, other, alike in changes:
                    parts += packed[done : at[a + i] - begin], other
                    done = at[a + i + 1] - begin
                    same = same and alike
                best.append((score - loss, b"".join(parts) + packed[done:]))
            yield packed, score, best, same
            a = b

    def _next(self, words, ids, at, a, losses, n):
        """(loss, changes) of the n best, a change as (place of the word, its rank among the word's, ids, whether they decode alike).

        Any but the best changes some words; the n best change only the n - 1 words that lose least.
        """
        options = []
        for _ in range(min(n - 1, len(losses))):
            i = int(losses.argmin())
            if losses[i] == math.inf:
                break
            losses[i] = math.inf
            options.append([(0.0, i, 0)] + [(lost, i, k, *way) for k, (lost, *way) in enumerate(self.ways(words[i], ids[at[a + i] : at[a + i + 1]], n), 1)])
        # changes that alone lose more than n ways do are in none of the n best
        single = sorted(c[0] for own in options for c in own[1:])
        most = single[n - 2] if 1 < n <= len(single) + 1 else math.inf
        options = [[c for c in own if c[0] <= most] for own in options]
        every = []
        for combo in itertools.product(*options):
            every.append((sum(c[0] for c in combo), sorted(c[1:] for c in combo if c[2])))
        every.sort()
        return every[:n]

    def shown(self, packed: bytes) -> bytes:
        import array

        return b"".join(map(self.v.shown.__getitem__, array.array("i", packed)))

    def decode(self, packed: bytes) -> str:
        """The text of packed ids: pieces' characters, bytes joined, the first space dropped if encoding adds one."""
        text = self.shown(packed).decode(errors="replace")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


#: Stands for a literal space mark inside a lattice: half a surrogate pair, which no text and no piece contains.
_LITERAL = "\ud800"


def _chars(word: str) -> str:
    if MARK in word:
        word = word.replace(MARK, _LITERAL)
    return word.replace(" ", MARK)


def _packed(ids: tuple[int, ...]) -> bytes:
    import array

    return array.array("i", ids).tobytes()


FIELDS = [
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_pieces", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("nbest_scores", T.ArrayType(T.DoubleType())),
    T.StructField("round_trip", T.BooleanType()),
    T.StructField("ids_sha256", T.StringType()),
]


#: Bytes of texts whose words are measured together; their ids make one Arrow batch.
TEXTS = 1 << 20


def _lists(packed: list[bytes]):
    """An Arrow array of lists of packed ids."""
    import pyarrow as pa

    at = np.cumsum([0] + [len(x) // 4 for x in packed])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, path: str, nbest: int = 4, with_ids: bool = True, with_nbest: bool = False) -> DataFrame:
    """FIELDS for each document and, on request, ids array<int> of the best and nbest_ids array<array<int>>, beside nbest_scores:
    whole texts, encoded and decoded again. round_trip: the best gives back the text, and the parts that others change give the same bytes."""
    vocabulary = Vocabulary.load(path)
    sent = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(Vocabulary(**sent.value))
        for batch in batches:
            for a, b in chunked(utf8(batch.column("text"))[1], TEXTS):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column("text").to_pylist()]
                rows, ids, ways = [], [], []
                for text, (packed, score, best, same) in zip(texts, encoder.encoded(texts, nbest), strict=True):
                    rows.append((len(packed) // 4, score, [s for s, _ in best], same and encoder.decode(packed) == text, hashlib.sha256(packed).hexdigest()))
                    ids.append(packed)
                    ways.append([x for _, x in best])
                cols = list(zip(*rows, strict=True))
                arrays = [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.bool_(), pa.string()], strict=True))]
                if with_ids:
                    arrays.append(_lists(ids))
                if with_nbest:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(w) for w in ways]), pa.int32()), _lists([x for w in ways for x in w])))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    more = [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("nbest_ids", T.ArrayType(T.ArrayType(T.IntegerType())))] * with_nbest
    schema = T.StructType(FIELDS + more)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
