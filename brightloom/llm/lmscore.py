"""Language-model scores by online logistic context mixing.

A text is its words, lower-cased in A-Z, and one end. Each word is coded as the bits of its bytes and of a space after them:
four bits for the 15 most frequent bytes of the training texts, twelve for the others.
Every bit is predicted by several hashed contexts: the two, three and four bytes before it in the word, all of the word so
far, and the state of the text with each of them. Their log-odds are combined by weights that a gate selects (which bit, whether
it is of the first byte, and how often training has seen the word so far); the weights learn online, and an adaptive probability map refines the
result. The state of a text is the kind of its last short word: short words are grouped by what follows them, so that
the state tells languages and styles apart. A word's bits thus depend on its state and bytes only, so they are coded once for
each state and word of the corpus, in a table that grows with it, and not once for each occurrence.

Three more experts know whole words: the share of a word among all training words of its state (with the corpus's share behind
it), its share among the text's words so far, and its share among the words that followed the last one in the text so far.
The four are mixed word by word. Each text has its own weights for them, chosen by a gate (did the text repeat itself
just now), which start from what training texts teach and go on learning while the text is scored; no weight falls far below
its start, so a new word after a long repetition is still foreseen. A word of over LONG bytes may also be told by its own bytes
so far, with a chance of OWN. What is less likely than a double can hold stays a logarithm.

All experts give probabilities of disjoint codes, so scores are log-probabilities of whole texts. Counts, weights, maps and
groups cover all training documents and all their words: each partition learns online from all it has, weights are averaged
by the bits each has seen (ROUNDS times), counts are added up. Tables that travel have fixed sizes; words and their counts
never do as a whole: each chunk of documents gets those it uses.

Defined results: a null or empty text is its end alone; without training documents, N and V are 0 and all bits are even;
texts are scored whole, the text's own share of words adapting anew every PIECE tokens; equal texts have equal scores; rows
that repeat or share a doc_id are separate documents; a null doc_id is a training document. Columns other than doc_id
and text are dropped.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, _SPACE, Powers, mixed, saved, utf8, word_hashes

PIECE = 1 << 15
#: Learning passes over all training words; each starts from the weights merged before.
ROUNDS = 1
#: Bytes of text after which a task passes on the words it has counted.
FLUSH = 32 << 20
#: Short words have so many bytes at most; their hashes make KINDS kinds, those STATES - 1 groups.
SHORT, KINDS, STATES = 3, 256, 9
#: Contexts of a byte: log2 of their numbers of places. A place holds the 15 nodes of four bits.
PLACES = (12, 14, 15, 12, 15, 15)
NODES = 16
_FIRST = np.concatenate([[0], np.cumsum([NODES << b for b in PLACES])])
#: Which contexts count words by their occurrences; the others count each word once a state.
BY_TOKENS = (False, False, False, True, True, True)
#: The context that says whether training has seen the word so far.
PREFIX = 4
#: Counts that travel in one row.
ROW = 1 << 12
#: Gates of the bits, and of the experts.
BIT_GATES, GATES = 96, 6
#: Places of a word in one row of the vocabulary, and entries that a task sorts by chunk at once.
PLACES_OF_ROW, PACKED_AT_ONCE = 4_096, 1_000_000
#: Times that training has seen a prefix, as levels that choose weights.
LEVELS = (1, 4, 32)
#: How far a text's weights move with each word; every LEAST_EVERY words they are lifted to that share of their start.
RATE, LEAST, LEAST_EVERY = 0.05, 0.01, 64
#: Words of more bytes are also told by their own bytes, with this chance; numbers of bytes before that predict the next one there,
#: and how much what is known without them counts.
LONG, OWN, OWN_ORDERS, OWN_BACK = 32, 0.001, (0, 1, 3), (32.0, 2.0, 0.5)
#: Training words that a state must have before its own shares weigh as much as the corpus's.
BACKOFF = 2_000
END_HASH = -1
_MASK = np.int64(-16)


# --- tokens ---------------------------------------------------------------------------------------------------------


@dataclass
class Tokens:
    """Words of several texts with an end after each text: hash, text, bytes of the word, and where they are."""

    hash: np.ndarray
    doc: np.ndarray
    size: np.ndarray
    data: bytes
    start: np.ndarray


def tokens(texts: list[bytes], powers: Powers) -> Tokens:
    data = b"\n".join(texts)
    raw = np.frombuffer(data, np.uint8)
    h, start = word_hashes(raw, powers)
    edge = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True)) if len(raw) else np.zeros(0, np.int64)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    doc = np.searchsorted(at, start, side="right") - 1
    ends = np.searchsorted(doc, np.arange(len(texts)), side="right")
    put = lambda v, x: np.insert(v, ends, x)
    return Tokens(put(h.astype(np.int64), END_HASH), put(doc, np.arange(len(texts))), put(edge[1::2] - start, 0), (_LOWER[raw] if len(raw) else raw).tobytes(), put(start, 0))


def short_words(t: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(the kind of each token, the place of the last short word of its text before it, or -1)."""
    n = len(t.hash)
    kind = (t.hash & (KINDS - 1)).astype(np.int64)
    last = np.maximum.accumulate(np.where((t.size > 0) & (t.size <= SHORT), np.arange(n), -1)) if n else np.zeros(0, np.int64)
    last = np.concatenate([[-1], last[:-1]])[:n]
    return kind, np.where((last >= 0) & (t.doc[np.maximum(last, 0)] == t.doc), last, -1)


def states(t: Tokens, groups: np.ndarray) -> np.ndarray:
    """The state of each token's text before it: 0, or the group of the last short word."""
    kind, last = short_words(t)
    return np.where(last >= 0, groups[kind[np.maximum(last, 0)]], 0)


def keys(t: Tokens, groups: np.ndarray) -> np.ndarray:
    """A word and its state in one number: 60 bits of the hash, 4 of the state."""
    return (t.hash & _MASK) | states(t, groups)


def grouped(follows: np.ndarray) -> np.ndarray:
    """The group (1 to STATES - 1) of each kind of short word: kinds that follow each other often belong together (spherical k-means)."""
    both = (follows + follows.T).astype(float)
    weight = both.sum(1)
    x = np.sqrt(both / np.maximum(weight, 1)[:, None])
    centre = [int(np.argmax(weight))]
    for _ in range(STATES - 2):  # the farthest, by weight
        far = (1 - (x @ x[centre].T).max(1)) * np.sqrt(weight)
        centre.append(int(np.argmax(far)))
    c = x[centre]
    for _ in range(30):
        near = (x @ c.T).argmax(1)
        sums = np.stack([(x * weight[:, None])[near == k].sum(0) for k in range(len(c))])
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return (near + 1).astype(np.int64)


def _runs_of_pieces(doc: np.ndarray) -> np.ndarray:
    """A number for each run of PIECE tokens of one text."""
    new = np.concatenate([[True], doc[1:] != doc[:-1]]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    place = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
    return np.cumsum(new | (place % PIECE == 0)) - 1


def _before(h: np.ndarray, place: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often the piece had the value before; values of one piece are told apart by 40 scrambled bits and PIECE places."""
    seen = np.empty(len(h), np.int64)
    with np.errstate(over="ignore"):
        key = mixed(h.astype(np.uint64)) >> np.uint64(24) << np.uint64(15) | place.astype(np.uint64)
    for a, b in itertools.pairwise([*first.tolist(), len(h)]):
        own = np.sort(key[a:b])
        value = own >> np.uint64(15)
        new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        seen[a + (own & np.uint64(PIECE - 1)).astype(np.int64)] = np.arange(b - a) - np.repeat(new, np.diff(np.append(new, b - a)))
    return seen


def distinct(k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted values, a place of each, the number of each place's value)."""
    order = np.argsort(k)
    value = k[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(k)]
    back = np.empty(len(k), np.int64)
    back[order] = np.cumsum(new) - 1
    return value[new], order[new], back


def own_shares(h: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(share of the piece so far that is this word; share of this word among those that followed the last one so far; gate).

    The gate says whether the last word had been there before, alone or after its own predecessor, and whether 20 words are past.
    """
    if not len(h):
        return np.zeros(0), np.zeros(0), np.zeros(0, np.int64)
    fresh = np.concatenate([[True], piece[1:] != piece[:-1]])
    first = np.flatnonzero(fresh)
    place = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    seen = _before(h, place, first)
    last = np.concatenate([[0], h[:-1]])
    with np.errstate(over="ignore"):
        pair = mixed(last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + h.astype(np.uint64)).astype(np.int64)
    pairs = np.where(fresh, 0, _before(pair, place, first))
    follows = np.where(fresh, 0, np.concatenate([[0], seen[:-1]]))
    hit = (seen > 0).astype(np.int64) + (pairs > 0)
    gate = np.where(fresh, 0, np.concatenate([[0], hit[:-1]])) * 2 + (place >= 20)
    return seen / np.maximum(place, 1), np.minimum(pairs / np.maximum(follows, 1), 1.0), gate


# --- bits -----------------------------------------------------------------------------------------------------------


@dataclass
class Bits:
    """The bits of spelled words, in fours: place of each context's count, gate without knowledge, the bits; the word of each four."""

    at: list[np.ndarray]
    gate: np.ndarray
    bit: np.ndarray
    word: np.ndarray


_DEPTH = np.arange(4)
#: What stands before the bits of a byte that isn't among the frequent ones.
OTHER = 15


def ranks(counts: np.ndarray) -> np.ndarray:
    """The code of each byte: 0 to 14 for the most frequent ones, else OTHER."""
    out = np.full(256, OTHER, np.uint8)
    out[np.argsort(-counts, kind="stable")[:OTHER]] = np.arange(OTHER)
    return out


def spelled(words: list[bytes], state: np.ndarray, code: np.ndarray) -> Bits:
    """Words of a state, each with a space after it, four bits after four bits."""
    length = np.array([len(w) + 1 for w in words], np.int64)
    data = np.frombuffer(b" ".join([*words, b""]), np.uint8)
    word = np.repeat(np.arange(len(words)), length)
    first = (np.cumsum(length) - length)[word]
    place = np.arange(len(data)) - first
    back = np.zeros((4, len(data)), np.uint64)
    for k in range(4):
        back[k, k + 1 :] = data[: -k - 1]
        back[k] *= place > k
    # fours: one for a frequent byte, else OTHER, the high and the low half
    rank = code[data]
    many = np.where(rank == OTHER, 3, 1)
    byte = np.repeat(np.arange(len(data)), many)
    part = np.arange(len(byte)) - np.repeat(np.cumsum(many) - many, many)
    high = data[byte] >> 4
    four = np.where(part == 0, rank[byte], np.where(part == 1, high, data[byte] & 15))
    odd = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        two = back[0] | back[1] << np.uint64(8)
        three = two | back[2] << np.uint64(16)
        up, down = _POWERS.upto(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        prefix = (total[:-1] - total[first]) * down[first] + place.astype(np.uint64)
        own = (state[word].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        contexts = [two, three, three | back[3] << np.uint64(24), own + two, prefix, own + prefix]
        turn = (part + np.where(part == 2, high, 0)).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        node = (1 << _DEPTH | four[:, None] >> (4 - _DEPTH)).astype(np.int32)
        at = []
        for k, c in enumerate(contexts):
            base = (mixed((c * odd + np.uint64(k))[byte] ^ turn) >> np.uint64(64 - PLACES[k])).astype(np.int32)
            at.append(((base * np.int32(NODES) + np.int32(_FIRST[k]))[:, None] + node).ravel())
    bit = (four[:, None] >> (3 - _DEPTH) & 1).astype(np.uint8)
    gate = (((place[byte] > 0) * 3 + part)[:, None] * 4 + _DEPTH).astype(np.int32)
    return Bits(at, gate.ravel(), bit.ravel(), word[byte])


_POWERS = Powers()


def own_spelling(word: bytes) -> float:
    """log10 probability of a word and the space after it by counts of its own bytes so far, for each order of OWN_ORDERS; the orders' mean.

    An order adds what it counted to the order 0 (and that to even chances). Counts begin anew every PIECE bytes.
    """
    data = np.frombuffer(word + b" ", np.uint8).astype(np.int64)
    place, first = np.arange(len(data)) % PIECE, np.arange(0, len(data), PIECE)
    total, less = [], np.full(len(data), 1 / 256)
    for k, back in zip(OWN_ORDERS, OWN_BACK, strict=True):
        context = np.zeros(len(data), np.int64)
        for j in range(1, k + 1):
            context[j:] |= data[:-j] << 8 * j
        hits, many = _before(context | data, place, first), _before(context, place, first)
        p = (np.minimum(hits, many) + back * less) / (many + back)
        less = less if k else p
        total.append(np.log(p).sum())
    return float((np.logaddexp.reduce(total) - math.log(len(total))) / math.log(10))


def log_odds(n0: np.ndarray, n1: np.ndarray, prior: float = 0.4) -> np.ndarray:
    return np.log((n1 + np.float32(prior)) / (n0 + np.float32(prior)))


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Mixer:
    """Weights for inputs, chosen by a gate, and an adaptive probability map by gate and log-odds; both learn online."""

    BINS = 24
    FINE = 2048

    def __init__(self, inputs: int, gates: int):
        self.w = np.full((inputs, gates), 0.35, np.float32)
        self.map = np.tile(squash(np.linspace(-8, 8, self.BINS + 1)), (gates, 1)).astype(np.float32)
        self.seen = np.zeros(gates)
        self.curve = np.tile(20 * np.eye(inputs), (gates, 1, 1))
        self.n, self.ones = np.zeros(self.map.size), np.zeros(self.map.size)
        self.cost = np.zeros(0, np.float32)

    def mixed(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        z = x[0] * self.w[0][gate]
        for w, v in zip(self.w[1:], x[1:], strict=True):
            z += v * w[gate]
        return z.clip(-8, 7.999, out=z)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(totals, counts) that may be added over partitions: weights times the bits of their gate, then the map's ones."""
        many = np.tile(self.seen, len(self.w))
        return np.concatenate([self.w.ravel() * many, self.ones]), np.concatenate([many, self.n])

    def merge(self, total: np.ndarray, count: np.ndarray) -> None:
        """Takes sums over all partitions; weights that no bit has moved stay."""
        w, k = self.w.ravel(), self.w.size
        self.w = np.where(count[:k] > 0, total[:k] / np.maximum(count[:k], 1), w).astype(np.float32).reshape(self.w.shape)
        self.ones, self.n = total[k:], count[k:]

    def settle(self) -> None:
        """Tabulates log10 of the final probabilities by gate, fine log-odds and bit: the mean of the mix and its refinement by the map."""
        self.map = ((400 * self.map + self.ones.reshape(self.map.shape)) / (400 + self.n.reshape(self.map.shape))).astype(np.float32)
        z = (np.arange(self.FINE) + 0.5) * (16 / self.FINE) - 8
        at = (z + 8) * (self.BINS / 16)
        low = at.astype(int)
        refined = self.map[:, low] * (low + 1 - at) + self.map[:, low + 1] * (at - low)
        p = ((squash(z) + refined) * 0.5).clip(1 / 65536, 1 - 1 / 65536)
        self.cost = np.log10(np.stack([1 - p, p], 2)).astype(np.float32).ravel()

    def scores(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """log10 probability of each bit."""
        fine = ((self.mixed(x, gate) + 8) * (self.FINE / 16)).astype(np.int32)
        return self.cost[(gate * self.FINE + fine) * 2 + bit]

    def learn(self, x: list[np.ndarray], gate: np.ndarray, bit: np.ndarray, weight: np.ndarray, block: int = 1 << 17):
        """Block after block: predict, count for the map, then a Newton step of each gate's weights on all curvature so far."""
        gates = self.w.shape[1]
        for a in range(0, len(bit), block):
            order = np.argsort(gate[a : a + block].astype(np.uint8), kind="stable") + a
            g, y, c = gate[order], bit[order].astype(np.float32), weight[order]
            rows = np.stack([v[order] for v in x])
            many = np.bincount(g, minlength=gates)
            edge = np.append(0, np.cumsum(many))
            z = np.einsum("ij,ij->j", rows, np.repeat(self.w, many, axis=1)).clip(-8, 7.999)
            p = squash(z)
            near = g * (self.BINS + 1) + ((z + 8) * (self.BINS / 16) + 0.5).astype(np.int32)
            self.n += np.bincount(near, c, minlength=self.map.size)
            self.ones += np.bincount(near, c * y, minlength=self.map.size)
            self.seen += np.bincount(g, c, minlength=gates)
            error, bend = (y - p) * c, np.maximum(p * (1 - p), np.float32(0.01)) * c
            slope = np.zeros((gates, len(x)))
            bent = rows * bend
            for k in np.flatnonzero(many).tolist():
                own = slice(edge[k], edge[k + 1])
                slope[k] = rows[:, own] @ error[own]
                self.curve[k] += rows[:, own] @ bent[:, own].T
            self.w += np.linalg.solve(self.curve, slope[:, :, None])[:, :, 0].T.clip(-0.2, 0.2).astype(np.float32)


def level(n: np.ndarray) -> np.ndarray:
    """The part of a gate that says how often a prefix was seen."""
    return 24 * np.searchsorted(LEVELS, n, side="right").astype(np.int32)


def with_bias(x: list[np.ndarray]) -> list[np.ndarray]:
    return [*x, np.full(len(x[0]), 0.3, np.float32)]


# --- passes ---------------------------------------------------------------------------------------------------------


def _texts(batch, a: int, b: int) -> list[bytes]:
    data, at = utf8(batch.column("text"))
    return [data[at[i] : at[i + 1]].tobytes() for i in range(a, b)]


def _groups(batch, bound: int = 1 << 21, most: int = 1_000):
    """Ranges of rows of bounded bytes, at most `most` rows."""
    _, at = utf8(batch.column("text"))
    a = 0
    while a < batch.num_rows:
        b = min(a + most, max(a + 1, int(np.searchsorted(at, at[a] + bound, side="right")) - 1), batch.num_rows)
        yield a, b
        a = b


_SUMS = "slot int, total double, n double"


def _rows(total: np.ndarray, n: np.ndarray):
    import pyarrow as pa

    full = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full].astype(float)), pa.array(n[full].astype(float))], names=["slot", "total", "n"])


def _summed(rows: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the partitions, of a fixed size."""
    total, n = np.zeros(size), np.zeros(size)
    for r in rows.groupBy("slot").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toLocalIterator(prefetchPartitions=True):
        total[r["slot"]], n[r["slot"]] = r["total"], r["n"]
    return total, n


def _habits(batches):
    """How often kinds of short words follow each other, how often tokens, and pairs of tokens, had been in their text before, by gate; then bytes."""
    powers = Powers()
    follows, hits, n, used = np.zeros(KINDS * KINDS), np.zeros(2 * GATES), np.zeros(2 * GATES), np.zeros(256)
    for batch in batches:
        for a, b in _groups(batch):
            t = tokens(_texts(batch, a, b), powers)
            kind, last = short_words(t)
            on = np.flatnonzero((last >= 0) & (t.size > 0) & (t.size <= SHORT))
            follows += np.bincount(kind[last[on]] * KINDS + kind[on], minlength=KINDS * KINDS)
            own, pair, gate = own_shares(t.hash, _runs_of_pieces(t.doc))
            hits += np.append(np.bincount(gate, own > 0, minlength=GATES), np.bincount(gate, pair > 0, minlength=GATES))
            n += np.tile(np.bincount(gate, minlength=GATES), 2)
            used += np.bincount(np.frombuffer(t.data, np.uint8), minlength=256)
    yield from _rows(np.concatenate([follows, hits, used]), np.concatenate([follows, n, used]))


_PACKED = "bucket int, chunk int, k binary, train binary, size binary, words binary"


def _counted(groups: np.ndarray, buckets: int):
    """Words of each chunk by state, with how often training texts have them; one row for each bucket of hashes."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in _PACKED.split(", ")]
        powers = Powers()
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size, chunk = 0, None

        def flush():
            k = np.concatenate([x[0] for x in held])
            words = list(itertools.chain.from_iterable(x[2] for x in held))
            uniq, first, back = distinct(k)
            train = np.bincount(back, np.concatenate([x[1] for x in held])).astype("<i8")
            bucket = (uniq >> 4) % buckets
            order = np.argsort(bucket, kind="stable")
            edge = [0, *(np.flatnonzero(np.diff(bucket[order])) + 1).tolist(), len(order)]
            for a, b in itertools.pairwise(edge):
                own = order[a:b]
                told = [words[i] for i in first[own].tolist()]
                row = (int(bucket[own[0]]), chunk, uniq[own].astype("<i8").tobytes(), train[own].tobytes(), np.array([len(w) for w in told], "<i4").tobytes(), b"".join(told))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=names)
            held.clear()

        for batch in batches:
            training, chunks = batch.column("training").to_numpy(zero_copy_only=False), batch.column("chunk").to_numpy()
            for a, b in _groups(batch):
                every = _texts(batch, a, b)
                for c in np.unique(chunks[a:b]):
                    if held and (c != chunk or size > FLUSH):
                        yield from flush()
                        size = 0
                    chunk = int(c)
                    rows = np.flatnonzero(chunks[a:b] == c)
                    texts = [every[i] for i in rows]
                    size += sum(map(len, texts))
                    t = tokens(texts, powers)
                    uniq, first, back = distinct(keys(t, groups))
                    train = np.bincount(back, training[a:b][rows][t.doc])
                    words = [t.data[x : x + n] if n else b"\n" for x, n in zip(t.start[first].tolist(), t.size[first].tolist(), strict=True)]
                    held.append((uniq, train, words))
        if held:
            yield from flush()

    return run


_VOCABULARY = "h long, word binary, t array<long>, main boolean, places array<long>"


def _merged(batches):
    """One row for each word of a bucket: training counts by state, and the chunks and states that use it, PLACES_OF_ROW to a row."""
    import pyarrow as pa

    def flush(held: list):
        k, train, size = (np.concatenate([np.frombuffer(x[j], t) for x in held]) for j, t in ((2, "<i8"), (3, "<i8"), (4, "<i4")))
        chunk = np.repeat(np.array([x[1] for x in held], np.int64), [len(x[2]) // 8 for x in held])
        data, at = b"".join(x[5] for x in held), np.cumsum(size) - size
        order = np.argsort(k, kind="stable")
        k, train, chunk = k[order], train[order], chunk[order]
        h = k >> 4
        fresh = np.flatnonzero(np.diff(h, prepend=h[0] - 1) != 0)
        row = np.repeat(np.arange(len(fresh)), np.diff(fresh, append=len(h)))
        counts = np.bincount(row * STATES + (k & 15), train, minlength=len(fresh) * STATES).astype(np.int64).reshape(-1, STATES)
        # a common word's places take several rows
        place = np.arange(len(h)) - fresh[row]
        cut = np.flatnonzero(place % PLACES_OF_ROW == 0)
        own, first = row[cut], order[cut]
        for a in range(0, len(cut), 10_000):
            part = slice(a, a + 10_000)
            r, edge = own[part], np.append(cut[part], cut[a + 10_000] if a + 10_000 < len(cut) else len(h))
            words = [data[x : x + n] for x, n in zip(at[first[part]].tolist(), size[first[part]].tolist(), strict=True)]
            t = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * STATES), pa.array(counts[r].ravel()))
            places = pa.ListArray.from_arrays(pa.array((edge - edge[0]).astype(np.int32)), pa.array(chunk[edge[0] : edge[-1]] << 4 | k[edge[0] : edge[-1]] & 15))
            yield pa.RecordBatch.from_arrays([pa.array(h[cut[part]]), pa.array(words, pa.binary()), t, pa.array(place[cut[part]] == 0), places], names=[x.split()[0] for x in _VOCABULARY.split(", ")])

    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and r[0] != held[0][0]:
                yield from flush(held)
                held = []
            held.append(r)
    if held:
        yield from flush(held)


def _spelled_batches(batch, mask: np.ndarray, code: np.ndarray, bytes_at_once: int = 1 << 16):
    """Bits of the words of a vocabulary batch in the states of the mask, so many bytes at once: (bits, row, state)."""
    row, state = np.nonzero(mask)
    words = batch.column("word").to_pylist()
    size = np.cumsum([len(words[i]) + 1 for i in row.tolist()])
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + bytes_at_once, side="right")))
        yield spelled([words[i] for i in row[a:b].tolist()], state[a:b], code), row[a:b], state[a:b]
        a = b


def _training_counts(batch) -> np.ndarray:
    return batch.column("t").flatten().to_numpy().reshape(-1, STATES)


def _tables(code: np.ndarray):
    """Zeros and ones at every place of the contexts, over the partition's words: rows (part, data) of 2 x ROW counts."""

    def run(batches):
        import pyarrow as pa

        size = int(_FIRST[-1])
        n = np.zeros(2 * size)
        for batch in batches:
            counts = _training_counts(batch)
            for bits, row, state in _spelled_batches(batch, counts > 0, code):
                many = np.repeat(counts[row, state][bits.word], 4).astype(float)
                other = bits.bit * np.int32(size)
                for k, at in enumerate(bits.at):
                    np.add.at(n, at + other, many if BY_TOKENS[k] else 1.0)
        parts = n.reshape(2, -1, ROW)
        for p in np.flatnonzero(parts.any((0, 2))):
            yield pa.RecordBatch.from_arrays([pa.array([int(p)], pa.int32()), pa.array([parts[:, p].astype("<f4").tobytes()], pa.binary())], names=["part", "data"])

    return run


def _added(batches):
    """Sums of sorted rows (part, data)."""
    import pyarrow as pa

    part, total = None, None
    for batch in batches:
        for p, data in zip(batch.column("part").to_pylist(), batch.column("data").to_pylist(), strict=True):
            values = np.frombuffer(data, "<f4").astype(np.float64)
            if p != part and part is not None:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["part", "data"])
            part, total = (p, total + values) if p == part else (p, values)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.astype("<f4").tobytes()], pa.binary())], names=["part", "data"])


def _gathered(rows: DataFrame) -> np.ndarray:
    """The counts over all partitions, of a fixed size: 2 x places."""
    out = np.zeros((2, int(_FIRST[-1]) // ROW, ROW), np.float32)
    for p, data in rows.repartition("part").sortWithinPartitions("part").mapInArrow(_added, "part int, data binary").toLocalIterator(prefetchPartitions=True):
        out[:, p] = np.frombuffer(data, "<f4").reshape(2, ROW)
    return out.reshape(2, -1)


def without_one(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, levels of the prefix) at every place: of all counts, without a zero, without a one."""
    n0, n1 = counts
    less = [(n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))]
    places = slice(int(_FIRST[PREFIX]), int(_FIRST[PREFIX + 1]))
    return np.concatenate([log_odds(*x) for x in less]).astype(np.float32), np.concatenate([level((a + b)[places]) for a, b in less])


def _learned(counts: np.ndarray, w: np.ndarray, code: np.ndarray):
    """The mixer's sums after one online pass over a partition's training words; counts without the word itself stand for words not seen."""

    def run(batches):
        mixer = Mixer(*w.shape)
        mixer.w = w.copy()
        odds, levels = without_one(counts)
        size, span = len(odds) // 3, len(levels) // 3
        for batch in batches:
            train = _training_counts(batch)
            for bits, row, state in _spelled_batches(batch, train > 0, code):
                many = train[row, state]
                less = bits.bit + np.int32(1)
                alone = np.where(np.repeat((many == 1)[bits.word], 4), less, 0)
                x = [odds[at + (less if by else alone) * np.int32(size)] for at, by in zip(bits.at, BY_TOKENS, strict=True)]
                gate = bits.gate + levels[bits.at[PREFIX] - int(_FIRST[PREFIX]) + less * np.int32(span)]
                mixer.learn(with_bias(x), gate, bits.bit, np.repeat(many[bits.word], 4).astype(np.float32))
        yield from _rows(*mixer.sums())

    return run


@dataclass
class Model:
    code: np.ndarray  # of each byte
    odds: np.ndarray  # log-odds at every place
    seen: np.ndarray  # level of each place of PREFIX
    mixer: Mixer
    shares: np.ndarray  # of the experts bits, state, text and pair, by gate
    by_state: np.ndarray  # training words of each state; their sum is N
    types: int  # V

    @property
    def tokens(self) -> int:
        return int(self.by_state.sum())

    def share(self, state: np.ndarray, train: np.ndarray, total: np.ndarray) -> np.ndarray:
        """Shares of words among the training words of their states, with the corpus's shares behind them."""
        return (train + BACKOFF * total / max(self.tokens, 1)) / (self.by_state[state] + BACKOFF)

    def spell(self, bits: Bits, words: int) -> np.ndarray:
        """log10 probability of each word."""
        x = [self.odds[at] for at in bits.at]
        gate = bits.gate + self.seen[bits.at[PREFIX] - int(_FIRST[PREFIX])]
        each = self.mixer.scores(with_bias(x), gate, bits.bit).reshape(-1, 4).sum(1, dtype=np.float64)
        return np.bincount(bits.word, each, minlength=words)


def first_shares(hits: np.ndarray, n: np.ndarray, training: bool) -> np.ndarray:
    """The experts' weights at a text's start, by gate: the text's own experts by their hit rates, bits a quarter of the rest."""
    rate = (hits / np.maximum(n, 1)).reshape(2, GATES)
    own, pair = np.clip(0.4 * rate[0], 0.01, 0.4), np.clip(0.5 * rate[1], 0.01, 0.5)
    rest = 1 - own - pair
    bits = 0.25 * rest if training else rest
    return np.stack([bits, rest - bits, own, pair], 1)


def _fit(vocabulary: DataFrame, habits: tuple[np.ndarray, np.ndarray], by_state: np.ndarray, types: int) -> Model:
    """Online fits on all training words, merged over partitions after each round."""
    start, used = habits[0][KINDS * KINDS : -256], habits[0][-256:]
    code = ranks(used)
    counts = _gathered(vocabulary.mapInArrow(_tables(code), "part int, data binary"))
    mixer = Mixer(len(PLACES) + 1, BIT_GATES)
    for _ in range(ROUNDS):
        mixer.merge(*_summed(vocabulary.mapInArrow(_learned(counts, mixer.w, code), _SUMS), mixer.w.size + mixer.map.size))
    mixer.settle()
    places = slice(int(_FIRST[PREFIX]), int(_FIRST[PREFIX + 1]))
    shares = first_shares(start, habits[1][KINDS * KINDS : -256], by_state.sum() > 0)
    return Model(code, log_odds(*counts).astype(np.float32), level(counts[:, places].sum(0)), mixer, shares, by_state, types)


def with_own(spelled: np.ndarray, words) -> np.ndarray:
    """log10 probabilities (words x states) by bits, or with a chance of OWN by a long word's own bytes."""
    out = spelled + math.log10(1 - OWN)
    for i in np.flatnonzero(np.diff(utf8(words)[1]) > LONG).tolist():
        own = own_spelling(words[i].as_py()) + math.log10(OWN)
        out[i] = np.logaddexp(out[i] * math.log(10), own * math.log(10)) / math.log(10)
    return out


#: What a chunk gets of a word and state: training count of the word, probability by bits (as log10), share.
_USED = np.dtype([("k", "<i8"), ("c", "<i8"), ("lp", "<f4"), ("share", "<f4")])


def _looked_up(model: Model):
    """The words of each chunk, packed: (chunk, data of _USED). A task sorts so many entries by chunk at once."""

    def run(batches):
        import pyarrow as pa

        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            chunk, used = (np.concatenate([x[j] for x in held]) for j in (0, 1))
            order = np.argsort(chunk, kind="stable")
            chunk, used = chunk[order], used[order]
            edge = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for i in range(0, len(edge) - 1, 200):
                some = edge[i : i + 201]
                yield pa.RecordBatch.from_arrays([pa.array(chunk[some[:-1]].astype(np.int32)), pa.array([used[a:b].tobytes() for a, b in itertools.pairwise(some)], pa.binary())], names=["chunk", "data"])
            held.clear()

        for batch in batches:
            counts, places = _training_counts(batch), batch.column("places")
            row = np.repeat(np.arange(batch.num_rows), np.diff(places.offsets.to_numpy()))
            place = places.flatten().to_numpy()
            mask = np.zeros((batch.num_rows, STATES), bool)
            mask[row, place & 15] = True
            value = np.zeros((batch.num_rows, STATES))
            for bits, r, state in _spelled_batches(batch, mask, model.code):
                value[r, state] = model.spell(bits, len(r))
            value = with_own(value, batch.column("word"))
            used = np.empty(len(row), _USED)
            state = place & 15
            used["k"], used["c"] = batch.column("h").to_numpy()[row] << 4 | state, counts.sum(1)[row]
            used["lp"], used["share"] = value[row, state], model.share(state, counts[row, state], used["c"])
            held.append((place >> 4, used))
            if sum(len(x[0]) for x in held) > PACKED_AT_ONCE:
                yield from flush()
        if held:
            yield from flush()

    return run


def scaled(lp: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of each token by all experts, scaled so that the greatest is 1; log10 of the scale). lp: the first expert's, as log10."""
    most = np.max(rest, 0)
    scale = np.maximum(lp, np.log10(most, where=most > 0, out=np.full(len(lp), -np.inf)))
    return np.stack([10.0 ** (lp - scale), *(x * 10.0 ** np.minimum(-scale, 300) for x in rest)], 1), scale


def expert_mix(p: np.ndarray, gate: np.ndarray, piece: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """log10 of the experts' mix (p: tokens x experts), all pieces side by side; each moves its own copy of the weights after each token."""
    if not len(p):
        return np.zeros(0)
    first = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
    length = np.diff(np.append(first, len(piece)))
    place = np.arange(len(piece)) - np.repeat(first, length)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(first))
    rank = np.repeat(rank, length)
    # step by step, pieces that go on first
    order = np.argsort(place * len(first) + rank)
    p, slot = p[order], (rank * len(shares) + gate)[order]
    edge = np.append(0, np.cumsum(np.bincount(place))).tolist()
    w = np.tile(shares, (len(first), 1))
    one, total = np.ones(p.shape[1]), np.empty(len(p))
    least = np.tile(LEAST * shares, (len(first), 1))
    for step, (a, b) in enumerate(itertools.pairwise(edge), 1):
        if step % LEAST_EVERY == 0:
            live = w[: (b - a) * len(shares)]
            np.maximum(live, least[: len(live)], out=live)
            live /= live.dot(one)[:, None]
        own = w.take(slot[a:b], 0)
        parts = own * p[a:b]
        sums = parts.dot(one)
        total[a:b] = sums
        parts *= (RATE / sums)[:, None]
        own *= 1 - RATE
        own += parts
        w[slot[a:b]] = own
    out = np.empty(len(p))
    out[order] = np.log10(total)
    return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def _scored(model: Model, groups: np.ndarray):
    """Sorted rows of each chunk: first its words, then its documents, which are scored."""

    def run(batches):
        import zlib

        import pyarrow as pa

        powers = Powers()
        words: list[bytes] = []
        chunk, table = None, None
        n = model.tokens
        floor = n + 0.1 * (model.types + 1)
        for batch in batches:
            chunks, kind = batch.column("chunk").to_numpy(), batch.column("kind").to_numpy()
            cut = np.flatnonzero((np.diff(chunks) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in itertools.pairwise([0, *cut.tolist(), batch.num_rows]):
                part = batch.slice(a, b - a)
                if chunks[a] != chunk:
                    chunk, words, table = chunks[a], [], None
                if kind[a] == 0:
                    words += part.column("data").to_pylist()
                    continue
                if table is None:
                    table = np.frombuffer(b"".join(words), _USED)
                    table = table[np.argsort(table["k"], kind="stable")]
                    table_keys = table["k"].copy()
                    words = []
                for lo, hi in _groups(part):
                    texts = _texts(part, lo, hi)
                    t = tokens(texts, powers)
                    k, _, back = distinct(keys(t, groups))
                    found = table[np.searchsorted(table_keys, k)][back]
                    c = found["c"]
                    piece = _runs_of_pieces(t.doc)
                    own, pair, gate = own_shares(t.hash, piece)
                    p, scale = scaled(found["lp"].astype(float), found["share"].astype(float), own, pair)
                    lp = expert_mix(p, gate, piece, model.shares) + scale
                    m = len(texts)
                    many = lambda w=None: np.bincount(t.doc, w, minlength=m)  # noqa: B023, E731
                    score = many(lp)
                    ids = part.column("doc_id").slice(lo, hi - lo)
                    held = [d.is_valid and zlib.crc32(str(d.as_py()).encode()) % 10 == 0 for d in ids]
                    size = np.array([max(len(x), 1) for x in texts])
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(held), pa.array(many().astype(np.int64)), pa.array(many(c > 0).astype(np.int64)), pa.array(np.full(m, n, np.int64)), pa.array(many(np.log10((c + 0.1) / floor))), pa.array(score), pa.array(-score * math.log2(10) / size)],
                        names=[x.split()[0] for x in _SCORED.split(", ")],
                    )

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """_SCORED for each document: learned from those that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = saved(rows.withColumn("training", ~held_out(F.col("doc_id"))).withColumn("chunk", F.spark_partition_id()), "chunks")
    habits = _summed(base.where("training").select("text").mapInArrow(_habits, _SUMS), KINDS * KINDS + 2 * GATES + 256)
    groups = grouped(habits[0][: KINDS * KINDS].reshape(KINDS, KINDS))
    chunks = (base.agg(F.max("chunk")).first()[0] or 0) + 1
    counted = base.select("text", "training", "chunk").mapInArrow(_counted(groups, chunks), _PACKED)
    vocabulary = saved(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_merged, _VOCABULARY), "vocabulary")
    known = vocabulary.where("main and exists(t, n -> n > 0)").select("word", "t")
    *by_state, v = known.agg(*[F.coalesce(F.sum(F.col("t")[s]), F.lit(0)) for s in range(STATES)], F.count("*")).first()
    model = _fit(known, habits, np.array(by_state, float), int(v))
    none = lambda kind: F.lit(None).cast(kind)
    words = vocabulary.mapInArrow(_looked_up(model), "chunk int, data binary").select("chunk", F.lit(0).alias("kind"), "data", none("long").alias("doc_id"), none("string").alias("text"))
    texts = base.select("chunk", F.lit(1).alias("kind"), none("binary").alias("data"), "doc_id", "text")
    both = words.unionAll(texts).repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(_scored(model, groups), _SCORED)
