"""The language model against plain loops: bits, mixing, states, and what the fits learn from."""

import math
import zlib

import numpy as np
import pytest

from brightloom.llm import lmscore
from brightloom.llm.common import Powers


def test_every_training_document_and_word_is_learned(spark, monkeypatch):
    rows = [(i, f"w{i} of many") for i in range(2_500)]
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    assert len(training) > 2_000
    seen, summed = [], lmscore._summed
    monkeypatch.setattr(lmscore, "_summed", lambda *a: seen.append(summed(*a)) or seen[-1])
    lmscore.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert len(seen) == 1 + lmscore.ROUNDS
    # tokens by gate; then bits by gate, as many as their words occur: four for a frequent byte, else twelve
    assert seen[0][1][lmscore.KINDS**2 :][: lmscore.GATES].sum() == 4 * len(training)
    code = lmscore.ranks(seen[0][0][-256:])
    assert (code < lmscore.OTHER).sum() == lmscore.OTHER and code[ord(" ")] < 4
    for _, n in seen[1:]:
        assert n[: lmscore.BIT_GATES].sum() == sum(4 if code[b] < lmscore.OTHER else 12 for t in training for w in [*t.split(), "\n"] for b in w.encode() + b" ")


CODE = lmscore.ranks(np.bincount(np.frombuffer(b"  eeetttaaoinshrdlu", np.uint8), minlength=256))


def made_model(r):
    counts = r.integers(0, 40, (2, int(lmscore._FIRST[-1]))).astype(np.float32)
    mixer = lmscore.Mixer(len(lmscore.PLACES) + 1, lmscore.BIT_GATES)
    mixer.w = r.uniform(-0.3, 0.6, mixer.w.shape).astype(np.float32)
    mixer.n, mixer.ones = r.integers(0, 3000, mixer.n.shape).astype(float), r.integers(0, 1000, mixer.n.shape).astype(float)
    mixer.ones = np.minimum(mixer.ones, mixer.n)
    mixer.settle()
    places = slice(int(lmscore._FIRST[lmscore.PREFIX]), int(lmscore._FIRST[lmscore.PREFIX + 1]))
    return lmscore.Model(CODE, lmscore.log_odds(*counts), lmscore.level(counts[:, places].sum(0)), mixer, None, np.ones(9), 1), counts


def test_bits_against_plain_loops():
    """The same coder, one bit at a time: gate, log-odds, weights, map."""
    r = np.random.default_rng(1)
    model, counts = made_model(r)
    words, state = [b"the", b"a", "straße".encode(), b"\n", b"x" * 40], np.array([0, 3, 1, 8, 2])
    bits = lmscore.spelled(words, state, CODE)
    want, at = [], 0
    m = model.mixer
    for w in words:
        total = 0.0
        for place, byte in enumerate(w + b" "):
            fours = [CODE[byte]] if CODE[byte] < 15 else [15, byte >> 4, byte & 15]
            for part, d in [(j, d) for j in range(len(fours)) for d in range(4)]:
                bit = int(fours[part]) >> (3 - d) & 1
                assert bits.bit[at] == bit
                x = [math.log((counts[1][a[at]] + 0.4) / (counts[0][a[at]] + 0.4)) for a in bits.at] + [0.3]
                seen = counts[0][bits.at[lmscore.PREFIX][at]] + counts[1][bits.at[lmscore.PREFIX][at]]
                gate = ((place > 0) * 3 + part) * 4 + d + 24 * sum(seen >= v for v in lmscore.LEVELS)
                z = min(max(sum(a * b for a, b in zip(x, m.w[:, gate].tolist(), strict=True)), -8), 7.999)
                z = (math.floor((z + 8) * m.FINE / 16) + 0.5) * 16 / m.FINE - 8
                low = math.floor((z + 8) * m.BINS / 16)
                part = (z + 8) * m.BINS / 16 - low
                p = (1 / (1 + math.exp(-z)) + m.map[gate, low] * (1 - part) + m.map[gate, low + 1] * part) / 2
                p = min(max(p, 1 / 65536), 1 - 1 / 65536)
                total += math.log10(p if bit else 1 - p)
                at += 1
        want.append(total)
    assert at == len(bits.bit)
    # a rounding at the edge of a bin moves a bit by a bin's width at most
    assert np.allclose(model.spell(bits, len(words)), want, atol=0.02)


def test_codes_are_probabilities():
    """After any word so far, the chances of all next bytes add up to one."""
    model, _ = made_model(np.random.default_rng(2))
    head = b"wo"
    words = [head + bytes([b]) for b in range(256)]
    bits = lmscore.spelled(words, np.full(256, 4), CODE)
    x = [model.odds[at] for at in bits.at]
    gate = bits.gate + model.seen[bits.at[lmscore.PREFIX] - int(lmscore._FIRST[lmscore.PREFIX])]
    each = model.mixer.scores(lmscore.with_bias(x), gate, bits.bit).reshape(-1, 4).sum(1, dtype=float)
    fours = lambda text: sum(1 if CODE[b] < 15 else 3 for b in text)
    total, at = 0.0, 0
    for w in words:
        total += 10 ** each[at + fours(head) : at + fours(w)].sum()
        at += fours(w + b" ")
    # what is missing is the second code that frequent bytes have, and never use
    assert 0.5 < total <= 1 + 1e-6


def test_places_depend_on_what_precedes_only():
    one, two = (lmscore.spelled([w], np.array([3]), CODE) for w in (b"prefix", b"prefer"))
    same = 4 * sum(1 if CODE[b] < 15 else 3 for b in b"pref")
    for a, b in zip(one.at, two.at, strict=True):
        assert np.array_equal(a[: same + 1], b[: same + 1])
    other = lmscore.spelled([b"prefix"], np.array([4]), CODE)
    assert [np.array_equal(a, b) for a, b in zip(one.at, other.at, strict=True)] == [True, True, True, False, True, False]


@pytest.mark.parametrize("trial", range(5))
def test_experts_against_plain_loops(trial):
    r = np.random.default_rng(trial)
    length = [30, 1, 7, 30]
    piece, gate = np.repeat(np.arange(4), length), r.integers(0, lmscore.GATES, sum(length))
    p, shares = r.random((sum(length), 4)), r.dirichlet(np.ones(4), lmscore.GATES)
    want, w, last = [], None, None
    for i in range(len(p)):
        if piece[i] != last:
            w, last = shares.copy(), piece[i]
        parts = w[gate[i]] * p[i]
        want.append(math.log10(parts.sum()))
        w[gate[i]] += lmscore.RATE * (parts / parts.sum() - w[gate[i]])
    got = lmscore.expert_mix(p, gate, piece, shares)
    assert np.allclose(got, want)
    # what comes later, and other texts, change nothing
    assert np.allclose(lmscore.expert_mix(p[:20], gate[:20], piece[:20], shares), got[:20])


def test_own_shares_and_states_against_plain_loops():
    texts = [b"a b a b c a b", b"", b"the x of the x of the", b"longer words only here"]
    t = lmscore.tokens(texts, Powers())
    own, pair, _ = lmscore.own_shares(t.hash, lmscore._runs_of_pieces(t.doc))
    groups = np.random.default_rng(0).integers(1, 9, lmscore.KINDS)
    state = lmscore.states(t, groups)
    at = 0
    for text in texts:
        words = [*text.split(), "end"]
        for i, w in enumerate(words):
            assert own[at] == (words[:i].count(w) / i if i else 0)
            before = [words[j] for j in range(1, i) if words[j - 1] == words[i - 1]]
            assert math.isclose(pair[at], before.count(w) / len(before) if before else 0)
            short = [x for x in words[:i] if len(x) <= lmscore.SHORT]
            assert state[at] == (groups[next(t.hash[k] for k in range(len(t.hash)) if t.data[t.start[k] : t.start[k] + t.size[k]] == short[-1] and t.size[k]) & 255] if short else 0)
            at += 1
    assert at == len(t.hash)


def test_weights_learn():
    """Newton steps find the one input that tells the bits."""
    r = np.random.default_rng(3)
    bit = r.integers(0, 2, 40_000).astype(np.uint8)
    odds = 2.0 * (2 * bit.astype(float) - 1) * np.where(r.random(40_000) < 1 / (1 + math.exp(-2.0)), 1, -1)
    x = [r.standard_normal(40_000).astype(np.float32), odds.astype(np.float32)]
    mixer = lmscore.Mixer(2, 3)
    mixer.learn(x, r.integers(0, 3, 40_000), bit, np.ones(40_000, np.float32), block=1_000)
    assert np.allclose(mixer.w, [[0.0] * 3, [1.0] * 3], atol=0.1)


def test_held_out_texts_score_above_the_base(spark):
    got = lmscore.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").selectExpr("sum(score) as s", "sum(base_score) as b", "count(*) as n").first()
    assert got["n"] > 50 and got["s"] > 0.98 * got["b"]


def test_scores_of_odd_rows(spark):
    rows = [(None, "a b a b"), (3, "a b a b"), (3, None), (3, ""), (4, " \t\n"), (5, "x" * 70_000), (6, "w " * 40_000), (7, "A B\na  b")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as k", "'x' as word", "2 as chunk")
    got = lmscore.score(table.unionAll(table)).collect()
    assert len(got) == 2 * len(rows)
    by = {}
    for x in got:
        by.setdefault((x["n_tokens"], x["n_known"], x["score"], x["base_score"]), []).append(x["doc_id"])
    assert sorted(map(len, by.values())) == [2, 2, 6, 6]
    empty = [x for x in got if x["n_tokens"] == 1]
    assert len(empty) == 6 and all(x["score"] < 0 for x in empty)
    none = [tuple(x) for x in lmscore.score(spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0], "doc_id long, text string")).collect()]
    assert none and all(x[1] and x[3] == 0 and x[4] == 0 and math.isfinite(x[6]) for x in none)


def test_held_out_words_that_no_double_can_hold(spark):
    """Long words that training lacks are finite and near what their own bytes allow; so are words after them."""
    known = [(i, "the quick brown fox jumps over the lazy dog and so on") for i in range(200)]
    held = [i for i in range(1_000, 3_000) if zlib.crc32(str(i).encode()) % 10 == 0]
    r = np.random.default_rng(4)
    letters = bytes(r.integers(97, 113, 2_000).astype(np.uint8)).decode()
    odd = [f"{letters} and so on", f"the {letters} {letters} lazy dog", "中文没有空格" * 100, "x" * 70_000, "lazy " * 20_000 + "quicksilver"]
    got = {x["doc_id"]: x for x in lmscore.score(spark.createDataFrame(known + list(zip(held, [*odd, "lazy " * 20_000], strict=False)), "doc_id long, text string")).collect()}
    score = [got[i]["score"] for i in held[:6]]
    assert all(got[i]["held_out"] for i in held[:6]) and all(math.isfinite(x["score"]) for x in got.values())
    # 16 letters: 1.2 digits each
    assert -1.3 * 2_000 < score[0] < -1.15 * 2_000 and score[1] > 1.01 * score[0] - 20
    assert score[2] > -120 and score[3] > -60
    # the last word costs its spelling, whatever came before
    assert score[5] - score[4] < 25


def test_own_spelling_against_plain_loops():
    for word in (b"abracadabra" * 5, b"x" * 90, bytes(range(33, 120)), "中文".encode() * 30):
        data, want = word + b" ", []
        for order in lmscore.OWN_ORDERS:
            total = 0.0
            for i, b in enumerate(data):
                chance = lambda k, back, less: (sum(data[j] == b and data[max(j - k, 0) : j] == data[max(i - k, 0) : i] for j in range(i)) + back * less) / (sum(data[max(j - k, 0) : j] == data[max(i - k, 0) : i] for j in range(i)) + back)  # noqa: B023, E731
                p = chance(0, lmscore.OWN_BACK[0], 1 / 256)
                total += math.log10(p if order == 0 else chance(order, lmscore.OWN_BACK[lmscore.OWN_ORDERS.index(order)], p))
            want.append(10**total)
        assert math.isclose(lmscore.own_spelling(word), math.log10(sum(want) / 3), abs_tol=0.01)
    # longer than a piece
    assert -60 < lmscore.own_spelling(b"y" * 100_000) < 0


def test_mix_of_experts_far_below_a_double():
    lp, rest = np.array([-400.0, -2.0, -5_000.0]), [np.array(x) for x in ([0.0, 0.5, 0.25], [0.0, 0.0, 0.125], [0.0, 0.25, 0.0])]
    p, scale = lmscore.scaled(lp, *rest)
    got = lmscore.expert_mix(p, np.zeros(3, int), np.arange(3), np.full((1, 4), 0.25)) + scale
    assert np.allclose(got, [math.log10(0.25) - 400, math.log10(0.25 * 0.76), math.log10(0.25 * 0.375)])
