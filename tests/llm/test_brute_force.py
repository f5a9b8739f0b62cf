"""Operators without comparison SQL against plain loops, and rows that are odd."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import htmltext, jaccard, langid, pieces, queries, stages, urls

R = random.Random(11)


# 2 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return htmltext.train(htmltext.labelled_pages(n=40), rounds=40)


@pytest.mark.parametrize("trial", range(15))
def test_viterbi_against_all_labellings(field, trial):
    """The best of all sequences of labels, by the sums that the field defines."""
    r = random.Random(trial)
    page = [b for html, _ in htmltext.labelled_pages(seed=trial, n=2) for b in htmltext.blocks(html)]
    page = r.sample(page, min(len(page), 8))

    def total(labels):
        s = field.start[labels[0]]
        for i, ((path, text, linked), y) in enumerate(zip(page, labels, strict=True)):
            for f in [*htmltext.path_features(path), *htmltext.text_features(text, linked, i == 0)]:
                s += field.weights.get(f, (0.0, 0.0))[y]
            if i:
                s += field.moves[labels[i - 1]][y]
        return s

    best = max(total(y) for y in itertools.product((0, 1), repeat=len(page)))
    assert math.isclose(total(field.labels(page, {})), best, rel_tol=1e-9, abs_tol=1e-9)


def test_html_odd_rows(spark, field):
    rows = [(None, "<article><p>Some text that is long enough to stay here.</p></article>")] * 3 + [(1, "<article><p>Before it. <object>never closed <p>After it, a sentence with words.</article>")]
    table = spark.createDataFrame(rows, "page_id long, html string").withColumns({"url": F.lit("u"), "n_chars": F.lit("x"), "path": F.lit(1)})
    got = htmltext.extract(table, field).collect()
    assert len(got) == 4 and len({r["text"] for r in got if r["page_id"] is None}) == 1
    assert "After it" in next(r["text"] for r in got if r["page_id"] == 1)
    assert htmltext.extract(table.where("false"), field).count() == 0


# 3 ----------------------------------------------------------------------------------------------------------------


def test_vectors_against_plain_loops():
    texts = ["", "a", "Straße und Weg", "the the the", "x" * 500]
    data = b"".join(t.encode() for t in texts)
    at = np.cumsum([0] + [len(t.encode()) for t in texts])
    got = langid.vectors(np.frombuffer(data, np.uint8), at)
    for row, t in zip(got, texts, strict=True):
        b = t.encode().translate(langid._TABLE)
        b += b" " * max(0, 3 - len(b))
        counts = {}
        for n, odd in ((3, 2654435761), (4, 2246822519)):
            for i in range(len(b) - n + 1):
                k = int.from_bytes(b[i : i + n], "little") * odd % 2**32 >> (32 - langid.BITS)
                counts[k] = counts.get(k, 0) + 1
        want = np.zeros(1 << langid.BITS)
        for k, c in counts.items():
            want[k] = math.sqrt(c / sum(counts.values()))
        assert np.allclose(row, want, atol=1e-6)


def test_decisions_against_plain_loops():
    """Votes, then summed certainties; the score is the product of the least certain duels."""
    r = np.random.default_rng(5)
    names = ["en", "de", "sv", "fr", "es"]
    x = r.standard_normal((200, 1 << langid.BITS)).astype(np.float32)[:, :]
    model = langid.LanguageModel.train([names[i % 5] for i in range(200)], x)
    got, score = model.predict(x[:40])
    margin = x[:40] @ model.weights + model.bias

    def duel(i, group, members):
        sure = {v: [] for v in members}
        for k, (g, a, b) in enumerate(model.pairs):
            if g == group and a in members:
                p = 1 / (1 + math.exp(-4 * float(np.clip(margin[i, k], -8, 8))))
                sure[a].append(p)
                sure[b].append(1 - p)
        best = max(members, key=lambda v: (sum(p > 0.5 for p in sure[v]), sum(sure[v])))
        return best, min(sure[best], default=1.0)

    for i in range(40):
        kind, p = duel(i, "", sorted(model.groups))
        lang, q = duel(i, kind, model.groups[kind])
        assert got[i] == lang and math.isclose(score[i], p * q, rel_tol=1e-6)


def test_language_odd_rows(spark):
    rows = [(1, "the water and the house", "en"), (1, "the water and the house", "en"), (None, "das wasser und das haus", "de"), (2, "das wasser und das haus", "de"), (3, "x", None)] * 4
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"key": F.lit(1), "v": F.lit("x"), "lang_pred": F.lit(1)})
    model = langid.fit(table)
    got = langid.identify(table, model).collect()
    assert len(got) == len(rows) and len({(r["text"], r["lang_pred"], r["score"]) for r in got}) == 3
    assert {r["lang_pred"] for r in got if r["lang"] == "de"} == {"de"}


# 6 ----------------------------------------------------------------------------------------------------------------


def test_round_trip_of_every_kind_of_character(spark):
    texts = ["", "▁", "a▁b ▁", "\x00\x01", "\U0001f600 ok", "  two  spaces ", "é" * 3, "�", "\U0010ffff", None, ""]
    table = spark.createDataFrame([(None, t) for t in texts] * 2, "doc_id long, text string").withColumns({"ids": F.lit(1), "score": F.lit("x"), "n_pieces": F.lit(0)})
    got = pieces.encode(table, queries.PIECES).collect()
    assert len(got) == 2 * len(texts) and all(r["round_trip"] for r in got)


# 7 ----------------------------------------------------------------------------------------------------------------


def test_representatives_of_shared_ids(spark):
    rows = [(5, "b one two three four five six", "y"), (5, "a one two three four seven", "x"), (5, "a one two three four seven", "w"), (6, "other words here for all to see", "z"), (None, "n " * 9, "q"), (None, "n " * 9, "q")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [{tuple(r) for r in jaccard.representatives(t).where("doc_id is not null").collect()} for t in (table, table.repartition(5), table.orderBy(F.desc("text")))]
    assert got[0] == got[1] == got[2] and sorted((r[0], r[1][0]) for r in got[0]) == [(5, "a"), (6, "o")]


# 10 ---------------------------------------------------------------------------------------------------------------


def test_regression_against_plain_loops(spark):
    """The same steps in numpy, from the same hashed n-grams; the n-grams against slices of the text."""
    labelled = urls.labelled_urls(spark)
    rows = labelled.orderBy("url", "keep").select("url", "keep", urls.features(urls.host_of(F.col("url")), urls.path_of(F.col("url"))).alias("f")).collect()
    for r in rows[:5]:
        host, _, path = r["url"].split("://", 1)[1].partition("/")
        path = ("/" + path).split("?")[0].split("#")[0]
        grams = [(salt, f"^{t}$$"[i : i + urls.N]) for salt, t in (("h", host.lower()), ("p", path)) for i in range(len(t) + 3 - urls.N + 1)]
        want = spark.createDataFrame(grams, "s string, g string").select(F.pmod(F.hash("s", "g"), F.lit(1 << urls.BITS)).alias("k")).collect()
        assert sorted(x["k"] for x in want) == sorted(r["f"])
    w = np.zeros((1 << urls.BITS) + 1)
    for _ in range(urls.EPOCHS):
        g = np.zeros_like(w)
        for r in rows:
            z = w[r["f"]].sum() / math.sqrt(len(r["f"])) + w[-1]
            e = r["keep"] - 1 / (1 + math.exp(-z))
            np.add.at(g, r["f"], e / math.sqrt(len(r["f"])))
            g[-1] += e
        w += urls.RATE * (g / len(rows) - urls.DECAY * w)
    got = urls.train(labelled).first()["_weights"]
    assert np.allclose(got, w, atol=1e-9)


def test_urls_odd_rows(spark):
    rows = [(None, "http://a.example.org/es/x")] * 2 + [(1, "http://" + "h" * 50_000 + ".com/fr/"), (2, "")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumns({"weights": F.lit("kept"), "score": F.lit("x")})
    got = urls.judge(table, urls.labelled_urls(spark)).collect()
    assert len(got) == 4 and all(r["weights"] == "kept" for r in got) and [r["verdict"] for r in got if r["page_id"] is None] == ["block"] * 2
    assert next(r["rule"] for r in got if r["page_id"] == 1) == "com/fr/"


# the stages -------------------------------------------------------------------------------------------------------


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", [k for k, _ in stages.STAGES])
def test_stages_on_odd_rows(spark, name):
    """Nulls in any column, empty and long texts, repeats, an empty table and a clashing column."""
    stage = dict(stages.STAGES)[name]
    long = " ".join(f"w{i}" for i in range(20_000))
    rows = [(None, "text of some words here", "en", "a", 1), (1, None, None, None, None), (2, "", "en", "a", 0), (3, long, None, "b", 9), (4, "the same words again and again", "en", None, 5), (4, "the same words again and again", "en", None, 5), (5, "die straße und das haus", "de", "b", 3)]
    table = spark.createDataFrame(rows, SCHEMA).withColumn("k1", F.lit("clash"))
    out = stage(spark, table, "").collect()
    if name == "encoded":
        assert len(out) == len(rows) and all(r["round_trip"] for r in out)
    else:
        assert set(out[0].asDict()) == set(stages.COLUMNS)
        assert long in {r["text"] for r in out}
    assert stage(spark, table.where("false"), "").count() == 0
