"""The functions behind corpus_pipeline.STAGES; each takes (spark, docs, sf_dir).

All but the last return the columns of documents. Nulls, empty texts and repeated rows are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard, langid, mixing, pieces, suffixes
from .common import prepared
from .queries import PIECES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`: no text or no letter); all others stay."""
    prepared(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.identify(docs.select(*COLUMNS), model).where(F.col("lang_pred") != "und").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8 or more."""
    prepared(spark)
    return jaccard.representatives(docs.select(*COLUMNS), words=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without passages of over 50 words that occur more than once, and strings of 400 bytes that do; documents that consist of them go."""
    prepared(spark)
    return suffixes.cleaned(docs.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix of sources takes them."""
    prepared(spark)
    return mixing.mixed(docs.select(*COLUMNS))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, with its n-best scores."""
    prepared(spark)
    return pieces.encode(docs, PIECES, with_ids=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("encoded", encoded),
]
