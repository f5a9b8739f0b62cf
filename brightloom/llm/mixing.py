"""Mixing sources to target weights by entropy balancing.

Token constraints say how many words the mix takes of each source, and optionally of each value of a second column. Among all
rates that meet them and stay at or below MOST, entropy balancing takes those nearest (in Kullback-Leibler divergence over
words) to taking everything once: a document's rate is the exponential of its source's dual plus its value's dual, cut
at MOST. The dual is convex. Each Newton step is one distributed aggregate over the table of (source, value) cells: the
sources' block of the curvature is diagonal and is eliminated in place, so only the second column's system, of a fixed
size, reaches the driver. With sources alone, the start is already the solution, and one step confirms it. Rates become
whole copies by systematic rounding inside buckets of a source.

Defined results: a null text has size 0; a null source or value is one of its own, sources with null last; a document of
size 0 takes no words; rows that repeat, share a doc_id or have none are separate documents, placed by doc_id and text;
constraints that contradict each other are met as far as the steps get; an empty table gives no rows. Columns of the input
other than those named are dropped, so clashing names do no harm.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checked, discard, ranked, saved

#: A source's target is at most this many times its size, and so is a document's share.
MOST = 3.0
#: Rows that one bucket of a source has on average while rates are rounded.
BUCKET_ROWS = 128
#: Sources up to which their table is broadcast; above, it is joined with a shuffle.
BROADCAST_SOURCES = 10_000
#: Documents up to which their copies are broadcast (about 100 bytes each).
BROADCAST_COPIES = 200_000
NEWTON_STEPS = 60
#: Values that the second column may have; their system of equations is solved on the driver.
MOST_VALUES = 1_000
#: Times that a bucket's remaining lack of words is spread over its shortest documents.
CORRECTIONS = 4


def _order() -> Column:
    """What places a document: a hash of its doc_id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary"))


def sized(docs: DataFrame, column: str | None = None) -> DataFrame:
    """doc_id, source, size in words, order (a hash of doc_id and text), value of the second column."""
    value = F.col(column).cast("string") if column else F.lit(None).cast("string")
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), _order().alias("_order"), value.alias("_value"))


def targets(sizes: DataFrame, weights: tuple = (1, 2, 3)) -> DataFrame:
    """source, source_size, n, target: water-filling under the cap. One aggregate row reaches the driver in each round."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = ranked(sums, [F.col("source").asc_nulls_last()], "_rank", "source-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = saved(rank.withColumn("weight", weight), "source-sizes")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap, level = MOST * F.col("source_size"), 0.0
    while True:
        above = cap < F.lit(level) * F.col("weight")
        held, open_weight = table.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (held or 0.0)) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return table.withColumn("target", F.least(cap, F.lit(level) * F.col("weight"))).drop("_rank", "weight")


def balanced(sizes: DataFrame, sources: DataFrame, values: dict | None = None) -> tuple[DataFrame, dict]:
    """(sources with their dual, duals of the values of the second column).

    values: words to take of each value; without it, sources alone. Steps are damped to 1 and end when none moves a dual.
    """
    first = F.when(F.col("target") > 0, F.log(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    solved = saved(sources.withColumn("dual", first), "duals")
    names = list(values or {})
    if len(names) > MOST_VALUES:
        raise ValueError(f"the second column has {len(names)} values, more than {MOST_VALUES}")
    mu = np.zeros(len(names))
    cells = sizes.groupBy("source", "_value").agg(F.sum("size").alias("w")).where("w > 0")
    place = {v: k for k, v in enumerate(names)}
    index = F.coalesce(*[F.when(F.col("_value").eqNullSafe(F.lit(v)), F.lit(k)) for v, k in place.items()], F.lit(-1)) if names else F.lit(-1)
    cells = saved(cells.withColumn("_at", index.cast("int")).groupBy("source", "_at").agg(F.sum("w").cast("double").alias("w")), "cells")
    wanted = np.array([float((values or {})[v]) for v in names])
    for _ in range(NEWTON_STEPS):
        right = checked(solved.where("target > 0").select(F.col("source").alias("_source"), "target", "dual"), BROADCAST_SOURCES)
        bias = F.coalesce(F.element_at(F.array(*[F.lit(float(x)) for x in mu]), F.greatest(F.col("_at") + 1, F.lit(1))), F.lit(0.0)) if names else F.lit(0.0)
        x = F.col("dual") + F.when(F.col("_at") >= 0, bias).otherwise(F.lit(0.0))
        mass = F.col("w") * F.least(F.exp(x), F.lit(MOST))
        bend = F.when(x <= math.log(MOST) + 1e-12, mass).otherwise(F.lit(0.0))
        met = cells.join(right, F.col("source").eqNullSafe(F.col("_source"))).select("source", "_at", "target", mass.alias("mass"), bend.alias("bend"))
        each = met.groupBy("source").agg(F.first("target").alias("target"), F.sum("mass").alias("mass"), F.sum("bend").alias("bend"), F.collect_list(F.struct("_at", "mass", "bend")).alias("parts"))
        each = each.withColumn("lack", F.when(F.col("bend") > 0, (F.col("mass") - F.col("target")) / F.col("bend")).otherwise(F.lit(0.0)))
        step = np.zeros(len(names))
        if names:
            step = _second_step(each, wanted)
            mu = mu + step
        moved = F.aggregate("parts", F.lit(0.0), lambda t, c: t + F.when(c["_at"] >= 0, c["bend"] * F.element_at(F.array(*[F.lit(float(v)) for v in step]), F.greatest(c["_at"] + 1, F.lit(1)))).otherwise(F.lit(0.0))) if names else F.lit(0.0)
        shift = -F.col("lack") - F.when(F.col("bend") > 0, moved / F.col("bend")).otherwise(F.lit(0.0))
        shifts = each.select(F.col("source").alias("_source"), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), shift)).alias("_shift"))
        if not names:
            largest = shifts.agg(F.max(F.abs("_shift"))).first()[0] or 0.0
            if largest < 1e-12:
                break
        stepped = solved.join(checked(shifts, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source")), "left")
        new = saved(stepped.withColumn("dual", F.col("dual") + F.coalesce("_shift", F.lit(0.0))).withColumn("_moved", F.abs(F.coalesce("_shift", F.lit(0.0)))).drop("_source", "_shift"), "duals")
        discard(solved)
        solved = new
        if max(new.agg(F.max("_moved")).first()[0] or 0.0, np.abs(step).max(initial=0.0)) < 1e-12:
            break
    return solved, {v: float(mu[k]) for v, k in place.items()}


def _second_step(each: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """The damped Newton step of the second column's duals after the sources' are eliminated; sums of a fixed size reach the driver."""
    g = len(wanted)
    one = each.select("lack", "bend", F.explode("parts").alias("a"), "parts").where("a._at >= 0")
    sums = one.groupBy("a._at").agg(F.sum("a.mass").alias("mass"), F.sum("a.bend").alias("bend"), F.sum(F.col("a.bend") * F.col("lack")).alias("held"))
    both = one.where("bend > 0").select("a", "bend", F.explode("parts").alias("b")).where("b._at >= 0")
    cross = both.groupBy(F.col("a._at").alias("i"), F.col("b._at").alias("j")).agg(F.sum(F.col("a.bend") * F.col("b.bend") / F.col("bend")).alias("v"))
    slope, curve = -wanted.copy(), np.zeros((g, g))
    for r in sums.collect():
        slope[r["_at"]] += r["mass"] - r["held"]
        curve[r["_at"], r["_at"]] += r["bend"]
    for r in cross.collect():
        curve[r["i"], r["j"]] -= r["v"]
    # the system is singular, as sources fix the total; the shortest step is taken
    step = -np.linalg.lstsq(curve, slope, rcond=1e-10)[0]
    return step / max(1.0, np.abs(step).max(initial=0.0))


def mix(docs: DataFrame, weights: tuple = (1, 2, 3), column: str | None = None, values: dict | None = None) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies, taken: one row for each document. values: words to take of each value of column.

    In a bucket, documents stand in order of size and copies are the steps of the running sum of rates, so each bucket
    takes its expected number of documents of every length, up to one. Then short documents get or lose a copy until the
    bucket's words lie within one such document of what its rates ask for.
    """
    return _mixed(docs, weights, column, values).select("doc_id", "size", "source_size", "target", "rate", "copies", "taken")


def _mixed(docs: DataFrame, weights: tuple, column: str | None, values: dict | None) -> DataFrame:
    sizes = saved(sized(docs, column), "sizes")
    sources, duals = balanced(sizes, targets(sizes, weights), values)
    few = sources.count() <= BROADCAST_SOURCES
    right = sources.select(F.col("source").alias("_source"), "source_size", "n", "target", "dual")
    joined = sizes.join(F.broadcast(right) if few else right, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    bias = F.coalesce(*[F.when(F.col("_value").eqNullSafe(F.lit(v)), F.lit(x)) for v, x in duals.items()], F.lit(0.0)) if duals else F.lit(0.0)
    rate = F.when(F.col("target") > 0, F.least(F.round(F.exp(F.col("dual") + bias), 12), F.lit(MOST))).otherwise(F.lit(0.0))
    order = F.col("_order")
    bucketed = joined.withColumn("rate", rate).withColumn("_bucket", F.pmod(F.conv(F.substring(order, 1, 8), 16, 10).cast("long"), F.ceil(F.col("n") / BUCKET_ROWS)))
    if not few:
        bucketed = bucketed.repartition("source", "_bucket")
    group = Window.partitionBy("source", "_bucket")
    ordered = group.orderBy("size", order, "doc_id")
    phase = F.col("_bucket") * 0.6180339887498949 + 0.5
    phase = phase - F.floor(phase)
    upto = F.sum("rate").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    if not duals:
        upto = F.col("rate") * F.row_number().over(ordered)  # equal rates: no sum to round
    out = bucketed.withColumn("_upto", upto)
    out = out.withColumn("copies", F.floor(F.round(F.col("_upto") + phase, 9)) - F.floor(F.round(F.col("_upto") - F.col("rate") + phase, 9)))
    for _ in range(CORRECTIONS):
        lack = F.round(F.sum(F.col("size") * (F.col("rate") - F.col("copies"))).over(group), 6)
        out = out.withColumn("_lack", lack)
        can = (F.col("size") > 0) & F.when(F.col("_lack") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0)
        run = F.sum(F.when(can, F.col("size")).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        # too much with nothing short enough to remove: the shortest that was taken goes, and the next round refills
        stuck = (F.col("_lack") < -0.1 * F.sum(F.col("size") * F.col("rate")).over(group)) & (run == F.col("size"))
        out = out.withColumn("copies", F.col("copies") + F.when(can & ((run <= F.abs("_lack")) | stuck), F.signum("_lack")).otherwise(0).cast("long"))
    return out.withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))


def mixed(docs: DataFrame, weights: tuple = (1, 2, 3), column: str | None = None, values: dict | None = None) -> DataFrame:
    """docs, each row as many times as the mix takes it; equal rows take the fewest copies any of them has."""
    copies = _mixed(docs, weights, column, values).groupBy("doc_id", "_order", "source").agg(F.min("copies").cast("int").alias("_copies"))
    named = copies.where("_copies > 0").select(F.col("doc_id").alias("_doc"), "_order", F.col("source").alias("_from"), "_copies")
    right = checked(saved(named, "copies"), BROADCAST_COPIES)
    own = docs.withColumn("_own", _order())
    taken = own.join(right, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_order")) & F.col("source").eqNullSafe(F.col("_from")))
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(*docs.columns)
