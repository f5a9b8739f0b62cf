"""Joins: every type under every strategy, and the ones Catalyst has no operator for: range, as-of and salted joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import add, frame, sql
from ..sources.files import scratch
from ..tables import load

#: Rows up to which one side is broadcast by the helpers below.
BROADCAST_ROWS = 1_000_000


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if a count shows it to be small; otherwise unchanged, so the join shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


_HINTS = {"broadcast": "broadcast", "hash": "shuffle_hash", "merge": "merge"}
_TYPES = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


#: All rows of both tables; those that a value rules out have no key, so every type has matched and unmatched rows on both sides.
_BUYER = "case when c_mktsegment <> 'MACHINERY' then c_custkey end"
_ORDER = "case when o_totalprice > 250000 then nullif(o_custkey, 7) end"


def _typed(how: str, hint: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment", f"{_BUYER} as k")
        o = load(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ORDER} as b")
        right = checked_broadcast(o) if hint == "broadcast" else o.hint(hint)
        joined = c.join(right, c["k"] == o["b"], how)
        return joined.select("c_custkey", "c_mktsegment") if how in ("left_semi", "left_anti") else joined.select("c_custkey", "c_mktsegment", "o_orderkey")

    return build


def _typed_sql(how: str) -> str:
    c, o = f"(select *, {_BUYER} as k from customer) c", f"(select *, {_ORDER} as b from orders) o"
    if how in ("left_semi", "left_anti"):
        return f"select c_custkey, c_mktsegment from {c} where {'not ' * (how == 'left_anti')}exists (select 1 from {o} where k = b)"
    return f"select c_custkey, c_mktsegment, o_orderkey from {c} {how} join {o} on k = b"


for _name, _how in _TYPES.items():
    for _kind, _hint in _HINTS.items():
        add(f"join_{_name}_{_kind}", _typed(_how, _hint), _typed_sql(_how), f"join.{_how} join.{ {'broadcast': 'broadcast_hash', 'hash': 'shuffled_hash', 'merge': 'sort_merge'}[_kind] } exchange.broadcast")

sql("join_cross", "select r_name, count(*) as n from region cross join nation group by r_name", covers="join.cross")
sql("join_not_in_null", "select c_custkey from customer where c_nationkey not in (select nullif(s_nationkey, 0) from supplier)", covers="join.not_in join.null_aware_anti")
sql("join_not_in_values", "select c_custkey from customer where nullif(c_nationkey, 3) not in (select s_nationkey from supplier where s_nationkey < 5)", covers="join.not_in join.null_aware_anti")
sql("join_not_in", "select n_nationkey from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 5000)", covers="join.not_in")
sql("join_exists_or", "select c_custkey from customer where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P' and o_totalprice > 400000)", covers="join.existence")
sql("join_null_safe", "select count(*) as n from (select nullif(n_regionkey, 1) as k from nation) a join (select nullif(r_regionkey, 1) as k from region) b on a.k <=> b.k",
    "select count(*) as n from (select nullif(n_regionkey, 1) as k from nation) a join (select nullif(r_regionkey, 1) as k from region) b on a.k is not distinct from b.k", covers="predicate.<=>")
sql("join_collated", "select count(*) as n from customer join (select c_mktsegment as s from customer group by c_mktsegment) t on collate(lower(c_mktsegment), 'UTF8_LCASE') = collate(t.s, 'UTF8_LCASE')",
    "select count(*) as n from customer join (select c_mktsegment as s from customer group by c_mktsegment) t on lower(c_mktsegment) = lower(t.s)", covers="join.collated group.collated")
sql("join_residual", "select o_orderkey, l_linenumber from orders join lineitem on o_orderkey = l_orderkey and l_extendedprice > o_totalprice / 4", covers="join.residual")
sql("join_using_natural", "select k, a.v as left_v, b.v as right_v from (select n_regionkey as k, max(n_name) as v from nation group by n_regionkey) a join (select r_regionkey as k, r_name as v from region) b using (k)", covers="join.using")


#: Pairs of rows that one task of a join without equality compares.
PAIRS_PER_TASK = 1 << 25


def theta_join(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """Pairs for which a condition without equality holds. All pairs are compared, so both sides are counted first and dealt to as many
    tasks as that takes, PAIRS_PER_TASK each. A small right side is broadcast; otherwise blocks of both sides meet.
    """
    rows = right.count()
    tasks = max(1, -(-left.count() * rows // PAIRS_PER_TASK))
    if rows <= BROADCAST_ROWS:
        return left.repartition(tasks).join(F.broadcast(right), on)
    blocks = math.isqrt(tasks - 1) + 1
    return left.repartition(blocks).join(right.repartition(blocks).hint("shuffle_replicate_nl"), on)


@frame("join_theta", "select a.s_suppkey as lo, b.s_suppkey as hi from supplier a join supplier b on a.s_acctbal < b.s_acctbal and a.s_nationkey > b.s_nationkey", "join.nested_loop")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier")
    a = s.selectExpr("s_suppkey as lo", "s_acctbal as less", "s_nationkey as after")
    b = s.selectExpr("s_suppkey as hi", "s_acctbal as more", "s_nationkey as before")
    return theta_join(a, b, (F.col("less") < F.col("more")) & (F.col("after") > F.col("before"))).select("lo", "hi")


def range_join(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, width: float) -> DataFrame:
    """Pairs with start <= point < end: both sides are cut into bins of a width, an equi-join on the bin, then the exact test.

    An interval is repeated for each bin it meets, so width should be about the usual interval (see usual_width).
    """
    p = points.withColumn("_bin", F.floor(F.col(point) / width))
    bins = F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))
    i = intervals.where(F.col(end) > F.col(start)).withColumn("_bin", F.explode(bins))
    return p.join(i, "_bin").where((F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))).drop("_bin")


def usual_width(intervals: DataFrame, start: str, end: str) -> float:
    """Twice the 90th percentile of the intervals' lengths: most meet one or two bins, and few points share one."""
    found = intervals.agg(F.percentile_approx(F.col(end) - F.col(start), 0.9, 1000)).first()[0]
    return 2.0 * float(found) if found and found > 0 else 1.0


#: Points, those with a value, and their values' halves.
_SUMS = ("_n", "_known", "_high", "_low")


def _running(names: tuple[str, ...] = ("_sign", "_key", *_SUMS)):
    """Of sorted rows (sign, key, value), where points have the sign 0: what lies before each other row in its partition, last the partition's sums.

    Values are added in halves of 32 bits, so no sum overflows.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        before, kind = np.zeros(4, np.int64), None
        for batch in batches:
            sign, value, kind = batch.column(0).to_numpy(), batch.column(2), batch.column(1).type
            v, point = value.fill_null(0).to_numpy(), sign == 0
            known = point & value.is_valid().to_numpy(zero_copy_only=False)
            sums = np.stack([point, known, np.where(point, v >> 32, 0), np.where(point, v & 0xFFFFFFFF, 0)]).astype(np.int64).cumsum(1) + before[:, None]
            before = sums[:, -1].copy() if len(sign) else before
            edge = np.flatnonzero(~point)
            yield pa.RecordBatch.from_arrays([pa.array(sign[edge]), batch.column(1).take(pa.array(edge)), *[pa.array(x[edge]) for x in sums]], names=list(names))
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.nulls(1, kind), *[pa.array([x], pa.int64()) for x in before]], names=list(names))

    return run


def range_totals(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, key: str, value: str) -> DataFrame:
    """For each key of intervals, over the pairs with start <= point < end: their number n and the total of a long value.

    No pair is made. Points and the intervals' ends are sorted together, once, by ranges; a running sum over them says at each end
    what lies below it, and an interval's total is the difference. Equal points and ends are told apart by their rows, so no value
    is too frequent for a task. Only sums for each partition reach the driver.
    """
    spark, kind = points.sparkSession, intervals.schema[key].dataType.simpleString()
    ends = F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col(end).alias("at"), F.lit(1).alias("sign")))).alias("_end")
    edges = intervals.where(F.col(end) > F.col(start)).select(F.col(key).alias("_key"), ends)
    edges = edges.select(F.col("_end.at").alias("_at"), F.lit(0).alias("_side"), F.col("_end.sign").alias("_sign"), "_key", F.lit(None).cast("long").alias("_value"))
    inner = points.where(F.col(point).isNotNull()).select(F.col(point).alias("_at"), F.lit(1).alias("_side"), F.lit(0).alias("_sign"), F.lit(None).cast(kind).alias("_key"), F.col(value).cast("long").alias("_value"))
    # ends come before the points that equal them
    dealt = edges.unionAll(inner).repartitionByRange("_at", "_side", "_key", "_value").sortWithinPartitions("_at", "_side")
    columns = ", ".join(f"{x} long" for x in _SUMS)
    path = scratch(spark)
    dealt.select("_sign", "_key", "_value").mapInArrow(_running(), f"_sign int, _key {kind}, {columns}").withColumn("_part", F.spark_partition_id()).write.parquet(path)
    sums = spark.read.schema(f"_sign int, _key {kind}, {columns}, _part int").parquet(path)
    offsets, total = [], [0] * len(_SUMS)
    for r in sorted(sums.where("_sign = 0").select("_part", *_SUMS).collect()):
        offsets.append((r["_part"], *total))
        total = [a + r[x] for a, x in zip(total, _SUMS, strict=True)]
    before = spark.createDataFrame(offsets, f"_part int, {', '.join(f'_before{x} long' for x in _SUMS)}")
    joined = sums.where("_sign <> 0").join(F.broadcast(before), "_part")
    found = joined.groupBy(F.col("_key").alias(key)).agg(*[F.sum(F.col("_sign") * (F.col(x) + F.col(f"_before{x}"))).alias(x) for x in _SUMS]).where("_n > 0")
    whole = (F.col("_high").cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("_low")).cast("long")
    return found.select(key, F.col("_n").alias("n"), F.when(F.col("_known") > 0, whole).alias("total"))


@frame("join_range", """
select o_orderkey, count(*) as n, cast(sum(event_id) as bigint) as ids from events
join (select o_orderkey, o_totalprice / 5000 as lo, o_totalprice / 5000 + 1.5 as hi from orders) o on value >= o.lo and value < o.hi group by o_orderkey""", "join.range")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of whole tables grow with the square of the input, so each interval's are counted, not returned, and not made either."""
    events = load(spark, sf_dir, "events").select("event_id", "value")
    spans = load(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice / 5000 as lo", "o_totalprice / 5000 + 1.5 as hi")
    return range_totals(events, spans, "value", "lo", "hi", "o_orderkey", "event_id").select("o_orderkey", "n", F.col("total").alias("ids"))


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before its time: one union and one window.

    Right rows that share key and time are reduced to the greatest first. A key's rows meet in one task, sorted and streamed.
    """
    value = F.struct(*values)
    r = right.groupBy(by, at).agg(F.max(value).alias("_v")).select(by, at, "_v", F.lit(0).alias("_side"), F.lit(None).alias("_row"))
    row = F.struct(*left.columns)
    both = r.unionByName(left.select(by, at, F.lit(None).alias("_v"), F.lit(1).alias("_side"), row.alias("_row")), allowMissingColumns=True)
    order = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_found", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return found.select("_row.*", *[F.col(f"_found.{v}").alias(v) for v in values])


@frame("join_asof", """
select a.event_id, b.value as last_view from (select * from events where event_type = 'purchase') a
asof left join (select user_id, ts, max(value) as value from events where event_type = 'view' group by user_id, ts) b on a.user_id = b.user_id and a.ts >= b.ts""", "join.asof")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    left = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.where("event_type = 'view'").select("user_id", "ts", F.col("value").alias("last_view"))
    return asof_join(left, right, "user_id", "ts", ["last_view"]).select("event_id", "last_view")


def salted_join(big: DataFrame, small: DataFrame, on: str, hot_rows: int = 100_000, share: int = 50_000) -> DataFrame:
    """Inner join in which keys with more than hot_rows rows on the big side are spread over salts; other keys aren't touched."""
    hot = big.groupBy(on).count().where(F.col("count") > hot_rows).select(on, F.ceil(F.col("count") / share).cast("int").alias("_salts"))
    hot = checked_broadcast(hot)
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = big.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*big.columns), salts).cast("int")).drop("_salts")
    right = small.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [on, "_salt"]).drop("_salt")


@frame("join_salted", "select n_name, count(*) as n, cast(sum(cast(c_acctbal as decimal(18,2))) as double) as bal from customer join nation on c_nationkey = n_nationkey group by n_name", "join.skew")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey", "c_acctbal")
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    joined = salted_join(c, n, "k", hot_rows=50, share=20)
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("bal"))


@frame("join_smj_to_shj", "select o_orderstatus, count(*) as n from orders join lineitem on o_orderkey = l_orderkey group by o_orderstatus", "join.rewrite")
def join_smj_to_shj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rewrite of sort-merge to shuffled hash joins, asked for by hint."""
    o, l = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return l.join(o.hint("shuffle_hash"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


