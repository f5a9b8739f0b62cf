"""Structured Streaming over the events table: windows, watermarks, deduplication, joins and custom state.

Each query reads the files as a stream until nothing is left and writes to Parquet with a checkpoint, so it ends by itself and
can be compared with the same question asked of the table at rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..registry import frame
from ..sources.files import scratch
from ..tables import load

WAIT_S = 300


def in_parts(parts: list[DataFrame]) -> DataFrame:
    """A stream of tables, one in each micro-batch, in their order."""
    spark, path = parts[0].sparkSession, scratch(parts[0].sparkSession)
    files = spark.sparkContext.defaultParallelism
    for part in parts:
        # files are taken in the order of their modification, as many as a part has
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(path)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table in the order of time, in three micro-batches or a few more."""
    events = load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = F.unix_seconds("ts")
    cuts = events.agg(F.percentile_approx(second, [0.33, 0.67])).first()[0] or [0, 0]
    return in_parts([events.where(part) for part in (second <= cuts[0], (second > cuts[0]) & (second <= cuts[1]), second > cuts[1])])


def drained(stream: DataFrame, mode: str = "append", batch: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs a stream over all that is available and reads back what it wrote."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession)
    writer = stream.writeStream.option("checkpointLocation", scratch(spark)).trigger(availableNow=True)
    if mode != "append" or batch:
        # complete and update results overwrite; the last batch stands
        keep = batch or (lambda df, i: df.write.mode("overwrite").parquet(out))
        query = writer.outputMode(mode).foreachBatch(keep).start()
    else:
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    if not query.awaitTermination(WAIT_S):
        query.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(stream.schema).parquet(out)


@frame("stream_tumbling", "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by 1, 2", "streaming.tumbling streaming.complete")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = event_stream(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(counted.select(F.col("window.start").alias("day"), "event_type", "n"), "complete").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n")


@frame("stream_sliding", "select s as start, count(*) as n from (select unnest([time_bucket(interval '6 hour', ts), time_bucket(interval '6 hour', ts) - interval '6 hour']) as s from events) t group by s", "streaming.sliding")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = event_stream(spark, sf_dir).groupBy(F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n"))
    return drained(counted.select(F.col("window.start").alias("start"), "n"), "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@frame("stream_watermark_append", "select day, n from (select time_bucket(interval '1 day', ts) as day, count(*) as n from events group by 1) t where day < (select time_bucket(interval '1 day', max(ts)) from events)", "streaming.watermark streaming.append")
def stream_watermark_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days come out once the watermark has passed them; the last one is still open."""
    counted = event_stream(spark, sf_dir).withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return drained(counted.select(F.col("window.start").alias("day"), "n")).select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@frame("stream_session", "select user_id, cast(sum(new) as bigint) as sessions from (select user_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '2' hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)) t group by user_id", "streaming.session_window")
def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = event_stream(spark, sf_dir).groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return drained(counted.select("user_id", "n"), "complete").groupBy("user_id").agg(F.count("*").alias("sessions"))


@frame("stream_dedup", "select distinct user_id, event_type from events", "streaming.dedup")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(event_stream(spark, sf_dir).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]))


@frame("stream_dedup_watermark", "select count(*) as n from events", "streaming.dedup_within_watermark")
def stream_dedup_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = event_stream(spark, sf_dir).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    return drained(once.select("event_id")).agg(F.count("*").alias("n"))


@frame("stream_static_join", "select event_id, c_mktsegment from events join customer on user_id = c_custkey", "streaming.static_join")
def stream_static_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return drained(event_stream(spark, sf_dir).join(c, F.col("user_id") == F.col("c_custkey")).select("event_id", "c_mktsegment"))


@frame("stream_stream_join", "select a.event_id as click, b.event_id as purchase from events a join events b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'purchase' and b.ts >= a.ts and b.ts <= a.ts + interval '1' hour", "streaming.stream_join")
def stream_stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = event_stream(spark, sf_dir).withWatermark("ts", "2 hours")
    a = events.where("event_type = 'click'").select(F.col("event_id").alias("click"), F.col("user_id").alias("u"), F.col("ts").alias("at"))
    b = events.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    return drained(a.join(b, F.expr("u = user_id and ts >= at and ts <= at + interval 1 hour")).select("click", "purchase"))


@frame("stream_state", "select user_id, count(*) as n, max(value) as top from events group by user_id", "streaming.state")
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A count and a maximum for each user, kept in custom state; the last update of each user stands."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, top = state.get if state.exists else (0, float("-inf"))
        for f in frames:
            n, top = n + len(f), max(top, float(f["value"].max()))
        state.update((n, top))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "top": [top]})

    rows = event_stream(spark, sf_dir).select("user_id", "value")
    kept = rows.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, top double", "n long, top double", "append", GroupStateTimeout.NoTimeout)
    return drained(kept).groupBy("user_id").agg(F.max("n").alias("n"), F.max("top").alias("top"))


@frame("stream_foreach_batch", "select event_type, count(*) as n from events group by event_type", "streaming.foreach_batch streaming.sink")
def stream_foreach_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch is appended under its number, so a repeated batch replaces itself: exactly once."""
    out = scratch(spark)
    stream = event_stream(spark, sf_dir)

    def keep(df: DataFrame, i: int) -> None:
        df.select("event_type").write.mode("overwrite").parquet(f"{out}/batch={i}")

    query = stream.writeStream.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).foreachBatch(keep).start()
    if not query.awaitTermination(WAIT_S):
        query.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema("event_type string, batch int").parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


_THIRD = "(select cast(floor(epoch(min(ts))) as bigint) + (cast(floor(epoch(max(ts))) as bigint) - cast(floor(epoch(min(ts))) as bigint)) // 3 from events)"


@frame("stream_late_data", f"select day, n from (select time_bucket(interval '1 day', ts) as day, count(*) as n from events where floor(epoch(ts)) > {_THIRD} group by 1) t where day < (select time_bucket(interval '1 day', max(ts)) from events)", "streaming.late_data")
def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first third of the time comes last, two batches behind the watermark: its rows are dropped."""
    events = load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    second = F.unix_seconds("ts")
    first, last = events.agg(F.min(second), F.max(second)).first()
    third = ((last or 0) - (first or 0)) // 3
    cut, later = (first or 0) + third, (first or 0) + 2 * third
    stream = in_parts([events.where((second > cut) & (second <= later)), events.where(second > later), events.where(second <= cut)])
    counted = stream.withWatermark("ts", "0 seconds").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"))
    return drained(counted.select(F.col("window.start").alias("day"), "n")).select(F.col("day").cast("timestamp_ntz").alias("day"), "n")


@frame("stream_update", "select event_type, count(*) as n from events group by event_type", "streaming.update")
def stream_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch writes the groups it changed; the last update of a group stands."""
    out = scratch(spark)

    def keep(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={i}")

    counted = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    query = counted.writeStream.option("checkpointLocation", scratch(spark)).trigger(availableNow=True).outputMode("update").foreachBatch(keep).start()
    if not query.awaitTermination(WAIT_S):
        query.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema("event_type string, n long, batch int").parquet(out).groupBy("event_type").agg(F.max_by("n", "batch").alias("n"))
