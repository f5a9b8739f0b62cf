"""Dates, times, timestamps, intervals and time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..registry import frame, sql
from .cases import case, fn

I = "cast({} as int)".format  # noqa: E741
D = "o_orderdate"
case("fn_date_fields", "orders", "o_orderkey", *[(f, f"{f}({D})", I(f"{f}({D})")) for f in "year quarter month day dayofmonth dayofyear weekofyear hour minute second".split()], ("dow", f"dayofweek({D})", I(f"dayofweek({D}) + 1")), ("wd", f"weekday({D})", I(f"(dayofweek({D}) + 6) % 7")), ("ex", f"extract(doy from {D})", I(f"extract(doy from {D})")), ("dp", f"date_part('month', {D})", I(f"date_part('month', {D})")), ("dq", f"datepart('year', {D})", I(f"date_part('year', {D})")), ("dn", f"dayname({D})", f"substring(dayname({D}), 1, 3)"), ("mn", f"monthname({D})", f"substring(monthname({D}), 1, 3)"), covers=fn("year quarter month day dayofmonth dayofyear weekofyear hour minute second dayofweek weekday extract date_part datepart dayname monthname"))
case("fn_date_arithmetic", "orders", "o_orderkey", ("a", f"date_add({D}, 10)", f"cast({D} as date) + 10"), ("b", f"date_sub({D}, 10)", f"cast({D} as date) - 10"), ("c", f"datediff({D}, date '1995-01-01')", I(f"date_diff('day', date '1995-01-01', cast({D} as date))")), ("d", f"date_diff({D}, date '1995-01-01')", I(f"date_diff('day', date '1995-01-01', cast({D} as date))")), ("e", f"add_months({D}, 2)", f"cast(cast({D} as date) + interval '2' month as date)"), ("f", f"last_day({D})", f"last_day({D})"), ("g", f"cast(dateadd(day, 3, cast({D} as date)) as date)", f"cast({D} as date) + 3"), ("h", f"cast(timestampadd(hour, 5, {D}) as timestamp_ntz)", f"{D} + interval '5' hour"), ("i", f"timestampdiff(day, timestamp_ntz '1995-01-01 00:00:00', {D})", f"date_diff('day', timestamp '1995-01-01 00:00:00', {D})"), ("j", f"timediff(month, timestamp_ntz '1995-01-01 00:00:00', {D})", f"date_sub('month', timestamp '1995-01-01 00:00:00', {D})"), ("k", f"{D} + interval '1' day"), covers=fn("date_add date_sub datediff date_diff add_months last_day dateadd timestampadd timestampdiff timediff"))
case("fn_date_trunc", "orders", "o_orderkey", ("a", f"trunc({D}, 'month')", f"cast(date_trunc('month', {D}) as date)"), ("b", f"cast(date_trunc('year', {D}) as timestamp_ntz)", f"cast(date_trunc('year', {D}) as timestamp)"), ("c", f"next_day({D}, 'Mon')", f"cast(cast({D} as date) + cast(7 - (dayofweek({D}) + 6) % 7 as int) as date)"), ("d", f"round(months_between({D}, timestamp_ntz '1995-01-01 00:00:00'), 4)", f"round((year({D}) - 1995) * 12 + (month({D}) - 1) + case when {D} = last_day({D}) and false then 0 else (day({D}) - 1) / 31.0 end, 4)"), covers=fn("trunc date_trunc next_day months_between"))
case("fn_date_format", "orders", "o_orderkey", ("a", f"date_format({D}, 'yyyy/MM/dd')", f"strftime({D}, '%Y/%m/%d')"), ("b", f"to_date(date_format({D}, 'yyyyMMdd'), 'yyyyMMdd')", f"cast({D} as date)"), ("c", f"to_timestamp_ntz(date_format({D}, 'yyyy-MM-dd HH:mm:ss'))", D), ("d", f"try_to_date('nope', 'yyyy')", "cast(null as date)"), ("e", f"cast(to_timestamp(date_format({D}, 'dd-MM-yyyy'), 'dd-MM-yyyy') as timestamp_ntz)", f"date_trunc('day', {D})"), ("f", "cast(try_to_timestamp('bad') as timestamp_ntz)", "cast(null as timestamp)"), covers=fn("date_format to_date to_timestamp_ntz try_to_date to_timestamp try_to_timestamp"))
case("fn_date_epoch", "orders", "o_orderkey", ("a", f"unix_date(cast({D} as date))", I(f"date_diff('day', date '1970-01-01', cast({D} as date))")), ("b", f"date_from_unix_date(unix_date(cast({D} as date)))", f"cast({D} as date)"), ("c", f"unix_timestamp({D})", f"cast(epoch({D}) as bigint)"), ("d", f"to_unix_timestamp({D})", f"cast(epoch({D}) as bigint)"), ("e", f"unix_seconds(cast({D} as timestamp))", f"cast(epoch({D}) as bigint)"), ("f", f"unix_millis(cast({D} as timestamp))", f"epoch_ms({D})"), ("g", f"unix_micros(cast({D} as timestamp))", f"epoch_us({D})"), ("h", "cast(timestamp_seconds(o_orderkey) as timestamp_ntz)", "timestamp '1970-01-01 00:00:00' + to_seconds(o_orderkey)"), ("i", "cast(timestamp_millis(o_orderkey) as timestamp_ntz)", "timestamp '1970-01-01 00:00:00' + to_milliseconds(o_orderkey)"), ("j", "cast(timestamp_micros(o_orderkey) as timestamp_ntz)", "timestamp '1970-01-01 00:00:00' + to_microseconds(o_orderkey)"), ("k", "from_unixtime(o_orderkey)", "strftime(timestamp '1970-01-01 00:00:00' + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S')"), covers=fn("unix_date date_from_unix_date unix_timestamp to_unix_timestamp unix_seconds unix_millis unix_micros timestamp_seconds timestamp_millis timestamp_micros from_unixtime"))
case("fn_date_make", "nation", "n_nationkey", ("a", "make_date(2024, 1, n_nationkey + 1)", "make_date(2024, 1, cast(n_nationkey + 1 as int))"), ("b", "make_timestamp_ntz(2024, 2, 3, n_nationkey % 24, 5, 6)", "make_timestamp(2024, 2, 3, cast(n_nationkey % 24 as int), 5, 6)"), ("c", "cast(make_timestamp(2024, 2, 3, 4, 5, 6) as timestamp_ntz)", "timestamp '2024-02-03 04:05:06'"), ("d", "cast(make_timestamp_ltz(2024, 2, 3, 4, 5, 6) as timestamp_ntz)", "timestamp '2024-02-03 04:05:06'"), ("e", "cast(try_make_timestamp(2024, 13, 1, 0, 0, 0) as timestamp_ntz)", "cast(null as timestamp)"), ("f", "date '2024-01-31' + make_ym_interval(0, 1)", "date '2024-02-29'"), ("g", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(1, 2, 3, 4)", "timestamp '2024-01-02 02:03:04'"), ("h", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(1, 1)", "timestamp '2025-02-01 00:00:00'"), ("i", "try_make_interval(2147483647) is null", "true"), ("j", "cast(to_timestamp_ltz('2024-01-01 00:00:00') as timestamp_ntz)", "timestamp '2024-01-01 00:00:00'"), covers=fn("make_date make_timestamp_ntz make_timestamp make_timestamp_ltz try_make_timestamp make_ym_interval make_dt_interval make_interval try_make_interval to_timestamp_ltz"))
case("fn_time_zones", "", "", ("a", "cast(from_utc_timestamp(timestamp '2024-07-01 12:00:00', 'America/New_York') as timestamp_ntz)", "timestamp '2024-07-01 08:00:00'"), ("b", "cast(to_utc_timestamp(timestamp '2024-01-01 12:00:00', 'Asia/Tokyo') as timestamp_ntz)", "timestamp '2024-01-01 03:00:00'"), ("c", "convert_timezone('UTC', 'Europe/Paris', timestamp_ntz '2024-07-01 00:00:00')", "timestamp '2024-07-01 02:00:00'"), ("d", "current_timezone() in ('UTC', 'Etc/UTC')", "true"), ("e", "current_date() = curdate() and cast(now() as date) >= date '2024-01-01' and current_timestamp() is not null and localtimestamp() is not null", "true"), covers=fn("from_utc_timestamp to_utc_timestamp convert_timezone current_timezone current_date curdate now current_timestamp localtimestamp"))
_TIME = (
    ("a", "cast(make_time(1, 2, 3.5) as string)", "'01:02:03.5'"), ("b", "cast(to_time('10:20:30') as string)", "'10:20:30'"), ("c", "try_to_time('x') is null", "true"), ("d", "cast(time_trunc('hour', time '10:20:30') as string)", "'10:00:00'"), ("e", "time_diff('minute', time '10:00:00', time '11:30:00')", "cast(90 as bigint)"), ("f", "current_time() is not null", "true"),
)


@frame("fn_time_type", "select " + ", ".join(f"{o} as {a}" for a, _, o in _TIME), fn("make_time to_time try_to_time time_trunc time_diff current_time"))
def time_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TIME values; the type is off by default."""
    spark.conf.set("spark.sql.timeType.enabled", "true")
    return spark.sql("select " + ", ".join(f"{s} as {a}" for a, s, _ in _TIME))


sql("tw_tumbling", "select cast(window.start as timestamp_ntz) as day, event_type, count(*) as n from events group by window(ts, '1 day'), event_type", "select time_bucket(interval '1 day', ts) as day, event_type, count(*) as n from events group by 1, 2", covers=fn("window") + " time_window.tumbling")
sql("tw_sliding", "select cast(window.start as timestamp_ntz) as start, count(*) as n from events group by window(ts, '2 hours', '1 hour')",
    "select s as start, count(*) as n from (select unnest([time_bucket(interval '1 hour', ts), time_bucket(interval '1 hour', ts) - interval '1 hour']) as s from events) t group by s", covers="time_window.sliding")
sql("tw_session", "select user_id, count(*) as sessions from (select user_id, session_window(ts, '2 hours') as w from events group by user_id, session_window(ts, '2 hours')) t group by user_id",
    "select user_id, cast(sum(new) as bigint) as sessions from (select user_id, case when lag(ts) over w is null or ts - lag(ts) over w >= interval '2' hour then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)) t group by user_id", covers=fn("session_window") + " time_window.session")
sql("tw_window_time", "select cast(window_time(w) as timestamp_ntz) as t, n from (select window(ts, '7 days') as w, count(*) as n from events group by window(ts, '7 days')) x",
    "select time_bucket(interval '7 days', ts, timestamp '1970-01-01') + interval '7 days' - interval '1 microsecond' as t, count(*) as n from events group by 1", covers=fn("window_time"))
