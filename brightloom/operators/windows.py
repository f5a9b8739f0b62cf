"""Window functions and frames."""

from __future__ import annotations

from ..registry import sql

_ORDER = "partition by o_custkey order by o_orderdate, o_orderkey"
sql("win_rank_family", "select c_custkey, row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey) as rn, rank() over (partition by c_nationkey order by c_mktsegment) as rk, dense_rank() over (partition by c_nationkey order by c_mktsegment) as dr, round(percent_rank() over (partition by c_nationkey order by c_mktsegment), 8) as pr, round(cume_dist() over (partition by c_nationkey order by c_mktsegment), 8) as cd from customer",
    "select c_custkey, cast(row_number() over (partition by c_nationkey order by c_mktsegment, c_custkey) as int) as rn, cast(rank() over (partition by c_nationkey order by c_mktsegment) as int) as rk, cast(dense_rank() over (partition by c_nationkey order by c_mktsegment) as int) as dr, round(percent_rank() over (partition by c_nationkey order by c_mktsegment), 8) as pr, round(cume_dist() over (partition by c_nationkey order by c_mktsegment), 8) as cd from customer",
    covers="fn.row_number fn.rank fn.dense_rank fn.percent_rank fn.cume_dist window")
sql("win_ntile", f"select o_orderkey, ntile(4) over ({_ORDER}) as q from orders", f"select o_orderkey, cast(ntile(4) over ({_ORDER}) as int) as q from orders", covers="fn.ntile")
sql("win_lag_lead", f"select o_orderkey, lag(o_totalprice) over ({_ORDER}) as prev, lead(o_totalprice, 2, cast(-1 as double)) over ({_ORDER}) as next2 from orders", covers="fn.lag fn.lead")
sql("win_lag_ignore_nulls", f"select o_orderkey, lag(nullif(o_orderstatus, 'O')) ignore nulls over ({_ORDER}) as prev from orders", f"select o_orderkey, lag(nullif(o_orderstatus, 'O') ignore nulls) over ({_ORDER}) as prev from orders", covers="fn.lag.ignore_nulls")
sql("win_first_last", f"select o_orderkey, first_value(nullif(o_orderstatus, 'F')) ignore nulls over ({_ORDER} rows between unbounded preceding and current row) as f, last_value(o_totalprice) over ({_ORDER} rows between current row and unbounded following) as l from orders",
    f"select o_orderkey, first_value(nullif(o_orderstatus, 'F') ignore nulls) over ({_ORDER} rows between unbounded preceding and current row) as f, last_value(o_totalprice) over ({_ORDER} rows between current row and unbounded following) as l from orders", covers="fn.first_value fn.last_value window.ignore_nulls")
sql("win_nth_value", f"select o_orderkey, nth_value(o_totalprice, 2) over ({_ORDER} rows between unbounded preceding and unbounded following) as second from orders", covers="fn.nth_value")
sql("win_running", f"select o_orderkey, cast(sum(o_custkey) over ({_ORDER} rows between unbounded preceding and current row) as bigint) as s, count(*) over ({_ORDER}) as n, min(o_totalprice) over ({_ORDER}) as lo, max(o_totalprice) over ({_ORDER}) as hi from orders", covers="window.rows fn.sum fn.count")
sql("win_sliding", f"select o_orderkey, round(avg(o_totalprice) over ({_ORDER} rows between 2 preceding and 2 following), 4) as a, count(*) over ({_ORDER} rows between 3 preceding and 1 preceding) as n from orders", covers="window.rows_sliding")
sql("win_range_numeric", "select p_partkey, count(*) over (partition by p_type order by p_size range between 5 preceding and 5 following) as near from part", covers="window.range")
sql("win_range_interval", "select event_id, count(*) over (partition by user_id order by ts range between interval '1' day preceding and current row) as day from events", covers="window.range_interval")
sql("win_range_date", "select o_orderkey, count(*) over (partition by o_custkey order by cast(o_orderdate as date) range between interval '90' day preceding and current row) as quarter from orders", covers="window.range_date")
sql("win_statistics", "select o_orderkey, round(stddev(o_totalprice) over (partition by o_custkey), 4) as sd, round(corr(o_totalprice, o_orderkey) over (partition by o_orderstatus), 6) as c from orders", covers="window.statistics")
sql("win_share_of_total", "select c_custkey, round(c_acctbal / sum(c_acctbal) over (partition by c_nationkey), 8) as share, count(*) over () as n from customer where c_acctbal > 0", covers="window.unpartitioned")
sql("win_topk_per_group", "select o_custkey, o_orderkey, rk from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as rk from orders) t where rk <= 3",
    "select o_custkey, o_orderkey, cast(rk as int) as rk from (select o_custkey, o_orderkey, rank() over (partition by o_custkey order by o_totalprice desc) as rk from orders) t where rk <= 3", covers="window_group_limit")
sql("win_collect", "select o_orderkey, array_join(collect_list(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), '') as last3 from orders",
    "select o_orderkey, array_to_string(list(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey rows between 2 preceding and current row), '') as last3 from orders", covers="window.collect")
sql("win_named", "select n_name, rank() over w as r, count(*) over w as n from nation window w as (partition by n_regionkey order by n_name)", "select n_name, cast(rank() over w as int) as r, count(*) over w as n from nation window w as (partition by n_regionkey order by n_name)", covers="window.named")
sql("win_gaps_islands", "select user_id, count(*) as n, min(event_id) as first_event from (select user_id, event_id, event_id - row_number() over (partition by user_id order by event_id) as island from events) t group by user_id, island having count(*) > 1", covers="window.gaps_and_islands")
sql("win_sessionize", "select user_id, cast(sum(new) as bigint) as sessions from (select user_id, case when lag(ts) over (partition by user_id order by ts, event_id) is null or ts - lag(ts) over (partition by user_id order by ts, event_id) >= interval '2' hour then 1 else 0 end as new from events) t group by user_id", covers="sessionization")
