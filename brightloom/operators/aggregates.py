"""Aggregates: grouping sets, FILTER, DISTINCT, statistics, percentiles, sketches and collections."""

from __future__ import annotations

from ..registry import sql

sql("agg_group_by_multi", "select o_orderstatus, o_orderpriority, count(*) as n, min(o_totalprice) as lo, max(o_totalprice) as hi from orders group by o_orderstatus, o_orderpriority", covers="hash_aggregate fn.min fn.max fn.count")
sql("agg_empty_input", "select count(*) as n, cast(sum(o_custkey) as bigint) as s, max(o_orderdate) as m from orders where o_orderkey < 0", covers="aggregate.empty")
sql("agg_filter_clause", "select o_orderstatus, count(*) filter (where o_totalprice > 200000) as big, cast(sum(o_custkey) filter (where o_orderpriority = '1-URGENT') as bigint) as urgent from orders group by o_orderstatus", covers="aggregate.filter")
sql("agg_distinct", "select o_orderstatus, count(distinct o_custkey) as customers, cast(sum(distinct o_custkey % 100) as bigint) as s from orders group by o_orderstatus", covers="aggregate.distinct fn.sum_distinct")
sql("agg_distinct_multi", "select l_returnflag, count(distinct l_suppkey, l_linestatus) as pairs, count(distinct l_partkey) as parts from lineitem group by l_returnflag",
    "select l_returnflag, count(distinct (l_suppkey, l_linestatus)) as pairs, count(distinct l_partkey) as parts from lineitem group by l_returnflag", covers="aggregate.distinct_multi expand")
sql("agg_rollup", "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderpriority) as int) as g from orders group by rollup (o_orderstatus, o_orderpriority)", covers="expand.rollup fn.grouping")
sql("agg_cube", "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping_id(o_orderstatus, o_orderpriority) as bigint) as gid from orders group by cube (o_orderstatus, o_orderpriority)",
    "select o_orderstatus, o_orderpriority, count(*) as n, cast(grouping(o_orderstatus, o_orderpriority) as bigint) as gid from orders group by cube (o_orderstatus, o_orderpriority)", covers="expand.cube fn.grouping_id")
sql("agg_grouping_sets", "select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())", covers="expand.grouping_sets")
sql("agg_statistics", "select l_returnflag, round(stddev(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sdp, round(stddev_samp(l_quantity), 6) as sds, round(variance(l_quantity), 6) as v, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs from lineitem group by l_returnflag",
    covers="fn.stddev fn.stddev_pop fn.stddev_samp fn.variance fn.var_pop fn.var_samp")
sql("agg_std_mean", "select l_returnflag, round(std(l_quantity), 6) as sd, round(mean(l_quantity), 6) as m, round(try_avg(l_quantity), 6) as ta, cast(try_sum(l_partkey) as bigint) as ts from lineitem group by l_returnflag",
    "select l_returnflag, round(stddev(l_quantity), 6) as sd, round(avg(l_quantity), 6) as m, round(avg(l_quantity), 6) as ta, cast(sum(l_partkey) as bigint) as ts from lineitem group by l_returnflag", covers="fn.std fn.mean fn.try_avg fn.try_sum")
sql("agg_corr_covar", "select l_returnflag, round(corr(l_quantity, l_extendedprice), 8) as c, round(covar_pop(l_quantity, l_discount), 8) as cp, round(covar_samp(l_quantity, l_discount), 8) as cs from lineitem group by l_returnflag", covers="fn.corr fn.covar_pop fn.covar_samp")
_REGRESSION = """select l_returnflag, regr_count(l_extendedprice, l_quantity) as n, round(regr_avgx(l_extendedprice, l_quantity), 4) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay, round(regr_slope(l_extendedprice, l_quantity), 4) as sl,
 round(regr_intercept(l_extendedprice, l_quantity), 3) as ic, round(regr_r2(l_extendedprice, l_quantity), 8) as r2, round(regr_sxx(l_extendedprice, l_quantity), 2) as sxx, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 2) as sxy, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 2) as syy
 from lineitem group by l_returnflag"""
sql("agg_regression", _REGRESSION, _REGRESSION.replace("regr_count(l_extendedprice, l_quantity)", "cast(regr_count(l_extendedprice, l_quantity) as bigint)"), covers="fn.regr_count fn.regr_avgx fn.regr_avgy fn.regr_slope fn.regr_intercept fn.regr_r2 fn.regr_sxx fn.regr_sxy fn.regr_syy")
sql("agg_moments", "select l_returnflag, round(skewness(l_extendedprice), 5) as sk, round(kurtosis(l_extendedprice), 5) as ku from lineitem group by l_returnflag",
    "select l_returnflag, round(sum(power(x - m, 3)) / count(*) / power(sum(power(x - m, 2)) / count(*), 1.5), 5) as sk, round(sum(power(x - m, 4)) / count(*) / power(sum(power(x - m, 2)) / count(*), 2) - 3, 5) as ku from (select l_returnflag, l_extendedprice as x, avg(l_extendedprice) over (partition by l_returnflag) as m from lineitem) t group by l_returnflag",
    covers="fn.skewness fn.kurtosis")
sql("agg_bitwise", "select o_orderstatus, bit_and(o_orderkey) as a, bit_or(o_orderkey) as o, bit_xor(o_orderkey) as x from orders group by o_orderstatus", covers="fn.bit_and fn.bit_or fn.bit_xor")
sql("agg_boolean", "select o_orderstatus, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 450000) as o, every(o_totalprice > 1000) as e, some(o_totalprice > 450000) as s, any(o_totalprice > 450000) as y, count_if(o_totalprice > 200000) as n from orders group by o_orderstatus",
    "select o_orderstatus, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 450000) as o, bool_and(o_totalprice > 1000) as e, bool_or(o_totalprice > 450000) as s, bool_or(o_totalprice > 450000) as y, cast(count_if(o_totalprice > 200000) as bigint) as n from orders group by o_orderstatus",
    covers="fn.bool_and fn.bool_or fn.every fn.some fn.any fn.count_if")
sql("agg_percentiles", "select l_returnflag, percentile(l_quantity, 0.25) as p25, median(l_quantity) as med, percentile_cont(0.9) within group (order by l_quantity) as p90, percentile_disc(0.5) within group (order by l_quantity) as d50 from lineitem group by l_returnflag",
    "select l_returnflag, quantile_cont(l_quantity, 0.25) as p25, median(l_quantity) as med, quantile_cont(l_quantity, 0.9) as p90, quantile_disc(l_quantity, 0.5) as d50 from lineitem group by l_returnflag", covers="fn.percentile fn.median fn.percentile_cont fn.percentile_disc")
sql("agg_approx", """select abs(approx_count_distinct(l_partkey) - count(distinct l_partkey)) <= 0.1 * count(distinct l_partkey) as distinct_near,
 abs(approx_percentile(l_quantity, 0.5, 1000) - percentile(l_quantity, 0.5)) <= 1 as median_near from lineitem""", "select true as distinct_near, true as median_near", covers="fn.approx_count_distinct fn.approx_percentile")
sql("agg_first_last", "select o_custkey, min_by(o_orderkey, struct(o_totalprice, o_orderkey)) as cheapest, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) as dearest from orders group by o_custkey",
    "select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as dearest from orders group by o_custkey", covers="fn.min_by fn.max_by")
sql("agg_first_any", "select o_orderstatus, first(s) as f, last(s) as l, any_value(s) as a, first_value(s) as fv, last_value(s) as lv from (select o_orderstatus, length(o_orderstatus) as s from orders) t group by o_orderstatus",
    "select o_orderstatus, cast(1 as int) as f, cast(1 as int) as l, cast(1 as int) as a, cast(1 as int) as fv, cast(1 as int) as lv from orders group by o_orderstatus", covers="fn.first fn.last fn.any_value fn.first_value fn.last_value")
sql("agg_collect", "select o_custkey, array_join(transform(sort_array(collect_list(o_orderkey)), x -> cast(x as string)), ',') as orders_, array_join(sort_array(collect_set(o_orderstatus)), '') as statuses, size(array_agg(o_orderkey)) as n from orders group by o_custkey",
    "select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') as orders_, array_to_string(list_sort(list(distinct o_orderstatus)), '') as statuses, cast(len(list(o_orderkey)) as int) as n from orders group by o_custkey", covers="fn.collect_list fn.collect_set fn.array_agg object_hash_aggregate")
sql("agg_listagg", "select c_nationkey, listagg(distinct c_mktsegment, '|') within group (order by c_mktsegment) as segments from customer group by c_nationkey",
    "select c_nationkey, string_agg(distinct c_mktsegment, '|' order by c_mktsegment) as segments from customer group by c_nationkey", covers="fn.listagg")
sql("agg_string_agg", "select n_regionkey, string_agg(n_name, ',') within group (order by n_nationkey) as names from nation group by n_regionkey",
    "select n_regionkey, string_agg(n_name, ',' order by n_nationkey) as names from nation group by n_regionkey", covers="fn.string_agg")
sql("agg_mode", "select p_brand, mode(p_size) is not null as has from part group by p_brand", "select p_brand, true as has from part group by p_brand", covers="fn.mode")
sql("agg_mode_unique", "select mode(x) as m from (select case when o_orderkey % 3 = 0 then 'a' else 'b' end as x from orders) t", covers="fn.mode")
sql("agg_decimal", "select o_orderstatus, cast(sum(cast(o_totalprice as decimal(15,2))) as decimal(25,2)) as total, cast(max(cast(o_totalprice as decimal(15,2))) as decimal(15,2)) as top from orders group by o_orderstatus", covers="types.decimal")
sql("agg_expression_keys", "select year(o_orderdate) as y, cast(count(*) as bigint) as n, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as f from orders group by year(o_orderdate)",
    "select cast(year(o_orderdate) as int) as y, count(*) as n, cast(sum(case when o_orderstatus = 'F' then 1 else 0 end) as bigint) as f from orders group by 1", covers="aggregate.expression")
sql("agg_null_groups", "select nullif(c_nationkey, 4) as k, count(*) as n, count(nullif(c_mktsegment, 'BUILDING')) as nonnull from customer group by nullif(c_nationkey, 4)", covers="aggregate.null_keys")
sql("agg_histogram", "select width_bucket(o_totalprice, 0, 500000, 10) as b, count(*) as n from orders group by 1", "select cast(case when o_totalprice < 0 then 0 when o_totalprice >= 500000 then 11 else floor(o_totalprice / 50000) + 1 end as bigint) as b, count(*) as n from orders group by 1", covers="fn.width_bucket")
