"""Session values, row ids, variants, assertions and metadata."""

from __future__ import annotations

from ..registry import sql
from .cases import case, fn

case("fn_session", "", "", ("a", "current_catalog()", "'spark_catalog'"), ("b", "current_database()", "'default'"), ("c", "current_schema()", "'default'"), ("d", "current_user() = user() and user() = session_user()", "true"), ("e", "assert_true(1 < 2) is null", "true"), covers=fn("current_catalog current_database current_schema current_user user session_user assert_true"))
sql("fn_row_ids", "select count(distinct id) = count(*) as distinct_ids, min(p) >= 0 as parts from (select monotonically_increasing_id() as id, spark_partition_id() as p from orders) t", "select true as distinct_ids, true as parts", covers=fn("monotonically_increasing_id spark_partition_id"))
case("fn_variant", "events", "event_id", ("a", "variant_get(parse_json(props), '$.k', 'int')", "cast(json_extract_string(props, '$.k') as int)"), ("b", "try_parse_json('{bad') is null", "true"), ("c", "schema_of_variant(parse_json('{\"a\": 1}'))", "'OBJECT<a: BIGINT>'"), ("d", "is_variant_null(parse_json('null'))", "true"), ("e", "to_json(to_variant_object(named_struct('a', 1)))", "'{\"a\":1}'"), ("f", "try_variant_get(parse_json('{\"a\": \"x\"}'), '$.a', 'int') is null", "true"), covers=fn("variant_get parse_json try_parse_json schema_of_variant is_variant_null to_variant_object try_variant_get"))
sql("fn_variant_schema", "select schema_of_variant_agg(parse_json(props)) as s from events", "select 'OBJECT<k: BIGINT>' as s", covers=fn("schema_of_variant_agg"))
sql("fn_raise_error", "select coalesce(try_cast(o_orderstatus as int), -1) as v, if(o_orderkey < 0, raise_error('negative key'), o_orderkey) as k from orders", "select -1 as v, o_orderkey as k from orders", covers=fn("raise_error"))
case("fn_interval_multiply", "nation", "n_nationkey", ("a", "timestamp_ntz '2024-01-01 00:00:00' + interval '1' day * n_nationkey", "timestamp '2024-01-01 00:00:00' + to_days(n_nationkey)"), ("b", "timestamp_ntz '2024-01-01 00:00:00' + interval '90' minute", "timestamp '2024-01-01 01:30:00'"), ("c", "date '2024-03-31' - interval '1' month", "date '2024-02-29'"), covers="types.interval expr.MultiplyDTInterval")
case("fn_nested_fields", "nation", "n_nationkey", ("a", "array_join(array(struct(n_name as f), struct('x' as f)).f, ',')", "n_name || ',x'"), ("b", "map(1, struct(n_regionkey as r))[1].r", "n_regionkey"), covers="expr.GetArrayStructFields expr.GetStructField expr.GetMapValue")
sql("agg_map_keys", "select count(*) as groups_ from (select m, count(*) as n from (select map('r', n_regionkey) as m from nation) t group by m) u", "select count(distinct n_regionkey) as groups_ from nation", covers="expr.MapSort aggregate.map_keys")
sql("agg_average", "select o_orderstatus, round(avg(o_custkey), 6) as a from orders group by o_orderstatus", covers=fn("avg"))
