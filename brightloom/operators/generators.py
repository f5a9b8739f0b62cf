"""Generators: explode, posexplode, inline, stack, json_tuple."""

from __future__ import annotations

from ..registry import sql

sql("gen_explode", "select s_suppkey, explode(split(s_name, '#')) as piece from supplier", "select s_suppkey, unnest(string_split(s_name, '#')) as piece from supplier", covers="generate.explode fn.explode")
sql("gen_explode_outer", "select n_nationkey, explode_outer(case when n_regionkey = 1 then array() when n_regionkey = 2 then null else array(n_nationkey, n_regionkey) end) as v from nation",
    "select n_nationkey, unnest([n_nationkey, n_regionkey]) as v from nation where n_regionkey not in (1, 2) union all select n_nationkey, null from nation where n_regionkey in (1, 2)", covers="generate.explode_outer fn.explode_outer")
sql("gen_posexplode", "select vec_id, pos, round(col, 5) as x from (select vec_id, posexplode(embedding) from embeddings) t",
    "select vec_id, cast(generate_subscripts(embedding, 1) - 1 as int) as pos, round(unnest(embedding), 5) as x from embeddings", covers="generate.posexplode fn.posexplode")
sql("gen_posexplode_outer", "select k, pos, col from (select 1 as k, array('a', 'b') as a union all select 2, null) t lateral view posexplode_outer(a) as pos, col", "select * from (values (1, 0, 'a'), (1, 1, 'b'), (2, null, null)) t(k, pos, col)", covers="generate.posexplode_outer fn.posexplode_outer generate.lateral_view")
sql("gen_inline", "select r_regionkey, x, y from region lateral view inline(array(struct(r_regionkey as x, r_name as y), struct(r_regionkey + 10 as x, 'other' as y))) as x, y", "select r_regionkey, r_regionkey as x, r_name as y from region union all select r_regionkey, r_regionkey + 10, 'other' from region", covers="generate.inline fn.inline")
sql("gen_inline_outer", "select r_regionkey, x from region lateral view inline_outer(case when r_regionkey > 2 then array(struct(r_regionkey as x)) end) as x", "select r_regionkey, case when r_regionkey > 2 then r_regionkey end as x from region", covers="fn.inline_outer")
sql("gen_stack", "select s_suppkey, k, v from supplier lateral view stack(2, 'bal', s_acctbal, 'key', cast(s_suppkey as double)) as k, v", "select s_suppkey, 'bal' as k, s_acctbal as v from supplier union all select s_suppkey, 'key', cast(s_suppkey as double) from supplier", covers="generate.stack fn.stack")
sql("gen_json_tuple", "select event_id, k, missing from events lateral view json_tuple(props, 'k', 'zz') as k, missing", "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.zz') as missing from events", covers="generate.json_tuple fn.json_tuple")
sql("gen_explode_map", "select n_nationkey, key, value from nation lateral view explode(map('name', n_name, 'region', cast(n_regionkey as string))) as key, value", "select n_nationkey, 'name' as key, n_name as value from nation union all select n_nationkey, 'region', cast(n_regionkey as varchar) from nation", covers="generate.explode_map")
sql("gen_words", "select w, count(*) as n from (select explode(split(lower(p_name), ' ')) as w from part) t group by w", "select w, count(*) as n from (select unnest(string_split(lower(p_name), ' ')) as w from part) t group by w", covers="generate.explode")
sql("gen_sequence", "select n_nationkey, explode(sequence(0, n_regionkey)) as i from nation", "select n_nationkey, cast(unnest(range(0, n_regionkey + 1)) as int) as i from nation", covers="fn.sequence")
