"""Arrays, maps, structs and higher-order functions."""

from __future__ import annotations

from .cases import case, fn

A = "array(n_regionkey, n_nationkey, 3)"
L = "[n_regionkey, n_nationkey, 3]"
J = lambda e: f"array_join({e}, ',')"
K = lambda e: f"array_to_string({e}, ',')"
I = "cast({} as int)".format  # noqa: E741

case("fn_array_build", "nation", "n_nationkey", ("a", J(A), K(L)), ("b", J("sequence(1, n_regionkey + 1)"), K("range(1, n_regionkey + 2)")), ("c", J("array_repeat(n_regionkey, 3)"), K("[n_regionkey, n_regionkey, n_regionkey]")), ("d", J(f"array_append({A}, 9)"), K(f"list_append({L}, 9)")), ("e", J(f"array_prepend({A}, 9)"), K(f"list_prepend(9, {L})")), ("f", J(f"array_insert({A}, 2, 7)"), K("[n_regionkey, 7, n_nationkey, 3]")), ("g", J("flatten(array(array(1, n_regionkey), array(5)))"), K("[1, n_regionkey, 5]")), ("h", J("slice(sequence(1, 9), 2, 3)"), K("[2, 3, 4]")), ("i", J(f"concat({A}, array(8))"), K(f"list_concat({L}, [8])")), covers=fn("array sequence array_repeat array_append array_prepend array_insert flatten slice concat array_join"))
case("fn_array_inspect", "nation", "n_nationkey", ("a", f"size({A})", "3"), ("b", f"cardinality({A})", "3"), ("c", f"array_size({A})", "3"), ("d", f"array_contains({A}, 3)", "true"), ("e", f"array_position({A}, n_nationkey)", f"cast(list_position({L}, n_nationkey) as bigint)"), ("f", f"array_max({A})", f"list_max({L})"), ("g", f"array_min({A})", f"list_min({L})"), ("h", f"element_at({A}, -1)", "3"), ("i", f"get({A}, 0)", "n_regionkey"), ("j", f"try_element_at({A}, 7)", "cast(null as int)"), ("k", f"{A}[1]", "n_nationkey"), ("l", f"arrays_overlap({A}, array(24, 4))", f"list_has_any({L}, [24, 4])"), covers=fn("size cardinality array_size array_contains array_position array_max array_min element_at get try_element_at arrays_overlap"))
case("fn_array_sets", "nation", "n_nationkey", ("a", J(f"sort_array(array_distinct({A}))"), K(f"list_sort(list_distinct({L}))")), ("b", J(f"sort_array(array_union({A}, array(1, 50)))"), K(f"list_sort(list_distinct(list_concat({L}, [1, 50])))")), ("c", J(f"sort_array(array_intersect({A}, array(3, 4)))"), K(f"list_sort(list_distinct(list_filter({L}, lambda x: x in (3, 4))))")), ("d", J(f"sort_array(array_except({A}, array(3, 4)))"), K(f"list_sort(list_distinct(list_filter({L}, lambda x: x not in (3, 4))))")), ("e", J(f"array_remove({A}, 3)"), K(f"list_filter({L}, lambda x: x <> 3)")), ("f", J("array_compact(array(1, null, n_regionkey))"), K("[1, n_regionkey]")), ("g", J(f"sort_array({A}, false)"), K(f"list_reverse_sort({L})")), ("h", J(f"reverse({A})"), K(f"list_reverse({L})")), ("i", f"array_join(array(1, null, 2), '-', 'x')", "'1-x-2'"), ("j", f"size(shuffle({A}))", "3"), covers=fn("array_distinct array_union array_intersect array_except array_remove array_compact sort_array reverse shuffle"))
case("fn_lambdas", "nation", "n_nationkey", ("a", J(f"transform({A}, x -> x * 2)"), K(f"list_transform({L}, lambda x: x * 2)")), ("b", J(f"filter({A}, x -> x > 2)"), K(f"list_filter({L}, lambda x: x > 2)")), ("c", f"exists({A}, x -> x > 20)", f"len(list_filter({L}, lambda x: x > 20)) > 0"), ("d", f"forall({A}, x -> x < 20)", f"len(list_filter({L}, lambda x: x < 20)) = 3"), ("e", f"aggregate({A}, 0, (s, x) -> s + x)", "n_regionkey + n_nationkey + 3"), ("f", f"reduce({A}, 1, (s, x) -> s + x, s -> s * 10)", "(n_regionkey + n_nationkey + 4) * 10"), ("g", J(f"zip_with({A}, array(1, 2, 3), (x, y) -> x + y)"), K("[n_regionkey + 1, n_nationkey + 2, 6]")), ("h", J(f"transform({A}, (x, i) -> x + i)"), K("[n_regionkey, n_nationkey + 1, 5]")), ("i", J(f"array_sort({A}, (x, y) -> y - x)"), K(f"list_reverse_sort({L})")), ("j", f"arrays_zip({A}, array('p', 'q', 'r'))[2]['1']", "'r'"), covers=fn("transform filter exists forall aggregate reduce zip_with array_sort arrays_zip"))
M = "map('a', n_regionkey, 'b', n_nationkey)"
case("fn_maps", "nation", "n_nationkey", ("a", f"{M}['a']", "n_regionkey"), ("b", J(f"map_keys({M})"), "'a,b'"), ("c", J(f"map_values({M})"), K("[n_regionkey, n_nationkey]")), ("d", f"map_contains_key({M}, 'c')", "false"), ("e", f"element_at({M}, 'b')", "n_nationkey"), ("f", f"map_entries({M})[1].value", "n_nationkey"), ("g", "map_from_arrays(array('x', 'y'), array(n_nationkey, 2))['x']", "n_nationkey"), ("h", "map_from_entries(array(struct('k', n_nationkey)))['k']", "n_nationkey"), ("i", f"size(map_concat({M}, map('c', 1)))", "3"), ("j", "str_to_map('p:1,q:2')['q']", "'2'"), ("k", f"size(map_filter({M}, (k, v) -> v > 2))", I("(n_regionkey > 2)::int + (n_nationkey > 2)::int")), ("l", f"transform_values({M}, (k, v) -> v + 1)['a']", "n_regionkey + 1"), ("m", f"transform_keys({M}, (k, v) -> upper(k))['B']", "n_nationkey"), ("n", f"map_zip_with({M}, map('a', 10), (k, x, y) -> x + coalesce(y, 0))['a']", "n_regionkey + 10"), ("o", f"try_element_at({M}, 'zz')", "cast(null as int)"), covers=fn("map map_keys map_values map_contains_key element_at map_entries map_from_arrays map_from_entries map_concat str_to_map map_filter transform_values transform_keys map_zip_with try_element_at"))
case("fn_structs", "nation", "n_nationkey", ("a", "named_struct('x', n_nationkey, 'y', n_name).y", "n_name"), ("b", "struct(n_nationkey as p, n_regionkey as q).q", "n_regionkey"), ("c", "struct(1, 2) < struct(1, n_nationkey)", "2 < n_nationkey"), covers=fn("named_struct struct"))
case("fn_vectors", "embeddings", "vec_id", ("norm", "round(sqrt(aggregate(embedding, 0.0D, (s, x) -> s + cast(x as double) * x)), 4)", "round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x))), 4)"), ("dot", "round(aggregate(zip_with(embedding, reverse(embedding), (x, y) -> cast(x as double) * y), 0.0D, (s, x) -> s + x), 4)", "round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::double * p[2])), 4)"), covers="vector.dot")
