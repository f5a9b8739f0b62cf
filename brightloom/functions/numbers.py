"""Arithmetic, mathematics, bits, conditions and casts."""

from __future__ import annotations

from ..registry import sql
from .cases import case, fn

R = lambda e, k=8: f"round({e}, {k})"

case("fn_arithmetic", "orders", "o_orderkey", ("a", "o_orderkey + o_custkey"), ("b", "o_orderkey - o_custkey"), ("c", "o_orderkey * 3"), ("d", R("o_totalprice / 7")), ("e", "o_orderkey % 7"), ("f", "mod(o_orderkey, 5)", "o_orderkey % 5"), ("g", "(o_orderkey + 1) div 4", "(o_orderkey + 1) // 4"), ("h", "negative(o_orderkey)", "-o_orderkey"), ("i", "positive(o_orderkey)", "o_orderkey"), ("j", "pmod(-o_orderkey - 1, 7)", "((-o_orderkey - 1) % 7 + 7) % 7"), ("k", "abs(o_orderkey - 500)"), ("l", "cast(sign(o_orderkey - 500) as int)", "cast(sign(o_orderkey - 500) as int)"), ("m", "cast(signum(o_orderkey - 500.5) as int)", "cast(sign(o_orderkey - 500.5) as int)"), covers=fn("+ - * / % mod div negative positive pmod abs sign signum"))
case("fn_try_arithmetic", "nation", "n_nationkey", ("a", "try_add(2147483647, n_nationkey)", "case when n_nationkey = 0 then 2147483647 end"), ("b", "try_subtract(-2147483648, n_nationkey)", "case when n_nationkey = 0 then cast(-2147483648 as int) end"), ("c", "try_multiply(1073741824, n_nationkey)", "case when n_nationkey < 2 then cast(1073741824 * cast(n_nationkey as bigint) as int) end"), ("d", R("try_divide(10, n_nationkey)"), R("case when n_nationkey <> 0 then 10 / n_nationkey end")), ("e", "try_mod(10, n_nationkey)", "case when n_nationkey <> 0 then 10 % n_nationkey end"), covers=fn("try_add try_subtract try_multiply try_divide try_mod"))
case("fn_rounding", "orders", "o_orderkey", ("a", "round(o_totalprice, 1)"), ("b", "cast(bround(o_orderkey / 2.0D) as bigint)", "cast(round_even(o_orderkey / 2.0, 0) as bigint)"), ("c", "cast(floor(o_totalprice) as bigint)", "cast(floor(o_totalprice) as bigint)"), ("d", "cast(ceil(o_totalprice) as bigint)", "cast(ceil(o_totalprice) as bigint)"), ("e", "cast(ceiling(o_totalprice) as bigint)", "cast(ceil(o_totalprice) as bigint)"), ("f", "cast(rint(o_orderkey / 2.0D) as bigint)", "cast(round_even(o_orderkey / 2.0, 0) as bigint)"), ("g", "round(o_orderkey, -2)", "round(o_orderkey, -2)"), covers=fn("round bround floor ceil ceiling rint"))
X = "(p_size / 60.0D)"
Y = "(p_size / 60.0::double)"
case("fn_trigonometry", "part", "p_partkey", *[(f"f{i}", R(f"{f}({X})"), R(f"{f}({Y})")) for i, f in enumerate("sin cos tan asin acos atan sinh cosh tanh asinh atanh degrees radians cot exp sqrt cbrt".split())], ("acosh", R(f"acosh({X} + 1)"), R(f"acosh({Y} + 1)")), ("atan2", R(f"atan2({X}, 2)"), R(f"atan2({Y}, 2)")), ("sec", R(f"sec({X})"), R(f"1 / cos({Y})")), ("csc", R(f"csc({X})"), R(f"1 / sin({Y})")), ("hypot", R(f"hypot({X}, 2)"), R(f"sqrt({Y} * {Y} + 4)")), where="p_size > 0", covers=fn("sin cos tan asin acos atan sinh cosh tanh asinh acosh atanh degrees radians cot exp sqrt cbrt atan2 sec csc hypot"))
case("fn_logarithms", "part", "p_partkey", ("a", R("ln(p_retailprice)")), ("b", R("log10(p_retailprice)")), ("c", R("log2(p_retailprice)")), ("d", R("log(3, p_retailprice)"), R("ln(p_retailprice) / ln(3)")), ("e", R("log1p(p_size)"), R("ln(1 + p_size)")), ("f", R(f"expm1({X})"), R(f"exp({Y}) - 1")), ("g", R("power(p_size, 2)")), ("h", R("pow(p_size, 0.5)")), ("i", R("pi()")), ("j", R("e()"), R("exp(1)")), ("k", "factorial(p_size % 10)", "cast(factorial(cast(p_size % 10 as int)) as bigint)"), covers=fn("ln log10 log2 log log1p expm1 power pow pi e factorial"))
case("fn_extremes", "orders", "o_orderkey", ("a", "greatest(o_orderkey, o_custkey, 100)"), ("b", "least(o_orderkey, o_custkey, 100)"), ("c", "greatest(nullif(o_orderstatus, 'F'), 'G')"), covers=fn("greatest least"))
case("fn_bits", "orders", "o_orderkey", ("a", "o_orderkey & o_custkey"), ("b", "o_orderkey | o_custkey"), ("c", "o_orderkey ^ o_custkey", "xor(o_orderkey, o_custkey)"), ("d", "~o_orderkey"), ("e", "shiftleft(o_orderkey, 3)", "o_orderkey * 8"), ("f", "shiftright(o_orderkey, 2)", "o_orderkey >> 2"), ("g", "shiftrightunsigned(o_orderkey, 1)", "o_orderkey >> 1"), ("h", "o_orderkey << 2", "o_orderkey * 4"), ("i", "o_orderkey >> 1"), ("j", "o_orderkey >>> 1", "o_orderkey >> 1"), ("k", "bit_count(o_orderkey)", "cast(bit_count(o_orderkey) as int)"), ("l", "cast(bit_get(o_orderkey, 1) as int)", "cast((o_orderkey >> 1) & 1 as int)"), ("m", "cast(getbit(o_orderkey, 0) as int)", "cast(o_orderkey & 1 as int)"), covers=fn("& | ^ ~ shiftleft shiftright shiftrightunsigned << >> >>> bit_count bit_get getbit"))
case("fn_number_bases", "orders", "o_orderkey", ("a", "bin(o_orderkey)", "bin(o_orderkey)"), ("b", "hex(o_orderkey)", "hex(o_orderkey)"), ("c", "conv(cast(o_orderkey as string), 10, 16)", "hex(o_orderkey)"), ("d", "conv('ff', 16, 10)", "'255'"), covers=fn("bin hex conv"))
case("fn_conditional", "customer", "c_custkey", ("a", "if(c_acctbal > 0, 'plus', 'minus')"), ("b", "case when c_nationkey < 5 then 'low' when c_nationkey < 15 then 'mid' else 'high' end"), ("c", "coalesce(nullif(c_nationkey, 3), -1)"), ("d", "nvl(nullif(c_nationkey, 3), -2)", "coalesce(nullif(c_nationkey, 3), -2)"), ("e", "nvl2(nullif(c_nationkey, 3), 1, 0)", "case when nullif(c_nationkey, 3) is not null then 1 else 0 end"), ("f", "ifnull(nullif(c_nationkey, 3), -3)"), ("g", "nanvl(c_acctbal, 0)", "case when isnan(c_acctbal) then 0 else c_acctbal end"), ("h", "nullifzero(c_nationkey)", "nullif(c_nationkey, 0)"), ("i", "zeroifnull(nullif(c_nationkey, 4))", "coalesce(nullif(c_nationkey, 4), 0)"), covers=fn("if when coalesce nvl nvl2 ifnull nanvl nullif nullifzero zeroifnull"))
case("fn_casts_numeric", "orders", "o_orderkey", ("a", "cast(o_totalprice as int)", "cast(trunc(o_totalprice) as int)"), ("b", "cast(o_orderkey as double)"), ("c", "cast(o_totalprice as decimal(12,1))", "cast(o_totalprice as decimal(12,1))"), ("d", "cast(o_orderkey as string)", "cast(o_orderkey as varchar)"), ("e", "cast(o_orderkey % 2 as boolean)", "cast(o_orderkey % 2 as boolean)"), ("f", "cast(o_orderkey > 5 as int)"), ("g", "cast(o_orderkey % 100 as smallint)"), ("h", "cast(o_orderkey % 100 as tinyint)"), ("i", "cast(o_custkey as float)"), ("j", "cast(cast(o_totalprice as decimal(15,2)) as bigint)", "cast(trunc(cast(o_totalprice as decimal(15,2))) as bigint)"), covers=fn("cast") + " cast.int cast.double cast.decimal cast.string cast.boolean cast.short cast.byte cast.float cast.long")
case("fn_casts_string", "", "", ("a", "cast('12' as int)"), ("b", "cast(' 1.5 ' as double)", "1.5::double"), ("c", "cast('true' as boolean)"), ("d", "cast('12.345' as decimal(6,2))", "cast(12.35 as decimal(6,2))"), ("e", "cast('2024-02-29' as date)"), ("f", "cast('2024-02-29 12:34:56.5' as timestamp_ntz)", "cast('2024-02-29 12:34:56.5' as timestamp)"), ("g", "try_cast('x' as int)"), ("h", "try_cast('2024-13-01' as date)"), ("i", "cast(cast('abc' as binary) as string)", "'abc'"), ("j", "cast(date '2024-01-05' as string)", "'2024-01-05'"), ("k", "cast(array(1, 2) as string)", "'[1, 2]'"), ("l", "cast(date '2024-01-05' as timestamp_ntz)", "cast(date '2024-01-05' as timestamp)"), ("m", "typeof(cast(1 as bigint))", "'bigint'"), covers=fn("cast typeof") + " cast.string cast.date cast.timestamp cast.binary cast.try")
case("fn_casts_nested", "", "", ("a", "array_join(cast(array(1, 2) as array<string>), ',')", "'1,2'"), ("b", "cast(struct(1 as x, '2' as y) as struct<x: string, y: int>).y + 1", "3"), ("c", "cast(map('k', 1) as map<string, double>)['k']", "1.0::double"), ("d", "cast(cast(1704067200 as timestamp) as bigint)", "cast(1704067200 as bigint)"), ("e", "cast(timestamp_ntz '2024-01-01 10:00:00' as date)", "date '2024-01-01'"), covers="cast.array cast.struct cast.map cast.timestamp")
sql("fn_random_invariants", "select min(a) >= 0 and max(a) < 1 as unit, abs(avg(b)) < 0.2 as centred, min(c) >= 5 and max(c) <= 9 as within, min(length(d)) = 7 as letters, abs(avg(e) - 0.5) < 0.1 as even, count(distinct f) = count(*) as distinct_uuid from (select rand(1) as a, randn(2) as b, uniform(5, 9) as c, randstr(7) as d, random(3) as e, uuid() as f from orders) t", "select true as unit, true as centred, true as within, true as letters, true as even, true as distinct_uuid", covers=fn("rand randn uniform randstr random uuid"))
sql("fn_decimal_arithmetic", "select cast(cast(1.10 as decimal(5,2)) + cast(2.205 as decimal(6,3)) as decimal(10,3)) as a, cast(cast(10 as decimal(10,2)) * cast(0.25 as decimal(4,2)) as decimal(12,4)) as b, cast(cast(1 as decimal(10,2)) / cast(3 as decimal(10,2)) as decimal(12,6)) as c", "select cast(3.305 as decimal(10,3)) as a, cast(2.5 as decimal(12,4)) as b, cast(0.333333 as decimal(12,6)) as c", covers="types.decimal")

#: Edge values of casts from strings, with what Spark's try_cast gives: text, int, double, boolean, date, decimal(6,2), tinyint.
_TEXTS = (
    ("' 12 '", "12", "12.0", "null", "null", "12.00", "12"), ("'1e3'", "null", "1000.0", "null", "null", "1000.00", "null"), ("'NaN'", "null", "'NaN'", "null", "null", "null", "null"), ("'-Infinity'", "null", "'-Infinity'", "null", "null", "null", "null"),
    ("'2147483648'", "null", "2.147483648E9", "null", "null", "null", "null"), ("'-129'", "-129", "-129.0", "null", "null", "-129.00", "null"), ("'yes'", "null", "null", "true", "null", "null", "null"), ("'F'", "null", "null", "false", "null", "null", "null"),
    ("'2024-02-30'", "null", "null", "null", "null", "null", "null"), ("'2024-2-9'", "null", "null", "null", "'2024-02-09'", "null", "null"), ("'2024'", "2024", "2024.0", "null", "'2024-01-01'", "2024.00", "null"), ("''", "null", "null", "null", "null", "null", "null"), ("'0.005'", "null", "0.005", "null", "null", "0.01", "null"),
)
_AS = ("int", "double", "boolean", "date", "decimal(6,2)", "tinyint")
sql(
    "fn_casts_edges",
    "select r_regionkey, i, " + ", ".join(f"cast(try_cast(v as {t}) as string) as c{k}" for k, t in enumerate(_AS)) + " from region lateral view posexplode(array(" + ", ".join(r[0] for r in _TEXTS) + ")) as i, v",
    "select r_regionkey, cast(i as int) as i, " + ", ".join(f"cast(x{k} as varchar) as c{k}" for k in range(len(_AS))) + " from region, (values " + ", ".join("(" + ", ".join([str(i), *(v if v[0] in "'n" else f"'{v}'" for v in r[1:])]) + ")" for i, r in enumerate(_TEXTS)) + ") t(i, " + ", ".join(f"x{k}" for k in range(len(_AS))) + ")",
    covers="cast.string cast.edges",
)
sql(
    "fn_casts_overflow",
    "select l_orderkey, l_linenumber, try_cast(l_partkey * 1000 as smallint) as a, try_cast(l_extendedprice * 1e6 as int) as b, try_cast(l_extendedprice as decimal(6, 1)) as c, cast(cast(l_quantity as int) as boolean) as d, try_cast(exp(l_quantity * 1000) as int) as e from lineitem",
    "select l_orderkey, l_linenumber, case when l_partkey * 1000 between -32768 and 32767 then cast(l_partkey * 1000 as smallint) end as a, case when abs(l_extendedprice * 1e6) < 2147483648 then cast(trunc(l_extendedprice * 1e6) as int) end as b, try_cast(l_extendedprice as decimal(6, 1)) as c, l_quantity >= 1 as d, cast(null as int) as e from lineitem",
    covers="cast.overflow",
)
