"""String functions."""

from __future__ import annotations

from .cases import case, fn

I = "cast({} as int)".format  # noqa: E741

case("fn_string_case", "customer", "c_custkey", ("u", "upper(c_mktsegment)"), ("l", "lower(c_mktsegment)"), ("uc", "ucase(c_name)"), ("lc", "lcase(c_name)"), ("i", "initcap(lower(c_mktsegment))", "upper(substring(c_mktsegment, 1, 1)) || lower(substring(c_mktsegment, 2))"), covers=fn("upper lower ucase lcase initcap"))
case("fn_string_length", "part", "p_partkey", ("a", "length(p_name)", I("length(p_name)")), ("b", "char_length(p_name)", I("length(p_name)")), ("c", "character_length(p_name)", I("length(p_name)")), ("d", "len(p_name)", I("length(p_name)")), ("e", "octet_length(p_name)", I("strlen(p_name)")), ("f", "bit_length(p_name)", I("bit_length(p_name)")), covers=fn("length char_length character_length len octet_length bit_length"))
case("fn_string_substring", "part", "p_partkey", ("a", "substring(p_name, 2, 3)"), ("b", "substr(p_name, 3)"), ("c", "left(p_name, 4)"), ("d", "right(p_name, 4)"), ("e", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"), ("f", "split_part(p_brand, '#', 2)"), covers=fn("substring substr left right substring_index split_part"))
case("fn_string_trim_pad", "part", "p_partkey", ("a", "trim('  ' || p_name || ' ')"), ("b", "ltrim('  ' || p_type)"), ("c", "rtrim(p_type || '  ')"), ("d", "btrim('xx' || p_brand || 'xx', 'x')", "trim('xx' || p_brand || 'xx', 'x')"), ("e", "lpad(p_type, 12, '*')"), ("f", "rpad(p_type, 12, '*')"), covers=fn("trim ltrim rtrim btrim lpad rpad"))
case("fn_string_search", "part", "p_partkey", ("a", "instr(p_name, 'a')", I("instr(p_name, 'a')")), ("b", "locate('e', p_name)", I("instr(p_name, 'e')")), ("c", "position('i' in p_name)", I("position('i' in p_name)")), ("d", "contains(p_name, 'ring')"), ("e", "startswith(p_name, 'red')", "starts_with(p_name, 'red')"), ("f", "endswith(p_name, 'et')", "ends_with(p_name, 'et')"), ("g", "find_in_set(p_type, 'ECONOMY,PROMO,SMALL')", "case p_type when 'ECONOMY' then 1 when 'PROMO' then 2 when 'SMALL' then 3 else 0 end"), covers=fn("instr locate position contains startswith endswith find_in_set"))
case("fn_string_replace", "part", "p_partkey", ("a", "replace(p_name, 'e', 'EE')"), ("b", "translate(p_name, 'aeiou', '12345')"), ("c", "reverse(p_name)"), ("d", "repeat(p_type, 2)"), ("e", "overlay(p_type placing '##' from 2 for 3)", "substring(p_type, 1, 1) || '##' || substring(p_type, 5)"), ("f", "concat(p_type, '/', p_brand)", "p_type || '/' || p_brand"), ("g", "concat_ws('-', p_type, nullif(p_type, 'PROMO'), p_brand)"), ("h", "space(3) || 'x'", "'   x'"), covers=fn("replace translate reverse repeat overlay concat concat_ws space"))
case("fn_string_code", "part", "p_partkey", ("a", "ascii(p_name)"), ("b", "chr(65 + p_size)", "chr(65 + p_size)"), ("c", "char(97)", "chr(97)"), ("d", "hex(p_type)", "hex(p_type)"), ("e", "base64(cast(p_type as binary))", "base64(encode(p_type))"), ("f", "cast(unbase64(base64(cast(p_brand as binary))) as string)", "p_brand"), ("g", "cast(unhex(hex(p_brand)) as string)", "p_brand"), ("h", "decode(encode(p_name, 'UTF-8'), 'UTF-8')", "p_name"), covers=fn("ascii chr char hex base64 unbase64 unhex encode decode"))
case("fn_string_distance", "part", "p_partkey", ("a", "levenshtein(p_name, p_type)", I("levenshtein(p_name, p_type)")), ("b", "soundex('Robert')", "'R163'"), ("c", "luhn_check('79927398713')", "true"), ("d", "elt(2, p_name, p_type)", "p_type"), covers=fn("levenshtein soundex luhn_check elt"))
case("fn_string_regex", "part", "p_partkey", ("a", "regexp_extract(p_brand, '([0-9]+)', 1)"), ("b", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), ("c", "regexp_like(p_name, '^[rs]')", "regexp_matches(p_name, '^[rs]')"), ("d", "p_name rlike 'ge'", "regexp_matches(p_name, 'ge')"), ("e", "regexp_count(p_name, '[aeiou]')", I("len(regexp_extract_all(p_name, '[aeiou]'))")), ("f", "array_join(regexp_extract_all(p_name, '([a-z])[aeiou]', 1), '')", "array_to_string(regexp_extract_all(p_name, '([a-z])[aeiou]', 1), '')"), ("g", "regexp_substr(p_brand, '[0-9]+')", "regexp_extract(p_brand, '[0-9]+')"), ("h", "regexp_instr(p_brand, '[0-9]')", "7"), ("i", "p_name regexp 'red'", "regexp_matches(p_name, 'red')"), covers=fn("regexp_extract regexp_replace regexp_like rlike regexp_count regexp_extract_all regexp_substr regexp_instr regexp"))
case("fn_string_split", "part", "p_partkey", ("a", "size(split(p_name, ' '))", I("len(string_split(p_name, ' '))")), ("b", "split(p_name, ' ')[0]", "string_split(p_name, ' ')[1]"), ("c", "array_join(split(p_name, '[aeiou]'), '|')", "array_to_string(string_split_regex(p_name, '[aeiou]'), '|')"), covers=fn("split"))
case("fn_string_format", "orders", "o_orderkey", ("a", "format_string('%05d/%s', o_orderkey, o_orderstatus)", "lpad(cast(o_orderkey as varchar), cast(greatest(5, length(cast(o_orderkey as varchar))) as int), '0') || '/' || o_orderstatus"), ("b", "printf('%s-%s', o_orderstatus, o_orderpriority)", "o_orderstatus || '-' || o_orderpriority"), ("c", "format_number(o_orderkey * 1000 + 1234567, 0)", "format('{:,}', o_orderkey * 1000 + 1234567)"), covers=fn("format_string printf format_number"))
case("fn_string_mask_number", "", "", ("a", "mask('AbCD123-@$#')", "'XxXXnnn-@$#'"), ("b", "to_number('$78.12', '$99.99')", "cast(78.12 as decimal(4,2))"), ("c", "to_char(78.12, '$99.99')", "'$78.12'"), ("d", "to_varchar(454, '999')", "'454'"), ("e", "cast(try_to_number('abc', '99') as int)", "cast(null as int)"), ("f", "cast(to_binary('abc', 'utf-8') as string)", "'abc'"), ("g", "try_to_binary('a!', 'base64') is null", "true"), ("h", "collation('x')", "'SYSTEM.BUILTIN.UTF8_BINARY'"), ("i", "'ABC' collate UTF8_LCASE = 'abc'", "true"), covers=fn("mask to_number to_char to_varchar try_to_number to_binary try_to_binary collation collate"))
case("fn_predicates", "customer", "c_custkey", ("a", "c_name like '%7'"), ("b", "c_mktsegment ilike 'build%'"), ("c", "c_nationkey in (1, 2, 3)"), ("d", "c_acctbal between 0 and 1000"), ("e", "not (c_acctbal > 0)"), ("f", "! (c_custkey = 3)", "not (c_custkey = 3)"), ("g", "c_custkey == 5", "c_custkey = 5"), ("h", "nullif(c_nationkey, 2) is null"), ("i", "isnull(nullif(c_nationkey, 2))", "nullif(c_nationkey, 2) is null"), ("j", "isnotnull(nullif(c_nationkey, 2))", "nullif(c_nationkey, 2) is not null"), ("k", "nullif(c_nationkey, 2) <=> null", "nullif(c_nationkey, 2) is null"), ("l", "isnan(c_acctbal)", "isnan(c_acctbal)"), ("m", "c_acctbal >= 10 and c_acctbal <= 20 or c_custkey < 5"), ("n", "equal_null(nullif(c_nationkey, 2), null)", "nullif(c_nationkey, 2) is null"), covers=fn("like ilike in between not ! == isnull isnotnull <=> isnan and or < <= > >= = equal_null"))
