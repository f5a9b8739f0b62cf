"""JSON, CSV, XML, URLs and hashes."""

from __future__ import annotations

from ..registry import sql
from .cases import case, fn

case("fn_json", "events", "event_id", ("a", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("b", "from_json(props, 'k int').k", "cast(json_extract_string(props, '$.k') as int)"), ("c", "to_json(named_struct('id', event_id, 't', event_type))", "'{\"id\":' || event_id || ',\"t\":\"' || event_type || '\"}'"), ("d", "json_array_length('[1,2,3]')", "3"), ("e", "json_object_keys(props)[0]", "'k'"), ("f", "schema_of_json('{\"a\": 1}')", "'STRUCT<a: BIGINT>'"), covers=fn("get_json_object from_json to_json json_array_length json_object_keys schema_of_json"))
case("fn_csv", "nation", "n_nationkey", ("a", "from_csv(concat_ws(',', n_nationkey, n_name), 'k int, n string').n", "n_name"), ("b", "to_csv(struct(n_nationkey, n_name))", "n_nationkey || ',' || n_name"), ("c", "schema_of_csv('1,abc')", "'STRUCT<_c0: INT, _c1: STRING>'"), covers=fn("from_csv to_csv schema_of_csv"))
X = "concat('<r><k>', n_nationkey, '</k><n>', n_name, '</n></r>')"
case("fn_xml", "nation", "n_nationkey", ("a", f"xpath_string({X}, 'r/n')", "n_name"), ("b", f"xpath_int({X}, 'r/k')", "n_nationkey"), ("c", f"xpath_long({X}, 'r/k')", "cast(n_nationkey as bigint)"), ("d", f"xpath_double({X}, 'r/k')", "cast(n_nationkey as double)"), ("e", f"xpath_boolean({X}, 'r/k > 5')", "n_nationkey > 5"), ("f", f"xpath({X}, 'r/n/text()')[0]", "n_name"), ("g", f"xpath_short({X}, 'r/k')", "cast(n_nationkey as smallint)"), ("h", f"xpath_float({X}, 'r/k')", "cast(n_nationkey as float)"), ("i", f"xpath_number({X}, 'r/k')", "cast(n_nationkey as double)"), ("j", f"from_xml({X}, 'k int, n string').n", "n_name"), ("k", "schema_of_xml('<r><k>1</k></r>')", "'STRUCT<k: BIGINT>'"), ("l", "to_xml(struct(n_nationkey as k)) like '%<k>%'", "true"), covers=fn("xpath_string xpath_int xpath_long xpath_double xpath_boolean xpath xpath_short xpath_float xpath_number from_xml schema_of_xml to_xml"))
case("fn_url", "pages", "page_id", ("a", "parse_url(url, 'HOST')", "regexp_extract(url, '://([^/?#]+)', 1)"), ("b", "parse_url(url, 'PROTOCOL')", "regexp_extract(url, '^([a-z]+):', 1)"), ("c", "url_decode(url_encode(url))", "url"), ("d", "url_encode('a b&c')", "'a+b%26c'"), ("e", "try_url_decode('%zz') is null", "true"), covers=fn("parse_url url_encode url_decode try_url_decode"))
case("fn_hash", "customer", "c_custkey", ("a", "md5(c_name)"), ("b", "sha2(c_name, 256)", "sha256(c_name)"), ("c", "sha1(c_name)"), ("d", "sha(c_name)", "sha1(c_name)"), ("e", "crc32('Spark')", "cast(1557323817 as bigint)"), covers=fn("md5 sha2 sha1 sha crc32"))
case("fn_hash_known", "", "", ("a", "hash('Spark', array(123), 2)", "-1321691492"), ("b", "xxhash64('Spark', array(123), 2)", "cast(5602566077635097486 as bigint)"), covers=fn("hash xxhash64"))
sql("fn_aes", "select cast(aes_decrypt(aes_encrypt(c_name, '0000111122223333'), '0000111122223333') as string) = c_name as same, try_aes_decrypt(unhex('00'), '0000111122223333') is null as bad from customer", "select true as same, true as bad from customer", covers=fn("aes_encrypt aes_decrypt try_aes_decrypt"))
