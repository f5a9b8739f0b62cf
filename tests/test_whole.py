"""Queries over whole tables, on tables large enough for filters on ids to show."""

import duckdb
import pytest

from brightloom import catalog
from brightloom.registry import REGISTRY
from brightloom.tables import TABLES

catalog.queries()

CUT = "project_expressions join_range join_residual join_theta join_not_in_null agg_collect gen_posexplode gen_json_tuple udf_pandas_scalar fn_json fn_aes fn_variant fn_raise_error fn_string_format fn_rounding fn_number_bases"
NAMES = CUT.split() + [f"join_{t}_{k}" for t in "inner left right full semi anti".split() for k in "broadcast hash merge".split()] + ["join_not_in_values"]


@pytest.fixture(scope="module")
def large(tiny):
    return tiny.replace("sf0.001", "sf0.1")


@pytest.mark.parametrize("name", NAMES)
def test_whole(spark, large, tmp_path, name):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{large}/{t}.parquet'")
    q = REGISTRY[name]
    q.build(spark, large).write.parquet(f"{tmp_path}/mine")
    mine = f"from '{tmp_path}/mine/*.parquet'"
    cols = ", ".join(r[0] for r in con.execute(f"describe ({q.oracle})").fetchall())
    con.execute(f"create table theirs as {q.oracle}")
    assert con.execute(f"select count(*) from ((select {cols} {mine} except all select {cols} from theirs) union all (select {cols} from theirs except all select {cols} {mine}))").fetchone() == (0,)
    assert con.execute("select count(*) from theirs").fetchone()[0] > 0 or name == "join_not_in_null"


@pytest.mark.parametrize(("name", "table"), [("project_expressions", "orders"), ("gen_json_tuple", "events"), ("fn_json", "events"), ("fn_aes", "customer"), ("fn_rounding", "orders"), ("udf_pandas_scalar", "orders")])
def test_every_row_is_read(spark, large, name, table):
    assert REGISTRY[name].build(spark, large).count() == spark.read.parquet(f"{large}/{table}.parquet").count()
