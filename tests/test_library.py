"""Helpers beside the registry: plans, joins, sessions, errors that strict mode raises."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brightloom import catalog
from brightloom.operators.joins import asof_join, range_join, salted_join
from brightloom.plans import explain
from brightloom.tables import load


def test_entry_imports_and_runs(spark, tiny):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= catalog.queries().keys()
    assert catalog.queries()["tpch_q1"](spark, tiny).count() == 6


def test_filters_and_columns_reach_the_scan(spark, tiny):
    report = explain(load(spark, tiny, "lineitem").where("l_quantity > 40").select("l_orderkey"))
    assert any("l_quantity" in p for p in report.pushed)
    assert "l_extendedprice" not in report.read[0]
    assert report.shuffles == 0


@pytest.mark.parametrize(("hint", "node"), [("broadcast", "BroadcastHashJoin"), ("shuffle_hash", "ShuffledHashJoin"), ("merge", "SortMergeJoin")])
def test_hints_choose_the_join(spark, tiny, hint, node):
    o, c = load(spark, tiny, "orders"), load(spark, tiny, "customer")
    assert explain(o.join(c.hint(hint), o["o_custkey"] == c["c_custkey"])).operators[node] == 1


def test_python_is_reported(spark):
    shout = F.udf(lambda x: x, "long", useArrow=True)
    assert any("Python" in why for _, why in explain(spark.range(3).select(shout("id"))).reasons)


def test_asof_takes_the_last_before(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 3)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, 10), ("a", 5, 20), ("a", 5, 15), ("a", 6, 30)], "k string, t int, v int")
    got = {r["id"]: r["v"] for r in asof_join(left, right, "k", "t", ["v"]).collect()}
    assert got == {1: 20, 2: None, 3: None, 4: None}


def test_range_join_is_exact(spark):
    points = spark.createDataFrame([(0.0,), (1.0,), (2.5,), (9.9,)], "x double")
    spans = spark.createDataFrame([(1, 0.0, 2.5), (2, 2.5, 2.5), (3, -5.0, 50.0)], "i int, a double, b double")
    got = sorted((r["x"], r["i"]) for r in range_join(points, spans, "x", "a", "b", 3.0).collect())
    assert got == [(0.0, 1), (0.0, 3), (1.0, 1), (1.0, 3), (2.5, 3), (9.9, 3)]


def test_salted_join_keeps_every_row(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(1, "hot"), (800, "cold")], "k long, name string")
    got = {r["name"]: r["count"] for r in salted_join(big, small, "k", hot_rows=100, share=50).groupBy("name").count().collect()}
    assert got == {"hot": 700, "cold": 1}


@pytest.mark.parametrize("expression", ["cast('x' as int)", "1 / 0", "cast(300 as tinyint)", "array(1)[3]", "2147483647 + 1"])
def test_strict_mode_raises(spark, expression):
    with pytest.raises(Exception, match="CAST|DIVIDE|OVERFLOW|INDEX|ARITHMETIC"):
        spark.sql(f"select {expression} as v").collect()


def test_null_placement(spark):
    rows = spark.createDataFrame([(1, None), (2, 3), (3, 1)], "id int, v int")
    assert [r["id"] for r in rows.orderBy(F.col("v").desc_nulls_first()).collect()] == [1, 2, 3]
    assert [r["id"] for r in rows.orderBy(F.col("v").asc_nulls_last()).collect()] == [3, 2, 1]
    anti = spark.sql("select 1 as k where 1 not in (select * from values (2), (null))")
    assert anti.count() == 0


def test_dates_at_edges(spark):
    row = spark.sql("select date '2024-02-29' + interval 1 year as leap, date_sub(date '1970-01-01', 1) as before, unix_date(date '1969-12-31') as day").first()
    assert row["before"] == dt.date(1969, 12, 31) and row["day"] == -1
    assert row["leap"] in (dt.date(2025, 2, 28), dt.datetime(2025, 2, 28))


def test_strict_plans_and_summaries(spark, tiny):
    import pytest

    from brightloom.plans import PlanError, strict, summary

    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    assert strict(orders.groupBy("o_orderstatus").count()).shuffles == 1
    pairs = orders.crossJoin(orders.select("o_custkey")).hint("shuffle_replicate_nl")
    with pytest.raises(PlanError, match="every row|every pair|each row"):
        strict(pairs)
    found = summary(orders.where("o_orderkey > 5").groupBy("o_custkey").count())
    assert found["shuffles"] == 1 and found["pushed"] == 1 and found["notes"] == []
    one = orders.agg({"o_orderkey": "max"})
    assert strict(one, allowed=("Exchange",)).shuffles == 1
    with pytest.raises(PlanError, match="one task"):
        strict(one)


def test_usual_width_of_intervals(spark):
    from brightloom.operators.joins import range_join, usual_width

    spans = spark.createDataFrame([(i, i * 1.0, i * 1.0 + 2.0) for i in range(50)] + [(99, 5.0, 5.0)], "id int, lo double, hi double")
    assert usual_width(spans, "lo", "hi") == 4.0 and usual_width(spans.where("false"), "lo", "hi") == 1.0
    points = spark.createDataFrame([(k, k / 3) for k in range(160)], "p int, x double")
    for width in (0.5, 4.0, 100.0):
        got = {(r["p"], r["id"]) for r in range_join(points, spans, "x", "lo", "hi", width).collect()}
        assert got == {(k, i) for k in range(160) for i in range(50) if i <= k / 3 < i + 2.0}


def test_range_totals_against_plain_loops(spark):
    from brightloom.operators.joins import range_totals

    nan, inf = float("nan"), float("inf")
    points = [(1, 0.0), (2, -0.0), (None, 0.0), (4, 2.5), (2**62, 2.5), (-(2**62), 1.0), (2**62 + 5, 9.0), (7, nan), (8, inf), (9, None), (None, 40.0), (3, -inf)]
    spans = [(1, 0.0, 2.5), (1, -0.0, 1.0), (2, 2.5, 2.5), (3, 2.5, 0.0), (4, -inf, inf), (5, 9.0, nan), (6, None, 3.0), (7, 40.0, 41.0), (None, 2.5, 9.0), (9, 100.0, 200.0), (10, 9.0, 40.0)]
    below = lambda a, b: False if a != a else True if b != b else a < b
    want = {}
    for k, a, b in spans:
        for v, x in points:
            if None not in (x, a, b) and not below(x, a) and below(x, b):
                n, ids = want.get(k, (0, None))
                want[k] = n + 1, ids if v is None else (ids or 0) + v
    p, i = spark.createDataFrame(points, "v long, x double").repartition(3), spark.createDataFrame(spans, "k int, a double, b double").repartition(3)
    assert {r["k"]: (r["n"], r["total"]) for r in range_totals(p, i, "x", "a", "b", "k", "v").collect()} == want
    assert range_totals(p.where("false"), i, "x", "a", "b", "k", "v").count() == range_totals(p, i.where("false"), "x", "a", "b", "k", "v").count() == 0


def test_range_totals_of_one_crowded_value(spark, tmp_path):
    """400,000 points at one value in 100,000 equal intervals: 4e10 pairs, none of which may be made."""
    spark.range(400_000).selectExpr("id as event_id", "20.5D as value").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(100_000).selectExpr("id as o_orderkey", "100000D as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = catalog.queries()["join_range"](spark, str(tmp_path))
    assert got.groupBy("n", "ids").count().collect() == [(400_000, 400_000 * 399_999 // 2, 100_000)]


def test_theta_join_is_dealt_by_its_pairs(spark, tmp_path, monkeypatch):
    """One file of suppliers, as large tables have: no task compares more than its share of the pairs."""
    import duckdb

    from brightloom.operators import joins
    from brightloom.registry import REGISTRY

    rows = spark.range(12_000).selectExpr("id as s_suppkey", "cast(nullif(id % 25, 3) as int) as s_nationkey", "if(id % 999 = 5, double('nan'), cast(id * 7919 % 3001 as double)) as s_acctbal")
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    oracle = REGISTRY["join_theta"].oracle.replace("from supplier", "from s").replace("join supplier", "join s")
    con = duckdb.connect()
    con.execute(f"create table s as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    total = con.execute(f"select count(*), sum(lo * 31 + hi * hi) from ({oracle})").fetchone()
    for most, node in ((1_000_000, "BroadcastNestedLoopJoin"), (1_000, "CartesianProduct")):
        monkeypatch.setattr(joins, "BROADCAST_ROWS", most)
        got = REGISTRY["join_theta"].build(spark, str(tmp_path))
        assert explain(got).operators[node] == 1
        parts = got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.expr("lo * 31 + hi * hi")).alias("s")).collect()
        assert (sum(r["n"] for r in parts), sum(r["s"] for r in parts)) == total
        assert len(parts) >= 12_000**2 // joins.PAIRS_PER_TASK and max(r["n"] for r in parts) < total[0] / 3


def test_xml_files_are_bounded(spark, tmp_path):
    """One partition of many customers becomes several files, as a task reads an XML file whole."""
    from brightloom.sources.files import XML_ROWS

    rows = spark.range(5 * XML_ROWS // 2).selectExpr("id as c_custkey", "concat('Customer <&> ', id) as c_name", "if(id % 7 = 0, null, cast(id % 25 as int)) as c_nationkey", "id / 8 as c_acctbal", "'BUILDING' as c_mktsegment")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.queries()["io_xml"](spark, str(tmp_path))
    assert len(got.inputFiles()) == 3 and got.rdd.getNumPartitions() == 3
    assert got.exceptAll(rows).count() == 0 and got.count() == rows.count()
