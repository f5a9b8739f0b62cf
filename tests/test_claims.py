"""What COVERAGE.md may say: entries without a query that exercises them aren't claimed."""

from brightloom import catalog


def test_unexercised_entries_are_not_claimed():
    assert not catalog.coverage().keys() & {"scan.default_columns"}
    assert catalog.coverage()["sample.split"] == ["sample_split"]


def test_split_parts_are_a_share_each(spark, tiny):
    orders = spark.read.parquet(f"{tiny}/orders.parquet")
    a, b = orders.randomSplit([0.7, 0.3], seed=5)
    assert a.count() + b.count() == orders.count() and 0.6 < a.count() / orders.count() < 0.8


def test_late_rows_are_dropped(spark, tiny):
    """The claim streaming.late_data: the query counts fewer rows than closed days have."""
    counted = catalog.queries()["stream_late_data"](spark, tiny).groupBy().sum("n").first()[0]
    assert 0 < counted < spark.read.parquet(f"{tiny}/events.parquet").count() * 0.75
