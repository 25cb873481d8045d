"""Stand-in inputs keep every row of the tables they reshape."""

from pyspark.sql import functions as F

from kiln.sources.derived import VIEWS, derived

SF = "/root/testdata/sf0.01"


def _n(spark, table):
    return spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_views_keep_whole_tables(spark):
    assert derived(spark, SF, "dirty_customer").count() == _n(spark, "customer")
    assert derived(spark, SF, "categorical_customer").count() == _n(spark, "customer")
    assert derived(spark, SF, "customer_age_copy").count() == _n(spark, "customer")
    assert derived(spark, SF, "labelled_documents").count() == _n(spark, "documents")
    assert derived(spark, SF, "dirty_dates").count() == _n(spark, "lineitem")
    # the events view adds repeated rows (dirt for duplicate checks) on top of every event
    ev = derived(spark, SF, "dirty_events")
    assert ev.select("event_id").distinct().count() == _n(spark, "events")
    assert ev.count() > _n(spark, "events")
    assert set(VIEWS) == {"dirty_customer", "dirty_events", "dirty_dates", "labelled_documents",
                          "categorical_customer", "customer_age_copy"}
