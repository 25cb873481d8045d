import tempfile

from kiln.plans import pipelines as P
from kiln.sources import io


def test_stage_flow_and_gating(spark):
    rows = [(i, 20 + i % 40 if i % 9 else None, float(1000 + 37 * i), "Paris" if i % 2 else "Lyon",
             "Paris" if i % 2 else "Lyon", "2024-0%d-1%d" % (1 + i % 9, i % 10), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "Customer_ID long, Age long, Salary double, City string, City_Copy string, "
                                     "Join_Date string, Churn int")
    root = tempfile.mkdtemp(prefix="kiln-test-", dir="/tmp")
    try:
        io.read_stage(spark, root, "cleaned")
        raise AssertionError("missing checkpoint must raise")
    except io.PipelineStateError as exc:
        assert "cleaned" in str(exc)
    paths = P.run_stages(spark, df, root, target="Churn", key="Customer_ID")
    status = {r["stage"]: r for r in io.pipeline_status(spark, root).collect()}
    assert status["feature_selected"]["is_current"]
    cleaned = io.read_stage(spark, root, "cleaned")
    assert "City_Copy" not in cleaned.columns and cleaned.where("Age IS NULL").count() == 0
    selected = io.read_stage(spark, root, "feature_selected")
    assert "Churn" in selected.columns and "Customer_ID" not in selected.columns
    assert io.read_stage(spark, root, "feature_engineered").count() == 80
    assert set(paths) == {"raw", "cleaned", "feature_engineered", "feature_selected"}


def test_fingerprint_order_insensitive(spark):
    df = spark.range(0, 100).selectExpr("id", "id % 7 AS k")
    a = io.frame_fingerprint(df).first()
    b = io.frame_fingerprint(df.orderBy("k").repartition(3)).first()
    assert a == b


def test_report_round_trip_and_csv_copy(spark):
    from kiln.operators import quality as Q
    root = tempfile.mkdtemp(prefix="kiln-report-", dir="/tmp")
    df = spark.createDataFrame([(1, None), (2, "b"), (3, None)], "x int, y string")
    rep = Q.missing_values(df)
    io.write_report(rep, root, "missing")
    back = io.read_report(spark, root, "missing", rep.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rep.collect()))
    io.write_stage(df, root, "cleaned", csv_copy=True)
    assert spark.read.option("header", True).csv(f"{root}/cleaned_csv").count() == 3
