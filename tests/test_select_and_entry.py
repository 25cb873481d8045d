from pyspark.sql import functions as F

from kiln.operators import select as S


def test_correlation_and_vif(spark):
    df = spark.range(0, 300).select(F.col("id").cast("double").alias("Salary"),
                                    (F.col("id") * 2.0 + (F.col("id") % 3)).alias("Salary_Copy"),
                                    (F.col("id") % 11).cast("double").alias("Noise"))
    pairs = S.correlated_pairs(df).collect()
    assert [(r[0], r[1]) for r in pairs] == [("Salary", "Salary_Copy")]
    v = {r["feature"]: r["status"] for r in S.vif(df).collect()}
    assert v["Salary"] == "HIGH" and v["Noise"] == "GOOD"


def test_decisions(spark):
    rows = [(i, "SAME", float(i), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "customer_id long, Constant_Column string, x double, Churn int")
    res = S.analyze_selection(df, "Churn")
    d = {r["feature"]: r["decision"] for r in res["decisions"].collect()}
    assert d["Churn"] == "KEEP" and d["Constant_Column"] == "REMOVE" and d["customer_id"] == "REMOVE"
    kept = S.apply_selection(df, res["decisions"], "Churn").columns
    assert "Churn" in kept and "Constant_Column" not in kept


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
