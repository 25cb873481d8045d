from kiln.operators import clean as C
from kiln.operators import impute as I


def test_median_on_skewed(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 1.0, 1.0, 1.0, 2.0, 2.0, 3.0, 1000.0, None]], "score double")
    out, log = I.impute_missing(df)
    assert log[0].details["method"] == "median"
    assert sorted(r[0] for r in out.collect())[-2] == 3


def test_empty_strings(spark):
    df = spark.createDataFrame([("Alice",), ("",), ("  ",), ("Bob",)], "name string")
    out, log = C.normalize_empty_strings(df)
    assert [r[0] for r in out.collect()] == ["Alice", None, None, "Bob"]
    assert log[0].details["empty_strings_converted"] == 2


def test_invalid_age_to_null(spark):
    df = spark.createDataFrame([(a,) for a in [20, 30, 40, -5, 999]], "age int")
    out, _ = C.null_domain_invalid(df)
    assert [r[0] for r in out.collect()] == [20, 30, 40, None, None]


def test_integer_restore(spark):
    df = spark.createDataFrame([(20.0, 1.5), (30.0, 2.5), (None, None), (41.0, 3.25)],
                               "Age double, Salary double")
    out, _ = I.impute_missing(df)
    assert dict(out.dtypes)["Age"] == "bigint" and dict(out.dtypes)["Salary"] == "double"


def test_global_mode(spark):
    rows = [("Male",)] * 80 + [("Female",)] * 20 + [(None,)]
    out, log = I.impute_missing(spark.createDataFrame(rows, "Gender string"))
    assert log[0].details["method"] == "global_mode"
    assert out.where("Gender IS NULL").count() == 0 and out.where("Gender = 'Male'").count() == 81


def test_unknown_and_review(spark):
    few = [("A",)] * 5 + [("B",)] * 5 + [(None,)] * 5
    out, log = I.impute_missing(spark.createDataFrame(few, "Category string"))
    assert log[0].details["method"] == "unknown_category"
    assert out.where("Category = 'Unknown'").count() == 5
    sparse = [("A",), ("B",)] + [(None,)] * 4
    out2, log2 = I.impute_missing(spark.createDataFrame(sparse, "seg string"))
    assert log2[0].operation in ("categorical_imputation_review", "high_missing_column_review")
    assert out2.where("seg IS NULL").count() == 4


def test_distribution_fill_reproducible(spark):
    rows = [(i, "red" if i % 3 == 0 else ("blue" if i % 3 == 1 else "green")) for i in range(60)]
    rows += [(100 + i, None) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, color string")
    a, log = I.impute_missing(df, key="id")
    b, _ = I.impute_missing(df.repartition(3), key="id")
    assert log[0].details["method"] == "distribution_based"
    assert sorted(a.collect()) == sorted(b.collect())
    assert a.where("color IS NULL").count() == 0


def test_group_mode(spark):
    rows = []
    for city, g in [("Paris", "F"), ("Lyon", "M")]:
        rows += [(city, g)] * 12 + [(city, "M" if g == "F" else "F")] + [(city, None)]
    df = spark.createDataFrame(rows, "City string, Gender string")
    out, log = I.impute_missing(df)
    assert log[0].details["method"] == "group_based_mode"
    got = {r["City"]: r["Gender"] for r in out.where("Gender IS NOT NULL").groupBy("City", "Gender").count()
           .orderBy("count", ascending=False).collect()[:2]}
    assert got == {"Paris": "F", "Lyon": "M"}


def test_outlier_strategies(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 21)] + [(1000.0,)], "x double")
    clipped, _ = C.handle_outliers(df, "clip")
    assert max(r[0] for r in clipped.collect()) < 1000
    removed, _ = C.handle_outliers(df, "remove")
    assert removed.count() == 20
    flagged, log = C.handle_outliers(df, "flag")
    assert flagged.count() == 21 and log[0].details["outlier_count"] == 1
