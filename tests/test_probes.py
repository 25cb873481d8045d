"""Inputs that the test tables do not have: NaN, infinities, booleans, 64-bit ids, many categories, many columns."""

import pytest
from pyspark.sql import functions as F

from kiln.functions.exprs import parse_timestamp
from kiln.operators import clean as C
from kiln.operators import impute as I
from kiln.operators import quality as Q
from kiln.operators import select as S
from kiln.plans import pipelines as PL
from kiln.sources import io


@pytest.fixture(scope="module")
def odd(spark):
    return spark.range(0, 200, 1, 3).select(
        (F.col("id") + F.lit(2**60)).alias("big_id"),
        F.when(F.col("id") % 10 == 3, float("nan")).when(F.col("id") == 7, 1e6).otherwise(
            (F.col("id") % 20).cast("double")).alias("x"),
        F.when(F.col("id") % 9 == 0, None).otherwise(F.col("id") % 4 == 0).alias("flag"),
        (F.col("id") % 2).cast("int").alias("label"))


def test_nan_is_not_an_outlier(odd):
    assert Q.iqr_outliers(odd).select("column_name", "outlier_count").collect() == [("x", 1)]
    assert Q.snapshot(odd).first()["outlier_cells"] == 1
    clipped, _ = C.handle_outliers(odd, "clip")
    assert clipped.where(F.isnan("x")).count() == 20 and clipped.where("x > 1000 AND NOT isnan(x)").count() == 0
    kept, log = C.handle_outliers(odd, "remove")
    assert kept.count() == 199
    assert [e.details["rows_removed"] for e in log if e.operation == "outlier_rows_removed"] == [1]


def test_boolean_columns_stay_boolean(odd):
    for strategy in ("flag", "clip", "remove"):
        C.handle_outliers(odd, strategy)
    filled, _ = I.impute_missing(odd)
    assert filled.schema["flag"].dataType.typeName() == "boolean" and filled.where("flag IS NULL").count() == 0
    cleaned, log = PL.clean(odd)
    assert cleaned.count() > 0
    assert PL.clean_summary(odd, cleaned, log).where("section = 'metric'").count() == 6
    assert set(PL.preview_clean(odd)) >= {"issues_to_fix", "issues_to_flag"}


def test_nan_and_null_give_the_same_information(odd):
    nulls = odd.withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    a, b = (S.mutual_information(d, "label", ["x"]).first()["mi_score"] for d in (odd, nulls))
    assert a == b > 0


def test_shares_tile_the_unit_interval(spark):
    counts = spark.range(0, 200_000, 1, 8).select(F.concat(F.lit("v"), F.col("id")).alias("v"),
                                                  F.when(F.col("id") < 5, 1000).otherwise(1).alias("k"))
    runs = []
    for _ in range(2):
        iv = I.cumulative_shares(counts, 1024).select("v", "lo", "hi").distinct().orderBy("lo").collect()
        assert len(iv) == 200_000 and iv[0]["lo"] == 0.0 and iv[-1]["hi"] == 1.0
        assert all(a["hi"] == b["lo"] for a, b in zip(iv, iv[1:]))
        runs.append(iv)
    assert runs[0] == runs[1]


def test_imputation_report_rows_by_method(spark):
    rows = [("Paris" if i % 2 else "Lyon", None if i % 10 == 0 else ("F" if i % 2 else "M")) for i in range(60)]
    rows += [(None, None)] * 4
    df = spark.createDataFrame(rows, "city string, gender string")
    out, log = I.impute_missing(df)
    got = {(r["column"], r["method"]): r for r in I.imputation_report(spark, log).collect()}
    # the city of the last four rows is filled first, so their gender comes from its group too
    assert got["gender", "group_based_mode"]["filled"] == 10 and got["gender", "group_based_mode"]["grouping_feature"] == "city"
    assert got["gender", "group_based_mode"]["confidence"] == "high"
    assert sum(r["filled"] for (c, _), r in got.items() if c == "gender") == 10
    assert out.where("gender IS NULL").count() == 0


def test_near_duplicates_in_large_buckets(spark):
    cols = [((F.col("id") * (i + 3)) % (50 + i)).cast("int").alias(f"c{i}") for i in range(60)]
    df = spark.range(0, 400).select(*cols, F.when(F.col("id") == 5, 99).otherwise((F.col("id") * 10) % 57).cast("int").alias("twin"))
    got = {(r["column_a"], r["column_b"]) for r in Q.near_duplicate_columns(df).collect()}
    assert ("c7", "twin") in got


def test_vif_of_more_than_40_features(spark):
    cols = [F.rand(i).alias(f"f{i}") for i in range(45)]
    df = spark.range(0, 300).select(*cols).withColumn("sum_last", F.col("f43") + F.col("f44") + F.rand(99) * 0.01)
    got = {r["feature"]: r["status"] for r in S.vif(df).collect()}
    assert len(got) == 46 and got["sum_last"] == "HIGH" and got["f0"] == "GOOD"


def test_correlation_with_gaps_matches_spark(spark):
    df = spark.range(0, 500).select((F.col("id") + F.rand(1) * 5).alias("a"),
                                    F.when(F.col("id") % 7 != 0, F.col("id") * 2 + F.rand(2) * 9).alias("b"),
                                    F.rand(3).alias("c"))
    r = df.agg(F.corr("a", "b")).first()[0]
    got = S.correlated_pairs(df).collect()
    assert [(g["feature_a"], g["feature_b"], g["correlation"]) for g in got] == [("a", "b", round(r, 4))]


def test_datetime_forms(spark):
    forms = {"2024-01-20T10:00:00Z": "2024-01-20 10:00:00", "2024-01-20 10:00:00.123": "2024-01-20 10:00:00.123",
             "2024-01-20T10:00:00+02:00": "2024-01-20 08:00:00", "20 Jan 2024": "2024-01-20 00:00:00",
             "Jan 20, 2024": "2024-01-20 00:00:00", "01-20-2024": "2024-01-20 00:00:00", "20240120": "2024-01-20 00:00:00",
             "25/12/2024": "2024-12-25 00:00:00", "1/2/24": "2024-01-02 00:00:00", "1/2/71": "1971-01-02 00:00:00",
             "2024-01": "2024-01-01 00:00:00", "3/4/2024": "2024-03-04 00:00:00", "2024-13-01": None, "soon": None}
    df = spark.createDataFrame([(k,) for k in forms], "s string")
    got = {r["s"]: r["t"] for r in df.select("s", parse_timestamp(F.col("s"), df.schema["s"].dataType).cast("string").alias("t")).collect()}
    assert got == forms


def test_fingerprint_sees_which_column_is_null(spark):
    a = spark.createDataFrame([(None, 1), (2, None)], "x int, y int")
    b = spark.createDataFrame([(1, None), (None, 2)], "x int, y int")
    assert io.frame_fingerprint(a).first()["content_hash"] != io.frame_fingerprint(b).first()["content_hash"]


def test_csv_bytes_schema_and_backticks(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_bytes("id,na`me\n1,é\n2,\n".encode())
    bad.write_bytes(b"id,name\n1,\xff\xfe\n")
    df = io.read_table(spark, str(good))
    assert df.columns == ["id", "na`me"]
    cleaned, _ = PL.clean(df)
    assert cleaned.count() == 2
    assert io.read_table(spark, str(good), schema="id string, name string").dtypes == [("id", "string"), ("name", "string")]
    with pytest.raises(io.SourceError):
        io.read_table(spark, str(bad))


def test_candidates_leave_out_removed_features(spark):
    df = spark.range(0, 50).select(F.lit("2024-01-20").alias("join_date"), F.col("id").cast("double").alias("score"))
    from kiln.operators import features as FE
    out, rep = FE.engineer(df)
    assert {g["feature"] for g in rep.generated} <= set(out.columns)
    assert {r["feature"] for r in PL.candidates(df).collect()} <= set(out.columns)


def test_pair_preference_rules(spark):
    pairs = spark.createDataFrame([("a", "b", 0.95), ("c", "d", 0.99), ("e", "f", 0.92)],
                                  "feature_a string, feature_b string, correlation double")
    quality = spark.createDataFrame(
        [("a", False, False, None, 0.0), ("b", False, False, None, 0.0), ("c", False, True, "orig", 0.0),
         ("d", False, True, "c", 0.0), ("e", False, False, None, 0.0), ("f", False, False, None, 0.0)],
        "feature string, is_identifier boolean, is_exact_duplicate boolean, duplicate_of string, missing_pct double")
    mi = spark.createDataFrame([(c, s, 1) for c, s in (("a", .5), ("b", .1), ("e", .5), ("f", .1))],
                               "feature string, mi_score double, rank int")
    got = {r["feature_a"]: r["preferred_feature"] for r in S.prefer_in_pairs(pairs, quality, mi, generated=["e"]).collect()}
    assert got == {"a": "a", "c": "orig", "e": None}
