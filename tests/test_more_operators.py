import os
import tempfile

import pytest

from kiln.operators import features as FE
from kiln.operators import opportunity as OP
from kiln.operators import quality as Q
from kiln.operators import select as S
from kiln.sources import io


def test_ratio_feature_and_division_by_zero(spark):
    rows = [(100.0 + (i * 37) % 50 * 7.3, float(i % 5)) for i in range(50)]
    out, rep = FE.engineer_numeric(spark.createDataFrame(rows, "Revenue double, Quantity double"))
    assert "Revenue_Per_Quantity" in out.columns
    zeros = sum(1 for r in out.collect() if r["Revenue_Per_Quantity"] is None)
    assert zeros == 10
    assert any(i["issue"] == "division_by_zero" and i["count"] == 10 for i in rep.issues)


def test_revenue_per_unit_name(spark):
    assert FE.ratio_pairs(["Revenue", "Units"]) == [("Revenue", "Units", "Revenue_Per_Unit")]
    assert FE.ratio_pairs(["Salary", "Years_Experience"]) == [("Salary", "Years_Experience", "Salary_Per_Years_Experience")]


def test_age_bins(spark):
    rows = [(18 + (i * 37) % 62,) for i in range(100)]
    out, _ = FE.engineer_numeric(spark.createDataFrame(rows, "Age long"))
    labels = {r["Age_Binned"] for r in out.collect()}
    assert len(labels) == 5 and any(lab.startswith("[") for lab in labels)


def test_age_years_and_birth_after_reference(spark):
    df = spark.createDataFrame([("1990-06-15", "2020-06-14"), ("2030-01-01", "2020-01-01")],
                               "Date_of_Birth string, Reference_Date string")
    out, rep = FE.engineer_datetime(df)
    ages = sorted(r["Date_of_Birth_Reference_Date_Age_Years"] for r in out.collect())
    assert ages == [-11, 29]  # floor of the day difference / 365.25, as the reference
    assert any(i["issue"] == "birth_after_reference" for i in rep.issues)


def test_relationships_by_name():
    rel = OP.relationships({"Height": "numerical", "Weight": "numerical", "Join_Date": "datetime"})
    kinds = {r[1] for r in rel}
    assert "body_ratio" in kinds and "tenure_to_reference" in kinds


def test_frequency_profile_and_uniform(spark):
    rows = [("red",)] * 3 + [("blue",)] * 3 + [("green",)] * 2 + [(None,)] * 2
    fp = Q.frequency_profile(spark.createDataFrame(rows, "color string"), "color").collect()
    top = min(fp, key=lambda r: r["rank"])
    assert top["category"] == "blue" and top["percentage"] == 37.5 and top["is_uniform"]


def test_snapshot(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "x int, y string")
    r = Q.snapshot(df).first()
    assert (r["rows"], r["columns"], r["total_missing"], r["duplicate_rows"]) == (3, 2, 1, 1)


def test_csv_read_names_and_preview(spark):
    d = tempfile.mkdtemp(prefix="kiln-csv-", dir="/tmp")
    path = os.path.join(d, "t.csv")
    with open(path, "w") as f:
        f.write("a,a,b\n1,2,x\n3,4,y\n")
    df = io.read_table(spark, path)
    assert df.columns == ["a", "a__dup1", "b"]
    assert [r["a"] for r in io.preview(df, 1, key="a").collect()] == [1]
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as f:
        f.write("a,b\n1,2\nx,y,z\n")  # an extra field is malformed (a short row is padded, as pandas does)
    with pytest.raises(io.SourceError):
        io.read_table(spark, bad)
    empty = os.path.join(d, "empty.csv")
    open(empty, "w").close()
    with pytest.raises(io.SourceError):
        io.read_table(spark, empty)


def test_write_once(spark):
    root = tempfile.mkdtemp(prefix="kiln-stage-", dir="/tmp")
    df = spark.range(3)
    io.write_stage(df, root, "raw")
    with pytest.raises(Exception):
        io.write_stage(df, root, "raw")


def test_apply_selection_options(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "t int, a int, b int, c int")
    dec = spark.createDataFrame([("t", "KEEP"), ("a", "REMOVE"), ("b", "REVIEW"), ("c", "REMOVE")],
                                "feature string, decision string")
    assert S.apply_selection(df, dec, "t").columns == ["t", "b"]
    assert S.apply_selection(df, dec, "t", force_keep=["a"], also_remove=["b"]).columns == ["t", "a"]
    assert S.apply_selection(df, dec, "t", manual_drop=["b", "t"]).columns == ["t", "a", "c"]


def test_nested_columns_pass_through(spark):
    from kiln.operators import detect as D
    from kiln.operators import profile as P
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    prof = {r["column_name"]: r for r in P.profile_columns(df).collect()}
    assert prof["embedding"]["unique_values"] is None and prof["label"]["unique_values"] >= 1
    assert "embedding" not in {r["column_name"] for r in D.feature_types(df).collect()}
    assert Q.missing_values(df).count() == 0
