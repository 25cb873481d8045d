"""Dry runs that write nothing, observed invariants, resume, one-pass CSV."""

import os

import pytest
from pyspark.sql import functions as F

from kiln.plans import pipelines as P
from kiln.session import ensure_checkpoint_dir, scratch, staged
from kiln.sources import io


def people(spark, n=80):
    rows = [(i, 20 + i % 40 if i % 9 else None, float(1000 + 37 * i), "Paris" if i % 2 else "Lyon",
             None if i % 13 == 0 else ("F" if i % 2 else "M"), "2024-0%d-1%d" % (1 + i % 9, i % 10), i % 2) for i in range(n)]
    return spark.createDataFrame(rows + rows[:3], "Customer_ID long, Age long, Salary double, City string, Sex string, "
                                                  "Join_Date string, Churn int")


def shared_files(spark):
    return {os.path.join(d, f) for d, _, names in os.walk(ensure_checkpoint_dir(spark).removeprefix("file:")) for f in names}


def test_dry_runs_write_nothing(spark, monkeypatch):
    monkeypatch.setenv("TMPDIR", "/tmp")
    df, had = people(spark), shared_files(spark)
    preview = P.preview_clean(df, key="Customer_ID")
    log = {r["operation"]: r for r in preview["planned_log"].collect()}
    assert P.candidates(df).count() > 0 and preview["issues_to_fix"].count() > 0 and "duplicate_row_removal" in log
    assert shared_files(spark) == had and not spark.sparkContext._jsc.getPersistentRDDs()
    _, wet = P.clean(df, key="Customer_ID")
    assert [(e.operation, e.column, e.details) for e in wet] == [
        (e.operation, e.column, e.details) for e in _dry_log(spark, df)]


def _dry_log(spark, df):
    with scratch(spark, write=False):
        return P.clean(df, key="Customer_ID")[1]


def test_intermediate_tables_are_gone_after_a_run(spark, tmp_path):
    had = shared_files(spark)
    P.run_stages(spark, people(spark), str(tmp_path), target="Churn", key="Customer_ID")
    assert shared_files(spark) == had
    with scratch(spark):
        assert staged(spark.range(5), "x").count() == 5 and shared_files(spark) != had
    assert shared_files(spark) == had


def test_writes_observe_what_they_write(spark, tmp_path):
    df = people(spark)
    io.write_stage(df, str(tmp_path), "raw", keep=["Age"])
    m = io.read_manifest(spark, str(tmp_path), "raw")
    want = io.frame_fingerprint(df).first()
    assert (m.rows, m.content_hash) == (want["rows"], want["content_hash"]) and m.columns == df.columns
    assert m.kept_hash == io.frame_fingerprint(df.select("Age")).first()["content_hash"]
    empty = df.limit(0)
    io.write_stage(empty, str(tmp_path), "cleaned")
    assert io.read_manifest(spark, str(tmp_path), "cleaned").rows == 0
    assert io.read_manifest(spark, str(tmp_path), "feature_selected") is None


def test_a_stage_that_changes_its_input_is_refused(spark, tmp_path, monkeypatch):
    real = P.FE.engineer
    monkeypatch.setattr(P.FE, "engineer", lambda d, s=None: (real(d, s)[0].withColumn("Salary", F.col("Salary") + 1), real(d, s)[1]))
    with pytest.raises(io.PipelineStateError, match="changed columns"):
        P.run_stages(spark, people(spark), str(tmp_path), target="Churn", key="Customer_ID")
    monkeypatch.setattr(P.FE, "engineer", lambda d, s=None: (real(d, s)[0].where("Customer_ID > 3"), real(d, s)[1]))
    with pytest.raises(io.PipelineStateError, match="rows"):
        P.run_stages(spark, people(spark), str(tmp_path), target="Churn", key="Customer_ID", resume=True)


def test_resume_keeps_what_is_still_valid(spark, tmp_path):
    df, root = people(spark), str(tmp_path)
    run = lambda **k: P.run_stages(spark, k.pop("raw", df), root, key="Customer_ID", resume=True, **k)
    at = lambda s: os.stat(f"{root}/{s}/_SUCCESS").st_mtime_ns
    run(target="Churn")
    first = {s: at(s) for s in io.STAGES}
    run(target="Churn")
    assert {s: at(s) for s in io.STAGES} == first
    run(target="Sex")  # only the selection depends on the target
    second = {s: at(s) for s in io.STAGES}
    assert [s for s in io.STAGES if second[s] != first[s]] == ["feature_selected"]
    part = next(f for f in os.listdir(f"{root}/feature_engineered") if f.endswith(".parquet"))
    os.truncate(f"{root}/feature_engineered/{part}", 10)  # a file that is not what was written
    run(target="Sex")
    third = {s: at(s) for s in io.STAGES}
    assert [s for s in io.STAGES if third[s] != second[s]] == ["feature_engineered", "feature_selected"]
    run(raw=df.where("Customer_ID < 70"), target="Sex")
    assert all(at(s) != third[s] for s in io.STAGES)
    with pytest.raises(Exception, match="(?i)exist"):
        P.run_stages(spark, df, root, target="Sex", key="Customer_ID")  # without resume nothing is overwritten


CASES = [("id,name\n1,a\n2,b,c\n", "Line 3, column 'name'"), ("id,name\n1,a\n\n3\n", "Line 4, column 'id'")]


@pytest.mark.parametrize("text, message", CASES)
def test_csv_errors_name_line_and_column(spark, tmp_path, text, message):
    path = tmp_path / "t.csv"
    path.write_text(text)
    with pytest.raises(io.SourceError, match=message):
        io.read_table(spark, str(path))


def test_csv_bytes_and_types_name_line_and_column(spark, tmp_path):
    bad, typed = tmp_path / "bad.csv", tmp_path / "typed.csv"
    bad.write_bytes(b"id,name\n1,a\n2,\xff\xfe\n")
    with pytest.raises(io.SourceError, match="Line 3, column 'name'"):
        io.read_table(spark, str(bad))
    typed.write_text("id,n\n1,5\n2,x7\n")
    with pytest.raises(io.SourceError, match="Line 3, column 'n'.*x7"):
        io.read_table(spark, str(typed), schema="id int, n int")


def test_csv_type_lattice(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("i,l,d,day,at,b,s,none,mixed,x,x\n1,3000000000,1.5,2024-01-02,2024-01-02 10:00:00,true,a,,1,p,q\n"
                    "-2,4,1e3,2024-02-03,2024-02-03,FALSE,\"b, c\",,x,r,s\n,,,,,,,,,,\n")
    df = io.read_table(spark, str(path))
    assert [t for _, t in df.dtypes] == ["int", "bigint", "double", "date", "timestamp", "boolean", "string", "string",
                                         "string", "string", "string"]
    assert df.columns[-2:] == ["x", "x__dup1"] and df.count() == 3
    assert df.where("i = -2").first()["s"] == "b, c"
