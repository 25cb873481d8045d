"""Work that a report does once: parsing, counting of values, and small code for many columns."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kiln.functions.exprs import parse_timestamp
from kiln.operators import detect as D
from kiln.operators import features as FE
from kiln.operators import profile as P
from kiln.operators import quality as Q
from kiln.operators import quantiles as QT
from kiln.operators import select as S
from kiln.operators import stats
from kiln.session import ensure_checkpoint_dir


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_dates_alone_are_cast_and_other_texts_meet_one_test(spark):
    texts = ["2020-01-05", " 2020-02-30", "1/2/2020　", "13/2/2020", "2/30/2020", "2020-01-1T", "5-LOW", "20200105", None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(texts)], "i int, s string")
    parsed = df.select("i", parse_timestamp(F.col("s"), df.schema["s"].dataType).cast("string").alias("t"))
    got = {r["i"]: r["t"] and r["t"][:10] for r in parsed.collect()}
    assert got == {0: "2020-01-05", 1: None, 2: "2020-01-02", 3: "2020-02-13", 4: None, 5: None, 6: None, 7: "2020-01-05", 8: None}
    assert r"^\d{4}-\d{2}-\d{2}$" in _plan(parsed)  # the test of a date alone


def test_datetime_profile_parses_each_value_once(spark):
    df = spark.createDataFrame([("2020-01-05", "1/2/2020"), ("x", "1/2/2020"), (None, None)], "a string, b string")
    rep = P.datetime_profile(df, ["a", "b"])
    assert "Expand" not in _plan(rep)
    rows = {r["column_name"]: (r["unique_dates"], r["parseable_count"], r["invalid_count"], r["has_time"]) for r in rep.collect()}
    assert rows == {"a": (1, 1, 1, False), "b": (1, 2, 0, False)}
    none = P.datetime_profile(df.where("a = 'none'"), ["a"]).collect()
    assert [tuple(r) for r in none] == [("a", None, None, 0, None, False, 0, 0)]


def test_numeric_features_count_values_with_the_facts_only(spark, monkeypatch):
    monkeypatch.setattr(QT, "quantiles_and_distinct", lambda *a: pytest.fail("values counted again"))
    df = spark.range(200).selectExpr("cast(id % 37 as double) AS age", "cast(id % 25 AS string) AS text_number", "exp(id / 20.0) AS fee")
    out, _ = FE.engineer_numeric(df)
    assert {"age_Binned", "fee_Log"} <= set(out.columns)


def test_bins_need_no_count_of_every_value(spark, monkeypatch):
    counted = []
    real = stats.distinct_counts
    monkeypatch.setattr(stats, "distinct_counts", lambda df, names, **k: counted.extend(names) or real(df, names, **k))
    df = spark.range(500).selectExpr("cast(id AS double) AS y", "id * 7 % 501 AS x", "id % 3 AS few")
    rows = {r["feature"]: r["mi_score"] for r in S.mutual_information(df, "y").collect()}
    assert counted == ["few"] and rows["x"] > rows["few"]


def test_signatures_of_columns_are_sums_of_long(spark):
    df = spark.range(50).selectExpr("id AS a", "cast(id AS string) AS b", "49 - id AS c", "id + 1 AS d")
    got = Q.column_signatures(df, df.columns)
    assert got["a"] == got["b"] == got["c"] != got["d"] and all(isinstance(x, int) for v in got.values() for x in v)
    assert Q.duplicate_column_map(df) == {"b": "a"}


def test_quantile_places_are_looked_up_per_cell(spark):
    df = spark.range(1, 1002).selectExpr("cast(id AS double) a", "cast(id * id AS double) b", "CASE WHEN id < 3 THEN double('inf') ELSE 1.5D END AS c",
                                         "cast(null AS double) d")
    qs, n = QT.value_quantiles(df, {c: F.col(c) for c in df.columns}, (0.0, 0.25, 0.5, 1.0))
    assert qs["a"] == {0.0: 1.0, 0.25: 251.0, 0.5: 501.0, 1.0: 1001.0} and qs["b"][0.5] == 501.0 ** 2
    assert qs["c"] == {0.0: 1.5, 0.25: 1.5, 0.5: 1.5, 1.0: float("inf")} and n["d"] == 0
    few = QT._segment({0: QT._Segments([(0.0, 1.0)]), 1: QT._Segments([(0.0, 1.0), (2.0, 3.0)])})
    got = spark.createDataFrame([(0, 2.5), (1, 2.5), (1, 1.5)], "i int, v double").select(few.alias("s")).collect()
    assert [r["s"] for r in got] == [2, 3, 2]


def test_feature_pipeline_parses_each_text_column_once_for_its_type(spark, monkeypatch):
    asked = []
    real = Q.text_ratios
    for module in (FE, D):
        monkeypatch.setattr(module, "text_ratios", lambda df, names: asked.extend(names) or real(df, names))
    df = spark.range(60).selectExpr("concat('2020-01-', 10 + id % 19) AS start_date", "concat('a', id % 3) AS kind", "id % 40 AS age")
    out, _ = FE.engineer(df)
    assert {"start_date_Day", "age_Binned"} <= set(out.columns)
    assert sorted(asked) == sorted(set(asked)) and {"start_date", "kind"} <= set(asked)


def _longest_methods(spark, monkeypatch, work):
    """Bytes of the longest generated method of every query that ``work`` collects."""
    ran, nested = [], []

    def recorded(real):
        def run(self, *a):
            nested.append(1)
            out = real(self, *a)
            nested.pop()
            if not nested:
                ran.append(self)
            return out
        return run
    with monkeypatch.context() as m:
        for name in ("collect", "first"):
            m.setattr(DataFrame, name, recorded(getattr(DataFrame, name)))
        work()
    for df in ran:
        df.collect()  # the plan of a frame is final when it ran itself
    parts = [df._jdf.queryExecution().debug().codegenToSeq() for df in ran]
    return [p.apply(k)._3().maxMethodCodeSize() for p in parts for k in range(p.size())]


def test_code_for_many_columns_is_short_enough_to_be_compiled(spark, monkeypatch):
    longest = 8000  # bytes: the JVM interprets methods beyond that
    wide = spark.range(50).select(*[(F.col("id") * k % 7).cast("double").alias(f"n{k}") for k in range(12)],
                                  *[F.concat(F.lit("2020-01-1"), (F.col("id") * k % 7).cast("string")).alias(f"s{k}") for k in range(12)])
    path = ensure_checkpoint_dir(spark) + "/wide_code"
    wide.write.mode("overwrite").parquet(path)
    df = spark.read.parquet(path)
    numbers, texts = df.columns[:12], df.columns[12:]
    for work in (lambda: stats.numeric_stats(df, numbers, distinct=False), lambda: Q.column_signatures(df, df.columns),
                 lambda: Q.text_ratios(df, texts)):
        sizes = _longest_methods(spark, monkeypatch, work)
        assert sizes and max(sizes) <= longest


def test_quantiles_count_the_cells_once(spark, monkeypatch):
    ran = []
    real = DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: ran.append(self) or real(self))
    df = spark.range(500).selectExpr("cast(id AS double) a", "cast(id * id AS double) b")
    QT.value_quantiles(df, {c: F.col(c) for c in df.columns}, (0.0, 0.5, 1.0))
    assert any("ReusedExchange" in d._jdf.queryExecution().executedPlan().toString() for d in ran)


def test_information_reads_its_input_once(spark):
    df = spark.range(300).selectExpr("id % 2 AS y", "CASE WHEN id % 11 > 0 THEN id % 3 END AS few", "cast(null AS void) AS none",
                                     "concat('k', id % 2) AS same", "id % 300 AS `a.b`")
    out = S.mutual_information(df, "y")
    assert "Range" not in _plan(out)  # the plan of the input ran for the staged table
    rows = {r["feature"]: (r["mi_score"], r["rank"]) for r in out.collect()}
    assert rows["same"] == (0.693147, 1) and rows["none"][0] == 0.0 and set(rows) == {"few", "none", "same", "a.b"}
