"""Dominant values, near-duplicate columns and moments of wide tables against plain versions."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from kiln.operators import dominant as DV
from kiln.operators import quality as Q
from kiln.operators import select as S
from kiln.operators.moments import pair_moments


def plain(values):
    counts = Counter(v for v in values if v is not None)
    return min(counts.items(), key=lambda kv: (-kv[1], kv[0].encode())) if counts else None


def test_dominant_values_equal_plain_version(spark):
    long = "x" * 100
    rows = [(f"all distinct {i * 7919 % 3000:05d}", f"pair {i // 2:05d}", "hot" if i % 3 else f"other {i}", None,
             f"{long}{i // 2 % 700:04d}{'y' * (i % 2 and 0)}", "é" if i % 2 else "z", "" if i % 4 else None, i % 7)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string, h int").repartition(5)
    want = {c: plain([None if r[k] is None else str(r[k]) for r in rows]) for k, c in enumerate(df.columns)}
    for few in (1000, 3):
        got = DV.dominant_values(df, df.columns, few=few)
        assert got == {c: w for c, w in want.items() if w}
    assert DV.dominant_values(df.limit(0), df.columns) == {} == DV.dominant_values(df, [])


def test_only_hot_columns_are_settled_by_the_summary(spark):
    df = spark.range(0, 4000).select((F.col("id") % 2000).cast("string").alias("cold"), (F.col("id") % 5).cast("string").alias("warm"))
    got = DV.dominant_counts(df, ["cold", "warm"], rest=False)
    assert set(got) == {"warm"} and got["warm"][0] == 800 and len(got["warm"][1]) == 5
    cold = DV.dominant_counts(df, ["cold"])["cold"]
    assert cold[0] == 2 and set(cold[1].columns) == {"h1", "h2", "prefix"}


def test_strips_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40)) + 1e6
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], [f"f{i}" for i in range(40)])
    got = np.full((40, 40), np.nan)
    for strip in pair_moments(df, df.columns, block=16):
        r = strip.correlation()
        got[strip.at:strip.at + len(r), strip.at:] = r
    for i in range(40):
        for j in range(i, 40):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            assert abs(got[i, j] - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 1e-6


def test_vif_equals_regressions(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 6))
    x[:, 4] = x[:, 0] + 0.5 * x[:, 1] + 0.05 * rng.normal(size=200)
    x = np.column_stack([x, x[:, 2], np.full(200, 3.0)])  # a copy and a constant
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], [f"f{i}" for i in range(8)])
    got = {r["feature"]: r for r in S.vif(df).collect()}
    assert set(got) == {f"f{i}" for i in range(7)}
    z = x[:, :7] - x[:, :7].mean(axis=0)
    for i in range(7):
        other = np.delete(z, i, axis=1)
        rest = z[:, i] - other @ np.linalg.lstsq(other, z[:, i], rcond=None)[0]
        r2 = min(max(1 - rest @ rest / (z[:, i] @ z[:, i]), 0), 0.999999)
        assert abs(got[f"f{i}"]["vif"] - min(1 / (1 - r2), 1e6)) < 0.02 + 1e-3 / (1 - r2)
    assert got["f2"]["related"] == "f6" and got["f3"]["related"] == ""


def test_near_duplicates_of_a_thousand_binary_columns(spark, monkeypatch):
    n = 1000
    cols = [(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0).alias(f"b{i}") for i in range(n)]
    df = spark.range(0, 3000, 1, 4).select("id", *cols)
    df = df.select(*[f"b{i}" for i in range(n)], F.when(F.col("id") % 25 == 0, ~F.col("b7")).otherwise(F.col("b7")).alias("twin"))
    checked = []
    real = Q._chunked_agg
    monkeypatch.setattr(Q, "_chunked_agg", lambda d, exprs: checked.append(len(exprs)) or real(d, exprs))
    got = Q.near_duplicate_columns(df, exclude=set()).collect()
    assert [tuple(r) for r in got] == [("b7", "twin", 96.0)] and sum(checked) < 3000


def test_banded_and_exact_candidates_agree(spark):
    df = spark.range(0, 2000).select(
        F.col("id").alias("a"), F.when(F.col("id") % 30 == 0, -1).otherwise(F.col("id")).alias("b"),
        (F.col("id") % 9).alias("c"), F.when(F.col("id") < 90, 8).otherwise(F.col("id") % 9).alias("d"), (F.col("id") % 8).alias("e"))
    banded, exact = (sorted(map(tuple, Q.near_duplicate_columns(df, exact=e).collect())) for e in (False, True))
    assert banded == exact and {r[:2] for r in exact} == {("a", "b"), ("c", "d")}
