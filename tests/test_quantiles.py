import pytest
from pyspark.sql import functions as F

from kiln.operators import quantiles as QN
from kiln.operators.stats import distinct_counts, distinct_up_to, numeric_stats


def test_equals_percentile(spark):
    df = spark.range(0, 20000).select(
        ((F.col("id") * 7919) % 10007).cast("double").alias("a"),
        F.when(F.col("id") % 5 == 0, None).otherwise((F.col("id") % 97) / 3.0).alias("b"),
        F.lit(1.0).alias("c"), F.lit(None).cast("double").alias("d"))
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = QN.exact_quantiles(df, {n: F.col(n) for n in "abcd"}, probs)
    want = df.agg(*[F.percentile(n, F.array(*map(F.lit, probs))).alias(n) for n in "abc"]).first()
    for n in "abc":
        assert [got[n][p] for p in probs] == list(want[n])
    assert set(got["d"].values()) == {None}


def test_one_hot_value(spark):
    """A column that is 90 % one value: its rows collapse before the shuffle."""
    df = spark.range(0, 50000, 1, 8).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(7).cast("double").alias("v"))
    got, n = QN.value_quantiles(df, {"v": F.col("v")}, (0.05, 0.5, 0.999))
    want = df.agg(F.percentile("v", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.999))).alias("q")).first()["q"]
    assert list(got["v"].values()) == list(want) and n["v"] == 50000


@pytest.mark.parametrize("k, margin", [(8, 0.0), (64, 0.001), (2048, 0.005)])
def test_ranks_outside_their_brackets_are_found(spark, k, margin):
    """Small sketches without a margin miss wanted ranks; the result stays exact."""
    df = spark.range(0, 30000, 1, 6).select(((F.col("id") * 7919) % 30011).cast("double").alias("a"),
                                            F.when(F.col("id") % 3 > 0, -F.sqrt(F.col("id").cast("double"))).alias("b"))
    probs = (0.0, 0.01, 0.25, 0.5, 0.51, 0.9, 1.0)
    got, _ = QN.value_quantiles(df, {n: F.col(n) for n in "ab"}, probs, sketch_k=k, margin=margin)
    want = df.agg(*[F.percentile(n, F.array(*map(F.lit, probs))).alias(n) for n in "ab"]).first()
    assert all([got[n][p] for p in probs] == list(want[n]) for n in "ab")


def test_few_values_leave_their_tasks(spark):
    """Only what lies inside the brackets is counted by value."""
    df = spark.range(0, 100000, 1, 4).select(F.col("id").cast("double").alias("v0"))
    sizes, brackets = QN._brackets(df, 1, (0.25, 0.5, 0.75), QN.SKETCH_K, QN.MARGIN)
    inside = sum(hi - lo for lo, hi in brackets[0])
    assert sizes == [100000] and len(brackets[0]) == 3 and inside < 0.05 * 100000


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(0, 3000).select(((F.col("id") * 31) % 1009 / 7).alias("a"), (F.col("id") % 3).cast("double").alias("b"))
    probs = (0.2, 0.5, 0.8)
    out = []
    for parts in ("1", "3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            out.append(numeric_stats(df, ["a", "b"], quantiles=probs))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    for n in "ab":
        assert len({(tuple(o[n].quantiles.items()), o[n].distinct) for o in out}) == 1


def test_distinct_counts_above_2_to_53(spark):
    df = spark.range(0, 1000).select((F.col("id") + F.lit(2**60)).alias("long_id"),
                                     (F.col("id").cast("decimal(38,2)") + F.lit("1" + "0" * 30).cast("decimal(38,2)")).alias("big"),
                                     F.concat(F.lit("x" * 100), F.col("id").cast("string")).alias("text"),
                                     F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") / 2).alias("d"))
    assert distinct_counts(df, df.columns) == {"long_id": 1000, "big": 1000, "text": 1000, "d": 500}
    assert numeric_stats(df, ["long_id"], quantiles=(0.5,))["long_id"].distinct == 1000


def test_sketches_rule_columns_out(spark, monkeypatch):
    from kiln.operators import stats
    df = spark.range(0, 5000).select("id", (F.col("id") % 50).alias("k50"), (F.col("id") % 51).alias("k51"),
                                     (F.col("id") % 3 == 0).alias("flag"), F.lit(None).cast("string").alias("none"))
    counted = []
    real = stats.distinct_counts
    monkeypatch.setattr(stats, "distinct_counts", lambda d, names, **k: counted.extend(names) or real(d, names, **k))
    got = distinct_up_to(df, df.columns, 50)
    assert got == {"id": None, "k50": 50, "k51": 51, "flag": 2, "none": 0} and "id" not in counted
