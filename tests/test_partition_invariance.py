"""Results must not depend on partitioning or row order."""

import pytest
from pyspark.sql import functions as F

from kiln.operators import clean as C
from kiln.operators import detect as D
from kiln.operators import features as FE
from kiln.operators import impute as I
from kiln.operators import profile as P
from kiln.operators import quality as Q
from kiln.operators import select as S


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.range(0, 3000).select(
        F.col("id").alias("record_id"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") * 37) % 90 + 10).alias("age"),
        (F.exp((F.col("id") % 101) / 20.0) * 100).alias("salary"),
        F.when(F.col("id") % 11 == 0, None)
         .when((F.col("id") % 5 < 3) == ((F.col("id") % 13) != 1), F.lit("F")).otherwise(F.lit("M")).alias("gender"),
        F.element_at(F.array(*[F.lit(x) for x in ["Paris", "Lyon", "Nice"]]),
                     (F.col("id") % 3 + 1).cast("int")).alias("city"),
        F.when(F.col("id") % 17 == 0, None).otherwise(
            F.element_at(F.array(*[F.lit(x) for x in ["a", "b", "c", "d"]]), (F.col("id") % 4 + 1).cast("int"))
        ).alias("segment"),
        F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("id") * 86_000), "yyyy-MM-dd").alias("join_date"),
        (F.col("id") % 2).alias("churn"))
    return df


def _same(a, b):
    return sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def _variants(df):
    return [df.repartition(1), df.repartition(7).orderBy(F.rand(3)), df.repartition(5, "city")]


def test_reports(frame):
    base = _variants(frame)
    for op in (Q.missing_values, Q.duplicate_rows, Q.iqr_outliers, P.numeric_report, P.profile_columns,
               D.feature_types, lambda d: S.feature_quality(d, "churn").drop("quality_flags")):
        outs = [op(v) for v in base]
        assert _same(outs[0], outs[1]) and _same(outs[0], outs[2])


def test_imputation(frame):
    outs = [I.impute_missing(v, key="record_id")[0] for v in _variants(frame)]
    assert _same(outs[0], outs[1]) and _same(outs[0], outs[2])


def test_feature_engineering(frame):
    outs = [FE.engineer(v)[0] for v in _variants(frame)]
    assert outs[0].columns == outs[1].columns == outs[2].columns
    assert _same(outs[0], outs[1]) and _same(outs[0], outs[2])


def test_selection_and_mi(frame):
    outs = [S.analyze_selection(v, "churn")["decisions"] for v in _variants(frame)]
    assert _same(outs[0], outs[1]) and _same(outs[0], outs[2])


def test_cleaning_pipeline(frame):
    from kiln.plans.pipelines import clean
    outs = [clean(v, key="record_id")[0] for v in _variants(frame)]
    assert _same(outs[0], outs[1]) and _same(outs[0], outs[2])
