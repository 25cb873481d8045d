"""Sequence test against sorted differences, rule tables, map columns."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from kiln.functions.rules import Rule, decide, fitting
from kiln.operators import clean as C
from kiln.operators import detect as D
from kiln.operators import quality as Q
from kiln.plans import pipelines as PL


def plain_sequential(values):
    values = sorted(v for v in values if v is not None)
    return statistics.median(b - a for a, b in zip(values, values[1:])) in (0, 1)


@pytest.mark.parametrize("stretch", [4, 1024])
def test_sequences_equal_sorted_differences(spark, monkeypatch, stretch):
    monkeypatch.setattr(D, "STRETCH", stretch)
    rng = random.Random(7)
    n = 300
    columns = {
        "plain": [("long", 1000 + i) for i in range(n)],
        "shuffled": [("long", v) for v in rng.sample(range(-150, 150), n)],
        "sparse": [("long", 3 * i) for i in range(n)],
        "half": [("long", i if i < 150 else 10 * i) for i in range(n)],
        "just": [("long", i if i < 152 else 10 * i) for i in range(n)],
        "repeats": [("long", i - (i % 20 == 0)) for i in range(n)],
        "far": [("long", 2**62 + i) for i in range(n)],
        "wide": [("decimal(38,0)", 10**30 + i) for i in range(n)],
        "whole": [("double", float(i)) for i in range(n)],
        "huge": [("double", 2.0**60 + 1024.0 * i) for i in range(n)],
        "gaps": [("long", None if i % 40 == 0 else i) for i in range(n)],
    }
    from decimal import Decimal
    names = list(columns)
    rows = [tuple(Decimal(columns[c][i][1]) if columns[c][i][0].startswith("dec") else columns[c][i][1] for c in names) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {columns[c][0][0]}" for c in names)).repartition(4)
    for part in (names, [c for c in names if c != "wide"]):
        facts = D.column_facts(df.select(*part))
        for c in part:
            values = [v for _, v in columns[c]]
            candidate = len({v for v in values if v is not None}) >= 0.95 * n
            assert facts[c].sequential is (candidate and plain_sequential(values)), c


def test_first_rule_that_fits_decides():
    class Facts:
        a, b, flag, none = 3, 0.5, True, None
    rules = (Rule("missing", least={"none": 0}), Rule("low", below={"a": 3}), Rule("yes", {"flag": True}, {"a": 3}), Rule("rest"))
    assert decide(rules, Facts()) == "yes" and fitting(rules, Facts()) == ["yes", "rest"]
    assert decide(rules[:2], Facts()) is None and decide((Rule("no", {"none": True}),), Facts()) is None


def test_map_columns_pass_through_cleaning(spark):
    df = spark.range(0, 6).select(
        (F.col("id") % 3).alias("k"), F.when(F.col("id") != 1, F.create_map(F.lit("x"), F.col("id") % 3, F.lit("y"), F.lit(1))).alias("m"),
        F.array(F.create_map(F.lit("z"), F.col("id") % 3)).alias("ms"), F.struct(F.create_map(F.lit(1), F.col("id") % 3).alias("q")).alias("s"))
    out, _ = C.drop_duplicate_rows(df)
    assert out.dtypes == df.dtypes and out.count() == 4  # ids 0 = 3, 2 = 5; 1 and 4 differ by the null map
    other = df.select("k", F.map_from_arrays(F.array(F.lit("y"), F.lit("x")), F.array(F.lit(1).cast("long"), F.col("k"))).alias("m"))
    same = df.where("id <> 1") if "id" in df.columns else df.where("m IS NOT NULL")
    both = same.select("k", F.map_from_arrays(F.array(F.lit("x"), F.lit("y")), F.array(F.col("k"), F.lit(1).cast("long"))).alias("m")).union(other)
    assert C.drop_duplicate_rows(both)[0].count() == 3  # entries in another order are the same map
    assert Q.duplicate_rows(df).first()["count"] == 2
    cleaned, log = PL.clean(df)
    assert cleaned.count() == 4 and any(e.details.get("rows_removed") == 2 for e in log)
