"""Column statistics computed in as few Spark jobs as possible.

Every statistic here is an aggregate over the whole table: a single
``df.agg(...)`` whose result is one row of numbers per column, so the driver
only ever sees O(columns) values. Aggregates are partial (map-side combine)
so the shuffle carries one small buffer per partition, not rows.

Quantiles are exact (see ``quantiles``). ``exact=False`` uses ``percentile_approx``
(rank error 1/accuracy). Distinct counts are exact; callers that compare them with a
limit use ``distinct_up_to``, which counts only columns that a sketch cannot rule out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import (
    as_double,
    cells,
    col,
    is_double_type,
    is_integral_type,
    is_numeric_type,
    parse_number,
)

APPROX_ACCURACY = 100_000
#: Registers of a distinct sketch (as a power of two) and its standard error, 0.83 / 2^(k / 2).
SKETCH_LOG_K = 12
SKETCH_ERROR = 0.013


def _k(i: int, name: str) -> str:
    return f"c{i}__{name}"


def numeric_view(df: DataFrame, name: str, coerce: bool = False) -> Column:
    """Double view of a column (numeric dtype, or coerced text when asked)."""
    dt = df.schema[name].dataType
    if is_numeric_type(dt):
        return as_double(col(name), dt)
    if coerce:
        return parse_number(col(name), dt)
    return F.lit(None).cast("double")


@dataclass
class NumericStats:
    name: str
    n_rows: int
    non_null: int
    distinct: int | None = None
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std_pop: float | None = None
    skew: float | None = None
    zeros: int = 0
    negatives: int = 0
    non_integral: int = 0
    quantiles: dict[float, float] = field(default_factory=dict)

    @property
    def integer_like(self) -> bool:
        return self.non_null > 0 and self.non_integral == 0


def numeric_stats(df: DataFrame, names: list[str], coerce: bool = False,
                  distinct: bool = True, quantiles: tuple[float, ...] = (),
                  exact: bool = True) -> dict[str, NumericStats]:
    """One aggregate job: counts, moments, min/max, quantiles per column."""
    if not names:
        return {}
    views = {n: numeric_view(df, n, coerce) for n in names}
    v = F.col("v")
    # integral test as numpy allclose(v, round(v)): |v-r| <= 1e-8 + 1e-5*|r|
    r = F.rint(v)
    # moments only: a plain HashAggregate stays in whole-stage codegen; quantile
    # aggregates are imperative and would drag every function out of codegen
    rows = {x["i"]: x for x in cells(df, list(views.values())).groupBy("i").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(v).alias("nn"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.skewness(v).alias("skew"), F.count_if(v == 0).alias("zero"),
        F.count_if(v < 0).alias("neg"), F.count_if(F.abs(v - r) > F.lit(1e-8) + F.lit(1e-5) * F.abs(r)).alias("frac"),
    ).collect()}  # one row per column, none without rows
    qv: dict[str, dict[float, float | None]] = {}
    nd: dict[str, int] = {}
    if quantiles and exact and distinct:
        from kiln.operators.quantiles import quantiles_and_distinct
        # doubles merge long whole numbers and decimals beyond 2^53: a key beside them tells those apart
        keys = {n: col(n) if is_integral_type(t) else F.xxhash64(col(n)) for n in names
                if is_numeric_type(t := df.schema[n].dataType) and not is_double_type(t) and t.typeName() != "boolean"}
        qv, _, nd = quantiles_and_distinct(df, views, tuple(quantiles), keys)
    elif quantiles and exact:
        from kiln.operators.quantiles import value_quantiles
        qv, _ = value_quantiles(df, views, tuple(quantiles))
    elif quantiles:
        probs = F.array(*[F.lit(float(p)) for p in quantiles])
        qrow = df.agg(*[F.percentile_approx(views[n], probs, APPROX_ACCURACY).alias(f"q{i}")
                        for i, n in enumerate(names)]).first()
        qv = {n: dict(zip(quantiles, qrow[f"q{i}"] or [None] * len(quantiles))) for i, n in enumerate(names)}
    if distinct and not nd:  # numbers as they are, since doubles merge long ones beyond 2^53
        nd = distinct_counts(df, names, values={n: views[n] for n in names
                                                if not is_numeric_type(df.schema[n].dataType)})
    out: dict[str, NumericStats] = {}
    empty = dict.fromkeys(("min", "max", "mean", "std", "skew")) | dict.fromkeys(("n_rows", "nn", "zero", "neg", "frac"), 0)
    for i, name in enumerate(names):
        row = rows.get(i, empty)
        nn = int(row["nn"])
        pop = row["skew"]
        skew = None
        if nn >= 3 and pop is not None:
            skew = float(pop) * (nn * (nn - 1)) ** 0.5 / (nn - 2)
        st = NumericStats(
            name=name, n_rows=int(row["n_rows"]), non_null=nn,
            distinct=nd.get(name) if distinct else None,
            min=row["min"], max=row["max"], mean=row["mean"],
            std_pop=row["std"], skew=skew,
            zeros=int(row["zero"]), negatives=int(row["neg"]),
            non_integral=int(row["frac"]),
        )
        found = qv.get(name, {})
        if found and all(x is not None for x in found.values()):
            st.quantiles = {p: float(found[p]) for p in quantiles}
        out[name] = st
    return out


def quartile_stats(df: DataFrame, names: list[str], coerce: bool = False,
                   quantiles: tuple[float, ...] = (0.25, 0.75)) -> dict[str, NumericStats]:
    """Non-null counts and exact quantiles only (no moments), as IQR fences need them."""
    from kiln.operators.quantiles import value_quantiles
    if not names:
        return {}
    qs, nn = value_quantiles(df, {n: numeric_view(df, n, coerce) for n in names}, tuple(quantiles))
    out = {}
    for n in names:
        st = NumericStats(name=n, n_rows=-1, non_null=nn[n])
        if nn[n]:
            st.quantiles = {p: float(qs[n][p]) for p in quantiles}
        out[n] = st
    return out


def null_counts(df: DataFrame, names: list[str] | None = None) -> tuple[int, dict[str, int]]:
    """Rows and missing (null or NaN) count per column, one job."""
    names = names if names is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, name in enumerate(names):
        aggs.append(F.count_if(missing(df, name)).alias(_k(i, "miss")))
    row = df.agg(*aggs).first()
    return int(row["n_rows"]), {n: int(row[_k(i, "miss")]) for i, n in enumerate(names)}


def missing(df: DataFrame, name: str) -> Column:
    """Missing = null, or NaN in a floating column (infinity is not missing)."""
    dt = df.schema[name].dataType
    c = col(name)
    if dt.typeName() in ("double", "float"):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Ingest rule: floating NaN becomes null so counts follow missing semantics."""
    exprs = []
    for f in df.schema.fields:
        c = col(f.name)
        if f.dataType.typeName() in ("double", "float"):
            exprs.append(F.when(~F.isnan(c), c).alias(f.name))
        else:
            exprs.append(c.alias(f.name))
    return df.select(*exprs)


def distinct_up_to(df: DataFrame, names: list[str], limit: int) -> dict[str, int | None]:
    """Exact distinct counts of the columns that may have ``limit`` values or fewer; None for those with more.

    A mergeable HyperLogLog sketch per column (one scan, no shuffle of values) rules
    out columns whose estimate lies ten standard errors above the limit. The others
    hold few values, which partial aggregation leaves as few rows per task.
    """
    if not names:
        return {}
    row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(_sketched(df, n), F.lit(SKETCH_LOG_K))).alias(_k(i, "nd"))
                   for i, n in enumerate(names)]).first()
    near = [n for i, n in enumerate(names) if (row[_k(i, "nd")] or 0) <= limit * (1 + 10 * SKETCH_ERROR) + 10]
    return dict.fromkeys(names) | distinct_counts(df, near)


def _sketched(df: DataFrame, name: str) -> Column:
    """What a distinct sketch takes of a column: a hash of its non-missing value."""
    return F.when(~missing(df, name), F.xxhash64(col(name)))


def distinct_counts(df: DataFrame, names: list[str], exact: bool = True,
                    values: dict[str, Column] | None = None) -> dict[str, int]:
    """Distinct non-null values per column (NaN counts as missing).

    Exact counts unpivot the columns to (column index, value) and count
    distinct pairs: one shuffle whose map side already drops repeats. This is
    much cheaper than many ``count(DISTINCT ...)`` in one aggregate, which
    makes Spark expand *every* aggregate of the job once per column. Whole
    numbers travel as long and doubles as double; every other type by 128 hash
    bits of its text, so that long texts are not shuffled.
    ``values`` may give the expression to count per name (default: the column).
    """
    if not names:
        return {}
    exprs = {n: (values or {}).get(n, F.when(~missing(df, n), col(n))) for n in names}
    if not exact:
        row = df.agg(*[F.approx_count_distinct(exprs[n], 0.01).alias(_k(i, "nd"))
                       for i, n in enumerate(names)]).first()
        return {n: int(row[_k(i, "nd")]) for i, n in enumerate(names)}
    parts = []
    no_long, no_double = F.lit(None).cast("long"), F.lit(None).cast("double")
    for i, n in enumerate(names):
        e = exprs[n]
        dt = df.select(e.alias("x")).schema["x"].dataType
        a, b, d = no_long, no_long, no_double
        if is_integral_type(dt):
            a = e.cast("long")
        elif is_double_type(dt):
            d = e.cast("double")
        else:
            t = e.cast("string")
            a, b = F.when(t.isNotNull(), F.xxhash64(t)), F.when(t.isNotNull(), F.xxhash64(F.lit("2"), t))
        parts.append(F.struct(F.lit(i).alias("i"), a.alias("a"), b.alias("b"), d.alias("d")))
    pairs = (df.select(F.inline(F.array(*parts))).where(F.col("a").isNotNull() | F.col("d").isNotNull()).distinct())
    counts = {r["i"]: r["k"] for r in pairs.groupBy("i").agg(F.count(F.lit(1)).alias("k")).collect()}
    return {n: int(counts.get(i, 0)) for i, n in enumerate(names)}
