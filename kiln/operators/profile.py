"""Column profiling and role detection (PRF-*, AGG-9, AGG-21).

One shared statistics pass per report. Name rules run on the driver over the
schema; value rules are aggregates. Nothing here collects data rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import names as N
from kiln.functions.exprs import (
    pyround,
    BOOLEAN_LITERALS,
    as_text,
    col,
    is_numeric_type,
    is_string_type,
    is_timestamp_type,
    parse_timestamp,
    strip,
)
from kiln.operators.quality import _orderable, _report, text_ratios
from kiln.operators.stats import distinct_counts, missing, numeric_stats, numeric_view

# ---- fixed values: thresholds ----------------------------------------------
CATEGORICAL_UNIQUE_MAX = 50
CATEGORICAL_RATIO_MAX = 0.05
DATETIME_PARSE_RATIO = 0.8
IDENTIFIER_UNIQUE_RATIO = 0.95
HIGH_CARDINALITY_UNIQUE = 50
HIGH_CARDINALITY_RATIO = 0.5
EXAMPLE_MAX_LEN = 80
MIN_NUMERIC_FOR_IQR = 8
# ---- end of fixed values ----------------------------------------------------


# --------------------------------------------------------------------- AGG-9
def numeric_report(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per numeric column: missing, distinct, min/max/mean/median/std, G1 skew,
    zero/negative counts, integer-like, IQR fences and outlier count.

    Pass 1 (one aggregate job) fits moments and quartiles; pass 2 is a lazy
    aggregate that counts values outside the fitted fences.
    """
    names = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    st = numeric_stats(df, names, distinct=True, quantiles=(0.25, 0.5, 0.75), exact=exact)
    rows = []
    for c in names:
        s = st[c]
        v = numeric_view(df, c)
        q1, q3 = s.quantiles.get(0.25), s.quantiles.get(0.75)
        fenced = (s.non_null >= MIN_NUMERIC_FOR_IQR and q1 is not None and q3 - q1 != 0)
        lo = q1 - 1.5 * (q3 - q1) if fenced else None
        hi = q3 + 1.5 * (q3 - q1) if fenced else None
        outl = (F.count_if((v < F.lit(lo)) | (v > F.lit(hi))) if fenced
                else F.lit(None).cast("long"))
        rows.append(F.struct(
            F.lit(c).alias("column_name"),
            F.lit(s.non_null).cast("long").alias("non_null"),
            F.lit(s.distinct).cast("long").alias("distinct_count"),
            _r(s.min).alias("min"), _r(s.max).alias("max"), _r(s.mean).alias("mean"),
            _r(s.quantiles.get(0.5)).alias("median"), _r(s.std_pop).alias("std"),
            _r(s.skew if s.skew is not None else (0.0 if s.non_null else None)).alias("skewness"),
            F.lit(s.zeros).cast("long").alias("zero_count"),
            F.lit(s.negatives).cast("long").alias("negative_count"),
            F.lit(s.integer_like).alias("integer_like"),
            _r(lo).alias("lower_bound"), _r(hi).alias("upper_bound"),
            outl.cast("long").alias("outlier_count"),
        ))
    rep = _report(df, rows)
    miss = F.col("n_rows") - F.col("non_null")
    return rep.select(
        "column_name", miss.cast("long").alias("missing_count"),
        F.when(F.col("n_rows") > 0, pyround(miss * 100.0 / F.col("n_rows"), 2)).alias("missing_percentage"),
        "non_null", "distinct_count", "min", "max", "mean", "median", "std", "skewness",
        "zero_count", "negative_count", "integer_like", "lower_bound", "upper_bound", "outlier_count")


def _r(x: float | None, digits: int = 4) -> Column:
    if x is None:
        return F.lit(None).cast("double")
    return pyround(F.lit(float(x)), digits)


# ------------------------------------------------------------ PRF-1 .. PRF-4
def _bool_like(df: DataFrame, c: str, distinct: int) -> Column:
    """Boolean dtype, or <= 4 distinct values all in the boolean literal set."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.BooleanType):
        return F.lit(True)
    if distinct > 4:
        return F.lit(False)
    t = F.lower(strip(as_text(col(c), dt)))
    nn = F.count(F.when(~missing(df, c), col(c)))
    return (nn > 0) & F.coalesce(F.bool_and(F.when(~missing(df, c), t.isin(*BOOLEAN_LITERALS))), F.lit(False))


def semantic_type_expr(df: DataFrame, c: str, distinct: int, n_rows: Column, datetime_like: float) -> Column:
    """Profile type: boolean -> datetime -> numerical -> categorical -> text."""
    dt = df.schema[c].dataType
    dtl = F.lit(is_timestamp_type(dt) or datetime_like >= DATETIME_PARSE_RATIO)
    cat = (F.lit(distinct <= CATEGORICAL_UNIQUE_MAX)
           | ((n_rows > 0) & (F.lit(distinct) / n_rows <= CATEGORICAL_RATIO_MAX)))
    return (F.when(_bool_like(df, c, distinct), F.lit("boolean"))
            .when(dtl, F.lit("datetime"))
            .when(F.lit(is_numeric_type(dt)), F.lit("numerical"))
            .when(cat, F.lit("categorical"))
            .otherwise(F.lit("text")))


def _dtype_label(dt: T.DataType) -> str:
    return dt.simpleString()


def profile_columns(df: DataFrame) -> DataFrame:
    """Column summary: dtype, non-null, null, distinct, example, semantic type.

    The example is the smallest non-null value as text (an order-free stand-in
    for "first non-null"), cut to 80 characters.
    """
    rows = []
    n_rows = F.count(F.lit(1))
    dist = distinct_counts(df, [c for c in df.columns if _orderable(df.schema[c].dataType)])
    texts = text_ratios(df, [c for c in df.columns if is_string_type(df.schema[c].dataType)])
    for c in df.columns:
        dt = df.schema[c].dataType
        ok = _orderable(dt)
        v = F.when(~missing(df, c), col(c))
        nd = F.lit(dist[c]).cast("long") if ok else F.lit(None).cast("long")
        ex = F.min(as_text(v, dt)) if ok else F.lit(None).cast("string")
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.lit(_dtype_label(dt)).alias("data_type"),
            F.count(v).alias("non_null_count"), F.count_if(missing(df, c)).alias("null_count"),
            nd.alias("unique_values"), ex.alias("example_raw"),
            (semantic_type_expr(df, c, dist[c], n_rows, texts[c].datetime_like if c in texts else 0.0) if ok else F.lit("text")).alias("semantic_type")))
    rep = _report(df, rows)
    ex = F.col("example_raw")
    example = F.when(F.length(ex) <= EXAMPLE_MAX_LEN, ex).otherwise(
        F.concat(F.substring(ex, 1, EXAMPLE_MAX_LEN - 3), F.lit("...")))
    return rep.select("column_name", "data_type",
                      F.col("non_null_count").cast("long").alias("non_null_count"),
                      F.col("null_count").cast("long").alias("null_count"),
                      F.col("unique_values").cast("long").alias("unique_values"),
                      example.alias("example_value"), "semantic_type", "n_rows")


# ------------------------------------------------------------ PRF-5 .. PRF-8
def identifier_columns(profile: DataFrame) -> DataFrame:
    """ID-like name, or > 1 distinct and distinct/rows >= 0.95."""
    names = [r["column_name"] for r in profile.select("column_name").collect()]
    id_names = [c for c in names if N.is_identifier_name(c)]
    by_name = F.col("column_name").isin(*id_names) if id_names else F.lit(False)
    unique = ((F.col("n_rows") > 1) & (F.col("unique_values") > 1)
              & (F.col("unique_values") / F.col("n_rows") >= IDENTIFIER_UNIQUE_RATIO))
    return (profile.where(by_name | unique)
            .select("column_name", by_name.alias("name_match"), unique.alias("high_uniqueness")))


def target_candidates(df: DataFrame) -> DataFrame:
    """Columns whose name matches target/label patterns (schema rule only)."""
    rows = [(c,) for c in df.columns if N.is_target_name(c)]
    return df.sparkSession.createDataFrame(rows, "column_name string")


def high_cardinality(profile: DataFrame) -> DataFrame:
    """Categorical/text columns with > 50 distinct or distinct/rows > 0.5."""
    ratio = F.col("unique_values") / F.col("n_rows")
    return (profile.where(~F.col("semantic_type").isin("numerical", "boolean", "datetime")
                          & (F.col("n_rows") > 0)
                          & ((F.col("unique_values") > HIGH_CARDINALITY_UNIQUE)
                             | (ratio > HIGH_CARDINALITY_RATIO)))
            .select("column_name", F.col("unique_values").alias("unique_count")))


def column_types(profile: DataFrame) -> DataFrame:
    """Columns per semantic type: how many, and their names in order."""
    return (profile.groupBy("semantic_type")
            .agg(F.count(F.lit(1)).cast("long").alias("n_columns"),
                 F.array_join(F.sort_array(F.collect_list("column_name")), ",").alias("columns")))


def profile(df: DataFrame) -> dict[str, DataFrame]:
    """PIP-1: the whole profile from one shared summary pass."""
    report = profile_columns(df)
    summary = df.sparkSession.createDataFrame(report.collect(), report.schema)  # one row per column
    return {
        "column_summaries": summary,
        "column_types": column_types(summary),
        "identifier_columns": identifier_columns(summary),
        "potential_target_columns": target_candidates(df),
        "constant_columns": summary.where(F.col("unique_values") <= 1).select("column_name"),
        "high_cardinality_columns": high_cardinality(summary),
    }


def profile_report(parts: dict[str, DataFrame]) -> DataFrame:
    """PIP-1 as one table: (section, item, detail), one row per column and finding."""
    lines = {"column_types": ("semantic_type", "columns"), "identifier_columns": ("column_name", None),
             "potential_target_columns": ("column_name", None), "constant_columns": ("column_name", None),
             "high_cardinality_columns": ("column_name", "unique_count")}
    frames = [parts[k].select(F.lit(k).alias("section"), F.col(item).alias("item"),
                              (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))
              for k, (item, detail) in lines.items()]
    return reduce(DataFrame.unionByName, frames)


# -------------------------------------------------------------------- AGG-21
def datetime_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per datetime column: min/max date, distinct dates, range days, time part, parse counts."""
    if not names:
        raise ValueError("report needs at least one column")
    # every value is parsed once, and a row per date and column goes on
    cells = F.array(*[F.struct(F.lit(i).alias("i"), (~missing(df, c)).cast("int").alias("there"), F.col(f"__kiln_t{i}").alias("t"))
                      for i, c in enumerate(names)])
    parsed = df.select("*", *[parse_timestamp(col(c), df.schema[c].dataType).alias(f"__kiln_t{i}") for i, c in enumerate(names)])
    timed = (F.hour("t") + F.minute("t") + F.second("t")) != 0
    dates = parsed.select(F.inline(cells)).groupBy("i", F.to_date("t").alias("date")).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.bool_or(timed).alias("timed"), F.count("t").alias("k"),
        F.sum("there").alias("there"))
    found = dates.groupBy("i").agg(
        F.min("lo").alias("min_date"), F.max("hi").alias("max_date"), F.count("date").alias("unique_dates"),
        F.coalesce(F.bool_or("timed"), F.lit(False)).alias("has_time"), F.sum("k").alias("parseable_count"),
        (F.sum("there") - F.sum("k")).alias("invalid_count"))
    every = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column_name string")  # a table may have no rows
    rep = every.join(found, "i", "left").na.fill(0, ["unique_dates", "parseable_count", "invalid_count"]).na.fill(False, ["has_time"])
    days = (F.unix_micros(F.col("max_date").cast("timestamp"))
            - F.unix_micros(F.col("min_date").cast("timestamp"))) / 86400e6
    return rep.select("column_name", "min_date", "max_date",
                      F.col("unique_dates").cast("long").alias("unique_dates"),
                      pyround(days, 2).alias("date_range_days"), "has_time",
                      F.col("parseable_count").cast("long").alias("parseable_count"),
                      F.col("invalid_count").cast("long").alias("invalid_count"))


# --------------------------------------------------------------------- PRF-9
def overview(df: DataFrame, profile_df: DataFrame | None = None) -> DataFrame:
    """Counts per semantic type, first target by priority, and the problem type."""
    from kiln.operators.select import detect_target, target_task

    prof = profile_df if profile_df is not None else profile_columns(df)
    counts = {r["semantic_type"]: r["n"] for r in
              prof.groupBy("semantic_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    target = detect_target(df)
    problem = None
    if target is not None:
        d = df.agg(F.count_distinct(col(target))).first()[0]
        if d == 2:
            problem = "binary_classification"
        elif target_task(df, target) == "classification":
            problem = "multiclass_classification"
        else:
            problem = "regression"
    row = (counts.get("numerical", 0), counts.get("categorical", 0), counts.get("datetime", 0),
           counts.get("text", 0), counts.get("boolean", 0), target, problem)
    return df.sparkSession.createDataFrame([row], "numerical long, categorical long, datetime long, text long, "
                                                  "boolean long, target string, problem_type string")
