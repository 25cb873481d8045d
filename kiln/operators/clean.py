"""Cleaning transforms (PRJ-*, FLT-*, PIP-5).

Each step is *fit* (zero or one aggregate job whose result is a handful of
per-column literals) followed by *transform* (one lazy ``select``/``filter``).
Steps return ``(DataFrame, list[LogEntry])``; log entries are per-column
records, never data rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions import names as N
from kiln.functions.exprs import (
    col,
    comparable,
    is_numeric_type,
    is_string_type,
    parse_number,
    parse_timestamp,
    strip,
)
from kiln.operators.quality import (
    _orderable,
    constant_columns,
    duplicate_column_map,
    iqr_bounds,
    outlier_mask,
    text_ratios,
)
from kiln.operators.stats import numeric_view

# ---- fixed values: thresholds ----------------------------------------------
NUMERIC_CONVERT_RATIO = 0.95
DATETIME_CONVERT_RATIO = 0.90
DATETIME_LIKE_RATIO = 0.8
MAX_PLAUSIBLE_AGE = 120
MAX_CHANGE_SAMPLES = 8
# ---- end of fixed values ----------------------------------------------------


@dataclass
class LogEntry:
    operation: str
    column: str | None = None
    details: dict[str, Any] = field(default_factory=dict)


LOG_SCHEMA = "operation string, column string, details map<string,string>"


def log_frame(spark, log: list[LogEntry]) -> DataFrame:
    rows = [(e.operation, e.column, {k: str(v) for k, v in e.details.items()}) for e in log]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def _replace(df: DataFrame, updates: dict[str, Column]) -> DataFrame:
    """Replace some columns in place (schema order kept) in one projection."""
    return df.select(*[updates[c].alias(c) if c in updates else col(c) for c in df.columns])


# --------------------------------------------------------------------- PRJ-1
def normalize_empty_strings(df: DataFrame) -> tuple[DataFrame, list[LogEntry]]:
    """Empty or whitespace-only strings become null; count per column."""
    texts = [c for c in df.columns if is_string_type(df.schema[c].dataType)]
    if not texts:
        return df, []
    blank = {c: col(c).isNotNull() & (strip(col(c)) == "") for c in texts}
    row = df.agg(*[F.count_if(blank[c]).alias(f"b{i}") for i, c in enumerate(texts)]).first()
    hit = {c: int(row[f"b{i}"]) for i, c in enumerate(texts) if row[f"b{i}"]}
    log = [LogEntry("empty_string_normalization", c, {"empty_strings_converted": n})
           for c, n in hit.items()]
    updates = {c: F.when(~blank[c], col(c)) for c in hit}
    return _replace(df, updates), log


# --------------------------------------------------------------- PRJ-2 / 3
def convert_types(df: DataFrame, numeric_ratio: float = NUMERIC_CONVERT_RATIO,
                  datetime_ratio: float = DATETIME_CONVERT_RATIO) -> tuple[DataFrame, list[LogEntry]]:
    """Text -> double when >= 95 % of non-null values parse; else text -> timestamp
    when datetime-like and >= 90 % parse. Failed values become null."""
    texts = [c for c in df.columns if is_string_type(df.schema[c].dataType)]
    if not texts:
        return df, []
    updates, log = {}, []
    for c, r in text_ratios(df, texts).items():
        dt = df.schema[c].dataType
        numeric = r.share(r.numbers)
        if r.values and numeric >= numeric_ratio:
            updates[c] = parse_number(col(c), dt)
            log.append(LogEntry("dtype_conversion", c, {"old_dtype": "string", "new_dtype": "double",
                                                        "conversion_ratio": round(numeric, 4)}))
        elif r.values and r.datetime_like >= DATETIME_LIKE_RATIO and r.share(r.timestamps) >= datetime_ratio:
            updates[c] = parse_timestamp(col(c), dt)
            log.append(LogEntry("dtype_conversion", c, {"old_dtype": "string", "new_dtype": "timestamp"}))
    return _replace(df, updates), log


# --------------------------------------------------------------------- PRJ-4
def domain_rule(name: str) -> tuple[str, Any] | None:
    """First matching name rule: (issue type, predicate builder over a double)."""
    if N.matches(N.CLEAN_AGE, name):
        return "impossible_age", lambda v: (v < 0) | (v > MAX_PLAUSIBLE_AGE)
    if N.matches(N.CLEAN_SALARY, name):
        return "negative_salary", lambda v: v < 0
    if N.matches(N.CLEAN_QUANTITY, name):
        return "negative_quantity", lambda v: v < 0
    return None


INVALID_FLAG = "__invalid__"


def null_domain_invalid(df: DataFrame, keep_flags: bool = False) -> tuple[DataFrame, list[LogEntry]]:
    """Domain-invalid values become null; hit columns are coerced to numeric.

    With ``keep_flags`` a boolean ``<c>__invalid__`` column marks the nulled
    cells so later imputation can report fills that came from invalid values.
    """
    rules = {}
    for c in df.columns:
        r = domain_rule(c)
        if r is not None and _orderable(df.schema[c].dataType):
            rules[c] = r
    if not rules:
        return df, []
    masks = {c: F.coalesce(pred(parse_number(col(c), df.schema[c].dataType)), F.lit(False))
             for c, (_, pred) in rules.items()}
    row = df.agg(*[F.count_if(m).alias(f"x{i}") for i, m in enumerate(masks.values())]).first()
    updates, log, flags = {}, [], []
    for i, (c, (issue, _)) in enumerate(rules.items()):
        n = int(row[f"x{i}"])
        if n == 0:
            continue
        dt = df.schema[c].dataType
        v = parse_number(col(c), dt)
        # numeric columns keep their type; text columns are coerced to double
        v_out = F.when(~masks[c], col(c) if is_numeric_type(dt) else v)
        updates[c] = v_out
        flags.append(masks[c].alias(c + INVALID_FLAG))
        log.append(LogEntry("invalid_value_handling", c,
                            {"issue_type": issue, "before_invalid": n, "after_invalid": 0,
                             "action": "convert_to_missing"}))
    out = df.select(*[updates[c].alias(c) if c in updates else col(c) for c in df.columns],
                    *(flags if keep_flags else []))
    return out, log


# --------------------------------------------------------------------- PRJ-6
def drop_duplicate_columns(df: DataFrame, remove: bool = True) -> tuple[DataFrame, list[LogEntry]]:
    dup_of = duplicate_column_map(df)
    op = "duplicate_column_removal" if remove else "duplicate_column_retained"
    log = [LogEntry(op, d, {"duplicate_of": o, "similarity": 100.0}) for d, o in dup_of.items()]
    return (df.drop(*dup_of.keys()) if remove and dup_of else df), log


# --------------------------------------------------------------------- PRJ-7
def drop_constant_columns(df: DataFrame, remove: bool = False) -> tuple[DataFrame, list[LogEntry]]:
    consts = [r["column_name"] for r in constant_columns(df).collect()]
    if not consts:
        return df, []
    if remove:
        return df.drop(*consts), [LogEntry("constant_column_removal", None, {"columns_removed": consts})]
    return df, [LogEntry("constant_columns_retained", None, {"columns": consts})]


# ------------------------------------------------------------------- PIP-5
def drop_duplicate_rows(df: DataFrame) -> tuple[DataFrame, list[LogEntry]]:
    """Exact duplicate rows removed (one shuffle on all columns, map-side dedup).

    Columns that hold maps, which Spark cannot compare, are compared by their entries in order of keys.
    """
    maps = {f.name: f"__kiln_map_{i}" for i, f in enumerate(df.schema.fields) if "map<" in f.dataType.simpleString()}
    if not maps:
        return df.dropDuplicates(), [LogEntry("duplicate_row_removal")]
    marked = df.select("*", *[comparable(col(c), df.schema[c].dataType).alias(m) for c, m in maps.items()])
    out = marked.dropDuplicates([maps.get(c, c) for c in df.columns])
    return out.select(*[col(c) for c in df.columns]), [LogEntry("duplicate_row_removal")]


# --------------------------------------------------------- PRJ-5, FLT-1/2
# log codes of the three strategies
OUTLIER_OPERATIONS = {"flag": "outliers_flagged", "clip": "outliers_clipped", "remove": "outliers_marked_for_removal"}


def handle_outliers(df: DataFrame, strategy: str = "flag", exact: bool = True,
                    add_flag_columns: bool = False) -> tuple[DataFrame, list[LogEntry]]:
    """IQR outliers on numeric columns: ``flag`` (report), ``clip`` or ``remove``.

    Fences are fitted for all columns before anything changes; ``remove``
    drops a row that is outside the fences in *any* numeric column.
    """
    names = [c for c in df.columns if is_numeric_type(df.schema[c].dataType)]
    bounds = iqr_bounds(df, coerce=False, exact=exact, names=names)
    if not bounds:
        return df, []
    # NaN is missing, not an outlier; booleans count as 0 and 1
    masks = {c: outlier_mask(df, c, lo, hi) for c, (lo, hi) in bounds.items()}
    anywhere = reduce(or_, masks.values())
    aggs = [F.count(F.lit(1)).alias("n"), F.count_if(anywhere).alias("rows")]
    row = df.agg(*aggs, *[F.count_if(m).alias(f"o{i}") for i, m in enumerate(masks.values())]).first()
    n = int(row["n"])
    hit = {c: int(row[f"o{i}"]) for i, c in enumerate(masks) if row[f"o{i}"]}
    log = []
    for c, k in hit.items():
        lo, hi = bounds[c]
        log.append(LogEntry(OUTLIER_OPERATIONS[strategy], c, {
            "outlier_count": k, "outlier_percentage": round(k * 100.0 / n, 2),
            "lower_bound": round(lo, 4), "upper_bound": round(hi, 4), "strategy": strategy}))
    if strategy == "flag":
        if add_flag_columns:
            return df.select("*", *[masks[c].alias(c + "__is_outlier") for c in hit]), log
        return df, log
    if strategy == "clip":
        updates = {}
        for c in hit:
            lo, hi = bounds[c]
            v = numeric_view(df, c)
            updates[c] = F.when(v < lo, F.lit(lo)).when(v > hi, F.lit(hi)).otherwise(col(c).cast("double"))
        return _replace(df, updates), log
    if strategy == "remove":
        if not hit:
            return df, log
        log.append(LogEntry("outlier_rows_removed", None, {"rows_removed": int(row["rows"])}))
        return df.where(~anywhere), log
    raise ValueError(f"unknown outlier strategy {strategy!r}")


# -------------------------------------------------------------------- PRJ-11
def change_samples(df: DataFrame, before: str, after: str, key: str | list[str],
                   n: int = MAX_CHANGE_SAMPLES) -> DataFrame:
    """Up to n changed cells (key, before, after), smallest keys first."""
    keys = [key] if isinstance(key, str) else list(key)
    changed = ~col(before).eqNullSafe(col(after))
    return (df.where(changed)
            .select(*[col(k) for k in keys], col(before).cast("string").alias("before"),
                    col(after).cast("string").alias("after"))
            .orderBy(*[col(k) for k in keys]).limit(n))
