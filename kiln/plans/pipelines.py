"""Composite pipelines (PIP-4, PIP-6, PIP-8, PIP-13/14) and the stage flow.

``clean`` runs the reference's fixed step order; every step fits a few
literals with aggregate jobs and adds one projection or filter to the plan.
``run_stages`` chains raw -> cleaned -> feature_engineered -> feature_selected,
writing each stage once under a shared root and reading it back, which also
cuts the lineage between stages (executor loss replays at most one stage).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.operators import clean as C
from kiln.operators import features as FE
from kiln.operators import impute as I
from kiln.operators import quality as Q
from kiln.operators import select as S
from kiln.operators.stats import null_counts
from kiln.session import scratch, staged
from kiln.sources import io


@dataclass(frozen=True)
class CleaningConfig:
    # fixed values: the reference's default cleaning options
    handle_empty_strings: bool = True
    convert_safe_dtypes: bool = True
    handle_invalid_values: bool = True
    remove_duplicate_columns: bool = True
    handle_missing_values: bool = True
    remove_duplicate_rows: bool = True
    handle_outliers: bool = True
    outlier_strategy: str = "flag"
    remove_constant_columns: bool = False
    impute: I.ImputeConfig = field(default_factory=I.ImputeConfig)


def clean(df: DataFrame, cfg: CleaningConfig | None = None,
          key: str | list[str] | None = None) -> tuple[DataFrame, list[C.LogEntry]]:
    """PIP-4: names -> empty strings -> types -> domain rules -> duplicate columns ->
    impute -> duplicate rows -> outliers -> constants (identifiers are never dropped)."""
    cfg = cfg or CleaningConfig()
    log: list[C.LogEntry] = []
    out = io.dedup_column_names(df)
    steps = []
    if cfg.handle_empty_strings:
        steps.append(C.normalize_empty_strings)
    if cfg.convert_safe_dtypes:
        steps.append(C.convert_types)
    if cfg.handle_invalid_values:
        steps.append(lambda d: C.null_domain_invalid(d, keep_flags=cfg.handle_missing_values))
    steps.append(lambda d: C.drop_duplicate_columns(d, cfg.remove_duplicate_columns))
    if cfg.handle_missing_values:
        steps.append(lambda d: I.impute_missing(d, cfg.impute, key))
    if cfg.remove_duplicate_rows:
        steps.append(C.drop_duplicate_rows)
    if cfg.handle_outliers:
        steps.append(lambda d: C.handle_outliers(d, cfg.outlier_strategy))
    steps.append(lambda d: C.drop_constant_columns(d, cfg.remove_constant_columns))
    for step in steps:
        out, entries = step(out)
        log += entries
        if step is C.drop_duplicate_rows:
            # the fits below read the imputed table: write it once instead of imputing again for each
            out = staged(out, "cleaning")
            # no step before this one adds or drops rows; both counts read no column
            log[-1].details["rows_removed"] = df.count() - out.count()
    out = out.drop(*[c for c in out.columns if c.endswith(C.INVALID_FLAG)])
    # PRJ-10: identifier columns are never dropped by cleaning; note them
    from kiln.functions import names as N
    for c in out.columns:
        if N.is_identifier_name(c):
            log.append(C.LogEntry("identifier_column_retained", c))
    return out, log


#: log operations that only point something out; all others changed the data
FLAG_OPERATIONS = frozenset(("identifier_column_retained", "duplicate_column_retained", "constant_columns_retained",
                             "outliers_flagged", "high_missing_column_review", "all_null_column_review",
                             "categorical_imputation_review"))
_CELL_COUNTS = ("count", "before_missing", "empty_strings_converted", "before_invalid", "outlier_count", "rows_removed")


def issues(log: list[C.LogEntry], spark: SparkSession) -> DataFrame:
    """One row per log entry: whether it was (or will be) fixed or only flagged, and the cells or rows concerned."""
    rows = []
    for e in log:
        n = next((int(e.details[k]) for k in _CELL_COUNTS if k in e.details), None)
        rows.append(("flag" if e.operation in FLAG_OPERATIONS else "fix", e.operation, e.column, n))
    return spark.createDataFrame(rows, "kind string, operation string, column string, cells long")


def clean_summary(before: DataFrame, after: DataFrame, log: list[C.LogEntry]) -> DataFrame:
    """PIP-7: rows (section, item, before, after).

    ``metric``: snapshot numbers; ``transition``: missing cells per column that
    changed; ``fix`` / ``flag``: logged operations with the cells concerned.
    """
    spark = before.sparkSession
    b, a = (Q.snapshot(x).first() for x in (before, after))
    rows = [("metric", k, int(b[k]), int(a[k])) for k in ("rows", "columns", "total_missing", "duplicate_rows",
                                                           "outlier_cells")]
    changed = {e.column for e in log if e.column and e.operation not in FLAG_OPERATIONS}
    rows.append(("metric", "modified_columns", 0, len(changed)))
    _, had = null_counts(before)
    _, has = null_counts(after)
    rows += [("transition", f"missing:{c}", had[c], has[c]) for c in before.columns if c in has and had[c] != has[c]]
    totals = issues(log, spark).groupBy("kind", "operation").agg(F.sum("cells").alias("n")).orderBy("kind", "operation")
    for r in totals.collect():  # one row per kind of log entry
        rows.append((r["kind"], r["operation"], r["n"], 0 if r["kind"] == "fix" else r["n"]))
    return spark.createDataFrame(rows, "section string, item string, before long, after long")


def candidates(df: DataFrame) -> DataFrame:
    """PIP-9: dry run of feature engineering: what would be created, with priority
    HIGH for log and ratio features, MEDIUM otherwise. Only the fit jobs run and nothing is written."""
    with scratch(df.sparkSession, write=False):
        _, rep = FE.engineer(df)
    rows = [(g["feature"], g.get("source"), g.get("transformation"),
             "HIGH" if g.get("transformation") in ("log1p", "ratio") else "MEDIUM") for g in rep.generated]
    return df.sparkSession.createDataFrame(rows, "feature string, source string, transformation string, "
                                                 "priority string")


def preview_clean(df: DataFrame, cfg: CleaningConfig | None = None,
                  key: str | list[str] | None = None) -> dict[str, DataFrame]:
    """PIP-6: findings before cleaning, the planned log, and what it would fix or only flag; nothing is written."""
    spark = df.sparkSession
    with scratch(spark, write=False):
        _, log = clean(df, cfg, key)
        planned = issues(log, spark)
        return {"missing": Q.missing_values(df), "duplicate_rows": Q.duplicate_rows(df),
                "outliers": Q.iqr_outliers(df, coerce=False), "planned_log": C.log_frame(spark, log),
                "issues_to_fix": planned.where("kind = 'fix'").drop("kind"),
                "issues_to_flag": planned.where("kind = 'flag'").drop("kind")}


def run_stages(spark: SparkSession, raw: DataFrame, root: str, target: str | None = None,
               key: str | list[str] | None = None, selected: list[str] | None = None,
               cfg: CleaningConfig | None = None, resume: bool = False) -> dict[str, str]:
    """Write raw -> cleaned -> feature_engineered -> feature_selected, each read back
    from its checkpoint before the next stage starts.

    Every write observes the row count and content hash of what it writes, and each
    stage is held against the manifest of the one before: cleaning may only lose the
    rows that its log says, engineering must leave original columns and rows as they
    were, selection must keep the rows. Intermediate tables are gone after each stage.
    With ``resume`` stages stay that are whole and were made by the same step and
    parameters from the same input; the first other one and those after it are made anew.
    """
    cfg = cfg or CleaningConfig()
    steps: list[tuple[str, str, Callable[[DataFrame | None], _Made]]] = [
        ("raw", "", lambda _: _Made(raw)),
        ("cleaned", repr((cfg, key)), lambda d: _clean_stage(d, cfg, key)),
        ("feature_engineered", repr(selected), lambda d: _feature_stage(d, selected)),
        ("feature_selected", repr(target), lambda d: _selection_stage(d, target))]
    paths: dict[str, str] = {}
    before: io.Manifest | None = None
    for at, (name, params, make) in enumerate(steps):
        paths[name] = io.stage_path(root, name)
        plan = hashlib.sha256(f"{name}|{params}".encode()).hexdigest()
        origin = before.content_hash if before else ""
        had = io.read_manifest(spark, root, name) if resume else None
        if had is not None and (had.plan, had.input_hash) == (plan, origin) and (
                at or had.content_hash == io.frame_fingerprint(raw).first()["content_hash"]):
            before = had
            continue
        if resume:
            for stale, _, _ in reversed(steps[at:]):
                io.drop_stage(spark, root, stale)
                io.drop_report(spark, root, REPORTS.get(stale))
            resume = False
        with scratch(spark):
            made = make(io.read_stage(spark, root, steps[at - 1][0]) if at else None)
            io.write_stage(made.df, root, name, plan=plan, input_hash=origin, keep=made.keep)
            now = io.read_manifest(spark, root, name)
            wrong = _violation(made, before, now)
            if wrong:
                io.drop_stage(spark, root, name)
                raise io.PipelineStateError(wrong)
            if made.report is not None:
                io.write_report(made.report, root, REPORTS[name])
        before = now
    return paths


REPORTS = {"cleaned": "cleaning_log", "feature_engineered": "feature_engineering", "feature_selected": "feature_selection"}


@dataclass
class _Made:
    """A stage to be written: its table, report, the columns that must be as in its input, and rows it may lose."""
    df: DataFrame
    report: DataFrame | None = None
    keep: list[str] | None = None
    lost_rows: int = 0


def _clean_stage(df: DataFrame, cfg: CleaningConfig, key: str | list[str] | None) -> _Made:
    out, log = clean(df, cfg, key)
    lost = sum(int(e.details.get("rows_removed", 0)) for e in log)
    return _Made(out, C.log_frame(df.sparkSession, log), lost_rows=lost)


def _feature_stage(df: DataFrame, selected: list[str] | None) -> _Made:
    out, rep = FE.engineer(df, selected)
    return _Made(out, rep.frame(df.sparkSession), keep=df.columns)


def _selection_stage(df: DataFrame, target: str | None) -> _Made:
    analysis = S.analyze_selection(df, target)
    return _Made(S.apply_selection(df, analysis["decisions"], S.detect_target(df, target)), analysis["decisions"])


def _violation(made: _Made, before: io.Manifest | None, now: io.Manifest) -> str | None:
    """What is wrong with a stage by what its write observed."""
    if before is not None and now.rows != before.rows - made.lost_rows:
        return (f"Stage '{now.stage}' has {now.rows} rows; '{before.stage}' had {before.rows}, of which "
                f"{made.lost_rows} were removed.")
    if made.keep is not None and now.kept_hash != before.content_hash:
        return f"Stage '{now.stage}' changed columns of '{before.stage}'."
    return None
