"""Feature engineering: datetime (FED-*), numeric (FEN-*), text (FET-*), validation (FEV-*).

Each stage: detect on the schema + one statistics job, build every candidate
feature as a lazy Column, test all candidates for variation in **one**
``agg(min <> max)``, then add the survivors in one projection. Rows are never
filtered, so the row count is invariant by construction. Stages see the
columns added by earlier stages (datetime -> numeric -> text), as in the
reference.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions import names as N
from kiln.functions.pairs import DATE_RULES, RATIO_RULES, matching
from kiln.functions.exprs import (
    round_value,
    pyround,
    cells,
    char_count,
    col,
    is_numeric_type,
    is_string_type,
    is_timestamp_type,
    parse_number,
    parse_timestamp,
    word_count,
)
from kiln.operators.detect import column_facts, feature_type, is_identifier, text_kind
from kiln.operators.quality import TextRatios, text_ratios
from kiln.operators.stats import distinct_counts, missing, numeric_stats
from kiln.session import staged

# ---- fixed values: thresholds ----------------------------------------------
DATE_HINT_PARSE_RATIO = 0.5
DATETIME_LIKE_RATIO = 0.8
ABS_SKEW_THRESHOLD = 1.0
MIN_UNIQUE_FOR_LOG = 10
MIN_NON_NULL_FOR_TRANSFORM = 20
NUM_BINS = 5
MIN_UNIQUE_FOR_BINNING = 10
GENERATED_MAX_MISSING_PCT = 50.0
DAYS_PER_YEAR = 365.25
RANGE_CHECKS = (("_Month", 1, 12), ("_DayOfWeek", 0, 6), ("_IsWeekend", 0, 1))
INTEGER_SUFFIXES = ("_Year", "_Month", "_Day", "_DayOfWeek", "_IsWeekend", "_Hour", "_Minute",
                    "_CharCount", "_WordCount", "_Age_Years")
# ---- end of fixed values ----------------------------------------------------


@dataclass
class FeatureReport:
    generated: list[dict[str, Any]] = field(default_factory=list)
    skipped: list[dict[str, Any]] = field(default_factory=list)
    issues: list[dict[str, Any]] = field(default_factory=list)
    removed: list[dict[str, Any]] = field(default_factory=list)

    def frame(self, spark) -> DataFrame:
        rows = ([("generated", g["feature"], g.get("source"), g.get("transformation")) for g in self.generated]
                + [("skipped", s["feature"], s.get("source"), s.get("reason")) for s in self.skipped]
                + [("removed", r["feature"], r.get("source"), r.get("reason")) for r in self.removed]
                + [("issue", i["issue"], ",".join(i.get("columns", [])), str(i.get("count"))) for i in self.issues])
        return spark.createDataFrame(rows, "kind string, feature string, source string, detail string")


def _admit(df: DataFrame, cands: list[tuple[str, Column, dict]], selected: set[str] | None,
           rep: FeatureReport) -> DataFrame:
    """FEV-1: keep candidates that are selected, not yet present and not constant."""
    keep = []
    for name, expr, meta in cands:
        if selected is not None and name not in selected:
            rep.skipped.append({"feature": name, "source": meta.get("source"), "reason": "not_selected"})
        elif name in df.columns:
            rep.skipped.append({"feature": name, "source": meta.get("source"), "reason": "already_exists"})
        else:
            keep.append((name, expr, meta))
    if not keep:
        return df
    varies = _varying(df, [e for _, e, _ in keep])
    added = []
    for i, (name, expr, meta) in enumerate(keep):
        if i in varies:
            added.append(expr.alias(name))
            rep.generated.append({"feature": name, **meta})
        else:
            rep.skipped.append({"feature": name, "source": meta.get("source"),
                                "reason": "constant"})
    return df.select("*", *added) if added else df


def _varying(df: DataFrame, values: list[Column]) -> set[int]:
    """Which of the values take more than one distinct non-null value: one job for numbers, one for texts."""
    out: set[int] = set()
    dtypes = df.select(*[e.alias(f"v{i}") for i, e in enumerate(values)]).schema
    texts = [i for i, f in enumerate(dtypes) if is_string_type(f.dataType)]
    for own in (texts, [i for i in range(len(values)) if i not in texts]):
        if own:  # parts of dates and counts are longs far below 2^53
            of = [values[i] if own is texts else values[i].cast("double") for i in own]
            rows = cells(df, of).groupBy("i").agg((F.min("v") != F.max("v")).alias("varies")).collect()  # one row per value
            out |= {own[r["i"]] for r in rows if r["varies"]}
    return out


# ------------------------------------------------------------------ FED-1..9
def datetime_columns(df: DataFrame, ratios: dict[str, TextRatios] | None = None) -> list[str]:
    """Timestamp dtype, datetime-like text, or a date-ish name with >= 50 % parse.

    ``ratios`` takes what the text columns parse as.
    """
    ratios = ratios if ratios is not None else {}
    texts = [c for c in df.columns if is_string_type(df.schema[c].dataType)]
    out = [c for c in df.columns if is_timestamp_type(df.schema[c].dataType)]
    ratios |= text_ratios(df, texts)
    for c, r in ratios.items():
        hinted = N.matches(N.DATE_HINT, c) and r.share(r.timestamps) >= DATE_HINT_PARSE_RATIO
        if r.values and (hinted or r.datetime_like >= DATETIME_LIKE_RATIO):
            out.append(c)
    order = {c: i for i, c in enumerate(df.columns)}
    return sorted(out, key=order.get)


def date_pairs(cols: list[str], explicit: list[tuple[str, str, str]] | None = None) -> list[tuple[str, str, str]]:
    """(first, second, kind) by the date rules, then the explicit ones; each once."""
    named = [(a, b, r.kind) for r, a, b in matching(DATE_RULES, cols)]
    return list(dict.fromkeys(named + list(explicit or [])))


def engineer_datetime(df: DataFrame, selected: set[str] | None = None,
                      pairs: list[tuple[str, str, str]] | None = None,
                      keep: bool = False, ratios: dict[str, TextRatios] | None = None) -> tuple[DataFrame, FeatureReport]:
    """With ``keep`` texts are parsed once, into a staged table that all jobs read. ``ratios`` takes what they parse as."""
    rep = FeatureReport()
    dcols = datetime_columns(df, ratios)
    if not dcols:
        return df, rep
    # parse each column once into a hidden column; the derived parts read it
    # (Catalyst does not re-inline an expensive expression used many times)
    hidden = {c: f"__kiln_ts_{i}" for i, c in enumerate(dcols)}
    base = df.select("*", *[parse_timestamp(col(c), df.schema[c].dataType).alias(hidden[c]) for c in dcols])
    if keep and any(is_string_type(df.schema[c].dataType) for c in dcols):
        base = staged(base, "dates")
    parsed = {c: F.col(hidden[c]) for c in dcols}
    aggs = []
    for i, c in enumerate(dcols):
        t = parsed[c]
        aggs += [F.count_if(col(c).isNotNull() & t.isNull()).alias(f"bad{i}"),
                 F.coalesce(F.bool_or((F.hour(t) + F.minute(t) + F.second(t)) != 0), F.lit(False)).alias(f"tm{i}")]
    prs = [p for p in date_pairs(dcols, pairs) if p[0] in parsed and p[1] in parsed]
    for j, (a, b, _) in enumerate(prs):
        aggs.append(F.count_if(_days(parsed[a], parsed[b]) < 0).alias(f"neg{j}"))
    row = base.agg(*aggs).first()
    cands: list[tuple[str, Column, dict]] = []
    for i, c in enumerate(dcols):
        t = parsed[c]
        if row[f"bad{i}"]:
            rep.issues.append({"issue": "invalid_datetime", "columns": [c], "count": int(row[f"bad{i}"])})
        parts = [("_Year", F.year(t)), ("_Month", F.month(t)), ("_Day", F.dayofmonth(t)),
                 ("_DayOfWeek", F.weekday(t)),
                 ("_IsWeekend", F.when(t.isNotNull(), (F.weekday(t) >= 5).cast("int")))]
        if row[f"tm{i}"]:
            parts += [("_Hour", F.hour(t)), ("_Minute", F.minute(t))]
        else:
            rep.skipped.append({"feature": f"{c}_Hour", "source": c, "reason": "no_time_component"})
        for suffix, e in parts:
            cands.append((f"{c}{suffix}", e.cast("long"), {"source": c, "transformation": f"Datetime -> {suffix[1:]}"}))
    for j, (a, b, kind) in enumerate(prs):
        days = _days(parsed[a], parsed[b])
        if kind == "duration":
            if row[f"neg{j}"]:
                rep.issues.append({"issue": "negative_duration", "columns": [a, b], "count": int(row[f"neg{j}"])})
            cands.append((f"{a}_{b}_Duration_Days", pyround(days, 2),
                          {"source": f"{a}, {b}", "transformation": "Duration_Days"}))
        else:
            if row[f"neg{j}"]:
                rep.issues.append({"issue": "birth_after_reference", "columns": [a, b], "count": int(row[f"neg{j}"])})
            cands.append((f"{a}_{b}_Age_Years", F.floor(days / DAYS_PER_YEAR).cast("long"),
                          {"source": f"{a}, {b}", "transformation": "Age_Years"}))
    return _admit(base, cands, selected, rep).drop(*hidden.values()), rep


def _days(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86400e6


# ------------------------------------------------------------------ FEN-1..6
def ratio_pairs(cols: list[str]) -> list[tuple[str, str, str]]:
    """R14: (numerator, denominator, feature name) by the ratio rules; of equal names the first stays."""
    named: dict[str, tuple[str, str, str]] = {}
    for r, a, b in sorted(matching(RATIO_RULES, cols), key=lambda m: cols.index(m[1])):
        named.setdefault(r.label(a, b), (a, b, r.label(a, b)))
    return list(named.values())


def _bin_label(lo: float, hi: float, first: bool) -> str:
    return f"{'[' if first else '('}{round(lo, 4)}, {round(hi, 4)}]"


def _facts(df: DataFrame, known: dict | None, ratios: dict[str, TextRatios] | None) -> dict:
    """Detection facts; columns already described in ``known`` and ``ratios`` (same rows,
    same values: stages only add columns) are not recomputed."""
    known = known if known is not None else {}
    todo = [c for c in df.columns if c not in known]
    if todo:
        known.update(column_facts(df, todo, ratios))
    return {c: known[c] for c in df.columns if c in known}


def engineer_numeric(df: DataFrame, selected: set[str] | None = None,
                     exact: bool = True, known_facts: dict | None = None,
                     ratios: dict[str, TextRatios] | None = None) -> tuple[DataFrame, FeatureReport]:
    rep = FeatureReport()
    facts = _facts(df, known_facts, ratios)
    types = {c: feature_type(f) for c, f in facts.items()}
    numeric = [c for c, t in types.items() if t == "numerical" and not is_identifier(facts[c])]
    if not numeric:
        return df, rep
    probs = tuple(i / NUM_BINS for i in range(NUM_BINS + 1))
    st = numeric_stats(df, numeric, coerce=True, distinct=False, quantiles=probs, exact=exact)
    # numbers have been counted with the facts; numbers in text are told apart by their value
    texts = [c for c in numeric if is_string_type(df.schema[c].dataType)]
    distinct = {c: facts[c].distinct for c in numeric} | distinct_counts(
        df, texts, values={c: parse_number(col(c), df.schema[c].dataType) for c in texts})
    cands: list[tuple[str, Column, dict]] = []
    for c in numeric:
        s = st[c]
        v = parse_number(col(c), df.schema[c].dataType)
        skew = round_value(s.skew, 4) if s.skew is not None else 0.0
        binary = distinct[c] <= 2
        if (not binary and distinct[c] >= MIN_UNIQUE_FOR_LOG and s.non_null >= MIN_NON_NULL_FOR_TRANSFORM
                and abs(skew) >= ABS_SKEW_THRESHOLD and skew > 0 and s.negatives == 0):
            cands.append((f"{c}_Log", F.log1p(v), {"source": c, "transformation": "log1p",
                                                    "before_skewness": skew}))
        elif not binary:
            rep.skipped.append({"feature": f"{c}_Log", "source": c, "reason": "log_not_needed"})
        if (N.matches(N.BIN_CANDIDATE, c) or N.matches(N.FE_AGE, c)) and not binary and \
                distinct[c] >= MIN_UNIQUE_FOR_BINNING and s.non_null >= MIN_NON_NULL_FOR_TRANSFORM and s.quantiles:
            edges = sorted(set(s.quantiles[p] for p in probs))
            if len(edges) >= 2:
                expr = None
                for k in range(len(edges) - 1, 0, -1):
                    lo, hi = edges[k - 1], edges[k]
                    label = _bin_label(lo, hi, k == 1)
                    cond = (v >= lo) & (v <= hi) if k == 1 else (v > lo) & (v <= hi)
                    expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
                cands.append((f"{c}_Binned", expr, {"source": c, "transformation": f"Quantile binning (q={NUM_BINS})"}))
    df1 = _admit(df, cands, selected, rep)
    _describe_logs(df, rep, st)
    # ratios use the type map built before log/bin features existed (R14)
    rcands = []
    ratio_info = []
    for a, b, name in ratio_pairs(numeric):
        na = parse_number(col(a), df.schema[a].dataType)
        nb = parse_number(col(b), df.schema[b].dataType)
        raw = F.try_divide(na, F.when(nb != 0, nb))
        rcands.append((name, F.when(~F.isnan(raw) & (F.abs(raw) != float("inf")), raw),
                       {"source": f"{a}, {b}", "transformation": "ratio"}))
        ratio_info.append((name, a, b, nb, raw))
    if ratio_info:
        row = df1.agg(*[F.count_if(nb == 0).alias(f"z{i}") for i, (_, _, _, nb, _) in enumerate(ratio_info)],
                      *[F.count_if(F.abs(raw) == float("inf")).alias(f"i{i}")
                        for i, (_, _, _, _, raw) in enumerate(ratio_info)]).first()
        for i, (name, a, b, _, _) in enumerate(ratio_info):
            if row[f"z{i}"]:
                rep.issues.append({"issue": "division_by_zero", "columns": [a, b], "count": int(row[f"z{i}"])})
            if row[f"i{i}"]:
                rep.issues.append({"issue": "infinite_ratio", "columns": [a, b], "count": int(row[f"i{i}"])})
    return _admit(df1, rcands, selected, rep), rep


def _describe_logs(df: DataFrame, rep: FeatureReport, before: dict) -> None:
    """FEN-1: range and skewness of each log feature's source, and of the feature itself (one job for all)."""
    logs = [g for g in rep.generated if g.get("transformation") == "log1p"]
    if not logs:
        return
    values = [F.log1p(parse_number(col(g["source"]), df.schema[g["source"]].dataType)) for g in logs]
    row = df.agg(*[f(v).alias(f"{n}{i}") for i, v in enumerate(values)
                   for n, f in (("s", F.skewness), ("lo", F.min), ("hi", F.max), ("k", F.count))]).first()
    for i, g in enumerate(logs):
        k = row[f"k{i}"]
        g |= {"before_min": round_value(before[g["source"]].min, 4), "before_max": round_value(before[g["source"]].max, 4),
              "after_skewness": round_value(row[f"s{i}"] * (k * (k - 1)) ** 0.5 / (k - 2), 4),
              "after_min": round_value(row[f"lo{i}"], 4), "after_max": round_value(row[f"hi{i}"], 4)}


def log_statistics(spark, rep: FeatureReport) -> DataFrame:
    """FEN-1: one row per log feature: skewness and range before and after."""
    names = ("before_skewness", "before_min", "before_max", "after_skewness", "after_min", "after_max")
    rows = [(g["feature"], *(float(g[n]) for n in names)) for g in rep.generated if g.get("transformation") == "log1p"]
    return spark.createDataFrame(rows, "feature string, " + ", ".join(f"{n} double" for n in names))


# ------------------------------------------------------------------ FET-1..2
def engineer_text(df: DataFrame, selected: set[str] | None = None,
                  known_facts: dict | None = None) -> tuple[DataFrame, FeatureReport]:
    rep = FeatureReport()
    facts = _facts(df, known_facts, None)
    texts = []
    for c, f in facts.items():
        if is_identifier(f) or feature_type(f) == "identifier":
            continue
        kind = text_kind(f)
        if (feature_type(f) != "text" and not kind) or kind == "names":
            continue
        texts.append(c)
    if not texts:
        return df, rep
    row = df.agg(*[F.count_if(char_count(col(c)) > 0).alias(f"v{i}") for i, c in enumerate(texts)]).first()
    cands = []
    for i, c in enumerate(texts):
        if row[f"v{i}"] < MIN_NON_NULL_FOR_TRANSFORM:
            rep.skipped.append({"feature": f"{c}_WordCount", "source": c, "reason": "too_few_values"})
            continue
        cands.append((f"{c}_CharCount", char_count(col(c)), {"source": c, "transformation": "character count"}))
        cands.append((f"{c}_WordCount", word_count(col(c)), {"source": c, "transformation": "word count"}))
    return _admit(df, cands, selected, rep), rep


# ------------------------------------------------------------------ FEV-1..8
def validate_features(df: DataFrame, originals: list[str], generated: list[str]) -> tuple[DataFrame, FeatureReport]:
    """inf -> null; drop constant, > 50 % missing and duplicate generated columns;
    integral suffixes cast to long. Originals and row count are untouched."""
    rep = FeatureReport()
    gen = [g for g in generated if g in df.columns]
    if not gen:
        return df, rep
    fixed = {}
    for g in gen:
        dt = df.schema[g].dataType
        if dt.typeName() in ("double", "float"):
            fixed[g] = F.when(F.abs(col(g)) != float("inf"), col(g))
    work = df.select(*[fixed[c].alias(c) if c in fixed else col(c) for c in df.columns])
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, g in enumerate(gen):
        present = F.when(~missing(work, g), col(g))
        aggs += [F.count_if(missing(work, g)).alias(f"m{i}"),
                 F.coalesce(F.min(present) != F.max(present), F.lit(False)).alias(f"v{i}")]
    infinite = [g for g in gen if g in fixed]
    row = work.agg(*aggs).first()
    if infinite:
        bad = df.agg(*[F.count_if(F.abs(col(g)) == float("inf")).alias(f"i{i}") for i, g in enumerate(infinite)]).first()
        rep.issues += [{"issue": "infinite_values", "columns": [g], "count": int(bad[f"i{i}"])}
                       for i, g in enumerate(infinite) if bad[f"i{i}"]]
    n = row["n"] or 1
    drop = []
    for i, g in enumerate(gen):
        if not row[f"v{i}"]:
            drop.append(g)
            rep.removed.append({"feature": g, "reason": "constant"})
        elif row[f"m{i}"] * 100.0 / n > GENERATED_MAX_MISSING_PCT:
            drop.append(g)
            rep.removed.append({"feature": g, "reason": "too_many_missing"})
    from kiln.operators.quality import duplicate_column_map
    keep_gen = [g for g in gen if g not in drop]
    dup = duplicate_column_map(work.select(*[col(c) for c in originals + keep_gen if c in work.columns]))
    for d, o in dup.items():
        if d in keep_gen:
            drop.append(d)
            rep.removed.append({"feature": d, "reason": f"duplicate_of:{o}"})
    out = work.drop(*drop)
    # FEV-6: range checks, flag only
    ranges = [(g, lo, hi) for g in out.columns if g in gen for suffix, lo, hi in RANGE_CHECKS if g.endswith(suffix)]
    if ranges:
        row = out.agg(*[F.count_if((col(g) < lo) | (col(g) > hi)).alias(f"r{i}")
                        for i, (g, lo, hi) in enumerate(ranges)]).first()
        for i, (g, lo, hi) in enumerate(ranges):
            if row[f"r{i}"]:
                rep.issues.append({"issue": "out_of_range", "columns": [g], "count": int(row[f"r{i}"])})
    # FEV-8: originals survive (rows cannot change: the plan has no filter)
    lost = [c for c in originals if c not in out.columns]
    if lost:
        raise ValueError(f"feature validation would drop original columns {lost}")
    casts = {g: col(g).cast("long") for g in out.columns
             if g in gen and g.endswith(INTEGER_SUFFIXES) and is_numeric_type(out.schema[g].dataType)}
    return out.select(*[casts[c].alias(c) if c in casts else col(c) for c in out.columns]), rep


# -------------------------------------------------------------------- PIP-8
def engineer(df: DataFrame, selected: list[str] | None = None,
             pairs: list[tuple[str, str, str]] | None = None) -> tuple[DataFrame, FeatureReport]:
    """datetime -> numeric -> text -> validate; ``selected=[]`` passes through."""
    rep = FeatureReport()
    if selected is not None and len(selected) == 0:
        return df, rep
    sel = set(selected) if selected is not None else None
    originals = list(df.columns)
    out = df
    facts: dict = {}  # detection facts shared by the numeric and text stages
    ratios: dict = {}  # what texts parse as, shared by the datetime and numeric stages
    for stage in (lambda d: engineer_datetime(d, sel, pairs, keep=True, ratios=ratios),
                  lambda d: engineer_numeric(d, sel, known_facts=facts, ratios=ratios),
                  lambda d: engineer_text(d, sel, known_facts=facts)):
        out, r = stage(out)
        if r.generated:
            # the next stage fits with several jobs over these columns: write them once
            out = staged(out, "features")
        for k in ("generated", "skipped", "issues"):
            getattr(rep, k).extend(getattr(r, k))
    generated = [c for c in out.columns if c not in originals]
    out, r = validate_features(out, originals, generated)
    rep.removed.extend(r.removed)
    rep.issues.extend(r.issues)
    rep.generated = [g for g in rep.generated if g["feature"] in out.columns]
    return out, rep
