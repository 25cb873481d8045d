"""Feature selection (AGG-15..20, PIP-10..14).

Statistics are aggregates over the whole table; only per-column numbers (and
one matrix of column pairs for correlation and VIF) reach the driver. Mutual information
is a grouped count over (feature, x bin, y bin) with marginals from window
sums, so its work is distributed across features and bins.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions import names as N
from kiln.functions.exprs import as_text, cells, col, is_numeric_type, is_string_type, is_timestamp_type, pyround, round_value
from kiln.operators.detect import column_facts, is_identifier
from kiln.operators.dominant import dominant_values
from kiln.operators.moments import pair_moments
from kiln.operators.quality import duplicate_column_map
from kiln.operators.quantiles import value_quantiles
from kiln.operators.stats import distinct_up_to, missing, numeric_view
from kiln.session import staged

# ---- fixed values: thresholds ----------------------------------------------
NEAR_CONSTANT_THRESHOLD = 0.99
MODERATE_MISSING = 0.20
HIGH_MISSING = 0.50
HIGH_CARDINALITY = 0.50
CORRELATION_THRESHOLD = 0.90
VIF_HIGH = 10.0
VIF_REVIEW = 5.0
MIN_ROWS_FOR_MI = 10
MIN_ROWS_FOR_VIF = 20
MI_MAX_BINS = 10
MI_MEANINGFUL = 0.02
CLASSIFICATION_MAX_DISTINCT = 20
R2_CAP = 0.999999
RELATED_MIN = CORRELATION_THRESHOLD
# ---- end of fixed values ----------------------------------------------------


# -------------------------------------------------------------------- DET-9
def detect_target(df: DataFrame, explicit: str | None = None) -> str | None:
    if explicit:
        return explicit if explicit in df.columns else None
    for key in N.TARGET_PRIORITY:
        for c in df.columns:
            if key in c.lower():
                return c
    for c in df.columns:
        if N.is_target_name(c):
            return c
    return None


# ------------------------------------------------------------------- AGG-20
def feature_quality(df: DataFrame, target: str | None = None) -> DataFrame:
    """One row per column: missing %, distinct, top value and share, flags, semantic type."""
    facts = column_facts(df)
    dup_of = duplicate_column_map(df)
    names = list(facts)
    # in all-distinct columns each value occurs once, so the tie rule picks the smallest value
    unique = [c for c in names if facts[c].non_null > 0 and facts[c].distinct == facts[c].non_null]
    spark = df.sparkSession
    top = dominant_values(df, [c for c in names if c not in unique], distinct={c: facts[c].distinct for c in names})
    if unique:
        mins = df.agg(*[F.min(as_text(col(c), df.schema[c].dataType)).alias(f"m{i}") for i, c in enumerate(unique)]).first()
        top |= {c: (mins[f"m{i}"], 1) for i, c in enumerate(unique)}
    # mean text length (reference: first 30 values; here the full column)
    lens = {}
    texts = [c for c in names if is_string_type(df.schema[c].dataType)]
    if texts:
        row = df.agg(*[F.avg(F.length(col(c))).alias(f"l{i}") for i, c in enumerate(texts)]).first()
        lens = {c: row[f"l{i}"] or 0.0 for i, c in enumerate(texts)}
    meta = []
    for i, c in enumerate(names):
        f = facts[c]
        dt = df.schema[c].dataType
        is_t = target is not None and c == target
        is_id = is_identifier(f) and not is_t
        n = f.n_rows
        if is_t:
            sem = "target"
        elif is_id:
            sem = "identifier"
        elif dt.typeName() == "boolean":
            sem = "binary"
        elif is_numeric_type(dt):
            sem = "binary" if f.distinct <= 2 else "numerical"
        elif is_timestamp_type(dt):
            sem = "datetime"
        elif n and f.distinct / n >= HIGH_CARDINALITY and f.distinct > 20:
            sem = "text" if lens.get(c, 0.0) >= 40 else "high_cardinality_categorical"
        else:
            sem = "categorical"
        meta.append((i, c, dt.simpleString(), sem, round_value((1 - f.non_null / n) * 100.0, 2) if n else 0.0,
                     f.distinct, round_value(f.distinct / n * 100.0, 2) if n else 0.0, is_id, c in dup_of,
                     dup_of.get(c), f.non_null, *top.get(c, (None, None))))
    j = spark.createDataFrame(meta, "gi int, feature string, datatype string, semantic_type string, "
                                    "missing_pct double, unique_count long, unique_pct double, "
                                    "is_identifier boolean, is_exact_duplicate boolean, duplicate_of string, "
                                    "non_null long, top_value string, top_count long")
    share = F.col("top_count") / F.col("non_null")
    const = (F.col("non_null") > 0) & (F.col("unique_count") <= 1)
    near = (F.col("non_null") > 0) & ~const & (share >= NEAR_CONSTANT_THRESHOLD)
    flags = F.array_compact(F.array(
        F.when(const, F.lit("constant")), F.when(near, F.lit("near_constant")),
        F.when(F.col("missing_pct") >= HIGH_MISSING * 100, F.lit("high_missing"))
         .when(F.col("missing_pct") >= MODERATE_MISSING * 100, F.lit("moderate_missing")),
        F.when(F.col("is_identifier"), F.lit("identifier")),
        F.when(F.col("is_exact_duplicate"), F.lit("exact_duplicate")),
        F.when(F.col("semantic_type") == "high_cardinality_categorical", F.lit("high_cardinality"))))
    return j.select("feature", "datatype", "semantic_type", "missing_pct", "unique_count", "unique_pct",
                    F.col("top_value").alias("most_frequent_value"),
                    pyround(share * 100.0, 2).alias("frequency_pct"),
                    const.alias("is_constant"), near.alias("is_near_constant"), "is_identifier",
                    "is_exact_duplicate", "duplicate_of", flags.alias("quality_flags"))


# ------------------------------------------------------------------- AGG-15
def correlated_pairs(df: DataFrame, target: str | None = None, threshold: float = CORRELATION_THRESHOLD,
                     exclude: set[str] | None = None) -> DataFrame:
    """Pearson r of all numeric pairs (pairwise complete rows); |r| >= threshold."""
    exclude = exclude or set()
    nums = [c for c in df.columns if is_numeric_type(df.schema[c].dataType) and c != target and c not in exclude]
    spark = df.sparkSession
    schema = "feature_a string, feature_b string, correlation double"
    if len(nums) < 2:
        return spark.createDataFrame([], schema)
    rows = []
    for strip in pair_moments(df, nums):
        r = strip.correlation()
        r[np.tril_indices(len(r), 0, r.shape[1])] = np.nan  # each pair once
        rows += [(nums[strip.at + i], nums[strip.at + j], round_value(float(r[i, j]), 4))
                 for i, j in np.argwhere(np.abs(r) >= threshold).tolist()]
    rows.sort(key=lambda t: abs(t[2]), reverse=True)
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------------- AGG-16
def vif(df: DataFrame, target: str | None = None, exclude: set[str] | None = None,
        preferred: list[str] | None = None) -> DataFrame:
    """Variance inflation of every numeric feature on complete rows.

    Blocked scans sum the co-moments over rows without missing values. One
    eigendecomposition of the features' correlation matrix gives the diagonal of its
    (pseudo-)inverse, which is what per-column least squares with intercept gives.
    ``preferred`` features come first. ``related`` names the other features with
    |r| >= ``RELATED_MIN``, strongest first.
    """
    exclude = exclude or set()
    spark = df.sparkSession
    schema = "feature string, vif double, status string, related string"
    cands = [c for c in df.columns if is_numeric_type(df.schema[c].dataType) and c != target
             and c not in exclude]
    sel = list(dict.fromkeys([c for c in (preferred or []) if c in cands] + cands))
    full = np.full((len(sel), len(sel)), np.nan)
    n = 0
    for strip in pair_moments(df, sel, complete=True) if len(sel) > 1 else ():
        n, r = strip.n[0, 0], strip.correlation()
        still = np.sqrt(strip.variances()[0].diagonal()) <= 1e-12
        r[still] = np.nan
        full[strip.at:strip.at + len(r), strip.at:] = r
        full[strip.at:, strip.at:strip.at + len(r)] = r.T
    keep = [i for i in range(len(sel)) if not np.isnan(full[i, i])]
    if n < MIN_ROWS_FOR_VIF or len(keep) < 2:
        return spark.createDataFrame([], schema)
    full = full[np.ix_(keep, keep)]
    np.fill_diagonal(full, 1.0)
    rows = []
    for a, value in enumerate(inverse_diagonal(full)):
        val = min(float(value), 1.0 / (1.0 - R2_CAP), 1e6)
        status = "HIGH" if val > VIF_HIGH else ("REVIEW" if val >= VIF_REVIEW else "GOOD")
        near = sorted((b for b in range(len(keep)) if b != a and abs(full[a, b]) >= RELATED_MIN),
                      key=lambda b: (-round_value(abs(float(full[a, b])), 4), b))
        rows.append((sel[keep[a]], round_value(val, 2), status, ",".join(sel[keep[b]] for b in near)))
    return spark.createDataFrame(rows, schema)


def inverse_diagonal(r: np.ndarray) -> np.ndarray:
    """The diagonal of a correlation matrix's inverse; huge for columns that others determine."""
    value, vector = np.linalg.eigh(r)
    return np.maximum((vector ** 2 / np.maximum(value, 1e-14)).sum(axis=1), 1.0)


# ------------------------------------------------------------------- AGG-17
def target_task(df: DataFrame, target: str) -> str:
    dt = df.schema[target].dataType
    if not is_numeric_type(dt) or dt.typeName() == "boolean":
        return "classification"
    d = distinct_up_to(df, [target], CLASSIFICATION_MAX_DISTINCT)[target]
    return "classification" if d is not None and d <= CLASSIFICATION_MAX_DISTINCT else "regression"


def _inner_edges(lo: float, hi: float, distinct: int) -> list[float]:
    """Edges between the bins of linspace(lo, hi + 1e-12, b + 1)."""
    b = max(2, min(MI_MAX_BINS, distinct))
    step = (hi + 1e-12 - lo) / b
    return [k * step + lo for k in range(1, b)]


def _bin(v: Column, edges: list[Column]) -> Column:
    """Bin index = number of inner edges <= v (edges that a column lacks are null)."""
    idx = F.lit(0)
    for e in edges:
        idx = idx + F.when(v >= e, 1).otherwise(0)
    return idx


def mutual_information(df: DataFrame, target: str, features: list[str] | None = None) -> DataFrame:
    """Histogram MI (nats) of each feature with the target, ranked descending.

    All scans read one staged copy of the rows with a target, so that the plan below (a join, parsing) runs once.
    """
    spark = df.sparkSession
    schema = "feature string, mi_score double, rank int"
    feats = [c for c in (features or [c for c in df.columns if c != target]) if c != target]
    names = list(dict.fromkeys([target, *feats]))
    kept = [col(c).cast("string") if df.schema[c].dataType.typeName() == "void" else col(c) for c in names]
    base = staged(df.where(~missing(df, target)).select(*[c.alias(f"c{i}") for i, c in enumerate(kept)]), "information").toDF(*names)
    task = target_task(base, target)
    tdt = df.schema[target].dataType
    n_y = base.agg(F.count(F.lit(1)).alias("n"),
                   F.min(col(target).cast("double") if is_numeric_type(tdt) else F.lit(None)).alias("mn"),
                   F.max(col(target).cast("double") if is_numeric_type(tdt) else F.lit(None)).alias("mx")).first()
    # bins are few, so that only columns with few values need their number of values
    few = lambda d, cs: {c: MI_MAX_BINS if k is None else k for c, k in distinct_up_to(d, cs, MI_MAX_BINS).items()}
    classes = few(base, [target])[target]
    if n_y["n"] < MIN_ROWS_FOR_MI or classes < 2 or not feats:
        return spark.createDataFrame([], schema)
    if task == "classification":
        y = as_text(col(target), tdt)
    else:
        y = _bin(col(target).cast("double"), [F.lit(e) for e in _inner_edges(n_y["mn"], n_y["mx"], classes)]).cast("string")
    # fill values for missing x: median (numeric) / most frequent (categorical), on target rows
    nums = [c for c in feats if is_numeric_type(base.schema[c].dataType)]
    cats = [c for c in feats if c not in nums]
    view = {c: numeric_view(base, c) for c in nums}  # NaN counts as missing
    found, _ = value_quantiles(base, view, (0.0, 0.5, 1.0))
    median = {c: found[c][0.5] if found[c][0.5] is not None else 0.0 for c in nums}
    filled = {c: F.coalesce(view[c], F.lit(median[c])) for c in nums}
    # bin count follows the distinct values *after* the median fill
    distinct = few(base.select(*[filled[c].alias(c) for c in nums]), nums)
    tops = dominant_values(base, cats)
    count = F.count(F.lit(1)).alias("k")
    joint = []
    if nums:
        edges = []
        for c in nums:
            lo, hi = (median[c] if found[c][p] is None else found[c][p] for p in (0.0, 1.0))
            edges.append(_inner_edges(lo, hi, max(distinct[c], 1)))
        own = [F.get(F.array(*[F.lit(e[k] if k < len(e) else None).cast("double") for e in edges]), F.col("i"))
               for k in range(max(map(len, edges)))]  # the k-th edge of each column, which its number picks
        rows = cells(base, [filled[c] for c in nums], y.alias("y")).select("y", "i", _bin(F.col("v"), own).cast("long").alias("a"))
        joint.append(rows.groupBy("y", "i", "a", F.lit(0).cast("long").alias("b")).agg(count))
    if cats:
        # categories travel as 128 hash bits, however long their texts are
        texts = [F.coalesce(as_text(col(c), base.schema[c].dataType), F.lit(tops[c][0] if c in tops else None).cast("string")) for c in cats]
        rows = cells(base, texts, y.alias("y")).select("y", (F.col("i") + len(nums)).alias("i"), F.xxhash64("v").alias("a"),
                                                       F.xxhash64(F.lit("2"), "v").alias("b"))
        joint.append(rows.groupBy("y", "i", "a", "b").agg(count))
    n = float(n_y["n"])
    # x marginal: a window per (feature, x) - each group holds one row per class,
    # never a whole feature; y marginal: every feature sees all target rows, so it
    # is the class count table (one row per class), joined (AQE broadcasts it)
    px = reduce(DataFrame.unionAll, joint).withColumn("kx", F.sum("k").over(Window.partitionBy("i", "a", "b")))
    py = base.groupBy(y.alias("y")).agg(F.count(F.lit(1)).alias("ky"))
    p = px.join(py, "y")
    term = (F.col("k") / n) * F.log((F.col("k") * n) / (F.col("kx") * F.col("ky")))
    mi = p.groupBy("i").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))
    # features whose x has a single bin carry no information
    out = mi.select(F.get(F.array(*map(F.lit, nums + cats)), F.col("i")).alias("feature"), pyround("mi", 6).alias("mi_score"))
    return out.select("feature", "mi_score",
                      F.row_number().over(Window.orderBy(F.desc("mi_score"), "feature")).alias("rank"))


# ------------------------------------------------------------------ PIP-12
DECISION_SCHEMA = "feature string, decision string, status string, mi_score double, mi_meaningful boolean"


def decisions(quality: DataFrame, corr: DataFrame, vif_df: DataFrame, mi: DataFrame,
              target: str | None) -> DataFrame:
    """KEEP / REVIEW / REMOVE per feature (rule R6); all inputs are per-column tables."""
    in_pair = (corr.select(F.col("feature_a").alias("feature")).union(corr.select(F.col("feature_b").alias("feature")))
               .distinct().withColumn("in_corr_pair", F.lit(True)))
    q = (quality.join(in_pair, "feature", "left").join(vif_df.select("feature", "vif", F.col("status").alias("vif_status")),
                                                       "feature", "left")
         .join(mi.select("feature", "mi_score"), "feature", "left"))
    flags = F.col("quality_flags")
    is_t = F.lit(target is not None) & (F.col("feature") == F.lit(target or ""))
    review_codes = F.array_compact(F.array(
        F.when(F.array_contains(flags, "near_constant"), F.lit("NEAR_CONSTANT")),
        F.when(F.array_contains(flags, "high_missing"), F.lit("HIGH_MISSING")),
        F.when(F.array_contains(flags, "moderate_missing"), F.lit("MODERATE_MISSING")),
        F.when(F.array_contains(flags, "high_cardinality"), F.lit("HIGH_CARDINALITY")),
        F.when(F.coalesce(F.col("in_corr_pair"), F.lit(False)), F.lit("HIGH_CORRELATION")),
        F.when(F.col("vif_status") == "HIGH", F.lit("HIGH_VIF")),
        F.when(F.col("vif_status") == "REVIEW", F.lit("MODERATE_VIF"))))
    decision = (F.when(is_t, F.lit("KEEP")).when(F.col("is_constant"), F.lit("REMOVE"))
                .when(F.col("is_exact_duplicate"), F.lit("REMOVE")).when(F.col("is_identifier"), F.lit("REMOVE"))
                .when(F.size(review_codes) > 0, F.lit("REVIEW")).otherwise(F.lit("KEEP")))
    status = (F.when(is_t, F.lit("TARGET")).when(F.col("is_constant"), F.lit("CONSTANT"))
              .when(F.col("is_exact_duplicate"), F.lit("DUPLICATE")).when(F.col("is_identifier"), F.lit("IDENTIFIER"))
              .when(F.size(review_codes) > 0, F.array_join(review_codes, ","))
              .otherwise(F.lit("GOOD")))
    return q.select("feature", decision.alias("decision"), status.alias("status"), "mi_score",
                    (F.coalesce(F.col("mi_score"), F.lit(0.0)) >= MI_MEANINGFUL).alias("mi_meaningful"))


def analyze_selection(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """PIP-13: target -> quality -> MI -> correlation -> VIF -> decisions."""
    target = detect_target(df, target)
    q = feature_quality(df, target)  # a local table already
    qrows = q.select("feature", "is_constant", "is_identifier").collect()  # one row per column
    constants = {r["feature"] for r in qrows if r["is_constant"]}
    ids = {r["feature"] for r in qrows if r["is_identifier"]}
    spark = df.sparkSession
    mi = (mutual_information(df, target, [c for c in df.columns if c != target and c not in ids])
          if target else spark.createDataFrame([], "feature string, mi_score double, rank int"))
    corr = correlated_pairs(df, target, exclude=constants)
    pref = []
    for r in corr.collect():
        pref += [r["feature_a"], r["feature_b"]]
    v = vif(df, target, exclude=constants | ids, preferred=list(dict.fromkeys(pref)))
    dec = spark.createDataFrame(decisions(q, corr, v, mi, target).collect(), DECISION_SCHEMA)  # one row per column
    return {"quality": q, "mutual_information": mi, "correlation": corr, "vif": v, "decisions": dec,
            "summary": selection_summary(q, corr, v, dec, target)}


def selection_summary(quality: DataFrame, corr: DataFrame, vif_df: DataFrame, dec: DataFrame,
                      target: str | None) -> DataFrame:
    """PIP-13: rows (item, count) over the analysed features; inputs are per-column tables."""
    q = quality.where(F.col("feature") != F.lit(target)) if target else quality
    counts = q.agg(F.count(F.lit(1)).alias("features"), F.count_if("is_constant").alias("constant"),
                   F.count_if("is_near_constant").alias("near_constant"), F.count_if("is_identifier").alias("identifier"),
                   F.count_if("is_exact_duplicate").alias("exact_duplicate"),
                   F.count_if(F.col("semantic_type") == "high_cardinality_categorical").alias("high_cardinality"),
                   F.count_if(F.exists("quality_flags", lambda f: f.endswith("_missing"))).alias("missing")).first()
    kinds = dict.fromkeys(("KEEP", "REVIEW", "REMOVE"), 0)
    d = dec.where(F.col("feature") != F.lit(target)) if target else dec
    kinds |= {r["decision"]: r["n"] for r in d.groupBy("decision").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = [*counts.asDict().items(), ("correlated_pairs", corr.count()),
            ("high_vif", vif_df.where("status = 'HIGH'").count()), ("review_vif", vif_df.where("status = 'REVIEW'").count()),
            *((k.lower(), n) for k, n in kinds.items())]
    return quality.sparkSession.createDataFrame(rows, "item string, count long")


def apply_selection(df: DataFrame, decisions_df: DataFrame, target: str | None = None,
                    force_keep: list[str] | None = None, also_remove: list[str] | None = None,
                    manual_drop: list[str] | None = None) -> DataFrame:
    """PIP-14 / PRJ-12: drop REMOVE columns (and REVIEW ones listed in also_remove);
    the target and force_keep columns always stay; manual mode drops only the listed ones."""
    keep_always = set(force_keep or []) | ({target} if target else set())
    if manual_drop is not None:
        drop = [c for c in manual_drop if c not in keep_always]
    else:
        rows = decisions_df.select("feature", "decision").collect()  # one row per column
        review_drop = set(also_remove or [])
        drop = [r["feature"] for r in rows if r["feature"] not in keep_always and
                (r["decision"] == "REMOVE" or (r["decision"] == "REVIEW" and r["feature"] in review_drop))]
    return df.select(*[col(c) for c in df.columns if c not in set(drop)])


# --------------------------------------------------------------- PIP-10 / 11
MISSING_PREFERENCE_POINTS = 10.0


def prefer_in_pairs(pairs: DataFrame, quality: DataFrame, mi: DataFrame | None = None,
                    generated: list[str] | None = None) -> DataFrame:
    """Preferred feature inside each correlated pair, by the first rule that decides: not an
    identifier; of an exact duplicate its original; >= 10 points less missing; none (review) when
    only one is ``generated``; MI higher by >= 0.02; else none. Inputs are per-column tables."""
    facts = quality.select("feature", "is_identifier", "is_exact_duplicate", "duplicate_of", "missing_pct",
                           F.col("feature").isin(list(generated or [])).alias("generated"))
    score = mi.select("feature", "mi_score") if mi is not None else \
        quality.select("feature", F.lit(None).cast("double").alias("mi_score"))
    facts = facts.join(score, "feature", "left")
    side = lambda s: facts.select(F.col("feature").alias(f"feature_{s}"), F.struct(
        *[c for c in facts.columns if c != "feature"]).alias(s))
    j = pairs.join(side("a"), "feature_a", "left").join(side("b"), "feature_b", "left")
    fa, fb, a, b = F.col("feature_a"), F.col("feature_b"), F.col("a"), F.col("b")
    gap = a["missing_pct"] - b["missing_pct"]
    gain = a["mi_score"] - b["mi_score"]
    pick = (F.when(a["is_identifier"] & ~b["is_identifier"], fb).when(b["is_identifier"] & ~a["is_identifier"], fa)
            .when(a["is_exact_duplicate"], F.coalesce(a["duplicate_of"], fb))
            .when(b["is_exact_duplicate"], F.coalesce(b["duplicate_of"], fa))
            .when(F.abs(gap) >= MISSING_PREFERENCE_POINTS, F.when(gap < 0, fa).otherwise(fb))
            .when(a["generated"] != b["generated"], F.lit(None).cast("string"))
            .when(F.abs(gain) >= MI_MEANINGFUL, F.when(gain > 0, fa).otherwise(fb)))
    return j.select("feature_a", "feature_b", "correlation", pick.alias("preferred_feature"))


def categorical_redundancy(df: DataFrame) -> DataFrame:
    """Exact duplicates among non-numeric columns (notes only)."""
    dup = duplicate_column_map(df)
    rows = [(d, o) for d, o in dup.items() if not is_numeric_type(df.schema[d].dataType)]
    return df.sparkSession.createDataFrame(rows, "duplicate_column string, original_column string")
