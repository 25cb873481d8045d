"""DuckDB oracles for feature selection."""

from __future__ import annotations

from itertools import combinations

from suite import sqlgen as G
from suite.schemas import source_sql

NET_PRICE = "(SELECT *, l_extendedprice * (1 - l_discount) AS net_price FROM lineitem)"
NET_PRICE_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                  "net_price"]


def correlated_pairs(src: str, names: list[str], thr: float = 0.9) -> str:
    parts = [f"SELECT {G.lit(a)} AS feature_a, {G.lit(b)} AS feature_b, corr({G.q(a)}, {G.q(b)}) AS r FROM {src} t"
             for a, b in combinations(names, 2)]
    return (f"SELECT feature_a, feature_b, round_even(r, 4) AS correlation FROM ({G.union_all(parts)}) x "
            f"WHERE r IS NOT NULL AND NOT isnan(r) AND abs(r) >= {thr}")


def vif3(src: str, names: list[str]) -> str:
    """Closed form for three features: R2_i = (r_ij^2 + r_ik^2 - 2 r_ij r_ik r_jk) / (1 - r_jk^2)."""
    a, b, c = names
    r = {(a, b): "rab", (a, c): "rac", (b, c): "rbc"}

    def rr(x, y):
        return r.get((x, y)) or r[(y, x)]
    parts = []
    for i, j, k in ((a, b, c), (b, a, c), (c, a, b)):
        r2 = f"(({rr(i,j)}^2 + {rr(i,k)}^2 - 2*{rr(i,j)}*{rr(i,k)}*{rr(j,k)}) / (1 - {rr(j,k)}^2))"
        r2c = f"least(greatest({r2}, 0.0), 0.999999)"
        v = f"least(1.0 / (1.0 - {r2c}), 1e6)"
        parts.append(f"SELECT {G.lit(i)} AS feature, round_even({v}, 2) AS vif, "
                     f"CASE WHEN round_even({v}, 2) > 10 THEN 'HIGH' WHEN round_even({v}, 2) >= 5 THEN 'REVIEW' ELSE 'GOOD' END "
                     f"AS status FROM c")
    q = ", ".join(f"corr({G.q(x)}, {G.q(y)}) AS {r[(x, y)]}" for x, y in r)
    return (f"WITH d AS (SELECT * FROM {src} t WHERE {' AND '.join(G.q(n) + ' IS NOT NULL' for n in names)}), "
            f"c AS (SELECT {q} FROM d) {G.union_all(parts)}")


def mutual_information(table: str, target: str, nums: list[str], cats: list[str], regression: bool = False) -> str:
    """Histogram MI: categorical x by value (mode fill), numeric x in clamp(distinct,2,10)
    equal-width bins over [min, max + 1e-12] after a median fill; y = class label, or such a bin."""
    src = source_sql(table)
    st = ", ".join([f"quantile_cont(CAST({G.q(c)} AS DOUBLE), 0.5) AS med_{c}" for c in nums]
                   + [f"(SELECT v FROM (SELECT CAST({G.q(c)} AS VARCHAR) AS v, count(*) AS k FROM base "
                      f"WHERE {G.q(c)} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1) AS mode_{c}" for c in cats])
    fl = ", ".join([f"coalesce(CAST(b.{G.q(c)} AS DOUBLE), st.med_{c}) AS v_{c}" for c in nums]
                   + [f"coalesce(CAST(b.{G.q(c)} AS VARCHAR), st.mode_{c}) AS v_{c}" for c in cats])
    bd = ", ".join(f"min(v_{c}) AS lo_{c}, max(v_{c}) AS hi_{c}, greatest(2, least(10, count(DISTINCT v_{c}))) AS nb_{c}"
                   for c in nums)
    longs = []
    for c in nums:
        step = f"((bd.hi_{c} + 1e-12 - bd.lo_{c}) / bd.nb_{c})"
        idx = f"len(list_filter(range(1, bd.nb_{c}), lambda k: f.v_{c} >= k * {step} + bd.lo_{c}))"
        longs.append(f"SELECT {G.lit(c)} AS feature, CAST({idx} AS VARCHAR) AS x, f.y FROM f, bd")
    for c in cats:
        longs.append(f"SELECT {G.lit(c)} AS feature, f.v_{c} AS x, f.y FROM f")
    y = f"CAST(b.{G.q(target)} AS VARCHAR)"
    if regression:
        step = "((yb.hi + 1e-12 - yb.lo) / yb.nb)"
        y = (f"CAST(len(list_filter(range(1, yb.nb), lambda k: CAST(b.{G.q(target)} AS DOUBLE) >= k * {step} + yb.lo)) AS VARCHAR)")
    return f"""
WITH base AS (SELECT * FROM {src} t WHERE {G.q(target)} IS NOT NULL),
yb AS (SELECT min(try_cast({G.q(target)} AS DOUBLE)) AS lo, max(try_cast({G.q(target)} AS DOUBLE)) AS hi,
              greatest(2, least(10, count(DISTINCT {G.q(target)}))) AS nb FROM base),
st AS (SELECT {st} FROM base),
f AS (SELECT {y} AS y, {fl} FROM base b, st, yb),
bd AS (SELECT {bd} FROM f),
j AS (SELECT feature, x, y, count(*) AS k FROM ({G.union_all(longs)}) l GROUP BY feature, x, y),
p AS (SELECT feature, k, sum(k) OVER (PARTITION BY feature) AS n, sum(k) OVER (PARTITION BY feature, x) AS kx,
             sum(k) OVER (PARTITION BY feature, y) AS ky FROM j),
m AS (SELECT feature, round_even(greatest(sum((CAST(k AS DOUBLE) / n) * ln((CAST(k AS DOUBLE) * n) / (CAST(kx AS DOUBLE) * ky))), 0.0), 6)
      AS mi_score FROM p GROUP BY feature)
SELECT feature, mi_score, CAST(row_number() OVER (ORDER BY mi_score DESC, feature) AS INTEGER) AS rank FROM m"""


def categorical_redundancy(table: str) -> str:
    """Exact duplicates restricted to text columns (first equal predecessor is the original)."""
    from suite.quality_sql import duplicate_columns
    from suite.schemas import cols
    texts = ", ".join(G.lit(c) for c, k in cols(table) if k == "str")
    return (f"SELECT duplicate_column, original_column FROM ({duplicate_columns(table)}) d "
            f"WHERE duplicate_column IN ({texts})")


def feature_quality(table: str, target: str | None) -> str:
    """AGG-20 rows: missing/unique %, top value and share, flags, semantic type (R17)."""
    from suite.detect_sql import feature_types
    from suite.profile_sql import _SPARK_TYPE
    from suite.quality_sql import duplicate_columns
    from suite.schemas import cols
    src = source_sql(table)
    rows = []
    for c, k in cols(table):
        q = G.q(c)
        v = f"(CASE WHEN NOT {G.missing(c, k)} THEN {q} END)"
        text = G.text(c, k)
        top = (f"(SELECT v FROM (SELECT {text} AS v, count(*) AS cnt FROM {src} t WHERE {v} IS NOT NULL "
               f"GROUP BY 1) x ORDER BY cnt DESC, v LIMIT 1)")
        topk = (f"(SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM {src} t WHERE {v} IS NOT NULL GROUP BY {text}) x)")
        mlen = f"avg(length({q}))" if k == "str" else "0.0"
        rows.append(f"SELECT {G.lit(c)} AS feature, {_SPARK_TYPE.format(c='any_value(' + q + ')')} AS datatype, "
                    f"{G.lit(k)} AS kind, count(*) AS n, count({v}) AS nn, count(DISTINCT {v}) AS d, "
                    f"{top} AS top_value, {topk} AS topk, {mlen} AS mlen FROM {src} t")
    tgt = G.lit(target) if target else "NULL"
    sem = (f"CASE WHEN s.feature = {tgt} THEN 'target' WHEN ft.is_identifier THEN 'identifier' "
           f"WHEN s.kind = 'bool' THEN 'binary' WHEN s.kind IN ('int', 'dbl') THEN "
           f"(CASE WHEN s.d <= 2 THEN 'binary' ELSE 'numerical' END) WHEN s.kind = 'ts' THEN 'datetime' "
           f"WHEN s.n > 0 AND CAST(s.d AS DOUBLE) / s.n >= 0.5 AND s.d > 20 THEN "
           f"(CASE WHEN s.mlen >= 40 THEN 'text' ELSE 'high_cardinality_categorical' END) ELSE 'categorical' END")
    return f"""
WITH s AS ({G.union_all(rows)}),
ft AS (SELECT column_name, CASE WHEN column_name = {tgt} THEN false ELSE is_identifier END AS is_identifier
       FROM ({feature_types(table)}) x),
dp AS ({duplicate_columns(table)}),
r AS (SELECT s.*, ft.is_identifier, dp.original_column AS duplicate_of, {sem} AS semantic_type,
             round_even((1 - CAST(s.nn AS DOUBLE) / s.n) * 100.0, 2) AS missing_pct,
             s.nn > 0 AND s.d <= 1 AS is_constant,
             s.nn > 0 AND NOT (s.d <= 1) AND CAST(s.topk AS DOUBLE) / s.nn >= 0.99 AS is_near_constant
      FROM s JOIN ft ON ft.column_name = s.feature LEFT JOIN dp ON dp.duplicate_column = s.feature)
SELECT feature, datatype, semantic_type, missing_pct, CAST(d AS BIGINT) AS unique_count,
  round_even(CAST(d AS DOUBLE) / n * 100.0, 2) AS unique_pct, top_value AS most_frequent_value,
  round_even(CAST(topk AS DOUBLE) / nn * 100.0, 2) AS frequency_pct, is_constant, is_near_constant, is_identifier,
  duplicate_of IS NOT NULL AS is_exact_duplicate, duplicate_of,
  array_to_string(list_filter([CASE WHEN is_constant THEN 'constant' END,
    CASE WHEN is_near_constant THEN 'near_constant' END,
    CASE WHEN missing_pct >= 50 THEN 'high_missing' WHEN missing_pct >= 20 THEN 'moderate_missing' END,
    CASE WHEN is_identifier THEN 'identifier' END, CASE WHEN duplicate_of IS NOT NULL THEN 'exact_duplicate' END,
    CASE WHEN semantic_type = 'high_cardinality_categorical' THEN 'high_cardinality' END],
    lambda x: x IS NOT NULL), ',') AS quality_flags
FROM r"""


def vif2(src: str, a: str, b: str) -> str:
    """Two features: R2 = r^2 on complete rows (>= 20), capped, VIF = 1/(1-R2)."""
    v = "least(1.0 / (1.0 - least(greatest(r * r, 0.0), 0.999999)), 1e6)"
    rows = [f"SELECT {G.lit(x)} AS feature, round_even({v}, 2) AS vif, CASE WHEN round_even({v}, 2) > 10 THEN 'HIGH' "
            f"WHEN round_even({v}, 2) >= 5 THEN 'REVIEW' ELSE 'GOOD' END AS status FROM c WHERE k >= 20" for x in (a, b)]
    return (f"WITH d AS (SELECT CAST({G.q(a)} AS DOUBLE) AS x, CAST({G.q(b)} AS DOUBLE) AS y FROM {src} t "
            f"WHERE {G.q(a)} IS NOT NULL AND {G.q(b)} IS NOT NULL), c AS (SELECT corr(x, y) AS r, count(*) AS k FROM d) "
            + G.union_all(rows))


def decisions(table: str, target: str, nums: list[str], cats: list[str], vif_pair: tuple[str, str],
              identifiers: list[str]) -> str:
    """Rule R6 over the quality, correlation, VIF and MI oracles (MI skips the target and identifiers)."""
    src = source_sql(table)
    q = feature_quality(table, target)
    corr = correlated_pairs(src, [c for c in nums if c != target])
    mi = mutual_information(table, target, [c for c in nums if c != target and c not in identifiers],
                            [c for c in cats if c not in identifiers])
    vf = vif2(src, *vif_pair)
    codes = ("list_filter([CASE WHEN is_near_constant THEN 'NEAR_CONSTANT' END, "
             "CASE WHEN missing_pct >= 50 THEN 'HIGH_MISSING' END, "
             "CASE WHEN missing_pct < 50 AND missing_pct >= 20 THEN 'MODERATE_MISSING' END, "
             "CASE WHEN semantic_type = 'high_cardinality_categorical' THEN 'HIGH_CARDINALITY' END, "
             "CASE WHEN in_pair THEN 'HIGH_CORRELATION' END, CASE WHEN vif_status = 'HIGH' THEN 'HIGH_VIF' END, "
             "CASE WHEN vif_status = 'REVIEW' THEN 'MODERATE_VIF' END], lambda x: x IS NOT NULL)")
    return f"""
WITH qq AS ({q}),
cp AS ({corr}),
pr AS (SELECT feature_a AS feature FROM cp UNION SELECT feature_b FROM cp),
vv AS ({vf}),
mm AS ({mi}),
j AS (SELECT qq.*, pr.feature IS NOT NULL AS in_pair, vv.status AS vif_status, mm.mi_score
      FROM qq LEFT JOIN pr ON pr.feature = qq.feature LEFT JOIN vv ON vv.feature = qq.feature
      LEFT JOIN mm ON mm.feature = qq.feature),
k AS (SELECT *, {codes} AS codes FROM j)
SELECT feature,
  CASE WHEN feature = {G.lit(target)} THEN 'KEEP' WHEN is_constant THEN 'REMOVE' WHEN is_exact_duplicate THEN 'REMOVE'
       WHEN is_identifier THEN 'REMOVE' WHEN len(codes) > 0 THEN 'REVIEW' ELSE 'KEEP' END AS decision,
  CASE WHEN feature = {G.lit(target)} THEN 'TARGET' WHEN is_constant THEN 'CONSTANT' WHEN is_exact_duplicate THEN 'DUPLICATE'
       WHEN is_identifier THEN 'IDENTIFIER' WHEN len(codes) > 0 THEN array_to_string(codes, ',') ELSE 'GOOD' END AS status,
  mi_score, coalesce(mi_score, 0.0) >= 0.02 AS mi_meaningful
FROM k"""


def prefer_pairs(table: str, target: str, nums: list[str], mi_nums: list[str], mi_cats: list[str]) -> str:
    """PIP-10: preferred feature inside each correlated pair."""
    src = source_sql(table)
    return f"""
WITH cp AS ({correlated_pairs(src, nums)}),
q AS ({feature_quality(table, target)}),
m AS ({mutual_information(table, target, mi_nums, mi_cats)})
SELECT cp.feature_a, cp.feature_b, cp.correlation,
  CASE WHEN qa.is_identifier AND NOT qb.is_identifier THEN cp.feature_b
       WHEN qb.is_identifier AND NOT qa.is_identifier THEN cp.feature_a
       WHEN qa.is_exact_duplicate THEN coalesce(qa.duplicate_of, cp.feature_b)
       WHEN qb.is_exact_duplicate THEN coalesce(qb.duplicate_of, cp.feature_a)
       WHEN qb.missing_pct - qa.missing_pct >= 10 THEN cp.feature_a
       WHEN qa.missing_pct - qb.missing_pct >= 10 THEN cp.feature_b
       WHEN ma.mi_score - mb.mi_score >= 0.02 THEN cp.feature_a
       WHEN mb.mi_score - ma.mi_score >= 0.02 THEN cp.feature_b END AS preferred_feature
FROM cp LEFT JOIN q qa ON qa.feature = cp.feature_a LEFT JOIN q qb ON qb.feature = cp.feature_b
LEFT JOIN m ma ON ma.feature = cp.feature_a LEFT JOIN m mb ON mb.feature = cp.feature_b"""
