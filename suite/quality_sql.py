"""DuckDB oracles for the quality checks (independent SQL, same rules)."""

from __future__ import annotations

from itertools import combinations

from suite import names as N
from suite import sqlgen as G
from suite.schemas import cols, source_sql


def _pct(x: str, n: str = "n") -> str:
    return f"(CAST({x} AS DOUBLE) * 100.0 / {n})"


def missing_values(table: str) -> str:
    cs = cols(table)
    aggs = ", ".join(f"count(*) FILTER (WHERE {G.missing(c, k)}) AS m{i}" for i, (c, k) in enumerate(cs))
    parts = [f"SELECT {G.lit(c)} AS column_name, m{i} AS cnt, n FROM s" for i, (c, _) in enumerate(cs)]
    return f"""
WITH s AS (SELECT count(*) AS n, {aggs} FROM {source_sql(table)} t),
r AS ({G.union_all(parts)})
SELECT column_name, CAST(cnt AS BIGINT) AS "count", round_even({_pct('cnt')}, 2) AS percentage,
  CASE WHEN {_pct('cnt')} < 5 THEN 'Low' WHEN {_pct('cnt')} <= 20 THEN 'Medium' ELSE 'High' END AS severity
FROM r WHERE cnt > 0"""


def constant_columns(table: str) -> str:
    cs = cols(table)
    parts = [f"SELECT {G.lit(c)} AS column_name FROM {source_sql(table)} t "
             f"HAVING count(DISTINCT CASE WHEN NOT {G.missing(c, k)} THEN {G.q(c)} END) <= 1"
             for c, k in cs]
    return G.union_all(parts)


def high_missing_columns(table: str, thr: float = 0.5) -> str:
    cs = cols(table)
    aggs = ", ".join(f"count(*) FILTER (WHERE {G.missing(c, k)}) AS m{i}" for i, (c, k) in enumerate(cs))
    parts = [f"SELECT {G.lit(c)} AS column_name, m{i} AS cnt, n FROM s" for i, (c, _) in enumerate(cs)]
    return f"""
WITH s AS (SELECT count(*) AS n, {aggs} FROM {source_sql(table)} t),
r AS ({G.union_all(parts)})
SELECT column_name, round_even({_pct('cnt')}, 2) AS missing_percentage FROM r
WHERE CAST(cnt AS DOUBLE) / n > {thr}"""


def duplicate_rows(table: str) -> str:
    names = ", ".join(G.q(c) for c, _ in cols(table))
    return f"""
WITH g AS (SELECT count(*) AS k FROM {source_sql(table)} t GROUP BY {names})
SELECT CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS "count",
  CASE WHEN coalesce(sum(k), 0) > 0 THEN round_even(CAST(sum(k - 1) AS DOUBLE) * 100.0 / sum(k), 2)
       ELSE 0.0 END AS percentage
FROM g"""


def duplicate_columns(table: str) -> str:
    """All pairs compared exhaustively; a column's original is its first equal predecessor."""
    cs = cols(table)
    pairs = list(combinations(range(len(cs)), 2))
    aggs = ", ".join(
        f"bool_and({G.text(cs[i][0], cs[i][1])} IS NOT DISTINCT FROM {G.text(cs[j][0], cs[j][1])}) AS e{i}_{j}"
        for i, j in pairs)
    parts = []
    for j in range(1, len(cs)):
        case = " ".join(f"WHEN e{i}_{j} THEN {G.lit(cs[i][0])}" for i in range(j))
        parts.append(f"SELECT {G.lit(cs[j][0])} AS duplicate_column, CASE {case} END AS original_column FROM e")
    return f"""
WITH e AS (SELECT {aggs} FROM {source_sql(table)} t),
r AS ({G.union_all(parts)})
SELECT duplicate_column, original_column, CAST(100.0 AS DOUBLE) AS similarity FROM r
WHERE original_column IS NOT NULL"""


def near_duplicate_columns(table: str, dup_cols: set[str]) -> str:
    """Pairs with equal dtype and null count, agreement in [0.95, 1)."""
    cs = [(c, k) for c, k in cols(table) if c not in dup_cols]
    # dtype buckets are static; the null-count condition is evaluated in SQL
    pairs = [(a, b) for a, b in combinations(cs, 2) if a[1] == b[1]]
    if not pairs:
        return "SELECT NULL AS column_a, NULL AS column_b, NULL AS similarity WHERE false"
    miss = ", ".join(f"count(*) FILTER (WHERE {G.missing(c, k)}) AS m_{i}" for i, (c, k) in enumerate(cs))
    idx = {c: i for i, (c, _) in enumerate(cs)}
    agree = ", ".join(
        f"count(*) FILTER (WHERE (CASE WHEN NOT {G.missing(a, ka)} THEN {G.q(a)} END) IS NOT DISTINCT FROM "
        f"(CASE WHEN NOT {G.missing(b, kb)} THEN {G.q(b)} END)) AS p_{idx[a]}_{idx[b]}"
        for (a, ka), (b, kb) in pairs)
    parts = [f"SELECT {G.lit(a)} AS column_a, {G.lit(b)} AS column_b, "
             f"CAST(p_{idx[a]}_{idx[b]} AS DOUBLE) / n AS ratio, m_{idx[a]} = m_{idx[b]} AS same_nulls FROM s"
             for (a, _), (b, _) in pairs]
    return f"""
WITH s AS (SELECT count(*) AS n, {miss}, {agree} FROM {source_sql(table)} t),
r AS ({G.union_all(parts)})
SELECT column_a, column_b, round_even(ratio * 100.0, 2) AS similarity FROM r
WHERE same_nulls AND ratio >= 0.95 AND ratio < 1.0"""


def _dtl(c: str) -> str:
    """Best single-format parse ratio among non-null values."""
    fr = ", ".join(f"CAST(count(*) FILTER (WHERE {G.ts_single(c, p)} IS NOT NULL) AS DOUBLE) / "
                   f"count({G.q(c)})" for p in G.STRPTIMES)
    return f"(CASE WHEN count({G.q(c)}) > 0 THEN greatest({fr}) ELSE 0.0 END)"


def suspicious_types(table: str) -> str:
    parts = []
    for c, k in cols(table):
        if k != "str":
            continue
        nn = f"count({G.q(c)})"
        num_ratio = f"(CAST(count({G.num(c, k)}) AS DOUBLE) / {nn})"
        date_ratio = f"(CAST(count({G.ts(c, k)}) AS DOUBLE) / {nn})"
        name_hit = "true" if N.matches(N.QUALITY_DATE, c) else "false"
        issue = (f"CASE WHEN {nn} = 0 THEN NULL WHEN {num_ratio} >= 0.8 THEN 'numeric_stored_as_text' "
                 f"WHEN ({_dtl(c)} >= 0.8 OR {name_hit}) AND {date_ratio} >= 0.8 THEN 'date_stored_as_text' END")
        parts.append(f"SELECT {G.lit(c)} AS column_name, {issue} AS issue_type, "
                     f"round_even(CASE WHEN {nn} > 0 THEN {num_ratio} END, 4) AS numeric_ratio "
                     f"FROM {source_sql(table)} t")
    return f"SELECT * FROM ({G.union_all(parts)}) r WHERE issue_type IS NOT NULL"


def invalid_values(table: str, year: int) -> str:
    parts = []
    src = source_sql(table)
    for c, k in cols(table):
        if N.matches(N.QUALITY_AGE, c):
            parts.append(f"SELECT {G.lit(c)} AS column_name, 'negative_age' AS issue_type, "
                         f"count(*) FILTER (WHERE {G.num(c, k)} < 0) AS cnt FROM {src} t")
        if N.matches(N.QUALITY_SALARY, c):
            parts.append(f"SELECT {G.lit(c)} AS column_name, 'negative_salary' AS issue_type, "
                         f"count(*) FILTER (WHERE {G.num(c, k)} < 0) AS cnt FROM {src} t")
        if N.matches(N.QUALITY_EMAIL, c):
            t = G.strip(G.text(c, k))
            parts.append(f"SELECT {G.lit(c)} AS column_name, 'invalid_email' AS issue_type, "
                         f"count(*) FILTER (WHERE {t} IS NOT NULL AND NOT regexp_matches({t}, "
                         f"{G.lit(N.EMAIL_VALUE)})) AS cnt FROM {src} t")
        named = N.matches(N.QUALITY_DATE, c) or k == "ts"
        if named or k == "str":
            v = G.ts(c, k)
            bad = f"count(*) FILTER (WHERE year({v}) < 1900 OR year({v}) > {year + 1})"
            if not named:
                bad = f"(CASE WHEN {_dtl(c)} >= 0.8 THEN {bad} ELSE 0 END)"
            parts.append(f"SELECT {G.lit(c)} AS column_name, 'impossible_date' AS issue_type, "
                         f"{bad} AS cnt FROM {src} t")
    return (f"SELECT column_name, issue_type, CAST(cnt AS BIGINT) AS \"count\" "
            f"FROM ({G.union_all(parts)}) r WHERE cnt > 0")


def iqr_outliers(table: str, coerce: bool = True) -> str:
    parts = []
    src = source_sql(table)
    for c, k in cols(table):
        if k not in ("int", "dbl", "bool") and not (coerce and k == "str"):
            continue
        v = G.num(c, k)
        parts.append(f"""SELECT {G.lit(c)} AS column_name,
  count({v}) AS nn, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3 FROM {src} t""")
    fences = f"""
WITH q AS ({G.union_all(parts)}),
b AS (SELECT column_name, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q
      WHERE nn >= 8 AND q3 - q1 <> 0)"""
    counts = []
    for c, k in cols(table):
        if k not in ("int", "dbl", "bool") and not (coerce and k == "str"):
            continue
        v = G.num(c, k)
        counts.append(f"""SELECT b.column_name, count(*) FILTER (WHERE {v} < b.lo OR {v} > b.hi) AS cnt,
  round_even(b.lo, 4) AS lower_bound, round_even(b.hi, 4) AS upper_bound
FROM {src} t, b WHERE b.column_name = {G.lit(c)} GROUP BY b.column_name, b.lo, b.hi""")
    return f"""{fences}
SELECT column_name, CAST(cnt AS BIGINT) AS outlier_count, lower_bound, upper_bound
FROM ({G.union_all(counts)}) r WHERE cnt > 0"""


def class_imbalance(table: str, target: str, kind: str) -> str:
    src = source_sql(table)
    return f"""
WITH c AS (SELECT {G.text(target, kind)} AS label, count(*) AS cnt FROM {src} t
           WHERE NOT {G.missing(target, kind)} GROUP BY 1),
s AS (SELECT sum(cnt) AS total, max(cnt) AS mx, min(cnt) AS mn FROM c)
SELECT {G.lit(target)} AS target_column, label, CAST(cnt AS BIGINT) AS "count",
  round_even(CAST(cnt AS DOUBLE) * 100.0 / total, 2) AS percentage,
  round_even(CAST(mx AS DOUBLE) * 100.0 / total, 2) AS majority_percentage,
  round_even(CAST(mx AS DOUBLE) / mn, 2) AS imbalance_ratio,
  round_even(CAST(mx AS DOUBLE) * 100.0 / total, 2) >= 90 AS is_severe,
  CASE WHEN round_even(CAST(mx AS DOUBLE) * 100.0 / total, 2) >= 90 THEN 'severe'
       WHEN round_even(CAST(mx AS DOUBLE) * 100.0 / total, 2) >= 80 THEN 'moderate'
       ELSE 'balanced' END AS level
FROM c, s"""


def frequency_profile(table: str, column: str, kind: str) -> str:
    src = source_sql(table)
    v = G.text(column, kind)
    return f"""
WITH c AS (SELECT {v} AS category, count(*) AS cnt FROM {src} t WHERE NOT {G.missing(column, kind)} GROUP BY 1),
s AS (SELECT sum(cnt) AS total, count(*) AS cats FROM c),
top AS (SELECT category, cnt, row_number() OVER (ORDER BY cnt DESC, category) AS rk FROM c),
r AS (SELECT category, cnt, rk, round_even(CAST(cnt AS DOUBLE) * 100.0 / s.total, 2) AS pct, s.total, s.cats
      FROM top, s WHERE rk <= 12),
d AS (SELECT max(CASE WHEN rk = 1 THEN pct END) AS p1, coalesce(max(CASE WHEN rk = 2 THEN pct END), 0.0) AS p2 FROM r)
SELECT {G.lit(column)} AS column_name, category, CAST(cnt AS BIGINT) AS "count", pct AS percentage,
  CAST(rk AS INTEGER) AS rank, d.p1 / 100.0 AS dominant_share, d.p2 / 100.0 AS second_share,
  round_even(d.p1 - d.p2, 2) AS gap_to_second, CAST(total AS BIGINT) AS non_null_count,
  CAST(cats AS BIGINT) AS n_categories,
  (cats >= 2 AND d.p1 / 100.0 < 0.45 AND (d.p1 - d.p2) / 100.0 <= 0.10) AS is_uniform
FROM r, d"""


def snapshot(table: str) -> str:
    cs = cols(table)
    src = source_sql(table)
    miss = " + ".join(f"count(*) FILTER (WHERE {G.missing(c, k)})" for c, k in cs)
    nums = [(c, k) for c, k in cs if k in ("int", "dbl", "bool")]
    fence_parts = [f"SELECT {G.lit(c)} AS column_name, count({G.num(c, k)}) AS nn, quantile_cont({G.num(c, k)}, 0.25) AS q1, "
                   f"quantile_cont({G.num(c, k)}, 0.75) AS q3 FROM {src} t" for c, k in nums]
    cnt_parts = [f"SELECT count(*) FILTER (WHERE {G.num(c, k)} < b.q1 - 1.5 * (b.q3 - b.q1) OR "
                 f"{G.num(c, k)} > b.q3 + 1.5 * (b.q3 - b.q1)) AS oc FROM {src} t, b "
                 f"WHERE b.column_name = {G.lit(c)} AND b.nn >= 8 AND b.q3 - b.q1 <> 0" for c, k in nums]
    return f"""
WITH b AS ({G.union_all(fence_parts)}),
o AS ({G.union_all(cnt_parts)})
SELECT CAST((SELECT count(*) FROM {src} t) AS BIGINT) AS "rows", {len(cs)} AS "columns",
  CAST((SELECT {miss} FROM {src} t) AS BIGINT) AS total_missing,
  CAST((SELECT coalesce(sum(k - 1), 0) FROM (SELECT count(*) AS k FROM {src} t GROUP BY {", ".join(G.q(c) for c, _ in cs)}) g)
       AS BIGINT) AS duplicate_rows,
  CAST((SELECT coalesce(sum(oc), 0) FROM o) AS BIGINT) AS outlier_cells"""


def quality_score(table: str, year: int, target: str | None, target_kind: str | None) -> str:
    """Rule R5 over the individual check oracles: penalties, half-even rounding, clamp, level.
    ``target`` is the first target-named column (None when no column name qualifies)."""
    src = source_sql(table)
    ci = ("SELECT 0.0 AS p" if target is None else
          f"SELECT coalesce(max(CASE WHEN is_severe THEN 10.0 WHEN majority_percentage >= 80 THEN 5.0 "
          f"ELSE 0.0 END), 0.0) AS p FROM ({class_imbalance(table, target, target_kind)}) x")
    pen = f"""
WITH n AS (SELECT count(*) AS n FROM {src} t),
mv AS (SELECT coalesce(sum(CASE severity WHEN 'Low' THEN 0.5 WHEN 'Medium' THEN 2.0 ELSE 4.0 END), 0.0) AS p
       FROM ({missing_values(table)}) x),
dr AS (SELECT percentage FROM ({duplicate_rows(table)}) x),
cc AS (SELECT count(*) AS k FROM ({constant_columns(table)}) x),
hm AS (SELECT count(*) AS k FROM ({high_missing_columns(table)}) x),
iv AS (SELECT coalesce(sum(least(3.0, 1.0 + CAST(x."count" AS DOUBLE) / greatest(n.n, 1) * 10.0)), 0.0) AS p
       FROM ({invalid_values(table, year)}) x, n),
ol AS (SELECT coalesce(sum(least(2.0, CAST(x.outlier_count AS DOUBLE) / greatest(n.n, 1) * 20.0)), 0.0) AS p
       FROM ({iqr_outliers(table)}) x, n),
ci AS ({ci}),
b AS (SELECT least(25.0, mv.p) AS missing_values,
             CASE WHEN n.n > 0 THEN least(15.0, dr.percentage * 0.4) ELSE 0.0 END AS duplicate_rows,
             least(10.0, cc.k * 2.0) AS constant_columns, least(15.0, hm.k * 5.0) AS high_missing_columns,
             least(15.0, iv.p) AS invalid_values, least(10.0, ol.p) AS outliers, ci.p AS class_imbalance
      FROM n, mv, dr, cc, hm, iv, ol, ci),
s AS (SELECT *, CAST(greatest(0, least(100, round_even(100.0 - (missing_values + duplicate_rows + constant_columns
        + high_missing_columns + invalid_values + outliers + class_imbalance), 0))) AS INTEGER) AS score FROM b)
SELECT score, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 60 THEN 'Fair'
  ELSE 'Poor' END AS level,
  round_even(CAST(missing_values AS DOUBLE), 4) AS missing_values,
  round_even(CAST(duplicate_rows AS DOUBLE), 4) AS duplicate_rows,
  round_even(CAST(constant_columns AS DOUBLE), 4) AS constant_columns,
  round_even(CAST(high_missing_columns AS DOUBLE), 4) AS high_missing_columns,
  round_even(CAST(invalid_values AS DOUBLE), 4) AS invalid_values, round_even(CAST(outliers AS DOUBLE), 4) AS outliers,
  round_even(CAST(class_imbalance AS DOUBLE), 4) AS class_imbalance FROM s"""
    return pen


def findings(table: str, year: int, target: str, kind: str) -> str:
    """PIP-3: every section's findings, from the single checks."""
    src = source_sql(table)
    total = f"(SELECT count(*) FROM {src} t)"
    parts = [
        f"SELECT 'missing_values' AS section, column_name, 'missing' AS issue, count, percentage FROM ({missing_values(table)}) x",
        f"SELECT 'duplicate_rows', NULL, 'duplicate_rows', count, percentage FROM ({duplicate_rows(table)}) x WHERE count > 0",
        f"SELECT 'constant_columns', column_name, 'constant', 1, 100.0 FROM ({constant_columns(table)}) x",
        f"SELECT 'high_missing_columns', h.column_name, 'high_missing', m.count, m.percentage FROM "
        f"({high_missing_columns(table)}) h JOIN ({missing_values(table)}) m ON m.column_name = h.column_name",
        f"SELECT 'invalid_values', column_name, issue_type, count, round_even(count * 100.0 / {total}, 2) "
        f"FROM ({invalid_values(table, year)}) x",
        f"SELECT 'outliers', column_name, 'iqr_outliers', outlier_count, round_even(outlier_count * 100.0 / {total}, 2) "
        f"FROM ({iqr_outliers(table)}) x",
        f"SELECT 'class_imbalance', any_value(target_column), 'majority_class', max(count), any_value(majority_percentage) "
        f"FROM ({class_imbalance(table, target, kind)}) x",
    ]
    return ("SELECT section, column_name, issue, CAST(count AS BIGINT) AS count, CAST(percentage AS DOUBLE) AS percentage "
            f"FROM ({G.union_all(parts)}) f")
