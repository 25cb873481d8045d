"""DuckDB oracle for the numeric column report (flagship)."""

from __future__ import annotations

from suite import names as N
from suite import sqlgen as G
from suite.schemas import cols, source_sql


def numeric_report(table: str) -> str:
    src = source_sql(table)
    parts = []
    for c, k in cols(table):
        if k not in ("int", "dbl", "bool"):
            continue
        v = G.num(c, k)
        r = f"round_even({v}, 0)"
        parts.append(f"""SELECT {G.lit(c)} AS column_name, count(*) AS n, count({v}) AS nn,
  count(DISTINCT {v}) AS nd, min({v}) AS mn, max({v}) AS mx, avg({v}) AS mean,
  quantile_cont({v}, 0.5) AS med, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.75) AS q3,
  stddev_pop({v}) AS sd, skewness({v}) AS sk, count(*) FILTER (WHERE {v} = 0) AS zc,
  count(*) FILTER (WHERE {v} < 0) AS nc,
  count(*) FILTER (WHERE abs({v} - {r}) > 1e-8 + 1e-5 * abs({r})) AS frac FROM {src} t""")
    fences = []
    for c, k in cols(table):
        if k not in ("int", "dbl", "bool"):
            continue
        v = G.num(c, k)
        fences.append(f"""SELECT s.column_name, count(*) FILTER (WHERE {v} < s.q1 - 1.5 * (s.q3 - s.q1)
  OR {v} > s.q3 + 1.5 * (s.q3 - s.q1)) AS oc FROM {src} t, s WHERE s.column_name = {G.lit(c)}
  GROUP BY s.column_name""")
    fenced = "(s.nn >= 8 AND s.q3 - s.q1 <> 0)"
    return f"""
WITH s AS ({G.union_all(parts)}),
o AS ({G.union_all(fences)})
SELECT s.column_name, CAST(s.n - s.nn AS BIGINT) AS missing_count,
  CASE WHEN s.n > 0 THEN round_even(CAST(s.n - s.nn AS DOUBLE) * 100.0 / s.n, 2) END AS missing_percentage,
  CAST(s.nn AS BIGINT) AS non_null, CAST(s.nd AS BIGINT) AS distinct_count,
  round_even(s.mn, 4) AS "min", round_even(s.mx, 4) AS "max", round_even(s.mean, 4) AS mean, round_even(s.med, 4) AS median,
  round_even(s.sd, 4) AS std, round_even(CASE WHEN s.nn >= 3 THEN s.sk WHEN s.nn > 0 THEN 0.0 END, 4) AS skewness,
  CAST(s.zc AS BIGINT) AS zero_count, CAST(s.nc AS BIGINT) AS negative_count,
  (s.nn > 0 AND s.frac = 0) AS integer_like,
  CASE WHEN {fenced} THEN round_even(s.q1 - 1.5 * (s.q3 - s.q1), 4) END AS lower_bound,
  CASE WHEN {fenced} THEN round_even(s.q3 + 1.5 * (s.q3 - s.q1), 4) END AS upper_bound,
  CASE WHEN {fenced} THEN CAST(o.oc AS BIGINT) END AS outlier_count
FROM s JOIN o ON s.column_name = o.column_name"""


def datetime_profile(table: str, names: list[str]) -> str:
    """Per datetime column: min/max, distinct calendar dates, range in days, time part, parse counts."""
    src = source_sql(table)
    kinds = dict(cols(table))
    parts = []
    for c in names:
        t = G.ts(c, kinds[c])
        parts.append(f"""SELECT {G.lit(c)} AS column_name, min({t}) AS min_date, max({t}) AS max_date,
  CAST(count(DISTINCT CAST({t} AS DATE)) AS BIGINT) AS unique_dates,
  round_even((epoch_us(max({t})) - epoch_us(min({t}))) / 86400e6, 2) AS date_range_days,
  coalesce(bool_or(hour({t}) + minute({t}) + second({t}) <> 0), false) AS has_time,
  CAST(count({t}) AS BIGINT) AS parseable_count,
  CAST(count({G.q(c)}) - count({t}) AS BIGINT) AS invalid_count FROM {src} t""")
    return G.union_all(parts)


def identifier_columns(table: str) -> str:
    """ID-like name, or more than one distinct value with distinct/rows >= 0.95."""
    src = source_sql(table)
    parts = []
    for c, k in cols(table):
        name_hit = "true" if N.is_identifier_name(c) else "false"
        v = f"(CASE WHEN NOT {G.missing(c, k)} THEN {G.q(c)} END)"
        uniq = (f"(count(*) > 1 AND count(DISTINCT {v}) > 1 AND "
                f"CAST(count(DISTINCT {v}) AS DOUBLE) / count(*) >= 0.95)")
        parts.append(f"SELECT {G.lit(c)} AS column_name, {name_hit} AS name_match, {uniq} AS high_uniqueness "
                     f"FROM {src} t")
    return f"SELECT * FROM ({G.union_all(parts)}) r WHERE name_match OR high_uniqueness"


_SPARK_TYPE = ("CASE typeof({c}) WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
               "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' "
               "ELSE lower(typeof({c})) END")


def profile_columns(table: str) -> str:
    """dtype, counts, distinct, smallest value as text (<= 80 chars), semantic type."""
    BOOLEAN_LITERALS = N.BOOLEAN_LITERALS
    src = source_sql(table)
    lits = ", ".join(G.lit(x) for x in BOOLEAN_LITERALS)
    parts = []
    for c, k in cols(table):
        q = G.q(c)
        v = f"(CASE WHEN NOT {G.missing(c, k)} THEN {q} END)"
        text = G.text(c, k)
        d = f"count(DISTINCT {v})"
        boollike = ("true" if k == "bool" else
                    f"({d} <= 4 AND count({v}) > 0 AND coalesce(bool_and(CASE WHEN {v} IS NOT NULL THEN "
                    f"lower({G.strip(text)}) IN ({lits}) END), false))")
        if k == "str":
            fr = ", ".join(f"CAST(count(*) FILTER (WHERE {G.ts_single(c, p)} IS NOT NULL) AS DOUBLE) / count({q})"
                           for p in G.STRPTIMES)
            dtl = f"(CASE WHEN count({q}) > 0 THEN greatest({fr}) ELSE 0.0 END) >= 0.8"
        else:
            dtl = "true" if k == "ts" else "false"
        numeric = "true" if k in ("int", "dbl", "bool") else "false"
        sem = (f"CASE WHEN {boollike} THEN 'boolean' WHEN {dtl} THEN 'datetime' WHEN {numeric} THEN 'numerical' "
               f"WHEN {d} <= 50 OR (count(*) > 0 AND CAST({d} AS DOUBLE) / count(*) <= 0.05) THEN 'categorical' "
               f"ELSE 'text' END")
        ex = f"min(CAST({v} AS VARCHAR))"
        parts.append(f"""SELECT {G.lit(c)} AS column_name, {_SPARK_TYPE.format(c='any_value(' + q + ')')} AS data_type,
  CAST(count({v}) AS BIGINT) AS non_null_count, CAST(count(*) FILTER (WHERE {G.missing(c, k)}) AS BIGINT) AS null_count,
  CAST({d} AS BIGINT) AS unique_values,
  CASE WHEN length({ex}) <= 80 THEN {ex} ELSE substr({ex}, 1, 77) || '...' END AS example_value,
  {sem} AS semantic_type, CAST(count(*) AS BIGINT) AS n_rows FROM {src} t""")
    return G.union_all(parts)


def high_cardinality(table: str) -> str:
    return (f"SELECT column_name, unique_values AS unique_count FROM ({profile_columns(table)}) p "
            f"WHERE semantic_type NOT IN ('numerical', 'boolean', 'datetime') AND n_rows > 0 "
            f"AND (unique_values > 50 OR CAST(unique_values AS DOUBLE) / n_rows > 0.5)")


def overview(table: str, target: str | None, target_kind: str | None) -> str:
    """Counts per semantic type, the first target by priority, and the problem type."""
    p = profile_columns(table)
    src = source_sql(table)
    if target is None:
        prob = "CAST(NULL AS VARCHAR)"
    else:
        d = f"(SELECT count(DISTINCT {G.q(target)}) FROM {src} t)"
        numeric = target_kind in ("int", "dbl")
        clf = f"{d} <= 20" if numeric else "true"
        prob = (f"CASE WHEN {d} = 2 THEN 'binary_classification' WHEN {clf} THEN 'multiclass_classification' "
                f"ELSE 'regression' END")
    cnt = lambda t: f"CAST(count(*) FILTER (WHERE semantic_type = '{t}') AS BIGINT) AS {t}"
    return (f"SELECT {cnt('numerical')}, {cnt('categorical')}, {cnt('datetime')}, {cnt('text')}, {cnt('boolean')}, "
            f"{G.lit(target) if target else 'CAST(NULL AS VARCHAR)'} AS target, {prob} AS problem_type FROM ({p}) x")


def column_types(table: str) -> str:
    return (f"SELECT semantic_type, count(*) AS n_columns, string_agg(column_name, ',' ORDER BY column_name) AS columns "
            f"FROM ({profile_columns(table)}) p GROUP BY semantic_type")


def target_candidates(table: str) -> str:
    names = ", ".join(G.lit(c) for c, _ in cols(table))
    return (f"SELECT c AS column_name FROM (SELECT unnest([{names}]) AS c) x "
            f"WHERE regexp_matches(replace(c, ' ', '_'), {G.lit(N.TARGET.pattern)}, 'i')")


def profile_report(table: str) -> str:
    none = "CAST(NULL AS VARCHAR) AS detail"
    return f"""
SELECT 'column_types' AS section, semantic_type AS item, columns AS detail FROM ({column_types(table)}) a
UNION ALL SELECT 'identifier_columns', column_name, {none} FROM ({identifier_columns(table)}) b
UNION ALL SELECT 'potential_target_columns', column_name, {none} FROM ({target_candidates(table)}) c
UNION ALL SELECT 'constant_columns', column_name, {none} FROM ({profile_columns(table)}) d WHERE unique_values <= 1
UNION ALL SELECT 'high_cardinality_columns', column_name, CAST(unique_count AS VARCHAR) FROM ({high_cardinality(table)}) e"""
