"""DuckDB oracle for categorical imputation (IMP-5 .. IMP-10), column by column."""

from __future__ import annotations

from suite import names as N
from suite import sqlgen as G
from suite.schemas import INT32, cols, source_sql


def _step(prev: str, out: str, target: str, cands: list[str], all_cols: list[str], key: str,
          seed: int = 42) -> str:
    """CTEs that fill ``target`` in ``prev`` and expose the result as ``out``."""
    t = G.q(target)
    # candidate stats: 2..50 distinct, distinct/rows <= 0.5; order by distinct, then column position
    cstats = G.union_all([
        f"SELECT {i} AS pos, {G.lit(c)} AS name, count(DISTINCT {G.q(c)}) AS nd, count(*) AS n FROM {prev}"
        for i, c in enumerate(cands)])
    groups = G.union_all([
        f"SELECT {i} AS pos, CAST({G.q(c)} AS VARCHAR) AS gv, CAST({t} AS VARCHAR) AS v, count(*) AS k "
        f"FROM {prev} WHERE {t} IS NOT NULL AND {G.q(c)} IS NOT NULL GROUP BY 1, 2, 3" for i, c in enumerate(cands)])
    lookups = G.union_all([
        f"SELECT p.{G.q(key)} AS rk, e.conf4, e.ord, e.top FROM {prev} p JOIN {out}_elig e "
        f"ON e.pos = {i} AND e.gv = CAST(p.{G.q(c)} AS VARCHAR) WHERE p.{t} IS NULL" for i, c in enumerate(cands)])
    u = (f"(CAST(('0x' || substr(md5('{seed}|{target}|' || CAST(p.{G.q(key)} AS VARCHAR)), 1, 8)) AS BIGINT) "
         f"/ 4294967296.0)")
    others = ", ".join(f"p.{G.q(c)}" for c in all_cols if c != target)
    return f"""
{out}_cs AS (SELECT pos, name, nd, n, nd >= 2 AND nd <= 50 AND CAST(nd AS DOUBLE) / n <= 0.5 AS ok FROM ({cstats}) x),
{out}_ord AS (SELECT pos, row_number() OVER (ORDER BY nd, pos) AS ord FROM {out}_cs WHERE ok),
{out}_g AS ({groups}),
{out}_tab AS (SELECT pos, gv, sum(k) OVER (PARTITION BY pos, gv) AS size, k, v,
                     row_number() OVER (PARTITION BY pos, gv ORDER BY k DESC, v) AS r FROM {out}_g),
{out}_elig AS (SELECT t.pos, t.gv, t.v AS top, round_even(CAST(t.k AS DOUBLE) / t.size, 4) AS conf4, o.ord
               FROM {out}_tab t JOIN {out}_ord o ON o.pos = t.pos
               WHERE t.r = 1 AND t.size >= 10 AND CAST(t.k AS DOUBLE) / t.size >= 0.60),
{out}_best AS (SELECT rk, top FROM (SELECT rk, top, row_number() OVER (PARTITION BY rk ORDER BY conf4 DESC, ord) AS r
               FROM ({lookups}) l) x WHERE r = 1),
{out}_f AS (SELECT CAST({t} AS VARCHAR) AS v, count(*) AS k FROM {prev} WHERE {t} IS NOT NULL GROUP BY 1),
{out}_fs AS (SELECT sum(k) AS total, count(*) AS cats,
                    max(k) AS topk, arg_min(v, (-k)::BIGINT) AS _x FROM {out}_f),
{out}_dom AS (SELECT v AS dominant FROM {out}_f ORDER BY k DESC, v LIMIT 1),
{out}_m AS (SELECT CASE WHEN total >= 3 AND total >= 20 AND round_even(CAST(topk AS DOUBLE) * 100.0 / total, 2) / 100.0 >= 0.60
                        THEN 'global' WHEN total >= 20 AND cats >= 2 THEN 'distribution'
                        WHEN total < 3 THEN 'review' ELSE 'unknown' END AS method FROM {out}_fs),
{out}_iv AS (SELECT v, (sum(k) OVER (ORDER BY k DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k)
                     / CAST((SELECT total FROM {out}_fs) AS DOUBLE) AS lo,
                    sum(k) OVER (ORDER BY k DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     / CAST((SELECT total FROM {out}_fs) AS DOUBLE) AS hi FROM {out}_f),
{out} AS (SELECT {others},
  CASE WHEN (SELECT method FROM {out}_m) = 'review' THEN p.{t}
       ELSE coalesce(p.{t}, b.top,
            CASE (SELECT method FROM {out}_m)
              WHEN 'global' THEN (SELECT dominant FROM {out}_dom)
              WHEN 'unknown' THEN 'Unknown'
              ELSE (SELECT iv.v FROM {out}_iv iv WHERE {u} >= iv.lo AND {u} < iv.hi) END) END AS {t}
  FROM {prev} p LEFT JOIN {out}_best b ON b.rk = p.{G.q(key)})"""


def _numeric_fills(prev: str, out: str, table: str, columns: list[tuple[str, str]] | None = None) -> str:
    """Mean, or median when |G1| >= 1 with >= 8 values; integral columns rounded half-even."""
    stats, items = [], []
    for i, (c, k) in enumerate(columns or cols(table)):
        q = G.q(c)
        if k not in ("int", "dbl"):
            items.append(f"p.{q}")
            continue
        v = f"CAST({q} AS DOUBLE)"
        stats.append(f"count({v}) AS k{i}, avg({v}) AS a{i}, quantile_cont({v}, 0.5) AS q{i}, skewness({v}) AS s{i}, "
                     f"count(*) FILTER (WHERE {q} IS NULL) AS m{i}, count(*) AS n{i}")
        fill = f"(CASE WHEN x.k{i} >= 8 AND abs(x.s{i}) >= 1.0 THEN x.q{i} ELSE x.a{i} END)"
        filled = f"coalesce(CAST(p.{q} AS DOUBLE), {fill})"
        itype = "INTEGER" if (table, c) in INT32 else "BIGINT"
        expr = f"CAST(round_even({filled}, 0) AS {itype})" if k == "int" else filled
        items.append(f"CASE WHEN x.m{i} = 0 OR CAST(x.m{i} AS DOUBLE) / x.n{i} > 0.70 OR x.m{i} = x.n{i} "
                     f"THEN p.{q} ELSE {expr} END AS {q}")
    return (f"{out}_x AS (SELECT {', '.join(stats)} FROM {prev}), "
            f"{out} AS (SELECT {', '.join(items)} FROM {prev} p, {out}_x x)")


def categorical_imputation(table: str, key: str, targets: list[str], exclude: tuple[str, ...] = (),
                           numeric: bool = False) -> str:
    """Empty strings -> null, numeric fills (optional), then fill each target column in
    schema order. ``exclude``: exact-duplicate columns, never grouping features."""
    names = [c for c, _ in cols(table)]
    texts = [c for c, k in cols(table) if k == "str"]
    norm = ", ".join(f"CASE WHEN {G.q(c)} IS NOT NULL AND {G.strip(G.q(c))} = '' THEN NULL ELSE {G.q(c)} END AS {G.q(c)}"
                     if c in texts else G.q(c) for c in names)
    ctes = [f"s0 AS (SELECT {norm} FROM {source_sql(table)} t)"]
    prev = "s0"
    if numeric:
        ctes.append(_numeric_fills(prev, "sn", table))
        prev = "sn"
    for i, tgt in enumerate(targets, start=1):
        cands = [c for c in texts if c != tgt and c not in exclude and not N.is_identifier_name(c)]
        ctes.append(_step(prev, f"s{i}", tgt, cands, names, key).strip())
        prev = f"s{i}"
    cols_out = ", ".join(G.q(c) for c in names)
    return "WITH " + ",\n".join(ctes) + f"\nSELECT {cols_out} FROM {prev}"


def clean_pipeline(table: str, key: str, numbers_as_text: list[str], targets: list[str], copies: tuple[str, ...]) -> str:
    """Blanks -> types -> domain rules -> copies out -> numeric and categorical fills -> distinct rows.

    A text column is parsed where 95 % of its values are numbers, and whole numbers come out as such.
    """
    kinds = {c: "int" if c in numbers_as_text else k for c, k in cols(table) if c not in copies}
    blank = lambda c, k: (f"CASE WHEN {G.strip(G.q(c))} <> '' THEN {G.q(c)} END AS {G.q(c)}" if k == "str" else G.q(c))
    ctes = [f"s0 AS (SELECT {', '.join(blank(c, k) for c, k in cols(table))} FROM {source_sql(table)} t)"]
    parsed = []
    for c, k in cols(table):
        if c in numbers_as_text:
            v = G.num(c, "str")
            enough = f"(SELECT count({v}) >= 0.95 * count({G.q(c)}) FROM s0)"
            whole = f"(SELECT bool_and({v} = round({v})) FROM s0 WHERE {v} IS NOT NULL)"
            parsed.append(f"CASE WHEN {enough} AND {whole} THEN CAST({v} AS BIGINT) END AS {G.q(c)}")
        elif c not in copies:
            parsed.append(G.q(c))
    ctes.append(f"s1 AS (SELECT {', '.join(parsed)} FROM s0)")
    ruled = []
    for c, k in kinds.items():
        high = f" OR {G.q(c)} > 120" if N.matches(N.CLEAN_AGE, c) else ""
        domain = k in ("int", "dbl") and any(N.matches(p, c) for p in (N.CLEAN_AGE, N.CLEAN_SALARY, N.CLEAN_QUANTITY))
        ruled.append(f"CASE WHEN NOT coalesce({G.q(c)} < 0{high}, false) THEN {G.q(c)} END AS {G.q(c)}" if domain else G.q(c))
    ctes.append(f"s2 AS (SELECT {', '.join(ruled)} FROM s1)")
    ctes.append(_numeric_fills("s2", "s3", table, list(kinds.items())))
    prev = "s3"
    for i, target in enumerate(targets):
        cands = [c for c, k in kinds.items() if k == "str" and c != target and not N.is_identifier_name(c)]
        ctes.append(_step(prev, f"f{i}", target, cands, list(kinds), key).strip())
        prev = f"f{i}"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT DISTINCT {', '.join(G.q(c) for c in kinds)} FROM {prev}"
