"""DuckDB oracle for feature-type detection (DET-1..4, R8 by brute force, R13, R19)."""

from __future__ import annotations

from suite import names as N
from suite.names import BOOLEAN_LITERALS
from suite import sqlgen as G
from suite.schemas import cols, source_sql


def _facts(table: str, c: str, k: str) -> str:
    src = source_sql(table)
    q = G.q(c)
    v = f"(CASE WHEN NOT {G.missing(c, k)} THEN {q} END)"
    text = G.text(c, k)
    lits = ", ".join(G.lit(x) for x in BOOLEAN_LITERALS)
    parts = [f"count(*) AS n", f"count({v}) AS nn", f"count(DISTINCT {v}) AS d",
             f"coalesce(bool_and(CASE WHEN {v} IS NOT NULL THEN lower({G.strip(text)}) IN ({lits}) END), false) AS allbool"]
    if k == "str":
        fr = ", ".join(f"CAST(count(*) FILTER (WHERE {G.ts_single(c, p)} IS NOT NULL) AS DOUBLE) / count({q})"
                       for p in G.STRPTIMES)
        parts += [f"CASE WHEN count({q}) > 0 THEN greatest({fr}) ELSE 0.0 END AS dtr",
                  f"CAST(count({G.num(c, k)}) AS DOUBLE) / greatest(count({q}), 1) AS numr",
                  f"avg(length({q})) AS mlen",
                  f"CAST(count(*) FILTER (WHERE regexp_matches({G.strip(q)}, {G.lit(N.EMAIL_VALUE)})) AS DOUBLE) "
                  f"/ greatest(count({q}), 1) AS emr"]
    else:
        parts += ["CAST(NULL AS DOUBLE) AS dtr", "CAST(NULL AS DOUBLE) AS numr", "CAST(NULL AS DOUBLE) AS mlen",
                  "0.0 AS emr"]
    if k in ("int", "dbl", "bool"):
        x = G.num(c, k)
        r = f"round_even({x}, 0)"
        parts.append(f"count(*) FILTER (WHERE abs({x} - {r}) > 1e-8 + 1e-5 * abs({r})) = 0 AS intlike")
    else:
        parts.append("false AS intlike")
    top = (f"(SELECT coalesce(max(cnt), 0) FROM (SELECT count(*) AS cnt FROM {src} t WHERE {v} IS NOT NULL "
           f"GROUP BY {text}) x) AS topk")
    # R8 by brute force: median of the differences of the sorted values
    med = (f"(SELECT quantile_cont(diff, 0.5) FROM (SELECT CAST({G.num(c, k)} AS DOUBLE) - "
           f"lag(CAST({G.num(c, k)} AS DOUBLE)) OVER (ORDER BY CAST({G.num(c, k)} AS DOUBLE)) AS diff "
           f"FROM {src} t WHERE {v} IS NOT NULL) y WHERE diff IS NOT NULL) AS meddiff") \
        if k in ("int", "dbl") else "CAST(NULL AS DOUBLE) AS meddiff"
    return f"SELECT {G.lit(c)} AS column_name, {', '.join(parts)}, {top}, {med} FROM {src} t"


def feature_types(table: str) -> str:
    rows = []
    for c, k in cols(table):
        name_hit = N.is_identifier_name(c)
        person = N.matches(N.FE_PERSON_NAME, c)
        text_name = N.matches(N.FE_TEXT, c)
        numeric = k in ("int", "dbl", "bool")
        low = c.lower()
        kind_named = next((kind for key, kind in (("review", "reviews"), ("address", "addresses"),
                                                  ("comment", "comments"), ("note", "comments"),
                                                  ("desc", "descriptions")) if key in low), None)
        u = "(CAST(d AS DOUBLE) / n)"
        boollike = "true" if k == "bool" else "(nn > 0 AND d <= 4 AND allbool)"
        seq = (f"({'true' if numeric else 'false'} AND intlike AND nn >= 3 "
               f"AND d >= greatest(10, CAST(floor(0.9 * n) AS BIGINT)) AND {u} >= 0.95 AND meddiff IN (0.0, 1.0))")
        if person and not name_hit:
            ident = "false"
        else:
            ident = (f"(({'true' if name_hit else 'false'} AND {u} >= 0.5) OR "
                     f"({'false' if numeric else 'true'} AND {u} >= 0.95 AND d > greatest(5, CAST(floor(0.5 * n) AS BIGINT))) OR "
                     f"({seq} AND {u} >= 0.95) OR ({'true' if k == 'str' else 'false'} AND emr >= 0.8 AND {u} >= 0.9))")
        if k == "str":
            not_text = f"(d <= 50 AND {u} < 0.5 AND {'false' if text_name else 'true'} AND mlen < 40)"
            is_text = f"({'true' if text_name else 'false'} OR mlen >= 80 OR ({u} >= 0.7 AND mlen >= 40))"
            kind_default = "CASE WHEN mlen >= 80 THEN 'long/free-form text' ELSE 'short text' END"
            kind_expr = G.lit(kind_named) if kind_named else kind_default
            tkind = (f"CASE WHEN nn = 0 OR {not_text} THEN NULL "
                     + (f"WHEN mlen < 80 THEN 'names' " if person else "")
                     + f"WHEN {is_text} THEN {kind_expr} ELSE NULL END")
        else:
            tkind = "CAST(NULL AS VARCHAR)"
        dt = "true" if k == "ts" else (f"dtr >= 0.8" if k == "str" else "false")
        ftype = (f"CASE WHEN nn > 0 AND d <= 1 THEN 'constant / near-constant' "
                 f"WHEN nn > 0 AND CAST(topk AS DOUBLE) / nn >= 0.98 AND d > 1 AND NOT {boollike} THEN 'constant / near-constant' "
                 f"WHEN {ident} THEN 'identifier' WHEN {boollike} THEN 'boolean' WHEN {dt} THEN 'datetime' "
                 f"WHEN ({tkind}) IS NOT NULL THEN 'text' "
                 + ("WHEN true THEN 'numerical' " if numeric else "")
                 + ("WHEN nn > 0 AND numr >= 0.9 THEN 'numerical' WHEN true THEN 'categorical' " if k == "str" else "")
                 + "ELSE 'unknown / other' END")
        rows.append(f"SELECT column_name, {ftype} AS feature_type, CAST(d AS BIGINT) AS unique_count, "
                    f"round_even({u}, 4) AS uniqueness, {ident} AS is_identifier, {tkind} AS text_kind "
                    f"FROM ({_facts(table, c, k)}) f")
    return G.union_all(rows)


def opportunities(table: str, target: str | None) -> str:
    """DET-8 report: per column primary opportunity and priorities, advice rows, name-based relationships."""
    src = source_sql(table)
    ft = feature_types(table)
    per_col = []
    for c, k in cols(table):
        x = G.num(c, k)
        v = f"(CASE WHEN NOT {G.missing(c, k)} THEN {G.q(c)} END)"
        text = G.text(c, k)
        age = "true" if N.matches(N.FE_AGE, c) else "false"
        per_col.append(
            f"SELECT {G.lit(c)} AS column_name, round_even(coalesce(skewness({x}), 0.0), 4) AS sk, min({x}) AS mn, "
            f"max({x}) AS mx, count({x}) AS nx, {age} AS agename, count({v}) AS nn, count(DISTINCT {v}) AS d, "
            f"(SELECT coalesce(max(cnt), 0) FROM (SELECT count(*) AS cnt FROM {src} t WHERE {v} IS NOT NULL "
            f"GROUP BY {text}) y) AS topk FROM {src} t")
    binning = "(s.agename AND s.nx > 0 AND s.mn >= 0 AND s.mx <= 120)"
    logop = "(s.nx > 0 AND abs(s.sk) >= 1.0 AND s.mn >= 0)"
    logpri = "CASE WHEN abs(s.sk) < 2 THEN 'MEDIUM' ELSE 'HIGH' END"
    dom = "round_even(CAST(s.topk AS DOUBLE) / s.nn * 100.0, 2)"
    cat1 = ("CASE WHEN s.d <= 10 THEN 'Encoding' WHEN s.d <= 50 THEN 'Encoding / rare-category grouping' "
            "ELSE 'Category frequency encoding' END")
    cat1p = "CASE WHEN s.d <= 10 THEN 'HIGH' ELSE 'MEDIUM' END"
    rare = f"(s.nn > 0 AND {dom} >= 80 AND s.d > 1)"
    opp = (f"CASE f.feature_type WHEN 'identifier' THEN 'None' "
           f"WHEN 'constant / near-constant' THEN 'Potentially low-information feature' "
           f"WHEN 'datetime' THEN 'Datetime decomposition' WHEN 'boolean' THEN 'None (already binary)' "
           f"WHEN 'text' THEN 'Text-derived features' "
           f"WHEN 'numerical' THEN CASE WHEN {binning} THEN 'Possible binning' WHEN {logop} THEN "
           f"'Possible log / skewness transformation' ELSE 'None' END "
           f"WHEN 'categorical' THEN {cat1} ELSE 'None' END")
    pri = (f"CASE f.feature_type WHEN 'identifier' THEN 'HIGH' WHEN 'constant / near-constant' THEN 'MEDIUM' "
           f"WHEN 'datetime' THEN 'HIGH' WHEN 'boolean' THEN 'LOW' WHEN 'text' THEN 'MEDIUM' "
           f"WHEN 'numerical' THEN CASE WHEN {binning} THEN 'MEDIUM' WHEN {logop} THEN {logpri} ELSE 'LOW' END "
           f"WHEN 'categorical' THEN {cat1p} ELSE 'LOW' END")
    nops = (f"CASE f.feature_type WHEN 'constant / near-constant' THEN 1 WHEN 'datetime' THEN 1 WHEN 'text' THEN 1 "
            f"WHEN 'numerical' THEN CAST({binning} AS INTEGER) + CAST({logop} AS INTEGER) "
            f"WHEN 'categorical' THEN 1 + CAST({rare} AS INTEGER) ELSE 0 END")
    overall = (f"CASE f.feature_type WHEN 'identifier' THEN 'HIGH' WHEN 'constant / near-constant' THEN 'MEDIUM' "
               f"WHEN 'datetime' THEN 'HIGH' WHEN 'text' THEN 'MEDIUM' "
               f"WHEN 'numerical' THEN CASE WHEN {logop} AND abs(s.sk) >= 2 THEN 'HIGH' "
               f"WHEN {binning} OR {logop} THEN 'MEDIUM' ELSE 'LOW' END "
               f"WHEN 'categorical' THEN {cat1p} ELSE 'LOW' END")
    card = ("CASE WHEN f.feature_type = 'categorical' THEN CASE WHEN s.d <= 10 THEN 'Low cardinality' "
            "WHEN s.d <= 50 THEN 'Medium cardinality' ELSE 'High cardinality' END END")
    leak = f"f.column_name = {G.lit(target)}" if target else "false"
    rows = [f"""SELECT 'column' AS kind, f.column_name AS columns, f.feature_type, {opp} AS opportunity, {pri} AS priority,
  {overall} AS overall_priority, CAST({nops} AS INTEGER) AS n_opportunities, {leak} AS possible_leakage,
  {card} AS cardinality, f.text_kind FROM ({ft}) f JOIN ({G.union_all(per_col)}) s ON s.column_name = f.column_name"""]
    names = [c for c, _ in cols(table)]
    for c in names:
        if N.matches(N.FE_AGE, c) or N.matches(N.FE_SALARY, c):
            rows.append(f"SELECT 'advice', {G.lit(c)}, 'numerical', 'Polynomial terms (advice only)', 'LOW', 'LOW', 0, "
                        f"false, NULL, NULL FROM ({ft}) f WHERE f.column_name = {G.lit(c)} AND f.feature_type = 'numerical'")

    def typed(c: str, types: tuple[str, ...]) -> str:
        lst = ", ".join(G.lit(t) for t in types)
        return f"EXISTS (SELECT 1 FROM ({ft}) g WHERE g.column_name = {G.lit(c)} AND g.feature_type IN ({lst}))"

    def rel(cs: list[str], what: str, prio: str, cond: str) -> str:
        return (f"SELECT 'relationship', {G.lit(','.join(cs))}, 'relationship', {G.lit(what)}, {G.lit(prio)}, "
                f"{G.lit(prio)}, 1, false, NULL, NULL WHERE {cond}")
    hs = [c for c in names if N.matches(N.FE_HEIGHT, c)]
    ws = [c for c in names if N.matches(N.FE_WEIGHT, c)]
    rows += [rel([h, w], "body_ratio", "HIGH",
                 f"{typed(h, ('numerical',))} AND {typed(w, ('numerical',))}") for h in hs for w in ws]
    ss = [c for c in names if N.matches(N.FE_SALARY, c)]
    es = [c for c in names if N.matches(N.FE_EXPERIENCE, c)]
    rows += [rel([s_, e], "pay_per_experience", "MEDIUM",
                 f"{typed(s_, ('numerical',))} AND {typed(e, ('numerical', 'categorical'))}") for s_ in ss for e in es]
    st = [c for c in names if N.matches(N.FE_START_DATE, c)]
    en = [c for c in names if N.matches(N.FE_END_DATE, c)]
    rows += [rel([a, b], "duration", "HIGH",
                 f"{typed(a, ('datetime',))} AND {typed(b, ('datetime',))}") for a in st for b in en if a != b]
    no_end = " AND ".join(f"NOT {typed(b, ('datetime',))}" for b in en) or "true"
    rows += [rel([a], "tenure_to_reference", "MEDIUM", f"{typed(a, ('datetime',))} AND {no_end}")
             for a in st]
    return G.union_all(rows)
