"""DuckDB oracles for the cleaning transforms (whole output tables)."""

from __future__ import annotations

from suite import names as N
from suite import sqlgen as G
from suite.schemas import INT32, cols, source_sql


def _select(table: str, repl: dict[str, str], src: str | None = None) -> str:
    items = [f"{repl[c]} AS {G.q(c)}" if c in repl else G.q(c) for c, _ in cols(table)]
    return f"SELECT {', '.join(items)} FROM {src or source_sql(table)} t"


def empty_strings(table: str) -> str:
    repl = {c: f"CASE WHEN {G.q(c)} IS NOT NULL AND {G.strip(G.q(c))} = '' THEN NULL ELSE {G.q(c)} END"
            for c, k in cols(table) if k == "str"}
    return _select(table, repl)


def convert_numeric(table: str, converted: list[str]) -> str:
    """Columns known to pass the 95 % rule are parsed; the rule itself is checked too."""
    repl = {}
    for c, k in cols(table):
        if c in converted:
            ratio = (f"(SELECT CAST(count({G.num(c, k)}) AS DOUBLE) / count({G.q(c)}) "
                     f"FROM {source_sql(table)} t)")
            repl[c] = f"CASE WHEN {ratio} >= 0.95 THEN {G.num(c, k)} END"
    return _select(table, repl)


def domain_invalid(table: str, converted: list[str] | None = None) -> str:
    """Domain rules; ``converted`` text columns were first parsed by the 95 % rule."""
    converted = converted or []
    src = f"({convert_numeric(table, converted)})" if converted else None
    repl = {}
    for c, k in cols(table):
        if c in converted:
            k = "dbl"
        v = G.num(c, k)
        if N.matches(N.CLEAN_AGE, c):
            bad = f"({v} < 0 OR {v} > 120)"
        elif N.matches(N.CLEAN_SALARY, c):
            bad = f"({v} < 0)"
        elif N.matches(N.CLEAN_QUANTITY, c):
            bad = f"({v} < 0)"
        else:
            continue
        keep = G.q(c) if k in ("int", "dbl") else v
        repl[c] = f"CASE WHEN coalesce({bad}, false) THEN NULL ELSE {keep} END"
    return _select(table, repl, src)


def impute_numeric(table: str) -> str:
    """Mean, or median when |G1| >= 1 with >= 8 values; whole-valued columns rounded."""
    repl, stats = {}, []
    for i, (c, k) in enumerate(cols(table)):
        if k == "ts":  # most frequent value, the smallest of equals
            repl[c] = (f"coalesce(t.{G.q(c)}, (SELECT v FROM (SELECT {G.q(c)} AS v, count(*) AS n FROM {source_sql(table)} t "
                       f"WHERE {G.q(c)} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1))")
        if k not in ("int", "dbl"):
            continue
        v = G.num(c, k)
        stats.append(f"count({v}) AS k{i}, avg({v}) AS a{i}, quantile_cont({v}, 0.5) AS q{i}, "
                     f"skewness({v}) AS s{i}, count(*) FILTER (WHERE abs({v} - round_even({v}, 0)) > 1e-9) AS f{i}, "
                     f"count(*) FILTER (WHERE {G.missing(c, k)}) AS m{i}, count(*) AS n{i}")
        fill = f"(CASE WHEN s.k{i} >= 8 AND abs(s.s{i}) >= 1.0 THEN s.q{i} ELSE s.a{i} END)"
        filled = f"coalesce(CAST(t.{G.q(c)} AS DOUBLE), {fill})"
        # integral columns are restored to whole numbers; the registered inputs'
        # floating columns hold fractions, so they stay double
        itype = "INTEGER" if (table, c) in INT32 else "BIGINT"
        expr = f"CAST(round_even({filled}, 0) AS {itype})" if k == "int" else filled
        repl[c] = (f"CASE WHEN s.m{i} = 0 OR CAST(s.m{i} AS DOUBLE) / s.n{i} > 0.70 OR s.m{i} = s.n{i} "
                   f"THEN t.{G.q(c)} ELSE {expr} END")
    items = [f"{repl[c]} AS {G.q(c)}" if c in repl else f"t.{G.q(c)}" for c, _ in cols(table)]
    return (f"WITH s AS (SELECT {', '.join(stats)} FROM {source_sql(table)} t) "
            f"SELECT {', '.join(items)} FROM {source_sql(table)} t, s")


def _fences(table: str, names: list[str]) -> str:
    parts = []
    for c, k in cols(table):
        if c not in names:
            continue
        v = G.num(c, k)
        parts.append(f"count({v}) AS n_{c}, quantile_cont({v}, 0.25) AS q1_{c}, quantile_cont({v}, 0.75) AS q3_{c}")
    return f"(SELECT {', '.join(parts)} FROM {source_sql(table)} t)"


def _mask(c: str, k: str) -> str:
    v = G.num(c, k)
    lo = f"(f.q1_{c} - 1.5 * (f.q3_{c} - f.q1_{c}))"
    hi = f"(f.q3_{c} + 1.5 * (f.q3_{c} - f.q1_{c}))"
    ok = f"(f.n_{c} >= 8 AND f.q3_{c} - f.q1_{c} <> 0)"
    return f"coalesce({ok} AND ({v} < {lo} OR {v} > {hi}), false)", lo, hi, ok


def outliers_clip(table: str) -> str:
    nums = [c for c, k in cols(table) if k in ("int", "dbl")]
    clip = [c for c, k in cols(table) if k == "dbl"]
    repl = {}
    for c, k in cols(table):
        if c not in clip:
            continue
        m, lo, hi, ok = _mask(c, k)
        hit = f"(SELECT count(*) FILTER (WHERE {m}) FROM {source_sql(table)} t, {_fences(table, nums)} f)"
        v = f"CAST(t.{G.q(c)} AS DOUBLE)"
        repl[c] = (f"CASE WHEN {hit} = 0 THEN t.{G.q(c)} ELSE "
                   f"CASE WHEN {v} < {lo} THEN {lo} WHEN {v} > {hi} THEN {hi} ELSE {v} END END")
    items = [f"{repl[c]} AS {G.q(c)}" if c in repl else f"t.{G.q(c)}" for c, _ in cols(table)]
    return f"SELECT {', '.join(items)} FROM {source_sql(table)} t, {_fences(table, nums)} f"


def outliers_remove(table: str) -> str:
    nums = [c for c, k in cols(table) if k in ("int", "dbl")]
    conds = [_mask(c, k)[0] for c, k in cols(table) if c in nums]
    items = ", ".join(f"t.{G.q(c)}" for c, _ in cols(table))
    return (f"SELECT {items} FROM {source_sql(table)} t, {_fences(table, nums)} f "
            f"WHERE NOT ({' OR '.join(conds)})")


def drop_duplicate_rows(table: str) -> str:
    return f"SELECT DISTINCT * FROM {source_sql(table)} t"


def change_samples(table: str) -> str:
    """First 8 changed ``age`` cells by key (the limit is the feature: a sample report)."""
    src = source_sql(table)
    after = "CASE WHEN coalesce(age < 0 OR age > 120, false) THEN NULL ELSE age END"
    return (f"SELECT customer_id, CAST(age AS VARCHAR) AS before, CAST(({after}) AS VARCHAR) AS after "
            f"FROM {src} t WHERE age IS DISTINCT FROM ({after}) ORDER BY customer_id LIMIT 8")


def without(table: str, dropped: str) -> str:
    """The table without one column."""
    return f"SELECT * EXCLUDE ({G.q(dropped)}) FROM {source_sql(table)} t"


def outlier_flags(table: str, flagged: list[str]) -> str:
    """The table plus <c>__is_outlier for the columns that have outliers."""
    nums = [c for c, k in cols(table) if k in ("int", "dbl")]
    kinds = dict(cols(table))
    flags = ", ".join(f"{_mask(c, kinds[c])[0]} AS {G.q(c + '__is_outlier')}" for c in flagged)
    return f"SELECT t.*, {flags} FROM {source_sql(table)} t, {_fences(table, nums)} f"


def whole(table: str) -> str:
    return f"SELECT * FROM {source_sql(table)} t"


def as_csv(table: str) -> str:
    """The table as its CSV file tells it: whole numbers that fit are INTEGER, blank fields are null."""
    items = [f"CAST({G.q(c)} AS INTEGER) AS {G.q(c)}" if k == "int" else f"nullif({G.q(c)}, '') AS {G.q(c)}" if k == "str" else G.q(c)
             for c, k in cols(table)]
    return f"SELECT {', '.join(items)} FROM {source_sql(table)} t"


def convert_dates(table: str, columns: list[str]) -> str:
    """Text columns of which 90 % parse as dates become timestamps."""
    repl = {}
    for c in columns:
        enough = f"(SELECT count({G.ts(c, 'str')}) >= 0.90 * count({G.q(c)}) FROM {source_sql(table)} t)"
        repl[c] = f"CASE WHEN {enough} THEN {G.ts(c, 'str')} END"
    return _select(table, repl)
