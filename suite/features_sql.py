"""DuckDB oracles for feature engineering."""

from __future__ import annotations

from suite import sqlgen as G
from suite.schemas import cols, source_sql


def _all(table: str) -> str:
    return ", ".join(f"t.{G.q(c)}" for c, _ in cols(table))


def datetime_parts(table: str, column: str, with_time: bool) -> str:
    c = f"CAST(t.{G.q(column)} AS TIMESTAMP)"
    parts = [f"year({c}) AS {G.q(column + '_Year')}", f"month({c}) AS {G.q(column + '_Month')}",
             f"day({c}) AS {G.q(column + '_Day')}", f"(isodow({c}) - 1) AS {G.q(column + '_DayOfWeek')}",
             f"CAST(isodow({c}) - 1 >= 5 AS BIGINT) AS {G.q(column + '_IsWeekend')}"]
    if with_time:
        parts += [f"hour({c}) AS {G.q(column + '_Hour')}", f"minute({c}) AS {G.q(column + '_Minute')}"]
    return f"SELECT {_all(table)}, {', '.join(parts)} FROM {source_sql(table)} t"


def text_counts(table: str, column: str) -> str:
    s = G.strip(f"coalesce(t.{G.q(column)}, '')")
    return (f"SELECT {_all(table)}, CAST(length({s}) AS BIGINT) AS {G.q(column + '_CharCount')}, "
            f"CAST(CASE WHEN {s} = '' THEN 0 ELSE len(regexp_split_to_array({s}, '\\s+')) END AS BIGINT) "
            f"AS {G.q(column + '_WordCount')} FROM {source_sql(table)} t")


def log_feature(table: str, column: str) -> str:
    """log1p when >= 10 distinct, >= 20 values, G1 skew >= 1 (4 dp) and no negatives."""
    v = f"t.{G.q(column)}"
    cond = (f"(SELECT count(DISTINCT {G.q(column)}) >= 10 AND count({G.q(column)}) >= 20 "
            f"AND round_even(skewness({G.q(column)}), 4) >= 1.0 AND min({G.q(column)}) >= 0 "
            f"FROM {source_sql(table)} x)")
    return (f"SELECT {_all(table)}, CASE WHEN {cond} THEN ln(1 + {v}) END AS {G.q(column + '_Log')} "
            f"FROM {source_sql(table)} t")


def unchanged_if_identifier(table: str, column: str) -> str:
    """R19: text whose values are >= 95 % distinct (and > max(5, n/2)) is an identifier,
    so the table comes back unchanged; if the rule did not hold no row is returned."""
    c = G.q(column)
    cond = (f"(SELECT count(DISTINCT {c}) >= 0.95 * count(*) AND count(DISTINCT {c}) > "
            f"greatest(5, CAST(floor(0.5 * count(*)) AS BIGINT)) FROM {source_sql(table)} x)")
    return f"SELECT {_all(table)} FROM {source_sql(table)} t WHERE {cond}"


# ---- pieces of whole feature tables: (name, expression over t) ---------------------------------------------------------
PARTS = {"Year": "year({t})", "Month": "month({t})", "Day": "day({t})", "DayOfWeek": "isodow({t}) - 1",
         "IsWeekend": "CAST(isodow({t}) - 1 >= 5 AS BIGINT)", "Hour": "hour({t})", "Minute": "minute({t})"}


def _ts(table: str, column: str) -> str:
    return G.ts(column, dict(cols(table))[column])


def parts(table: str, column: str, names: str = "Year Month Day DayOfWeek IsWeekend") -> list[tuple[str, str]]:
    return [(f"{column}_{n}", f"CAST({PARTS[n].format(t=_ts(table, column))} AS BIGINT)") for n in names.split()]


def _days(table: str, a: str, b: str) -> str:
    return f"((epoch_us({_ts(table, b)}) - epoch_us({_ts(table, a)})) / 86400e6)"


def duration(table: str, a: str, b: str) -> list[tuple[str, str]]:
    return [(f"{a}_{b}_Duration_Days", f"round_even({_days(table, a, b)}, 2)")]


def age(table: str, a: str, b: str) -> list[tuple[str, str]]:
    return [(f"{a}_{b}_Age_Years", f"CAST(floor({_days(table, a, b)} / 365.25) AS BIGINT)")]


def ratio(a: str, b: str) -> list[tuple[str, str]]:
    return [(f"{a}_Per_{b}", f"CAST({G.q(a)} AS DOUBLE) / nullif(CAST({G.q(b)} AS DOUBLE), 0)")]


def log(column: str) -> list[tuple[str, str]]:
    return [(f"{column}_Log", f"ln(1 + CAST({G.q(column)} AS DOUBLE))")]


def binned(source: str, column: str, value: str | None = None) -> list[tuple[str, str]]:
    """Quintile bins; equal edges merge, the first bin is closed on both sides."""
    v = f"CAST({value or G.q(column)} AS DOUBLE)"
    edges = (f"(SELECT list_sort(list_distinct(quantile_cont({v}, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) FROM {source} e)")
    k = f"greatest(1, len(list_filter({edges}, lambda x: x < {v})))"
    text = lambda at: f"CAST(round_even(list_extract({edges}, {at}), 4) AS VARCHAR)"
    return [(f"{column}_Binned", f"CASE WHEN {v} IS NOT NULL THEN CASE WHEN {k} = 1 THEN '[' ELSE '(' END || {text(k)} || ', ' || "
                                 f"{text(f'{k} + 1')} || ']' END")]


def with_features(table: str, *features: list[tuple[str, str]]) -> str:
    made = ", ".join(f"{e} AS {G.q(n)}" for fs in features for n, e in fs)
    return f"SELECT {_all(table)}, {made} FROM {source_sql(table)} t"


def people_dates(table: str = "people") -> list[list[tuple[str, str]]]:
    return [parts(table, "date_of_birth"), parts(table, "reference_date"), parts(table, "start_date", "Year Day DayOfWeek IsWeekend"),
            parts(table, "end_date"), duration(table, "start_date", "end_date"), age(table, "date_of_birth", "reference_date")]


def people_numbers(table: str = "people") -> list[list[tuple[str, str]]]:
    src = source_sql(table)
    return [binned(src, "age"), binned(src, "years_experience"), log("salary"), binned(src, "salary"),
            ratio("revenue", "years_experience"), ratio("revenue", "quantity"), ratio("salary", "years_experience"),
            ratio("salary", "quantity")]


def people_issues(table: str = "people") -> str:
    """What feature engineering counts on the way."""
    born, days = _ts(table, "date_of_birth"), lambda a, b: _days(table, a, b)
    rows = [("invalid_datetime", "date_of_birth", f"date_of_birth IS NOT NULL AND {born} IS NULL"),
            ("negative_duration", "start_date,end_date", f"{days('start_date', 'end_date')} < 0"),
            ("birth_after_reference", "date_of_birth,reference_date", f"{days('date_of_birth', 'reference_date')} < 0"),
            ("division_by_zero", "revenue,quantity", "quantity = 0"), ("division_by_zero", "salary,quantity", "quantity = 0")]
    return G.union_all([f"SELECT {G.lit(i)} AS issue, {G.lit(c)} AS columns, CAST(count(*) AS VARCHAR) AS cells "
                        f"FROM {source_sql(table)} t WHERE {w} HAVING count(*) > 0" for i, c, w in rows])


def log_statistics(table: str, column: str) -> str:
    v = f"CAST({G.q(column)} AS DOUBLE)"
    r = lambda x: f"round_even({x}, 4)"
    return (f"SELECT {G.lit(column + '_Log')} AS feature, {r(f'skewness({v})')} AS before_skewness, {r(f'min({v})')} AS before_min, "
            f"{r(f'max({v})')} AS before_max, {r(f'skewness(ln(1 + {v}))')} AS after_skewness, {r(f'min(ln(1 + {v}))')} AS after_min, "
            f"{r(f'max(ln(1 + {v}))')} AS after_max FROM {source_sql(table)} t")


def candidates(table: str, dates: dict[str, str], logs: list[str]) -> str:
    """Features that would be made: date parts that vary, and logs of skewed columns without negatives."""
    src, rows = source_sql(table), []
    for c, names in dates.items():
        rows += [f"SELECT {G.lit(n)} AS feature, {G.lit(c)} AS source, {G.lit('Datetime -> ' + n.rsplit('_', 1)[1])} AS transformation, "
                 f"'MEDIUM' AS priority FROM {src} t HAVING min({e}) <> max({e})" for n, e in parts(table, c, names)]
    rows += [f"SELECT {G.lit(c + '_Log')}, {G.lit(c)}, 'log1p', 'HIGH' FROM {src} t HAVING count(DISTINCT {G.q(c)}) >= 10 "
             f"AND count({G.q(c)}) >= 20 AND round_even(skewness({G.q(c)}), 4) >= 1.0 AND min({G.q(c)}) >= 0" for c in logs]
    return G.union_all(rows)


def validated(table: str = "generated") -> str:
    """Copies, constants and columns with more than half missing go; infinities become null; whole parts are longs."""
    kept = ", ".join(f"t.{G.q(c)}" for c, _ in cols("dirty_customer"))
    return (f"SELECT {kept}, CASE WHEN NOT isinf(bad_Ratio) THEN bad_Ratio END AS {G.q('bad_Ratio')}, "
            f"CAST(odd_Month AS BIGINT) AS {G.q('odd_Month')}, CAST(due_DayOfWeek AS BIGINT) AS {G.q('due_DayOfWeek')} "
            f"FROM {source_sql(table)} t")


def validation_report(table: str = "generated") -> str:
    src = source_sql(table)
    return f"""
SELECT 'removed' AS kind, 'copy_Gen' AS feature, 'duplicate_of:churn' AS detail FROM {src} t HAVING bool_and(copy_Gen IS NOT DISTINCT FROM churn)
UNION ALL SELECT 'removed', 'const_Gen', 'constant' FROM {src} t HAVING min(const_Gen) = max(const_Gen)
UNION ALL SELECT 'removed', 'sparse_Gen', 'too_many_missing' FROM {src} t HAVING count(sparse_Gen) < 0.5 * count(*)
UNION ALL SELECT 'issue', 'infinite_values', CAST(count(*) AS VARCHAR) FROM {src} t WHERE isinf(bad_Ratio) HAVING count(*) > 0
UNION ALL SELECT 'issue', 'out_of_range', CAST(count(*) AS VARCHAR) FROM {src} t WHERE odd_Month NOT BETWEEN 1 AND 12 HAVING count(*) > 0"""
