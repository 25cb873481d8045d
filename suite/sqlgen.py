"""DuckDB SQL fragments for the oracle side of the registry.

These only *write SQL text* for the independent DuckDB check; nothing here
runs on Spark. Each helper mirrors one semantic rule of the library (missing,
numeric parse, date parse, strip) in DuckDB's dialect.
"""

from __future__ import annotations

from suite.names import NUMERIC_TEXT, WHITESPACE

# fixed values: the datetime formats of the library that strptime can say (zones are left to unit tests)
STRPTIMES = ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%S", "%Y/%m/%d", "%m/%d/%Y",
             "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%f", "%d %b %Y",
             "%d %B %Y", "%b %d, %Y", "%B %d, %Y", "%m-%d-%Y", "%Y%m%d", "%d/%m/%Y", "%m/%d/%y", "%Y-%m")

# column kinds: "int" (integral), "dbl" (floating), "str", "ts", "bool"


def q(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def missing(name: str, kind: str) -> str:
    c = q(name)
    return f"({c} IS NULL OR isnan({c}))" if kind == "dbl" else f"({c} IS NULL)"


def num(name: str, kind: str) -> str:
    """Numeric view (coerced text for strings), as DOUBLE."""
    c = q(name)
    if kind in ("int", "dbl"):
        v = f"CAST({c} AS DOUBLE)"
        return f"(CASE WHEN NOT isnan({v}) THEN {v} END)"
    if kind == "bool":
        return f"CAST(CAST({c} AS INTEGER) AS DOUBLE)"
    if kind == "str":
        s = strip(c)
        return f"(CASE WHEN regexp_matches({s}, {lit(NUMERIC_TEXT)}) THEN TRY_CAST({s} AS DOUBLE) END)"
    return "CAST(NULL AS DOUBLE)"


def ts(name: str, kind: str) -> str:
    c = q(name)
    if kind == "ts":
        return f"CAST({c} AS TIMESTAMP)"
    if kind == "str":
        fmts = ", ".join(lit(p) for p in STRPTIMES)
        return f"try_strptime({strip(c)}, [{fmts}])"
    return "CAST(NULL AS TIMESTAMP)"


def ts_single(name: str, fmt: str) -> str:
    return f"try_strptime({strip(q(name))}, {lit(fmt)})"


def text(name: str, kind: str) -> str:
    c = q(name)
    if kind == "bool":
        return f"(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END)"
    return f"CAST({c} AS VARCHAR)"


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
