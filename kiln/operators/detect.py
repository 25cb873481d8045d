"""Feature-type detection (DET-1 .. DET-4, R8, R13, R19).

One aggregate job gathers every per-column number the rules need; the
near-constant test adds a frequent-items summary of the columns that *can* be
near-constant (distinct <= 2 % of values + 1), and the sequential-ID test one job
that walks the distinct values of all integer columns that are >= 95 % unique. Rules then run on the driver over
O(columns) numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions import names as N
from kiln.functions.exprs import (
    is_double_type,
    is_integral_type,
    round_value,
    BOOLEAN_LITERALS,
    NUMERIC_TEXT,
    cells,
    col,
    is_numeric_type,
    is_string_type,
    is_timestamp_type,
    strip_cell,
)
from kiln.functions.rules import Rule, decide
from kiln.operators.dominant import dominant_counts
from kiln.operators.quality import TextRatios, _orderable, text_ratios
from kiln.operators.stats import distinct_counts, missing, numeric_view

# ---- fixed values: thresholds ----------------------------------------------
LOW_CARDINALITY_MAX = 10
MEDIUM_CARDINALITY_MAX = 50
HIGH_UNIQUENESS_RATIO = 0.95
NEAR_CONSTANT_SHARE = 0.98
DATETIME_PARSE_RATIO = 0.8
SHORT_TEXT_MEAN_LEN = 40
LONG_TEXT_MEAN_LEN = 80
NUMERIC_TEXT_RATIO = 0.9
MAX_LITERAL_LEN = max(len(x) for x in BOOLEAN_LITERALS)
# ---- end of fixed values ----------------------------------------------------


@dataclass
class ColumnFacts:
    name: str
    dtype: T.DataType
    n_rows: int
    non_null: int
    distinct: int
    top_share: float | None
    bool_like: bool
    dt_ratio: float
    num_ratio: float
    mean_len: float | None
    integer_like: bool
    email_ratio: float
    sequential: bool = False

    @property
    def uniqueness(self) -> float:
        return self.distinct / self.n_rows if self.n_rows else 0.0

    # what the rule tables ask for
    @property
    def string(self) -> bool:
        return is_string_type(self.dtype)

    @property
    def numeric(self) -> bool:
        return is_numeric_type(self.dtype)

    @property
    def timestamp(self) -> bool:
        return is_timestamp_type(self.dtype)

    @property
    def id_named(self) -> bool:
        return N.is_identifier_name(self.name)

    @property
    def person_named(self) -> bool:
        return bool(N.matches(N.FE_PERSON_NAME, self.name))

    @property
    def text_named(self) -> bool:
        return bool(N.matches(N.FE_TEXT, self.name))

    @property
    def mostly_distinct(self) -> bool:
        return self.distinct > max(5, int(0.5 * self.n_rows))

    @property
    def text_like(self) -> bool:
        return decide(TEXT_LIKE_RULES, self) is True

    @property
    def identifier(self) -> bool:
        return is_identifier(self)

    @property
    def text(self) -> bool:
        return text_kind(self) is not None


def column_facts(df: DataFrame, names: list[str] | None = None, ratios: dict[str, TextRatios] | None = None
                 ) -> dict[str, ColumnFacts]:
    """``ratios`` may hold what some text columns parse as."""
    names = [c for c in (names or df.columns) if _orderable(df.schema[c].dataType)]
    texts = [i for i, c in enumerate(names) if is_string_type(df.schema[c].dataType)]
    numbers = [i for i, c in enumerate(names) if is_numeric_type(df.schema[c].dataType)]
    others = [i for i in range(len(names)) if i not in texts and i not in numbers]
    value = lambda i: F.when(~missing(df, names[i]), col(names[i]))
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(value(i)).alias(f"nn{i}") for i in others]).first().asDict()
    row |= {f"dt{i}": 1.0 for i in others if is_timestamp_type(df.schema[names[i]].dataType)}
    row |= {f"{k}{i}": v for i in texts for k, v in (("nn", 0), ("b", False), ("p", 0), ("l", None), ("e", 0))}
    row |= {f"{k}{i}": v for i in numbers for k, v in (("nn", 0), ("b", False), ("f", 0))}
    v, s = F.col("v"), F.col("s")
    if texts:
        # literals are <= 5 characters: longer text is never lower-cased
        short_lit = (F.length(s) <= MAX_LITERAL_LEN) & F.lower(s).isin(*BOOLEAN_LITERALS)
        for r in cells(df, [value(i) for i in texts]).select("i", "v", strip_cell(v).alias("s")).groupBy("i").agg(
                F.count(v).alias("nn"), F.coalesce(F.bool_and(F.when(v.isNotNull(), short_lit)), F.lit(False)).alias("b"),
                F.count_if(s.rlike(NUMERIC_TEXT) & s.try_cast("double").isNotNull()).alias("p"), F.avg(F.length(v)).alias("l"),
                F.count_if(s.contains("@") & s.rlike(N.EMAIL_VALUE)).alias("e")).collect():  # one row per column
            row |= {f"{k}{texts[r['i']]}": r[k] for k in ("nn", "b", "p", "l", "e")}
    if numbers:
        x = F.rint(v)
        for r in cells(df, [value(i).cast("double") for i in numbers]).groupBy("i").agg(
                F.count(v).alias("nn"), F.coalesce(F.bool_and(F.when(v.isNotNull(), v.isin(0.0, 1.0))), F.lit(False)).alias("b"),
                F.count_if(F.abs(v - x) > F.lit(1e-8) + F.lit(1e-5) * F.abs(x)).alias("f")).collect():  # one row per column
            i = numbers[r["i"]]
            dt = df.schema[names[i]].dataType
            # integral 0/1 render as "0"/"1"; fractional numbers render as "0.0"/"1.0", which are not literals
            whole = is_integral_type(dt) or dt.typeName() == "boolean"
            row |= {f"nn{i}": r["nn"], f"b{i}": r["b"] and whole, f"f{i}": r["f"]}
    dist = distinct_counts(df, names)
    ratios = (ratios or {}) | text_ratios(df, [names[i] for i in texts if names[i] not in (ratios or {})])
    row |= {f"dt{i}": ratios[names[i]].datetime_like for i in texts}
    n = int(row["n"])
    facts: dict[str, ColumnFacts] = {}
    for i, c in enumerate(names):
        dt = df.schema[c].dataType
        nn = int(row[f"nn{i}"])
        d = dist[c]
        bool_like = isinstance(dt, T.BooleanType) or (nn > 0 and d <= 4 and bool(row.get(f"b{i}")))
        facts[c] = ColumnFacts(
            name=c, dtype=dt, n_rows=n, non_null=nn, distinct=d, top_share=None, bool_like=bool_like,
            dt_ratio=float(row[f"dt{i}"]) if f"dt{i}" in row else 0.0,
            num_ratio=(row[f"p{i}"] / nn if nn else 0.0) if f"p{i}" in row else (1.0 if is_numeric_type(dt) else 0.0),
            mean_len=row[f"l{i}"] if f"l{i}" in row else None,
            integer_like=(nn > 0 and row[f"f{i}"] == 0) if f"f{i}" in row else False,
            email_ratio=(row[f"e{i}"] / nn if nn else 0.0) if f"e{i}" in row else 0.0)
    _top_shares(df, facts)
    _sequential(df, facts)
    return facts


def _top_shares(df: DataFrame, facts: dict[str, ColumnFacts]) -> None:
    """Dominant-value share for columns that can reach the near-constant bar."""
    cands = [f for f in facts.values()
             if f.non_null > 0 and f.distinct <= f.non_null * (1 - NEAR_CONSTANT_SHARE) + 1]
    for f in facts.values():
        if f not in cands:
            f.top_share = None if f.non_null == 0 else (1.0 if f.distinct == 1 else 0.0)
    if not cands:
        return
    for f in cands:
        f.top_share = 0.0  # below any share that a rule asks for
    for name, (k, _) in dominant_counts(
            df, [f.name for f in cands], 0.5, rest=False, n_rows=cands[0].n_rows,
            distinct={f.name: f.distinct for f in cands}).items():
        facts[name].top_share = k / facts[name].non_null


def _sequential(df: DataFrame, facts: dict[str, ColumnFacts]) -> None:
    """R8: median of sorted differences in {0, 1}, for all candidate columns in one job.

    Values are grouped into stretches of ``STRETCH`` whole numbers; a stretch is a set
    of offsets, in which neighbours that differ by one are counted. Where a stretch
    ends and the next one begins, their edge values meet under the number of the next.
    Repeats are differences of zero.
    """
    cands = [f for f in facts.values() if decide(SEQUENCE_CANDIDATE, f) and f.distinct >= max(10, int(0.9 * f.n_rows))]
    if not cands:
        return
    # whole numbers keep their value (doubles merge them beyond 2^53, where none differ by one)
    kind = "decimal(38,0)" if any(isinstance(f.dtype, T.DecimalType) for f in cands) else "long"
    numbers = F.array(*[F.struct(F.lit(i).alias("i"), (numeric_view(df, f.name) if is_double_type(f.dtype) else col(f.name))
                               .try_cast(kind).alias("v")) for i, f in enumerate(cands)])
    rows = df.select(F.inline(numbers)).where("v IS NOT NULL")
    stretch = F.floor(F.col("v") / STRETCH) if kind != "long" else F.shiftright("v", STRETCH.bit_length() - 1)
    sets = rows.withColumn("s", stretch).groupBy("i", "s").agg(
        F.array_sort(F.collect_set((F.col("v") - F.col("s") * STRETCH).cast("int"))).alias("at"))  # at most STRETCH numbers
    follow = _steps_of_one(F.col("at"))
    marks = F.array(F.struct(F.col("s").alias("edge"), F.array_contains("at", 0).alias("begins"), F.lit(False).alias("ends"), follow.alias("ones")),
                    F.struct((F.col("s") + 1).alias("edge"), F.lit(False).alias("begins"), F.array_contains("at", STRETCH - 1).alias("ends"),
                             F.lit(0).alias("ones")))
    edges = sets.select("i", F.inline(marks)).groupBy("i", "edge").agg(
        F.sum("ones").alias("ones"), (F.bool_or("begins") & F.bool_or("ends")).cast("int").alias("joined"))
    found = {r["i"]: r["ones"] for r in edges.groupBy("i").agg(F.sum(F.col("ones") + F.col("joined")).alias("ones")).collect()}
    for i, f in enumerate(cands):
        ones = found.get(i, 0)
        zeros, steps = f.non_null - f.distinct, f.non_null - 1
        middle = {(steps - 1) // 2, steps // 2}
        f.sequential = len({(m >= zeros) + (m >= zeros + ones) for m in middle}) == 1 and max(middle) < zeros + ones


def _steps_of_one(at: Column) -> Column:
    """How many neighbours of a sorted array of numbers differ by one."""
    pairs = F.zip_with(F.slice(at, 2, STRETCH), F.slice(at, 1, F.size(at) - 1), lambda y, x: F.when(y - x == 1, 1))
    return F.when(F.size(at) > 1, F.size(F.array_compact(pairs))).otherwise(0)


#: Whole numbers of a stretch, a power of two.
STRETCH = 1024
#: Columns whose values may be a sequence of whole numbers.
SEQUENCE_CANDIDATE = (Rule(True, {"numeric": True, "integer_like": True}, {"non_null": 3, "uniqueness": HIGH_UNIQUENESS_RATIO}),)

#: DET-1: what makes a column an identifier; False ends the search.
IDENTIFIER_RULES = (
    Rule(False, {"person_named": True, "id_named": False}),
    Rule("name", {"id_named": True}, {"uniqueness": 0.5}),
    Rule("distinct values", {"numeric": False, "mostly_distinct": True}, {"uniqueness": HIGH_UNIQUENESS_RATIO}),
    Rule("sequence", {"sequential": True}, {"uniqueness": HIGH_UNIQUENESS_RATIO}),
    Rule("e-mails", {"string": True}, {"email_ratio": 0.8, "uniqueness": 0.9}),
)

TEXT_LIKE_RULES = (
    Rule(True, {"text_named": True}),
    Rule(True, least={"mean_len": LONG_TEXT_MEAN_LEN}),
    Rule(True, least={"mean_len": SHORT_TEXT_MEAN_LEN, "uniqueness": 0.7}),
)
#: DET-3 (R13): what free text a column holds; False: none.
TEXT_RULES = (
    Rule(False, {"string": False}),
    Rule(False, below={"non_null": 1}),
    Rule(False, {"text_named": False},
         below={"distinct": MEDIUM_CARDINALITY_MAX + 1, "uniqueness": 0.5, "mean_len": SHORT_TEXT_MEAN_LEN}),
    Rule("names", {"person_named": True}, below={"mean_len": LONG_TEXT_MEAN_LEN}),
    Rule(False, {"text_like": False}),
    Rule("long/free-form text", least={"mean_len": LONG_TEXT_MEAN_LEN}),
    Rule("short text"),
)
# fixed values: what a part of a text column's name says about its kind
TEXT_NAMES = {"review": "reviews", "address": "addresses", "comment": "comments", "note": "comments", "desc": "descriptions"}

#: DET-4: the type of a column.
TYPE_RULES = (
    Rule("constant / near-constant", least={"non_null": 1}, below={"distinct": 2}),
    Rule("constant / near-constant", {"bool_like": False}, {"top_share": NEAR_CONSTANT_SHARE, "distinct": 2}),
    Rule("identifier", {"identifier": True}),
    Rule("boolean", {"bool_like": True}),
    Rule("datetime", {"timestamp": True}),
    Rule("datetime", {"numeric": False}, {"dt_ratio": DATETIME_PARSE_RATIO}),
    Rule("text", {"text": True}),
    Rule("numerical", {"numeric": True}),
    Rule("numerical", {"string": True}, {"non_null": 1, "num_ratio": NUMERIC_TEXT_RATIO}),
    Rule("categorical", {"string": True}),
    Rule("unknown / other"),
)


def is_identifier(f: ColumnFacts) -> bool:
    return bool(decide(IDENTIFIER_RULES, f))


def text_kind(f: ColumnFacts) -> str | None:
    """The kind of free text, or None."""
    kind = decide(TEXT_RULES, f) or None
    if kind in (None, "names"):
        return kind
    return next((named for part, named in TEXT_NAMES.items() if part in f.name.lower()), kind)


def feature_type(f: ColumnFacts) -> str:
    return decide(TYPE_RULES, f)


def feature_types(df: DataFrame) -> DataFrame:
    """Report: column, feature type, distinct, uniqueness, identifier flag, text kind."""
    facts = column_facts(df)
    rows = [(c, feature_type(f), f.distinct, round_value(f.uniqueness, 4), is_identifier(f), text_kind(f))
            for c, f in facts.items()]
    schema = ("column_name string, feature_type string, unique_count long, uniqueness double, "
              "is_identifier boolean, text_kind string")
    return df.sparkSession.createDataFrame(rows, schema)
