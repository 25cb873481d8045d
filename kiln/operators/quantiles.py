"""Exact quantiles through sketch brackets (linear interpolation, as ``percentile``).

One way for columns of any size:

1. one scan feeds a mergeable KLL sketch per column; sketches are merged in a tree of
   tasks. The sketch's values a little below and above each wanted rank bracket it;
2. one more scan counts, per column, what lies between the brackets (one number per
   partition) and the values inside them: only (column, value, count) of those are
   shuffled, so most values never leave their task and a hot value is one row;
3. brackets are cut into ``BUCKETS`` stretches of values. The totals of segments and
   stretches say which stretch holds a wanted rank, and running counts inside it pick
   the value: a task sees the values of one stretch;
4. a rank that lies outside its bracket (a sketch keeps its error bound in all but a
   few cases in a hundred thousand) is looked for again in the segment that holds it,
   so the result is exact whatever the sketch said.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.exprs import cells as as_cells

#: Sketch size, and the share of ranks on either side of a wanted one that its bracket
#: takes in (several times the sketch's error at that size).
SKETCH_K = 2048
MARGIN = 0.005
#: Groups of partitions whose sketches are merged before the last task merges the groups.
FAN_IN = 64
BUCKETS = 512

Bracket = tuple[float, float]


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: tuple[float, ...]
                    ) -> dict[str, dict[float, float | None]]:
    """Per name the value of each probability (None without values)."""
    return value_quantiles(df, values, probs)[0]


def value_quantiles(df: DataFrame, values: dict[str, Column], probs: tuple[float, ...], sketch_k: int = SKETCH_K,
                    margin: float = MARGIN) -> tuple[dict[str, dict[float, float | None]], dict[str, int]]:
    """(quantiles, number of non-null values) per name."""
    found, size, _ = _quantiles(df, values, probs, sketch_k, margin, None)
    return found, size


def quantiles_and_distinct(df: DataFrame, values: dict[str, Column], probs: tuple[float, ...], keys: dict[str, Column]
                           ) -> tuple[dict[str, dict[float, float | None]], dict[str, int], dict[str, int]]:
    """(quantiles, non-null values, distinct values) per name from one count of (column, value).

    Distinct counts need every value once, so here values outside the brackets are
    shuffled too. ``keys`` (long) tell values apart that are equal as doubles.
    """
    return _quantiles(df, values, probs, SKETCH_K, MARGIN, keys)


def _quantiles(df: DataFrame, values: dict[str, Column], probs: tuple[float, ...], sketch_k: int, margin: float,
               keys: dict[str, Column] | None) -> tuple[dict, dict, dict]:
    names = list(values)
    if not names:
        return {}, {}, {}
    cells = df.select(*[values[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)],
                      *[keys[n].cast("long").alias(f"a{i}") for i, n in enumerate(names) if keys is not None and n in keys])
    size, brackets = _brackets(cells, len(names), probs, sketch_k, margin)
    places = {(i, p): p * (size[i] - 1) for i in range(len(names)) if size[i] for p in probs}
    want = sorted({(i, r) for (i, _), h in places.items() for r in (math.floor(h), math.ceil(h))})
    found: dict[tuple[int, int], float] = {}
    distinct: dict[int, int] = {}
    every = keys is not None
    while want:
        got, brackets, counted = _pick(cells, {i: brackets[i] for i in sorted({i for i, _ in want})}, want, every)
        found |= got
        distinct = counted if every else distinct
        every, want = False, [w for w in want if w not in got]
    out: dict[str, dict[float, float | None]] = {n: dict.fromkeys(probs) for n in names}
    for (i, p), h in places.items():
        lo, hi = math.floor(h), math.ceil(h)
        a, b = found[i, lo], found[i, hi]
        out[names[i]][p] = a if a == b else (hi - h) * a + (h - lo) * b
    return out, {n: size[i] for i, n in enumerate(names)}, {n: distinct.get(i, 0) for i, n in enumerate(names)}


def _brackets(cells: DataFrame, n: int, probs: tuple[float, ...], sketch_k: int, margin: float
              ) -> tuple[list[int], dict[int, list[Bracket]]]:
    """Values per column, and disjoint brackets around the wanted ranks, in order."""
    group = F.pmod(F.spark_partition_id(), F.lit(FAN_IN)).alias("g")
    merged = cells.select(group, *[f"v{i}" for i in range(n)]).groupBy("g").agg(
        *[F.count(f"v{i}").alias(f"n{i}") for i in range(n)],
        *[F.kll_sketch_agg_double(f"v{i}", F.lit(sketch_k)).alias(f"s{i}") for i in range(n)]).agg(
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(n)],
        *[F.kll_merge_agg_double(f"s{i}", F.lit(sketch_k)).alias(f"s{i}") for i in range(n)])
    ranks = [r for p in probs for r in (max(0.0, p - margin), min(1.0, p + margin))]
    row = merged.select(*[f"n{i}" for i in range(n)], *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(
        f"s{i}", F.array(*map(F.lit, ranks)))).alias(f"q{i}") for i in range(n)]).first()
    brackets = {}
    for i in range(n):
        own: list[Bracket] = []
        for lo, hi in sorted(zip(row[f"q{i}"][::2], row[f"q{i}"][1::2])) if row[f"n{i}"] else ():
            if own and lo <= own[-1][1]:
                own[-1] = (own[-1][0], max(hi, own[-1][1]))
            else:
                own.append((lo, hi))
        brackets[i] = own
    return [int(row[f"n{i}"]) for i in range(n)], brackets


@dataclass
class _Segments:
    """The parts that a column's brackets cut the number line into; odd ones are inside."""
    brackets: list[Bracket]

    def outside(self, segment: int) -> Bracket:
        """A bracket that holds every value of an even segment."""
        k = segment // 2
        return (self.brackets[k - 1][1] if k else -math.inf, self.brackets[k][0] if k < len(self.brackets) else math.inf)


def _per_column(parts: dict[int, _Segments], number) -> list[Column]:
    """For the k-th bracket of every column the number of each column, which its index ``i`` picks (null: no such bracket)."""
    most = max(len(p.brackets) for p in parts.values())
    own = lambda i, k: float(number(*parts[i].brackets[k])) if i in parts and k < len(parts[i].brackets) else None
    return [F.get(F.array(*[F.lit(own(i, k)).cast("double") for i in range(max(parts) + 1)]), F.col("i")) for k in range(most)]


def _segment(parts: dict[int, _Segments]) -> Column:
    """The segment of the value ``v`` of column ``i``: how many edges of brackets it has passed."""
    v, out = F.col("v"), F.lit(0)
    for lo, hi in zip(_per_column(parts, lambda lo, _: lo), _per_column(parts, lambda _, hi: hi)):
        out = out + F.when(v >= lo, 1).otherwise(0) + F.when(v > hi, 1).otherwise(0)
    return out


def _bucket(parts: dict[int, _Segments]) -> Column:
    """The stretch of its bracket that a value inside lies in."""
    wide = lambda lo, hi: math.isfinite(lo) and math.isfinite(hi) and 0 < hi - lo < math.inf
    at = F.shiftright("seg", 1)
    start = F.get(F.array(*_per_column(parts, lambda lo, hi: lo if wide(lo, hi) else 0.0)), at)
    scale = F.get(F.array(*_per_column(parts, lambda lo, hi: BUCKETS / (hi - lo) if wide(lo, hi) else 0.0)), at)
    return F.floor(F.least((F.col("v") - start) * scale, F.lit(float(BUCKETS)))).cast("int")


def _pick(cells: DataFrame, brackets: dict[int, list[Bracket]], want: list[tuple[int, int]], every: bool
          ) -> tuple[dict[tuple[int, int], float], dict[int, list[Bracket]], dict[int, int]]:
    """Values of the wanted (column, rank)s that lie inside their column's brackets, brackets for the others,
    and with ``every`` the distinct values of each column."""
    spark = cells.sparkSession
    parts = {i: _Segments(b) for i, b in brackets.items()}
    keyed = {i for i in parts if f"a{i}" in cells.columns and every}
    # a row per cell first: one short piece of code then places the values of all columns
    if keyed:
        rows = cells.select(F.inline(F.array(*[F.struct(
            F.lit(i).alias("i"), F.col(f"v{i}").alias("v"), (F.col(f"a{i}") if i in keyed else F.lit(None).cast("long")).alias("a"))
            for i in parts])))
    else:
        rows = as_cells(cells, [F.col(f"v{i}") if i in parts else F.lit(None).cast("double") for i in range(max(parts) + 1)])
        rows = rows.select("i", "v", F.lit(None).cast("long").alias("a"))
    rows = rows.where("v IS NOT NULL")
    inside = F.col("seg") % 2 == 1
    counts = rows.withColumn("seg", _segment(parts)).select(
        "i", "seg", F.when(inside, _bucket(parts)).otherwise(0).alias("bucket"), (F.col("v") if every else F.when(inside, F.col("v"))).alias("v"),
        "a").groupBy("i", "seg", "bucket", "v", "a").agg(F.count(F.lit(1)).alias("k"))
    wanted = F.broadcast(spark.createDataFrame(want, "w int, rank long"))  # two rows per quantile
    place = ["i", "seg", "bucket"]
    totals = counts.groupBy(*place).agg(F.sum("k").alias("n"), F.count(F.lit(1)).alias("d"))  # BUCKETS rows per bracket, one per gap
    before = F.coalesce(F.sum("n").over(Window.partitionBy("i").orderBy("seg", "bucket").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    hit = totals.withColumn("before", before).join(wanted, (F.col("i") == F.col("w")) & (F.col("before") <= F.col("rank"))
                                                   & (F.col("rank") < F.col("before") + F.col("n")))
    hit = hit.select(*[F.col(c).alias(f"h_{c}") for c in place], "rank", "before")
    # of a gap one row says that the rank lies there. Place is never null; the null-safe test spares Spark a filter below the
    # counts, so that both branches read one shuffle of them
    near = counts.join(F.broadcast(hit), [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in place])  # one row per wanted rank
    near = near.withColumn("v", F.when(F.col("seg") % 2 == 1, F.col("v"))).groupBy(*place, "rank", "before", "v").agg(F.sum("k").alias("k"))
    upto = F.col("before") + F.sum("k").over(Window.partitionBy(*place, "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    rows = near.withColumn("upto", upto).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("k")))
    rows = rows.select("i", "rank", "seg", "v", F.lit(None).cast("long").alias("d"))
    if every:
        none = F.lit(None)
        rows = rows.unionByName(totals.groupBy("i").agg(F.sum("d").alias("d")).select(
            "i", none.cast("long").alias("rank"), none.cast("int").alias("seg"), none.cast("double").alias("v"), "d"))
    found, again, distinct = {}, {}, {}
    for r in rows.collect():
        if r["rank"] is None:
            distinct[r["i"]] = r["d"]
        elif r["seg"] % 2:
            found[r["i"], r["rank"]] = r["v"]
        else:
            again.setdefault(r["i"], set()).add(parts[r["i"]].outside(r["seg"]))
    return found, {i: sorted(b) for i, b in again.items()}, distinct
