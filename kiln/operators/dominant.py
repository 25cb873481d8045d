"""Dominant values (most frequent, the smallest of equals) without shuffling texts.

1. One scan feeds a mergeable frequent-items summary per column (hashes, at most
   ``1 / SHARE`` of them): every value on more than that share of the rows is in it.
2. One scan counts the survivors exactly: a few rows per task and column. A column
   whose best survivor lies above the share is settled, with all that tie with it; so
   are columns known to hold few values, which need no summary.
3. Of the other columns, 128 hash bits per value are counted, with the first
   ``PREFIX`` characters of its text.
4. Ties are told apart by their text: winners with the smallest prefix go on, by
   further ``PREFIX`` characters while they are many; the few that are left are looked
   up in one scan that takes a minimum. A whole text never leaves its task but as that
   minimum.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.exprs import as_text, cells, col
from kiln.session import scratch, staged

SHARE = 1 / 256
PREFIX = 64
#: Values that may go into a filter's list.
FEW = 1_000


def dominant_values(df: DataFrame, names: list[str], share: float = SHARE, few: int = FEW,
                    distinct: dict[str, int] | None = None) -> dict[str, tuple[str, int]]:
    """(value as text, count) of the most frequent non-missing value per column that has one."""
    texts = _texts(df, names)
    direct: dict[int, list[tuple[int, int]]] = {}
    out: dict[str, tuple[str, int]] = {}
    with scratch(df.sparkSession):
        counts = dominant_counts(df, names, share, distinct=distinct)
        for c, (n, winners) in counts.items():
            if isinstance(winners, DataFrame):
                out[c] = (_smallest(texts, names.index(c), winners, few), n)
            else:
                direct[names.index(c)] = winners
    found = _minimum(texts, direct)
    return out | {names[i]: (v, counts[names[i]][0]) for i, v in found.items()}


def _texts(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns t0, t1, ... with the text of each named column (missing values null)."""
    return df.select(*[as_text(col(c), df.schema[c].dataType).alias(f"t{i}") for i, c in enumerate(names)])


def _hashes(i: int) -> tuple[Column, Column]:
    t = F.col(f"t{i}")
    return F.when(t.isNotNull(), F.xxhash64(t)), F.when(t.isNotNull(), F.xxhash64(F.lit("2"), t))


def dominant_counts(df: DataFrame, names: list[str], share: float = SHARE, rest: bool = True,
                    n_rows: int | None = None, distinct: dict[str, int] | None = None
                    ) -> dict[str, tuple[int, list[tuple[int, int]] | DataFrame]]:
    """Per column that has a value: the largest count, and the hashes of the values that reach it.

    The hashes are a list for columns that the summary settles, else a table (h1, h2, prefix).
    Without ``rest`` columns with no value above the share are left out. ``n_rows`` and
    numbers of ``distinct`` values may be known: columns with few need no summary.
    """
    if not names:
        return {}
    texts = _texts(df, names)
    small = {i for i, c in enumerate(names) if (distinct or {}).get(c, FEW + 1) <= FEW}
    many = [i for i in range(len(names)) if i not in small]
    kept: dict[int, list[int]] = {}
    if many:
        row = texts.select(*[_hashes(i)[0].alias(f"h{i}") for i in many]).freqItems([f"h{i}" for i in many], share).first()
        kept = {i: [h for h in row[k] if h is not None] for k, i in enumerate(many)}
    wanted = F.col("i").isin(sorted(small)) if small else F.lit(False)
    for i, h in kept.items():
        if h:
            wanted = wanted | ((F.col("i") == i) & F.col("h1").isin(h))
    # what no survivor is counts into one row per column, which gives the number of values
    rows = _hashed(texts, range(len(names))).withColumn("kept", wanted).groupBy(
        "i", F.when(F.col("kept"), F.col("h1")).alias("h1"), F.when(F.col("kept"), F.col("h2")).alias("h2")).agg(
        F.count(F.lit(1)).alias("k")).collect()  # at most 1 / share rows per column, or FEW
    n = 0 if not rows else df.count() if n_rows is None else n_rows
    best: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    for r in rows:
        if r["h1"] is None:
            best.setdefault(r["i"], (0, []))
            continue
        k, own = best.get(r["i"], (0, []))
        if r["k"] >= k:
            best[r["i"]] = (r["k"], [*(own if r["k"] == k else []), (r["h1"], r["h2"])])
    open_ = sorted(i for i, (k, _) in best.items() if k <= share * n and i not in small)
    out: dict[str, tuple[int, list | DataFrame]] = {names[i]: b for i, b in best.items() if i not in open_}
    return out | {names[i]: w for i, w in (_counted(texts, open_) if rest else {}).items()}


def _hashed(texts: DataFrame, at: Iterable[int]) -> DataFrame:
    """A row (column, hashes, prefix) per text of the columns ``at``; each text is rendered once."""
    number = F.get(F.array(*map(F.lit, at)), F.col("i"))
    return cells(texts, [F.col(f"t{i}") for i in at]).where("v IS NOT NULL").select(
        number.alias("i"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("2"), "v").alias("h2"),
        F.substring("v", 1, PREFIX).alias("prefix"))


def _counted(texts: DataFrame, at: list[int]) -> dict[int, tuple[int, DataFrame]]:
    """The largest count of the columns ``at``, and the hashes with prefixes that reach it."""
    if not at:
        return {}
    counts = staged(_hashed(texts, at).groupBy("i", "h1", "h2").agg(
        F.count(F.lit(1)).alias("k"), F.min("prefix").alias("prefix")), "values")
    most = {r["i"]: r["k"] for r in counts.groupBy("i").agg(F.max("k").alias("k")).collect()}  # one row per column
    return {i: (k, counts.where((F.col("i") == i) & (F.col("k") == k)).select("h1", "h2", "prefix")) for i, k in most.items()}


def _smallest(texts: DataFrame, i: int, winners: DataFrame, few: int) -> str:
    """The smallest text of column i among the values (h1, h2, prefix)."""
    known = ""
    while True:
        step = winners.agg(F.min("prefix").alias("p")).first()["p"]
        if len(step) < PREFIX:  # the text ends here, so that no other one has this prefix
            return known + step
        known += step
        winners = staged(winners.where(F.col("prefix") == step).select("h1", "h2"), "ties")
        if winners.count() <= few:
            return _minimum(texts, {i: [(r["h1"], r["h2"]) for r in winners.collect()]})[i]
        h1, h2 = _hashes(i)
        longer = texts.where(F.col(f"t{i}").startswith(known)).select(
            h1.alias("h1"), h2.alias("h2"), F.substring(f"t{i}", len(known) + 1, PREFIX).alias("prefix")).distinct()
        winners = longer.join(winners, ["h1", "h2"], "left_semi")


def _minimum(texts: DataFrame, wanted: dict[int, list[tuple[int, int]]]) -> dict[int, str]:
    """The smallest text per column among the values with the given hashes: one aggregate over all columns."""
    aggs = []
    for i, pairs in wanted.items():
        h1, h2 = _hashes(i)
        hit = h1.isin([a for a, _ in pairs]) & h2.isin([b for _, b in pairs])
        aggs.append(F.min(F.when(hit, F.col(f"t{i}"))).alias(str(i)))
    row = texts.agg(*aggs).first() if aggs else None
    return {i: row[str(i)] for i in wanted}
