"""Mixing sources to target weights.

1. *Pack.* A document's size is its number of words. The documents of a source
   form one stream of words (in a pseudorandom document order) that is cut into
   blocks of ``block_words``; a document's place in the stream comes from a
   two-level prefix sum (hash chunks of bounded size, then chunk totals), so a
   source that holds a third of all rows is never summed in one task.
2. *Target.* Sources share ``amount`` times all words by weight; a target stops
   at ``max_repeat`` times its source's size and the excess is reshared by
   weight until none is above (water filling).
3. *Draw.* A source takes ``target / size`` of its stream: so many block draws,
   whole passes and a part. The last block of the part is cut to the words still
   due, so that a source takes its target, rounded to a word, however small it
   is. The draws of a source are dealt over the output shards by one seeded
   multinomial, so that each shard's mixture is a multinomial sample while the
   source's total stays exact; ``shard_layout`` lists each shard's slots in order.
4. *Map and join.* Draw ``k`` of a source is block ``perm(k mod blocks)`` of pass
   ``k div blocks``, with ``perm`` a keyed Feistel permutation of the source's
   block numbers for that pass: no block repeats within a pass. Draws and blocks
   meet in an equi-join on (source, block).

Same input, seed and parameters give the same mixture on any partitioning.

Defined cases: null text has size 0 and is never taken; the null source is a
source like any other and comes last; repeated rows are separate documents; a
source without words has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import WORD, stage

BLOCK_WORDS = 256
CHUNK_ROWS = 8_192
SHARD_SLOTS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...], amount: float, max_repeat: float) -> DataFrame:
    """``totals`` (one row per source: source, source_size) plus ``rank``, ``target``.

    Water filling in closed form: sources in rising order of cap / weight are
    capped as long as their cap is below the level that the rest would get.
    One row per source, so the ordered windows see sources, not documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = totals.withColumn("rank", F.row_number().over(order) - 1) \
        .withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))) \
        .withColumn("cap", F.col("source_size") * float(max_repeat))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) * float(amount) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(rest))
    fits = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))
    # the first source that stays below its cap sets the level of all that do
    final = level.withColumn("final", F.min(F.when(fits.isNotNull(), F.struct(
        (F.col("cap") / F.col("weight")).alias("o"), F.col("rank").alias("r"), F.col("level").alias("l"))))
        .over(whole).getField("l"))
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("final") * F.col("weight")))
    return final.select("source", "source_size", "rank", target.alias("target"))


def _streams(docs: DataFrame) -> DataFrame:
    """Non-empty documents plus ``start``: words of their source's stream before them."""
    per_source = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    keyed = (docs.join(per_source, docs["source"].eqNullSafe(per_source["source"]), "inner")
             .select(docs["*"], F.ceil(F.col("n") / CHUNK_ROWS).alias("chunks"))
             .withColumn("order", F.xxhash64("k1", F.lit(7)))
             .withColumn("chunk", F.pmod(F.col("order"), F.col("chunks"))).drop("chunks"))
    within = Window.partitionBy("source", "chunk").orderBy("order", "doc_id", "size", "k1", "k2")
    keyed = keyed.withColumn("inner", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
                             - F.col("size"))
    totals = keyed.groupBy("source", "chunk").agg(F.sum("size").alias("words"))
    offset = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("t_source"), F.col("chunk").alias("t_chunk"),
                                F.coalesce(F.sum("words").over(offset), F.lit(0)).alias("base"))
    return keyed.join(totals, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("chunk") == F.col("t_chunk"))) \
        .withColumn("start", F.col("base") + F.col("inner")).drop("t_source", "t_chunk", "base", "inner", "chunk", "order")


def _mix(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of x under key."""
    with np.errstate(over="ignore"):
        z = x + key * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int, rounds: int = 4, back: bool = False) -> np.ndarray:
    """A keyed pseudorandom permutation of 0..n-1 (or ``back``): Feistel network with cycle walking."""
    if n <= 1:
        return index.astype(np.int64)
    half = np.uint64(max(1, (int(n - 1).bit_length() + 1) // 2))
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> half, x & mask
        for r in reversed(range(rounds)) if back else range(rounds):
            round_key = np.uint64((key * 31 + r + 1) & 0xFFFFFFFFFFFFFFFF)
            if back:
                left, right = right ^ (_mix(left, round_key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, round_key) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def _pass_key(seed: int, rank: int, turn: int) -> int:
    return hash((seed, rank, turn))


def draw_plan(size: int, target: float, block_words: int, seed: int, rank: int) -> tuple[int, int, int]:
    """(blocks, draws, words of the last draw) by which a source takes its target, rounded to a word."""
    blocks = -(-size // block_words)
    passes, due = divmod(int(round(target)), size)
    if not due:
        return blocks, passes * blocks, block_words
    part, tail = -(-due // block_words), size - (blocks - 1) * block_words
    last = due - (part - 1) * block_words
    # the short block at the stream's end may be among the part's draws
    at = int(permute(np.array([blocks - 1]), blocks, _pass_key(seed, rank, passes), back=True)[0])
    if at < part - 1 or (at == part - 1 and last > tail):
        last += block_words - tail
        if last > block_words:
            part, last = part + 1, last - block_words
    return blocks, passes * blocks + part, last


def _draws(targets: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Draws per source and shard: (rank, n_blocks, shard, first, count, cut).

    ``cut`` is how many words the shard's last draw takes of its block.
    """
    total = F.sum("target").over(Window.partitionBy())
    plan = targets.filter("source_size > 0 AND target > 0").select(
        "rank", "source_size", "target",
        F.greatest(F.lit(1), F.ceil(total / (block_words * SHARD_SLOTS))).cast("long").alias("shards"))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                blocks, draws, last = draw_plan(int(r.source_size), float(r.target), block_words, seed, int(r.rank))
                rng = np.random.Generator(np.random.PCG64([seed, int(r.rank)]))
                counts = rng.multinomial(draws, np.full(int(r.shards), 1.0 / int(r.shards)))
                first = np.cumsum(counts) - counts
                some = np.flatnonzero(counts)
                for a in range(0, len(some), 100_000):
                    s = some[a:a + 100_000]
                    yield pd.DataFrame({"rank": int(r.rank), "blocks": blocks, "shard": s, "first": first[s],
                                        "count": counts[s],
                                        "cut": np.where(first[s] + counts[s] == draws, last, block_words)})

    return plan.repartition("rank").mapInPandas(
        deal, "rank long, blocks long, shard long, first long, count long, cut long")


def _slots(draws: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row per draw: (rank, shard, place in the shard, pass, block, words taken from the block's start)."""
    # a shard's sources follow each other by rank: at most SHARD_SLOTS rows of a shard, or one per source
    lower = Window.partitionBy("shard").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    draws = draws.withColumn("base", F.coalesce(F.sum("count").over(lower), F.lit(0)))

    def map_blocks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                k = np.arange(int(r.first), int(r.first) + int(r.count), dtype=np.int64)
                turn, block = k // int(r.blocks), np.empty(len(k), np.int64)
                for p in np.unique(turn).tolist():
                    at = turn == p
                    block[at] = permute(k[at] % int(r.blocks), int(r.blocks), _pass_key(seed, int(r.rank), p))
                words = np.full(len(k), block_words, np.int64)
                words[-1] = int(r.cut)
                yield pd.DataFrame({"rank": int(r.rank), "shard": int(r.shard), "place": int(r.base) + np.arange(len(k)),
                                    "turn": turn, "block": block, "words": words})

    return draws.repartition(F.col("rank"), F.col("shard")).mapInPandas(
        map_blocks, "rank long, shard long, place long, turn long, block long, words long")


def _row_key(df: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[Column, Column]:
    """96 bits that tell rows apart by id, source and text; fully repeated rows share them."""
    parts = [F.col(f"`{id_col}`").cast("long"), F.col(f"`{source_col}`").cast("string"),
             F.col(f"`{text_col}`").cast("string")]
    return F.xxhash64(*parts).alias("k1"), F.hash(*parts).alias("k2")


def plan_mixture(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, max_repeat: float = 2.0,
                 block_words: int = BLOCK_WORDS, seed: int = 11) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, targets, slots), all staged or one row per source.

    documents: doc_id, source, size, k1, k2, start; targets: source, source_size,
    rank, target; slots: rank, shard, place, turn, block, words - one row per drawn block.
    """
    text = F.col(f"`{text_col}`").cast("string")
    base = stage(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                           F.col(f"`{source_col}`").cast("string").alias("source"),
                           word_count(text).alias("size"),
                           *_row_key(df, id_col, text_col, source_col)), "mix-sizes")
    targets = stage(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")),
                                   weights, amount, max_repeat), "mix-targets")
    docs = _streams(base)
    return docs, targets, _slots(_draws(targets, block_words, seed), block_words, seed)


def _pieces(docs: DataFrame, targets: DataFrame, block_words: int) -> DataFrame:
    """Parts of documents by block: doc columns plus rank, block, from, upto (words of the document)."""
    t = targets.select(F.col("source").alias("t_source"), "rank")
    with_rank = docs.filter("size > 0").join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    blocks = F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words))
    return (with_rank.withColumn("block", F.explode(blocks))
            .withColumn("from", F.greatest(F.lit(0), F.col("block") * block_words - F.col("start")))
            .withColumn("upto", F.least("size", (F.col("block") + 1) * block_words - F.col("start"))))


def _taken(pieces: DataFrame, slots: DataFrame, block_words: int) -> DataFrame:
    """Pieces with the slots that draw their block, ``upto`` cut to the slot's words."""
    # the planner sees only the small table that the draws were made from: it must not broadcast them
    end = F.col("block") * block_words + F.col("words") - F.col("start")
    return pieces.join(slots.hint("merge"), ["rank", "block"]).withColumn("upto", F.least("upto", end)).filter(
        F.col("upto") > F.col("from"))


def shard_layout(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, max_repeat: float = 2.0,
                 block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """What the output shards hold: shard, place (gapless from 0), doc_id, source, block, pass, and the words
    ``from`` .. ``upto`` of the document that the slot's block takes; a slot has a row per document in its block.
    """
    docs, targets, slots = plan_mixture(df, id_col, text_col, source_col, weights, amount, max_repeat, block_words, seed)
    return _taken(_pieces(stage(docs, "mix-stream"), targets, block_words), slots, block_words).select(
        "shard", "place", "doc_id", "source", "block", F.col("turn").alias("pass"), "from", "upto")


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, max_repeat: float = 2.0,
                block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, shards (output shards with words of it)."""
    docs, targets, slots = plan_mixture(df, id_col, text_col, source_col, weights, amount, max_repeat,
                                        block_words, seed)
    docs = stage(docs, "mix-stream")
    times = slots.groupBy("rank", "block", "words").agg(F.count(F.lit(1)).alias("times"), F.collect_set("shard").alias("to"))
    taken = (_taken(_pieces(docs, targets, block_words), times, block_words)
             .groupBy("rank", "start").agg(
                 F.sum((F.col("upto") - F.col("from")) * F.col("times")).alias("taken"),
                 F.array_sort(F.array_distinct(F.flatten(F.collect_list("to")))).alias("shards"))  # one document's blocks
             .withColumnRenamed("start", "k_start").withColumnRenamed("rank", "k_rank"))
    t = targets.select(F.col("source").alias("t_source"), "rank", "source_size", "target")
    return (docs.join(t, F.col("source").eqNullSafe(F.col("t_source")))
            .join(taken, (F.col("rank") == F.col("k_rank")) & (F.col("start") == F.col("k_start"))
                  & (F.col("size") > 0), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken"),
                    F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards")))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[float, ...] = (5, 2, 1), amount: float = 1.5, max_repeat: float = 2.0,
                    block_words: int = BLOCK_WORDS, seed: int = 11) -> DataFrame:
    """The mixture as rows of ``df``: one row per document and pass that takes some of it.

    A row that is taken whole keeps its text; otherwise its text is the taken
    words (blocks in document order), joined by one space. Other columns stay.
    """
    names = df.columns
    text = F.col(f"`{text_col}`").cast("string")
    docs, targets, slots = plan_mixture(df, id_col, text_col, source_col, weights, amount, max_repeat,
                                        block_words, seed)
    docs = stage(docs, "mix-stream")
    parts = (_taken(_pieces(docs, targets, block_words), slots.select("rank", "block", "turn", "words"), block_words)
             .groupBy("k1", "k2", "start", "size", "turn")
             .agg(F.sort_array(F.collect_list(F.struct("from", "upto"))).alias("parts"),
                  F.sum(F.col("upto") - F.col("from")).alias("got")))
    # fully repeated rows are told apart by their order in the stream
    nth = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("start"))
    parts = parts.withColumn("nth", nth).groupBy("k1", "k2").agg(F.collect_list(F.struct(
        "nth", "turn", "parts", (F.col("got") == F.col("size")).alias("whole"))).alias("__taken")) \
        .withColumnsRenamed({"k1": "__k1", "k2": "__k2"})
    k1, k2 = _row_key(df, id_col, text_col, source_col)
    rows = df.withColumns({"__r1": k1, "__r2": k2}).join(parts, (F.col("__r1") == F.col("__k1"))
                                                         & (F.col("__r2") == F.col("__k2")))
    own = F.row_number().over(Window.partitionBy("__r1", "__r2").orderBy(F.lit(1)))
    rows = rows.withColumn("__own", own).withColumn("__one", F.explode(F.filter(
        "__taken", lambda t: t["nth"] == F.col("__own"))))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    rows = rows.withColumn("__words", F.when(~F.col("__one.whole"), words))
    cut = F.array_join(F.flatten(F.transform("__one.parts", lambda p: F.slice(
        F.col("__words"), (p["from"] + 1).cast("int"), (p["upto"] - p["from"]).cast("int")))), " ")
    return rows.select(*(F.when(F.col("__one.whole"), F.col(f"`{c}`")).otherwise(cut).alias(c) if c == text_col
                         else F.col(f"`{c}`") for c in names))
