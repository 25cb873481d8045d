"""SimHash near-duplicate groups with pigeonring filtering.

*Fingerprint.* Word shingles of the lower-cased (A-Z) text are hashed with
XXH64; a bit of the 64-bit fingerprint is set if it is set in more than half of
the hashes.

*Candidates.* The fingerprint is a ring of ``SEGMENTS`` segments. If two
fingerprints differ in at most t bits, there is a segment from which every chain
of l consecutive segments differs in at most l * t / SEGMENTS bits (rounded
down). With t = 4 and 5 segments the budgets are 0, 1, 2, 3, 4: the first segment
agrees and the next differs in at most one bit, so of three parts of that next
segment at least two agree. First segment plus two of three parts make an
equi-join key of 21 to 22 bits; 15 keys per distinct fingerprint find every pair.
Candidates pass the remaining chain budgets before the full Hamming check.

*Scale.* Copies share a fingerprint and are collapsed first. Keys with one
fingerprint go nowhere; a key with more than ``CELL_ROWS`` is dealt into blocks
and every two blocks meet in a cell of their own, so a task holds a bounded
number of fingerprints however hot a key is. A cell gives a spanning forest of
its links, never all pairs. Components are found by alternating large-star and
small-star rounds on staged edge tables.

Defined cases: null text is empty and, like every text without words, has
fingerprint zero; texts with fewer words than a shingle count as one shingle;
null ids take part and are not named as a component (unless all are null);
repeated rows share a component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import (change_points, documents, each_text, keep_keys, row_key, runs_of, stage,
                             with_columns)

SEED = 42
MAX_BITS = 4
#: (first bit, bits) of the ring's segments, and of the three parts of each.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
CELL_ROWS = 4096
SMALL_CELL = 12


def _hash_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for a in range(0, len(h), 65_536):
        bits = np.unpackbits(h[a:a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return total


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int) -> int:
    """SimHash of a UTF-8 text over word shingles, as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[:len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1:] - 1).tolist())], np.uint64)
    value = int(_POWERS[_hash_counts(h) * 2 > len(h)].sum(dtype=np.uint64))
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(df: DataFrame, text_col: str, shingle: int = 4, name: str = "__fp",
                     keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) plus the fingerprint (long) of every whole text."""
    def column(cols: list[pa.Array]) -> list[pa.Array]:
        return [pa.array([fingerprint(t, shingle) for t in each_text(cols[0])], pa.int64())]

    return with_columns(df, [text_col], f"{name} long", column, keep)


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _parts(i: int) -> list[int]:
    """Bit masks of the three parts of segment i."""
    at, bits = SEGMENTS[i]
    cuts = [at, at + bits // 3, at + 2 * bits // 3, at + bits]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]


def key_masks() -> list[int]:
    """A segment and two of three parts of the next, as masks: the candidate keys."""
    masks = []
    for i, (at, bits) in enumerate(SEGMENTS):
        own, parts = ((1 << bits) - 1) << at, _parts((i + 1) % len(SEGMENTS))
        masks += [own | sum(parts) - p for p in parts]
    return masks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


_SEG_MASKS = [np.uint64(((1 << bits) - 1) << at) for at, bits in SEGMENTS]


def linked(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Whether fingerprints differ in at most ``max_bits``: chain budgets first, then all bits."""
    x = a ^ b
    m = len(_SEG_MASKS)
    d = np.stack([np.bitwise_count(x & s) for s in _SEG_MASKS]).astype(np.int16)
    chain, ok = np.zeros_like(d), np.ones(d.shape, bool)
    for length in range(1, m):
        chain += np.roll(d, -(length - 1), axis=0)
        ok &= chain <= length * max_bits // m
    found = ok.any(axis=0)
    found[found] = np.bitwise_count(x[found]) <= max_bits
    return found


def _forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among a cell's fingerprints."""
    left, out_a, out_b = fps, [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        pivot = queue.pop()
        near = linked(left, pivot, max_bits)
        if near.any():
            new = left[near]
            out_a.append(np.full(len(new), pivot, np.uint64))
            out_b.append(new)
            queue += list(new)
            left = left[~near]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _cell_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    for t in runs_of(batches, ["mask", "value", "lo", "hi"]):
        fps = t.column("fp").to_numpy().view(np.uint64)
        starts = change_points(t, ["mask", "value", "lo", "hi"])
        sizes = np.diff(np.append(starts, len(fps)))
        small = sizes <= SMALL_CELL
        out_a, out_b = [], []
        size_at = np.repeat(np.where(small, sizes, 0), sizes)
        place = np.arange(len(fps)) - np.repeat(starts, sizes)
        for step in range(1, SMALL_CELL):
            at = np.flatnonzero(place + step < size_at)
            if not len(at):
                break
            hit = at[linked(fps[at], fps[at + step], max_bits)]
            out_a.append(fps[hit])
            out_b.append(fps[hit + step])
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            a, b = _forest(fps[s:s + n], max_bits)
            out_a.append(a)
            out_b.append(b)
        a, b = np.concatenate(out_a).view(np.int64), np.concatenate(out_b).view(np.int64)
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a < b) that connect the distinct fingerprints ``fp`` as all links would."""
    if max_bits * 2 >= len(SEGMENTS) * 2:
        raise ValueError("the key budget (0, then 1) needs max_bits below the number of segments")
    keys = fps.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(key_masks())))).alias("k")).select("fp", "k.mask", "k.value")
    shared = keys.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / cell_rows)
    own = F.pmod(F.xxhash64("fp", F.lit(5)), F.col("blocks"))
    cells = (keys.hint("merge").join(shared, ["mask", "value"]).withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("fp", "mask", "value", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")))
    where = ["mask", "value", "lo", "hi"]
    return (cells.repartition(*where).sortWithinPartitions(*where)
            .mapInArrow(lambda b: _cell_links(b, max_bits), "a long, b long").distinct())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the smallest node of its component.

    Large-star and small-star rounds; each round's edges are staged, and the
    rounds end when the edges no longer change.
    """
    def summary(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003))
                     .first())

    now = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    seen = summary(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node keeps an edge to its own minimum
        large = large.unionByName(least.filter("u <> m").select("u", F.col("m").alias("v"))).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        turned = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stage(turned.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
        last, seen = seen, summary(now)
        if seen == last:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def fingerprint_components(ids: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """From rows (doc_id, fp): one row per distinct fingerprint, (fp, component_id).

    ``component_id`` is the smallest doc_id of the fingerprint's component.
    """
    distinct = stage(ids.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(named, "root").select("fp", "component_id")


def simhash_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                       max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    ids = stage(with_fingerprint(documents(df, id_col, text_col), "text", shingle, "fp", ["doc_id"]), "simhash")
    return (ids.join(fingerprint_components(ids, max_bits), "fp")
            .select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``df`` that stay: of each component one with its smallest id.

    Of rows that repeat that id, the one with the smallest text hash stays.
    """
    doc, tie = row_key(id_col, text_col)
    slim = df.select(F.col(f"`{text_col}`").cast("string").alias("text"), doc, tie)
    ids = stage(with_fingerprint(slim, "text", shingle, "fp", ["__doc", "__tie"]), "simhash")
    named = ids.withColumn("doc_id", F.when(F.col("__doc") != F.lit(-(1 << 63)), F.col("__doc")))
    parts = fingerprint_components(named.select("doc_id", "fp"), max_bits)
    # a component without any id is one per fingerprint
    group = [F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("fp"))]
    best = (named.join(parts, "fp").groupBy(*group)
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "__doc", "__tie")).alias("w"))
            .select("w.__doc", "w.__tie"))
    return keep_keys(df, best, id_col, text_col)
