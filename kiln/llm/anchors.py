"""Winnowed anchors: what substring and suffix-array deduplication share.

A *unit* is a word or a byte. Every window of ``window`` consecutive units has one
anchor: of the grams (``gram`` units) inside the window the one whose hash ranks
lowest, the leftmost of equals. The choice depends on the window's content alone,
so equal windows have their anchor at the same place, wherever they occur.

Consecutive windows of a document with the same anchor place form an occurrence
(gram hash, context hash, document, first and last window). Its context is all
units of those windows. Occurrences with equal gram and context hash have all
their windows in common; occurrences of one gram with different contexts may
share some. Occurrences are ranged over all tasks by (gram, context, document,
place) with sampled splitters, so neither a gram nor a passage that fills a third
of the table is one task's work; each partition walks its sorted rows once, and
two rows per partition tell which runs go on next door.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import each_text, stage, text_bytes

CHUNK_BYTES = 1 << 20
PLACE_BITS = 30  # of a packed rank: places in a chunk; the other 34 rank the gram
_U = np.uint64
_BASES = (_U(0x9E3779B97F4A7C15 | 1), _U(0xC2B2AE3D27D4EB4F | 1))
_INVERSES = tuple(_U(pow(int(b), -1, 1 << 64)) for b in _BASES)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Powers:
    """Powers of the bases and of their inverses modulo 2^64, grown on demand."""

    def __init__(self):
        self.n, self.up, self.down = 0, [], []

    def get(self, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK_BYTES + 4096)
            ones = np.ones(self.n, _U)
            self.up, self.down = [], []
            for b, i in zip(_BASES, _INVERSES):
                for out, base in ((self.up, b), (self.down, i)):
                    x = ones * base
                    x[0] = 1
                    out.append(np.multiply.accumulate(x))
        return self.up[which], self.down[which]


_POWERS = Powers()


class Rolling:
    """Polynomial hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, which: int = 0):
        up, self.down = _POWERS.get(len(values) + 1, which)
        self.sums = np.zeros(len(values) + 1, _U)
        np.cumsum(values * up[:len(values)], out=self.sums[1:])

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the values from a (inclusive) to b (exclusive)."""
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(_U))


def lowest(ranks: np.ndarray, width: int) -> np.ndarray:
    """Place of the lowest rank (leftmost of equals) in each run of ``width`` ranks."""
    n = len(ranks)
    packed = (ranks >> _U(PLACE_BITS) << _U(PLACE_BITS)) | np.arange(n, dtype=_U)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(_U).max, _U)
    padded[:n] = packed
    rows = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[:n - width + 1], ahead[width - 1:n])
    return (low & _U((1 << PLACE_BITS) - 1)).astype(np.int64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Rolling(data.astype(_U) + _U(1)).hash(starts, ends)


def word_bounds(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte bounds of the words of concatenated texts, and each text's first word (with the end)."""
    n = len(data)
    solid = ~_SPACE[data]
    begins, stops = solid.copy(), np.zeros(n + 1, bool)
    inner = edges[(edges > 0) & (edges < n)]
    begins[1:] &= ~solid[:-1]
    begins[inner] = solid[inner]
    stops[1:n] = solid[:-1] & ~solid[1:]
    stops[inner] = solid[inner - 1]
    stops[n] = n > 0 and solid[-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops), np.searchsorted(starts, edges)


class Units:
    """The hashable units of some texts: hashes of words, or bytes; ``edges`` are the texts' bounds in units."""

    def __init__(self, data: np.ndarray, edges: np.ndarray, words: bool):
        if words:
            self.starts, self.ends, self.edges = word_bounds(data, edges)
            self.values = word_hashes(data, self.starts, self.ends)
        else:
            self.edges, self.values = edges, data.astype(_U) + _U(1)


def occurrences(units: Units, gram: int, window: int) -> tuple[np.ndarray, ...]:
    """(text, gram hash, context hash, first window, last window, anchor) of every anchor occurrence.

    Windows and the anchor's place are numbered from their text's start.
    """
    n, edges = len(units.values), units.edges
    none = tuple(np.zeros(0, t) for t in (np.int64, _U, _U, np.int64, np.int64, np.int64))
    if n < window:
        return none
    rolling = Rolling(units.values)
    at = np.arange(n - gram + 1)
    grams = rolling.hash(at, at + gram)
    place = lowest(grams, window - gram + 1)
    text = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    valid = np.flatnonzero(text[:n - window + 1] == text[window - 1:])  # windows inside one text
    if not len(valid):
        return none
    place, owner = place[valid], text[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    lo, hi, p = valid[first], valid[last], place[first]
    context = Rolling(units.values, 1).hash(lo, hi + window)
    with np.errstate(over="ignore"):
        context = mix(context + (p - lo).astype(_U) * _BASES[0])
    begin = edges[owner[first]]
    return owner[first], grams[p], context, lo - begin, hi - begin, p - begin


def chunks(arr: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a string column with at most ``limit`` bytes (or one text): rows, bytes and text bounds."""
    data, off = text_bytes(arr)
    raw = np.frombuffer(data, np.uint8)
    a = 0
    while a < len(arr):
        z = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        yield a, z, raw[off[a]:off[z]], off[a:z + 1] - off[a]
        a = z


def keyed_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tie, text): ids with null as the smallest number, and 64 bits that tell texts of one id apart."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("doc"),
                     F.xxhash64(text).alias("tie"), text.alias("text"))


def doc_id(doc: Column) -> Column:
    """The id behind ``doc``: null again for the smallest number."""
    return F.when(doc != F.lit(-(1 << 63)), doc)


OCCURRENCE = "h long, ctx long, doc long, place long, span int"
TIED = f"{OCCURRENCE}, tie long"


def anchor_rows(docs: DataFrame, gram: int, window: int, words: bool) -> DataFrame:
    """Occurrences of ``docs``: gram and context hash, doc, place (first window), span, tie.

    ``span`` holds how many windows follow the first (low 16 bits) and how far the anchor is from its start.
    """
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, tie = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, z, data, edges in chunks(b.column(2)):
                text, h, ctx, lo, hi, p = occurrences(Units(data, edges, words), gram, window)
                if len(text):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(doc[a:z][text]),
                         pa.array(lo), pa.array(((hi - lo) | (p - lo) << 16).astype(np.int32)), pa.array(tie[a:z][text])],
                        names=["h", "ctx", "doc", "place", "span", "tie"])

    return docs.mapInArrow(rows, TIED)


_MARKED = ("h long, ctx long, doc long, place long, tie long, span int, repeated boolean, copies boolean, first boolean, "
           "several boolean, part int, head int")


class _Walk:
    """State of one partition's walk over rows sorted by (h, ctx, doc, place, tie)."""

    KEYS = ("h", "ctx", "doc", "place", "tie")

    def __init__(self, part: int):
        self.part = part
        self.first_h: int | None = None
        self.before: tuple | None = None  # keys of the last row given out
        self.several = False  # whether its gram run has shown several contexts
        self.leader: pa.RecordBatch | None = None  # else: the marked first row of that run

    def marks(self, t: pa.RecordBatch, after: pa.RecordBatch | None) -> pa.RecordBatch | None:
        """The marked rows of ``t``; ``after`` begins with the next row."""
        keys = [t.column(c).to_numpy() for c in self.KEYS]
        none = [np.empty(0, np.int64)] * len(self.KEYS)
        prior = [np.array([x], np.int64) for x in self.before] if self.before else none
        later = [after.column(c).to_numpy()[:1] for c in self.KEYS] if after is not None else none
        h, ctx, doc, place, tie = (np.concatenate([p, k, q]) for p, k, q in zip(prior, keys, later))
        lead, n = len(prior[0]), len(keys[0])
        same_h = h[1:] == h[:-1]
        same_c = same_h & (ctx[1:] == ctx[:-1])
        other = same_c & ((doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (tie[1:] != tie[:-1]))
        no = np.zeros(1, bool)
        back = lambda x: x[:n] if lead else np.concatenate([no, x[:n - 1]])  # noqa: E731  the row before agrees
        ahead = lambda x: np.concatenate([x, no])[lead:lead + n]  # noqa: E731  the row after agrees
        joins_h, joins_c = back(same_h), back(same_c)
        run = np.cumsum(~joins_h) - (0 if joins_h[0] else 1)
        several = np.zeros(int(run[-1]) + 1, bool)
        several[run[joins_h & ~joins_c]] = True
        if len(later[0]) and same_h[-1] and not same_c[-1]:
            several[run[-1]] = True
        late = None
        if joins_h[0]:
            if self.several:
                several[0] = True
            elif several[0]:  # the run's first row was given out as the leader of its only context
                late = self.leader
        if self.first_h is None:
            self.first_h = int(keys[0][0])
        row_several = several[run]
        repeated, copies = back(other), ahead(other)
        head = np.where(keys[0] == self.first_h, 1, 0)
        if after is None:
            head = head + np.where(keys[0] == keys[0][-1], 2, 0)
        marked = lambda at, sev: self._rows(t, at, (
            repeated[at], copies[at], ~joins_c[at], sev, head[at].astype(np.int32)))
        self.before, self.several = tuple(int(k[-1]) for k in keys), bool(several[-1])
        start = int(np.flatnonzero(~joins_h)[-1]) if (~joins_h).any() else None
        if start is not None:
            at = np.array([start])
            self.leader = marked(at, np.ones(1, bool))
        keep = np.flatnonzero(repeated | copies | row_several | (head > 0))
        out = [marked(keep, row_several[keep])] if len(keep) else []
        out = ([late] if late is not None else []) + out
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    def _rows(self, t: pa.RecordBatch, at: np.ndarray, marks: tuple) -> pa.RecordBatch:
        *flags, head = marks
        return pa.RecordBatch.from_arrays(
            [*(t.column(c).take(pa.array(at)) for c in (*self.KEYS, "span")), *(pa.array(f) for f in flags),
             pa.array(np.full(len(at), self.part, np.int32)), pa.array(head)],
            names=[f.split()[0] for f in _MARKED.split(", ")])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows a batch behind and drop those that share nothing.

    ``repeated``: an earlier row has the same gram and context; ``copies``: a later
    one has; ``first``: the first row of its context; ``several``: its gram has
    several contexts (certain for first rows; one that was given out before its
    run's second context came is given out again). ``head`` (1: first gram run of the
    partition, 2: last, 3: both) marks rows that the partitions next door concern.
    """
    walk, held = _Walk(TaskContext.get().partitionId()), None
    for b in batches:
        if b.num_rows:
            got = walk.marks(held, b) if held is not None else None
            if got is not None:
                yield got
            held = b
    got = walk.marks(held, None) if held is not None else None
    if got is not None:
        yield got


def mark(rows: DataFrame, label: str) -> DataFrame:
    """Rows (h, ctx, doc, place, tie, span) that share a context or whose gram has several, with marks.

    Rows without a tie have one text per doc.
    """
    if "tie" not in rows.columns:
        rows = rows.withColumn("tie", F.lit(0).cast("long"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h", "ctx", "doc", "place", "tie"]
    marked = stage(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(_mark, _MARKED), label)
    row = F.struct(*order)
    edges = marked.filter("head > 0").groupBy("part").agg(
        F.min(row).alias("low"), F.max(row).alias("high"),
        F.max(F.when(F.col("head").bitwiseAND(1) > 0, F.col("several"))).alias("several_low"),
        F.max(F.when(F.col("head").bitwiseAND(2) > 0, F.col("several"))).alias("several_high")
    ).orderBy("part").collect()  # one row per partition
    fixes = _next_door(edges)
    if not fixes:
        return marked.drop("part", "head")
    table = marked.sparkSession.createDataFrame(fixes, (
        "f_part int, low_h long, low_ctx long, high_h long, high_ctx long, joined boolean, continues boolean, "
        "f_low boolean, f_high boolean"))
    is_low_context = (F.col("h") == F.col("low_h")) & (F.col("ctx") == F.col("low_ctx"))
    is_high_context = (F.col("h") == F.col("high_h")) & (F.col("ctx") == F.col("high_ctx"))
    fixed = marked.join(F.broadcast(table), F.col("part") == F.col("f_part"), "left")  # one row per partition
    yes = lambda c: F.coalesce(c, F.lit(False))
    return fixed.select(
        "h", "ctx", "doc", "place", "tie", "span",
        (F.col("repeated") | yes(F.col("joined") & is_low_context)).alias("repeated"),
        (F.col("copies") | yes(F.col("continues") & is_high_context)).alias("copies"),
        (F.col("first") & ~yes(F.col("joined") & is_low_context)).alias("first"),
        (F.col("several") | yes(F.col("f_low") & (F.col("h") == F.col("low_h")))
         | yes(F.col("f_high") & (F.col("h") == F.col("high_h")))).alias("several"))


def _next_door(edges: list) -> list[tuple]:
    """Per partition with rows, in order: its edge rows, and what the partitions next to it add.

    The last gram run of a partition goes on next door if the first gram there is
    the same; a chain of such pieces has several contexts if a piece has, or if
    two neighbouring pieces meet with different contexts.
    """
    chain: list[int] = []  # number of the chain that each partition's first run belongs to
    last: list[int] = []   # and its last run
    several: list[bool] = []
    for i, e in enumerate(edges):
        goes_on = i > 0 and edges[i - 1]["high"]["h"] == e["low"]["h"]
        if goes_on:
            chain.append(last[-1])
            several[chain[-1]] |= bool(e["several_low"]) or edges[i - 1]["high"]["ctx"] != e["low"]["ctx"]
        else:
            chain.append(len(several))
            several.append(bool(e["several_low"]))
        if e["low"]["h"] == e["high"]["h"]:
            last.append(chain[-1])
            several[last[-1]] |= bool(e["several_high"])
        else:
            last.append(len(several))
            several.append(bool(e["several_high"]))
    meets = [e["high"]["h"] == f["low"]["h"] and e["high"]["ctx"] == f["low"]["ctx"] for e, f in zip(edges, edges[1:])]
    return [(e["part"], e["low"]["h"], e["low"]["ctx"], e["high"]["h"], e["high"]["ctx"], i > 0 and meets[i - 1],
             i < len(meets) and meets[i], several[chain[i]], several[last[i]]) for i, e in enumerate(edges)]


# Documents travel compressed, since a shuffle of texts is what these operators write most of.

def packed(docs: DataFrame) -> DataFrame:
    """(doc, tie, blob): keyed documents with the text compressed."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            if b.num_rows:
                blobs = pa.array([press(t) for t in each_text(b.column(2))], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), blobs], names=["doc", "tie", "blob"])

    return docs.mapInArrow(pack, "doc long, tie long, blob binary")


def unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def gathered(spans: DataFrame) -> DataFrame:
    """From rows (doc, tie, place, span): per document the sorted list of (lo, hi) windows."""
    return spans.select("doc", "tie", F.col("place").alias("lo"),
                        (F.col("place") + F.col("span").bitwiseAND(0xFFFF)).alias("hi")).groupBy("doc", "tie")


def with_spans(docs: DataFrame, spans: DataFrame, how: str, once: bool = False) -> DataFrame:
    """Compressed documents joined with a per-document table (doc, tie, ...); ``once``: repeated rows as one.

    Repeated rows meet in a partial aggregate before the shuffle that the join needs anyway.
    """
    s = spans.withColumnsRenamed({"doc": "s_doc", "tie": "s_tie"})
    rows = packed(docs)
    if once:
        rows = rows.groupBy("doc", "tie").agg(F.first("blob").alias("blob"))
    return rows.join(s.hint("merge"), (F.col("doc") == F.col("s_doc")) & (F.col("tie") == F.col("s_tie")),
                             how).drop("s_doc", "s_tie")


def covered(lo: np.ndarray, hi: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n units lie in a window that starts in one of the ranges lo..hi."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, np.minimum(hi + window, n), -1)
    return np.cumsum(step[:n]) > 0
