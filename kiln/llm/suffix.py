"""Suffix-array deduplication of byte strings.

Removes every byte that lies in a string of ``window`` bytes which starts at more
than one place in the corpus (all its occurrences, the first too).

*Candidates.* Every window has one winnowed anchor (see ``anchors``). Occurrences
whose anchor and context (all bytes of the windows it stands for) agree repeat each
other whole. Where an anchor has several contexts, some of their windows may still
be shared: the first occurrence of each context goes on, with its bytes.

*Suffix arrays.* The contexts of an anchor are laid over each other at the anchor
and cut to what each shares with any other one, to the left and to the right
(neighbours in sorted order share most); contexts that keep fewer than ``window``
bytes share no window and are done. The different strings that are left are
joined, with separators, and their suffixes sorted by linear grouping construction
(see ``gsaca``). A window is repeated if the suffix it begins agrees with a
neighbour in the suffix array on ``window`` bytes, or if its string stands for
several contexts.

*Hot anchors.* An anchor with more than ``CELL_CONTEXTS`` contexts does not go to
one task: the windows of its contexts go through the range-partitioned walk that
anchors went through, with a 128-bit hash each. That is exact as well.

Defined cases: a null text has no bytes; matches may overlap and never cross
documents; rows with one id and different texts are different documents, fully
repeated rows are one document and get the same result each; null ids count as any
other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.anchors import (TIED, Rolling, Units, anchor_rows, covered, doc_id, gathered, keyed_documents, mark, unpack,
                              with_spans)
from kiln.llm.common import change_points, runs_of, stage
from kiln.llm.gsaca import suffix_array

WINDOW = 200
GRAM = 32
CELL_CONTEXTS = 8_192

_SHARED = "doc long, tie long, place long, span int"
_CONTEXT = "h long, doc long, tie long, place long, copies boolean, before binary, after binary"


def _contexts(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The bytes before the anchor (turned round) and from it on, of each leader of each document."""
    for b in batches:
        out: list[tuple] = []
        for i in range(b.num_rows):
            text, doc, tie = unpack(b.column("blob")[i].as_py()), b.column("doc")[i].as_py(), b.column("tie")[i].as_py()
            for h, lo, hi, anchor, copies in zip(*(b.column("leaders").slice(i, 1).flatten().field(k).to_pylist()
                                                   for k in ("h", "lo", "hi", "anchor", "copies"))):
                p = lo + anchor
                out.append((h, doc, tie, lo, copies, text[lo:p][::-1], text[p:hi + window]))
            if len(out) > 4096:
                yield _table(out, _CONTEXT_TYPES, _CONTEXT)
                out = []
        if out:
            yield _table(out, _CONTEXT_TYPES, _CONTEXT)


_CONTEXT_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())


def _table(rows: list[tuple], types: tuple, ddl: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=[f.split()[0] for f in ddl.split(", ")])


def _padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``width`` bytes, zero beyond a value's end (and zero bytes as one), and the lengths."""
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    size = np.diff(off)
    out = np.zeros((len(size), width), np.uint8)
    at = np.arange(width) < size[:, None]
    out[at] = np.maximum(raw[off[0]:off[-1]], 1)
    return out, size


def _most_shared(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Longest prefix that each row shares with another row of its group; zeros end a row."""
    n, width = rows.shape
    keyed = np.hstack([group.astype(">u4").view(np.uint8).reshape(n, 4), rows])
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{width + 4}").ravel(), kind="stable")
    a, b = rows[order[:-1]], rows[order[1:]]
    apart = (a != b) | (a == 0)
    share = np.where(apart.any(axis=1), apart.argmax(axis=1), width)
    share[group[order[:-1]] != group[order[1:]]] = 0
    most = np.zeros(n, np.int64)
    most[order[:-1]] = share
    most[order[1:]] = np.maximum(most[order[1:]], share)
    return most


def repeated_in(strings: list[bytes], window: int) -> list[np.ndarray]:
    """For each string, which of its windows start at another place of any of the strings too."""
    size = [len(s) for s in strings]
    joined = b"".join(strings)
    bounds = np.cumsum([0, *size])
    text = np.insert(np.frombuffer(joined, np.uint8).astype(np.int64) + 2, bounds[1:], 1)
    text[-1] = 0  # separators are 1, the last one ends the text
    starts = bounds[:-1] + np.arange(len(strings))
    whole = np.zeros(len(text), bool)
    for s, n in zip(starts.tolist(), size):
        whole[s:s + n - window + 1] = n >= window
    order = suffix_array(text)
    order = order[whole[order]]
    hit = np.zeros(len(text), bool)
    if len(order) > 1:
        small = text.astype(np.uint16)
        rows = np.lib.stride_tricks.sliding_window_view(small, window)
        for a in range(0, len(order) - 1, 4096):
            x, y = order[a:a + 4096], order[a + 1:a + 4097]
            x = x[:len(y)]
            same = (rows[x] == rows[y]).all(axis=1)
            hit[x[same]] = True
            hit[y[same]] = True
    return [hit[s:s + max(0, n - window + 1)] for s, n in zip(starts.tolist(), size)]


def _shared_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc, tie, place, span) of repeated windows among the contexts of each anchor; rows come sorted by h."""
    for t in runs_of(batches, ["h"]):
        n = t.num_rows
        group = np.zeros(n, np.int64)
        group[change_points(t, ["h"])] = 1
        group = np.cumsum(group)
        sides = []
        for name in ("before", "after"):
            column = t.column(name)
            rows, size = _padded(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column, window)
            sides.append(np.minimum(_most_shared(group, rows), size))
        left, right = sides
        alive = np.flatnonzero(left + right >= window)
        out: list[tuple] = []
        docs, ties, places = (t.column(c).to_numpy() for c in ("doc", "tie", "place"))
        before, after = t.column("before"), t.column("after")
        for part in np.split(alive, np.flatnonzero(np.diff(group[alive])) + 1):
            if not len(part):
                continue
            strings: dict[bytes, list[int]] = {}
            for i in part.tolist():
                a, z = int(left[i]), int(right[i])
                cut = before[i].as_py()[:a][::-1] + after[i].as_py()[:z]
                strings.setdefault(cut, []).append(i)
            found = repeated_in(list(strings), window)
            for (cut, rows), hit in zip(strings.items(), found):
                if len(rows) > 1:
                    hit = np.ones(len(cut) - window + 1, bool)
                turn = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
                for i in rows:
                    lo = int(places[i]) + len(before[i].as_py()) - int(left[i])
                    out += [(int(docs[i]), int(ties[i]), lo + a, z - a - 1) for a, z in turn.tolist()]
        if out:
            yield _table(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), _SHARED)


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(h, ctx, doc, place, span 0, tie) of every window of the leaders of each document."""
    for b in batches:
        for i in range(b.num_rows):
            data = np.frombuffer(unpack(b.column("blob")[i].as_py()), np.uint8)
            units = Units(data, np.array([0, len(data)]), False)
            leaders = b.column("leaders").slice(i, 1).flatten()
            start = np.concatenate([np.arange(a, z + 1) for a, z in zip(
                leaders.field("lo").to_pylist(), leaders.field("hi").to_pylist())])
            h, ctx = (Rolling(units.values, k).hash(start, start + window).view(np.int64) for k in (0, 1))
            for a in range(0, len(start), 50_000):
                s = start[a:a + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[a:a + 50_000]), pa.array(ctx[a:a + 50_000]),
                     pa.array(np.full(len(s), b.column("doc")[i].as_py(), np.int64)),
                     pa.array(s), pa.array(np.zeros(len(s), np.int32)),
                     pa.array(np.full(len(s), b.column("tie")[i].as_py(), np.int64))],
                    names=["h", "ctx", "doc", "place", "span", "tie"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
                     cell_contexts: int = CELL_CONTEXTS) -> DataFrame:
    """(doc, tie, place, span): ranges of windows of keyed documents that start at another place too."""
    seeds = mark(anchor_rows(docs, gram, window, False), "bytes")
    leaders = seeds.filter("first AND several").select("h", "doc", "tie", "place", "span", "copies").distinct()
    hot = leaders.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell_contexts).select(
        F.col("h").alias("hot_h"))
    flagged = leaders.join(hot, F.col("h") == F.col("hot_h"), "left").withColumn(
        "hot", F.col("hot_h").isNotNull()).drop("hot_h")
    lo = F.col("place")
    listed = flagged.select(
        "doc", "tie", "hot",
        F.struct("h", lo.alias("lo"), (lo + F.col("span").bitwiseAND(0xFFFF)).alias("hi"),
                 F.shiftright("span", 16).alias("anchor"), "copies").alias("l"))
    listed = listed.groupBy("doc", "tie").agg(
        F.collect_list(F.when(~F.col("hot"), F.col("l"))).alias("leaders"),
        F.collect_list(F.when(F.col("hot"), F.col("l"))).alias("hot_leaders"))
    opened = stage(with_spans(docs, listed, "inner", once=True).select("doc", "tie", "blob", "leaders", "hot_leaders"), "leaders")
    cells = (opened.select("doc", "tie", "blob", "leaders").mapInArrow(lambda b: _contexts(b, window), _CONTEXT)
             .repartition("h").sortWithinPartitions("h"))
    shared = cells.mapInArrow(lambda b: _shared_windows(b, window), _SHARED)
    rest = opened.filter(F.size("hot_leaders") > 0).select("doc", "tie", "blob", F.col("hot_leaders").alias("leaders"))
    windows = mark(rest.mapInArrow(lambda b: _windows(b, window), TIED), "hot-windows")
    again = lambda t: t.filter("repeated OR copies").select("doc", "tie", "place", "span")
    return again(seeds).unionByName(shared).unionByName(again(windows))


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            text = unpack(b.column("blob")[i].as_py())
            n, removed, spans, kept = len(text), 0, [], text
            if b.column("spans")[i].is_valid:
                one = b.column("spans").slice(i, 1).flatten()
                gone = covered(one.field(0).to_numpy(), one.field(1).to_numpy(), window, n)
                removed = int(gone.sum())
                spans = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))).reshape(-1, 2).tolist()
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((b.column("doc")[i].as_py(), n, removed, len(spans), spans, kept,
                         hashlib.sha256(kept).hexdigest()))
        if rows:
            yield _table(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())),
                                pa.binary(), pa.string()), _REMOVED)


_REMOVED = ("doc long, n_bytes long, n_removed long, n_spans long, spans array<array<long>>, kept binary, "
            "kept_sha256 string")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM, cell_contexts: int = CELL_CONTEXTS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, spans (byte ranges), kept (bytes), kept_sha256."""
    docs = keyed_documents(df, id_col, text_col)
    repeats = repeated_windows(docs, window, gram, cell_contexts)
    spans = gathered(repeats).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    out = with_spans(docs, spans, "left").select("doc", "tie", "blob", "spans").mapInArrow(
        lambda b: _remove(b, window), _REMOVED)
    return out.select(doc_id(F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "spans", "kept",
                      "kept_sha256")
