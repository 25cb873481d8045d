"""Substring deduplication of word sequences by seed and extend.

*Seeds.* Every window of ``window`` words has one winnowed anchor (see
``anchors``); documents meet on equal anchors.

*Extend.* An occurrence of an anchor carries the hash of its context: the anchor
extended both ways over all windows it stands for. Occurrences with the same
context agree on all of it: all but the earliest are repeats. Where an anchor has
several contexts, the first occurrence of each is extended window by window: its
windows go through the same walk as anchors did, with a 128-bit hash of their
words, and all but the earliest of equal windows are repeats. Every occurrence
costs a bounded number of rows, so a passage shared by g documents costs g rows,
not g squared pairs.

*Maximal repeats.* Overlapping and touching repeated windows of a document unite to
maximal spans, which are removed.

Earlier means smaller id, or the same document and an earlier start. Equality is
that of 128 hash bits (64 for the context within equal 64-bit anchors).

Defined cases: a null text has no words; a null id counts as smaller than all
others; of rows with the same id but different texts each is a document and, at the
same start, the one with the smaller text hash comes earlier; fully repeated rows
are one document and get the same result each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.anchors import (TIED, Rolling, Units, anchor_rows, covered, doc_id, gathered, keyed_documents, mark,
                              unpack, with_spans)

WINDOW = 20
GRAM = 5

_SPANS = "lo", "hi"


def _span_list(groups) -> DataFrame:
    return groups.agg(F.sort_array(F.collect_list(F.struct(*_SPANS))).alias("spans"))


def _bounds(spans: pa.Array, i: int) -> tuple[np.ndarray, np.ndarray]:
    one = spans.slice(i, 1).flatten()
    return one.field(0).to_numpy(), one.field(1).to_numpy()


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(h, ctx, doc, place, span 0, tie) of every window in the spans of each document."""
    for b in batches:
        out: list[list[np.ndarray]] = []
        for i in range(b.num_rows):
            data = np.frombuffer(unpack(b.column("blob")[i].as_py()), np.uint8)
            units = Units(data, np.array([0, len(data)]), True)
            lo, hi = _bounds(b.column("spans"), i)
            start = np.concatenate([np.arange(a, z + 1) for a, z in zip(lo.tolist(), hi.tolist())])
            h, ctx = (Rolling(units.values, k).hash(start, start + window).view(np.int64) for k in (0, 1))
            out.append([h, ctx, np.full(len(start), b.column("doc")[i].as_py(), np.int64),
                        start, np.zeros(len(start), np.int32), np.full(len(start), b.column("tie")[i].as_py(), np.int64)])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)],
                                             names=["h", "ctx", "doc", "place", "span", "tie"])


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, tie, place, span): ranges of windows of keyed documents that also start earlier."""
    seeds = mark(anchor_rows(docs, gram, window, True), "seeds")
    leaders = seeds.filter("first AND several").select("doc", "tie", "place", "span").distinct()
    extended = with_spans(docs, _span_list(gathered(leaders)), "inner").select("doc", "tie", "blob", "spans")
    windows = mark(extended.mapInArrow(lambda b: _windows(b, window), TIED), "windows")
    repeats = lambda t: t.filter("repeated").select("doc", "tie", "place", "span")
    return repeats(seeds).unionByName(repeats(windows))


def _remove(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            words = unpack(b.column("blob")[i].as_py()).split()
            n, removed, spans = len(words), 0, []
            if b.column("spans")[i].is_valid:
                gone = covered(*_bounds(b.column("spans"), i), window, n)
                removed = int(gone.sum())
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = turn.reshape(-1, 2).tolist()
                words = [w for w, g in zip(words, gone.tolist()) if not g]
            rows.append((b.column("doc")[i].as_py(), n, removed, spans, b" ".join(words)))
        if rows:
            doc, n, removed, spans, kept = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array([k.decode() for k in kept], pa.string()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                names=["doc", "n_words", "n_removed", "spans", "kept", "kept_sha256"])


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word ranges removed), kept (text), kept_sha256."""
    docs = keyed_documents(df, id_col, text_col)
    spans = _span_list(gathered(repeated_windows(docs, window, gram)))
    out = with_spans(docs, spans, "left").select("doc", "tie", "blob", "spans").mapInArrow(
        lambda b: _remove(b, window), "doc long, n_words long, n_removed long, spans array<array<long>>, kept string, "
                                      "kept_sha256 string")
    return out.select(doc_id(F.col("doc")).alias("doc_id"), "n_words", "n_removed", "spans", "kept", "kept_sha256")
