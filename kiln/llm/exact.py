"""Exact deduplication by content sort.

Texts are normalised (null as empty, ASCII A-Z lower-cased), range-partitioned
with splitters Spark samples from the data, and sorted externally inside each
partition, so equal texts are neighbours. Each partition compares neighbouring
texts in full and closes runs of equal texts. The range key is the first
``PREFIX`` characters, a 64-bit hash of the rest of the order and the id:
splitters stay short however long texts are, and a text that fills a third of the
table is spread over many partitions. Only runs whose prefix and hash are those
of a partition's first or last row can continue next door; those (two per
partition, but for hash collisions) are merged by SHA-256.

Defined cases: null text equals the empty text; a null id sorts before every
other id and stays only when the whole group has none; of repeated rows with the
same id and text exactly one stays; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import documents, keep_keys, stage, text_bytes, with_columns


#: Characters of the text in the range key.
PREFIX = 64


def _normalise(cols: list[pa.Array]) -> list[pa.Array]:
    return [pc.ascii_lower(pc.fill_null(cols[0], ""))]


def content_sorted(df: DataFrame, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """``df`` (its columns ``keep``) plus ``__norm`` and ``__hash``, ranged and sorted by content and id."""
    normed = with_columns(df, [text_col], "__norm string", _normalise, keep)
    normed = normed.withColumn("__hash", F.xxhash64("__norm"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    content, last = [F.substring("__norm", 1, PREFIX), F.col("__hash")], F.col(id_col).asc_nulls_first()
    return normed.repartitionByRange(n, *content, last).sortWithinPartitions(*content, "__norm", last)


def _sha(text: pa.Array, i: int) -> str:
    data, off = text_bytes(text.slice(i, 1))
    return hashlib.sha256(data[off[0]:off[1]]).hexdigest()


class _Run:
    """An open run of equal texts: its text, and the ids and text hashes of its rows so far."""

    def __init__(self, norm: pa.Array, at: int, key: int):
        self.text, self.sha, self.key = norm[at], _sha(norm, at), key
        self.ids: list[pa.Array] = []
        self.ties: list[pa.Array] = []


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Run]:
    """Runs of equal neighbouring texts in order."""
    run: _Run | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        norm, ids, ties, hashes = (b.column(c) for c in ("__norm", "doc_id", "__tie", "__hash"))
        same = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        starts = [0, *(np.flatnonzero(~same) + 1).tolist()]
        for a, z in zip(starts, [*starts[1:], n]):
            if run is None or a or norm[0] != run.text:
                if run is not None:
                    yield run
                run = _Run(norm, a, hashes[a].as_py())
            run.ids.append(ids.slice(a, z - a))
            run.ties.append(ties.slice(a, z - a))
    if run is not None:
        yield run


def _closed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Run, bool]]:
    """Runs in order, each with whether its hash is that of the partition's first or last run."""
    held: list[_Run] = []
    first = None
    for run in _runs(batches):
        first = run.key if first is None else first
        if held and held[0].key != run.key:
            yield from ((r, r.key == first) for r in held)
            held = []
        held.append(run)
    yield from ((r, True) for r in held)


_ROWS = "doc_id long, __tie long, text_sha256 string, run long, last_in_run boolean, run_size long, run_max long, edge boolean"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())


def _facts(run: _Run, no: int, edge: bool) -> tuple:
    """(sha, run number, size, largest id, edge) of a closed run."""
    return (run.sha, (TaskContext.get().partitionId() << 40) | no, sum(map(len, run.ids)),
            run.ids[-1][-1].as_py(), edge)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _ROWS.split(", ")]
    ids: list[pa.Array] = []
    ties: list[pa.Array] = []
    facts: list[tuple] = []

    def flush() -> pa.RecordBatch:
        sha, no, size, most, edge = (list(x) for x in zip(*facts))
        of = pa.array(np.repeat(np.arange(len(facts)), size))
        last = np.zeros(len(of), bool)
        last[np.cumsum(size) - 1] = True
        each = [pa.array(v, t).take(of) for v, t in zip((sha, no, size, most, edge), (*_TYPES[2:4], *_TYPES[5:]))]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(ties), *each[:2], pa.array(last), *each[2:]], names=names)

    for no, (run, edge) in enumerate(_closed_runs(batches)):
        ids += run.ids
        ties += run.ties
        facts.append(_facts(run, no, edge))
        if sum(map(len, run.ids)) + len(facts) > 10_000:
            yield flush()
            ids, ties, facts = [], [], []
    if facts:
        yield flush()


def _edge_groups(rows: DataFrame) -> DataFrame:
    """One row per text among the runs that may continue next door: two per partition, but for collisions."""
    heads = rows.filter("edge AND last_in_run")
    return heads.groupBy(F.col("text_sha256").alias("e_sha")).agg(
        F.sum("run_size").alias("e_size"), F.max("run_max").alias("e_max"),
        F.max(F.struct(F.col("run_max").alias("m"), F.col("run").alias("r"))).getField("r").alias("e_run"))


def _decisions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per document: doc_id, __tie, keep_id, group_size, kept, text_sha256."""
    docs = documents(df, id_col, text_col).withColumn("__tie", F.xxhash64("text"))
    rows = stage(content_sorted(docs, "doc_id", "text", ["doc_id", "__tie"]).mapInArrow(_report, _ROWS), "exact")
    merged = rows.join(F.broadcast(_edge_groups(rows)),  # about two rows per partition
                       F.col("edge") & (F.col("text_sha256") == F.col("e_sha")), "left")
    return merged.select(
        "doc_id", "__tie", F.coalesce("e_max", "run_max").alias("keep_id"),
        F.coalesce("e_size", "run_size").alias("group_size"),
        (F.col("last_in_run") & F.coalesce(F.col("run") == F.col("e_run"), F.lit(True))).alias("kept"),
        "text_sha256")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return _decisions(df, id_col, text_col).drop("__tie")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns: the largest id of each text."""
    kept = _decisions(df, id_col, text_col).filter("kept").select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__doc"), "__tie")
    return keep_keys(df, kept, id_col, text_col)
