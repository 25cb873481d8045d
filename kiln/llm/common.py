"""Shared plumbing: staged tables in the cluster's shared folder, Arrow text access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="kiln-llm-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of replaying the
    plan, and what is used more than once is computed once.
    """
    path = f"{shared_root(df.sparkSession)}/kiln-llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_columns(df: DataFrame, inputs: list[str], added: str,
                 fn: Callable[[list[pa.Array]], list[pa.Array]], keep: list[str] | None = None) -> DataFrame:
    """Append the columns named in the DDL ``added``; ``fn`` maps input arrays to output arrays.

    All rows and the columns ``keep`` (default: all) of ``df`` pass through in
    Arrow batches; ``added`` names must be new (callers use their own prefix).
    """
    new = T._parse_datatype_string(added)
    names = df.columns if keep is None else keep
    schema = T.StructType([*(df.schema[c] for c in names), *new.fields])
    at, passed = [df.columns.index(c) for c in inputs], [df.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn([b.column(i) for i in at])
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in passed), *out], names=schema.names)

    return df.mapInArrow(run, schema)


def text_bytes(arr: pa.Array) -> tuple[memoryview, np.ndarray]:
    """UTF-8 bytes of a string column and its offsets; null counts as empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    if len(arr) == 0:
        return memoryview(b""), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    offsets = np.frombuffer(off, width)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)
    return memoryview(data) if data is not None else memoryview(b""), offsets


def each_text(arr: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    data, off = text_bytes(arr)
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        yield bytes(data[a:b])


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Regroup key-sorted batches so that no run of equal keys is cut.

    Holds one batch and the open run; callers bound the length of a run.
    """
    rest: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if rest and all(b.column(k)[0] == rest[-1].column(k)[0] == b.column(k)[-1] for k in keys):
            rest.append(b)
            continue
        t = pa.Table.from_batches([*rest, b]).combine_chunks()
        change = change_points(t, keys)
        cut = int(change[-1])
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks().to_batches()
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def change_points(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a run of equal keys starts (0 included); keys hold no nulls."""
    n = t.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        c = t.column(k)
        v = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        if pa.types.is_integer(v.type):
            a = v.to_numpy(zero_copy_only=False)
            new[1:] |= a[1:] != a[:-1]
        else:
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """(__doc, __tie): a row's id (null as the smallest number) and a hash of its text."""
    return (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("__doc"),
            F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("__tie"))


def keep_keys(df: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose key is in ``keys`` (__doc, __tie), one of each key.

    Rows travel once: the window that drops fully repeated rows uses the join's partitions.
    """
    k = keys.select(F.col("__doc").alias("__k_doc"), F.col("__tie").alias("__k_tie")).distinct()
    doc, tie = row_key(id_col, text_col)
    rows = df.withColumns({"__doc": doc, "__tie": tie}).join(
        k.hint("merge"), (F.col("__doc") == F.col("__k_doc")) & (F.col("__tie") == F.col("__k_tie")), "left_semi")
    one = F.row_number().over(Window.partitionBy("__doc", "__tie").orderBy(F.lit(1)))
    return rows.withColumn("__one", one).filter("__one = 1").select(*(F.col(f"`{c}`") for c in df.columns))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, under fixed names, so that other columns cannot clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.col(f"`{text_col}`").cast("string").alias("text"))
