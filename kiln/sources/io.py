"""Sources, sinks and stage checkpoints (SRC-*, SNK-*, CHK-*).

Stages are write-once Parquet directories under one root (a shared folder on
a cluster): ``raw`` -> ``cleaned`` -> ``feature_engineered`` ->
``feature_selected``. A later stage reads only its required predecessor and
never silently falls back to an earlier one. Reports are small DataFrames
written as JSON next to the stage.
"""

from __future__ import annotations

import csv
import hashlib
import json
from collections import Counter
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.exprs import col
from kiln.operators.stats import nan_to_null
from kiln.session import delete_path, staged

STAGES = ("raw", "cleaned", "feature_engineered", "feature_selected")
STAGE_LABELS = {
    "raw": "Raw upload",
    "cleaned": "Cleaned dataset",
    "feature_engineered": "Feature-engineered dataset",
    "feature_selected": "Feature-selected dataset",
}


class SourceError(Exception):
    """A table could not be read; the message says why."""


class PipelineStateError(Exception):
    """A required checkpoint is missing; the message names the missing stage."""


# --------------------------------------------------------------------- SRC-1
#: Type lattice of CSV columns, narrowest first: a column has the first type whose test all its values pass.
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
_LATTICE = (("int", r"^[+-]?[0-9]{1,10}$"), ("bigint", r"^[+-]?[0-9]{1,19}$"),
            ("double", r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|NaN|[+-]?Infinity)$"),
            ("date", _ISO_DATE), ("timestamp", f"({_ISO_DATE})|({_ISO_TIME})"), ("boolean", "^(?i:true|false)$"))


def _typed(c: Column, kind: str) -> Column:
    """A text as a type of the lattice, null where it does not pass."""
    test = dict(_LATTICE).get(kind)
    return F.when(c.rlike(test), c).try_cast(kind) if test else c


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               encoding: str = "UTF-8", nan_as_null: bool = True, schema: str | None = None) -> DataFrame:
    """Read Parquet (default) or CSV with header and inferred types.

    A CSV file is scanned once: its records are staged as text below the shared
    folder, and the same write counts, per column, the values that pass each type of
    the lattice, broken records and undecodable text (Spark puts U+FFFD for it). Columns
    are then cast from the staged table. ``schema`` (DDL) gives the types instead.
    Records whose number of fields is not the header's, bytes that the encoding cannot
    decode and values that are not of a given type raise an error that names line and
    column, as an empty file does. NaN becomes null unless ``nan_as_null`` is off.
    """
    fmt = fmt or ("csv" if path.lower().endswith(".csv") else "parquet")
    try:
        if fmt == "csv":
            df = _read_csv(spark, path, encoding, schema)
        elif fmt == "parquet":
            df = spark.read.parquet(path)
        else:
            df = spark.read.format(fmt).load(path)
    except SourceError:
        raise
    except Exception as exc:  # noqa: BLE001 - translate reader errors
        raise SourceError(f"Could not read {fmt} table at {path}: {exc}") from exc
    df = dedup_column_names(df)
    return nan_to_null(df) if nan_as_null else df


def _read_csv(spark: SparkSession, path: str, encoding: str, schema: str | None) -> DataFrame:
    first = spark.read.option("encoding", encoding).text(path).limit(1).collect()  # the header line only
    if not first or not first[0][0].strip():
        raise SourceError("The CSV file is empty.")
    header = [h.strip() for h in next(csv.reader([first[0][0]]))]
    wanted = T._parse_datatype_string(schema).fields if schema else None
    if wanted is not None and len(wanted) != len(header):
        raise SourceError(f"The schema has {len(wanted)} columns, the file's header {len(header)}.")
    names = [f.name for f in wanted] if wanted is not None else unique_names(header)
    at = [f"v{i}" for i in range(len(names))]
    texts = T.StructType([T.StructField(c, T.StringType()) for c in (*at, "broken")])
    rows = (spark.read.schema(texts).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "broken").option("encoding", encoding).csv(path))
    bad = lambda c: F.col(c).contains("\ufffd")
    aggs = [F.count("broken").alias("broken"), F.min("broken").alias("record")]
    for i, c in enumerate(at):
        aggs += [F.count(c).alias(f"n{i}"), F.count_if(bad(c)).alias(f"u{i}")]
        if wanted is None:
            aggs += [F.count(_typed(F.col(c), k)).alias(f"{k}{i}") for k, _ in _LATTICE]
        else:
            fails = F.when(F.col(c).try_cast(wanted[i].dataType).isNull(), F.col(c))
            aggs += [F.count(fails).alias(f"f{i}"), F.min(fails).alias(f"m{i}")]
    seen = Observation()
    out = staged(rows.observe(seen, *aggs), "csv")
    facts = seen.get
    if facts["broken"]:
        record = facts["record"]
        fields = len(next(csv.reader([record]), []))
        last = header[min(fields, len(header)) - 1]
        raise SourceError(f"Line {_line(spark, path, encoding, F.col('value') == record)}, column {last!r}: the record has "
                          f"{fields} fields, the header {len(header)}.")
    for i, c in enumerate(header):
        if facts[f"u{i}"]:
            line = _line(spark, path, encoding, ~F.is_valid_utf8("value") | F.col("value").contains("\ufffd"))
            raise SourceError(f"Line {line}, column {c!r}: bytes that are not {encoding}.")
        if wanted is not None and facts[f"f{i}"]:
            value = facts[f"m{i}"]
            line = _line(spark, path, encoding, F.col("value").contains(value))
            raise SourceError(f"Line {line}, column {c!r}: {value!r} is not {wanted[i].dataType.simpleString()}.")
    if wanted is not None:
        return out.select(*[F.col(c).try_cast(f.dataType).alias(f.name) for c, f in zip(at, wanted)])
    kinds = [next((k for k, _ in _LATTICE if facts[f"n{i}"] and facts[f"{k}{i}"] == facts[f"n{i}"]), "string")
             for i in range(len(at))]
    return out.select(*[_typed(F.col(c), k).alias(n) for c, k, n in zip(at, kinds, names)])


def _line(spark: SparkSession, path: str, encoding: str, wrong: Column) -> int:
    """Number (from 1) of the first line for which ``wrong`` (over ``value``) holds; only errors ask for it."""
    lines = spark.read.option("encoding", encoding).text(path).select(
        "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    hit = lines.where(wrong).agg(F.min(F.struct("id", "part")).alias("h")).first()["h"]
    if hit is None:
        return 0
    return lines.where((F.col("part") <= hit["part"]) & (F.col("id") <= hit["id"])).count()


# --------------------------------------------------------------------- SRC-2
def unique_names(names: list[str]) -> list[str]:
    """The k-th repeat of ``x`` becomes ``x__dup{k}`` (first keeps its name)."""
    seen: Counter[str] = Counter()
    taken = set(names)
    out = []
    for n in names:
        seen[n] += 1
        if seen[n] == 1:
            out.append(n)
            continue
        k = seen[n] - 1
        cand = f"{n}__dup{k}"
        while cand in taken:
            k += 1
            cand = f"{n}__dup{k}"
        taken.add(cand)
        out.append(cand)
    return out


def dedup_column_names(df: DataFrame) -> DataFrame:
    names = unique_names([str(c) for c in df.columns])
    return df if names == df.columns else df.toDF(*names)


# --------------------------------------------------------------------- SRC-3
def preview(df: DataFrame, n: int = 10, key: str | list[str] | None = None) -> DataFrame:
    """First ``n`` rows (by key when given, so the preview is deterministic)."""
    if key:
        keys = [key] if isinstance(key, str) else list(key)
        df = df.orderBy(*[col(k) for k in keys])
    return df.limit(n)


# ---------------------------------------------------------------- SNK-1/CHK
def stage_path(root: str, stage: str) -> str:
    if stage not in STAGES:
        raise ValueError(f"unknown stage {stage!r}; expected one of {STAGES}")
    return f"{root.rstrip('/')}/{stage}"


def _exists(spark: SparkSession, path: str, mark: str = "/_SUCCESS") -> bool:
    fs, p = _fs(spark, path + mark)
    return bool(fs.exists(p))


@dataclass(frozen=True)
class Manifest:
    """What a stage was made of and what it holds; written after the stage, so a stage without one is not whole."""
    stage: str
    plan: str           # hash of the step and its parameters
    input_hash: str     # content hash of the stage before
    rows: int
    content_hash: str
    kept_hash: str      # content hash of the columns that the step had to leave alone
    columns: list[str]
    files: str          # names and lengths of the stage's files


def write_stage(df: DataFrame, root: str, stage: str, csv_copy: bool = False, plan: str = "", input_hash: str = "",
                keep: list[str] | None = None) -> str:
    """Write a checkpoint once; an existing checkpoint is an error, never overwritten.

    The write itself observes row count and content hashes for the manifest: no other scan.
    """
    path, spark = stage_path(root, stage), df.sparkSession
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), content_hash(df.columns).alias("all"),
               content_hash(keep or []).alias("kept")).write.mode("errorifexists").parquet(path)
    got = seen.get
    manifest = Manifest(stage, plan, input_hash, int(got["rows"]), str(got["all"]), str(got["kept"]), df.columns,
                        _files(spark, path))
    _write_text(spark, _manifest_path(root, stage), json.dumps(asdict(manifest)))
    if csv_copy:
        df.write.mode("errorifexists").option("header", True).csv(path + "_csv")
    return path


def read_manifest(spark: SparkSession, root: str, stage: str) -> Manifest | None:
    """The manifest of a stage that is whole and whose files are as they were written, else None."""
    if not _exists(spark, stage_path(root, stage)) or not _exists(spark, _manifest_path(root, stage), ""):
        return None
    text = spark.read.text(_manifest_path(root, stage), wholetext=True).first()[0]
    manifest = Manifest(**json.loads(text))
    return manifest if manifest.files == _files(spark, stage_path(root, stage)) else None


def drop_stage(spark: SparkSession, root: str, stage: str) -> None:
    for path in (_manifest_path(root, stage), stage_path(root, stage)):
        delete_path(spark, path)


def _manifest_path(root: str, stage: str) -> str:
    return f"{root.rstrip('/')}/manifests/{stage}.json"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _files(spark: SparkSession, path: str) -> str:
    """Hash of the names and lengths of a folder's files."""
    fs, p = _fs(spark, path)
    found = sorted((f.getPath().getName(), f.getLen()) for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", ".")))
    return hashlib.sha256(json.dumps(found).encode()).hexdigest()


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    """Read a required checkpoint; the error names the missing prior stage."""
    path = stage_path(root, stage)
    if not _exists(spark, path):
        idx = STAGES.index(stage)
        prior = STAGES[idx - 1] if idx > 0 else None
        hint = f" Run the step that produces it (after '{prior}')." if prior else ""
        raise PipelineStateError(f"Required checkpoint '{stage}' is missing at {path}.{hint}")
    return spark.read.parquet(path)


def pipeline_status(spark: SparkSession, root: str) -> DataFrame:
    """One row per stage: whether its checkpoint exists and where; marks the current stage."""
    rows = []
    present = [s for s in STAGES if _exists(spark, stage_path(root, s))]
    current = present[-1] if present else None
    for s in STAGES:
        rows.append((s, STAGE_LABELS[s], s in present, stage_path(root, s), s == current))
    schema = "stage string, label string, available boolean, path string, is_current boolean"
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------- SNK-2
def write_report(report: DataFrame, root: str, name: str) -> str:
    path = f"{root.rstrip('/')}/reports/{name}"
    report.coalesce(1).write.mode("errorifexists").json(path)
    return path


def drop_report(spark: SparkSession, root: str, name: str | None) -> None:
    if name is not None:
        delete_path(spark, f"{root.rstrip('/')}/reports/{name}")


def read_report(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{root.rstrip('/')}/reports/{name}")


# --------------------------------------------------------------------- CHK-3
def frame_fingerprint(df: DataFrame) -> DataFrame:
    """Row count, column list and an order-insensitive content hash.

    ``sum(xxhash64(row))`` over decimals does not depend on row order or
    partitioning, so it proves that an operator left its input unchanged. A
    flag per column goes into the hash, since it skips nulls.
    """
    return df.agg(F.count(F.lit(1)).alias("rows"), content_hash(df.columns).cast("string").alias("content_hash")) \
             .select("rows", F.lit(",".join(df.columns)).alias("columns"), "content_hash")


def content_hash(columns: list[str]) -> Column:
    """The aggregate behind ``frame_fingerprint``, over some columns."""
    parts = [x for c in columns for x in (col(c).isNull(), col(c))]
    return F.sum(F.xxhash64(*parts).cast("decimal(38,0)") if parts else F.lit(0).cast("decimal(38,0)"))
