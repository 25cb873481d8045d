"""Session helpers.

The library never creates its own cluster settings behind the caller's back: it
reads what the session already has and only fills gaps (tests, local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "kiln") -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, no UI)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("KILN_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every operator relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    value = sc.getConf().get("spark.checkpoint.dir", None)
    if not value:
        try:
            value = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            value = None
    return value or None


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's checkpoint folder; a local session without one (tests) gets a temporary folder."""
    value = checkpoint_dir(spark)
    if not value:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        value = tempfile.mkdtemp(prefix="kiln-ckpt-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(value)
    return value


@dataclass
class _Scope:
    """What ``staged`` made inside a ``scratch`` block."""
    write: bool
    paths: list[str] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)


_SCOPES: ContextVar[tuple[_Scope, ...]] = ContextVar("kiln_scratch", default=())


@contextmanager
def scratch(spark: SparkSession, write: bool = True) -> Iterator[None]:
    """Tables staged inside the block are gone after it; results that read them must be written inside.

    With ``write=False`` (dry runs) nothing is written at all: staged tables are blocks
    that Spark keeps on the executors' disks, and computes again if one is lost.
    """
    scope = _Scope(write)
    token = _SCOPES.set((*_SCOPES.get(), scope))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for df in scope.kept:
            df.unpersist()
        for path in scope.paths:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder below a shared root, through the file system that Spark uses for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back: cuts the lineage, computes it once.

    Inside a ``scratch`` block the innermost one says what becomes of the table.
    """
    spark = df.sparkSession
    scopes = _SCOPES.get()
    if scopes and not all(s.write for s in scopes):
        df = df.persist(StorageLevel.DISK_ONLY)
        scopes[-1].kept.append(df)
        return df
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/kiln-{label}-{uuid.uuid4().hex}"
    if scopes:
        scopes[-1].paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
