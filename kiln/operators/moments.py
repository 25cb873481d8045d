"""Pairwise moments of many numeric columns by blocks of columns.

Columns are cut into blocks of ``BLOCK``. One scan per block multiplies its value and
presence matrices with those of all columns from that block on, so a task holds
6 x BLOCK x k numbers however many columns there are, and up to BLOCK columns need
one scan. The partial sums are added in a tree of tasks before one of them reaches
the driver, which turns each strip into correlations at once and keeps no moments.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.operators.stats import numeric_view

FAN_IN = 16
BLOCK = 256


class Strip:
    """Moments of the pairs of a block of columns with all columns from the block's first on.

    Sums are over the rows where both columns of a pair are present; ``at`` is the
    block's first column.
    """

    def __init__(self, at: int, sums: np.ndarray):
        self.at = at
        self.n, self.x, self.y, self.xx, self.yy, self.xy = sums

    def variances(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the block's column and of the other one."""
        with np.errstate(invalid="ignore", divide="ignore"):
            return (np.maximum(self.xx / self.n - (self.x / self.n) ** 2, 0.0),
                    np.maximum(self.yy / self.n - (self.y / self.n) ** 2, 0.0))

    def correlation(self) -> np.ndarray:
        a, b = self.variances()
        with np.errstate(invalid="ignore", divide="ignore"):
            r = (self.xy / self.n - (self.x / self.n) * (self.y / self.n)) / np.sqrt(a * b)
        return np.where((a > 0) & (b > 0), r, np.nan)


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        for v in b.column(0):
            x = np.frombuffer(v.as_buffer())
            total = x.copy() if total is None else total + x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])


def pair_moments(df: DataFrame, names: list[str], complete: bool = False, block: int = BLOCK) -> Iterator[Strip]:
    """The strips of all pairs; with ``complete`` only over rows where every column is present. None without rows."""
    k = len(names)
    view = df.select(*[numeric_view(df, n).alias(f"c{i}") for i, n in enumerate(names)])
    if complete:
        view = view.dropna()
    # values are shifted by the columns' means, which keeps squares of large numbers apart
    means = view.agg(*[F.avg(c) for c in view.columns]).first()
    shift = np.array([m if m is not None else 0.0 for m in means], float)
    n = max(1, view.rdd.getNumPartitions())
    for at in range(0, k, block):
        got = _tree_sum(view.select(*view.columns[at:]).mapInArrow(_partial(shift[at:], min(block, k - at)), "v binary"), n)
        if got is not None:
            yield Strip(at, got.reshape(6, min(block, k - at), k - at))


def _partial(shift: np.ndarray, width: int):
    """Sums of one task: the first ``width`` columns against all."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, width, len(shift)))
        seen = False
        for b in batches:
            if not b.num_rows:
                continue
            seen = True
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(float) - shift
            there = ~np.isnan(x)
            x = np.where(there, x, 0.0)
            p, q, own, here = there.astype(float), x * x, x[:, :width].T, there[:, :width].T.astype(float)
            total += [here @ p, own @ p, here @ x, q[:, :width].T @ p, here @ q, own @ x]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return part


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_sum, "v binary")
    got = parts.repartition(1).mapInArrow(_sum, "v binary").collect()  # one row of fixed size
    return np.frombuffer(bytes(got[0]["v"])) if got else None
