"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Each whole text becomes a row of document statistics. Standardised statistics go
through ``FEATURES`` random cosine features, which approximate a Gaussian kernel.
Every partition sums its normal equations (a matrix of fixed size, whatever the
number of rows), the sums are added in a tree of tasks, and the driver solves two
half-data ridge models and the full one. Scores that the half models give the
other half's rows are binned (fixed bins) and fitted by pool-adjacent-violators;
the full model's scores pass through that curve.

Defined cases: a null text is empty; empty texts have statistics (zeros) and are
scored like others; null and non-finite labels and null ids are not learned from; several labels
of one id count with their mean; with nothing to learn from every score is 0.5;
repeated rows are scored once each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import documents, each_text, stage, with_columns

FEATURES = 512
RIDGE = 1e-3
BINS = 2048
SEED = 17
CLIP = 6.0
FAN_IN = 32

_CLASS = np.full(256, 6, np.int64)  # 6: other symbols
for _chars, _kind in ((range(ord("a"), ord("z") + 1), 0), (range(0x80, 0x100), 0), (range(ord("A"), ord("Z") + 1), 1),
                      (b"0123456789", 2), (b" \t\r\x0b\x0c", 3), (b"\n", 4), (b".,;:'\"?!-()", 5)):
    _CLASS[list(_chars)] = _kind

_SENTENCE = re.compile(rb"[.!?][\"')]*$").search
_NO_LETTER = re.compile(rb"^[^A-Za-z\x80-\xff]+$").match
N_STATISTICS = 22


def statistics(text: bytes) -> list[float]:
    """Statistics of a whole UTF-8 text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * N_STATISTICS
    n, size = len(words), len(text)
    kinds = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=7) / size
    counts = Counter(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    top = sum(c for _, c in counts.most_common(3))
    repeats = sum(map(bytes.__eq__, words[1:], words))
    # what a word looks like needs asking once per distinct word
    shouted = ended = bare = 0
    for w, c in counts.items():
        if len(w) > 1 and w.isupper():
            shouted += c
        if _SENTENCE(w):
            ended += c
        if _NO_LETTER(w):
            bare += c
    lines = text.split(b"\n")
    distinct_lines = len(set(lines))
    symbol_tail = sum(c for w, c in counts.items() if len(w) > 2 and _CLASS[w[-1]] == 6 and _CLASS[w[-2]] == 6)
    return [np.log1p(n), np.log1p(size), *kinds.tolist(), float(lengths.mean()), float(lengths.std()),
            len(counts) / n, np.log1p(len(counts)), top / n, repeats / n, shouted / n, ended / n, bare / n,
            symbol_tail / n, np.log1p(len(lines)), distinct_lines / len(lines), text.count(b"!") / n]


def with_statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus ``__x``, the statistics of each text."""
    def column(cols: list[pa.Array]) -> list[pa.Array]:
        rows = [statistics(t) for t in each_text(cols[0])]
        return [pa.array(rows, pa.list_(pa.float64()))]

    return with_columns(df, [text_col], "__x array<double>", column, keep)


class FourierFeatures:
    """Standardisation and random cosine features; the last feature is the constant 1."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.std, -CLIP, CLIP)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return np.hstack([z, np.ones((len(x), 1))])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.flatten(), float).reshape(len(column), -1)


def _tree_sum(parts: DataFrame, n: int) -> np.ndarray | None:
    """The sum of float64 vectors held as binary rows (column ``v``), added in a tree of tasks."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_buffer())
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    # at most FAN_IN vectors of fixed length reach the driver
    got = parts.repartition(1).mapInArrow(add, "v binary").collect()
    return np.frombuffer(bytes(got[0]["v"])).copy() if got else None


def _normal_equations(train: DataFrame, features: FourierFeatures) -> np.ndarray | None:
    """Per half: X'X, X'y and rows, of the training rows (__x, y, half)."""
    d = FEATURES + 1

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d, d + 1))
        seen = False
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                p = b.slice(a, 2048)
                z, y = features(_matrix(p.column(0))), np.array(p.column(1), float)
                half = np.array(p.column(2))
                for h in (0, 1):
                    zh = z[half == h]
                    total[h, :, :d] += zh.T @ zh
                    total[h, :, d] += zh.T @ y[half == h]
                seen = seen or len(y) > 0
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    parts = train.select("__x", "y", "half").mapInArrow(part, "v binary")
    total = _tree_sum(parts, max(train.rdd.getNumPartitions(), 1))
    return None if total is None else total.reshape(2, d, d + 1)


def _solve(equations: np.ndarray) -> np.ndarray:
    d = len(equations)
    a = equations[:, :d] + RIDGE * max(equations[d - 1, d - 1], 1.0) * np.diag([1.0] * (d - 1) + [1e-6])
    return np.linalg.solve(a, equations[:, d])


def pool_adjacent_violators(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to y in weighted squares."""
    blocks: list[list[float]] = []
    for value, weight in zip(y.tolist(), w.tolist()):
        blocks.append([value, weight, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, k, n = blocks.pop()
            u, j, m = blocks[-1]
            blocks[-1] = [(u * j + v * k) / (j + k), j + k, m + n]
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


def _bin(raw: np.ndarray) -> np.ndarray:
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


class Calibration:
    """An isotonic curve through the bins that have rows; between bins it is linear.

    A thousandth of the raw score keeps the order of scores on flat parts.
    """

    def __init__(self, n: np.ndarray, positive: np.ndarray):
        has = np.flatnonzero(n)
        self.at = (has + 0.5) / BINS * 2 - 0.5
        self.value = pool_adjacent_violators(positive[has] / n[has], n[has])

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        fitted = np.interp(raw, self.at, self.value) if len(self.at) else np.full(len(raw), 0.5)
        return np.clip(0.999 * fitted + 0.001 * np.clip((raw + 0.5) / 2, 0, 1), 0, 1)


def held_out(id_col: str = "doc_id", folds: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % folds == rest, F.lit(False))


def fit(train: DataFrame) -> tuple[FourierFeatures, np.ndarray, Calibration] | None:
    """Model from rows (__x, y, half); None without rows."""
    columns = [F.col("__x")[i] for i in range(N_STATISTICS)]
    moments = train.agg(*(F.avg(c) for c in columns), *(F.stddev_pop(c) for c in columns)).first()
    if moments[0] is None:
        return None
    features = FourierFeatures(np.array(moments[:N_STATISTICS], float), np.array(moments[N_STATISTICS:], float))
    equations = _normal_equations(train, features)
    halves = [_solve(equations[0]), _solve(equations[1])]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BINS))
        for b in batches:
            if b.num_rows:
                z, y, half = features(_matrix(b.column(0))), np.array(b.column(1), float), np.array(b.column(2))
                at = _bin(np.where(half == 0, z @ halves[1], z @ halves[0]))
                n += [np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)]
        yield pa.RecordBatch.from_arrays([pa.array([n.tobytes()], pa.binary())], names=["v"])

    n = _tree_sum(train.select("__x", "y", "half").mapInArrow(binned, "v binary"),
                  max(train.rdd.getNumPartitions(), 1)).reshape(2, BINS)
    return features, _solve(equations.sum(axis=0)), Calibration(n[0], n[1])


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", folds: int = 3, rest: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = stage(with_statistics(documents(df, id_col, text_col), "text", ["doc_id"]), "statistics")
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("l_id"), F.col(f"`{label_col}`").cast("double").alias("y")
                          ).filter(F.col("l_id").isNotNull() & (F.abs("y") < float("inf"))).groupBy("l_id").agg(F.avg("y").alias("y"))
    train = stage(rows.filter(~held_out("doc_id", folds, rest)).join(marks, F.col("doc_id") == F.col("l_id"))
                  .select("__x", "y", F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(2)).cast("int").alias("half")),
                  "quality-train")
    model = fit(train)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def column(cols: list[pa.Array]) -> list[pa.Array]:
        n = len(cols[0])
        if shared.value is None:
            return [pa.array([0.5] * n, pa.float64())]
        features, weights, calibrated = shared.value
        x = _matrix(cols[0])
        raw = np.concatenate([features(x[a:a + 2048]) @ weights for a in range(0, n, 2048)])
        return [pa.array(calibrated(raw))]

    return with_columns(rows, ["__x"], "score double", column, ["doc_id"]).select(
        "doc_id", held_out("doc_id", folds, rest).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
