"""Approximate nearest neighbours by query-aware collision counting.

Vectors are dealt into blocks of bounded size, and every block is indexed whole:
``projections`` random lines, each with the block's projected values in a sorted
array. A query is projected on the same lines and puts a window around its own
value on each. Windows start at ``width`` and grow by virtual rehashing
(``ratio`` times wider each round); a vector in the windows of at least a
``threshold`` share of the lines is a candidate and is verified by its exact distance. Until
the first candidate windows grow by ``first_ratio``. A block
stops for a query when the k-th verified distance is within the radius that the
windows stand for, or when its vectors are all verified. No round is cut short,
so vectors at equal distance are found together.

Queries are sent to every block in bounded batches; each block returns at most k
rows per query, and a grouped top-k merges them. Blocks hold ``BLOCK_ROWS`` vectors on
average, whatever the cluster, so the same table gives the same neighbours everywhere.
Many lines, a high threshold and slowly growing windows keep the vectors that are
verified few even where near and far ones differ by a fifth in distance.

Nearness is the Euclidean distance in double precision on the stored vectors;
ties go to the smaller id.

Defined cases: rows with a null id, and vectors that are null, empty, zero or hold
a null or non-finite component, take no part; queries meet vectors of their own
length only; exact repeats of a row count once; an id that has several vectors is
a candidate with each, and queries with the smallest; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import runs_of, stage

BLOCK_ROWS = 16_384
PROJECTIONS = 192
RATIO = 1.04
FIRST_RATIO = 1.2
THRESHOLD = 0.77
MARGIN = 0.03
START_SHARE = 0.7
QUERY_BATCH = 1_024
SEED = 29


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                      F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
            .filter(F.col("vec_id").isNotNull() & v.isNotNull())
            .filter(finite & F.exists(v, lambda x: x != 0.0)))


class BlockIndex:
    """Sorted projection arrays over one block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projections: int, seed: int):
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (vectors[1:] != vectors[:-1]).any(axis=1)
        self.ids, self.vectors = ids[fresh], vectors[fresh]
        rng = np.random.default_rng([seed, vectors.shape[1]])
        self.lines = rng.normal(size=(projections, vectors.shape[1]))
        values = self.vectors @ self.lines.T
        self.order = np.argsort(values, axis=0, kind="stable").astype(np.intp).T.copy()
        self.values = np.take_along_axis(values, self.order.T, axis=0).T.copy()
        self.spread = float(np.median(values.std(axis=0))) or 1.0
        self.met = self.verified = 0  # vectors in all searches so far, and those of them that were verified

    def search(self, query_id: int, query: np.ndarray, k: int, threshold: float, ratio: float
               ) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of at most k nearest found, nearest first."""
        n, m = len(self.ids), len(self.lines)
        need = math.ceil(threshold * m)
        own = self.lines @ query
        hits = np.zeros(n, np.intp)
        lo = [int(self.values[j].searchsorted(own[j])) for j in range(m)]
        hi = list(lo)
        verified = np.zeros(n, bool)
        ids, dist = np.zeros(0, np.int64), np.zeros(0)
        half = START_SHARE * self.spread
        ends = np.empty(2)
        while True:
            parts = []
            for j, (values, order, at) in enumerate(zip(self.values, self.order, own.tolist())):
                ends[:] = at - half, at + half
                a, b = values.searchsorted(ends).tolist()  # a value on an edge has chance zero
                parts += [order[a:lo[j]], order[hi[j]:b]]
                lo[j], hi[j] = min(a, lo[j]), max(b, hi[j])
            hits += np.bincount(np.concatenate(parts), minlength=n)
            new = np.flatnonzero((hits >= need) & ~verified)
            verified[new] = True
            new = new[self.ids[new] != query_id]
            if len(new):
                d = np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))
                ids, dist = np.concatenate([ids, self.ids[new]]), np.concatenate([dist, d])
                best = np.lexsort((ids, dist))[:k]
                ids, dist = ids[best], dist[best]
            # a vector at distance r falls within half of a line with the normal's chance for half / r
            if (len(ids) == k and dist[-1] * _reach(threshold) <= half) or verified.all():
                self.met, self.verified = self.met + n, self.verified + int(verified.sum())
                return ids, dist
            half *= ratio if len(ids) else FIRST_RATIO


def _reach(threshold: float) -> float:
    """The |z| that a standard normal stays below with the chance ``threshold + MARGIN``."""
    return NormalDist().inv_cdf(0.5 + min(0.98, threshold + MARGIN) / 2)


def _search_blocks(batches: Iterator[pa.RecordBatch], k: int, projections: int, threshold: float, ratio: float,
                   seed: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (dim, block, is_query): a block's vectors, then its queries in batches."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    index: BlockIndex | None = None
    now = None
    for b in batches:
        dim, block, query = (b.column(c).to_numpy(zero_copy_only=False) for c in ("dim", "block", "is_query"))
        cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (block[1:] != block[:-1]) | (query[1:] != query[:-1])) + 1
        for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if a == z:
                continue
            part = b.slice(a, z - a)
            ids = part.column("vec_id").to_numpy()
            vectors = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            if (dim[a], block[a]) != now:
                now, held, index = (dim[a], block[a]), [], None
            if not query[a]:
                held.append((ids, vectors))
                continue
            if index is None:
                if not held:
                    continue
                index = BlockIndex(*(np.concatenate(x) for x in zip(*held)), projections, seed)
                held = []
            for s in range(0, len(ids), QUERY_BATCH):
                q, v, d = [], [], []
                for i, x in zip(ids[s:s + QUERY_BATCH].tolist(), vectors[s:s + QUERY_BATCH]):
                    got, dist = index.search(i, x, k, threshold, ratio)
                    q.append(np.full(len(got), i, np.int64))
                    v.append(got)
                    d.append(dist)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (q, v, d)],
                                                 names=["query_id", "vec_id", "score"])


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id",
                       vector_col: str = "embedding", projections: int = PROJECTIONS, threshold: float = THRESHOLD,
                       ratio: float = RATIO, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """The k nearest found of every row of ``df`` for which ``is_query`` (over vec_id) holds.

    Returns query_id, rank (from 1), vec_id, score.
    """
    rows = stage(usable(df, id_col, vector_col).withColumn("dim", F.size("vector")), "vectors")
    blocks = F.broadcast(rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(  # one row per vector length
        F.col("dim").alias("b_dim"), F.ceil(F.col("n") / block_rows).cast("int").alias("blocks")))
    dealt = rows.join(blocks, F.col("dim") == F.col("b_dim"))
    own = F.pmod(F.xxhash64("vec_id", F.lit(31)), F.col("blocks")).cast("int")
    vectors = dealt.select("dim", own.alias("block"), F.lit(0).alias("is_query"), "vec_id", "vector")
    asked = rows.filter(is_query).groupBy("dim", "vec_id").agg(F.min("vector").alias("vector")).join(
        blocks, F.col("dim") == F.col("b_dim"))
    queries = asked.select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                           F.lit(1).alias("is_query"), "vec_id", "vector")
    # by range: blocks spread evenly over tasks, where hashes of a few block numbers would collide
    found = (vectors.unionByName(queries).repartitionByRange("dim", "block")
             .sortWithinPartitions("dim", "block", "is_query")
             .mapInArrow(lambda b: _search_blocks(b, k, projections, threshold, ratio, seed),
                         "query_id long, vec_id long, score double"))
    return top_k(found, k)


def top_k(found: DataFrame, k: int) -> DataFrame:
    """Per query the k best rows by (score, vec_id), each vec_id once.

    The collected list holds at most k rows per block of the query.
    """
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    lists = best.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "vec_id"))), 1, k)
                                         .alias("best"))
    return lists.select("query_id", F.posexplode("best").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
