"""Prefix trie of conversations with subtree totals by time-forward processing.

1. *Order.* Turns are range-partitioned and sorted by (conversation, turn, role,
   text); the text stays behind as a 128-bit digest and its length. A
   conversation's turns are numbered from counts per (conversation, range
   partition), so one that holds a third of all rows spans many tasks.
2. *Splice* (optional): the first turns of a conversation are those of another.
3. *Nodes.* A prefix is identified by the XOR of 128-bit hashes of (depth, turn
   digest) over its turns, a running XOR in chunks of ``CHUNK_TURNS`` turns. Nodes
   are grouped counts of equal prefixes; a node belongs to its smallest member.
4. *Chains.* A run of nodes with the same members is one chain, so a conversation
   has as many chains as others branch off it, however many turns it has.
5. *Time-forward processing.* Chains with fewer than ``heavy`` members form whole
   subtrees below the others; those are the shards. A shard's chains are sorted
   externally by reverse level order; each reads the messages that its children
   left for it in a priority queue, which spills sorted runs to disk, and leaves its
   own totals for its parent. The totals of shard roots, added up per parent, go
   through the same pass over the heavy chains, of which there are at most
   2 / ``heavy`` times as many as conversations.

Defined cases: rows without conversation id take no part; turns come null first,
equal turns by role, then text; null role or text is empty; a fully repeated row
is one more turn; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import stage

CHUNK_TURNS = 4096
HEAVY = 1000
#: Messages that a priority queue holds in memory before it spills a sorted run.
QUEUE_MESSAGES = 200_000
#: Characters of role and text in the range key; within a partition whole texts are sorted.
KEY_CHARS = 32
#: Bytes of joined ids in one piece of an ends list.
ENDS_BYTES = 1 << 16


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _before(by: list[str], order: str) -> Window:
    return Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """Staged rows c, part, seq, g1, g2, n_code: turns in order of (part, seq), texts as digests."""
    rows = df.select(F.col(f"`{conv}`").cast("long").alias("c"), F.col(f"`{turn}`").alias("turn"),
                     F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                     F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).filter("c IS NOT NULL")
    key = [F.col("c"), F.col("turn").asc_nulls_first(), F.substring("role", 1, KEY_CHARS), F.substring("text", 1, KEY_CHARS)]
    rows = rows.repartitionByRange(_parts(df), *key).sortWithinPartitions(
        "c", F.col("turn").asc_nulls_first(), "role", "text")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return stage(rows.select(
        "c", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"),
        F.substring(said, 1, 32).alias("g1"), F.substring(said, 33, 32).alias("g2"),
        F.length("text").cast("long").alias("n_code")), "turns")


def splice(conv: Column, group: int = 100, kinds: int = 6) -> tuple[Column, Column, int]:
    """(donor, h, largest h): a conversation takes its first h turns from the donor, as the dealt contract says."""
    return conv - conv % F.lit(group), F.crc32(conv.cast("string")) % F.lit(kinds), kinds - 1


def spliced_turns(turns: DataFrame, rule=splice) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after the splice; without a rule every conversation keeps its own turns.

    turns: c, d (from 1), g1, g2, n_code, last; conversations: c, length.
    """
    spans = turns.groupBy("c", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    spans = spans.withColumn("base", F.coalesce(F.sum("n").over(_before(["c"], "part")), F.lit(0)))
    convs = spans.groupBy("c").agg(F.sum("n").alias("n"))
    if rule is None:
        convs = convs.withColumns({"donor": F.col("c"), "h": F.lit(0).cast("long"), "taken": F.lit(0).cast("long")})
    else:
        donor, h, most = rule(F.col("c"))
        have = convs.select(F.col("c").alias("donor"), F.col("n").alias("donor_n"))
        convs = convs.withColumns({"donor": donor, "h": h}).join(have, "donor", "left").withColumn(
            "taken", F.least("h", F.coalesce("donor_n", F.lit(0))))
    convs = convs.select("c", "donor", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    placed = (turns.join(spans.join(convs, "c").select("c", "part", "first", "base", "h", "taken", "length"), ["c", "part"])
              .withColumn("pos", F.col("seq") - F.col("first") + F.col("base") + 1))
    own = placed.filter("pos > h").select("c", (F.col("taken") + F.col("pos") - F.col("h")).alias("d"),
                                          "g1", "g2", "n_code", "length")
    if rule is not None:
        given = placed.filter(F.col("pos") <= most).select(F.col("c").alias("donor"), F.col("pos").alias("d"), "g1", "g2", "n_code")
        own = own.unionByName(convs.select("c", "donor", "taken", "length").join(given, "donor").filter("d <= taken")
                              .select("c", "d", "g1", "g2", "n_code", "length"))
    return (own.withColumn("last", F.col("d") == F.col("length")).drop("length"), convs.select("c", "length"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """c, d, f1, f2 (of the first d turns), n_code, last."""
    by = ["c", "chunk"]
    rows = turns.withColumn("chunk", F.floor(F.col("d") / CHUNK_TURNS)).withColumns(
        {"x1": F.xxhash64("d", "g1", "g2"), "x2": F.xxhash64("g2", "d", "g1")})
    totals = rows.groupBy(*by).agg(F.bit_xor("x1").alias("t1"), F.bit_xor("x2").alias("t2"))
    up_to = Window.partitionBy(*by).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    totals = totals.select(*by, *(F.coalesce(F.bit_xor(t).over(_before(["c"], "chunk")), zero).alias(o)
                                  for t, o in (("t1", "o1"), ("t2", "o2")))).filter("chunk > 0")
    rows = rows.withColumns({f: F.bit_xor(x).over(up_to) for f, x in (("f1", "x1"), ("f2", "x2"))}).join(totals, by, "left")
    return rows.select("c", "d", *(F.col(f).bitwiseXOR(F.coalesce(o, zero)).alias(f) for f, o in (("f1", "o1"), ("f2", "o2"))),
                       "n_code", "last")


class SpillingQueue:
    """Priority queue of messages (key, children, leaves, saved); beyond ``limit`` a sorted run goes to a file.

    Keys only ever come out in growing order, so runs are merged by their heads.
    """

    def __init__(self, limit: int = QUEUE_MESSAGES):
        self.limit, self.heap, self.runs = limit, [], []

    def push(self, message: tuple) -> None:
        heapq.heappush(self.heap, message)
        if len(self.heap) > self.limit:
            out = tempfile.TemporaryFile()  # scratch of this task alone
            while self.heap:
                pickle.dump(heapq.heappop(self.heap), out)
            out.seek(0)
            self._advance(out)

    def _advance(self, run) -> None:
        try:
            heapq.heappush(self.runs, (pickle.load(run), id(run), run))
        except EOFError:
            run.close()

    def pop_all(self, key: tuple) -> tuple[int, int, int]:
        """The sums of all messages for ``key``."""
        children = leaves = saved = 0
        while True:
            if self.heap and self.heap[0][0] == key:
                m = heapq.heappop(self.heap)
            elif self.runs and self.runs[0][0][0] == key:
                m, _, run = heapq.heappop(self.runs)
                self._advance(run)
            else:
                return children, leaves, saved
            children, leaves, saved = children + m[1], leaves + m[2], saved + m[3]


_TOTALS = "c long, n long, children long, leaves long, below long, pc long, pn long, total long"


def _time_forward(limit: int):
    """Chains in reverse level order -> their totals; ``pc`` is set where the parent lies outside the shard.

    Input: c, n, top, bottom, own, pc, pn, inside, and children, leaves, below from outside.
    """
    names = [x.split()[0] for x in _TOTALS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = SpillingQueue(limit)
        for b in batches:
            out = []
            for c, n, top, bottom, own, pc, pn, inside, children, leaves, below in zip(*(x.to_pylist() for x in b.columns)):
                k, le, s = queue.pop_all((-bottom, c, n))
                k, le, s = k + children, le + leaves, s + below
                le = le if k else 1
                if inside:
                    queue.push(((1 - top, pc, pn), 1, le, s + own))
                    pc = None
                out.append((c, n, k, le, s, pc, pn, s + own))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=names)

    return run


def _chain_totals(chains: DataFrame, heavy: int, limit: int) -> DataFrame:
    """c, n, children, leaves, below (saved by the nodes under the chain) of every chain."""
    spark, zero = chains.sparkSession, F.lit(0).cast("long")
    order = [F.col("bottom").desc(), "c", "n"]
    cols = ["c", "n", "top", "bottom", "own", "pc", "pn", "inside", "children", "leaves", "below"]
    light = chains.filter(F.col("n") < heavy).withColumns(
        {"inside": F.coalesce(F.col("pn") < heavy, F.lit(False)), "children": zero, "leaves": zero, "below": zero})
    light = stage(light.repartition(_parts(chains), "root").sortWithinPartitions(*order).select(*cols)
                  .mapInArrow(_time_forward(limit), _TOTALS), "shards")
    sent = light.filter("pc IS NOT NULL").groupBy(F.col("pc").alias("c"), F.col("pn").alias("n")).agg(
        F.count(F.lit(1)).alias("children"), F.sum("leaves").alias("leaves"), F.sum("total").alias("below"))
    top = chains.filter(F.col("n") >= heavy).join(sent, ["c", "n"], "left").withColumn("inside", F.col("pc").isNotNull())
    top = top.fillna(0, ["children", "leaves", "below"])
    # one task, since every chain waits for all below: at most 2 / heavy as many rows as conversations
    top = top.repartition(1).sortWithinPartitions(*order).select(*cols).mapInArrow(_time_forward(limit), _TOTALS)
    return light.unionByName(stage(top, "roots")).select("c", "n", "children", "leaves", "below")


def _ends(rows: DataFrame) -> DataFrame:
    """own, d, ends_sha256 over the ids ``c`` of rows (own, d, c): joined piecewise, hashed in a stream."""
    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, held, size = None, None, [], 0
        out: list[tuple] = []
        for b in batches:
            for own, d, c in zip(*(x.to_pylist() for x in b.columns)):
                if (own, d) != key or size > ENDS_BYTES:
                    if held:
                        out.append((*key, first, ",".join(held)))
                    key, first, held, size = (own, d), c, [], 0
                held.append(str(c))
                size += len(held[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["own", "d", "first", "ids"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, first, ",".join(held))], names=["own", "d", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h = None, None
        out: list[tuple] = []
        for b in batches:
            for own, d, _, ids in zip(*(x.to_pylist() for x in b.columns)):
                if (own, d) != key:
                    if h:
                        out.append((*key, h.hexdigest()))
                    key, h = (own, d), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["own", "d", "ends_sha256"])
                out = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, h.hexdigest())], names=["own", "d", "ends_sha256"])

    n = _parts(rows)
    pieces = (rows.select("own", "d", "c").repartitionByRange(n, "own", "d", "c").sortWithinPartitions("own", "d", "c")
              .mapInArrow(join_ids, "own long, d long, first long, ids string"))
    return (pieces.repartition(n, "own", "d").sortWithinPartitions("own", "d", "first")
            .mapInArrow(digest, "own long, d long, ends_sha256 string"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                rule=None, heavy: int = HEAVY, queue_messages: int = QUEUE_MESSAGES) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = spliced_turns(ordered_turns(df, conv, turn, role, text), rule)
    zero = F.lit(0).cast("long")
    rows = stage(_prefixes(turns), "prefixes")
    # written, so that a node with many members, which has as many rows here, meets them in a join that AQE can split
    nodes = stage(rows.groupBy("d", "f1", "f2").agg(F.min("c").alias("own"), F.count(F.lit(1)).alias("n")), "nodes")
    below = rows.join(nodes.hint("merge"), ["d", "f1", "f2"]).select("c", "d", F.col("f1").alias("f"), "own", "n", "n_code", "last")
    top = convs.agg(F.min("c").alias("own"), F.count(F.lit(1)).alias("n")).first()  # the root has all conversations
    root = convs.select("c", zero.alias("d"), zero.alias("f"), F.lit(top["own"]).cast("long").alias("own"),
                        F.lit(top["n"]).cast("long").alias("n"), zero.alias("n_code"), (F.col("length") == 0).alias("last"))
    rows = stage(below.unionByName(root), "members")
    # per conversation: where its path leaves the nodes of smaller owners, and the heavy nodes
    paths = rows.groupBy("c").agg(
        F.max(F.when(F.col("own") < F.col("c"), F.struct("d", "own", "n"))).alias("hang"),
        F.min(F.when(F.col("n") < heavy, F.struct("d", "f"))).alias("root"))
    mine = rows.filter("own = c").select("c", "d", "n", ((F.col("n") - 1) * F.col("n_code")).alias("own"))
    chains = mine.groupBy("c", "n").agg(F.min("d").alias("top"), F.max("d").alias("bottom"), F.sum("own").alias("own"))
    above = chains.select("c", (F.col("bottom") + 1).alias("top"), F.col("n").alias("above"))
    chains = stage(chains.join(above, ["c", "top"], "left").join(paths, "c").select(
        "c", "n", "top", "bottom", "own",
        F.when(F.col("above").isNotNull(), F.col("c")).otherwise(F.col("hang.own")).alias("pc"),
        F.coalesce("above", "hang.n").alias("pn"), "root"), "chains")
    totals = chains.select("c", "n", "top", "bottom", "pc").join(_chain_totals(chains, heavy, queue_messages), ["c", "n"])
    # what the deeper nodes of the same chain save: by chunks of depths, then within the chunk
    by = ["c", "n", "chunk"]
    mine = mine.withColumn("chunk", F.floor(F.col("d") / CHUNK_TURNS))
    later = Window.partitionBy("c", "n").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    chunks = mine.groupBy(*by).agg(F.sum("own").alias("t")).select(
        *by, F.coalesce(F.sum("t").over(later), zero).alias("later"))
    deeper = Window.partitionBy(*by).orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = mine.withColumn("here", F.sum("own").over(deeper)).join(chunks.join(totals, ["c", "n"]), by)
    ends = _ends(rows.filter("last").select("own", "d", "c")).select(
        F.col("own").alias("c"), "d", "ends_sha256")
    return found.join(ends, ["c", "d"], "left").select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"),
        F.when(F.col("d") > F.col("top"), F.col("c")).otherwise(F.col("pc")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("d") < F.col("bottom"), F.lit(1).cast("long")).otherwise(F.col("children")).alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("here") + F.col("later") + F.col("below")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
