"""Best-fit-decreasing packing of token pieces into sequences of bounded length.

1. *Tokenise.* Each document becomes token ids (byte-level BPE file given by
   path) plus the end id; only documents longer than a sequence are cut, into
   full pieces counted from the end, so the first piece takes the remainder.
2. *Pack.* Pieces are packed best fit, longest first, over the whole table.
   Pieces of one length are interchangeable, so the packing depends only on how
   many pieces each length has: at most ``capacity`` numbers reach the driver.
   There a segment tree over remaining capacities (leaf r counts the open bins
   with r left) finds the tightest open bin that fits in logarithmic time; equal
   pieces going to equal bins are placed in one step, which gives exactly the
   bins that placing them one by one gives.
3. *Place.* The steps say for every length which ranks go to which bins and
   offsets; each piece gets its rank among its length by a two-level count
   (hash chunks of bounded size, then chunk totals) and looks its step up.

Defined cases: null text is empty and gives the end id alone; repeated rows are
packed once each; a null id is packed like any other; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import documents, stage

CAPACITY = 2048
END_ID = 0
CHUNK_ROWS = 50_000
#: Letters on whose class all Unicode versions agree, and the characters of plain texts.
LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
NOT_PLAIN = re.compile(f"[^\\t\\n\\r\\x20-\\x7E{LETTERS}¡«»¿–—‘’“”…]").search
#: Fixed value: the pre-tokenisation pattern of byte-level BPE, for plain texts.
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
MEMO_WORDS = 400_000


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's stand-in character of each byte: printable bytes stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes.

    The tokenizer encodes each pre-token on its own, so a plain text is split
    here and the ids of its pre-tokens are remembered (``MEMO_WORDS`` at most,
    then forgotten); a new pre-token goes to the tokenizer's BPE model. A text
    with other characters, or with an added token's string, goes to the
    tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.alphabet = _byte_alphabet()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _new(self, word: str) -> bytes:
        tokens = self.model.tokenize(word.encode().decode("latin-1").translate(self.alphabet))
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        return ids

    def encode(self, text: str) -> bytes:
        if NOT_PLAIN(text) or any(t in text for t in self.added):
            return self._whole(text)
        get, new = self.memo.get, self._new
        return b"".join([get(w) or new(w) for w in PIECES(text)])


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids with ``keep_ids``)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" * keep_ids)
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encoder.encode(text or "") + end
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    edges = [0, *range(min(first, n), n + 1, capacity)]
                    for k, (x, y) in enumerate(zip(edges, edges[1:])):
                        piece = ids[4 * x:4 * y]
                        rows.append((doc, k, x, y - x, zlib.crc32(piece),
                                     *([np.frombuffer(piece, "<u4").astype(np.int64)] if keep_ids else [])))
                if rows:
                    cols = list(zip(*rows))
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                     names=[x.split()[0] for x in schema.split(", ")])

    return documents(df, id_col, text_col).mapInArrow(cut, schema)


class CapacityTree:
    """Segment tree over capacities 0..capacity: which capacities have open bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, capacity: int, present: bool) -> None:
        i = self.size + capacity
        self.any[i] = present
        while i > 1:
            i //= 2
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now and self.any[i] != present:
                break
            self.any[i] = now

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that has an open bin."""
        i = self.size + need
        if self.any[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Placement steps (length, rank_from, rank_to, bin_from, per_bin, room).

    Ranks rank_from..rank_to-1 of that length go, ``per_bin`` to a bin, to the
    bins from ``bin_from`` on, which have ``room`` left before the step. Open
    bins are kept as ranges of consecutive bin numbers by room left.
    """
    tree, bins = CapacityTree(capacity), {}
    steps: list[tuple[int, int, int, int, int, int]] = []
    next_bin = 0

    def open_bins(room: int, first: int, n: int) -> None:
        if n > 0 and room > 0:
            bins.setdefault(room, []).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first = capacity, next_bin
                n = -(-left // (capacity // length))
                next_bin += n
            else:
                first, n = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    tree.set(room, False)
            per = room // length
            used = min(n, -(-left // per))
            placed = min(left, used * per)
            steps.append((length, rank, rank + placed, first, per, room))
            full = placed // per
            open_bins(room - per * length, first, full)
            if placed % per:
                open_bins(room - placed % per * length, first + full, 1)
            open_bins(room, first + used, n - used)
            rank, left = rank + placed, left - placed
    return steps


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (with ``length`` and a ``tie`` order within a length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in  # one row per length: at most ``capacity`` rows
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    steps = spark.sparkContext.broadcast(_by_length(best_fit_decreasing(counts, capacity)))
    # a length's rows are ranked in hash chunks of bounded size, then chunk totals give the offset
    sized = pieces.withColumn("__chunk", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(3)),
        F.ceil(F.get(F.array(*(F.lit(-(-counts.get(i, 0) // CHUNK_ROWS) or 1) for i in range(capacity + 1))),
                     F.col("length").cast("int")))))
    within = Window.partitionBy("length", "__chunk").orderBy("doc_id", "piece", "ids_crc32")
    totals = sized.groupBy(F.col("length").alias("__l"), F.col("__chunk").alias("__c")).agg(
        F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__l").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__l", "__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    ranked = (sized.withColumn("__rank", F.row_number().over(within) - 1)
              .join(totals, (F.col("length") == F.col("__l")) & (F.col("__chunk") == F.col("__c")))
              .withColumn("__rank", F.col("__rank") + F.col("__base")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        table = steps.value
        for i, (s, r) in enumerate(zip(length.tolist(), rank.tolist())):
            starts, rows = table[s]
            a, first, per, room = rows[bisect.bisect_right(starts, r) - 1]
            q, m = divmod(r - a, per)
            seq[i], off[i] = first + q, capacity - room + m * s
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    return (ranked.withColumn("__at", place("length", "__rank"))
            .select(*(F.col(f"`{c}`") for c in pieces.columns), "__at.sequence_id", "__at.offset"))


def _by_length(steps: list[tuple]) -> dict[int, tuple[list[int], list[tuple]]]:
    out: dict[int, tuple[list[int], list[tuple]]] = {}
    for length, a, _, first, per, room in steps:
        starts, rows = out.setdefault(length, ([], []))
        starts.append(a)
        rows.append((a, first, per, room))
    return out


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stage(token_pieces(df, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack_pieces(pieces, capacity)
