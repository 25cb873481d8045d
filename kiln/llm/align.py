"""Alignment of two tokenizers' tokens by merge-path partitioning.

1. *Encode.* Texts of a task are gathered into chunks of ``CHUNK_BYTES``; A (byte-level
   BPE) encodes space + text, B (pieces with byte fallback) the text. The end
   offsets of both token sequences are sorted arrays over the chunk's bytes.
2. *Merge path.* Binary searches on the diagonals i + j = w, 2w, ... of the A/B merge
   give the cut points of independent pieces of ``work`` ends each, wherever
   documents begin and however long one is. A piece finds the ends that both sides
   share and emits the overlaps of the groups between them; the part before its first
   shared end is stitched to what the pieces before it left open.
3. *Count.* A chunk keeps its distinct id pairs with the number of documents that hold
   them; the sums over all chunks are the corpus-wide counts, and the highest per A id
   comes from a window over at most B's vocabulary.
4. *Score.* The counts travel back per chunk and pair, and each chunk's documents add
   them up over their links.

Links of a group are counted by distinct id pair and number, so a long group of few
different ids stays small. Memory: about 100 bytes per token of a chunk, or of the
longest text.

Defined cases: null, empty, and texts that a tokenizer does not give back byte for
byte have no tokens: zeros and an empty digest. Repeated rows count as documents of
their own; a null id is aligned like any other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import documents, stage
from kiln.llm.packing import Encoder

#: Text bytes and rows of a chunk.
CHUNK_BYTES = 4 << 20
CHUNK_ROWS = 20_000
#: Token ends of a merge-path piece.
WORK = 1 << 16
#: Links of a group from which its ids are counted before they are paired.
LARGE_GROUP = 1 << 12
#: Words up to this length are remembered, at most MEMO_WORDS of them.
MEMO_LENGTH = 64
MEMO_WORDS = 300_000
SEGMENTS = re.compile(" +[^ ]*").findall


class ByteTokens(Encoder):
    """Ids of byte-level BPE tokens, with special tokens' strings as plain text; None if bytes are lost."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = []
        byte_of = {c: b for b, c in self.alphabet.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.ok = True

    def _same(self, ids: bytes, text: str) -> None:
        self.ok &= b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()]) == text.encode()

    def _whole(self, text: str) -> bytes:
        ids = super()._whole(text)
        self._same(ids, text)
        return ids

    def _new(self, word: str) -> bytes:
        ids = super()._new(word)
        self._same(ids, word)
        if not self.ok:
            del self.memo[word]  # so that the next text with it is found out too
        return ids

    def tokens(self, text: str) -> bytes | None:
        self.ok = True
        ids = self.encode(" " + text)
        return ids if self.ok else None


class PieceTokens:
    """Ids of sentence pieces; no piece spans the place before a space, so words are encoded on their own."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        fallback = re.compile("<0x([0-9A-F]{2})>").fullmatch
        self.bytes_of = [bytes([int(m[1], 16)]) if (m := fallback(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.split = not any(re.search("[^▁]▁", p) for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.memo: dict[str, bytes | None] = {}

    def _ids(self, text: str) -> bytes | None:
        """Of a text that starts with the space that the model adds."""
        ids = self.model.encode(text[1:], num_threads=1) if len(text) > 1 else [self.space]
        same = b"".join([self.bytes_of[i] for i in ids]) == text.encode()
        return np.asarray(ids, "<u4").tobytes() if same else None

    def _word(self, word: str) -> bytes | None:
        if len(word) > MEMO_LENGTH:
            return self._ids(word)
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        self.memo[word] = ids = self._ids(word)
        return ids

    def tokens(self, text: str) -> bytes | None:
        if not self.split:
            return self._ids(" " + text)
        get, new = self.memo.get, self._word
        ids = [get(w) or new(w) for w in SEGMENTS(" " + text)]
        return None if None in ids else b"".join(ids)


@lru_cache(maxsize=1)
def _tokenizers(path_a: str, path_b: str) -> tuple[ByteTokens, PieceTokens, np.ndarray, np.ndarray]:
    a, b = ByteTokens(path_a), PieceTokens(path_b)
    return a, b, *(np.array([len(x) for x in t.bytes_of], np.int64) for t in (a, b))


def merge_path(a: np.ndarray, b: np.ndarray, work: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut points (i, j) of the merge of two increasing arrays, ``work`` elements apart; equal elements stay together."""
    n, m = len(a), len(b)
    diagonal = np.arange(work, n + m, work)
    low, high = np.maximum(0, diagonal - m), np.minimum(diagonal, n)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        more = open_ & (a[np.minimum(mid, n - 1)] <= b[np.clip(diagonal - mid - 1, 0, m - 1)])
        low, high = np.where(more, mid + 1, low), np.where(open_ & ~more, mid, high)
    i, j = low, diagonal - low
    if n and m:
        j = j + ((i > 0) & (j < m) & (a[np.maximum(i, 1) - 1] == b[np.minimum(j, m - 1)]))
    return np.concatenate([[0], i, [n]]), np.concatenate([[0], j, [m]])


def group_ends(a: np.ndarray, b: np.ndarray, work: int = WORK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per piece: how many A and B tokens lie up to each end that both sides share."""
    cuts = list(zip(*merge_path(a, b, work)))
    for (i, j), (k, l) in zip(cuts, cuts[1:]):
        x, y = a[i:k], b[j:l]
        if len(x) and len(y):
            at = np.searchsorted(y, x)
            hit = y[np.minimum(at, len(y) - 1)] == x
            yield i + np.flatnonzero(hit) + 1, j + at[hit] + 1


def _pairs(ids_a: np.ndarray, ids_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, doc: np.ndarray,
           size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """(document << 32 | id pair, number) of the links of groups that start at ga[:-1], gb[:-1]; pairs may repeat."""
    na, nb = np.diff(ga), np.diff(gb)
    links = na * nb
    keys, counts = [], []
    small = links <= LARGE_GROUP
    for g in np.flatnonzero(~small).tolist():
        (x, cx), (y, cy) = (np.unique(v, return_counts=True) for v in (ids_a[ga[g]:ga[g + 1]], ids_b[gb[g]:gb[g + 1]]))
        keys.append((doc[g] << 32 | x[:, None] * size_b + y).ravel())
        counts.append(np.outer(cx, cy).ravel())
    n = links[small]
    g = np.repeat(np.flatnonzero(small), n)
    k = np.arange(len(g)) - np.repeat(np.cumsum(n) - n, n)
    q, r = np.divmod(k, nb[g])
    keys.append(doc[g] << 32 | ids_a[ga[g] + q] * size_b + ids_b[gb[g] + r])
    counts.append(np.ones(len(g), np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def _sum_equal(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Digits:
    """Decimal text of ids with a delimiter after each, built for a whole chunk at once."""

    def __init__(self, size: int):
        text = [str(i).encode() for i in range(size)]
        self.length = np.array([len(t) for t in text])
        self.width = int(self.length.max()) + 1
        self.table = np.frombuffer(b"".join(t.ljust(self.width, b"\0") for t in text), np.uint8).reshape(size, self.width)

    def join(self, ids: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each id's text starts, and the end)."""
        out, n = self.table[ids], self.length[ids]
        out[np.arange(len(ids)), n] = after
        flat = out.ravel()
        return flat[flat != 0], np.concatenate([[0], np.cumsum(n + 1)])


@lru_cache(maxsize=1)
def _digits(size: int) -> Digits:
    return Digits(size)


def _groups_text(ids_a, ids_b, ga, gb, starts_a, starts_b, size) -> list[str]:
    """SHA-256 of each document's groups as text; starts are token positions of documents, with the total."""
    na, nb = np.diff(ga), np.diff(gb)
    total = len(ids_a) + len(ids_b)
    ids, after = np.empty(total, np.int64), np.full(total, ord(","), np.uint8)
    ids[np.arange(len(ids_a)) + np.repeat(gb[:-1], na)] = ids_a
    ids[np.arange(len(ids_b)) + np.repeat(ga[1:], nb)] = ids_b
    after[ga[1:] + gb[:-1] - 1], after[ga[1:] + gb[1:] - 1] = ord("|"), ord(";")
    text, at = _digits(size).join(ids, after)
    edge = at[np.asarray(starts_a) + np.asarray(starts_b)].tolist()
    return [hashlib.sha256(text[x:y - 1]).hexdigest() for x, y in zip(edge, edge[1:])]


_CHUNK = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pair_at array<int>, links array<int>, pairs array<long>, docs array<int>")
_TYPES = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]


def _align_chunk(chunk: int, docs: list, a: list[bytes], b: list[bytes], len_a, len_b, work: int) -> pa.RecordBatch:
    """One row per document and a last one with the chunk's distinct pairs and their document counts."""
    ids_a, ids_b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
    n_a, n_b = (np.array([len(x) // 4 for x in y], np.int64) for y in (a, b))
    starts_a, starts_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
    size_b = len(len_b)
    if len(len_a) * size_b >= 1 << 32:
        raise ValueError("the vocabularies have more than 2^32 id pairs")
    keys, counts, parts_a, parts_b = [], [], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    for ga, gb in group_ends(np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b]), work):
        if not len(ga):
            continue
        # stitched: the piece's first group begins where the last shared end was
        ga, gb = np.concatenate([parts_a[-1][-1:], ga]), np.concatenate([parts_b[-1][-1:], gb])
        doc = np.searchsorted(starts_a, ga[:-1], side="right") - 1
        k, c = _sum_equal(*_pairs(ids_a, ids_b, ga, gb, doc, size_b))
        keys.append(k), counts.append(c)
        parts_a.append(ga[1:]), parts_b.append(gb[1:])
    ga, gb = np.concatenate(parts_a), np.concatenate(parts_b)
    sha = _groups_text(ids_a, ids_b, ga, gb, starts_a, starts_b, max(len(len_a), size_b)) if len(ids_a) else [""] * len(docs)
    sha = [s if n else "" for s, n in zip(sha, n_a.tolist())]
    key, links = _sum_equal(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts)))
    doc, pair = key >> 32, key & 0xFFFFFFFF
    pairs, at, held = np.unique(pair, return_inverse=True, return_counts=True)
    edges = np.searchsorted(doc, np.arange(len(docs) + 1))
    offsets = np.concatenate([edges, edges[-1:]]).astype(np.int32)
    groups = np.diff(np.searchsorted(ga[1:], starts_a, side="right"))
    sums = np.concatenate([[0], np.cumsum(links)])
    n_links = sums[edges[1:]] - sums[edges[:-1]]
    none = [None] * len(docs)
    cols = [pa.array([chunk] * (len(docs) + 1), pa.int64())]
    cols += [pa.array([*x, None], pa.int64()) for x in (docs, n_a.tolist(), n_b.tolist(), groups.tolist(), n_links.tolist())]
    cols += [pa.array([*sha, None], pa.string())]
    cols += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.astype(np.int32))) for x in (at, links)]
    cols += [pa.array([*none, pairs], _TYPES[9]), pa.array([*none, held.astype(np.int32)], _TYPES[10])]
    return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, _TYPES)], names=[x.split()[0] for x in _CHUNK.split(", ")])


def aligned_chunks(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                   work: int = WORK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows of documents with their links, and one row per chunk (``pairs`` not null) with its id pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok_a, tok_b, len_a, len_b = _tokenizers(path_a, path_b)
        chunk = TaskContext.get().partitionId() << 40
        docs, a, b, size = [], [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py() or ""
                x = tok_a.tokens(text) if text else None
                y = tok_b.tokens(text) if x is not None else None
                if y is None:
                    x = y = b""
                docs.append(batch.column(0)[i].as_py())
                a.append(x)
                b.append(y)
                size += len(text)
                if size > chunk_bytes or len(docs) >= CHUNK_ROWS:
                    yield _align_chunk(chunk, docs, a, b, len_a, len_b, work)
                    chunk, docs, a, b, size = chunk + 1, [], [], [], 0
        if docs:
            yield _align_chunk(chunk, docs, a, b, len_a, len_b, work)

    return documents(df, id_col, text_col).mapInArrow(run, _CHUNK)


def pair_counts(chunks: DataFrame, size_b: int) -> DataFrame:
    """pair (A id * size_b + B id), n (documents that hold it linked), best (n is its A id's highest)."""
    held = chunks.filter("pairs IS NOT NULL").select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    of_a = Window.partitionBy(F.expr(f"pair div {size_b}"))  # at most size_b rows
    return counts.withColumn("best", F.col("n") == F.max("n").over(of_a))


_SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Add a chunk's counts (in order of ``at``) up over its documents' links."""
    order = np.argsort(pairs.column("at").to_numpy())
    n, best = (pairs.column(c).to_numpy()[order].astype(np.int64) for c in ("n", "best"))
    at, links = (docs.column(c).combine_chunks() for c in ("pair_at", "links"))
    size = np.diff(at.offsets.to_numpy())
    i, k = at.flatten().to_numpy().astype(np.int64), links.flatten().to_numpy().astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(v)]) for v in (best[i] * k, n[i] * k)] if len(i) else [np.zeros(1, np.int64)] * 2
    edge = np.concatenate([[0], np.cumsum(size)])
    each = [pa.array(s[edge[1:]] - s[edge[:-1]]) for s in sums]
    cols = [docs.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    return pa.table([*cols, *each, docs.column("groups_sha256")], names=[x.split()[0] for x in _SCORED.split(", ")])


def align_documents(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text",
                    work: int = WORK, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    size_b = len(_tokenizers(path_a, path_b)[3])
    chunks = stage(aligned_chunks(df, path_a, path_b, id_col, text_col, work, chunk_bytes), "aligned")
    counts = pair_counts(chunks, size_b)
    held = chunks.filter("pairs IS NOT NULL").select(F.col("chunk").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    back = held.join(counts, "pair").select("of", "at", "n", "best")
    docs = chunks.filter("pairs IS NULL").drop("pairs", "docs")
    return docs.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(_score, _SCORED)
