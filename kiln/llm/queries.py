"""Registered queries of the ten operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.llm import (align, ann, exact, langid, mixing, packing, pii, quality, simhash, substring, suffix, trie,
                      wrapper)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """A tokenizer file of the contracts, from the installed public files."""
    import public_tokenizers
    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(_table(spark, sf_dir, "documents"), shingle=4, max_bits=4)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_documents(_table(spark, sf_dir, "documents"))


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), window=200).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract_pages(_table(spark, sf_dir, "pages"))


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), amount=1.5, max_repeat=2.0)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_digest(_table(spark, sf_dir, "documents"))


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"), rule=trie.splice)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_ann, op2_simhash, op3_quality, op4_langid, op5_substring, op6_suffix, op7_wrapper, op8_exact, op9_mixing, op10_packing,
    op11_pii, op12_align, op13_trie)}

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    # runs at the scale of the correctness check; on larger tables the windows are too many for one process
    "op5_substring": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i,
                unnest(list_transform(range(1, len(ws) + 1), lambda p: CASE WHEN p + 19 <= len(ws) THEN
                       array_to_string(ws[p:p + 19], ' ') END)) AS win FROM w),
start AS (SELECT *, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM word),
cover AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) AS gone FROM start),
kept AS (SELECT doc_id, count(*) FILTER (gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t
         FROM cover GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""",
    "op6_suffix": r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
place AS (SELECT doc_id, unnest(range(1, octet_length(b) + 1)) AS i, b FROM d),
win AS (SELECT doc_id, i, CASE WHEN i + 199 <= octet_length(b) THEN md5(b[i:i + 199]) END AS h FROM place),
start AS (SELECT doc_id, i, h IS NOT NULL AND count(*) OVER (PARTITION BY h) > 1 AS again FROM win),
cover AS (SELECT doc_id, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS 199 PRECEDING) AS gone FROM start),
turn AS (SELECT *, gone IS DISTINCT FROM lag(gone) OVER (PARTITION BY doc_id ORDER BY i) AS new FROM cover),
run AS (SELECT *, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM turn),
span AS (SELECT doc_id, r, gone, min(i) AS a, max(i) AS z FROM run GROUP BY ALL),
total AS (SELECT doc_id, sum(z - a + 1) FILTER (gone) AS n, count(*) FILTER (gone) AS spans,
                 string_agg(hex(b[a:z]), '' ORDER BY a) FILTER (NOT gone) AS t
          FROM span JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(coalesce(t, ''))) AS kept_sha256
FROM d LEFT JOIN total USING (doc_id)
""",
    "op8_exact": f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM d WINDOW same AS (PARTITION BY norm)
""",
    # crc32 bit by bit: its state shifts right, a bit that differs from the lowest one brings the polynomial in
    "op13_trie": r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS txt, row_number() OVER (
                  PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, max(pos) AS n, flatten(list_transform(string_split(c::VARCHAR, ''), lambda s:
             list_transform(range(8), lambda i: (ascii(s) >> i) & 1))) AS bits FROM t GROUP BY c),
k AS (SELECT c, c - c % 100 AS donor, xor(4294967295, list_reduce(list_prepend(4294967295, bits), lambda s, b:
             xor(s >> 1, xor(s & 1, b) * 3988292384))) % 6 AS h FROM n),
f AS (SELECT k.*, least(h, coalesce(n.n, 0)) AS taken FROM k LEFT JOIN n ON n.c = k.donor),
r AS (SELECT f.c, pos AS d, role, txt FROM f JOIN t ON t.c = f.donor AND pos <= taken
      UNION ALL SELECT f.c, taken + pos - h, role, txt FROM f JOIN t USING (c) WHERE pos > h),
p AS (SELECT c, 0 AS d, '' AS path, 0 AS len FROM f
      UNION ALL SELECT c, d, string_agg(md5(length(role) || ':' || role || txt), '') OVER (PARTITION BY c ORDER BY d), length(txt)
      FROM r),
z AS (SELECT *, d = max(d) OVER (PARTITION BY c) AS last FROM p),
node AS (SELECT path, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n, any_value(len) AS len,
                string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last) AS ends FROM z GROUP BY path),
kid AS (SELECT left(path, length(path) - 32) AS path, count(*) AS kids FROM node WHERE depth > 0 GROUP BY 1),
up AS (SELECT node.*, kids, unnest(range(0, depth + 1)) AS lvl FROM node LEFT JOIN kid USING (path)),
total AS (SELECT left(path, 32 * lvl) AS path, count(*) FILTER (kids IS NULL) AS n_leaves, sum((n - 1) * len) AS saved
          FROM up GROUP BY 1)
SELECT node.conv_id, node.depth::BIGINT AS depth, above.conv_id AS parent_conv_id, node.n AS n_convs,
       coalesce(kids, 0) AS n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN total USING (path) LEFT JOIN kid USING (path)
LEFT JOIN node above ON node.depth > 0 AND above.path = left(node.path, length(node.path) - 32)
""",
}
