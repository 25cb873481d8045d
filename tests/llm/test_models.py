"""Nearest neighbours, quality, language ID."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import ann, langid, quality
from tests.llm.conftest import SCHEMA, row


def brute_knn(ids, vectors, k):
    out = {}
    for q in sorted(i for i in ids if i % 100 == 0):
        v = vectors[ids.index(q)]
        d = sorted((math.dist(v, w), i) for i, w in zip(ids, vectors) if i != q)
        out[q] = d[:k]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").collect()
    want = brute_knn([r.vec_id for r in rows], [list(map(float, r.embedding)) for r in rows], 10)
    got = {}
    for r in ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, block_rows=700).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
        hits += len({f[2] for f in found} & {i for _, i in want[q]})
        true = {i: d for d, i in want[q]}
        assert all(abs(true[i] - d) < 1e-12 for _, d, i in found if i in true)
    assert hits >= 0.9 * 10 * len(want)


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (5, [0.0, 2.0]),
            (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (None, [1.0, 1.0]),
            (700, [1.0, 2.0, 3.0]), (800, [])]
    df = spark.createDataFrame([(i, v, 9, 9.0, "b", 1) for i, v in rows],
                               "vec_id long, embedding array<float>, rank int, score double, block string, dim int")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 100 == 0, k=10).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by == {0: [(2, 0.0), (3, 0.0), (100, 0.0), (5, math.sqrt(5))],
                  100: [(0, 0.0), (2, 0.0), (3, 0.0), (5, math.sqrt(5))]}
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_ann_ties_beyond_k(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(60)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(df, F.col("vec_id") == 50, k=5, block_rows=7).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(i + 1, i, 0.0) for i in range(5)]


def test_pool_adjacent_violators():
    rng = np.random.default_rng(0)
    for _ in range(50):
        y, w = rng.uniform(size=12), rng.uniform(0.5, 2, 12)
        fit = quality.pool_adjacent_violators(y, w)
        assert (np.diff(fit) >= -1e-12).all()
        # a projection: moving towards any non-decreasing sequence does not come nearer
        for _ in range(20):
            z = np.sort(rng.uniform(size=12))
            assert (w * (y - fit) * (z - fit)).sum() <= 1e-9


def test_quality_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = quality.score_quality(docs, labels)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    pdf = got.toPandas()
    assert len(pdf) == docs.count() and pdf.score.between(0, 1).all()
    assert (pdf.predicted == (pdf.score >= 0.5)).all()
    both = pdf.merge(labels.toPandas(), on="doc_id")
    rest = both[both.held_out]
    assert (rest.predicted == rest.quality).mean() > 0.97
    import zlib
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(pdf.doc_id, pdf.held_out))


def test_quality_edges(edge_docs, edge_rows, empty_docs, spark):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(1, 140)] + [(5, None, 0, "x"), (None, 1, 0, "x")],
                                   "doc_id long, quality int, toxic int, text string")
    got = quality.score_quality(edge_docs, labels).collect()
    assert len(got) == len(edge_rows) and all(0 <= r.score <= 1 for r in got)
    none = quality.score_quality(edge_docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and {r.predicted for r in none} == {1}
    assert quality.score_quality(empty_docs, labels).count() == 0
    # held-out labels change nothing
    turned = labels.withColumn("quality", F.when(quality.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(edge_docs, turned).collect()}
    assert again == {r.doc_id: r.score for r in got}


def test_kneser_ney_sums_to_one(spark):
    texts = [("abracadabra bandana", "a"), ("cabana banana", "a"), ("zyx zyx yzy", "b")]
    models = langid.learn(spark.createDataFrame(texts, "text string, lang string"))
    assert [m.lang for m in models] == ["a", "b"]
    alphabet = [ord(c) for c in "abrcdn "]  # every code language a has seen
    for context in ("ban", "   ", "dab", "zzz", "na "):
        base = 0
        for c in context:
            base = (base << 16) | ord(c)
        keys = np.array([(base << 16) | c for c in [*alphabet, ord("q")]], np.uint64)
        # the unknown code takes the alphabet's last share
        assert abs(np.exp(models[0].logp(keys)).sum() - 1) < 1e-3
    seen = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate("bana"))], np.uint64)
    assert models[0].logp(seen)[0] > models[1].logp(seen)[0]


def test_unseen_grams_are_not_found(spark):
    """Many different 4-grams: all that were learned are found, and no other one."""
    rng = np.random.default_rng(5)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9F00, 4000))) for _ in range(50)]
    model, = langid.learn(spark.createDataFrame([(t, "zh") for t in texts], "text string, lang string"))
    codes, sizes = langid.letter_stream(texts)
    seen, _ = langid._grams(codes, langid._predicted(sizes))
    assert model.grams[4].get(seen)[0].all()
    a, b = seen & np.uint64(0xFFFFFFFF), np.roll(seen, 7) & np.uint64(0xFFFFFFFF << 32)
    other = np.setdiff1d(a | b, seen)
    assert len(other) > 190_000 and not model.grams[4].get(other)[0].any()


def test_windows_prune(spark):
    """Fewer than a fifth of the vectors are verified at a recall of 0.9 and more."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    index, hits, asked = ann.BlockIndex(ids, x, ann.PROJECTIONS, ann.SEED), 0, np.flatnonzero(ids % 100 == 0)
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        got, _ = index.search(int(ids[i]), x[i], 10, ann.THRESHOLD, ann.RATIO)
        hits += len(set(got.tolist()) & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert hits >= 0.9 * 10 * len(asked) and index.verified < 0.2 * index.met


def test_letters_go_by_unicode_category(spark):
    """Private-use characters are no letters; letters beyond 16 bits never merge."""
    texts = ["\ue000 12", "\ue000\uf8ff", "😀 12", "𝒳", "𐐨", None, "", "12 34"]
    codes, sizes = langid.letter_stream(texts)
    assert sizes.tolist() == [0, 0, 0, 2, 2, 0, 0, 0]
    old = [chr(c) for c in range(0x10428, 0x10450)] + [chr(c) for c in range(0x20000, 0x2A000, 7)]
    streams = {tuple(langid._codes(c).tolist()) for c in old}
    assert len(streams) == len(old)
    rows = [(i, "𐐨𐐩𐐪 𐐫𐐬𐐭 " * 9, "deseret") for i in range(20)] + [(20 + i, "abc def ghi " * 9, "en") for i in range(20)]
    rows += [(100 + i, t, None) for i, t in enumerate(texts)] + [(200, "𐐨𐐩𐐪 𐐫𐐬", None)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify_documents(
        spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[100 + i] == ("und", 0.0) for i in (0, 1, 2, 5, 6, 7))
    assert got[200][0] == got[0][0] == "deseret" and got[20][0] == "en"


def test_kept_rows_may_have_any_column_names(spark):
    rows = [(i, "abc def ghi " * 9, "en", "x", 1.5, 2, "y") for i in range(20)] + [(50, None, "en", "x", 1.5, 2, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, c_lang string, c_mean double, c_limit int, size string")
    got = langid.keep_identified(df)
    assert got.columns == df.columns and {r.doc_id for r in got.collect()} == set(range(20))


def test_labels_that_are_no_numbers_are_not_learned(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7) + "end!" * (i % 2)) for i in range(60)], "doc_id long, text string")
    marks = [(i, float(i % 2)) for i in range(60)]
    odd = [(3, float("nan")), (4, float("inf")), (5, None), (None, 1.0), (7, -float("inf"))]
    clean, dirty = (quality.score_quality(docs, spark.createDataFrame(m, "doc_id long, quality double")).collect()
                    for m in (marks, marks + odd))
    want = {r.doc_id: r.score for r in clean}
    assert all(0 <= r.score <= 1 and abs(r.score - want[r.doc_id]) < 1e-9 for r in dirty)


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = langid.identify_documents(docs).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    both = got.merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    rest = both[both.held_out]
    assert (rest.lang_pred == rest.lang).mean() > 0.99
    assert both.rejected.mean() < 0.005


def test_language_edges(edge_docs, edge_rows, empty_docs, spark):
    got = {r.doc_id: r for r in langid.identify_documents(edge_docs).collect()}
    assert len(got) == len(edge_rows)
    for d in (1, 2, 3, 13):
        assert got[d].lang_pred == "und" and got[d].score == 0 and got[d].rejected
    assert all(r.lang_pred in ("en", "de", "fr") for d, r in got.items() if d not in (1, 2, 3, 13))
    kept = langid.keep_identified(edge_docs)
    assert kept.columns == edge_docs.columns and not {1, 2, 3, 13} & {r.doc_id for r in kept.collect()}
    assert langid.identify_documents(empty_docs).count() == 0
    untaught = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify_documents(untaught).collect()} == {"und"}


def test_other_scripts_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9, "Съешь ещё этих мягких французских булок " * 5, None),
                                 (10**9 + 1, "xq zvk jwq kx qqz vvx jkq zxw " * 20, None),
                                 (10**9 + 2, "𝒳𐐷𐐸" * 30, None)], docs.schema)
    got = {r.doc_id: r for r in langid.identify_documents(docs.union(odd)).filter("doc_id >= 1000000000").collect()}
    assert all(r.rejected for r in got.values()) and len(got) == 3
