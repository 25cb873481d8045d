"""Exact, SimHash, substring and suffix-array deduplication against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import anchors, exact, gsaca, simhash, substring, suffix
from tests.llm import brute
from tests.llm.conftest import SCHEMA, row


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("which", ["edge_docs", "sample"])
def test_exact(which, request):
    df = request.getfixturevalue(which)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = {rows[i][0]: v for i, v in brute.exact(rows).items()}
    got = exact.exact_duplicates(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.keep_id, r.group_size, r.text_sha256) == want[r.doc_id]
        assert r.kept == (r.doc_id == r.keep_id)
    kept = exact.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({v[0] for v in want.values()})


def test_exact_group_over_many_partitions_and_repeated_rows(spark):
    rows = [row(i, "Hot") for i in range(300)] + [row(7, "hot"), row(None, "hot"), row(None, "only null"), row(None, "ONLY null"),
                                                  row(500, "x"), row(500, "x")]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        got = exact.exact_duplicates(df).collect()
        hot = [r for r in got if r.group_size == 302]
        assert len(hot) == 302 and {r.keep_id for r in hot} == {299} and sum(r.kept for r in hot) == 1
        assert sum(r.kept for r in got if r.doc_id is None and r.keep_id is None) == 1
        assert sum(r.kept for r in got if r.doc_id == 500) == 1
        assert sorted(r.text.lower() for r in exact.drop_exact_duplicates(df).collect()) == ["hot", "only null", "x"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fingerprint_matches_bit_by_bit():
    for t in ("", "one", "one two three", "A b C d E f", "x " * 70_000, "é à\x0bü\tß  z"):
        assert simhash.fingerprint(t.encode(), 4) % (1 << 64) == brute.simhash(t)


@pytest.mark.parametrize("which", ["edge_docs", "sample"])
def test_simhash(which, request):
    df = request.getfixturevalue(which)
    fps = {d: brute.simhash(t) for d, t in texts(df).items()}
    want = brute.components(fps.items())
    got = simhash.simhash_duplicates(df).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (fps[d], want[d]) for d in fps}
    assert all(len(r.fingerprint) == 16 for r in got)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_chain_filter_and_keys_lose_no_link():
    rng = random.Random(3)
    masks = simhash.key_masks()
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 6)):
            b ^= 1 << bit
        near = (a ^ b).bit_count() <= 4
        assert bool(simhash.linked(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == near
        if near:
            assert any((a & m) == (b & m) for m in masks)


def test_hot_cells_give_the_same_components(spark):
    rng = random.Random(5)
    base, fps = rng.getrandbits(64), {}
    for i in range(400):  # one dense cloud of near fingerprints, and chains away from it
        f = base
        for bit in rng.sample(range(64), rng.randint(0, 5)):
            f ^= 1 << bit
        fps[i] = f
    for i in range(400, 440):
        fps[i] = fps[i - 1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in fps.items()]
    ids = spark.createDataFrame(signed, "doc_id long, fp long")
    links = simhash.fingerprint_links(ids.select("fp").distinct(), cell_rows=16)
    assert links.count() < 440 * 40  # forests of cells, not all pairs
    roots = {r.node: r.root for r in simhash.connected_components(links).collect()}
    want = brute.components(fps.items())
    by_root = {}
    for i, f in signed:
        by_root.setdefault(roots.get(f, f), set()).add(want[i])
    assert all(len(x) == 1 for x in by_root.values())
    assert len(by_root) == len(set(want.values()))


@pytest.mark.parametrize("which", ["edge_docs", "sample"])
def test_substring(which, request):
    df = request.getfixturevalue(which)
    want = brute.word_repeats(texts(df))
    got = substring.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want
    for r in got:
        assert r.n_removed == sum(b - a for a, b in r.spans) and len(r.kept.split()) == r.n_words - r.n_removed


@pytest.mark.parametrize("which,cells", [("edge_docs", 8192), ("sample", 8192), ("edge_docs", 1), ("sample", 1)])
def test_suffix(which, cells, request):
    df = request.getfixturevalue(which)
    want = brute.byte_repeats(texts(df))
    got = suffix.remove_repeats(df, cell_contexts=cells).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_repeats_with_null_and_repeated_ids(spark):
    same = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([row(None, same + " a"), row(3, same), row(3, same), row(3, "x " + same), row(9, same)], SCHEMA)
    got = substring.remove_repeats(df).collect()
    assert len(got) == 5
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert [r.n_removed for r in got if r.doc_id == 9] == [30]
    assert sorted(r.n_removed for r in got if r.doc_id == 3) == [30, 30, 30]


def test_window_overlapping_itself(spark):
    df = spark.createDataFrame([row(1, "a b " * 40), row(2, "q" * 500), row(3, "ab" * 100)], SCHEMA)
    docs = texts(df)
    got = substring.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute.word_repeats(docs)
    got = suffix.remove_repeats(df).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.byte_repeats(docs)


@pytest.mark.parametrize("cells", [1, 8192])
def test_suffix_repeated_rows_are_one_document(spark, cells):
    """Two texts that share pieces shorter than the window share no window, however often a row is given."""
    pieces = ["".join(chr(97 + (i * i * (k + 3) + 7 * i + k) % 26) for i in range(170)) for k in range(12)]
    one, two = ("".join(p + f"<{tag}{k:03d}>" * 9 for k, p in enumerate(pieces)) for tag in ("a", "b"))
    rows = [(1, one), (2, two), (1, one), (1, one), (3, two[:300] + "x"), (3, two[:300] + "x"), (None, one[500:900]), (None, one[500:900])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute.byte_repeats({1: one, 2: two, 3: two[:300] + "x", None: one[500:900]})
    got = suffix.remove_repeats(df, cell_contexts=cells).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(d, *v) for d, v in want.items()}


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(800):
        n, k = rng.randint(0, 50), rng.choice([1, 2, 3, 6])
        s = [rng.randint(1, k) for _ in range(n)] + [0]
        assert gsaca.suffix_array(np.array(s)).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


def test_lyndon_groups():
    s = [ord(c) for c in "graindraining"] + [0]
    group, prev = gsaca.lyndon_groups(np.array(s))
    for i in range(len(s)):
        nearest = [j for j in range(i) if group[j] < group[i]]
        assert prev[i] == (max(nearest) if nearest else -1)


def test_repeated_in():
    a, b = bytes(range(40)), bytes(range(10, 60))
    got = suffix.repeated_in([a, b, b"z" * 30], 25)
    assert got[0].tolist() == [i >= 10 for i in range(16)]
    assert got[1].tolist() == [i < 6 for i in range(26)]
    assert got[2].tolist() == [True] * 6


def test_walk_over_partition_edges(spark):
    """Marks do not depend on where the range partitions and batches are cut."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 5, 9, 10]), rng.choice([0, 0, 0, 0, 1]), d, 0, 0) for d in range(3000)]
    rows += [(50 + i, 7, i, 0, 0) for i in range(50)]
    df = spark.createDataFrame(rows, anchors.OCCURRENCE)
    want = {}
    for h, c, d, p, s in rows:
        twins = [x for x in rows if x[0] == h and x[1] == c]
        want[d, h] = (any(x[2] < d for x in twins), any(x[2] > d for x in twins), len({x[1] for x in rows if x[0] == h}) > 1)
    for parts, batch in ((1, "10000"), (7, "17"), (13, "1")):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            got = anchors.mark(df, "test").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
        leaders = {(r.doc, r.h) for r in got if r["first"] and r.several}
        assert leaders == {k for k, v in want.items() if not v[0] and v[2]}
        assert {(r.doc, r.h) for r in got if r.repeated} == {k for k, v in want.items() if v[0]}
        assert {(r.doc, r.h) for r in got if r.copies} == {k for k, v in want.items() if v[1]}


def test_empty_tables(empty_docs):
    for f in (exact.exact_duplicates, exact.drop_exact_duplicates, simhash.simhash_duplicates,
              simhash.drop_near_duplicates, substring.remove_repeats, suffix.remove_repeats):
        assert f(empty_docs).count() == 0


def test_many_null_ids(spark):
    """Different texts without an id stay different documents, however many there are."""
    passage = " ".join(f"w{i:02d}" for i in range(60))
    rows = [f"u{i:05d} " + passage if i % 2 else f"n{i}" for i in range(20_000)]
    df = spark.createDataFrame([(None, t) for t in rows], "doc_id long, text string").repartition(4)
    got = sorted((r.n_words, r.n_removed) for r in substring.remove_repeats(df).collect())
    assert got == [(1, 0)] * 10_000 + [(61, 0)] + [(61, 60)] * 9_999
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect())
    assert got == sorted(brute.byte_repeats(dict(enumerate(rows))).values())
