"""Mixing, packing, HTML extraction, the pipeline."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import mixing, packing, wrapper
from kiln.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.conftest import SCHEMA, row

TOKENIZER = tokenizer_path()


def sizes(df):
    return {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in df.select("doc_id", "text").collect()}


@pytest.mark.parametrize("which", ["edge_docs", "sample"])
def test_mixture(which, request):
    df = request.getfixturevalue(which)
    n, source = sizes(df), {r.doc_id: r.source for r in df.collect()}
    by = Counter()
    for d, s in source.items():
        by[s] += n[d]
    want = brute.targets(dict(by))
    got = mixing.mix_sources(df).collect()
    assert {r.doc_id: r.size for r in got} == n
    taken = Counter()
    for r in got:
        assert r.source_size == by[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - want[s]) <= 1.5 * mixing.BLOCK_WORDS  # half a block, and a short last block
    again = mixing.mix_sources(df.repartition(3, "n_chars")).collect()
    assert {r.doc_id: r.taken for r in again} == {r.doc_id: r.taken for r in got}


def test_mixed_documents_hold_the_taken_words(sample, edge_docs, spark):
    repeated = spark.createDataFrame([row(1, "a b c " * 300)] * 3 + [row(2, "d " * 900, "en", "s2")], SCHEMA)
    for df in (sample, edge_docs, repeated):
        taken = Counter()
        for r in mixing.mix_sources(df).collect():
            taken[r.doc_id] += r.taken
        rows = mixing.mixed_documents(df)
        assert rows.columns == df.columns
        got = Counter()
        for r in rows.collect():
            got[r.doc_id] += len(brute.WORD.findall(r.text))
        assert got == Counter({d: t for d, t in taken.items() if t})


def test_small_sources_take_their_targets(spark):
    """A long tail of sources that are smaller than half a block."""
    rows = [row(i, "w " * n, "en", f"s{i:03d}") for i, n in enumerate([100] * 60 + [1, 3, 40, 127, 129, 255, 256, 257, 900])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute.targets({r[3]: len(r[1].split()) for r in rows})
    taken, held = Counter(), Counter()
    for r in mixing.mix_sources(df).collect():
        taken[r.source] += r.taken
    for r in mixing.mixed_documents(df).collect():
        held[r.source] += len(r.text.split())
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want) and +taken == held


def test_shards_hold_the_drawn_counts(sample, edge_docs, monkeypatch):
    """Slots of a shard are gapless; its sources' slots are those that the multinomial drew; digests agree."""
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    for df in (sample, edge_docs):
        options = {"block_words": 64}
        layout = mixing.shard_layout(df, **options).collect()
        places, words, shards = {}, Counter(), {}
        for r in layout:
            assert places.setdefault((r.shard, r.place), (r.source, r.block, r["pass"])) == (r.source, r.block, r["pass"])
            words[r.doc_id] += r.upto - r["from"]
            shards.setdefault(r.doc_id, set()).add(r.shard)
        top = Counter(s for s, _ in places)
        assert len(top) > 1 and set(places) == {(s, p) for s, n in top.items() for p in range(n)}
        got = mixing.mix_sources(df, **options).collect()
        taken = Counter()
        for r in got:
            taken[r.doc_id] += r.taken
            assert r.shards == sorted(shards.get(r.doc_id, ())) if r.taken else r.shards == []
        assert +words == +taken
        _, targets, _ = mixing.plan_mixture(df, **options)
        drawn = {(r.rank, r.shard): r["count"] for r in mixing._draws(targets, 64, 11).collect()}
        rank = {r.source: r.rank for r in targets.collect()}
        seen = Counter((rank[source], shard) for (shard, _), (source, _, _) in places.items())
        assert seen == drawn


def test_rows_without_id_are_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 50)
    df = spark.createDataFrame([row(None, f"text {i}") for i in range(2000)], SCHEMA)
    docs, _, _ = mixing.plan_mixture(df)
    starts = sorted((r.start, r["size"]) for r in docs.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_draws_add_up_to_the_target():
    rng = random.Random(3)
    for _ in range(400):
        size, block = rng.randint(1, 60), rng.randint(1, 9)
        target, rank = rng.uniform(0, 2) * size, rng.randint(0, 50)
        blocks, draws, last = mixing.draw_plan(size, target, block, 11, rank)
        words = 0
        for k in range(draws):
            b = int(mixing.permute(np.array([k % blocks]), blocks, mixing._pass_key(11, rank, k // blocks))[0])
            words += min(block if k < draws - 1 else last, size - b * block)
        assert words == round(target) and 0 < last <= block


def test_permutation():
    for n in (1, 2, 3, 17, 64, 1000):
        a = mixing.permute(np.arange(n), n, 5)
        assert sorted(a.tolist()) == list(range(n))
        assert n < 10 or a.tolist() != mixing.permute(np.arange(n), n, 6).tolist()


def test_targets_fill_up(spark):
    rng = random.Random(2)
    for _ in range(6):
        by = {f"s{i:02d}": rng.choice([0, 1, 10, 500, 100_000]) * rng.randint(1, 5) for i in range(rng.randint(1, 12))}
        by[None] = rng.randint(0, 50)
        df = spark.createDataFrame(list(by.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), 1.5, 2.0).collect()}
        want = brute.targets(by)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1.0, want[s]) for s in by)


def test_best_fit_equals_one_by_one():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 37, 100])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
        bins = {}
        for length, a, b, first, per, room in packing.best_fit_decreasing(Counter(items), capacity):
            for r in range(a, b):
                q, m = divmod(r - a, per)
                bins.setdefault(first + q, []).append((capacity - room + m * length, length))
        for parts in bins.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
        assert sorted(capacity - sum(n for _, n in p) for p in bins.values()) == brute.best_fit(items, capacity)


def test_encoder_equals_the_tokenizer(sample):
    from tokenizers import Tokenizer
    whole, own = Tokenizer.from_file(TOKENIZER), packing.Encoder(TOKENIZER)
    texts = [r.text for r in sample.collect()] + [
        "", " ", "\n\n  x\t\ty  ", "it's we'll I'd 12ab34 ... ÀÉß ŉ", "nbsp here   zero​width", "日本語 текст 🙂",
        "<|endoftext|> inside", "\x1c\x1d x\x85y", "don’t “quote” – dash… «a»", "a" * 5000, "  leading", "trailing  ", "º ª ² ¼"]
    for t in texts:
        want = whole.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == want


@pytest.mark.parametrize("which", ["edge_docs", "sample"])
def test_packing(which, request):
    from tokenizers import Tokenizer
    df = request.getfixturevalue(which)
    whole = Tokenizer.from_file(TOKENIZER)
    rows = packing.pack_documents(df, TOKENIZER).collect()
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    lengths = []
    for d in df.collect():
        ids = whole.encode(d.text or "", add_special_tokens=False).ids + [0]
        own = sorted(pieces[d.doc_id], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for k, r in enumerate(own):
            assert r.start == at and (r.length == 2048 or len(own) == 1 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and (len(own) == 1) == (len(ids) <= 2048)
        lengths += [r.length for r in own]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(bins) == len(brute.best_fit(lengths, 2048))


def test_packing_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([row(1, "a b")] * 5 + [row(None, None), row(None, "x")], SCHEMA)
    got = packing.pack_documents(df, TOKENIZER).collect()
    assert len(got) == 7 and len({(r.sequence_id, r.offset) for r in got}) == 7 and {r.sequence_id for r in got} == {0}


PAGE = """<!DOCTYPE html><html><head><title>T {i}</title><style>p{{x}}</style></head><body class="page has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href=/a>Home {i}</a><li><a>More</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="ad-{i}" class="ad">Buy {i}</div>
<article><header><h1>Head&nbsp;{i}</h1><p class=byline>By x</p></header><p>First <b>bo</b>ld &amp; {i} text<br>line
<p>Second   {i} <script>var x="</p>";</script>part<p class="promo-line">Constant line</p>
<form>Name <input></form><aside>Side {i}</aside><section class="comments"><p>Reader says {i}</p></section></article>
<footer>Foot {i}</footer></body></html>"""


def test_extract(spark):
    rows = [(i, f"http://host.example/{i}", PAGE.format(i=i), "x", 1) for i in range(12)]
    rows += [(100, None, None, "x", 1), (101, "not a url", "", "x", 1), (102, "http://h2/x", "plain <b>te", "x", 1),
             (103, "http://h2/y", "<p>a<div>b</div>&lt;c&#62;<!-- no --> d<script>never", "x", 1),
             (104, "http://h3/y", "<div>" * 3000 + "deep" + "</div>" * 3000, "x", 1), (0, rows[0][1], rows[0][2], "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, part int").repartition(3)
    got = wrapper.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i in range(12):
        assert by[i].text == f"Head {i} First bold & {i} text line Second {i} part"
        assert by[i].n_chars == len(by[i].text)
    assert by[100].text == by[101].text == "" and by[102].text == "plain te"
    assert by[103].text == "a b <c> d" and by[104].text == "deep"
    assert wrapper.extract_pages(df.limit(0)).count() == 0


def test_names_do_not_drop_the_article(spark):
    """Wrappers whose class or id names a sidebar, header or the like around the text, with and without article."""
    inner = "<h1>Head {0}</h1><p>Words of page {0} that are its text</p>"
    shapes = ["<div class='has-sidebar'><article>%s</article></div>", "<div id='page' class='with-header'><main>%s</main></div>",
              "<article class='social'>%s</article>", "<div class='sidebar'><article>%s</article></div>",
              "<main><div class='social'><article>%s</article></div></main>", "<div class='widget'><div>%s</div></div>"]
    around = "<body><div class='menu'>Home</div>%s<div class='related'><article>Other {0}</article></div></body>"
    rows = [(100 * k + i, f"http://h{k}/{i}", (around if k < 5 else "<body><div class='ad'>Buy {0}</div>%s</body>").replace(
        "%s", s.replace("%s", inner)).format(i)) for k, s in enumerate(shapes) for i in range(6)]
    rows += [(1000, "http://few/1", "<body><div class='side'><p>Only page</p></div><div class=ad>Buy</div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrapper.extract_pages(df).collect()}
    assert got.pop(1000) == "Only page"
    assert got == {k: f"Head {k % 100} Words of page {k % 100} that are its text" for k in got}


def test_region_without_article():
    page = ("<body><div class=top>Fixed words</div><div class=x><div class=body>"
            "<p>Text number {0} is here and long enough</p><p>And {0} more</p></div></div><div class=tail>Fixed end</div></body>")
    trees = [wrapper.parse(page.format(i)) for i in range(6)]
    w, = wrapper.induce(trees)
    assert w.region[-1].label == "div.body"
    assert w.extract(wrapper.parse(page.format(99))) == "Text number 99 is here and long enough And 99 more"
    few, = wrapper.induce(trees[:2])
    assert few.extract(trees[0]).startswith("Fixed words")


def plain_content(pages, words):
    """Words of each page that are not among the fixed ones, by position in page order."""
    return [" ".join(w for w in re.sub(r"<[^>]*>", " ", p).split() if w not in words) for p in pages]


def test_wrappers_without_speaking_names():
    """Menus and boxes that nothing names: page-specific classes, two layouts on a host, optional boxes, no article element."""
    one = ("<html><body class='page-{0} postid-{1}'><div><ul><li>HOME<li>ABOUT<li>CONTACT</ul></div><div><h1>Title {0}</h1>"
           "<p>Body number {0} with words {1}</p>{2}<p>{3}{0}</p></div>{4}<div>COPYRIGHT EXAMPLE</div></body></html>")
    pages = [one.format(i, 7 * i, "<p>an extra paragraph %d</p>" % i if i % 3 == 0 else "", "more " * (i % 5 + 1),
                        "<section>OFFERS NOW</section>" if i % 2 else "") for i in range(30)]
    fixed = {"HOME", "ABOUT", "CONTACT", "COPYRIGHT", "EXAMPLE", "OFFERS", "NOW"}
    assert list(wrapper.extract_group(pages)) == plain_content(pages, fixed)
    first = "<body><div><ul><li>HOME<li>SHOP</ul></div><div><h1>A {0}</h1><p>Article text {0} here</p></div><div>READ ALSO THESE</div></body>"
    second = ("<body><table><tr><td>START<td>LIST</table><section><h2>Listing {0}</h2><ol><li>item {0}<li>thing {0} x</ol></section>"
              "<section>BOX ALWAYS SAME</section></body>")
    both = [t.format(i) for i in range(30) for t in (first, second)]
    fixed = {"HOME", "SHOP", "READ", "ALSO", "THESE", "START", "LIST", "BOX", "ALWAYS", "SAME"}
    assert list(wrapper.extract_group(both)) == plain_content(both, fixed)
    shuffled = random.Random(3).sample(both, len(both))
    assert dict(zip(shuffled, wrapper.extract_group(shuffled))) == dict(zip(both, plain_content(both, fixed)))


def test_copied_articles_stay():
    """Pages whose article most other pages copy keep it; the menu still goes."""
    page = "<body><div>MENU ITEMS</div><article><h1>Same head</h1><p>Same text on nearly all pages</p><p>{0}</p></article></body>"
    pages = [page.format(f"note {i}") for i in range(20)]
    got = list(wrapper.extract_group(pages))
    assert got == [f"Same head Same text on nearly all pages note {i}" for i in range(20)] or all("note" in t for t in got)


def test_pages_of_a_split_host(spark):
    page = "<body class=p{0}><div>MENU {1}</div><div><p>Words of page {0} here</p><p>and {0} again</p></div></body>"
    rows = [(i, f"http://big/{i}", page.format(i, "ITEMS")) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    want = {i: f"Words of page {i} here and {i} again" for i in range(120)}
    for size in (20, 2000):
        assert {r.page_id: r.text for r in wrapper.extract_pages(df, group_pages=size).collect()} == want


def test_tree_matching_counts():
    a = wrapper.parse("<ul><li>1<li>2<li>3</ul><p>x</p>")
    b = wrapper.parse("<p>y</p><ul><li>1<li>2</ul><p>x</p>")
    size, pairs = wrapper.match_trees(a, b)
    assert size == 5 and len(pairs) == 5  # root, ul, two li, p


def test_given_pages(spark):
    import html
    import re
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in wrapper.extract_pages(df).collect()}
    for r in df.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        text = html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner)))
        assert got[r.page_id] == " ".join(text.split())


def test_pipeline(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    assert [n for n, _ in cp.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    counts = []
    from kiln.llm.common import stage
    for name, step in cp.STAGES:
        out = step(spark, now, "/root/testdata/sf0.001")
        if name != "packing":
            assert out.dtypes == docs.dtypes
        now = stage(out, name)
        counts.append(now.count())
    assert counts[0] >= counts[1] >= counts[2] > 0
    assert cp.run(spark, "/root/testdata/sf0.001").count() == counts[-1]


def test_pipeline_edges(spark, edge_docs, empty_docs):
    import corpus_pipeline as cp
    from kiln.llm.common import stage
    for docs in (edge_docs, empty_docs):
        now = docs
        for name, step in cp.STAGES:
            now = stage(step(spark, now, ""), name)
        assert "sequence_id" in now.columns
