"""Personal data, tokenizer alignment and the conversation trie against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kiln.llm import align, pii, trie
from kiln.llm.queries import tokenizer_path
from tests.llm.conftest import SCHEMA, row

EMPTY = hashlib.sha256(b"").hexdigest()
A_FILE, B_FILE = tokenizer_path(), tokenizer_path("piece_bpe_32k.model")
TURNS = "conv_id long, turn long, role string, text string, c int, own string, part long, n int, pos string"


# --- conversation trie -------------------------------------------------------------------------------------------------

def plain_trie(rows, spliced=True):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in by.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if spliced else 0
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = own.get(donor, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def turn_rows():
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "yes", "", None, "Ä" * 9, "no way"]))
            for c in range(-160, 420) for t in range(rng.choice([1, 1, 2, 4, 7, 11]))]
    rows = [r for r in rows if r[0] not in (100, -100) and (r[0] != 300 or r[1] < 1)]  # absent and short donors
    rows += [(500, None, "user", "null turn first"), (500, 0, "user", "x"), (500, 0, "bot", "x"), (500, 0, "bot", "x"),
             (None, 1, "user", "nobody"), (501, 3, None, "long " * 30_000)]
    rows += [(777, t, "user", f"step {t % 3}") for t in range(90)] + [(778, t, "user", f"step {t % 3}") for t in range(87)]
    return rows


@pytest.mark.parametrize("heavy, queue", [(3, 4), (50, 1), (1000, 200_000)])
def test_trie_equals_plain_version(spark, monkeypatch, heavy, queue):
    monkeypatch.setattr(trie, "CHUNK_TURNS", 8 if heavy < 1000 else 4096)
    rows = turn_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "y") for r in rows], TURNS).repartition(5)
    got = trie.prefix_trie(df, rule=trie.splice, heavy=heavy, queue_messages=queue).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_unspliced_and_empty_tables(spark):
    rows = [(1, 1, "u", "a"), (2, 1, "u", "a"), (2, 2, "u", "b"), (5, 1, "u", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in trie.prefix_trie(df).collect())
    assert got == plain_trie(rows, spliced=False)
    assert trie.prefix_trie(df.limit(0)).collect() == [] == trie.prefix_trie(df.limit(0), rule=trie.splice).collect()


def test_spilling_queue_keeps_order():
    queue, rng = trie.SpillingQueue(3), random.Random(1)
    want = Counter()
    for _ in range(500):
        k = rng.randint(0, 40)
        queue.push(((k,), 1, 2, k))
        want[k] += 1
    assert [queue.pop_all((k,)) for k in range(41)] == [(want[k], 2 * want[k], k * want[k]) for k in range(41)]


# --- alignment ----------------------------------------------------------------------------------------------------------

def plain_alignment(texts):
    tok = Tokenizer.from_file(A_FILE)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B_FILE)
    decoded = {c: b for b, c in align._tokenizers(A_FILE, B_FILE)[0].alphabet.items()}

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs = []
    for text in texts:
        a = tok.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        xa, xb = [bytes(decoded[c] for c in tok.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            a, b, xa, xb = [], [], [], []
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            k, l = ea.index(e, i) + 1, eb.index(e, j) + 1
            groups.append((a[i:k], b[j:l]))
            i, j = k, l
        docs.append((a, b, groups))
    count = Counter(p for _, _, g in docs for p in {(x, y) for ga, gb in g for x in ga for y in gb})
    most = Counter()
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    out = []
    for a, b, groups in docs:
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), links.total(), sum(n for p, n in links.items() if count[p] == most[p[0]]),
                    sum(n * count[p] for p, n in links.items()), hashlib.sha256(told.encode()).hexdigest() if a else ""))
    return out


ODD = ["x▁y lost", "▁", " leading", "two  spaces ", " ", "   ", "<|endoftext|> plain <s> </s> <0x41> <unk>", "aaaa" * 700,
       "日本語のテキスト、漢字。" * 20, "\x00\x01 nul", "tab\tline\r\n\n end", "ﬁ ligature é é 😀😀 𝒳", "!" * 500 + "?" * 300,
       " ".join("a" * k for k in range(80)), "no-space-" * 200]


@pytest.mark.parametrize("work, chunk", [(7, 300), (1 << 16, 4 << 20)])
def test_alignment_equals_plain_version(spark, edge_rows, work, chunk):
    rows = [r for r in edge_rows if len(r[1] or "") < 20_000] + [row(1000 + i, t) for i, t in enumerate(ODD)]
    rows += [row(None, "no id here"), row(1003, ODD[3]), row(4, " ".join(f"word{i % 97}x{i}" for i in range(2000)))]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = align.align_documents(df, A_FILE, B_FILE, work=work, chunk_bytes=chunk).collect()
    want = [(r[0], *x) for r, x in zip(rows, plain_alignment([r[1] or "" for r in rows]))]
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_alignment_of_the_sample_and_of_nothing(spark, sample, empty_docs):
    rows = sample.select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in align.align_documents(sample, A_FILE, B_FILE).collect()}
    assert got == dict(zip([r.doc_id for r in rows], plain_alignment([r.text or "" for r in rows])))
    assert align.align_documents(empty_docs, A_FILE, B_FILE).collect() == []


def test_large_groups_count_links_like_small_ones():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 400), rng.integers(0, 9, 300)
    ga, gb, doc = np.array([0, 2, 350, 400]), np.array([0, 1, 290, 300]), np.array([0, 0, 1])
    got = align._sum_equal(*align._pairs(a, b, ga, gb, doc, 16))
    want = Counter()
    for g in range(3):
        for x in a[ga[g]:ga[g + 1]].tolist():
            for y in b[gb[g]:gb[g + 1]].tolist():
                want[int(doc[g]) << 32 | x * 16 + y] += 1
    assert dict(zip(got[0].tolist(), got[1].tolist())) == want


def test_merge_path_pieces_are_even():
    rng = random.Random(4)
    for n, m in ((0, 5), (5, 0), (1, 1), (40, 300), (200, 180)):
        a, b = (np.array(sorted(rng.sample(range(1000), k)), np.int64) for k in (n, m))
        i, j = align.merge_path(a, b, 16)
        assert (np.diff(i) >= 0).all() and (np.diff(j) >= 0).all() and (np.diff(i + j) <= 18).all()
        ends = [x for p in align.group_ends(a, b, 16) for x in a[p[0] - 1].tolist()]
        assert ends == sorted(set(a.tolist()) & set(b.tolist()))


# --- personal data ------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    """[(start, kind order, end)] of base spans."""
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else (2 * x - 9 * (x > 4)) for i, x in enumerate(reversed(d))) % 10 == 0
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split("."))
                    or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


PRIVATE = ["a@b.com_c@d.org,e@f", "x" * 5000 + "@" + "y." * 3000 + "z", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255 1.2.3",
           "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000000", "+1 (212) 555-0100. +44 20 7946 0958) +12345 ++1234567890",
           "😀 é 5500005555555559 10.0.0.1 5500005555555559", "9" * 30_000, "1 " * 9000, "+" * 400 + "1" + "(" * 400 + "2",
           "@@@ a@b a@b.c.d.e- q@-.-", ".%+-@x.y", "12-34 56--78 90", "a@b.c@d.e@f.g", "٣٤٥ 1٢3 +1٢34567890"]


def test_base_spans_equal_plain_version(spark, edge_rows):
    rows = edge_rows + [row(1000 + i, t) for i, t in enumerate(PRIVATE)] + [row(None, PRIVATE[3]), row(1003, PRIVATE[3])]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = pii.private_digest(df).collect()
    assert len(got) == len(rows)
    want = []
    for r in rows:
        base = plain_base(r[1] or "")
        n = Counter(k for _, k, _ in base)
        want.append((r[0], *(n[k] for k in range(4)), digest(base)))
    key = lambda r: (r[0] is not None, r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)


def test_base_spans_of_the_sample_and_of_nothing(spark, sample, empty_docs):
    got = {r.doc_id: r.base_sha256 for r in pii.private_digest(sample).collect()}
    assert got == {r.doc_id: digest(plain_base(r.text or "")) for r in sample.collect()}
    assert pii.private_digest(empty_docs).collect() == []


def test_contexts_discover_unseen_identifiers(spark):
    """Phones after 'call me at'; one without a plus sign is found by its context, and leads to a new pattern."""
    rows = [row(i, f"text {i} please call me at +1 212 555 01{i:02d} today or later") for i in range(9)]
    rows += [row(20, "you may call me at 212 555 7788 today"), row(21, "office tel. 212 555 7788 there"),
             row(22, "in the year 1999 we met at 2 places"), row(23, "page 4 of 1200 pages"), row(24, None), row(25, "")]
    rows += [row(30 + i, f"copy of a text {i}: the number is 4444{i}4 and no phone") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.spans for r in pii.private_digest(df).collect()}
    at = rows[9][1].index("212")
    assert got[20] == f"phone:{at}:{at + 12}"
    assert all(got[i] == "" for i in (22, 23, 24, 25, *range(30, 36)))
    assert all(got[i].startswith("phone:") and "," not in got[i] for i in range(9))
    spans = pii.private_spans(df).filter("NOT base").collect()
    assert {(s.kind, s.instance) for s in spans} == {("phone", "212 555 7788")}


def test_personal_data_runs_without_python(spark, sample):
    plan = pii.private_digest(sample)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
