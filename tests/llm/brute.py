"""Plain single-process versions of the operators, written from their contracts."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def lower(text: str) -> str:
    return text.translate(UPPER)


def exact(rows):
    """{row index: (keep_id, group_size, sha)} for rows (doc_id, text) with unique ids."""
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        groups[lower(t or "")].append((d, i))
    out = {}
    for text, members in groups.items():
        keep = max((d for d, _ in members if d is not None), default=None)
        for _, i in members:
            out[i] = (keep, len(members), hashlib.sha256(text.encode()).hexdigest())
    return out


def simhash(text, k=4):
    words = WORD.findall(lower(text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=4):
    """Smallest id reachable, for a list of (id, fingerprint) with unique ids."""
    todo, out = dict(fps), {}
    while todo:
        start, fp = next(iter(todo.items()))
        del todo[start]
        seen, queue = [start], [fp]
        while queue:
            f = queue.pop()
            near = [d for d, g in todo.items() if (f ^ g).bit_count() <= bits]
            queue += [todo.pop(d) for d in near]
            seen += near
        for d in seen:
            out[d] = min(seen)
    return out


def word_repeats(docs, window=20):
    """{doc_id: (n_words, n_removed, sha)} for {doc_id: text}."""
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    first = {}
    for d in sorted(words):
        for s in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][s:s + window]), (d, s))
    out = {}
    for d, w in words.items():
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (d, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def byte_repeats(docs, window=200):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} for {doc_id: text}."""
    data = {d: (t or "").encode() for d, t in docs.items()}
    counts = Counter(b[s:s + window] for b in data.values() for s in range(len(b) - window + 1))
    out = {}
    for d, b in data.items():
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if counts[b[s:s + window]] > 1:
                gone[s:s + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = len([x for x in bytes(gone).split(b"\0") if x])
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def targets(sizes, weights=(5, 2, 1), amount=1.5, cap=2.0):
    """{source: target}: share by weight, cap, reshare the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = amount * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > cap * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            free.discard(s)
        left = amount * sum(sizes.values()) - sum(out.values())
    return out


def best_fit(items, capacity):
    """Sorted remaining capacities after packing one by one, longest first, tightest bin first."""
    room = []
    for s in sorted(items, reverse=True):
        i = bisect.bisect_left(room, s)
        bisect.insort(room, (room.pop(i) if i < len(room) else capacity) - s)
    return room


def crc(text):
    return zlib.crc32(text.encode())
