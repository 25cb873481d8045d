"""Suffix arrays by linear grouping construction.

Suffixes start out grouped by their first symbol. Phase one takes the groups from
the highest down. For every suffix of a group its previous-smaller pointer is
found: the nearest suffix to the left that lies in a lower group. Suffixes that are
pointed at leave their group for new ones just above it, ordered by how many
pointers hit them. In the end a group holds the suffixes with one and the same
longest Lyndon prefix, and groups are in lexicographic order. Phase two walks the
suffix array from its start and sends the suffix to the left of each entry, and on
along the previous-smaller pointers, to the next free place of its group. No
names are given and nothing recurs.

A group is known by its first place in the suffix array; a group that loses
members keeps its first place and frees its last ones.
"""

from __future__ import annotations

from array import array
from itertools import groupby

import numpy as np


def lyndon_groups(symbols: np.ndarray) -> tuple[array, array]:
    """Phase one: each suffix's group (by first place) and previous-smaller pointer (-1: none)."""
    n = len(symbols)
    counts = np.bincount(symbols)
    first = np.cumsum(counts) - counts
    group = array("i", first[symbols].astype(np.int32).tobytes())
    order = np.argsort(symbols, kind="stable")
    members = {int(f): order[f:f + c].tolist() for f, c in zip(first.tolist(), counts.tolist()) if c}
    # first place of the group that ends before a place
    start_of_end = {int(f + c): int(f) for f, c in zip(first.tolist(), counts.tolist()) if c}
    end_of_start = {f: e for e, f in start_of_end.items()}
    prev = array("i", bytes(4 * n))
    end = n
    while end > 0:
        g = start_of_end[end]
        own = members.pop(g)
        if len(own) > 1:
            own = sorted(s for s in own if group[s] == g)
        hits: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = prev[p]
            prev[s] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        if len(hits) == 1:  # most groups are small
            (p, _), = hits.items()
            _leave(group[p], (p,), group, members, start_of_end, end_of_start)
        elif hits:
            moved = sorted((-c, group[p], p) for p, c in hits.items())
            for (_, old), part in groupby(moved, key=lambda m: m[:2]):
                _leave(old, [m[2] for m in part], group, members, start_of_end, end_of_start)
        end = g
    return group, prev


def _leave(old: int, suffixes, group: array, members: dict, start_of_end: dict, end_of_start: dict) -> None:
    """Move suffixes of the group ``old`` to a new group at the end of its places."""
    end = end_of_start[old]
    new = end - len(suffixes)
    start_of_end[end] = new
    end_of_start[new] = end
    if new > old:
        start_of_end[new] = old
        end_of_start[old] = new
    else:
        members[old] = []
    for s in suffixes:
        group[s] = new
    if new == old:
        members[old] = list(suffixes)
    else:
        members[new] = list(suffixes)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """The suffix array of ``symbols`` (non-negative); the last symbol is the only smallest one."""
    n = len(symbols)
    if n <= 1:
        return np.arange(n)
    group, prev = lyndon_groups(symbols)
    out = array("i", b"\xff" * (4 * n))
    free = array("i", range(n))  # next free place of the group with that first place
    placed = bytearray(n)
    out[0] = n - 1
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            at = free[g]
            free[g] = at + 1
            out[at] = j
            placed[j] = 1
            j = prev[j]
    return np.frombuffer(out, np.int32).astype(np.int64)
