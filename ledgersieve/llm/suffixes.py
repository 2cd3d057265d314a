"""Suffix sorting by linear grouping, over sequences of numbers.

First all suffixes are put into groups by their first symbol.  Groups are then processed from the
largest to the smallest: each suffix finds the previous one in a smaller group, and the suffixes
so pointed at leave their group for a new one right behind it, those with more pointers further
behind.  In the end two suffixes are in one group if they start with the same longest Lyndon word.
The order within the groups follows in one pass over the result itself: a suffix, once placed,
places the one before it and that one's chain of previous smaller suffixes at the front of their
groups.  Nothing is renamed and nothing recurses.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np


def suffix_array(symbols: Sequence[int]) -> array:
    """Start positions of all suffixes in order.  The last symbol must be smaller than all others."""
    n = len(symbols)
    if not n:
        return array("i")
    group_of, members, before, after, tail = _groups_by_first(symbols)
    previous, sizes = _group_by_lyndon_word(group_of, members, before, after, tail)
    return _ordered(n, group_of, sizes, before, tail, previous)


def _groups_by_first(symbols: Sequence[int]):
    """Group of each suffix, the groups' members, and the groups' neighbours in order."""
    kinds = {s: g for g, s in enumerate(sorted(set(symbols)))}
    members: list[set[int] | None] = [set() for _ in kinds]
    group_of = array("i", map(kinds.__getitem__, symbols))
    for at, g in enumerate(group_of):
        members[g].add(at)
    last = len(members) - 1
    return group_of, members, array("i", range(-1, last)), array("i", [*range(1, last + 1), -1]), last


def _group_by_lyndon_word(group_of, members, before, after, tail) -> tuple[array, array]:
    """Refines the groups, in place; returns each suffix's previous smaller one (or -1) and the groups' sizes.

    Members are let go of once their group is done.
    """
    previous = array("i", [-1]) * len(group_of)
    sizes = array("i", map(len, members))
    done = bytearray(len(members))
    g = tail
    while g != -1:
        done[g] = 1
        pointers: dict[int, int] = {}
        for at in sorted(members[g]):
            j = at - 1
            while j != -1 and done[group_of[j]]:
                j = previous[j]
            previous[at] = j
            if j != -1:
                pointers[j] = pointers.get(j, 0) + 1
        members[g] = None
        if pointers:
            # Most pointers first: each new group goes right behind the old one, in front of those made before.
            moved: dict[tuple[int, int], list[int]] = {}
            for j, count in pointers.items():
                moved.setdefault((-count, group_of[j]), []).append(j)
            for (_, old), leaving in sorted(moved.items(), key=lambda m: m[0]):
                if len(leaving) == sizes[old]:
                    continue
                new = len(members)
                members[old].difference_update(leaving)
                sizes[old] -= len(leaving)
                members.append(set(leaving))
                sizes.append(len(leaving))
                done.append(0)
                for j in leaving:
                    group_of[j] = new
                behind = after[old]
                after.append(behind)
                before.append(old)
                after[old] = new
                if behind != -1:
                    before[behind] = new
        g = before[g]
    return previous, sizes


def _ordered(n, group_of, sizes, before, tail, previous) -> array:
    front = array("i", bytes(4 * len(sizes)))
    g, end = tail, n
    while g != -1:
        end -= sizes[g]
        front[g] = end
        g = before[g]
    order = array("i", [-1]) * n
    placed = bytearray(n)
    order[front[group_of[n - 1]]] = n - 1
    front[group_of[n - 1]] += 1
    placed[n - 1] = 1
    for at in range(n):
        j = order[at] - 1
        while j >= 0 and not placed[j]:
            g = group_of[j]
            order[front[g]] = j
            front[g] += 1
            placed[j] = 1
            j = previous[j]
    return order


def common_prefixes(symbols: Sequence[int], order: Sequence[int]) -> np.ndarray:
    """Length of the longest prefix that each suffix (by start) shares with a neighbour in the order."""
    n = len(order)
    rank = array("i", bytes(4 * n))
    for at, start in enumerate(order):
        rank[start] = at
    shared = array("i", bytes(4 * (n + 1)))
    h = 0
    for start in range(n):
        at = rank[start]
        if not at:
            h = 0
            continue
        other = order[at - 1]
        limit = n - max(start, other)
        while h < limit and symbols[start + h] == symbols[other + h]:
            h += 1
        shared[at] = h
        if h:
            h -= 1
    by_rank = np.array(shared, dtype=np.int64)
    out = np.empty(n, dtype=np.int64)
    out[np.array(order, dtype=np.int64)] = np.maximum(by_rank[:-1], by_rank[1:])
    return out
