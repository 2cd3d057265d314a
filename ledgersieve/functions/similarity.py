"""String similarity scores, 0 to 100, as Arrow batches.

``ratio`` is the indel similarity ``200 * LCS / (len(a) + len(b))``.  The longest
common subsequence is counted with one big-integer step per character.  These
scorers only ever see candidate pairs; see ``operators.fuzzy``.
"""

from __future__ import annotations

import sys
from heapq import heappop, heappush

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType

from .text import as_col

# The scorers travel with the task, so workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _positions(text: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, ch in enumerate(text):
        masks[ch] = masks.get(ch, 0) | 1 << i
    return masks


def _lcs(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    masks, full = _positions(a), (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & masks.get(ch, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * _lcs(a, b) / total if total else 100.0


class _Node:
    """Sorted texts of one length, ``lo`` to ``hi``, that agree on their first ``end`` characters; ``first`` is their least name."""

    __slots__ = ("lo", "hi", "end", "first", "children")

    def __init__(self, texts: list[str], names: list[str], lo: int, hi: int, start: int):
        a, b, end = texts[lo], texts[hi - 1], start
        while end < len(a) and a[end] == b[end]:
            end += 1
        self.lo, self.hi, self.end, self.first, self.children = lo, hi, end, min(names[lo:hi]), None

    def split(self, texts: list[str], names: list[str]) -> list[_Node]:
        """The parts by the next character, made when first asked for."""
        if self.children is None:
            cuts = [i for i in range(self.lo, self.hi) if i == self.lo or texts[i][self.end] != texts[i - 1][self.end]]
            self.children = [_Node(texts, names, i, j, self.end) for i, j in zip(cuts, [*cuts[1:], self.hi])]
        return self.children


class Nearest:
    """The text with the best ``ratio``, and of equals the least name, among many that may be alike.

    Texts of one length form a tree by their first characters.  The row of the common subsequence is
    carried along it, so a beginning that many share is compared once.  What a beginning has matched
    and what is left of both texts bound every score below it; the highest bound is opened next, and
    the first whole text to come up is the best.
    """

    def __init__(self, pairs: list[tuple[str, str]], threshold: float):
        least: dict[str, str] = {}
        for text, name in pairs:
            least[text] = min(name, least.get(text, name))
        by_length: dict[int, list[str]] = {}
        for text in sorted(least):
            by_length.setdefault(len(text), []).append(text)
        self.threshold, self.trees = threshold, []
        for texts in by_length.values():
            names = [least[t] for t in texts]
            self.trees.append((texts, names, _Node(texts, names, 0, len(texts), 0)))

    def best(self, a: str) -> tuple[str, float] | None:
        m, masks, full = len(a), _positions(a), (1 << len(a)) - 1
        heap: list[tuple] = []
        pushed = 0
        for tree, (texts, _, root) in enumerate(self.trees):
            n = len(texts[0])
            if 200.0 * min(m, n) >= self.threshold * (m + n):
                pushed = self._push(heap, pushed, tree, root, 0, full, m, masks, full)
        while heap:
            score, name, _, tree, node, row = heappop(heap)
            texts, names, _ = self.trees[tree]
            if node.end == len(texts[0]):
                return name, -score
            for child in node.split(texts, names):
                pushed = self._push(heap, pushed, tree, child, node.end, row, m, masks, full)
        return None

    def _push(self, heap: list[tuple], pushed: int, tree: int, node: _Node, start: int, row: int, m: int, masks: dict[str, int], full: int) -> int:
        text = self.trees[tree][0][node.lo]
        for ch in text[start:node.end]:
            hit = row & masks.get(ch, 0)
            row = (row + hit | row - hit) & full
        open_ = max(0, m - len(text) + node.end)  # characters of the other text that the rest cannot all meet
        bound, total = m - (row & (1 << open_) - 1).bit_count(), m + len(text)
        score = 200.0 * bound / total if total else 100.0
        if score >= self.threshold:
            heappush(heap, (-score, node.first, pushed, tree, node, row))
        return pushed + 1


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _token_set(a: set[str], b: set[str]) -> float:
    common, only_a, only_b = a & b, a - b, b - a
    if common and (not only_a or not only_b):
        return 100.0
    shared, rest_a, rest_b = (" ".join(sorted(s)) for s in (common, only_a, only_b))
    whole_a, whole_b = f"{shared} {rest_a}".strip(), f"{shared} {rest_b}".strip()
    score = ratio(whole_a, whole_b)
    if common:
        score = max(score, ratio(shared, whole_a), ratio(shared, whole_b))
    return score


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against any window of the longer, ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    best = 0.0
    for end in range(1, len(b) + len(a)):
        best = max(best, ratio(a, b[max(0, end - len(a)):end]))
        if best == 100.0:
            break
    return best


def composite(a: str, b: str) -> float:
    """Best of whole-text, token and partial scores, the weaker kinds weighted down."""
    if not a or not b:
        return 0.0
    tokens_a, tokens_b = set(a.split()), set(b.split())
    longer = max(len(a), len(b)) / min(len(a), len(b))
    score = ratio(a, b)
    if longer < 1.5:
        return max(score, 0.95 * max(token_sort(a, b), _token_set(tokens_a, tokens_b)))
    weight = 0.9 if longer <= 8 else 0.6
    score = max(score, weight * _partial(a, b))
    if tokens_a & tokens_b:
        partial_tokens = 100.0
    else:
        partial_tokens = _partial(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    return max(score, 0.95 * weight * partial_tokens)


_SCORERS = {"ratio": ratio, "token_sort": token_sort, "composite": composite}


def similarity(a: Column | str, b: Column | str, scorer: str = "token_sort") -> Column:
    score = _SCORERS[scorer]

    @F.pandas_udf(DoubleType())
    def scored(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([score(x, y) for x, y in zip(left, right)], dtype="float64")

    return scored(as_col(a), as_col(b))


def plain(c: Column | str) -> Column:
    """Pre-processing of the composite score: other characters to blanks, trimmed, lower case."""
    return F.lower(F.btrim(F.regexp_replace(as_col(c), r"[^\p{L}\p{N}]", " ")))


def sorted_tokens(c: Column | str) -> Column:
    """Tokens in order, one blank between them: the text the token-sort score compares."""
    tokens = F.filter(F.split(as_col(c), r"\s+"), lambda t: t != "")
    return F.array_join(F.array_sort(tokens), " ")
