"""Benchmark decontamination with a generalised suffix automaton.

The word sequences of all benchmark items go into one automaton.  Document words are streamed
through it; after each word the automaton knows the longest run of words, ending there, that
some item contains.  Ten words or more, or a whole shorter item, mark the words of the run as
hit.  Spans are then removed, or whole documents dropped, by length and coverage limits.

The automaton is built from the benchmark alone.  Its size is bounded: items are dealt to parts
of at most ``PART_WORDS`` words (one longer item is a part of its own), each part is broadcast by
itself and adds its hits to those found before, so a larger benchmark means more steps of the
same scan and no larger broadcast.

Defined results: null or empty texts have no words and are never hit; an item without words has
no window; a null item id marks words but is not listed; repeated items and ids count once;
an empty benchmark leaves every document clean; other columns pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import unused

WINDOW = 10
#: Words of the benchmark that one broadcast automaton holds.
PART_WORDS = 200_000
#: A document is dropped if more than this share of its words is hit.
MAX_COVERAGE = 0.5

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that end a word become spaces; capital letters become small.
_FOLD = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_WORD_BYTES = re.compile(rb"[^\x20]+")

HITS = ("n_words", "hit_starts", "hit_ends", "hit_items")
_HIT_TYPES = ("bigint", "array<int>", "array<int>", "array<string>")


def tokens(text: bytes | str | None) -> list[bytes]:
    if not text:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_FOLD).split()


class Automaton:
    """Suffix automaton over word numbers of several items, with what a match at a state means.

    ``of_window[state]``: items of the window of full length among the state's words;
    ``short[state]``: (length, items) of the whole short items that end there, longest first.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for item, ws in items if ws]
        for _, sequence in numbered:
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self.of_window: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, set[str]]]] = {}
        self.shortest = min((min(len(s), window) for _, s in numbered), default=0)
        for item, sequence in numbered:
            self._mark(item, sequence)
        # The states whose suffixes hold a marked short item, or None: the nearest such state up the links.
        self.above: list[int] = [-1] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            self.above[state] = state if state in self.short else self.above[self.link[state]]

    def _extend(self, last: int, word: int) -> int:
        """Adds ``word`` behind state ``last``; items share states, so the step may exist already."""
        nxt, link, length = self.next, self.link, self.length
        known = nxt[last].get(word)
        if known is not None:
            if length[known] == length[last] + 1:
                return known
            return self._clone(last, word, known)
        state = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = state
            p = link[p]
        if p != -1:
            q = nxt[p][word]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return state

    def _clone(self, p: int, word: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(word) == q:
            nxt[p][word] = copy
            p = link[p]
        return copy

    def _step(self, state: int, matched: int, word: int) -> tuple[int, int]:
        nxt = self.next
        while word not in nxt[state]:
            state = self.link[state]
            if state == -1:
                return 0, 0
            matched = self.length[state]
        return nxt[state][word], matched + 1

    def _mark(self, item: str | None, sequence: list[int]) -> None:
        state = matched = 0
        whole = len(sequence) < self.window
        for word in sequence:
            state, matched = self._step(state, matched, word)
            while not whole and self.length[self.link[state]] >= self.window:
                state = self.link[state]
                matched = self.length[state]
            if not whole and matched >= self.window:
                self.of_window.setdefault(state, set()).update([] if item is None else [item])
        if whole:
            marks = self.short.setdefault(state, [])
            items = next((i for n, i in marks if n == len(sequence)), None)
            if items is None:
                items = set()
                marks.append((len(sequence), items))
                marks.sort(key=lambda mark: -mark[0])
            items.update([] if item is None else [item])

    def hits(self, numbers: list[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges inside occurrences of windows, and the items of these windows."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        state = matched = 0
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for at, word in enumerate(numbers):
            while word not in nxt[state]:
                state = link[state]
                if state == -1:
                    break
                matched = length[state]
            if state == -1:
                state = matched = 0
                continue
            state = nxt[state][word]
            matched += 1
            reach = 0
            if matched >= window:
                full = state
                while length[link[full]] >= window:
                    full = link[full]
                items |= self.of_window[full]
                reach = window
            short = self.above[state]
            while short != -1:
                for size, owners in self.short[short]:
                    if size <= matched:
                        items |= owners
                        reach = max(reach, size)
                short = self.above[link[short]]
            if reach:
                start = at + 1 - reach
                if spans and start <= spans[-1][1]:
                    spans[-1] = (min(spans[-1][0], start), at + 1)
                    while len(spans) > 1 and spans[-1][0] <= spans[-2][1]:
                        late = spans.pop()
                        spans[-1] = (min(spans[-1][0], late[0]), late[1])
                else:
                    spans.append((start, at + 1))
        return spans, items


def _scan(automaton: Automaton, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Streams only the stretches of known words that are long enough to hold a window."""
    numbers = np.fromiter(map(automaton.vocabulary.get, found, repeat(-1)), dtype=np.int32, count=len(found))
    known = np.concatenate(([False], numbers >= 0, [False])).view(np.int8)
    edges = np.flatnonzero(np.diff(known))
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= automaton.shortest
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        at, owners = automaton.hits(numbers[start:end].tolist())
        spans += [(a + start, b + start) for a, b in at]
        items |= owners
    return spans, items


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _parts(benchmark: DataFrame, window: int, id_col: str, text_col: str, part_words: int) -> Iterator[Automaton]:
    """Automata over parts of the benchmark, built from at most ``part_words`` words at a time."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    batch: list[tuple[str | None, list[bytes]]] = []
    size = 0
    for row in items.toLocalIterator():
        found = tokens(row.text)
        if batch and size + len(found) > part_words:
            yield Automaton(batch, window)
            batch, size = [], 0
        batch.append((row.item, found))
        size += len(found)
    if batch:
        yield Automaton(batch, window)


def _hit_schema(df: DataFrame, names: list[str]) -> T.StructType:
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, _HIT_TYPES, strict=True)))
    return T.StructType([*df.schema.fields, *added.fields])


def n_hit(names: list[str] | tuple[str, ...] = HITS) -> Column:
    """Number of hit words."""
    lengths = F.zip_with(names[2], names[1], lambda end, start: end - start)
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda total, n: total + n)


def match(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", part_words: int = PART_WORDS, names: list[str] | tuple[str, ...] = HITS,
) -> DataFrame:
    """The documents with ``n_words`` and the hits: word ranges (end exclusive) and sorted item ids.

    Works in the tasks that read the documents; nothing is shuffled.  Columns of the input that
    have one of these names are replaced.
    """
    names = list(names)
    docs = docs.drop(*[c for c in docs.columns if c in names])
    at = docs.columns.index(text_col)
    out = docs
    spark = docs.sparkSession
    automata = list(_parts(benchmark, window, item_id_col, item_text_col, part_words)) or [Automaton([], window)]
    for number, automaton in enumerate(automata):
        shipped = spark.sparkContext.broadcast(automaton)
        first = number == 0

        def run(batches, shipped=shipped, first=first):
            automaton = shipped.value
            for batch in batches:
                counts, starts, ends, items = [], [], [], []
                before = repeat(None) if first else zip(*(batch.column(n).to_pylist() for n in names), strict=True)
                for text, old in zip(batch.column(at).cast(pa.binary()), before, strict=False):
                    found = tokens(text.as_py())
                    spans, owners = _scan(automaton, found)
                    if old is not None:
                        spans = _merged(spans + list(zip(old[1], old[2], strict=True)))
                        owners = owners | set(old[3])
                    counts.append(len(found))
                    starts.append([s for s, _ in spans])
                    ends.append([e for _, e in spans])
                    items.append(sorted(owners))
                kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in names]
                kept_names = [n for n in batch.schema.names if n not in names]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(counts, pa.int64()), pa.array(starts, pa.list_(pa.int32())),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
                    names=[*kept_names, *names],
                )

        out = out.mapInArrow(run, _hit_schema(docs, names))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in _WORD_BYTES.finditer(raw.translate(_FOLD))]
    pieces, last = [], 0
    for start, end in spans:
        pieces.append(raw[last:places[start][0]])
        last = places[end - 1][1]
    pieces.append(raw[last:])
    return b"".join(pieces).decode()


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, max_coverage: float = MAX_COVERAGE, min_span: int = 1, **options
) -> DataFrame:
    """The documents without hit spans of ``min_span`` words or more; too widely hit ones are dropped.

    The columns are those of the input.
    """
    text_col = options.get("text_col", "text")
    names = docs.columns
    hits = unused(names, *HITS)
    found = match(docs, benchmark, names=hits, **options)
    at = names.index(text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            starts, ends = batch.column(len(batch.schema.names) - 3), batch.column(len(batch.schema.names) - 2)
            cleaned = []
            for text, start, end in zip(texts, starts, ends, strict=True):
                spans = [s for s in zip(start.as_py(), end.as_py(), strict=True) if s[1] - s[0] >= min_span]
                cleaned.append(_without(text.as_py(), spans) if spans else text.as_py())
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(cleaned, texts.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    light = found.filter((F.size(hits[1]) == 0) | (n_hit(hits) <= max_coverage * F.col(hits[0])))
    return light.mapInArrow(run, docs.schema)
