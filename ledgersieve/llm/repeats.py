"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes around it also starts anywhere else.  No suffix of the
whole corpus is shuffled.  Every window of that length picks the anchor with the least hash among
its ``GRAM``-byte strings, so equal windows pick equal anchors at the same distance; there is about
one anchor in 85 bytes.  Then

1. anchors are sorted by their hash, and by that of all bytes that windows around the anchor can
   reach; occurrences whose whole surroundings are equal are repeats as they are,
2. anchors that occur again in other surroundings send these bytes, once per kind of surroundings.
   They are cut where any two begin or cease to agree, the cuts give short sequences of numbers,
   and the suffix array of these sequences (:mod:`ledgersieve.llm.suffixes`) gives with its common
   prefixes all windows that occur twice.  Anchors in more than ``MEMBERS`` surroundings are first
   dealt by longer strings around them, one for each part of the distances at which a window can
   begin; equal surroundings collapse again, and what is still too many is dealt by smaller parts,
3. the ranges come back to their texts, which are cut and hashed.

Texts are known by two hashes of their own, so exact copies are one text with a count, and a text
that stands twice is a repeat as a whole.

Defined results: a null text is empty; texts shorter than the length lose nothing, even if they
are copies; overlapping repeats within one text count; nothing matches across texts; repeated rows
are copies of each other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import slices, stored
from ledgersieve.llm.suffixes import common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
#: Bytes of text that are hashed at a time; longer texts are taken in overlapping pieces.
PIECE = 4 << 20
#: Bytes of texts that a task holds as arrays, and as it passes them on.
SLICE, PASSED = 1 << 18, 1 << 21
#: Numbers that one suffix array holds at least; surroundings that are compared at once are never divided.
BATCH_SYMBOLS = 5_000
#: Kinds of surroundings of one string that are compared at once, parts that those of more are dealt to, and how many are dealt at a time.
MEMBERS, FAN, DEALT = 1_000, 4, 2_000

_MULTIPLIER = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(0x5851F42D4C957F2D, -1, 1 << 64))
_POSITION_BITS = np.uint64(24)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


class _Hashes:
    """Hashes of any range of a byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.back = np.full(n + 1, _INVERSE)
        forward = np.full(n + 1, _MULTIPLIER)
        self.back[0] = forward[0] = 1
        np.multiply.accumulate(self.back, out=self.back)
        np.multiply.accumulate(forward, out=forward)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[:n], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])


def _window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every window of ``width`` keys."""
    count = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1: width - 1 + count])


def _anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Place, hash and hash of the surroundings of the anchors of all texts in ``data``, with their text's number.

    ``starts`` and ``ends`` bound the texts, which stand one after the other.
    """
    hashes = _Hashes(data)
    n = len(data)
    grams = hashes.of(slice(0, n - GRAM + 1), slice(GRAM, n + 1))
    low = (np.uint64(1) << _POSITION_BITS) - np.uint64(1)
    keys = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    # A string that crosses into the next text is never least; a window that crosses is not asked for.
    for end in ends[:-1].tolist():
        keys[max(0, end - GRAM + 1): end] = np.iinfo(np.uint64).max
    minima = _window_minima(keys, LENGTH - GRAM + 1)
    within = np.zeros(len(minima) + 1, dtype=np.int32)
    long = ends - starts >= LENGTH
    np.add.at(within, starts[long], 1)
    np.add.at(within, ends[long] - LENGTH + 1, -1)
    place = np.unique(minima[np.cumsum(within[:-1]) > 0] & low).astype(np.int64)
    text = np.searchsorted(ends, place, side="right")
    left = np.maximum(place + GRAM - LENGTH, starts[text])
    right = np.minimum(place + LENGTH, ends[text])
    around = hashes.of(left, right) ^ _mixed((place - left).astype(np.uint64) * np.uint64(1 << 20) + (right - place).astype(np.uint64))
    return text, place - starts[text], grams[place].view(np.int64), around.view(np.int64)


def _pieces(text: bytes):
    """Offsets of pieces that hold every window of a long text."""
    step = PIECE - LENGTH
    return [(at, min(at + PIECE, len(text))) for at in range(0, max(1, len(text) - LENGTH + 1), step)]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("k1"),
        # The second half of the key: another hash and the length.
        F.xxhash64(F.lit(17), "text").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.octet_length("text").cast("long")).alias("k2"),
    )


_ANCHORS = "h bigint, around bigint, k1 bigint, k2 bigint, place int"


def anchors(texts: DataFrame) -> DataFrame:
    """``h, around, k1, k2, place`` of all anchors of ``k1, k2, text``."""

    def run(batches):
        for batch in slices(batches, 2, SLICE):
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            whole, rows = [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                if len(text) > PIECE:
                    found = {}
                    for start, end in _pieces(text):
                        # Surroundings reach over the piece, so pieces carry them on both sides.
                        a, b = max(0, start - LENGTH), min(len(text), end + LENGTH)
                        part = np.frombuffer(text[a:b], dtype=np.uint8)
                        _, place, h, around = _anchors(part, np.array([0]), np.array([len(part)]))
                        inner = (place + a >= start) & (place + a + GRAM <= end)
                        found.update(zip((place[inner] + a).tolist(), zip(h[inner].tolist(), around[inner].tolist(), strict=True), strict=True))
                    places = sorted(found)
                    if places:
                        yield _anchor_batch(np.full(len(places), k1[row]), np.full(len(places), k2[row]), np.array(places),
                                            np.array([found[p][0] for p in places]), np.array([found[p][1] for p in places]))
                elif len(text) >= LENGTH:
                    whole.append(text)
                    rows.append(row)
            if whole:
                ends = np.cumsum(np.fromiter(map(len, whole), dtype=np.int64, count=len(whole)))
                starts = np.concatenate(([0], ends[:-1]))
                text, place, h, around = _anchors(np.frombuffer(b"".join(whole), dtype=np.uint8), starts, ends)
                row = np.array(rows)[text]
                yield _anchor_batch(k1[row], k2[row], place, h, around)

    return texts.select("k1", "k2", "text").mapInArrow(run, _ANCHORS)


def _anchor_batch(k1, k2, place, h, around) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(around), pa.array(k1), pa.array(k2), pa.array(place.astype(np.int32))],
        names=["h", "around", "k1", "k2", "place"],
    )


def _change(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it."""
    out = np.ones(len(columns[0]), dtype=bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _kinds(batches, columns: int, bytes_at: int | None = None):
    """Distinct rows, whether a row is the first of its kind, and whether its kind has other rows.

    Rows are sorted; the first two columns (and the bytes, if given) are the kind, the next three
    tell the rows of a kind apart.  All that is held from batch to batch is the last row.
    """
    held, held_first = None, True
    for batch in batches:
        rows = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not batch.num_rows:
            continue
        if held is not None:
            rows = [np.concatenate(pair) for pair in zip(held, rows, strict=True)]
        own = _change(*rows[:5])
        rows = [c[own] for c in rows]
        first = _change(*rows[:2], *([] if bytes_at is None else [rows[bytes_at]]))
        first[0] = held_first
        covered = ~first
        covered[:-1] |= ~first[1:]
        yield [c[:-1] for c in rows], first[:-1], covered[:-1]
        held, held_first = [c[-1:] for c in rows], bool(first[-1])
    if held is not None:
        yield held, np.array([held_first]), np.array([not held_first])


class _Groups:
    """Gathers rows that are sorted by their first column into whole groups of equal ones.

    Groups of more than ``members`` rows are large; their rows are given out as they come.
    """

    def __init__(self, members: int):
        self.members = members
        self.held: list[np.ndarray] | None = None
        self.over = None

    def add(self, fresh: list[np.ndarray], last: bool = False):
        """The rows that are complete, the sizes of their groups, and whether these are large."""
        rows = fresh if self.held is None else [np.concatenate(pair) for pair in zip(self.held, fresh, strict=True)]
        n = len(rows[0])
        if not n:
            return rows, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        sizes = np.diff(np.append(np.flatnonzero(_change(rows[0])), n))
        large = sizes > self.members
        large[0] |= self.over is not None and rows[0][0] == self.over
        self.over = rows[0][-1] if large[-1] else None
        kept = 0 if last or large[-1] else int(sizes[-1])
        self.held = [c[n - kept:] for c in rows]
        if kept:
            sizes, large = sizes[:-1], large[:-1]
        return [c[: n - kept] for c in rows], sizes, large


def _compare(batches, members: int):
    """Repeated anchors: those ``covered`` by equal surroundings, and apart from them one per kind to be compared.

    ``large``: of more kinds than are compared at once.
    """
    groups = _Groups(members)

    def out(covered: list[np.ndarray], firsts: list[np.ndarray], last: bool = False):
        sent, sizes, large = groups.add(firsts, last)
        several = np.repeat((sizes > 1) | large, sizes)
        large = np.repeat(large, sizes)[several]
        sent = [c[several] for c in sent]
        n, m = len(covered[0]), len(sent[0])
        if n + m:
            columns = [np.concatenate(pair) for pair in zip(covered, sent, strict=True)]
            columns += [np.arange(n + m) < n, np.concatenate((np.zeros(n, dtype=bool), large))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "k1", "k2", "place", "covered", "large"])

    none = [np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int32)]
    for (h, _, *member), first, covered in _kinds(batches, 5):
        yield from out([c[covered] for c in (h, *member)], [c[first] for c in (h, *member)])
    yield from out(none, none, last=True)


_PARTS = "key bigint, hull bigint, k1 bigint, k2 bigint, place int, low short, high short, around binary"
_PART_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary())


def _dealt(key, k1, k2, place, low, high, around):
    """Members of large groups, by ``key``: once for each of ``FAN`` parts of the distances ``low`` to ``high``.

    A window begins at a distance before its anchor.  All windows of a part hold the bytes between
    the last begin and the first end, so members that share such a window share these bytes, and
    with them the new key.  ``hull`` is known by the bytes that the windows of the part can reach.
    """
    for at in range(0, len(key), DEALT):
        some = slice(at, at + DEALT)
        data = b"".join(around[some])
        hashes = _Hashes(np.frombuffer(data, dtype=np.uint8))
        length = np.fromiter(map(len, around[some]), dtype=np.int64)
        first, last = low[some].astype(np.int64), high[some].astype(np.int64)
        left = np.minimum(place[some], last)
        anchor = np.cumsum(length) - length + left
        right = length - left
        for part in range(FAN):
            a = first + (last - first + 1) * part // FAN
            b = first + (last - first + 1) * (part + 1) // FAN - 1
            # Near the ends of a text not every distance has a window.
            has = np.flatnonzero(np.maximum(a, LENGTH - right) <= np.minimum(b, left))
            if not len(has):
                continue
            a, b, mid, before, after = a[has], b[has], anchor[has], np.minimum(b, left)[has], np.minimum(LENGTH - a, right)[has]
            distances = _mixed((a * LENGTH + b).astype(np.uint64))
            parted = _mixed(key[some][has].view(np.uint64) ^ distances) ^ hashes.of(mid - a, mid + LENGTH - b)
            hull = hashes.of(mid - before, mid + after) ^ _mixed(before.astype(np.uint64))
            yield (parted.view(np.int64), hull.view(np.int64), k1[some][has], k2[some][has], place[some][has], a.astype(np.int16), b.astype(np.int16),
                   [data[i:j] for i, j in zip((mid - before).tolist(), (mid + after).tolist(), strict=True)])


def _part_batch(*columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PART_TYPES, strict=True)], names=[c.split()[0] for c in _PARTS.split(", ")])


def _surroundings(batches):
    """The surroundings of a text's anchors that must be compared, those of large groups dealt; copies of the text send nothing."""
    seen: set[tuple[int, int]] = set()
    for batch in slices(batches, 2, PASSED):
        out = {large: ([], [], [], [], []) for large in (False, True)}
        for k1, k2, text, sent in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()),
                                      batch.column(3).to_pylist(), strict=True):
            if (k1, k2) in seen:
                continue
            seen.add((k1, k2))
            text = text.as_py()
            for one in sent:
                place = one["place"]
                around = text[max(0, place + GRAM - LENGTH): place + LENGTH]
                for column, value in zip(out[one["large"]], (one["h"], k1, k2, place, around), strict=True):
                    column.append(value)
        for large, (h, k1, k2, place, around) in out.items():
            low, high = np.zeros(len(h), dtype=np.int16), np.full(len(h), LENGTH - GRAM, dtype=np.int16)
            h, k1, k2 = (np.array(c, dtype=np.int64) for c in (h, k1, k2))
            place = np.array(place, dtype=np.int32)
            if not large:
                # Kinds are told apart already; equal bytes at another distance are none.
                yield _part_batch(h, np.minimum(place, high).astype(np.int64), k1, k2, place, low, high, around)
            else:
                for columns in _dealt(h, k1, k2, place, low, high, around):
                    yield _part_batch(*columns)


def _shared(x: bytes, y: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def _agreements(parts: list[bytes]) -> list[tuple[int, ...]]:
    """Per part all lengths at which some other part ceases to agree with it.

    In sorted order these are the running minima of the neighbours' common prefixes, to either
    side; a stack holds them for one side at a time.  Where two parts agree, they have the same cuts.
    """
    order = sorted(range(len(parts)), key=parts.__getitem__)
    common = [_shared(parts[a], parts[b]) for a, b in zip(order, order[1:], strict=False)]
    cuts: list[tuple[int, ...]] = [()] * len(parts)
    for places, between in ((order, common), (order[::-1], common[::-1])):
        stack: list[int] = []
        for place, length in zip(places[1:], between, strict=True):
            while stack and stack[-1] >= length:
                stack.pop()
            stack.append(length)
            cuts[place] = tuple({*cuts[place], *stack})
    return cuts


def _sequences(around: list[bytes], left: list[int]):
    """Per member its cells: (offset from the anchor, length, content), cut where another member begins or ceases to agree."""
    back = _agreements([a[:n][::-1] for a, n in zip(around, left, strict=True)])
    ahead = _agreements([a[n:] for a, n in zip(around, left, strict=True)])
    for member, (a, n) in enumerate(zip(around, left, strict=True)):
        low, high = -max(back[member]), max(ahead[member])
        if high - low < LENGTH:
            continue
        edges = sorted({0, *(-c for c in back[member]), *ahead[member]})
        yield member, [(start, end - start, a[n + start: n + end]) for start, end in zip(edges, edges[1:], strict=False)]


def _repeated(batches, members: int):
    """Ranges of the texts whose windows occur in other surroundings of the same bytes; members of large groups come back dealt."""
    symbols, cell_owner, cell_start, cell_length = (array("q") for _ in range(4))
    owners: list[tuple[int, int, int]] = []
    numbers = 0
    groups = _Groups(members)

    def add(symbol: int, owner: int, start: int, length: int) -> None:
        symbols.append(symbol)
        cell_owner.append(owner)
        cell_start.append(start)
        cell_length.append(length)

    def solve():
        # Separators all differ, and the last symbol is the least.
        sequence = array("q", (s if s >= 0 else numbers - s for s in symbols))
        sequence.append(-1)
        shared = common_prefixes(sequence, suffix_array(sequence))
        lengths = np.array([*cell_length, 0])
        sums = np.concatenate(([0], np.cumsum(lengths)))
        at = np.flatnonzero(sums[np.arange(len(shared)) + shared] - sums[:-1] >= LENGTH)
        # Ranges of one member stand in order of their start; those that touch become one.
        out, last = [], -1
        for i in at.tolist():
            owner = cell_owner[i]
            k1, k2, place = owners[owner]
            start = place + cell_start[i]
            end = int(start + sums[i + shared[i]] - sums[i])
            if owner == last and start <= out[-1][3]:
                out[-1] = (k1, k2, out[-1][2], max(out[-1][3], end))
            else:
                out.append((k1, k2, start, end))
            last = owner
        for held in (symbols, cell_owner, cell_start, cell_length):
            del held[:]
        owners.clear()
        return _span_batch(*([o[i] for o in out] for i in range(4)))

    def compared(firsts: list[np.ndarray], last: bool = False):
        nonlocal numbers
        rows, sizes, large = groups.add(firsts, last)
        end = 0
        for size, many in zip(sizes.tolist(), large.tolist(), strict=True):
            begin, end = end, end + size
            key, k1, k2, place, low, high, around = (c[begin:end] for c in rows)
            if many:
                # Windows of a single distance are whole kinds, and nothing is left to compare.
                more = low < high
                for columns in _dealt(key[more], k1[more], k2[more], place[more], low[more], high[more], list(around[more])):
                    yield _more_batch(*columns)
                continue
            if size < 2:
                continue
            left = np.minimum(place, high).tolist()
            known: dict[tuple[int, bytes], int] = {}
            for member, sequence in _sequences(list(around), left):
                owners.append((int(k1[member]), int(k2[member]), int(place[member])))
                for start, length, content in sequence:
                    number = known.get((start, content))
                    if number is None:
                        number = known[start, content] = numbers
                        numbers += 1
                    add(number, len(owners) - 1, start, length)
                add(-len(owners), -1, 0, 0)
            if len(symbols) >= BATCH_SYMBOLS:
                yield solve()
                numbers = 0

    none = None
    for (key, _, *member), first, covered in _kinds(batches, 8, 7):
        if covered.any():
            k1, k2, place, _, high, around = (c[covered] for c in member)
            start = place - np.minimum(place, high)
            yield _span_batch(k1, k2, start, start + np.fromiter(map(len, around), dtype=np.int32, count=len(around)))
        none = [c[:0] for c in (key, *member)]
        yield from compared([c[first] for c in (key, *member)])
    if none is not None:
        yield from compared(none, last=True)
    if symbols:
        yield solve()


#: Ranges and, where these are null, members that are dealt once more.
_FOUND = f"start int, end int, {_PARTS}"


def _span_batch(k1, k2, start, end) -> pa.RecordBatch:
    none = [pa.nulls(len(k1), t) for t in _PART_TYPES]
    none[2:4] = pa.array(k1, pa.int64()), pa.array(k2, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), *none], names=[c.split()[0] for c in _FOUND.split(", ")])


def _more_batch(*columns) -> pa.RecordBatch:
    batch = _part_batch(*columns)
    nulls = [pa.nulls(batch.num_rows, pa.int32())] * 2
    return pa.RecordBatch.from_arrays([*nulls, *batch.columns], names=[c.split()[0] for c in _FOUND.split(", ")])


def _cut(batches, with_kept: bool):
    """Applies the ranges to the texts."""
    for batch in slices(batches, 1, PASSED):
        out = {n: [] for n in ("n_bytes", "n_removed", "n_spans", "kept_sha256")}
        kept_texts = []
        columns = (batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())
        for text, spans, copies in zip(*columns, strict=True):
            n = len(text)
            ranges = [(0, n)] if copies and n >= LENGTH else sorted((max(0, s["start"]), min(n, s["end"])) for s in spans or ())
            merged: list[list[int]] = []
            for start, end in ranges:
                if merged and start <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], end)
                else:
                    merged.append([start, end])
            kept, last = [], 0
            for start, end in merged:
                kept.append(text[last:start])
                last = end
            kept.append(text[last:])
            left = b"".join(kept)
            if with_kept:
                kept_texts.append(left)
            out["n_bytes"].append(n)
            out["n_removed"].append(n - len(left))
            out["n_spans"].append(len(merged))
            out["kept_sha256"].append(hashlib.sha256(left).hexdigest())
        columns = [batch.column(0), *(pa.array(out[n], pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), pa.array(out["kept_sha256"], pa.string())]
        if with_kept:
            columns.append(pa.array(kept_texts, pa.binary()))
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out, "kept"][: len(columns)])


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True, members: int = MEMBERS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept`` (the remaining bytes) of every document."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = keyed(docs, id_col, text_col)
    copies = stored(texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "repeat-copies")
    compared = (
        anchors(texts).repartition(parts, "h").sortWithinPartitions("h", "around", "k1", "k2", "place")
        .mapInArrow(lambda batches: _compare(batches, members), "h bigint, k1 bigint, k2 bigint, place int, covered boolean, large boolean")
    )
    compared = stored(compared, "repeat-anchors")
    once = ["k1", "k2"]
    sent = compared.filter("not covered").groupBy(*once).agg(F.collect_list(F.struct("h", "place", "large")).alias("sent"))
    around = texts.select("k1", "k2", "text").join(sent.hint("shuffle_hash"), once).mapInArrow(_surroundings, _PARTS)
    spans = []
    # Each round leaves a part of the distances at most, so there are few.
    while not spans or not around.isEmpty():
        found = around.repartition(parts, "key").sortWithinPartitions("key", "hull", "k1", "k2", "place").mapInArrow(lambda batches: _repeated(batches, members), _FOUND)
        found = stored(found, "repeat-spans")
        spans.append(found.filter("start IS NOT NULL").select(*once, "start", "end"))
        around = found.filter("key IS NOT NULL").drop("start", "end")
    whole = compared.filter("covered").select(
        *once, (F.col("place") + GRAM - LENGTH).alias("start"), (F.col("place") + LENGTH).alias("end"), F.lit(None).cast("long").alias("copies")
    )
    known = (
        reduce(DataFrame.unionByName, spans).unionByName(whole, allowMissingColumns=True).unionByName(copies, allowMissingColumns=True).groupBy(*once)
        .agg(F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", "end"))).alias("spans"), F.max("copies").alias("copies"))
    )
    result = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType),
        *T.StructType.fromDDL("n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_kept).fields,
    ])
    return (
        texts.join(stored(known, "repeat-known").hint("shuffle_hash"), once, "left")
        .select("doc_id", "text", "spans", "copies").mapInArrow(lambda batches: _cut(batches, with_kept), result)
    )


def text_of(kept: Column) -> Column:
    """Remaining bytes as text; a character that lost some of its bytes becomes the replacement character."""
    return F.decode(kept, "UTF-8")
