"""Fill-in-the-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of about ``FRAME_BYTES``; each frame knows the
bytes, code points and lines before it.  A cut after ``k`` units is found by a search in these
counts and by decompressing the one frame that holds the unit's end.  The output is arranged from
frames: those between the cuts are taken over as they are, only frames with a cut in them are
compressed anew, and the marks are frames of their own.  Digests, and the text rebuilt from an
output, stream one frame at a time in order, so a task holds the frames of a text and one
decompressed frame.

Cuts and form are drawn from the sha256 of ``seed:id``, so any engine can repeat them.  Units are
lines (with their line break) or code points.

Defined results: a null text is an empty one; a null id is drawn like an empty id; a text that is
empty or holds a mark stays plain, since a mark in it could not be told from the output's own;
repeated rows and ids give as many rows; both cuts may fall on one place, which leaves the middle
empty; an empty table gives no rows.  Further columns are not carried; where the id's name is that
of an added column, the added one gets underscores in front.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import slices, unused

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
FRAME_BYTES = 1 << 16
LEVEL = 3

_FRAME = pa.struct([("data", pa.binary()), ("bytes", pa.int64()), ("chars", pa.int64()), ("lines", pa.int64())])
_FRAME_SQL = "array<struct<data binary, bytes bigint, chars bigint, lines bigint>>"
_PIECE = pa.struct([("data", pa.binary()), ("bytes", pa.int64())])
_PIECE_SQL = "array<struct<data binary, bytes bigint>>"


@dataclass(frozen=True)
class Policy:
    """``rate`` per cent of the texts are transformed, ``spm`` per cent of these with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = "line"


def _points(data: bytes) -> int:
    """Code points of UTF-8: the bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80))


def _packed(text: bytes, pack: zstandard.ZstdCompressor) -> list[dict]:
    """The frames of a text, cut between code points."""
    frames, start, chars, lines = [], 0, 0, 0
    while start < len(text):
        stop = min(start + FRAME_BYTES, len(text))
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        piece = text[start:stop]
        frames.append({"data": pack.compress(piece), "bytes": start, "chars": chars, "lines": lines})
        start, chars, lines = stop, chars + _points(piece), lines + piece.count(b"\n")
    return frames


def framed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_chars, n_lines, marked, frames``: every text as frames, to be stored."""
    names = unused([id_col], "n_bytes", "n_chars", "n_lines", "marked", "frames")
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_whole_text"))
    kinds = ("bigint", "bigint", "bigint", "boolean", _FRAME_SQL)
    schema = T.StructType([rows.schema[0], *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True)))])

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, 1, 8 << 20):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            arrays = [
                pa.array([len(t) for t in texts], pa.int64()), pa.array([_points(t) for t in texts], pa.int64()),
                pa.array([t.count(b"\n") + (t != b"" and not t.endswith(b"\n")) for t in texts], pa.int64()),
                pa.array([PREFIX in t or SUFFIX in t or MIDDLE in t for t in texts], pa.bool_()),
                pa.array([_packed(t, pack) for t in texts], pa.list_(_FRAME)),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *names])

    return rows.mapInArrow(run, schema)


def draws(id_col: Column, seed: int) -> list[Column]:
    """The first four groups of eight hex digits of sha256(``seed:id``) as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _cut(frames: list[dict], unit: str, k: int, end: tuple[int, int, int]) -> tuple[int, int]:
    """Bytes and code points before the end of the ``k``-th unit; ``end`` is bytes, code points and units of the text."""
    if k == 0:
        return 0, 0
    if k == end[2]:
        return end[0], end[1]
    at = bisect_left(frames, k, key=lambda f: f["lines" if unit == "line" else "chars"]) - 1
    frame = frames[at]
    data = zstandard.ZstdDecompressor().decompress(frame["data"])
    if unit == "line":
        place = int(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10)[k - frame["lines"] - 1]) + 1
        return frame["bytes"] + place, frame["chars"] + _points(data[:place])
    starts = np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)
    return frame["bytes"] + int(starts[k - frame["chars"]]) if k - frame["chars"] < len(starts) else frame["bytes"] + len(data), k


def _between(frames: list[dict], start: int, stop: int, end: int) -> Iterator[tuple[bytes, int, int, int]]:
    """Frames that touch ``start:stop``, with the part of each inside and its length."""
    at = max(bisect_left(frames, start + 1, key=lambda f: f["bytes"]) - 1, 0)
    while at < len(frames) and frames[at]["bytes"] < stop:
        first = frames[at]["bytes"]
        last = frames[at + 1]["bytes"] if at + 1 < len(frames) else end
        yield frames[at]["data"], max(start - first, 0), min(stop, last) - first, last - first
        at += 1


def _taken(frames: list[dict], start: int, stop: int, end: int, pack: zstandard.ZstdCompressor) -> Iterator[tuple[bytes, int]]:
    """Compressed frames of a byte range: whole ones as they are, cut ones compressed anew."""
    if start >= stop:
        return
    for data, first, last, size in _between(frames, start, stop, end):
        if (first, last) == (0, size):
            yield data, size
        else:
            yield pack.compress(zstandard.ZstdDecompressor().decompress(data)[first:last]), last - first


def read(frames: list[dict], start: int, stop: int, end: int) -> Iterator[bytes]:
    """The bytes of a range, frame by frame."""
    if start >= stop:
        return
    opened = zstandard.ZstdDecompressor()
    for data, first, last, _ in _between(frames, start, stop, end):
        yield opened.decompress(data)[first:last]


def _parts(batches, at: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the frames in column ``at`` of one part hold about ``limit`` bytes."""
    for batch in batches:
        data = pc.struct_field(batch.column(at).flatten(), "data")
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False))))
        ends = sizes[np.cumsum(pc.list_value_length(batch.column(at)).to_numpy(zero_copy_only=False))]
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _laid(pieces: Iterable[tuple[bytes, int]]) -> tuple[list[dict], int]:
    """Frames in order with the bytes before each, and the bytes of all."""
    out, before = [], 0
    for data, size in pieces:
        out.append({"data": data, "bytes": before})
        before += size
    return out, before


def arranged(frames: DataFrame, policy: Policy = Policy(), id_col: str = "doc_id") -> DataFrame:
    """``id, n, form, prefix_chars, middle_chars, out_bytes, out``: the output of every text as frames."""
    if policy.unit not in ("line", "char"):
        raise ValueError(f"unit is line or char, not {policy.unit}")
    n_bytes, n_chars, n_lines, marked, held = unused([id_col], "n_bytes", "n_chars", "n_lines", "marked", "frames")
    names = unused([id_col], "n", "form", "prefix_chars", "middle_chars", "out_bytes", "out")
    h1, h2, h3, h4 = draws(F.col(id_col), policy.seed)
    n = F.col(n_lines if policy.unit == "line" else n_chars)
    plain = (F.col(n_bytes) == 0) | F.col(marked) | (h3 % 100 >= policy.rate)
    rows = frames.select(
        F.col(id_col), F.col(n_bytes), F.col(n_chars), n, F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1)),
        F.when(plain, "plain").when(h4 % 100 < policy.spm, "spm").otherwise("psm"), F.col(held),
    ).toDF(*[f"c{i}" for i in range(8)])
    kinds = ("bigint", "string", "bigint", "bigint", "bigint", _PIECE_SQL)
    schema = T.StructType([
        T.StructField(id_col, rows.schema[0].dataType),
        *T.StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))),
    ])

    def output(end, chars, n, low, high, form, held, pack):
        if form == "plain":
            return None, None, *_laid(_taken(held, 0, end, end, pack))
        first, first_chars = _cut(held, policy.unit, low, (end, chars, n))
        second, second_chars = _cut(held, policy.unit, high, (end, chars, n))
        part = {
            PREFIX: lambda: _taken(held, 0, first, end, pack), MIDDLE: lambda: _taken(held, first, second, end, pack),
            SUFFIX: lambda: _taken(held, second, end, end, pack),
        }
        order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
        pieces = (piece for mark in order for piece in ((pack.compress(mark), len(mark)), *part[mark]()))
        return first_chars, second_chars - first_chars, *_laid(pieces)

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(_PIECE)]

    def run(batches):
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for part in _parts(batches, 7):
            made = []
            for row in zip(*[part.column(i).to_pylist() for i in range(1, 8)], strict=True):
                prefix, middle, laid, size = output(*row, pack)
                made.append((row[2], row[5], prefix, middle, size, laid))
            arrays = [pa.array(values, kind) for values, kind in zip(zip(*made, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=[id_col, *names])

    return rows.mapInArrow(run, schema)


def _marks(frames: list[dict], size: int) -> dict[bytes, int]:
    """Where each mark stands in an output; frames are searched with the two bytes before them."""
    found, before, at = {}, b"", 0
    for piece in read(frames, 0, size, size):
        window = before + piece
        for mark in (PREFIX, SUFFIX, MIDDLE):
            if (place := window.find(mark)) >= 0:
                found.setdefault(mark, at - len(before) + place)
        before, at = window[-2:], at + len(piece)
    return found


def rebuilt(frames: list[dict], size: int, form: str) -> Iterator[bytes]:
    """The original text, from an output and its form alone."""
    if form == "plain":
        yield from read(frames, 0, size, size)
        return
    stands = _marks(frames, size)
    stops = sorted(stands.values()) + [size]
    for mark in (PREFIX, MIDDLE, SUFFIX):
        yield from read(frames, stands[mark] + len(mark), stops[stops.index(stands[mark]) + 1], size)


def _digest(pieces: Iterable[bytes]) -> str:
    digest = hashlib.sha256()
    for piece in pieces:
        digest.update(piece)
    return digest.hexdigest()


def _streamed(outputs: DataFrame, added: list[str], read_row, drop: bool) -> DataFrame:
    """Adds text columns that ``read_row(frames, bytes, form)`` gives; the frames stay unless dropped."""
    names = outputs.columns
    form, size, out = names[2], names[5], names[6]
    keep = names[:5] if drop else names
    schema = T.StructType([*outputs.select(*keep).schema, *[T.StructField(n, T.StringType()) for n in added]])

    def run(batches):
        for part in _parts(batches, names.index(out)):
            asked = zip(*[part.column(names.index(c)).to_pylist() for c in (out, size, form)], strict=True)
            made = zip(*[read_row(*row) for row in asked], strict=True)
            arrays = [part.column(names.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(values, pa.string()) for values in made]], names=[*keep, *added])

    return outputs.mapInArrow(run, schema)


def digests(outputs: DataFrame) -> DataFrame:
    """``output_sha256`` and ``restored_sha256`` of what :func:`arranged` gave, in place of the frames."""
    added = unused(outputs.columns[:1], "output_sha256", "restored_sha256")
    return _streamed(outputs, added, lambda held, size, form: (_digest(read(held, 0, size, size)), _digest(rebuilt(held, size, form))), True)


def texts(outputs: DataFrame) -> DataFrame:
    """The outputs as texts, in column ``text``."""
    added = unused(outputs.columns[:1], "text")
    return _streamed(outputs, added, lambda held, size, form: (b"".join(read(held, 0, size, size)).decode(),), True)
