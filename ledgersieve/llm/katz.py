"""Katz backoff language model with Good-Turing discounts, counted and evaluated level by level.

Texts are kept as slices: some megabytes of documents, their words numbered within the slice.  A
level asks for all n-grams of one length.  Every slice sends each of its different n-grams once, as
``context, word, training count, probability at the level below``, packed per bucket of contexts;
the bucket adds up all slices, writes its part of the n-gram table and answers each slice in the
order of its request: counts, numbers for the next level (a seen n-gram is the context of longer
ones), and what backing off needs of contexts of which the slice holds an unseen n-gram.  The last
answers give the probability of every token, summed per document.  What moves is one packed request
and answer per different n-gram of a slice, and slices stay where they are: their table is bucketed,
so only answers are shuffled to them.

A word seen ``c`` times in a context seen ``t`` times has ``d(c) c / t``; ``d`` is Good-Turing's
discount up to ``CUTOFF`` (as far as counts of counts allow, else half a count is taken), 1 above.
What a context loses so goes to the words not seen in it, in proportion to the level below; the
weight is the mass over one minus the lower level's sum over the seen words, so each context's
probabilities add up to one.  A context with nothing discounted counts one occurrence more.  At the
lowest level the mass goes to one unknown word.

A context that holds over ``1 / PARTS`` of all tokens is dealt to several buckets by its words; its
sums are added over the buckets.  There are fewer than ``PARTS`` such contexts per level, whatever
the corpus.

Words are told apart by 64 bits of hash: among four million words two fall together with a chance
of one in two millions.

Defined results: a null text is an empty one, and has the closing token alone; an unknown word is
the one unknown word of the lowest level; without training rows every token has probability one;
a document's first words have contexts that reach no further than its start; repeated rows and ids
are counted, and scored, each; an empty table gives no rows.  One text must fit into a task's
memory.  Other columns are not carried.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import shared_folder, stored, unused

ORDER = 2
CUTOFF = 5
PARTS = 1024
SLICE_BYTES = 4 << 20
#: Numbers with a meaning of their own; seen n-grams are numbered above them.
START, UNKNOWN, FIRST = 0, 1, 2
END = np.uint64(1)

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pack(values: np.ndarray) -> bytes:
    """Whole numbers of few bytes: byte by byte, all lowest ones first, compressed."""
    values = np.ascontiguousarray(values, dtype="<u8")
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(values).to_bytes(8, "little") + zstandard.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width, size = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((size, 8), dtype=np.uint8)
    if width and size:
        out[:, :width] = np.frombuffer(zstandard.decompress(data[9:]), dtype=np.uint8).reshape(width, size).T
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values[:1] * 0))


def _risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def _floats(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values, dtype="<f8").tobytes(), 1)


def _unfloats(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), dtype="<f8") if data else np.zeros(0)


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, each text closed by ``END``; and how many each text has."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    held = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    data = np.zeros(len(held) + 8, dtype=np.uint8)
    data[:len(held)] = _LOWER[held]
    inside = _WORD[held]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < len(held)]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = bounds[1:][bounds[1:] > 0] - 1
    closes[last] = inside[last]
    start, stop = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    per_doc = np.bincount(doc, minlength=len(column)) + 1
    out = np.full(len(start) + len(column), END, dtype=np.uint64)
    out[np.arange(len(start)) + doc] = np.maximum(_hashed(data, start, stop - start), _U(2))
    return out, per_doc


def _hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of every word: its bytes eight at a time; words of hundreds of bytes one by one."""
    eights = np.ndarray((max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
    out = _mixed(size.astype(np.uint64) + _U(0x9E3779B97F4A7C15))
    left = np.flatnonzero(size <= 512)
    at = 0
    while len(left):
        chunk = eights[start[left] + at]
        rest = size[left] - at
        short = rest < 8
        chunk[short] &= (_U(1) << (_U(8) * rest[short].astype(np.uint64))) - _U(1)
        out[left] = _mixed(out[left] ^ chunk)
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(size > 512):
        out[i] = xxhash.xxh64_intdigest(data[start[i]:start[i] + size[i]].tobytes(), seed=int(size[i]) & 0xFFFF)
    return out


def discounts(counts_of_counts: list[int]) -> tuple[np.ndarray, int]:
    """Factor by count (index 0 unused) up to ``CUTOFF``, and up to which count anything is taken off.

    Good-Turing's factors for the largest cutoff at which all of them lie between 0 and 1; half a
    count where there is none.
    """
    n = counts_of_counts
    for k in range(CUTOFF, 0, -1):
        if min(n[:k + 1]) <= 0 or (k + 1) * n[k] >= n[0]:
            continue
        common = (k + 1) * n[k] / n[0]
        found = [((r + 1) * n[r] / (r * n[r - 1]) - common) / (1 - common) for r in range(1, k + 1)]
        if all(0 < d < 1 for d in found):
            return np.array([1.0, *found, *[1.0] * (CUTOFF - k)]), k
    return np.array([1.0, *[(r - 0.5) / r for r in range(1, CUTOFF + 1)]]), CUTOFF


@dataclass(frozen=True)
class Level:
    """What all slices must know of a level: discounts, and sums of the contexts that are dealt to several buckets."""

    factors: np.ndarray
    cutoff: int
    split: dict[int, tuple[int, tuple[int, ...], float]]
    last: bool = False

    def share(self, counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return self.factors[np.where(counts > CUTOFF, 0, counts)] * counts / totals

    def left(self, few: np.ndarray, plus: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """The mass of the words not seen; ``few`` has the words seen once, twice, up to ``CUTOFF`` times."""
        taken = (1 - self.factors[1:]) * np.arange(1, CUTOFF + 1)
        return (few @ taken + plus) / totals


@dataclass
class Model:
    slices: DataFrame
    id_col: str
    buckets: int
    grams: list[DataFrame] = field(default_factory=list)
    answers: list[DataFrame] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)
    train_tokens: int = 0
    train_words: int = 0


def _sliced(docs: DataFrame, id_col: str, text_col: str, train: Column) -> DataFrame:
    """Documents as slices: ids, which of them teach, tokens per document, tokens numbered within the slice, word hashes."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("train", T.ArrayType(T.BooleanType())),
        *T.StructType.fromDDL("sizes binary, tokens binary, words binary"),
    ])

    def run(batches):
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            batch = pa.Table.from_batches(held).combine_chunks()
            parts = [batch.column(i).combine_chunks() for i in range(3)]
            parts = [p.chunk(0) if isinstance(p, pa.ChunkedArray) else p for p in parts]
            found, sizes = tokens(parts[2])
            words, at = np.unique(found, return_inverse=True)
            one = [pa.ListArray.from_arrays(pa.array([0, len(p)], pa.int32()), p) for p in parts[:2]]
            packed = [pa.array([b], pa.binary()) for b in (pack(sizes), pack(at), _rising(words))]
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), *one, *packed], names=schema.names)

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES - size, side="right")))
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
                start = stop
                if size >= SLICE_BYTES or start < batch.num_rows:
                    yield closed()
                    made, held, size = made + 1, [], 0
        if held:
            yield closed()

    return rows.mapInArrow(run, schema)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """Written to the shared folder as a table bucketed by slice, so that joins by slice leave it in place."""
    spark, name = df.sparkSession, f"slices_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "slice").sortBy("slice").format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


@dataclass
class _Grams:
    """The different n-grams of a slice in the order of its request, and where each token stands in them."""

    places: np.ndarray
    at: np.ndarray
    context: np.ndarray
    word: np.ndarray
    total: np.ndarray
    split: np.ndarray
    bounds: np.ndarray
    runs: np.ndarray


class _Walk:
    """The tokens of a slice, with what is known of each after some levels."""

    def __init__(self, row: dict, model_buckets: int, train_tokens: int):
        self.buckets, self.train_tokens = model_buckets, train_tokens
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.words = _risen(row["words"])
        self.token = unpack(row["tokens"]).astype(np.int64)
        self.teaches = np.repeat(np.array(row["train"], dtype=bool), self.sizes)
        self.first = np.zeros(len(self.token), dtype=bool)
        self.first[np.cumsum(self.sizes) - self.sizes] = True
        self.level = 0
        self.p = np.ones(len(self.token))
        self.number = self.word = self.count = self.seen = None

    def grams(self) -> _Grams:
        """The n-grams of the next level whose contexts were seen in training."""
        if not self.level:
            bucket = ((self.words >> _U(32)) * _U(self.buckets)) >> _U(32)
            bounds = np.searchsorted(bucket, np.arange(self.buckets + 1, dtype=np.uint64))
            zero = np.zeros(len(self.words), dtype=np.uint64)
            return _Grams(np.arange(len(self.token)), self.token, zero, self.words, zero, zero == 0, bounds, _runs(zero, bounds))
        before = np.concatenate(([START], self.number[:-1])).astype(np.uint64)
        total = np.concatenate(([0], self.count[:-1])).astype(np.int64)
        if self.level == 1:
            before[self.first], total[self.first] = START, self.texts
        else:
            total[self.first] = 0
        places = np.flatnonzero(total > 0)
        context, word = before[places], self.word[places]
        kinds, rank = np.unique(word, return_inverse=True)
        order_of, context_rank = np.unique(context, return_inverse=True)
        key, at = np.unique(context_rank.astype(np.uint64) * _U(max(len(kinds), 1)) + rank.astype(np.uint64), return_inverse=True)
        context, word = order_of[key // _U(max(len(kinds), 1))], kinds[key % _U(max(len(kinds), 1))]
        of_gram = np.zeros(len(key), dtype=np.int64)
        of_gram[at] = total[places]
        parts = (of_gram * PARTS + self.train_tokens - 1) // max(self.train_tokens, 1)
        part = _mixed(word) % parts.astype(np.uint64) if len(parts) else word
        bucket = (_mixed(context + part * _U(0x9E3779B97F4A7C15)) % _U(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        turned = np.empty(len(order), dtype=np.int64)
        turned[order] = np.arange(len(order))
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        context = context[order]
        return _Grams(places, turned[at], context, word[order], of_gram[order], parts[order] > 1, bounds, _runs(context, bounds))

    def requests(self) -> list[tuple]:
        """Bucket, contexts, words, which contexts are split, training counts and lower probabilities."""
        g = self.grams()
        teaches = self.teaches[g.places]
        counts = np.bincount(g.at[teaches], minlength=len(g.word))
        lower = np.zeros(len(g.word))
        lower[g.at] = self.p[g.places]
        out = []
        for bucket in np.flatnonzero(np.diff(g.bounds)):
            cut = slice(g.bounds[bucket], g.bounds[bucket + 1])
            known = counts[cut] > 0
            packed_words = _rising(g.word[cut]) if not self.level else pack(g.word[cut])
            out.append((int(bucket), _rising(g.context[cut]), packed_words, pack(g.split[cut]), pack(counts[cut]),
                        _floats(lower[cut][known]) if self.level else b""))
        return out

    def answered(self, answers: list[dict], level: Level) -> None:
        """Goes up one level with the answers of all buckets."""
        g = self.grams()
        answers = sorted(answers, key=lambda a: a["bucket"])
        joined = lambda name, read, kind: np.concatenate([read(a[name]) for a in answers]) if answers else np.zeros(0, kind)
        counts = joined("counts", unpack, np.uint64).astype(np.int64)
        numbers = joined("numbers", unpack, np.uint64) if not level.last else np.zeros(len(counts), dtype=np.uint64)
        least = joined("least", unpack, np.uint64).astype(np.int64)
        few = joined("few", unpack, np.uint64).astype(np.float64).reshape(-1, CUTOFF)
        seen_below = joined("lower", _unfloats, np.float64)
        run_of = np.repeat(np.arange(len(g.runs)), np.diff(np.append(g.runs, len(g.word))))
        unseen = np.zeros(len(g.runs), dtype=bool)
        unseen[run_of[counts == 0]] = True
        below, rest = np.zeros(len(g.runs)), np.zeros((len(g.runs), CUTOFF))
        below[unseen], rest[unseen] = seen_below, few
        for run in np.flatnonzero(g.split[g.runs]) if level.split else ():
            least[run], rest[run], below[run] = level.split[int(g.context[g.runs[run]])]
        plus = (least > level.cutoff).astype(np.int64)
        total = (g.total[g.runs] if self.level else np.full(len(g.runs), self.train_tokens)) + plus
        backoff = level.left(rest, plus, np.maximum(total, 1))
        if self.level:
            backoff = np.divide(backoff, 1 - below, out=np.zeros(len(backoff)), where=below < 1)
        seen = np.zeros(len(counts))
        there = counts > 0
        seen[there] = level.share(counts[there], total[run_of[there]])
        p = np.where(there[g.at], seen[g.at], backoff[run_of][g.at] * self.p[g.places])
        self.p[g.places] = p
        self.number, self.count = np.zeros(len(self.token), dtype=np.uint64), np.zeros(len(self.token), dtype=np.int64)
        self.number[g.places], self.count[g.places] = numbers[g.at], counts[g.at]
        if not self.level:
            self.word, self.seen = self.number, self.count
            ends = np.flatnonzero(self.words == END)
            self.texts = int(counts[ends[0]]) if len(ends) else 0
        self.level += 1


def _runs(context: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a context begins, within its bucket."""
    new = np.zeros(len(context), dtype=bool)
    if len(context):
        new[0] = True
        new[1:] = context[1:] != context[:-1]
        new[bounds[bounds < len(context)]] = True
    return np.flatnonzero(new)


def _joined(model: Model) -> DataFrame:
    """Slices with the answers of all levels so far; only answers move."""
    out = model.slices
    for n, answers in enumerate(model.answers):
        fields = F.struct(*[c for c in answers.columns if c != "slice"])
        out = out.join(answers.groupBy("slice").agg(F.collect_list(fields).alias(f"answers_{n}")), "slice", "left")
    return out


def _walks(batches, buckets: int, train_tokens: int, levels: list[Level]):
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            walk = _Walk(row, buckets, train_tokens)
            for n, level in enumerate(levels):
                walk.answered(row[f"answers_{n}"] or [], level)
            yield row, walk


_REQUEST = "slice bigint, bucket int, context binary, word binary, split binary, counts binary, lower binary"
_ANSWER = pa.struct([("slice", pa.int64()), ("bucket", pa.int32()), *[(n, pa.binary()) for n in ("counts", "numbers", "least", "few", "lower")]])
_GRAMS = pa.struct([
    ("context", pa.int64()), ("split", pa.bool_()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
    ("numbers", pa.list_(pa.int64())), ("few", pa.list_(pa.int64())), ("lower", pa.float64()),
])
_REDUCED = (
    "answer struct<slice bigint, bucket int, counts binary, numbers binary, least binary, few binary, lower binary>, "
    "grams struct<context bigint, split boolean, words array<bigint>, counts array<bigint>, numbers array<bigint>, few array<bigint>, lower double>"
)


def _list(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int64)))


def _merged(buckets: int, lowest: bool, last: bool):
    """Adds up the requests of one bucket: its n-grams by context, and an answer to every slice."""

    def run(requests: pa.Table) -> pa.Table:
        rows = requests.sort_by("slice").to_pylist()
        bucket = rows[0]["bucket"]
        contexts = [_risen(r["context"]) for r in rows]
        words = [_risen(r["word"]) if lowest else unpack(r["word"]) for r in rows]
        counts = [unpack(r["counts"]).astype(np.int64) for r in rows]
        ends = np.cumsum([len(c) for c in counts])
        context, word, count = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
        split, lower = np.concatenate([unpack(r["split"]) for r in rows]) > 0, np.zeros(len(count))
        if not lowest:
            lower[count > 0] = np.concatenate([_unfloats(r["lower"]) for r in rows])
        kinds, rank = np.unique(word, return_inverse=True)
        owners, owner = np.unique(context, return_inverse=True)
        key, at = np.unique(owner.astype(np.uint64) * _U(len(kinds)) + rank.astype(np.uint64), return_inverse=True)
        owner, word = (key // _U(len(kinds))).astype(np.int64), kinds[key % _U(len(kinds))]
        total = np.zeros(len(key), dtype=np.int64)
        np.add.at(total, at, count)
        below = np.zeros(len(key))
        below[at[count > 0]] = lower[count > 0]
        seen = total > 0
        order = np.argsort(-total[seen], kind="stable") if lowest else np.arange(seen.sum())
        number = np.zeros(len(key), dtype=np.uint64)
        ranks = np.empty(len(order), dtype=np.uint64)
        ranks[order] = np.arange(len(order), dtype=np.uint64)
        number[seen] = ranks * _U(buckets) + _U(bucket + FIRST)
        number[~seen] = UNKNOWN
        few = np.stack([np.bincount(owner[total == r], minlength=len(owners)) for r in range(1, CUTOFF + 2)], axis=1)
        sums = np.bincount(owner[seen], weights=below[seen], minlength=len(owners)).astype(np.float64)
        least = np.where(few[:, :CUTOFF].any(axis=1), few[:, :CUTOFF].astype(bool).argmax(axis=1) + 1, CUTOFF + 1)
        answers = []
        for row, stop, size in zip(rows, ends, map(len, counts), strict=True):
            part = at[stop - size:stop]
            run_start = _runs(context[stop - size:stop], np.zeros(0, np.int64))
            run_owner = owner[part[run_start]]
            absent = np.add.reduceat(~seen[part], run_start) > 0
            answers.append({
                "slice": row["slice"], "bucket": bucket, "counts": pack(total[part]), "numbers": None if last else pack(number[part]),
                "least": pack(least[run_owner]), "few": pack(few[run_owner[absent], :CUTOFF].ravel()), "lower": _floats(sums[run_owner[absent]]),
            })
        held = np.bincount(owner[seen], minlength=len(owners))
        kept = np.flatnonzero(held)
        offsets = np.concatenate(([0], np.cumsum(held[kept])))
        divided = np.zeros(len(owners), dtype=bool)
        divided[np.searchsorted(owners, context[split])] = True
        table = pa.StructArray.from_arrays([
            pa.array(owners[kept].astype(np.int64)), pa.array(divided[kept]), _list(word[seen].view(np.int64), offsets), _list(total[seen], offsets),
            _list(number[seen] * (not last), offsets if not last else offsets * 0), _list(few[kept].ravel(), np.arange(len(kept) + 1) * (CUTOFF + 1)), pa.array(sums[kept]),
        ], fields=list(_GRAMS))
        first = pa.array([*answers, *[None] * len(kept)], _ANSWER)
        second = pa.concat_arrays([pa.nulls(len(answers), _GRAMS), table])
        return pa.Table.from_arrays([first, second], names=["answer", "grams"])

    return run


def _climbed(model: Model, last: bool) -> None:
    """Counts the next level, writes its n-grams and answers, and learns its discounts."""
    buckets, train_tokens, levels, lowest = model.buckets, model.train_tokens, list(model.levels), not model.levels

    def ask(batches):
        for row, walk in _walks(batches, buckets, train_tokens, levels):
            found = walk.requests()
            if found:
                columns = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), [pa.int32(), *[pa.binary()] * 5], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([row["slice"]] * len(found), pa.int64()), *columns],
                                                 names=["slice", "bucket", "context", "word", "split", "counts", "lower"])

    requests = _joined(model).mapInArrow(ask, _REQUEST)
    reduced = stored(requests.groupBy("bucket").applyInArrow(_merged(buckets, lowest, last), _REDUCED), f"grams-{len(levels) + 1}")
    grams = reduced.filter("grams is not null").select("grams.*")
    model.answers.append(reduced.filter("answer is not null").select("answer.*"))
    model.grams.append(grams)
    sums = [F.coalesce(F.sum(F.element_at("few", r)), F.lit(0)).alias(f"n{r}") for r in range(1, CUTOFF + 2)]
    if lowest:
        all_counts = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b)
        sums += [F.coalesce(F.sum(all_counts), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.size("counts")), F.lit(0)).alias("words")]
    found = grams.agg(*sums).head()
    if lowest:
        model.train_tokens, model.train_words = int(found["tokens"]), int(found["words"])
    factors, cutoff = discounts([int(found[f"n{r}"]) for r in range(1, CUTOFF + 2)])
    parts = (
        grams.filter("split").groupBy("context")
        .agg(*[F.sum(F.element_at("few", r)).alias(f"n{r}") for r in range(1, CUTOFF + 1)], F.sum("lower").alias("lower")).collect()
    )
    split = {}
    for row in parts:
        few = tuple(int(row[f"n{r}"]) for r in range(1, CUTOFF + 1))
        split[row["context"]] = (next((r for r, n in enumerate(few, 1) if n), CUTOFF + 1), few, row["lower"])
    if lowest:  # one context, dealt to all buckets by its words; without training rows it is empty
        split.setdefault(START, (CUTOFF + 1, (0,) * CUTOFF, 0.0))
    model.levels.append(Level(factors, cutoff, split, last))


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> Model:
    """Counts n-grams up to ``order`` in the rows for which ``train`` holds; :func:`scored` scores all rows."""
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    model = Model(_bucketed(_sliced(docs, id_col, text_col, train), buckets), id_col, buckets)
    for n in range(order):
        _climbed(model, n == order - 1)
    return model


def scored(model: Model) -> DataFrame:
    """``id, train, n_tokens, n_known, train_tokens, base_score, score`` of every document; scores are log10."""
    names = [model.id_col, *unused([model.id_col], "train", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    kind = model.slices.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField(names[0], kind), *T.StructType.fromDDL(
        ", ".join(f"`{n}` {t}" for n, t in zip(names[1:], ("boolean", "bigint", "bigint", "bigint", "double", "double"), strict=True)))])
    buckets, n, v, levels = model.buckets, model.train_tokens, model.train_words, list(model.levels)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row, walk = next(_walks([one], buckets, n, levels))
                starts = np.cumsum(walk.sizes) - walk.sizes
                add = lambda values: np.add.reduceat(values, starts)  # noqa: E731, B023
                arrays = [
                    one.column(one.schema.get_field_index("ids")).flatten(), pa.array(row["train"], pa.bool_()), pa.array(walk.sizes),
                    pa.array(add((walk.seen > 0).astype(np.int64))), pa.array(np.full(len(starts), n, dtype=np.int64)),
                    pa.array(add(np.log10((walk.seen + 0.1) / (n + 0.1 * (v + 1))))), pa.array(add(np.log10(walk.p))),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return _joined(model).mapInArrow(run, schema)


def contexts(model: Model, n: int) -> DataFrame:
    """``context, total, backoff`` of level ``n``: the number of the context, its occurrences, the weight of the level below."""
    level = model.levels[n - 1]
    few = [F.sum(F.element_at("few", r)) for r in range(1, CUTOFF + 1)]
    seen = F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b))
    rows = model.grams[n - 1].groupBy("context").agg(seen.alias("seen"), F.sum("lower").alias("lower"), F.array(*few).alias("few"))
    taken = [F.element_at("few", r) * float((1 - level.factors[r]) * r) for r in range(1, CUTOFF + 1)]
    none = [F.element_at("few", r) == 0 for r in range(1, level.cutoff + 1)]
    plus = F.when(none[0] if len(none) == 1 else F.forall(F.array(*none), lambda c: c), 1).otherwise(0)
    mass = (sum(taken[1:], taken[0]) + F.col("plus")) / F.col("total")
    rows = rows.withColumn("plus", plus).withColumn("total", F.col("seen") + F.col("plus"))
    return rows.select("context", "total", (mass / (1 - F.col("lower"))).alias("backoff"))


def ngrams(model: Model, n: int) -> DataFrame:
    """``context, word, number, count, p`` of level ``n``; words of the lowest level are hashes, those above numbers."""
    level = model.levels[n - 1]
    factor = F.when(F.col("count") > CUTOFF, 1.0).otherwise(F.element_at(F.array(*[F.lit(float(d)) for d in level.factors[1:]]), F.least("count", F.lit(CUTOFF)).cast("int")))
    rows = model.grams[n - 1].select("context", F.posexplode("words").alias("at", "word"), "counts", "numbers").select(
        "context", "word", F.get("numbers", F.col("at")).alias("number"), F.get("counts", F.col("at")).alias("count"))
    return rows.join(contexts(model, n).select("context", "total"), "context").select(
        "context", "word", "number", "count", (factor * F.col("count") / F.col("total")).alias("p"))
