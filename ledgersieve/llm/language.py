"""Language identification as a mixture of languages.

Each language is a distribution over hashed byte trigrams of folded text.  A document is taken as
drawn from a mixture of languages; expectation-maximisation estimates the proportions from the
trigrams' likelihoods.  The set of languages is chosen by penalised likelihood: sets grow along
the order of the full estimate, and a further language must gain more than the penalty.

Training counts the trigrams of labelled rows.  It may stop at ``TRAIN_DOCS`` rows per language,
chosen by a hash of the text: the bound is a parameter, and prediction always covers whole texts of
all rows.  The model has ``BUCKETS`` numbers per language, however large the corpus is.

Defined results: ``und`` with score 0 for null texts, for texts without a letter and where no
language was learned; equal proportions go to the language that is first by name; rows without a
label teach nothing; repeated rows count as often as they stand; other columns pass through
untouched, save those of the names that are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import slices, unused

BUCKETS = 1 << 16
#: Labelled rows per language that training reads, in expectation.
TRAIN_DOCS = 20_000
#: Bytes of text that are estimated together with up to 16 languages; fewer with more.
SLICE_BYTES = 1 << 20
ROUNDS = 12
#: Overlapping trigrams repeat each letter three times, so the penalty per language is three times the usual one.
PENALTY = 3.0
UNKNOWN = "und"

_FOLD = np.zeros(256, dtype=np.uint32)
for _b in range(256):
    if 0x61 <= _b <= 0x7A:
        _FOLD[_b] = _b - 0x60
    elif 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b - 0x40
    elif _b >= 0x80:
        _FOLD[_b] = _b - 0x80 + 27
_ASCII_LETTER = np.array([chr(b).isalpha() and b < 0x80 for b in range(256)])


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a gap before, between and behind, and where each text starts and ends."""
    parts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 2)
    data = np.frombuffer(b"\n" + b"\n\n".join(parts) + b"\n", dtype=np.uint8)
    return data, np.concatenate(([0], ends))


def _grams(data: np.ndarray) -> np.ndarray:
    """Trigram bucket at each byte but the last two; trigrams of separators alone are bucket 0."""
    s = _FOLD[data]
    code = (s[:-2] * np.uint32(160) + s[1:-1]) * np.uint32(160) + s[2:]
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(16)
    bucket[(s[1:-1] == 0) & ((s[:-2] == 0) | (s[2:] == 0))] = 0
    return bucket


def _counted(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of the distinct trigrams of every text, in row order."""
    data, bounds = _texts(column)
    if len(data) < 3:
        return (np.empty(0, np.int64),) * 3
    grams = _grams(data)
    row = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))[: len(grams)]
    keys = (row << np.uint64(16)) | grams
    keys = np.sort(keys[grams != 0])
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    counts = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    return (keys >> np.uint64(16)).astype(np.int64), (keys & np.uint64(BUCKETS - 1)).astype(np.int64), counts


def _has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if _ASCII_LETTER[np.frombuffer(text, dtype=np.uint8)].any():
        return True
    return any(map(str.isalpha, text.decode()))


class Model:
    """Trigram probabilities per language."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        smooth = 0.5
        self.p = ((counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * BUCKETS)).T.astype(np.float32).copy()

    def mixtures(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Proportions per text and language (rows of zeros without a trigram), and mean log-likelihood per trigram."""
        n, k = len(column), len(self.languages)
        share = np.zeros((n, k))
        fit = np.zeros(n)
        row, gram, count = _counted(column)
        if not len(row) or not k:
            return share, fit
        starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        texts = row[starts]
        sizes = np.add.reduceat(count, starts)
        p = self.p[gram]
        sets = _Sets(p, count.astype(np.float32), starts, sizes)
        share[texts], log_likelihood = sets.chosen()
        fit[texts] = log_likelihood / sizes
        return share, fit


class _Sets:
    """Expectation-maximisation over the texts of one batch, and the choice of each text's languages."""

    def __init__(self, p: np.ndarray, count: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.p, self.count, self.starts, self.sizes = p, count, starts, sizes
        self.lengths = np.diff(np.concatenate((starts, [len(count)])))

    def em(self, share: np.ndarray, only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after the rounds, and log-likelihoods; languages that start at zero stay there."""
        p, count, starts, sizes, lengths = self.p, self.count, self.starts, self.sizes, self.lengths
        if only is not None:
            entries = np.repeat(only, lengths)
            p, count, sizes, lengths = p[entries], count[entries], sizes[only], lengths[only]
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        share = share.astype(np.float32)
        for _ in range(ROUNDS):
            q = p * np.repeat(share, lengths, axis=0)
            q *= (count / q.sum(axis=1))[:, None]
            share = np.add.reduceat(q, starts, axis=0) / sizes[:, None].astype(np.float32)
        total = (p * np.repeat(share, lengths, axis=0)).sum(axis=1)
        return share, np.add.reduceat(count * np.log(total), starts).astype(np.float64)

    def chosen(self) -> tuple[np.ndarray, np.ndarray]:
        """The set of languages with the least penalised likelihood, among the leading ones of the full estimate.

        The full estimate bounds the likelihood of all sets, so texts for which even that bound does
        not pay for a second language need no further estimate.
        """
        n, k = len(self.starts), self.p.shape[1]
        alone = np.add.reduceat(self.count[:, None] * np.log(self.p), self.starts, axis=0).astype(np.float64)
        full, bound = self.em(np.full((n, k), 1.0 / k))
        first = alone.argmax(axis=1)
        best = np.zeros((n, k), dtype=np.float32)
        best[np.arange(n), first] = 1.0
        likelihood = alone[np.arange(n), first]
        price = PENALTY * np.log(np.maximum(self.sizes, 2)) / 2
        score = likelihood - price
        order = np.argsort(-full, axis=1, kind="stable")
        for size in range(2, k + 1):
            worth = bound - size * price > score
            if not worth.any():
                break
            start = np.zeros((int(worth.sum()), k))
            np.put_along_axis(start, order[worth][:, :size], 1.0 / size, axis=1)
            share, reached = self.em(start, worth)
            better = reached - size * price[worth] > score[worth]
            at = np.flatnonzero(worth)[better]
            best[at], likelihood[at] = share[better], reached[better]
            score[at] = reached[better] - size * price[at]
        return best, likelihood


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from rows with a label; at most ``train_docs`` per language, in expectation, by a hash of the text."""
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    per_language = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    known = per_language.collect()  # a row per language
    sizes = {r["lang"]: r["n"] for r in sorted(known, key=lambda r: r["lang"])}
    languages = list(sizes)
    if not languages:
        return Model([], np.zeros((0, BUCKETS)))
    share = F.element_at(F.create_map(*[x for name, n in sizes.items() for x in (F.lit(name), F.lit(min(1.0, train_docs / n)))]), F.col("lang"))
    draw = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30)
    numbered = F.array_position(F.array(*[F.lit(name) for name in languages]), F.col("lang")) - 1
    taught = rows.filter((draw < share)).select(numbered.cast("int").alias("at"), "text")

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        for batch in slices(batches, 1):
            row, gram, n = _counted(batch.column(1))
            at = batch.column(0).to_numpy()[row]
            np.add.at(total, (at, gram), n)
        at, gram = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at * BUCKETS + gram), pa.array(total[at, gram])], names=["cell", "n"])

    cells = taught.mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(len(languages) * BUCKETS)
    found = cells.toArrow()
    counts[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return Model(languages, counts.reshape(len(languages), BUCKETS))


ADDED = ("lang_pred", "score", "languages", "shares", "fit")
_TYPES = ("string", "double", "array<string>", "array<double>", "double")


def identified(docs: DataFrame, model: Model, text_col: str = "text", names: list[str] | tuple[str, ...] = ADDED) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (share of that language), ``languages`` and ``shares`` (the chosen set), ``fit``."""
    names = list(names)
    added = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in zip(names, _TYPES, strict=True)))
    docs = docs.drop(*[c for c in docs.columns if c in names])
    at = docs.columns.index(text_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        for batch in slices(batches, at, SLICE_BYTES * 16 // max(16, len(model.languages))):
            texts = batch.column(at)
            share, fitted = model.mixtures(texts)
            letters = [_has_letter(t.as_py()) for t in texts.cast(pa.binary())]
            pred, score, chosen, shares, fits = [], [], [], [], []
            for row, letter, value in zip(share, letters, fitted, strict=True):
                if letter and not row.any() and model.languages:
                    row = np.full(len(row), 1 / len(row))
                known = letter and row.any()
                order = [int(i) for i in np.argsort(-row, kind="stable") if row[i] > 0] if known else []
                pred.append(model.languages[order[0]] if known else UNKNOWN)
                score.append(float(min(row[order[0]], 1.0)) if known else 0.0)
                chosen.append([model.languages[i] for i in order])
                shares.append([float(row[i]) for i in order])
                fits.append(float(value) if known else None)
            arrays = [
                pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.list_(pa.string())),
                pa.array(shares, pa.list_(pa.float64())), pa.array(fits, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)).cast("int")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with their own columns, that have a language which makes up ``least`` of them."""
    names = unused(docs.columns, *ADDED)
    found = identified(docs, model, text_col, names)
    return found.filter((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) >= least)).select(*docs.columns)
