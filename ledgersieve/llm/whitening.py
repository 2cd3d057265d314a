"""Whitening of embeddings with components found by FEAST contour integration.

Entries become whole numbers ``floor(64 c) + 1000000``, so counts, sums and second moments are
exact and do not depend on the order in which tasks add.  The fit list is each distinct vector
once.  Its second moments are taken of differences to the rounded mean; what rounding left over is
taken out in whole numbers, so the covariance is that of exactly centred vectors, rounded once.

Components come from the spectrum in slices.  Inertia counts (pivots of a symmetric elimination of
``V - sI``) tell how many eigenvalues lie above a shift, and shifts are set in gaps until a slice
holds few.  Slices are independent, so each is solved in a task of its own: a random block is
projected on the slice's eigenvectors by quadrature of ``(zI - V)^-1`` over a circle around the
slice, Rayleigh-Ritz extracts pairs, and the step repeats until residuals reach double precision
and as many values lie inside as the inertia counts say.  A slice that misses one starts again with
a wider block.

Tasks send sums, and the driver holds ``d * d`` numbers for ``d`` dimensions, however many rows.

Defined results: rows whose vector is null or holds a null, a non-finite entry or one beyond
2^53 / 64 (which no double holds to a unit) are dropped; the dimension is the most frequent length
(the larger one on a tie), vectors of other lengths are of no common space and dropped, empty ones
too; repeated rows are projected each, and fitted once; components without variance beyond
rounding are left out, so fewer than asked for may come; equal eigenvalues have no order of their
own, a fixed start decides; a deviation beyond a long is null; an empty table, or one with a single
distinct vector, gives no rows.  Other columns are not carried; where the id's name is that of an
added column, the added one gets underscores in front.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgersieve.llm.common import stored, unused

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Eigenvalues per slice at most, unless they are too close to be told apart.
PER_SLICE = 8
NODES = 8
ROWS = 4096
SEED = 20

_EPS = float(np.finfo(np.float64).eps)


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id, x``: whole-number vectors of the rows that can be used."""
    usable = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < float(1 << 53), F.lit(False)))
    whole = F.transform(vector_col, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))
    return vectors.filter(F.col(vector_col).isNotNull() & usable & (F.size(vector_col) > 0)).select(id_col, whole.alias(unused([id_col], "x")[0]))


def _matrix(batch: pa.RecordBatch, at: int, width: int) -> np.ndarray:
    return batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(whole: np.ndarray) -> np.ndarray:
    """Exact ``whole.T @ whole``: by floating-point products where these are exact, else by whole numbers of any size."""
    top = int(np.abs(whole).max(initial=0)) ** 2 * len(whole)
    if top < 1 << 53:
        part = whole.astype(np.float64)
        return (part.T @ part).astype(np.int64)
    if top >= 1 << 62:
        whole = whole.astype(object)
    return whole.T @ whole


def _summed(vectors: DataFrame, cells) -> dict[int, int]:
    """Whole numbers by cell: ``cells(batches)`` gives those of one task, Spark adds them up."""

    def run(batches):
        total = cells(batches)
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), values], names=["cell", "n"])

    added = vectors.mapInArrow(run, "cell int, n decimal(38,0)").groupBy("cell").agg(F.sum("n").alias("n"))
    return {r["cell"]: int(r["n"]) for r in added.collect()}


def _sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    def cells(batches):
        total = None
        for batch in batches:
            x = _matrix(batch, 0, width)
            for at in range(0, len(x), ROWS):
                part = x[at:at + ROWS]
                own = [len(part), *map(int, part.sum(axis=0) if np.abs(part).max(initial=0) < 1 << 50 else part.astype(object).sum(axis=0))]
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        return total

    found = _summed(vectors, cells)
    return found.get(0, 0), [found.get(i + 1, 0) for i in range(width)]


def _covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of exactly centred vectors, divisor ``n``, every entry rounded once."""
    width = len(sums)
    middle = [(2 * s + n) // (2 * n) for s in sums]
    upper = np.triu_indices(width)

    def cells(batches):
        total, centre = None, np.array(middle, dtype=np.int64)
        for batch in batches:
            x = _matrix(batch, 0, width)
            for at in range(0, len(x), ROWS):
                own = _moments(x[at:at + ROWS] - centre)[upper].astype(object)
                total = own if total is None else total + own
        return total

    found = _summed(vectors, cells)
    rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((width, width))
    for cell, (i, j) in enumerate(zip(*upper, strict=True)):
        out[i, j] = out[j, i] = (n * found[cell] - rest[i] * rest[j]) / (n * n)
    return out


def below(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues lie below ``shift``: by inertia, negative pivots of a symmetric elimination."""
    a = matrix - shift * np.eye(len(matrix))
    least = (1 + 17 ** 0.5) / 8
    count = 0
    while len(a):
        size = np.abs(a)
        i = int(np.argmax(np.diag(size)))
        r, s = np.unravel_index(int(np.argmax(np.triu(size, 1))), a.shape)
        if size[i, i] == 0 and size[r, s] == 0:
            break
        pivot = [i] if size[i, i] >= least * size[r, s] else [int(r), int(s)]
        # A block of two is taken only where its diagonal is small, so one of its eigenvalues is negative.
        count += int(a[i, i] < 0) if len(pivot) == 1 else 1
        rest = np.delete(np.arange(len(a)), pivot)
        side = a[np.ix_(rest, pivot)]
        a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(a[np.ix_(pivot, pivot)], side.T)
        a = (a + a.T) / 2
    return count


def slices_of(matrix: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """``low, high, count`` from the top of the spectrum down, until ``wanted`` eigenvalues are covered."""
    top = float(np.abs(matrix).sum(axis=1).max()) * (1 + 8 * _EPS)
    floor = len(matrix) * _EPS * top
    if top == 0:
        return []
    top += floor

    def gap(low: float, high: float) -> float:
        """A shift near the middle with no eigenvalue close by, if there is one."""
        width = high - low
        for step in (0.0, 0.07, -0.07, 0.15, -0.15, 0.22, -0.22, 0.3, -0.3):
            at = low + (0.5 + step) * width
            if below(matrix, at - 0.02 * width) == below(matrix, at + 0.02 * width):
                return at
        return low + 0.5 * width

    found, covered = [], 0
    todo = [(floor, top, below(matrix, floor), len(matrix))]
    while todo and covered < wanted:
        low, high, under, all_under = todo.pop()
        count = all_under - under
        if not count:
            continue
        if count > PER_SLICE and high - low > 64 * floor:
            at = gap(low, high)
            parted = below(matrix, at)
            todo += [(low, at, under, parted), (at, high, parted, all_under)]
        else:
            found.append((low, high, count))
            covered += count
    return found


def contour(matrix: np.ndarray, low: float, high: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues in ``low:high`` and their unit vectors, as columns."""
    size, norm = len(matrix), float(np.abs(matrix).sum(axis=1).max())
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    turns = np.exp(1j * np.pi / 2 * (1 - points))
    block = min(size, 2 * count + 4)
    while True:
        basis = np.random.default_rng(SEED).standard_normal((size, block))
        for _ in range(40):
            filtered = np.zeros_like(basis)
            for turn, weight in zip(turns, weights, strict=True):
                shifted = (centre + radius * turn) * np.eye(size) - matrix
                filtered += weight / 4 * (radius * turn * np.linalg.solve(shifted, basis.astype(complex))).real
            basis, _ = np.linalg.qr(filtered)
            values, turned = np.linalg.eigh(basis.T @ matrix @ basis)
            basis = basis @ turned
            inside = (values > low) & (values <= high)
            off = np.linalg.norm(matrix @ basis - basis * values, axis=0)
            if inside.sum() == count and off[inside].max(initial=0.0) <= 4 * size * _EPS * norm:
                return values[inside], basis[:, inside]
        if block == size:
            raise ArithmeticError(f"{int(inside.sum())} eigenvalues found between {low} and {high}, inertia counts {count}")
        block = min(size, 2 * block)


@dataclass(frozen=True)
class Model:
    """``n`` vectors with ``sums``; eigenvalues falling, components as columns; ``total`` is the trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    total: float
    identity_error: float

    @property
    def weights(self) -> np.ndarray:
        return self.components / np.sqrt(self.values)


def _components(spark, matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading components: every slice of the spectrum is solved in a task of its own."""
    width, parts = len(matrix), slices_of(matrix, wanted)
    if not parts:
        return np.zeros(0), np.zeros((width, 0))

    def solve(batches):
        for batch in batches:
            for low, high, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values, vectors = contour(matrix, low, high, count)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(vectors.T.tolist(), pa.list_(pa.float64()))], names=["value", "vector"])

    rows = spark.createDataFrame(parts, "low double, high double, n int").repartition(len(parts))
    found = rows.mapInArrow(solve, "value double, vector array<double>").collect()
    if len(found) != sum(count for _, _, count in parts):
        raise ArithmeticError(f"{len(found)} components, inertia counts {sum(count for _, _, count in parts)}")
    kept = sorted(found, key=lambda r: (-r["value"], r["vector"]))[:wanted]
    vectors = np.array([r["vector"] for r in kept]).T
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return np.array([r["value"] for r in kept]), vectors * signs


def _projected(x: np.ndarray, model_n: int, sums: list[int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n x - S`` in whole numbers, and the whitened rows."""
    if int(np.abs(x).max(initial=0)) * model_n + max(map(abs, sums)) < 1 << 62:
        off = x * np.int64(model_n) - np.array(sums, dtype=np.int64)
        centred = off / model_n
    else:
        off = x.astype(object) * model_n - np.array(sums, dtype=object)
        centred = (off / model_n).astype(np.float64)
    return off, centred @ weights


def _identity_error(vectors: DataFrame, n: int, sums: list[int], weights: np.ndarray) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, measured on the rows."""
    width, k = weights.shape

    def run(batches):
        total = np.zeros((k + 1, k))
        for batch in batches:
            x = _matrix(batch, 0, width)
            for at in range(0, len(x), ROWS):
                _, white = _projected(x[at:at + ROWS], n, sums, weights)
                total += np.vstack([white.T @ white, white.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["cell", "v"])

    cells = vectors.mapInArrow(run, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((k + 1) * k)
    total[[r["cell"] for r in cells]] = [r["v"] for r in cells]
    total = total.reshape(k + 1, k) / n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of what :func:`scaled` gave; ``None`` where no component has variance."""
    x = rows.columns[1]
    vectors = stored(rows.select(F.col(x).alias("x")).distinct(), "whitening")
    widths = vectors.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = widths.orderBy(F.desc("n"), F.desc("width")).head()
    if width is None:
        return None
    vectors = vectors.filter(F.size("x") == width["width"])
    n, sums = _sums(vectors, width["width"])
    matrix = _covariance(vectors, n, sums)
    values, parts = _components(rows.sparkSession, matrix, min(components, len(sums)))
    if not len(values):
        return None
    error = _identity_error(vectors, n, sums, parts / np.sqrt(values))
    return Model(n, sums, values, parts, float(np.trace(matrix)), error)


def whitened(rows: DataFrame, model: Model | None) -> DataFrame:
    """A row per vector and component: ``component, n, deviation, whitened, explained, identity_error``."""
    id_col, x = rows.columns
    at, n, deviation, white, explained, error = unused([id_col], "component", "n", "deviation", "whitened", "explained", "identity_error")
    fields = T.StructType.fromDDL(f"`{at}` int, `{n}` bigint, `{deviation}` bigint, `{white}` double, `{explained}` double, `{error}` double")
    if model is None:
        return rows.sparkSession.createDataFrame([], T.StructType([rows.schema[id_col], *fields]))
    sums, size, weights = model.sums, model.n, model.weights
    rows = rows.filter(F.size(x) == len(sums))

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                off, values = _projected(_matrix(part, 1, len(sums)), size, sums, weights)
                if int(np.abs(off).max(initial=0)) ** 2 * len(sums) >= 1 << 62:
                    off = off.astype(object)
                squares = [int(v) if v < 1 << 63 else None for v in (off * off).sum(axis=1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(squares, pa.int64()), pa.array(values.tolist(), pa.list_(pa.float64()))], names=["c0", "c1", "c2"])

    kinds = [rows.schema[id_col].dataType, T.LongType(), T.ArrayType(T.DoubleType())]
    projected = rows.mapInArrow(run, T.StructType([T.StructField(f"c{i}", kind) for i, kind in enumerate(kinds)]))
    shares = F.array(*[F.lit(float(v / model.total)) for v in model.values])
    return projected.select("c0", "c1", F.posexplode("c2").alias("k", "v")).select(
        F.col("c0").alias(id_col), (F.col("k") + 1).alias(at), F.lit(size).cast("bigint").alias(n), F.col("c1").alias(deviation), F.col("v").alias(white),
        F.get(shares, F.col("k")).alias(explained), F.lit(model.identity_error).alias(error),
    )
