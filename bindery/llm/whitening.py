"""Embedding whitening from covariances found by polarisation.

A pass over the vectors gives sums, and so the centre of every dimension. A second pass
aggregates squares only: of each centred dimension and of the sum of each pair of centred
dimensions. Since var(a + b) = var(a) + var(b) + 2 cov(a, b), differences of those
variances are the covariances, which are assembled for `eigh`.

Vectors are taken as whole numbers on a grid, and every sum is exact: tasks add up in
64-bit integers as far as those are proved to suffice and in Python's integers beyond;
partial sums travel as limbs of 32 bits that Spark adds as longs. So results do not depend
on how rows are dealt.

The centre that is taken off before squaring is the whole part of the mean, at most one
grid step below it. What is missing to the mean is the same for all rows, and its share is
taken off the sums exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindery.scratch import materialize

#: A grid value is floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Grid values beyond this are set to it, so that they stay longs.
LARGEST = 1 << 62
#: Limbs of 32 bits of a sum: 192 bits, for squares of 128 bits and 2^60 rows.
LIMBS = 6
#: Rows whose pair sums are squared at a time.
STEP_ROWS = 2_048
#: Eigenvalues below this share of the trace count as zero.
FLAT = 1e-12

_LIMB_COLUMNS = [f"limb{k}" for k in range(LIMBS)]
_SUMS = "a int, b int, " + ", ".join(f"{c} long" for c in _LIMB_COLUMNS)


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, sums of the grid values, components as rows, eigenvalues, trace.

    `covariance` is that of the grid values, rounded once to double.
    """

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    covariance: np.ndarray

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def usable(vector: str) -> str:
    """SQL condition: the vector is not null and holds no null or non-finite entry."""
    return (
        f"coalesce(forall(`{vector}`, c -> c is not null and not isnan(c) and abs(c) < double('infinity')), false)"
    )


def grid(vectors: pa.Array) -> np.ndarray:
    """Grid values of the vectors, a row each; they are of one length."""
    flat = vectors.flatten()
    scaled = np.floor(np.asarray(flat).astype(np.float64) * SCALE)
    wide = np.clip(scaled, -float(LARGEST), float(LARGEST - 1024))  # the next double below it
    return wide.astype(np.int64).reshape(len(vectors), -1) + SHIFT


def limbs_of(sums: list[int]) -> list[list[int]]:
    """The sums in limbs: all but the top one in 0 .. 2^32 - 1."""
    return [
        [(s >> (32 * k)) & 0xFFFFFFFF for s in sums] if k < LIMBS - 1 else [s >> (32 * k) for s in sums]
        for k in range(LIMBS)
    ]


def _row(names: list[tuple[int, int]], sums: list[int]) -> pa.RecordBatch:
    a, b = zip(*names)
    arrays = [pa.array(a, pa.int32()), pa.array(b, pa.int32())]
    arrays += [pa.array(x, pa.int64()) for x in limbs_of(sums)]
    return pa.RecordBatch.from_arrays(arrays, names=["a", "b", *_LIMB_COLUMNS])


def _added(partial: DataFrame) -> dict[tuple[int, int], int]:
    """The partial sums added up: as many entries as names, squares of the dimensions at most."""
    total = partial.groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in _LIMB_COLUMNS))
    return {(r.a, r.b): sum(r[c] << (32 * k) for k, c in enumerate(_LIMB_COLUMNS)) for r in total.collect()}


def exact(values: np.ndarray, largest: int) -> np.ndarray:
    """`values`, as Python integers if results up to `largest` need them."""
    return values if largest < 1 << 63 else values.astype(object)


def _sums(rows: DataFrame, dimensions: int) -> tuple[int, list[int]]:
    """Rows, and the sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = [0] * dimensions, 0
        for batch in batches:
            x = grid(batch.column(0))
            n += len(x)
            if len(x):
                x = exact(x, int(np.abs(x).max()) * len(x))
                sums = [s + int(v) for s, v in zip(sums, x.sum(axis=0))]
        yield _row([(-1, -1), *((i, i) for i in range(dimensions))], [n, *sums])

    found = _added(rows.mapInArrow(add, _SUMS))
    return found.get((-1, -1), 0), [found.get((i, i), 0) for i in range(dimensions)]


def _squares(rows: DataFrame, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of (y_a + y_b)^2 over rows, for a < b, and of y_a^2 as (a, a)."""
    dimensions = len(centre)
    names = [(a, b) for a in range(dimensions) for b in range(a, dimensions)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names), object)
        held, room = np.zeros(len(names), np.int64), (1 << 63) - 1
        for batch in batches:
            whole = grid(batch.column(0))
            for start in range(0, len(whole), STEP_ROWS):
                x = whole[start : start + STEP_ROWS]
                far = max(max(abs(int(v) - c) for v, c in zip(side, centre)) for side in (x.min(axis=0), x.max(axis=0)))
                most = 4 * far * far * len(x)
                if most >= 1 << 63:
                    y = x.astype(object) - np.array(centre, object)
                else:
                    y = x - np.array(centre, np.int64)
                y = np.ascontiguousarray(y.T)
                own = np.empty(len(names), y.dtype)
                at = 0
                for a in range(dimensions):
                    pair = y[a:] + y[a]
                    pair[0] = y[a]
                    own[at : at + len(pair)] = np.einsum("ij,ij->i", pair, pair) if y.dtype != object else (pair * pair).sum(axis=1)
                    at += len(pair)
                if y.dtype == object:
                    sums = sums + own
                    continue
                if most > room:
                    sums, held, room = sums + held.astype(object), np.zeros(len(names), np.int64), (1 << 63) - 1
                held, room = held + own, room - most
        sums = sums + held.astype(object)
        yield _row(names, [int(s) for s in sums])

    return _added(rows.mapInArrow(add, _SUMS))


def common_length(docs: DataFrame, vector: str) -> int:
    """The length that most usable vectors have, the longer of ties; 0 without any."""
    lengths = docs.where(usable(vector)).groupBy(F.size(vector).alias("length")).count()
    found = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return found[0] if found else 0


def _vectors(docs: DataFrame, vector: str, length: int) -> DataFrame:
    return docs.where(usable(vector)).where(F.size(vector) == length)


def fit_whitening(docs: DataFrame, vector: str = "embedding", length: int | None = None) -> Whitening | None:
    """Mean and covariance of all usable vectors, and its eigenvectors.

    Covariances have the divisor n. Vectors are usable if neither they nor an entry is
    null, NaN or infinite, and if they have `length` entries (the commonest by default);
    others are left out. None if there are none, or without a dimension. Repeated rows
    count as often as they occur; entries beyond the range of a long are set to its ends.

    A task holds `STEP_ROWS` vectors at a time beside its sums; it sends dimensions *
    (dimensions + 1) / 2 of them, and as many reach the driver, whatever the rows.
    """
    length = common_length(docs, vector) if length is None else length
    if not length:
        return None
    rows = _vectors(docs, vector, length).select(F.col(vector).cast("array<double>").alias("v"))
    n, sums = _sums(rows, length)
    if not n:
        return None
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    squares = _squares(rows, centre)
    variance = [n * squares[a, a] - rest[a] ** 2 for a in range(length)]  # times n^2
    covariance = np.empty((length, length))
    for a in range(length):
        covariance[a, a] = variance[a] / n**2
        for b in range(a + 1, length):
            together = n * squares[a, b] - (rest[a] + rest[b]) ** 2
            covariance[a, b] = covariance[b, a] = (together - variance[a] - variance[b]) / (2 * n**2)
    values, vectors = np.linalg.eigh(covariance)
    falling = np.argsort(-values, kind="stable")
    return Whitening(n, sums, vectors.T[falling], values[falling], sum(variance) / n**2, covariance)


def whiten(
    docs: DataFrame,
    model: Whitening | None,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """`vec_id, deviation, whitened` for every usable vector, repeated rows included.

    `deviation` (decimal) is the sum over dimensions of (n x - S)^2, exact; null past 38
    digits. `whitened` are the first components of x - S / n over the root of their
    eigenvalue, or null where the eigenvalue is zero. Null identifiers stay. Without a
    model there are no rows. Other columns are not read.
    """
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    if model is None:
        return docs.sparkSession.createDataFrame([], schema)
    n, sums, count = model.n, model.sums, min(components, model.dimensions)
    flat = model.eigenvalues[:count] <= FLAT * max(model.trace, np.finfo(float).tiny)
    scale = np.sqrt(np.where(flat, 1.0, model.eigenvalues[:count]))
    matrix = (model.components[:count] / scale[:, None]).T.copy()
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    share = np.array([r / n for r in rest])
    constant = sum(r * r for r in rest)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x = grid(batch.column(1))
            far = max(abs(int(x.min()) - max(centre)), abs(int(x.max()) - min(centre)))
            wide = exact(x, model.dimensions * far * max(far, n))
            y = wide - np.array(centre, wide.dtype)
            # (n x - S)^2 = (n y - rest)^2, opened up: whole rows in longs, n^2 beyond them.
            squares, mixed = (y * y).sum(axis=1), (y * np.array(rest, y.dtype)).sum(axis=1)
            far_off = [n * n * a - 2 * n * b + constant for a, b in zip(squares.tolist(), mixed.tolist())]
            deviation = [v if v < 10**38 else None for v in far_off]
            w = (y.astype(np.float64) - share) @ matrix
            mask = np.broadcast_to(flat, w.shape).reshape(-1)
            values = pa.array(w.reshape(-1), pa.float64(), mask=mask)
            borders = pa.array(np.arange(len(x) + 1, dtype=np.int32) * count)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(deviation, pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(borders, values),
                ],
                names=["vec_id", "deviation", "whitened"],
            )

    rows = _vectors(docs, vector, model.dimensions).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")
    )
    return rows.mapInArrow(project, schema)


def identity_error(rows: DataFrame, components: int) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity.

    Measured on the rows of `whiten`, by Spark's centred co-moments. Components with
    eigenvalue zero, which are null, are left out; None if no other is there.
    """
    w = [F.get("whitened", i) for i in range(components)]
    errors = [
        F.abs(F.covar_pop(w[i], w[j]) - float(i == j)).alias(f"c{i}_{j}")
        for i in range(components)
        for j in range(i, components)
    ]
    found = [e for e in rows.agg(*errors).first() if e is not None] if errors else []
    return max(found, default=None)


def whitened_components(
    docs: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and component, with the figures of the fit.

    `vec_id, component` (from 1), `n, deviation, whitened, explained, identity_error`.
    See `fit_whitening` and `whiten` for nulls, repeated rows and vectors of odd lengths;
    an empty table gives no rows.
    """
    model = fit_whitening(docs, vector)
    rows = whiten(docs, model, vec_id, vector, components)
    if model is not None:
        rows = materialize(rows, "whitened")
    count = min(components, model.dimensions) if model else 0
    explained = [float(e / model.trace) if model.trace else 0.0 for e in model.eigenvalues[:count]] if model else []
    share = F.get(F.array(*map(F.lit, explained)), F.col("place")) if explained else F.lit(None).cast("double")
    error = identity_error(rows, count) if model else None
    return rows.select(
        "vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened")
    ).select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        "deviation",
        "whitened",
        share.alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
