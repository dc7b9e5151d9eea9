"""Whitening of vectors: leading principal components by Chebyshev-filtered subspace iteration.

Entries become whole numbers ``x = floor(SCALE * c) + SHIFT``. The covariance V of the distinct
x-vectors is never formed: V times a block of vectors is one pass over the data, in which each
task centres its rows, multiplies them by the block and adds up ``X'(XQ)``. A Chebyshev
polynomial of V, built by its three-term recurrence from such passes, grows what lies above the
block's smallest Ritz value and damps the rest. QR and a Rayleigh-Ritz step follow, and rounds
go on until every wanted pair is certified: the residual norm, measured on the data, is down to
rounding (``CERTIFIED`` times the largest eigenvalue), or has stopped falling below ``ENOUGH``
times it. A round's last product also serves the next round's first step.

The driver holds blocks of dimension x ``3 * components``; partial sums of tasks are added up by
Spark. Sums of x, and the deviation, are exact whole numbers.

Defined cases: rows whose vector is null, empty or holds null or non-finite entries are dropped;
of the lengths that vectors have, only the most frequent takes part (the longest, if several
are), since a covariance joins vectors of one length; ``floor(SCALE * c)`` stays within
+-``LARGEST``; equal vectors count once in the fit, and every row, repeated ones and those with a
null id too, gets its result; components without variance (below ``FLAT`` of the trace) can't be
whitened and are left out, so that a table of equal vectors, and an empty one, give no rows; a
deviation that no long can hold is null; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 48
COMPONENTS = 16
#: Vectors of the block for each component asked for.
BLOCK = 3
#: Greatest degree of the filter, and how far it may set wanted vectors apart from each other.
DEGREE, SPREAD = 12, math.log(1e9)
CERTIFIED, ENOUGH, FLAT = 2e-15, 1e-11, 1e-9
ROUNDS = 200
#: Entries of a slice of rows that a task holds as doubles at once.
SLICE = 1 << 20

OUTPUT = (
    "vec_id long, component int, n long, deviation long, whitened double, explained double, "
    "identity_error double"
)


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int]:
    """``(vec_id, x)`` of the rows that take part, and the length of their vectors."""
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("c")
    )
    fine = F.forall("c", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.filter(F.col("c").isNotNull() & fine)
    lengths = rows.filter(F.size("c") > 0).groupBy(F.size("c").alias("d")).count()
    usual = lengths.agg(F.max_by("d", F.struct("count", "d"))).first()[0] or 0
    bounds = F.lit(float(-LARGEST)), F.lit(float(LARGEST))
    x = F.transform(
        "c",
        lambda v: F.floor(F.greatest(bounds[0], F.least(bounds[1], v * F.lit(float(SCALE)))))
        + F.lit(SHIFT).cast("long"),
    )
    return rows.filter(F.size("c") == usual).select("vec_id", x.alias("x")), usual


def _blocks(column: pa.ListArray, d: int) -> Iterator[np.ndarray]:
    """Rows of a column of vectors, as slices of bounded size."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, SLICE // d)
    for at in range(0, len(rows), step):
        yield rows[at : at + step]


@dataclass
class Centre:
    """The mean of ``n`` vectors with sums ``total``: a whole part and a fraction."""

    n: int
    total: list[int]

    def __post_init__(self):
        self.whole = np.array([s // self.n for s in self.total], np.int64)
        self.rest = np.array([s % self.n / self.n for s in self.total])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(float) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sums of ``(n * x - S) ** 2``."""
        off = x - self.whole  # n * x - S = n * off - S % n
        below = np.array([s % self.n for s in self.total], np.int64)
        most = (float(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 2.0**62:
            return ((off * self.n - below) ** 2).sum(axis=1).tolist()
        sums = [
            sum((int(o) * self.n - int(b)) ** 2 for o, b in zip(row, below, strict=True))
            for row in off
        ]
        return [s if s < 1 << 63 else None for s in sums]


def _sums(d: int):
    """Exact sums of x by dimension; the number of rows stands at ``d``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (d + 1)
        for batch in batches:
            for x in _blocks(batch.column(0), d):
                for k in range(0, len(x), 8192):  # so that no sum of a slice overflows
                    part = x[k : k + 8192]
                    sums = [a + b for a, b in zip(sums, [*part.sum(axis=0).tolist(), len(part)], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d + 1), pa.int32()), pa.array(map(str, sums), pa.string())],
            names=["i", "v"],
        )

    return run


def _products(d: int, centre: Centre, q: np.ndarray):
    """``X'(XQ)`` of centred rows, with their sum of squares behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(q.shape), 0.0
        for batch in batches:
            for x in map(centre.centred, _blocks(batch.column(0), d)):
                sums += x.T @ (x @ q)
                squares += float(np.einsum("ij,ij->", x, x))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(sums.size + 1), pa.int32()),
                pa.array(np.append(sums.ravel(), squares), pa.float64()),
            ],
            names=["i", "v"],
        )

    return run


def _outer(d: int, centre: Centre, axes: np.ndarray):
    """``Z'Z`` and the sums of Z for whitened rows Z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        sums = np.zeros((k + 1, k))
        for batch in batches:
            for x in map(centre.centred, _blocks(batch.column(0), d)):
                z = x @ axes
                sums += np.vstack([z.T @ z, z.sum(axis=0)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel(), pa.float64())],
            names=["i", "v"],
        )

    return run


def _added(fit: DataFrame, partial) -> np.ndarray:
    """What the tasks found, added up by place."""
    parts = fit.mapInArrow(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    rows = parts.toArrow()
    out = np.zeros(rows.num_rows)
    out[rows.column("i").to_numpy()] = rows.column("v").to_numpy()
    return out


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residual: float
    passes: int


def filtered(product, block: np.ndarray, image: np.ndarray, bound: float, top: float, degree: int):
    """A scaled Chebyshev polynomial of V applied to ``block``, small on [0, ``bound``] and about
    1 at ``top``. ``image`` is V times the block."""
    half = bound / 2
    first = half / (top - half)
    sigma, scale = first, first
    last, now = block, (image - half * block) * (sigma / half)
    for _ in range(degree - 1):
        scale = 1 / (2 / first - sigma)
        last, now = now, (product(now) - half * now) * (2 * scale / half) - sigma * scale * last
        sigma = scale
    return now


def leading(product, d: int, components: int, trace: float, seed: int = 7) -> Spectrum:
    """The leading eigenpairs of the matrix V that ``product`` multiplies by, certified."""
    want, k = min(components, d), min(d, BLOCK * components)
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.normal(size=(d, k)))[0]
    passes, best, waited = 0, math.inf, 0

    def counted(q: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return product(q)

    for _ in range(ROUNDS):
        image = counted(block)
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        own = int(np.sum(values[:want] > FLAT * trace))  # those that can be whitened
        off = np.linalg.norm(image[:, :own] - block[:, :own] * values[:own], axis=0)
        residual = float(off.max(initial=0) / max(values[0], 1e-300))
        waited = 0 if residual < best / 2 else waited + 1
        best = min(best, residual)
        if residual <= CERTIFIED or residual <= ENOUGH and waited >= 2:
            return Spectrum(values[:own], block[:, :own], trace, residual, passes)
        bound, low = max(values[-1], 1e-11 * values[0]), max(values[max(own, 1) - 1], 1e-11 * values[0])
        growth = [math.acosh(max(1.0, 2 * v / bound - 1)) for v in (values[0], low)]
        degree = int(max(1, min(DEGREE, SPREAD // max(1e-9, growth[0] - growth[1]))))
        block = np.linalg.qr(filtered(counted, block, image, bound, float(values[0]), degree))[0]
    raise RuntimeError(f"not certified after {ROUNDS} rounds: residual {best:.1e}")


def _whitened(d: int, centre: Centre, axes: np.ndarray, explained: np.ndarray, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = axes.shape[1]
        for batch in batches:
            ids, at = batch.column(0), 0
            for x in _blocks(batch.column(1), d):
                z, n = centre.centred(x) @ axes, len(x)
                place = pa.array(np.repeat(np.arange(at, at + n), k))
                deviation = pa.array(centre.deviations(x), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(place),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, centre.n, np.int64)),
                        deviation.take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(z.ravel()),
                        pa.array(np.tile(explained, n)),
                        pa.array(np.full(n * k, error)),
                    ],
                    names=[f.split(" ")[0] for f in OUTPUT.split(", ")],
                )
                at += n

    return run


def whitened(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for each usable
    row and component."""
    spark = vectors.sparkSession
    rows, d = usable(vectors, key, vector)
    fit = written(rows.select("x").distinct(), "fit")
    sums = (
        fit.mapInArrow(_sums(d), "i int, v string")
        .groupBy("i")
        .agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
        .collect()
    )
    found = {r.i: int(r.v) for r in sums}
    n = found.get(d, 0)
    if not d or not n:
        return spark.createDataFrame([], OUTPUT)
    centre = Centre(n, [found[i] for i in range(d)])
    trace = [0.0]

    def product(q: np.ndarray) -> np.ndarray:
        out = _added(fit, _products(d, centre, q)) / n
        trace[0] = float(out[-1])
        return out[:-1].reshape(q.shape)

    product(np.zeros((d, 1)))
    if trace[0] <= 0:
        return spark.createDataFrame([], OUTPUT)
    s = leading(product, d, components, trace[0])
    axes = s.vectors / np.sqrt(s.values)
    k = axes.shape[1]
    outer = _added(fit, _outer(d, centre, axes)).reshape(k + 1, k) / n
    error = float(np.abs(outer[:k] - np.outer(outer[k], outer[k]) - np.eye(k)).max())
    explained = s.values / s.trace
    return rows.mapInArrow(_whitened(d, centre, axes, explained, error), OUTPUT)
