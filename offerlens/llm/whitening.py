"""Whitening of vectors by principal components, found by subspace iteration with a
Chebyshev filter.

Entries become whole numbers, ``x = floor(64 c) + 1000000``, and each distinct vector
counts once. A pass over these vectors multiplies the centred XᵀX with a block of
columns: each task sums its share, Spark adds the shares by dimension, and only a
block of (dimensions x columns) numbers comes to the driver, however many vectors
there are. A turn of the iteration is ``DEGREE`` such passes, combined by the recurrence
of Chebyshev polynomials, which stay small on the unwanted part of the spectrum and
grow fast above it; then a QR, one more pass and a Rayleigh-Ritz step. The turns end when
every wanted pair has a residual at rounding error (or no turn lowers it any more). One
column of the block is drawn anew in each turn, so that a direction missed by the
first draw shows up among the wanted ones and asks for further turns.

Centring comes before multiplying: a row enters as ``(n x - S) / n``, whose numerator is
an exact whole number. So are the deviations.

Rows whose vector is null, empty or holds null or non-finite entries are left out, as
are rows of another length than most rows have (of equally common lengths the shorter
stays) and entries beyond 2**40, which have no exact numerator. Repeated rows all come
out; copies count once in the fit. Components without variance (fewer distinct vectors
or dimensions than components) have no whitened value and no rows; an empty table gives
no rows. A deviation beyond 2**63 is null. Only key and vector are read, so other
columns can't clash.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlens.llm.arrow import slices
from offerlens.session import checkpoint_folder

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
GUARDS = 16  # columns beyond the wanted ones; they set the cut of the filter
DEGREE = 12  # passes in a turn
TURNS = 60
RESIDUAL = 2e-15  # of the largest eigenvalue
MOST = float(1 << 40)
FLAT = 1e-12  # of the largest eigenvalue: no variance
SEED = 20_240_917


# Whole-number vectors --------------------------------------------------------
def _whole(column: pa.Array) -> list[np.ndarray | None]:
    """floor(64 c) of each vector, None where it isn't one of finite numbers."""
    out: list[np.ndarray | None] = []
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become nan
    starts = column.offsets.to_numpy()
    good = column.is_valid().to_numpy(zero_copy_only=False)
    for at, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
        scaled = np.floor(SCALE * flat[a:b])
        out.append(scaled.astype("<i8") if good[at] and b > a and np.isfinite(scaled).all() and np.abs(scaled).max() <= MOST else None)
    return out


def _narrow(x: np.ndarray) -> bytes:
    """Equal vectors give equal bytes, four to an entry where that holds them."""
    small = x.astype("<i4")
    return b"\0" + small.tobytes() if (small == x).all() else b"\1" + x.tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8" if data[0] else "<i4", offset=1).astype(np.int64)


def whole_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """The key, ``dims`` and ``x`` (packed floor(64 c)) of every usable row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = _whole(batch.column(1))
            keep = pa.array([x is not None for x in found], pa.bool_())
            own = [x for x in found if x is not None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), pa.array([len(x) for x in own], pa.int32()), pa.array([_narrow(x) for x in own], pa.binary())],
                [key, "dims", "x"])

    doubles = F.col(f"`{vector}`").cast("array<double>")
    return df.select(F.col(f"`{key}`"), doubles.alias("v")).mapInArrow(run, f"`{key}` {kind}, dims int, x binary")


def _blocks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches):
        if batch.num_rows:
            yield batch, np.stack([_wide(x) for x in batch.column(column).to_pylist()])


@dataclass(frozen=True)
class Fit:
    """Distinct vectors: their number, sums (of floor(64 c)), and sum of centred squares
    over n; components as columns, their eigenvalues, and the largest residual."""

    n: int
    sums: np.ndarray
    trace: float
    vectors: np.ndarray
    values: np.ndarray
    residual: float
    passes: int

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, from the exact numerator."""
        return _numerators(x, self.n, self.sums).astype(np.float64) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _numerators(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in whole numbers; Python's own where 64 bits don't hold them."""
    if n * (int(np.abs(x).max(initial=0)) + 1) + int(max(map(abs, sums.tolist()), default=0)) < 1 << 63:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n x - S)**2 for each row, exact; None beyond a long."""
    numerators = _numerators(x, n, sums)
    most = int(np.abs(numerators).max(initial=0))
    if numerators.dtype == object or most * most * numerators.shape[1] >= 1 << 63:
        totals = [sum(v * v for v in row) for row in numerators.tolist()]
        return [t if t < 1 << 63 else None for t in totals]
    return (numerators * numerators).sum(axis=1).tolist()


# Distributed sums ------------------------------------------------------------
def _summed(
    fit_list: DataFrame, shape: tuple[int, int], add: Callable[[np.ndarray], np.ndarray], least_exact: bool = False,
) -> np.ndarray:
    """The sum over all rows of a matrix that ``add`` makes of a block of rows. Each task
    hands on its own sum, a row of the matrix a row, and Spark adds them up."""
    rows, columns = shape
    kind, dtype = ("long", np.int64) if least_exact else ("double", np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype)
        seen = False
        for _, x in _blocks(batches, 0):
            total += add(x)
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows, dtype=np.int32)), *(pa.array(c) for c in total.T)], ["i", *(f"c{k}" for k in range(columns))])

    shares = fit_list.select("x").mapInArrow(run, "i int, " + ", ".join(f"c{k} {kind}" for k in range(columns)))
    # Whole numbers are added as decimals, which can't overflow.
    whole = [F.sum(F.col(f"c{k}").cast("decimal(19,0)") if least_exact else F.col(f"c{k}")).alias(f"c{k}") for k in range(columns)]
    out = np.zeros(shape, object if least_exact else np.float64)
    for row in shares.groupBy("i").agg(*whole).collect():
        out[row[0]] = [int(v) for v in row[1:]] if least_exact else row[1:]
    return out


def principal_components(fit_list: DataFrame, components: int = COMPONENTS, guards: int = GUARDS, degree: int = DEGREE, turns: int = TURNS) -> Fit | None:
    """Mean and leading components of the distinct vectors in ``fit_list`` (``dims``,
    ``x``); None without vectors."""
    first = fit_list.agg(F.count("*"), F.max("dims")).first()
    n, dims = int(first[0]), first[1]
    if not n:
        return None
    sums = _summed(fit_list, (1, dims), lambda x: x.sum(axis=0)[None, :], least_exact=True)[0]
    passes = 0

    def centred(x: np.ndarray) -> np.ndarray:
        return _numerators(x, n, sums).astype(np.float64) / n

    def times(block: np.ndarray) -> np.ndarray:
        """V times a block of columns, in one pass."""
        nonlocal passes
        passes += 1

        def add(x: np.ndarray) -> np.ndarray:
            y = centred(x)
            return y.T @ (y @ block)

        return _summed(fit_list, block.shape, add) / n

    trace = float(_summed(fit_list, (1, 1), lambda x: np.array([[np.square(centred(x)).sum()]]))[0, 0]) / n
    width = min(dims, components + guards)
    draw = np.random.default_rng(SEED)
    block = np.linalg.qr(draw.standard_normal((dims, width)))[0]
    best: tuple[float, np.ndarray, np.ndarray] | None = None
    stale = 0
    for _ in range(turns):
        # Rayleigh-Ritz: the best pairs that the block's space holds.
        image = times(block)
        small = block.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)
        values, block, image = values[order], block @ turn[:, order], image @ turn[:, order]
        want = min(components, int((values > FLAT * max(values[0], 0)).sum())) if values[0] > 0 else 0
        off = np.linalg.norm(image - block * values, axis=0)[:want]
        residual = float(off.max(initial=0)) / max(float(values[0]), 1e-300)
        if best is None or len(best[2]) < want or residual < 0.5 * best[0]:
            stale = 0
        else:
            stale += 1
        if best is None or len(best[2]) <= want and (residual < best[0] or len(best[2]) < want):
            best = residual, block[:, :want], values[:want]
        if width == dims or residual <= RESIDUAL or stale >= 3 or want == 0:
            break
        # The filter: damped on [0, cut], the part that the block's last columns stand for.
        cut = max(float(values[-1]), FLAT * float(values[0]))
        half = cut / 2
        scale = half / (float(values[0]) - half)
        if width > components:
            block[:, -1] = draw.standard_normal(dims)
            block[:, -1] -= block[:, :-1] @ (block[:, :-1].T @ block[:, -1])
        factor = scale
        before, now = block, (times(block) - half * block) * (factor / half)
        for _ in range(degree - 1):
            after = 1 / (2 / scale - factor)
            before, now = now, 2 * after / half * (times(now) - half * now) - factor * after * before
            factor = after
        block = np.linalg.qr(now)[0]
        block = np.linalg.qr(block)[0]  # a second time: columns of very unequal length
    residual, vectors, values = best
    return Fit(n, sums, trace, vectors, values, residual, passes)


def identity_error(fit_list: DataFrame, fit: Fit) -> float:
    """The largest entry of the whitened vectors' covariance minus the identity."""
    k = len(fit.values)

    def add(x: np.ndarray) -> np.ndarray:
        w = fit.whiten(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _summed(fit_list, (k + 1, k), add) / fit.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


# The table -------------------------------------------------------------------
def whitened(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, guards: int = GUARDS,
    degree: int = DEGREE, turns: int = TURNS,
) -> DataFrame:
    """One row per usable row and component: the key, ``component`` (from 1), ``n`` distinct
    vectors, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    spark = df.sparkSession
    place = f"{checkpoint_folder(spark)}/whitening-{os.urandom(8).hex()}"
    whole_vectors(df, key, vector).write.parquet(f"{place}/rows")
    rows = spark.read.parquet(f"{place}/rows")
    usual = rows.groupBy("dims").count().orderBy(F.desc("count"), "dims").limit(1).collect()
    dims = usual[0]["dims"] if usual else 0
    rows = rows.filter(F.col("dims") == dims)
    rows.select("dims", "x").distinct().write.parquet(f"{place}/distinct")
    fit_list = spark.read.parquet(f"{place}/distinct")
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = principal_components(fit_list, components, guards, degree, turns)
    if fit is None or not len(fit.values):
        return spark.createDataFrame([], schema)
    error = identity_error(fit_list, fit)
    explained = fit.values / fit.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(explained)
        for batch, x in _blocks(batches, 1):
            m = len(x)
            values = [
                np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, fit.n, np.int64),
                None, fit.whiten(x).reshape(-1), np.tile(explained, m), np.full(m * k, error),
            ]
            away = pa.array(deviations(x, fit.n, fit.sums), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(each), *(away.take(each) if v is None else pa.array(v) for v in values)],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(key, "x").mapInArrow(run, schema)
