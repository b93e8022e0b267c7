"""Whitening of embeddings by shifted CholeskyQR.

Entries become integers, so the sums by dimension and every row's distance from the mean are exact; rows are centred before
anything is multiplied. Three Gram passes over the table follow. The first factors the Gram matrix with a shift, which
makes the factor exist whatever the condition; the next two orthogonalise again, each row going through the triangular
solves of all factors so far. Their product R is the R of the centred rows, and its singular values and right singular
vectors are the standard deviations (times the root of n) and the components. No row leaves its task: passes send one
matrix a task, which are added up in a tree, and only its last level reaches the driver.

Dropped are rows whose vector is null, holds a null or non-finite entry or one that is beyond 2^40 as an integer, is empty,
or has another length than most (of lengths equally frequent, the smaller one stays). Repeated rows and ids count as often
as they come, a null id stays null, other columns are ignored, and a table without usable rows gives no rows. A component
without variance (constant or dependent dimensions, fewer rows than dimensions) has null as whitened value, explains 0 and
is left out of the identity error. A deviation beyond 64 bits is null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybeam.llm.shared import pack, unpack

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0**40
COMPONENTS = 32
FAN_IN = 32  # matrices that one task of the tree adds up
ROWS = 4096  # rows worked on at once
EPS = np.finfo(float).eps


@dataclass(frozen=True)
class Whitening:
    """``components`` in rows, largest variance first; ``variances`` of the integers, 0 where there is none."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray


def quantized(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are usable, and these rows as integers."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    usable = lengths == size
    flat = pc.list_flatten(column.filter(pa.array(usable))).cast(pa.float64())
    entries = flat.to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE
    fine = (np.abs(entries) < LARGEST).all(axis=1)  # false for NaN, which a null entry has become
    usable[np.flatnonzero(usable)[~fine]] = False
    return usable, np.floor(entries[fine]).astype(np.int64) + OFFSET


def scaled_deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """``n * x - sums``, exact: machine integers where they hold it, else Python's."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squared_lengths(deviations: np.ndarray) -> list[int | None]:
    most = int(np.abs(deviations).max(initial=0))
    if deviations.dtype == np.int64 and most * most * deviations.shape[1] < 2**63:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = (deviations.astype(object) ** 2).sum(axis=1)
    return [int(v) if v < 2**63 else None for v in exact]


def triangular_solve(rows: np.ndarray, r: np.ndarray) -> np.ndarray:
    """``rows @ inv(r)`` for an upper triangular ``r``, column after column."""
    out = np.empty_like(rows)
    for j in range(r.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
    return out


def _matrices(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    _, x = quantized(column, size)
    for k in range(0, len(x), ROWS):
        yield x[k : k + ROWS]


def _summed(vectors: DataFrame, size: int, of: Callable[[np.ndarray], tuple]) -> tuple | None:
    """The values of ``of`` for blocks of rows, added up: by task, then in a tree of tasks, at last on the driver."""

    def add(total: tuple | None, values: tuple) -> tuple:
        return values if total is None else tuple(a + b for a, b in zip(total, values, strict=True))

    def one_row(total: tuple | None) -> Iterator[pa.RecordBatch]:
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pack(*total)], pa.binary())], ["blob"])

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in _matrices(batch.column("vector"), size):
                total = add(total, of(x))
        yield from one_row(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                total = add(total, unpack(blob))
        yield from one_row(total)

    parts = vectors.mapInArrow(by_task, "blob binary")
    tasks = vectors.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = math.ceil(tasks / FAN_IN)
        parts = parts.repartition(tasks, F.xxhash64("blob")).mapInArrow(merge, "blob binary")
    total = None
    for row in parts.toLocalIterator():
        total = add(total, unpack(bytes(row.blob)))
    return total


def factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper triangular factor of ``gram`` plus a shift, which grows from rounding size where the matrix is singular."""
    size = len(gram)
    step = size * EPS * max(np.trace(gram), np.finfo(float).tiny)
    while True:
        try:
            return np.linalg.cholesky(gram + shift * np.eye(size)).T
        except np.linalg.LinAlgError:
            shift = max(2 * shift, step)


def vector_size(vectors: DataFrame) -> int:
    """The commonest length of usable vectors, 0 if there are none."""
    entry_ok = F.forall("vector", lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < LARGEST, F.lit(False)))
    usable = vectors.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & entry_ok)
    first = usable.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return first["size"] if first else 0


def fit(vectors: DataFrame, size: int) -> Whitening | None:
    """Means, components and variances of ``vectors`` (a column ``vector``); reads them four times."""

    def counted(x: np.ndarray) -> tuple:
        return len(x), x.sum(axis=0).astype(object)

    total = _summed(vectors, size, counted) if size else None
    if total is None:
        return None
    n, sums = int(total[0]), tuple(int(v) for v in total[1])
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> tuple:
        rows = scaled_deviations(x, n, sums).astype(float) / n
        for r in factors:
            rows = triangular_solve(rows, r)
        return (rows.T @ rows,)

    composed = np.eye(size)
    for turn in range(3):
        (g,) = _summed(vectors, size, gram)
        if not turn and not np.trace(g):
            none = np.zeros(size)
            return Whitening(n, sums, np.eye(size), none, none)
        # The shift of the first pass covers the rounding of the Gram matrix; no later pass needs one at full rank.
        shift = 11 * (n * size + size * (size + 1)) * EPS / 2 * np.linalg.norm(g, 2) if not turn else 0.0
        factors.append(factor(g, shift))
        composed = factors[-1] @ composed
    _, deviations, components = np.linalg.svd(composed)
    variances = deviations**2 / n
    variances[deviations <= deviations[0] * max(n, size) * EPS] = 0
    variances[max(0, n - 1) :] = 0  # n centred rows span n - 1 dimensions at most
    return Whitening(n, sums, components, variances, variances / variances.sum())


def _projected(x: np.ndarray, model: Whitening, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """Scaled deviations of rows, and their whitened values; NaN for a component without variance."""
    deviations = scaled_deviations(x, model.n, model.sums)
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (deviations.astype(float) / model.n) @ model.components[:kept].T / np.sqrt(model.variances[:kept])
    white[:, model.variances[:kept] == 0] = np.nan
    return deviations, white


def identity_error(vectors: DataFrame, model: Whitening, kept: int) -> float | None:
    """Largest absolute entry of the whitened values' covariance minus the identity, measured in one more pass."""
    live = np.flatnonzero(model.variances[:kept] > 0)
    if not len(live):
        return None

    def moments(x: np.ndarray) -> tuple:
        white = _projected(x, model, kept)[1][:, live]
        return white.sum(axis=0), white.T @ white

    total, products = _summed(vectors, len(model.sums), moments)
    mean = total / model.n  # of values that are centred already, so nothing cancels
    return float(np.abs(products / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(table: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component the RESULT columns. ``table`` (``vec_id, embedding``) is read seven times."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"))
    vectors = rows.select("vector")
    size = vector_size(vectors)
    model = fit(vectors, size)
    if model is None:
        return table.sparkSession.createDataFrame([], RESULT)
    kept = min(components, size)
    error = identity_error(vectors, model, kept)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            usable, x = quantized(batch.column("vector"), size)
            ids = batch.column("vec_id").filter(pa.array(usable))
            for k in range(0, len(x), ROWS):
                deviations, white = _projected(x[k : k + ROWS], model, kept)
                m = len(deviations)
                each = np.repeat(np.arange(m), kept)
                lengths = pa.array(squared_lengths(deviations), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(k, m).take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * kept, model.n)),
                        lengths.take(pa.array(each)),
                        pa.array(white.ravel(), from_pandas=True),
                        pa.array(np.tile(model.explained[:kept], m)),
                        pa.array([error] * (m * kept), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, RESULT)
