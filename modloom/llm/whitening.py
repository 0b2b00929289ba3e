"""Whitening by spectral divide and conquer over polar decompositions.

Counts and sums of the integer vectors are exact. Tasks then centre their rows, multiply them and
add up one block of products each, which Spark sums entry by entry, so nothing but one ``width`` by
``width`` matrix reaches the driver. There the covariance is split: the polar factor of
``V - shift * I``, from the QR-based dynamically weighted Halley iteration (QDWH), is the matrix
sign, which gives the projector on the eigenvectors above the shift; bases of the two invariant
subspaces split the matrix in two, and each half is split again, down to single components. The
components (some kilobytes) go to every task with the plan, and one pass whitens the rows.

Defined results: rows whose vector is null, empty or holds a null or non-finite entry, or has not
the width that most vectors have (the larger of two equally frequent ones), are left out; zero
vectors stay; a component without variance (no more than ``FLAT`` of the trace) whitens to zero and
counts in no identity error; one row or no row is no error; a null id and repeated rows stay;
entries count as at most 2**40 in size; other columns of the input take no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: x = floor(SCALE * c) + SHIFT
SCALE, SHIFT, LARGEST = 64, 1_000_000, 1 << 40
COMPONENTS = 32
#: Share of the trace up to which a component counts as one without variance.
FLAT = 1e-13
#: Rows that are multiplied at a time.
STEP = 4096

EPS = np.finfo(np.float64).eps


# --- polar decomposition and spectral splitting -------------------------------------------


def polar_factor(matrix: np.ndarray, steps: int = 40) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, which is its matrix sign, by QDWH."""
    n = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    # a lower bound of the singular values; the weights make up for one that is too small
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = EPS
    low = min(max(low, EPS), 1.0)
    eye = np.eye(n)
    for _ in range(steps):
        square = low * low
        d = np.cbrt(4 * (1 - square) / (square * square))
        root = np.sqrt(1 + d)
        a = root + np.sqrt(max(8 - 4 * d + 8 * (2 - square) / (square * root), 0)) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        next_x = b / c * x + (a - b / c) / np.sqrt(c) * q[:n] @ q[n:].T
        next_x = (next_x + next_x.T) / 2
        low = min(low * (a + b * square) / (1 + c * square), 1.0)
        moved = np.linalg.norm(next_x - x)
        x = next_x
        if moved < 1e-10 and 1 - low < 1e-8:
            break
    # one Newton-Schulz step takes the rest of the error away
    return x @ (3 * eye - x @ x) / 2


def split(matrix: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the eigenvectors above and below ``shift``; None if that fails."""
    n = len(matrix)
    projector = (polar_factor(matrix - shift * np.eye(n)) + np.eye(n)) / 2
    rank = round(float(np.trace(projector)))
    if not 0 < rank < n or abs(np.trace(projector) - rank) > 1e-6:
        return None
    # the projector's columns, the largest first, span the subspace; the second pass cleans the basis
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    basis, _ = np.linalg.qr(projector[:, order])
    basis, _ = np.linalg.qr(np.hstack([projector @ basis[:, :rank], basis[:, rank:]]))
    above, below = basis[:, :rank], basis[:, rank:]
    below = below - above @ (above.T @ below)
    below, _ = np.linalg.qr(below)
    if np.linalg.norm(below.T @ matrix @ above) > 64 * n * EPS * np.linalg.norm(matrix):
        return None
    return above, below


def shifts(matrix: np.ndarray) -> Iterator[float]:
    """Places that may part the spectrum: the middle of the diagonal, then others around it."""
    diagonal = np.sort(np.diag(matrix))
    yield float(np.median(diagonal))
    yield float(np.mean(diagonal))
    # Every eigenvalue lies within the spread of the mean; halves and thirds of that range.
    centre = float(np.mean(diagonal))
    spread = float(np.linalg.norm(matrix - centre * np.eye(len(matrix))))
    for part in (0.11, -0.13, 0.29, -0.31, 0.53, -0.57, 0.01, -0.012, 0.001, -0.0013):
        yield centre + part * spread


def rotate(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors by plane rotations; for blocks that no shift parts."""
    n = len(matrix)
    own, vectors = matrix.copy(), np.eye(n)
    for _ in range(60):
        off = np.abs(np.triu(own, 1))
        if off.max(initial=0) <= EPS * np.abs(own).max(initial=0):
            break
        for i in range(n - 1):
            for j in range(i + 1, n):
                if own[i, j] == 0:
                    continue
                angle = 0.5 * np.arctan2(2 * own[i, j], own[i, i] - own[j, j])
                turn = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
                own[[i, j]] = turn.T @ own[[i, j]]
                own[:, [i, j]] = own[:, [i, j]] @ turn
                vectors[:, [i, j]] = vectors[:, [i, j]] @ turn
    return np.diag(own).copy(), vectors


def components(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, falling; unit eigenvectors as columns) of a symmetric matrix."""
    n = len(covariance)
    scale = np.linalg.norm(covariance)
    values, vectors, done = np.zeros(n), np.eye(n), 0
    waiting = [np.eye(n)]
    while waiting:
        basis = waiting.pop()
        own = basis.T @ covariance @ basis
        own = (own + own.T) / 2
        width = own.shape[0]
        parts = None
        spread = np.linalg.norm(own - np.trace(own) / width * np.eye(width))
        if width > 2 and spread > 8 * EPS * scale:
            parts = next(filter(None, (split(own, shift) for shift in shifts(own))), None)
        if parts is not None:
            waiting.extend(basis @ part for part in parts)
            continue
        found, turned = rotate(own)
        values[done : done + width] = found
        vectors[:, done : done + width] = basis @ turned
        done += width
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# --- the model ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Whitening:
    """What is known of the rows that were fitted: integer sums and the spectrum."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def width(self) -> int:
        return len(self.sums)

    @cached_property
    def count(self) -> int:
        """Components that are given."""
        return min(COMPONENTS, self.width)

    @cached_property
    def used(self) -> np.ndarray:
        """Which of them have variance."""
        return self.values[: self.count] > FLAT * self.trace

    @cached_property
    def scaled(self) -> np.ndarray:
        """Columns that take a centred row to its whitened values."""
        root = np.sqrt(np.where(self.used, self.values[: self.count], 1.0))
        return np.where(self.used, self.vectors[:, : self.count] / root, 0.0)

    def explained(self) -> list[float]:
        return [float(v / self.trace) if self.trace > 0 else 0.0 for v in self.values[: self.count]]


def whole(flat: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of every entry."""
    scaled = np.floor(SCALE * flat.astype(np.float64))
    return np.clip(scaled, -SCALE * LARGEST, SCALE * LARGEST).astype(np.int64) + SHIFT


def centred(rows: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """x - S / n; what the whole part of S / n leaves is taken off last, so nothing cancels."""
    middle = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (rows - middle) - rest


def matrices(batches: Iterator[pa.RecordBatch], width: int, at: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The integer rows of the vectors in column ``at``, STEP rows at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, STEP):
            part = batch.slice(first, STEP)
            flat = part.column(at).flatten().to_numpy(zero_copy_only=False)
            yield part, whole(flat).reshape(-1, width)


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.lit(False))


def summed(df: DataFrame, column: str, make, size: int) -> np.ndarray:
    """Totals of the ``size`` numbers that ``make(batches)`` gives for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = make(batches)
        yield pa.record_batch({"i": pa.array(np.arange(size, dtype=np.int32)), "x": pa.array(total)})

    rows = df.select(column).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(size)
    for row in rows:
        total[row.i] = row.x
    return total


def products(df: DataFrame, column: str, width: int, n: int, sums: tuple[int, ...], turned: np.ndarray) -> np.ndarray:
    """The covariance of the rows after ``turned``, centred before it is multiplied."""
    size = turned.shape[1]

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((size, size))
        for _, rows in matrices(batches, width, 0):
            own = centred(rows, n, sums) @ turned
            total += own.T @ own
        return total.ravel()

    return summed(df, column, make, size * size).reshape(size, size) / n


def vectors_of(df: DataFrame, id_column: str, column: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    vector = F.col(f"`{column}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_column}`"), vector.alias("wh_vector")).filter(usable(F.col("wh_vector")))
    widths = rows.groupBy(F.size("wh_vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return rows.filter(F.size("wh_vector") == (most.width if most else 0))


def fit(rows: DataFrame) -> Whitening | None:
    """The model of ``rows`` (from ``vectors_of``); None without rows."""
    column = rows.columns[-1]
    entry = (F.floor(F.lit(float(SCALE)) * F.least(F.greatest("c", F.lit(-float(LARGEST))), F.lit(float(LARGEST)))) + SHIFT).alias("x")
    by_place = rows.select(F.posexplode(column).alias("i", "c")).select("i", entry)
    totals = by_place.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s")).orderBy("i").collect()
    if not totals:
        return None
    n, sums = totals[0].n, tuple(row.s for row in totals)
    covariance = products(rows, column, len(sums), n, sums, np.eye(len(sums)))
    values, vectors = components(covariance)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, over the fitted rows."""
    found = products(rows, rows.columns[-1], model.width, model.n, model.sums, model.scaled)
    return float(np.abs(found - np.diag(model.used.astype(float))).max(initial=0))


ADDED = "deviation long, whitened array<double>"


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(id, deviation, whitened) per row: the exact squared distance from the mean, n times as
    long on each side, and the values on the leading components."""
    id_column = rows.columns[0]
    schema = T.StructType([rows.schema[id_column], *T.StructType.fromDDL(ADDED).fields])
    n, sums = model.n, model.sums

    def squares(own: np.ndarray) -> list[int]:
        far = n * own - np.array(sums, np.int64)
        most = int(np.abs(far).max(initial=0))
        if most * most * len(sums) < 1 << 62:
            return (far * far).sum(axis=1).tolist()
        return [sum(x * x for x in row) for row in far.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, own in matrices(batches, model.width, 1):
            made = centred(own, n, sums) @ model.scaled
            values = pa.array(made.ravel())
            offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
            columns = [part.column(0), pa.array(squares(own), pa.int64()), pa.ListArray.from_arrays(offsets, values)]
            yield pa.record_batch(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def whitening_report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    rows = vectors_of(embeddings, "vec_id", "embedding")
    model = fit(rows)
    if model is None:
        schema = "component int, n long, deviation long, whitened double, explained double, identity_error double"
        kinds = T.StructType([embeddings.schema["vec_id"], *T.StructType.fromDDL(schema).fields])
        return embeddings.sparkSession.createDataFrame([], kinds)
    error = identity_error(rows, model)
    explained = F.array(*(F.lit(x) for x in model.explained()))
    long = whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return long.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
