"""One linear model with all heads, trained on the combined loss.

A text is its words, hashed into ``size`` buckets by built-in functions; each occurrence counts
1 / sqrt(words). Rows are packed once into blocks: the distinct buckets of each row, and how often it has them.
An iteration is one job over all blocks: a task adds up the gradient of its rows for all heads in one
array, a grouped sum combines the tasks, and the driver gets at most ``size`` + 2 rows for the next
step. Nothing else leaves the executors, whatever the number of rows.

Defined results: null and empty texts have the bias as their score; rows with a null label teach
the class head nothing, rows without a severity or without targets nothing to those heads; of an
empty table all losses are 0.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, IGNORE_ID, SEVERITY_NAMES, TARGET_NAMES
from modloom.functions.counting import count_where
from modloom.operators.losses import (
    LABEL_SMOOTHING,
    LAMBDA_SEVERITY,
    LAMBDA_TARGET,
    class_weights,
    target_weights,
)
from modloom.operators.sampling import epoch_resample
from modloom.operators.tokens import word_tokens
from modloom.sources.storage import cut_lineage, own_scratch

SIZE = 1 << 14
L2 = 1e-4
#: Words of a block, besides those of its last row, and its rows; bytes that a reader of blocks holds.
SLICE, ROWS = 1 << 17, 2_000
GROUP_BYTES = 32 << 20
#: Steps that the curvature is estimated from.
MEMORY = 8
CLASSES, LEVELS, TARGETS = len(CLASS_NAMES), len(SEVERITY_NAMES), len(TARGET_NAMES)
WIDTH = CLASSES + LEVELS + TARGETS
HEADS = ("class", "severity", "target")
#: Places of the bias and of the losses among the gradient's rows.
BIAS, LOSSES = -1, -2


class Setup(NamedTuple):
    """What the loss is scaled by: one number per class and target, and the rows of each head."""

    class_weight: np.ndarray
    target_weight: np.ndarray
    class_mass: float
    n: tuple[int, int, int]
    size: int


class Trained(NamedTuple):
    weights: np.ndarray  # (size + 1, WIDTH); the last row is the bias
    initial: dict[str, float]
    losses: dict[str, float]
    jobs: int


def with_buckets(df: DataFrame, size: int = SIZE) -> DataFrame:
    """``df`` with ``buckets``, the hashed words of ``text``."""
    words = word_tokens(F.lower(F.coalesce(F.col("text"), F.lit(""))))
    return df.withColumn(
        "buckets", F.transform(words, lambda word: F.pmod(F.xxhash64(word), F.lit(size)).cast("int"))
    )


def setup(df: DataFrame, size: int = SIZE) -> Setup:
    """Class weights from the resampled first epoch, target weights, and the rows of each head."""
    by_class = {r["label_name"]: r["weight"] for r in class_weights(epoch_resample(df, 0)).collect()}
    by_target = {r["target"]: r["weight"] for r in target_weights(df).collect()}
    class_weight = np.array([by_class[name] for name in CLASS_NAMES])
    counts = df.agg(
        *[count_where(F.col("label") == i).alias(f"n{i}") for i in range(CLASSES)],
        count_where(F.col("severity") != IGNORE_ID).alias("severity"),
        count_where(F.col("has_targets")).alias("target"),
    ).first()
    per_class = np.array([counts[f"n{i}"] for i in range(CLASSES)])
    return Setup(
        class_weight,
        np.array([by_target[name] for name in TARGET_NAMES]),
        float(class_weight @ per_class),
        (int(per_class.sum()), counts["severity"], counts["target"]),
        size,
    )


class Entries(NamedTuple):
    """Distinct buckets of some rows, row by row."""

    value: np.ndarray  # of each row: what one occurrence of a word counts
    rows: np.ndarray  # rows with words, and where their entries start
    starts: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def _small(numbers: np.ndarray) -> np.ndarray:
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _starts(keys: np.ndarray) -> np.ndarray:
    """Places of ``keys`` that differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])


def entries_of(buckets: pa.Array, size: int) -> Entries:
    sizes = buckets.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = buckets.flatten().to_numpy(zero_copy_only=False)
    key = np.sort(np.repeat(np.arange(len(sizes)) * size, sizes) + words)
    first = _starts(key)
    row, bucket = np.divmod(key[first], size)
    starts = _starts(row)
    count = np.diff(np.append(first, len(key)))
    value = 1.0 / np.sqrt(np.maximum(sizes, 1))
    return Entries(value, row[starts], starts, _small(bucket), _small(count))


def logits_of(found: Entries, weights: np.ndarray, lines: Iterable[int] = range(WIDTH)) -> np.ndarray:
    """Scores of the rows; ``weights`` and the scores have a line per output, the bias comes last.

    Only ``lines`` are worked out; the others hold the bias.
    """
    logits = np.zeros((WIDTH, len(found.value)))
    if len(found.rows):
        bucket, count = found.bucket.astype(np.intp), found.count.astype(np.float64)
        parts = np.empty(len(bucket))  # one buffer: new memory for each line would cost more than the sums
        for k in lines:
            np.take(weights[k], bucket, out=parts, mode="clip")
            np.multiply(parts, count, out=parts)
            logits[k, found.rows] = np.add.reduceat(parts, found.starts)
    logits *= found.value
    logits += weights[:, -1:]
    return logits


def add_slope(summed: np.ndarray, found: Entries, slope: np.ndarray, lines: Iterable[int]) -> None:
    """Adds to ``summed`` the gradient by weights of rows with ``slope``, that by their scores.

    Outside ``lines`` the slope is 0.
    """
    summed[:, -1] += slope.sum(axis=1)
    if len(found.rows):
        bucket, count = found.bucket.astype(np.intp), found.count.astype(np.float64)
        row = np.repeat(found.rows, np.diff(np.append(found.starts, len(bucket))))
        parts = np.empty(len(bucket))
        for k in lines:
            np.take(slope[k] * found.value, row, out=parts, mode="clip")
            np.multiply(parts, count, out=parts)
            summed[k, :-1] += np.bincount(bucket, parts, summed.shape[1] - 1)


def softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities, logarithms of them) per column."""
    shifted = logits - logits.max(axis=0)
    likely = np.exp(shifted)
    mass = likely.sum(axis=0)
    return likely / mass, shifted - np.log(mass)


def head_losses(
    logits: np.ndarray, label: np.ndarray, severity: np.ndarray, targets: np.ndarray, scale: Setup
) -> tuple[np.ndarray, np.ndarray]:
    """(loss shares of the three heads, gradient of the total by logits), a column per row.

    A label of -1, a severity of ``IGNORE_ID`` and NaN targets take no part.
    """
    losses, slope = np.zeros(3), np.zeros_like(logits)
    known = np.flatnonzero(label >= 0)
    if len(known):
        chosen = label[known]
        p, logs = softmax(logits[:CLASSES, known])
        shared = scale.class_weight * LABEL_SMOOTHING / CLASSES
        own = (1 - LABEL_SMOOTHING) * scale.class_weight[chosen]
        at = (chosen, np.arange(len(known)))
        losses[0] = -((shared @ logs).sum() + own @ logs[at]) / scale.class_mass
        p *= shared.sum() + own
        p -= shared[:, None]
        p[at] -= own
        slope[:CLASSES, known] = p / scale.class_mass
    graded = np.flatnonzero(severity != IGNORE_ID)
    if len(graded):
        here = slice(CLASSES, CLASSES + LEVELS)
        p, _ = softmax(logits[here, graded])
        levels = np.arange(LEVELS)
        expected = levels @ p
        error = expected - severity[graded]
        losses[1] = error @ error / scale.n[1]
        inner = p * (levels[:, None] - expected)
        slope[here, graded] = LAMBDA_SEVERITY * 2 / scale.n[1] * error * inner
    aimed = np.flatnonzero(~np.isnan(targets[0]))
    if len(aimed):
        here = slice(CLASSES + LEVELS, WIDTH)
        x, y = logits[here, aimed], targets[:, aimed]
        share = scale.target_weight / (TARGETS * scale.n[2])
        small = np.exp(-np.abs(x))
        losses[2] = share @ (np.maximum(x, 0) - x * y + np.log1p(small)).sum(axis=1)
        likely = np.where(x >= 0, 1.0, small) / (1 + small)
        slope[here, aimed] = (LAMBDA_TARGET * share)[:, None] * (likely - y)
    return losses, slope


def _answers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    def ints(name: str, missing: int) -> np.ndarray:
        return batch.column(name).cast(pa.int64()).fill_null(missing).to_numpy(zero_copy_only=False)

    targets = np.full((TARGETS, batch.num_rows), np.nan)
    rows = np.flatnonzero(batch.column("has_targets").fill_null(False).to_numpy(zero_copy_only=False))
    if len(rows):
        flat = batch.column("targets").take(pa.array(rows)).flatten().cast(pa.float64())
        targets[:, rows] = flat.to_numpy(zero_copy_only=False).reshape(len(rows), TARGETS).T
    return ints("label", -1), ints("severity", IGNORE_ID), targets


def _taught(label: np.ndarray, severity: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """A line per head: which rows it learns from."""
    return np.stack([label >= 0, severity != IGNORE_ID, ~np.isnan(targets[0])])


def packed(df: DataFrame, size: int) -> DataFrame:
    """The rows of ``df`` as blocks of about ``SLICE`` words: their entries and answers.

    The rows of a block teach the same heads, so that the others need not be worked out.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (1, 2, 4) @ _taught(*_answers(batch))
            order = np.argsort(kind, kind="stable")
            batch, kind = batch.take(pa.array(order)), kind[order]
            sizes = batch.column("buckets").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            before = np.cumsum(sizes, dtype=np.int64) - sizes
            block = before // SLICE * batch.num_rows + np.arange(batch.num_rows) // ROWS
            edges = np.append(_starts(block * 8 + kind), batch.num_rows)
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                part = batch.slice(start, end - start)
                label, severity, targets = _answers(part)
                found = entries_of(part.column("buckets"), size)
                # plain tuples, as workers may not find the package by its name
                whole = pickle.dumps((tuple(found), label, severity, targets), pickle.HIGHEST_PROTOCOL)
                yield pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["block"])

    rows = df.select("buckets", "label", "severity", "has_targets", "targets")
    return rows.mapInArrow(pack, "block binary")


def gradient(
    df: DataFrame, weights: np.ndarray, scale: Setup, max_tasks: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(losses of the three heads, gradient of their total) over all rows of ``df``, in one job.

    ``max_tasks`` tasks at most (four per core of the session, unless given) send a gradient each.
    """
    return gradient_of_blocks(packed(df, scale.size), weights, scale, max_tasks)


def gradient_of_blocks(
    blocks: DataFrame, weights: np.ndarray, scale: Setup, max_tasks: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``gradient`` over the rows of ``blocks`` (``packed``)."""
    if max_tasks is None:
        max_tasks = 4 * blocks.sparkSession.sparkContext.defaultParallelism

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.ascontiguousarray(weights.T)
        summed, losses = np.zeros_like(lines), np.zeros(3)
        for batch in batches:
            for block in batch.column("block"):
                entries, *answers = pickle.loads(block.as_buffer())
                entries = Entries(*entries)
                used = np.flatnonzero(_taught(*answers).any(axis=1).repeat((CLASSES, LEVELS, TARGETS)))
                shares, slope = head_losses(logits_of(entries, lines, used), *answers, scale)
                losses += shares
                add_slope(summed, entries, slope, used)
        found = summed.T
        touched = np.flatnonzero(found[:-1].any(axis=1))
        places = np.concatenate([touched, [BIAS, LOSSES]]).astype(np.int32)
        rows = np.vstack([found[touched], found[-1], np.pad(losses, (0, WIDTH - 3))])
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), *[pa.array(rows[:, k]) for k in range(WIDTH)]],
            names=["place", *[f"g{k}" for k in range(WIDTH)]],
        )

    schema = "place int, " + ", ".join(f"g{k} double" for k in range(WIDTH))
    parts = blocks.coalesce(max_tasks).mapInArrow(add_up, schema)
    sums = parts.groupBy("place").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(WIDTH)])
    table = sums.toArrow()
    places = table.column("place").to_numpy()
    values = np.column_stack([table.column(f"g{k}").to_numpy() for k in range(WIDTH)])
    found, losses = np.zeros_like(weights), np.zeros(3)
    inside = places >= 0
    found[places[inside]] = values[inside]
    for place, value in zip(places[~inside], values[~inside], strict=True):
        if place == BIAS:
            found[-1] = value
        else:
            losses = value[:3]
    return losses, found


def total(losses: np.ndarray, weights: np.ndarray) -> float:
    """The combined loss, with the penalty on large weights; the bias is free."""
    return float(losses @ (1.0, LAMBDA_SEVERITY, LAMBDA_TARGET) + L2 / 2 * (weights[:-1] ** 2).sum())


def _direction(slope: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Downhill, bent by the curvature that the last steps met (limited-memory BFGS)."""
    way, kept = slope.copy(), []
    for moved, turned in reversed(steps):
        share = (moved * way).sum() / (moved * turned).sum()
        way -= share * turned
        kept.append(share)
    if steps:
        moved, turned = steps[-1]
        way *= (moved * turned).sum() / (turned**2).sum()
    for (moved, turned), share in zip(steps, reversed(kept), strict=True):
        way += (share - (turned * way).sum() / (moved * turned).sum()) * moved
    return -way


def train(df: DataFrame, size: int = SIZE, max_jobs: int = 20, tolerance: float = 1e-4) -> Trained:
    """All heads at once on the rows of ``df``, which needs ``buckets`` (``with_buckets``).

    ``df`` is read for the scales and once more to write its blocks, which every job reads, so it
    should be a written table. A step that does not lower the loss enough is halved; training ends
    after ``max_jobs`` jobs or when a step gains less than ``tolerance`` of the loss.
    """
    scale = setup(df, size)
    with own_scratch(df.sparkSession):
        blocks = cut_lineage(packed(df, size), "blocks", **{"parquet.block.size": str(GROUP_BYTES)})
        return _descend(blocks, scale, max_jobs, tolerance)


def _descend(blocks: DataFrame, scale: Setup, max_jobs: int, tolerance: float) -> Trained:
    weights = np.zeros((scale.size + 1, WIDTH))

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        losses, slope = gradient_of_blocks(blocks, point, scale)
        slope[:-1] += L2 * point[:-1]
        return total(losses, point), losses, slope

    value, losses, slope = at(weights)
    initial, jobs, steps, length = losses, 1, [], None
    way = -slope
    while jobs < max_jobs and slope.any():
        length = length or (1.0 if steps else 1.0 / np.sqrt((slope**2).sum()))
        point = weights + length * way
        new_value, new_losses, new_slope = at(point)
        jobs += 1
        if new_value > value + 1e-4 * length * (slope * way).sum():
            length /= 2
            continue
        moved, turned = point - weights, new_slope - slope
        gain = (value - new_value) / max(value, 1e-12)
        weights, value, losses, slope, length = point, new_value, new_losses, new_slope, None
        if (moved * turned).sum() > 1e-12:
            steps = [*steps[1 - MEMORY :], (moved, turned)]
        way = _direction(slope, steps)
        if gain < tolerance:
            break
    named = [dict(zip(HEADS, map(float, part), strict=True)) for part in (initial, losses)]
    return Trained(weights, *named, jobs)


def with_scores(df: DataFrame, weights: np.ndarray) -> DataFrame:
    """``df`` with the three score vectors of a trained model, from ``buckets``.

    Columns of the caller with those names are replaced.
    """
    ends = (0, CLASSES, CLASSES + LEVELS, WIDTH)
    names = ("class_logits", "severity_logits", "target_logits")

    @F.pandas_udf(", ".join(f"{name} array<double>" for name in names))
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lines = np.ascontiguousarray(weights.T)
        for lists in batches:
            filled = [None if x is None else list(x) for x in lists]
            entries = entries_of(pa.array(filled, pa.list_(pa.int32())), len(weights) - 1)
            logits = logits_of(entries, lines).T
            yield pd.DataFrame(
                {name: list(logits[:, a:b]) for name, a, b in zip(names, ends, ends[1:], strict=False)}
            )

    found = df.drop(*names).withColumn("_scores", score(F.col("buckets")))
    return found.withColumns({name: F.col("_scores")[name] for name in names}).drop("_scores")


def loss_table(df: DataFrame, trained: Trained) -> DataFrame:
    """(head, initial, loss) of a training, with the combined loss as head "total"."""
    rows = [(name, trained.initial[name], trained.losses[name]) for name in HEADS]
    factors = (1.0, LAMBDA_SEVERITY, LAMBDA_TARGET)
    sums = [sum(f * row[i] for f, row in zip(factors, rows, strict=True)) for i in (1, 2)]
    lines = [(*row,) for row in rows] + [("total", *sums)]
    return df.sparkSession.createDataFrame(lines, "head string, initial double, loss double")
