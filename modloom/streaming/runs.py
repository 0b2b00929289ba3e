"""A training log that still grows: best so far, early stop and step windows as lines arrive.

State per run is a dozen numbers: best value, idle epochs, the open epoch, the open window. Lines of
a run come in the order of epoch and step from one micro-batch to the next, in any order inside
one; a micro-batch should hold a bounded number of files (``maxFilesPerTrigger``).

Defined results: lines without a run id form one run; a missing or NaN metric improves on
nothing but an empty past; an evaluation that comes late is compared with all that came before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from modloom.operators.runlog import (
    LOG_EVERY,
    LOSS_TERMS,
    PATIENCE,
    SELECTION_METRIC,
    evaluations,
    train_steps,
)

EVALUATIONS = (
    "run_id long, epoch int, step long, event string, value double, previous_best double, improved boolean"
)
STATUS = "run_id long, stop_epoch int, epochs_run long, epochs_logged long, best_metric double"
#: Rank of the open epoch, its number and best value; best value and last improving rank of the
#: epochs before it; epoch, rank and best value where training stopped.
EPOCH_STATE = (
    "rank long, epoch long, top double, best double, improving long,"
    " stop_epoch long, stop_rank long, stop_best double"
)
WINDOWS = "run_id long, window long, n long, " + ", ".join(
    f"train_loss_{name} double" for name in LOSS_TERMS
)
_SUMS = [f"sum_{name}" for name in LOSS_TERMS]
_COUNTS = [f"n_{name}" for name in LOSS_TERMS]
WINDOW_STATE = "window long, n long, " + ", ".join(
    [f"{name} double" for name in _SUMS] + [f"{name} long" for name in _COUNTS]
)


def _none(value) -> float | None:
    return None if value is None or math.isnan(value) else float(value)


def _larger(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


def _in_order(parts: Iterator[pd.DataFrame]) -> pd.DataFrame:
    rows = pd.concat(list(parts), ignore_index=True)
    return rows.sort_values(["epoch", "step", "event_rank"], kind="stable")


def follow_best(log: DataFrame, metric: str = SELECTION_METRIC) -> DataFrame:
    """Every evaluation with the best earlier value of its run, once, as it arrives.

    The rows, over all micro-batches, are those of ``runlog.best_so_far`` on the whole log.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        found = []
        for row in _in_order(parts).itertuples():
            value = _none(row.value)
            improved = True if best is None else None if value is None else value > best
            found.append((key[0], row.epoch, row.step, row.event, value, best, improved))
            best = _larger(best, value)
        state.update((best,))
        names = [part.split()[0] for part in EVALUATIONS.split(", ")]
        yield pd.DataFrame(found, columns=names, dtype=object)

    return evaluations(log, metric).groupBy("run_id").applyInPandasWithState(
        update, EVALUATIONS, "best double", "append", GroupStateTimeout.NoTimeout
    )


def follow_status(
    log: DataFrame, metric: str = SELECTION_METRIC, patience: int = PATIENCE
) -> DataFrame:
    """Where each run that got lines stands now, in update mode.

    A run's last row is that of ``runlog.early_stop`` on the log so far; the open epoch counts with
    the evaluations it has.
    """

    def closed(rank, top, best, improving):
        """Best value and last improving rank, the open epoch included."""
        if best is None or top is not None and top > best:
            improving = rank
        return _larger(best, top), improving

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = (0, None, None, None, 0, None, None, None)
        rank, epoch, top, best, improving, stop_epoch, stop_rank, stop_best = (
            state.get if state.exists else empty
        )
        for row in _in_order(parts).itertuples():
            if epoch is None or row.epoch > epoch:
                if rank:
                    best, improving = closed(rank, top, best, improving)
                    if stop_rank is None and rank - improving >= patience:
                        stop_epoch, stop_rank, stop_best = epoch, rank, best
                rank, epoch, top = rank + 1, int(row.epoch), None
            top = _larger(top, _none(row.value))
        state.update((rank, epoch, top, best, improving, stop_epoch, stop_rank, stop_best))
        if stop_rank is None:
            stop_best, last = closed(rank, top, best, improving)
            stops = rank - last >= patience
            stop_epoch, stop_rank = epoch if stops else None, rank
        line = (key[0], stop_epoch, stop_rank, rank, stop_best)
        names = [part.split()[0] for part in STATUS.split(", ")]
        yield pd.DataFrame([line], columns=names, dtype=object)

    return evaluations(log, metric).groupBy("run_id").applyInPandasWithState(
        update, STATUS, EPOCH_STATE, "update", GroupStateTimeout.NoTimeout
    )


def follow_windows(log: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Mean losses of every logging window that is over, once.

    A window is over when its run logs a step of a later one, or ends ("run_end"). The rows are
    those of ``runlog.step_windows`` on the whole log, without windows that are still open.
    """
    steps = train_steps(log).select(
        "run_id",
        F.floor((F.col("step") - 1) / every).alias("window"),
        *[f"train_loss_{name}" for name in LOSS_TERMS],
    )
    ends = log.filter(F.col("event") == "run_end").select("run_id")
    lines = steps.unionByName(ends, allowMissingColumns=True)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, ended = {}, False
        if state.exists:
            held[state.get[0]] = list(state.get[1:])
        for rows in parts:
            ended = ended or bool(rows["window"].isna().any())
            for window, part in rows.dropna(subset=["window"]).groupby("window"):
                sums = held.setdefault(int(window), [0] * (1 + 2 * len(LOSS_TERMS)))
                sums[0] += len(part)
                for i, name in enumerate(LOSS_TERMS):
                    values = part[f"train_loss_{name}"].dropna()
                    sums[1 + i] += float(values.sum())
                    sums[1 + len(LOSS_TERMS) + i] += len(values)
        newest = max(held, default=None)
        found = []
        for window in sorted(held):
            if window < newest or ended:
                n, *rest = held[window]
                sums, counts = rest[: len(LOSS_TERMS)], rest[len(LOSS_TERMS) :]
                means = [s / c if c else None for s, c in zip(sums, counts, strict=True)]
                found.append((key[0], window, n, *means))
        if newest is None or ended:
            if state.exists:
                state.remove()
        else:
            n, *rest = held[newest]
            sums = [float(x) for x in rest[: len(LOSS_TERMS)]]
            state.update((newest, n, *sums, *rest[len(LOSS_TERMS) :]))
        names = [part.split()[0] for part in WINDOWS.split(", ")]
        yield pd.DataFrame(found, columns=names, dtype=object)

    return lines.groupBy("run_id").applyInPandasWithState(
        update, WINDOWS, WINDOW_STATE, "append", GroupStateTimeout.NoTimeout
    )
