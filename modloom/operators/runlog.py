"""Questions to a training log: windowed means, best so far, early stop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from modloom.domains import TARGET_NAMES

LOSS_TERMS = ("total", "class", "severity", "target")
# The names of the metrics that an evaluation logs.
EVAL_METRICS = (
    "val_accuracy_class",
    "val_macro_f1_class",
    "val_weighted_f1_class",
    "val_accuracy_severity",
    "val_macro_f1_severity",
    "val_num_severity_rows",
    "val_num_target_rows",
    "val_macro_f1_target",
    "val_macro_precision_target",
    "val_macro_recall_target",
    "val_subset_accuracy_target",
    *(f"val_{kind}_target_{name}" for name in TARGET_NAMES for kind in ("precision", "recall", "f1")),
)
# Fixed values of the training setup.
LOG_EVERY = 10
PATIENCE = 2
SELECTION_METRIC = "val_macro_f1_class"
# Log lines per slice of a long epoch.
SLICE_STEPS = 100_000


def _means() -> list:
    return [F.avg(f"train_loss_{name}").alias(f"train_loss_{name}") for name in LOSS_TERMS]


def train_steps(log: DataFrame) -> DataFrame:
    return log.filter(F.col("event") == "train_step")


def step_windows(log: DataFrame, every: int = LOG_EVERY) -> DataFrame:
    """Mean losses per run and logging window of ``every`` steps."""
    window = F.floor((F.col("step") - 1) / every).alias("window")
    return train_steps(log).groupBy("run_id", window).agg(F.count(F.lit(1)).alias("n"), *_means())


def epoch_means(log: DataFrame) -> DataFrame:
    return (
        train_steps(log).groupBy("run_id", "epoch").agg(F.count(F.lit(1)).alias("n"), *_means())
    )


def evaluations(log: DataFrame, metric: str = SELECTION_METRIC) -> DataFrame:
    """Evaluations inside an epoch and the one that closes it."""
    return log.filter(F.col("event").isin("eval", "epoch")).select(
        "run_id",
        "epoch",
        "step",
        "event",
        # the evaluation that closes an epoch comes after one at the same step
        (F.col("event") == "epoch").cast("int").alias("event_rank"),
        F.col(metric).alias("value"),
    )


def best_so_far(
    log: DataFrame, metric: str = SELECTION_METRIC, slice_steps: int = SLICE_STEPS
) -> DataFrame:
    """Every evaluation with the best earlier value and whether it beats it strictly.

    The earlier best is the best of all earlier slices, from a table with one row per slice, and
    of the rows before it in its own slice. A long run is thus never ordered in one task.
    """
    rows = evaluations(log, metric).withColumn("slice", F.floor(F.col("step") / slice_steps))
    slices = rows.groupBy("run_id", "epoch", "slice").agg(F.max("value").alias("top"))
    earlier = (
        Window.partitionBy("run_id")
        .orderBy("epoch", "slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before_slice = slices.withColumn("before_slice", F.max("top").over(earlier)).drop("top")
    inside = (
        Window.partitionBy("run_id", "epoch", "slice")
        .orderBy("step", "event_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # The window runs first: the join on its own keys then reuses its shuffle.
    ranked = rows.withColumn("before_row", F.max("value").over(inside))
    joined = ranked.join(before_slice, ["run_id", "epoch", "slice"])
    previous = F.greatest("before_slice", "before_row")
    return joined.select(
        "run_id",
        "epoch",
        "step",
        "event",
        "value",
        previous.alias("previous_best"),
        (previous.isNull() | (F.col("value") > previous)).alias("improved"),
    )


def early_stop(
    log: DataFrame, metric: str = SELECTION_METRIC, patience: int = PATIENCE
) -> DataFrame:
    """Per run: best value, and the epoch after which training stops.

    An epoch improves if its best evaluation beats all earlier epochs, so epochs are reduced to
    one row each before they are ordered.
    """
    epochs = evaluations(log, metric).groupBy("run_id", "epoch").agg(F.max("value").alias("top"))
    in_order = Window.partitionBy("run_id").orderBy("epoch")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = epochs.select(
        "run_id",
        "epoch",
        "top",
        F.row_number().over(in_order).alias("rank"),
        F.max("top").over(earlier).alias("previous"),
    ).withColumn("improved", F.col("previous").isNull() | (F.col("top") > F.col("previous")))
    streak = marked.withColumn(
        "idle",
        F.col("rank")
        - F.max(F.when(F.col("improved"), F.col("rank"))).over(
            in_order.rowsBetween(Window.unboundedPreceding, 0)
        ),
    )
    stops = streak.groupBy("run_id").agg(
        F.min(F.when(F.col("idle") >= patience, F.struct("rank", "epoch"))).alias("stop"),
        F.max("rank").alias("epochs"),
    )
    cut = streak.join(stops, "run_id").filter(
        F.col("stop").isNull() | (F.col("rank") <= F.col("stop.rank"))
    )
    return cut.groupBy("run_id").agg(
        F.max("stop.epoch").alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs_run"),
        F.max("epochs").alias("epochs_logged"),
        F.max("top").alias("best_metric"),
    )
