"""Loss weights and evaluation losses as aggregates over scored rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, IGNORE_ID, TARGET_NAMES
from modloom.functions.counting import count_where
from modloom.functions.scores import bce_with_logits, elements, expected_level, log_sum_exp, total

# Fixed values of the training setup.
LABEL_SMOOTHING = 0.05
LAMBDA_SEVERITY = 0.5
LAMBDA_TARGET = 0.2


def _inverse_sqrt_weights(counts: list[Column]) -> list[Column]:
    """1 / sqrt(count), scaled to mean 1; an empty class counts as one row."""
    inverse = [1.0 / F.sqrt(F.greatest(n, F.lit(1)).cast("double")) for n in counts]
    scale = len(counts) / total(inverse)
    return [weight * scale for weight in inverse]


def _lines(df: DataFrame, key: str, names: Sequence[str], counts: list[Column]) -> DataFrame:
    cells = [
        F.struct(F.lit(name).alias(key), n.alias("n"), F.col("weights")[i].alias("weight"))
        for i, (name, n) in enumerate(zip(names, counts, strict=True))
    ]
    return df.select(F.inline(F.array(*cells)))


def _class_row(df: DataFrame) -> DataFrame:
    counts = df.agg(
        *[count_where(F.col("label") == i).alias(f"n{i}") for i in range(len(CLASS_NAMES))]
    )
    columns = [F.col(f"n{i}") for i in range(len(CLASS_NAMES))]
    return counts.withColumn("weights", F.array(*_inverse_sqrt_weights(columns)))


def _target_row(df: DataFrame) -> DataFrame:
    width = len(TARGET_NAMES)
    counts = df.filter("has_targets").agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.coalesce(F.sum(F.col("targets")[i].cast("double")), F.lit(0.0)).alias(f"n{i}")
            for i in range(width)
        ],
    )
    weights = _inverse_sqrt_weights([F.col(f"n{i}") for i in range(width)])
    usable = F.col("rows") > 0
    return counts.withColumn(
        "weights", F.array(*[F.when(usable, weight).otherwise(1.0) for weight in weights])
    )


def class_weights(df: DataFrame) -> DataFrame:
    """(label_name, n, weight) over the fixed classes."""
    counts = [F.col(f"n{i}") for i in range(len(CLASS_NAMES))]
    return _lines(_class_row(df), "label_name", CLASS_NAMES, counts)


def target_weights(df: DataFrame) -> DataFrame:
    """(target, n, weight) over the positives of rows with targets; all 1 without such rows."""
    counts = [F.col(f"n{i}") for i in range(len(TARGET_NAMES))]
    return _lines(_target_row(df), "target", TARGET_NAMES, counts)


def class_weight_vector(df: DataFrame) -> list[Column]:
    """The class weights in id order, read from one scalar subquery."""
    vector = _class_row(df).select("weights").scalar()
    return [vector[i] for i in range(len(CLASS_NAMES))]


def target_weight_vector(df: DataFrame) -> list[Column]:
    vector = _target_row(df).select("weights").scalar()
    return [vector[i] for i in range(len(TARGET_NAMES))]


def _literals(values: Sequence[float | Column] | None, width: int) -> list[Column]:
    chosen = [1.0] * width if values is None else list(values)
    return [v if isinstance(v, Column) else F.lit(float(v)) for v in chosen]


def loss_terms(
    df: DataFrame,
    by: Sequence[str] = (),
    class_weight: Sequence[float | Column] | None = None,
    target_weight: Sequence[float | Column] | None = None,
    smoothing: float = LABEL_SMOOTHING,
) -> DataFrame:
    """(*by, class, severity, target) losses; the sums are combined before any shuffle."""
    classes, targets = len(CLASS_NAMES), len(TARGET_NAMES)
    cw = _literals(class_weight, classes)
    tw = _literals(target_weight, targets)
    logits = F.col("class_logits")
    surprise = [log_sum_exp(logits, classes) - x for x in elements(logits, classes)]

    def of_label(values: list[Column]) -> Column:
        chosen = values[-1]
        for i in range(classes - 2, -1, -1):
            chosen = F.when(F.col("label") == i, values[i]).otherwise(chosen)
        return chosen

    label_weight = of_label(cw)
    smooth = total([w * s for w, s in zip(cw, surprise, strict=True)])
    class_part = (1 - smoothing) * label_weight * of_label(surprise) + smoothing / classes * smooth
    error = expected_level(F.col("severity_logits")) - F.col("severity").cast("double")
    per_target = [
        bce_with_logits(
            F.col("target_logits")[i].cast("double"), F.col("targets")[i].cast("double")
        )
        * tw[i]
        for i in range(targets)
    ]
    rows = df.select(
        *by,
        class_part.alias("class_part"),
        label_weight.alias("class_mass"),
        F.when(F.col("severity") != IGNORE_ID, error * error).alias("severity_part"),
        F.when(F.col("has_targets"), total(per_target) / targets).alias("target_part"),
    )
    return rows.groupBy(*by).agg(
        (F.sum("class_part") / F.sum("class_mass")).alias("class"),
        F.coalesce(F.avg("severity_part"), F.lit(0.0)).alias("severity"),
        F.coalesce(F.avg("target_part"), F.lit(0.0)).alias("target"),
    )


def with_total(
    losses: DataFrame,
    lambda_severity: float = LAMBDA_SEVERITY,
    lambda_target: float = LAMBDA_TARGET,
) -> DataFrame:
    combined = (
        F.col("class") + lambda_severity * F.col("severity") + lambda_target * F.col("target")
    )
    return losses.withColumn("total", combined)


def mean_batch_losses(losses: DataFrame) -> DataFrame:
    """Evaluation losses: the mean of per-batch losses."""
    return losses.agg(
        *[F.avg(name).alias(name) for name in ("class", "severity", "target", "total")]
    )
