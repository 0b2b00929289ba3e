"""Metrics of scored rows. Each metric set is one pass of counters and one row of result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, IGNORE_ID, SEVERITY_NAMES, TARGET_NAMES
from modloom.functions.counting import count_where
from modloom.functions.scores import argmax, sigmoid, total

TARGET_THRESHOLD = 0.5


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom`` with 0 for a zero denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def as_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """One row of counters to (metric, value) rows."""
    cells = [
        F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
        for name, value in metrics.items()
    ]
    return df.select(F.inline(F.array(*cells)))


def _confusion_counters(true: Column, predicted: Column, width: int) -> list[Column]:
    counters = [
        F.count(F.lit(1)).alias("rows"),
        count_where(true == predicted).alias("right"),
    ]
    for i in range(width):
        counters += [
            count_where((true == i) & (predicted == i)).alias(f"tp{i}"),
            count_where(predicted == i).alias(f"pred{i}"),
            count_where(true == i).alias(f"true{i}"),
        ]
    return counters


def _f1(i: int) -> Column:
    return ratio(2 * F.col(f"tp{i}"), F.col(f"pred{i}") + F.col(f"true{i}"))


def _precision(i: int) -> Column:
    return ratio(F.col(f"tp{i}"), F.col(f"pred{i}"))


def _recall(i: int) -> Column:
    return ratio(F.col(f"tp{i}"), F.col(f"true{i}"))


def _mean(parts: list[Column]) -> Column:
    return total(parts) / len(parts)


def _weighted(parts: list[Column]) -> Column:
    support = [F.col(f"true{i}") for i in range(len(parts))]
    return ratio(total([p * s for p, s in zip(parts, support, strict=True)]), total(support))


def class_metrics(df: DataFrame) -> DataFrame:
    width = len(CLASS_NAMES)
    scored = df.select("label", argmax(F.col("class_logits")).alias("predicted"))
    counts = scored.agg(*_confusion_counters(F.col("label"), F.col("predicted"), width))
    f1 = [_f1(i) for i in range(width)]
    return as_metrics(
        counts,
        {
            "val_accuracy_class": ratio(F.col("right"), F.col("rows")),
            "val_macro_f1_class": _mean(f1),
            "val_weighted_f1_class": _weighted(f1),
        },
    )


def graded_rows(df: DataFrame) -> DataFrame:
    """(severity, predicted) of the rows that have a severity."""
    return df.filter(F.col("severity") != IGNORE_ID).select(
        F.col("severity").cast("int"), argmax(F.col("severity_logits")).alias("predicted")
    )


def _severity_counts(df: DataFrame) -> DataFrame:
    return graded_rows(df).agg(
        *_confusion_counters(F.col("severity"), F.col("predicted"), len(SEVERITY_NAMES))
    )


def severity_metrics(df: DataFrame) -> DataFrame:
    f1 = [_f1(i) for i in range(len(SEVERITY_NAMES))]
    return as_metrics(
        _severity_counts(df),
        {
            "val_accuracy_severity": ratio(F.col("right"), F.col("rows")),
            "val_macro_f1_severity": _mean(f1),
            "val_num_severity_rows": F.col("rows"),
        },
    )


def target_metrics(df: DataFrame) -> DataFrame:
    """Per-target precision, recall and F1, their means, and exact-match accuracy."""
    width = len(TARGET_NAMES)
    rows = df.filter("has_targets").select(
        *[
            (sigmoid(F.col("target_logits")[i].cast("double")) >= TARGET_THRESHOLD).alias(f"p{i}")
            for i in range(width)
        ],
        *[(F.col("targets")[i].cast("int") == 1).alias(f"t{i}") for i in range(width)],
    )
    exact = reduce(lambda x, y: x & y, [F.col(f"p{i}") == F.col(f"t{i}") for i in range(width)])
    counters = [F.count(F.lit(1)).alias("rows"), count_where(exact).alias("exact")]
    for i in range(width):
        counters += [
            count_where(F.col(f"p{i}") & F.col(f"t{i}")).alias(f"tp{i}"),
            count_where(f"p{i}").alias(f"pred{i}"),
            count_where(f"t{i}").alias(f"true{i}"),
        ]
    metrics = {
        "val_num_target_rows": F.col("rows"),
        "val_macro_f1_target": _mean([_f1(i) for i in range(width)]),
        "val_macro_precision_target": _mean([_precision(i) for i in range(width)]),
        "val_macro_recall_target": _mean([_recall(i) for i in range(width)]),
        "val_subset_accuracy_target": ratio(F.col("exact"), F.col("rows")),
    }
    for i, name in enumerate(TARGET_NAMES):
        metrics[f"val_precision_target_{name}"] = _precision(i)
        metrics[f"val_recall_target_{name}"] = _recall(i)
        metrics[f"val_f1_target_{name}"] = _f1(i)
    return as_metrics(rows.agg(*counters), metrics)


def all_metrics(df: DataFrame) -> DataFrame:
    return class_metrics(df).unionByName(severity_metrics(df)).unionByName(target_metrics(df))


def select_metric(metrics: DataFrame, name: str) -> DataFrame:
    return metrics.filter(F.col("metric") == name).select("value")


def severity_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per level, then accuracy, macro and weighted means."""
    width = len(SEVERITY_NAMES)
    sets = {
        "precision": [_precision(i) for i in range(width)],
        "recall": [_recall(i) for i in range(width)],
        "f1": [_f1(i) for i in range(width)],
    }

    def line(name: str, values: dict[str, Column], support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("level"),
            *[value.alias(key) for key, value in values.items()],
            support.alias("support"),
        )

    rows = F.col("rows")
    accuracy = ratio(F.col("right"), rows)
    lines = [
        line(name, {key: parts[i] for key, parts in sets.items()}, F.col(f"true{i}"))
        for i, name in enumerate(SEVERITY_NAMES)
    ]
    lines += [
        line("accuracy", {key: accuracy for key in sets}, rows),
        line("macro avg", {key: _mean(parts) for key, parts in sets.items()}, rows),
        line("weighted avg", {key: _weighted(parts) for key, parts in sets.items()}, rows),
    ]
    return _severity_counts(df).select(F.inline(F.array(*lines)))


def severity_confusion(df: DataFrame) -> DataFrame:
    """Dense true x predicted table, one row per true level."""
    width = len(SEVERITY_NAMES)
    counts = graded_rows(df).agg(
        *[
            count_where((F.col("severity") == i) & (F.col("predicted") == j)).alias(f"c{i}{j}")
            for i in range(width)
            for j in range(width)
        ]
    )
    lines = [
        F.struct(
            F.lit(true).alias("true_level"),
            *[F.col(f"c{i}{j}").alias(f"pred_{name}") for j, name in enumerate(SEVERITY_NAMES)],
        )
        for i, true in enumerate(SEVERITY_NAMES)
    ]
    return counts.select(F.inline(F.array(*lines)))


def severity_distance(df: DataFrame) -> DataFrame:
    """Wrong rows one level off and further off; no rows if nothing is wrong."""
    gap = F.abs(F.col("severity") - F.col("predicted"))
    counts = graded_rows(df).agg(
        count_where(gap == 1).alias("adjacent"), count_where(gap > 1).alias("distant")
    )
    errors = F.col("adjacent") + F.col("distant")
    lines = [
        F.struct(
            F.lit(name).alias("kind"),
            F.col(name).alias("n"),
            ratio(F.col(name), errors).alias("share"),
        )
        for name in ("adjacent", "distant")
    ]
    return counts.filter(errors > 0).select(F.inline(F.array(*lines)))


# --- thresholds --------------------------------------------------------------------------

# Slices per doubling of a logit's distance from zero. A slice table has at most 8 x 9,000 rows,
# for logits from one thousandth to the largest float.
SLICES = 32


def logit_slice(logit: Column) -> Column:
    """A whole number that never falls as the logit grows, with fine steps at every scale."""
    return F.floor(F.signum(logit) * F.log2(1 + F.abs(logit) * 1024) * SLICES).cast("int")


def _target_scores(df: DataFrame) -> DataFrame:
    """Distinct logits per target with their rows, positives, and hits at the flat threshold.

    The sigmoid is monotonic, so the curve over the raw logits is the curve over the scores,
    without any rounding.
    """
    width = len(TARGET_NAMES)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("target_id"),
                F.col("target_logits")[i].alias("logit"),
                (F.col("targets")[i] > 0).cast("int").alias("positive"),
            )
            for i in range(width)
        ]
    )
    flat = sigmoid(F.col("logit").cast("double")) >= TARGET_THRESHOLD
    return (
        df.filter("has_targets")
        .select(F.inline(cells))
        .groupBy("target_id", "logit")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("positive").alias("positives"),
            count_where(flat).alias("flat_predicted"),
            count_where(flat & (F.col("positive") == 1)).alias("flat_hits"),
        )
    )


def threshold_table(df: DataFrame) -> DataFrame:
    """Per target: positives, F1 at 0.5, best threshold and its F1; the lowest one on a tie.

    A threshold is the sigmoid of an observed logit, in double precision. The running counts from
    the highest logit down are slice totals plus a running count inside the slice, so no window
    spans a whole target.
    """
    scores = _target_scores(df).withColumn("slice", logit_slice(F.col("logit").cast("double")))
    slices = scores.groupBy("target_id", "slice").agg(
        *[
            F.sum(name).alias(name)
            for name in ("n", "positives", "flat_predicted", "flat_hits")
        ]
    )
    higher = (
        Window.partitionBy("target_id").orderBy(F.desc("slice")).rowsBetween(
            Window.unboundedPreceding, -1
        )
    )
    whole = Window.partitionBy("target_id")
    offsets = slices.select(
        "target_id",
        "slice",
        F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("above_n"),
        F.coalesce(F.sum("positives").over(higher), F.lit(0)).alias("above_positives"),
        F.sum("positives").over(whole).alias("all_positives"),
        F.sum("flat_predicted").over(whole).alias("all_flat_predicted"),
        F.sum("flat_hits").over(whole).alias("all_flat_hits"),
    )
    down = Window.partitionBy("target_id", "slice").orderBy(F.desc("logit"))
    curve = scores.join(F.broadcast(offsets), ["target_id", "slice"]).select(
        "target_id",
        "logit",
        "all_positives",
        "all_flat_predicted",
        "all_flat_hits",
        (F.col("above_n") + F.sum("n").over(down)).alias("predicted"),
        (F.col("above_positives") + F.sum("positives").over(down)).alias("hits"),
    )
    f1 = ratio(2 * F.col("hits"), F.col("predicted") + F.col("all_positives"))
    best = curve.groupBy("target_id").agg(
        F.max(F.struct(f1.alias("f1"), (-F.col("logit")).alias("below"))).alias("best"),
        F.max("all_positives").alias("positives"),
        F.max("all_flat_predicted").alias("flat_predicted"),
        F.max("all_flat_hits").alias("flat_hits"),
    )
    names = F.array(*[F.lit(name) for name in TARGET_NAMES])
    domain = df.sparkSession.range(len(TARGET_NAMES)).select(
        F.col("id").cast("int").alias("target_id"),
        F.element_at(names, F.col("id").cast("int") + 1).alias("target"),
    )
    positives = F.coalesce("positives", F.lit(0))
    usable = positives > 0
    return domain.join(best, "target_id", "left").select(
        "target",
        positives.alias("positives"),
        F.when(
            usable,
            ratio(2 * F.col("flat_hits"), F.col("flat_predicted") + F.col("positives")),
        )
        .otherwise(0.0)
        .alias("flat_f1"),
        F.when(usable, sigmoid((-F.col("best.below")).cast("double"))).otherwise(0.5).alias("best_threshold"),
        F.when(usable, F.col("best.f1")).otherwise(0.0).alias("best_f1"),
    )


def best_threshold(df: DataFrame) -> DataFrame:
    return threshold_table(df).select("target", "best_threshold", "best_f1")
