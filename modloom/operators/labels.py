"""Class rules: signal masks, prioritised labels, class distributions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.checks import need_columns
from modloom.domains import CLASS_IDS, CLASS_NAMES, FALLBACK_CLASS
from modloom.functions.counting import count_where
from modloom.rules import LABEL_RULES, LabelRules, ScoreRule


def holds(condition: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(condition, F.lit(False))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def without_nan(value: Column, kind: str = "float") -> Column:
    """NaN compares as the largest number in Spark, so read it as null first."""
    return F.nanvl(value.cast(kind), F.lit(None).cast(kind))


def any_flag(df: DataFrame, labels: Sequence[str]) -> Column:
    names = [f"j_{label}" for label in labels]
    need_columns(df, names)
    return any_of([holds(F.col(name) == 1) for name in names])


def meets(rule: ScoreRule) -> Column:
    value = without_nan(F.col(rule.column))
    bound = F.lit(float(rule.minimum)).cast("float")
    return holds(value >= bound if rule.inclusive else value > bound)


def score_mask(df: DataFrame, rule: ScoreRule) -> Column:
    need_columns(df, [rule.column])
    return meets(rule)


def assign_label(masks: Mapping[str, Column], priority: Sequence[str]) -> Column:
    """Id of the first class in ``priority`` whose mask is true, else the fallback class."""
    unknown = [name for name in masks if name not in CLASS_IDS]
    if unknown:
        raise ValueError(f"unknown class names {unknown}")
    if FALLBACK_CLASS in masks:
        raise ValueError(f"{FALLBACK_CLASS!r} is the fallback class and takes no rule")
    ranked = [name for name in priority if name in masks]
    label = F.lit(CLASS_IDS[FALLBACK_CLASS])
    for name in reversed(ranked):
        label = F.when(masks[name], CLASS_IDS[name]).otherwise(label)
    return label.cast("byte")


def class_name(label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(name) for name in CLASS_NAMES]), label.cast("int") + 1)


def add_label_columns(
    df: DataFrame, masks: Mapping[str, Column], priority: Sequence[str]
) -> DataFrame:
    return df.withColumn("label", assign_label(masks, priority)).withColumn(
        "label_name", class_name(F.col("label"))
    )


def label_flags(df: DataFrame, rules: LabelRules = LABEL_RULES) -> DataFrame:
    masks = {name: any_flag(df, labels) for name, labels in rules.flags.items()}
    return add_label_columns(df, masks, rules.priority)


def label_scores(df: DataFrame, rules: LabelRules = LABEL_RULES) -> DataFrame:
    masks = {name: score_mask(df, rule) for name, rule in rules.scores.items()}
    return add_label_columns(df, masks, rules.priority)


def crosstab(
    df: DataFrame, rows: Sequence[str], column: str, values: Sequence[str]
) -> DataFrame:
    """Counts of ``column`` per ``rows`` with one output column per value, zero filled.

    One hash aggregate with a counter per value: a single shuffle of pre-aggregated rows.
    """
    return df.groupBy(*rows).agg(
        *[count_where(F.col(column) == value).alias(value) for value in values]
    )


def class_distribution(df: DataFrame) -> DataFrame:
    return crosstab(df, ["source"], "label_name", CLASS_NAMES)


def domain_counts(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """(name, position, n, total) for every value of the domain, absent ones with n = 0."""
    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_where(F.col(column) == value).alias(f"n_{i}") for i, value in enumerate(values)],
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(value).alias("name"),
                F.lit(i).alias("position"),
                F.col(f"n_{i}").alias("n"),
            )
            for i, value in enumerate(values)
        ]
    )
    return counts.select("total", F.inline(cells))


def class_shares(df: DataFrame) -> DataFrame:
    counts = domain_counts(df, "label_name", CLASS_NAMES)
    share = F.col("n") / F.greatest(F.col("total"), F.lit(1))
    return counts.select(F.col("name").alias("label_name"), "position", "n", share.alias("share"))


def underrepresented_classes(
    df: DataFrame, min_share: float = LABEL_RULES.min_class_share
) -> DataFrame:
    return class_shares(df).filter(F.col("share") < min_share)
