"""Severity of harmful rows: weighted flags or thresholds on mean ratings."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.checks import need_columns
from modloom.domains import (
    FALLBACK_CLASS,
    FLAG_SOURCE,
    IGNORE_ID,
    NO_SEVERITY,
    SCORE_SOURCE,
    SEVERITY_IDS,
    SEVERITY_NAMES,
)
from modloom.functions.counting import count_where
from modloom.operators.labels import any_of, crosstab, domain_counts, holds, meets, without_nan
from modloom.operators.quantiles import exact_quantiles
from modloom.rules import SEVERITY_RULES, LevelRule, SeverityRules

# Quantiles of the calibration report, signals of the score sum in adding order.
SCORE_QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)
SCORE_SUM = ("m_hate_speech_score", "m_violence", "m_dehumanize", "m_genocide")
SCORE_SIGNALS = (*SCORE_SUM, "m_insult")


def is_harmful() -> Column:
    return F.col("label_name") != FALLBACK_CLASS


def harmful_rows(df: DataFrame) -> DataFrame:
    return df.filter(is_harmful())


def flag_score(df: DataFrame, rules: SeverityRules = SEVERITY_RULES) -> Column:
    need_columns(df, [f"j_{name}" for name in rules.weights])
    parts = [
        F.least(F.greatest(F.coalesce(F.col(f"j_{name}").cast("int"), F.lit(0)), F.lit(0)), F.lit(1))
        * weight
        for name, weight in rules.weights.items()
    ]
    return reduce(lambda x, y: x + y, parts)


def bin_flag_score(score: Column, rules: SeverityRules = SEVERITY_RULES) -> Column:
    """Level whose inclusive bin holds the score; a later bin wins; 0 is no severity."""
    level = F.when(
        score > 0, F.raise_error(F.concat(F.lit("score outside every bin: "), score.cast("string")))
    ).otherwise(F.lit(NO_SEVERITY))
    for name, (low, high) in rules.bins.items():
        level = F.when(score.between(low, high), name).otherwise(level)
    return level


def level_mask(rule: LevelRule) -> Column:
    return any_of([meets(condition) for condition in rule.conditions()])


def score_level(df: DataFrame, rules: SeverityRules = SEVERITY_RULES) -> Column:
    need_columns(df, SCORE_SIGNALS)
    return (
        F.when(level_mask(rules.critical), "critical")
        .when(level_mask(rules.high), "high")
        .when(level_mask(rules.medium), "medium")
        .otherwise("low")
    )


def score_sum(df: DataFrame) -> Column:
    need_columns(df, SCORE_SIGNALS)
    zero = F.lit(0.0).cast("float")
    parts = [F.coalesce(without_nan(F.col(name)), zero) for name in SCORE_SUM]
    return reduce(lambda x, y: x + y, parts).cast("float")


def severity_id(name: Column) -> Column:
    code = F.raise_error(F.concat(F.lit("unknown severity name: "), F.coalesce(name, F.lit("null"))))
    for level, value in SEVERITY_IDS.items():
        code = F.when(name == level, value).otherwise(code)
    return code.cast("short")


def _if_present(df: DataFrame, columns: Sequence[str], build: Callable[[], Column]) -> Column:
    """An expression over ``columns``; if one is missing, the rows that need it fail."""
    missing = [name for name in columns if name not in df.columns]
    return F.raise_error(F.lit(f"missing columns {missing}")) if missing else build()


def derive_severity(df: DataFrame, rules: SeverityRules = SEVERITY_RULES) -> DataFrame:
    """Adds severity, severity_score and severity_name; one projection, no shuffle."""
    need_columns(df, ["source", "label_name"])
    from_flags = F.col("source") == FLAG_SOURCE
    from_scores = F.col("source") == SCORE_SOURCE
    unknown = F.raise_error(
        F.concat(F.lit("unknown source: "), F.coalesce(F.col("source"), F.lit("null")))
    )
    flag_part = _if_present(df, [f"j_{name}" for name in rules.weights], lambda: flag_score(df, rules))
    level_part = _if_present(df, SCORE_SIGNALS, lambda: score_level(df, rules))
    sum_part = _if_present(df, SCORE_SIGNALS, lambda: score_sum(df))
    name = (
        F.when(from_flags, bin_flag_score(flag_part.cast("int"), rules))
        .when(from_scores, level_part)
        .otherwise(unknown)
    )
    score = F.when(from_flags, flag_part.cast("float")).otherwise(sum_part.cast("float"))
    harmful = holds(is_harmful())
    # The source is checked for every row, harmful or not.
    graded = df.withColumns({"rule_name": name, "rule_score": score})
    return (
        graded.withColumns(
            {
                "severity_name": F.when(harmful, F.col("rule_name")).otherwise(
                    F.when(F.col("rule_name").isNotNull(), NO_SEVERITY)
                ),
                "severity_score": F.when(harmful, F.col("rule_score")).otherwise(
                    F.lit(0.0).cast("float")
                ),
            }
        )
        .withColumn("severity", severity_id(F.col("severity_name")))
        .drop("rule_name", "rule_score")
    )


def severity_counts() -> list[Column]:
    """The counts that a check of graded rows needs."""
    harmful = is_harmful()
    return [
        count_where(~harmful & (F.col("severity") != IGNORE_ID)).alias("neither_with_id"),
        count_where(~harmful & (F.col("severity_name") != NO_SEVERITY)).alias("neither_with_name"),
        count_where(harmful).alias("harmful"),
        *[
            count_where(harmful & (F.col("severity_name") == name)).alias(name)
            for name in SEVERITY_NAMES
        ],
    ]


def severity_check(df: DataFrame, rules: SeverityRules = SEVERITY_RULES) -> DataFrame:
    """One row of violation counts: graded fallback rows, and levels below the minimum share."""
    return judge_severity(df.agg(*severity_counts()), rules)


def judge_severity(counts: DataFrame, rules: SeverityRules = SEVERITY_RULES) -> DataFrame:
    """``severity_check`` from its one row of counts."""
    share_low = [
        (
            (F.col("harmful") > 0)
            & (F.col(name) / F.greatest(F.col("harmful"), F.lit(1)) < rules.min_level_share)
        )
        .cast("int")
        .alias(f"low_share_{name}")
        for name in SEVERITY_NAMES
    ]
    return counts.select("neither_with_id", "neither_with_name", *share_low)


def severity_quantiles(df: DataFrame) -> DataFrame:
    """(source, q, value) of the severity score over harmful rows."""
    scores = harmful_rows(df).select("source", F.col("severity_score").cast("double").alias("score"))
    return exact_quantiles(scores, "score", SCORE_QUANTILES, ["source"])


LEVEL_COLUMNS = (*SEVERITY_NAMES, NO_SEVERITY)


def severity_by_source(df: DataFrame) -> DataFrame:
    return crosstab(harmful_rows(df), ["source"], "severity_name", LEVEL_COLUMNS)


def severity_by_class(df: DataFrame) -> DataFrame:
    return crosstab(harmful_rows(df), ["label_name"], "severity_name", LEVEL_COLUMNS)


def severity_shares(df: DataFrame) -> DataFrame:
    counts = domain_counts(harmful_rows(df), "severity_name", LEVEL_COLUMNS).filter("n > 0")
    return counts.select(
        F.col("name").alias("severity_name"), "n", (F.col("n") / F.col("total")).alias("share")
    )
