"""Dataset statistics as long tables of (metric, key1, key2, value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, SPLITS, TARGET_COLUMNS
from modloom.functions.counting import count_where
from modloom.operators.dedup import duplicate_stats
from modloom.operators.labels import crosstab, holds
from modloom.operators.quantiles import exact_quantiles
from modloom.operators.severity import LEVEL_COLUMNS, harmful_rows, severity_quantiles

# Quantiles of the length report.
LENGTH_QUANTILES = (0.5, 0.9, 0.95, 0.99)


def length_percentiles(df: DataFrame) -> DataFrame:
    lengths = df.select(F.length(F.coalesce("text", F.lit(""))).alias("length"))
    return exact_quantiles(lengths, "length", LENGTH_QUANTILES, few_values=True)


def target_counts(df: DataFrame) -> DataFrame:
    """(target, n), most frequent first; null counts as false."""
    counts = df.agg(*[count_where(holds(F.col(name))).alias(name) for name in TARGET_COLUMNS])
    cells = [
        F.struct(F.lit(name).alias("target"), F.col(name).alias("n")) for name in TARGET_COLUMNS
    ]
    return counts.select(F.inline(F.array(*cells))).orderBy(F.desc("n"), "target")


def _line(metric: str, key1: Column | str, key2: Column | str, value: Column) -> Column:
    keys = [k if isinstance(k, Column) else F.lit(k) for k in (key1, key2)]
    return F.struct(
        F.lit(metric).alias("metric"),
        keys[0].alias("key1"),
        keys[1].alias("key2"),
        value.cast("double").alias("value"),
    )


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    return df.select(F.inline(F.array(*lines)))


def percent(q: Column) -> Column:
    return F.round(q * 100).cast("int").cast("string")


def dataset_stats(df: DataFrame) -> DataFrame:
    """The counts of one scan by source, the length percentiles and the duplicate counts."""
    counters = {
        ("class_counts_by_source", name): count_where(F.col("label_name") == name)
        for name in CLASS_NAMES
    }
    counters |= {
        ("split_counts_by_source", name): count_where(F.col("split") == name) for name in SPLITS
    }
    targets = {name: count_where(holds(F.col(name))) for name in TARGET_COLUMNS}
    by_source = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"),
        *[counter.alias(f"{metric}.{name}") for (metric, name), counter in counters.items()],
        *[counter.alias(name) for name, counter in targets.items()],
    )
    lines = [_line("total_rows", "", "", F.col("rows"))]
    lines += [
        _line(metric, F.col("source"), name, F.col(f"`{metric}.{name}`"))
        for metric, name in counters
    ]
    lines += [_line("target_group_counts", name, "", F.col(name)) for name in targets]
    # Totals and targets come once per source and are added up here.
    counts = (
        _lines(by_source, lines)
        .groupBy("metric", "key1", "key2")
        .agg(F.sum("value").alias("value"))
    )
    lengths = length_percentiles(df).select(
        F.lit("text_length_percentiles").alias("metric"),
        percent(F.col("q")).alias("key1"),
        F.lit("").alias("key2"),
        "value",
    )
    duplicates = _lines(
        duplicate_stats(df),
        [
            _line("duplicates", "", name, F.col(name))
            for name in ("duplicate_rows", "duplicate_groups", "conflicting_groups")
        ],
    )
    return counts.unionByName(lengths).unionByName(duplicates)


def calibration_report(df: DataFrame) -> DataFrame:
    """Severity quantiles, cross tables and shares of the harmful rows.

    Both cross tables and the shares are sums over one small table by source and class.
    """
    quantiles = severity_quantiles(df).select(
        F.lit("severity_score_quantiles").alias("metric"),
        F.col("source").alias("key1"),
        percent(F.col("q")).alias("key2"),
        "value",
    )
    cells = crosstab(
        harmful_rows(df), ["source", "label_name"], "severity_name", LEVEL_COLUMNS
    )
    crossed = _lines(
        cells,
        [
            _line(metric, F.col(key), name, F.col(name))
            for metric, key in (("severity_by_source", "source"), ("severity_by_class", "label_name"))
            for name in LEVEL_COLUMNS
        ],
    )
    tables = crossed.groupBy("metric", "key1", "key2").agg(F.sum("value").alias("value"))
    sums = cells.agg(*[F.sum(name).alias(name) for name in LEVEL_COLUMNS])
    everything = reduce(lambda x, y: x + y, [F.col(name) for name in LEVEL_COLUMNS])
    shares = _lines(
        sums,
        [
            _line("severity_share_overall", name, "", F.col(name) / everything)
            for name in LEVEL_COLUMNS
        ],
    ).filter(F.col("value") > 0)
    return quantiles.unionByName(tables).unionByName(shares)
