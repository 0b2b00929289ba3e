"""Duplicate and label-conflict flags. Duplicates are marked, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, SOURCES
from modloom.functions.counting import count_where
from modloom.operators.groups import HOT_GROUP_ROWS, attach_groups, group_table, has_conflict, present, written_groups
from modloom.sources.storage import cut_lineage


def with_flags(groups: DataFrame) -> DataFrame:
    size = F.col("group_size")
    return groups.withColumns(
        {
            "is_duplicate": size > 1,
            "dup_group_size": size,
            "label_conflict": has_conflict(),
        }
    )


def add_duplicate_flags(df: DataFrame, hot_rows: int = HOT_GROUP_ROWS) -> DataFrame:
    """Adds is_duplicate, dup_group_size and label_conflict per text_hash."""
    # Only groups of two or more take part in the join; the rest get the defaults.
    repeated = with_flags(written_groups(df)).filter(F.col("group_size") > 1)
    repeated = cut_lineage(
        repeated.select("text_hash", "group_size", "dup_group_size", "label_conflict"), "repeated"
    )
    joined = attach_groups(
        df, repeated, ["dup_group_size", "label_conflict"], "group_size", hot_rows=hot_rows
    )
    return joined.withColumns(
        {
            "is_duplicate": F.col("dup_group_size").isNotNull(),
            "dup_group_size": F.coalesce(F.col("dup_group_size"), F.lit(1).cast("long")),
            "label_conflict": F.coalesce(F.col("label_conflict"), F.lit(False)),
        }
    )


def duplicate_stats(df: DataFrame) -> DataFrame:
    """Duplicate rows, duplicate groups and conflicting groups, as one row."""
    return stats_of(with_flags(group_table(df)))


def stats_of(groups: DataFrame) -> DataFrame:
    """The same from a group table with flags."""
    return groups.agg(
        F.coalesce(
            F.sum(F.when(F.col("is_duplicate"), F.col("group_size"))), F.lit(0)
        ).alias("duplicate_rows"),
        count_where("is_duplicate").alias("duplicate_groups"),
        count_where("label_conflict").alias("conflicting_groups"),
    )


def _names_present(position: int, names: tuple[str, ...]) -> Column:
    ordered = sorted(names)
    return F.array_compact(
        F.array(*[F.when(present(position, name), F.lit(name)) for name in ordered])
    )


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Per duplicate group: size, sorted sources, sorted classes, any conflict."""
    groups = with_flags(group_table(df)).filter("is_duplicate")
    return groups.select(
        "text_hash",
        "dup_group_size",
        _names_present(0, SOURCES).alias("sources"),
        _names_present(1, CLASS_NAMES).alias("labels"),
        "label_conflict",
    )


def label_rank(label: Column) -> Column:
    """Precedence of a class: the most harmful one ranks 0."""
    return (F.lit(len(CLASS_NAMES) - 1) - label).cast("int")
