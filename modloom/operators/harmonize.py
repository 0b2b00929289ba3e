"""From the two raw sources to signal tables with common columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.checks import need_columns
from modloom.domains import (
    COUNT_SIGNAL,
    FLAG_LABELS,
    FLAG_SIGNALS,
    FLAG_SOURCE,
    HATE_SCORE,
    MEAN_SIGNALS,
    ORIGIN_SCORES,
    RATINGS,
    RAW_TARGETS,
    SCORE_SOURCE,
    SOURCE_COLUMNS,
    TARGET_COLUMNS,
)
from modloom.functions.counting import count_where
from modloom.functions.text import add_text_columns, make_uid
from modloom.operators.labels import holds, without_nan
from modloom.rules import TEXT_RULES, TextRules


# --- flag source -------------------------------------------------------------------------


def is_unlabeled(labels: Sequence[str] = FLAG_LABELS) -> Column:
    return holds(F.least(*[F.col(name) for name in labels]) < 0)


def split_labeled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled, unlabelled): a row is unlabelled if any flag is negative."""
    return df.filter(~is_unlabeled()), df.filter(is_unlabeled())


def invalid_rows(labels: Sequence[str] = FLAG_LABELS) -> Column:
    """The number of rows with a flag other than 0 and 1."""
    binary = reduce(lambda x, y: x & y, [holds(F.col(name).isin(0, 1)) for name in labels])
    return count_where(~binary).alias("invalid_rows")


def check_binary(df: DataFrame, labels: Sequence[str] = FLAG_LABELS) -> DataFrame:
    return df.agg(invalid_rows(labels))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def join_test_labels(texts: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """Every test text with its flags. Keys are unique on both sides, see check_test_labels."""
    return texts.join(labels.select(key, *FLAG_LABELS), key, "left")


def unmatched_texts(texts: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    return texts.join(labels.select(key), key, "left_anti")


def check_test_labels(texts: DataFrame, labels: DataFrame, key: str = "id") -> DataFrame:
    """One row: repeated keys on either side, and texts without labels."""
    sides = texts.select(key, F.lit(1).alias("t"), F.lit(0).alias("l")).unionByName(
        labels.select(key, F.lit(0).alias("t"), F.lit(1).alias("l"))
    )
    per_key = sides.groupBy(key).agg(F.sum("t").alias("t"), F.sum("l").alias("l"))
    return per_key.agg(
        count_where(F.col("t") > 1).alias("repeated_texts"),
        count_where(F.col("l") > 1).alias("repeated_labels"),
        count_where((F.col("t") > 0) & (F.col("l") == 0)).alias("texts_without_labels"),
    )


def flag_signals(df: DataFrame, origin: str | Column, rules: TextRules = TEXT_RULES) -> DataFrame:
    """Raw flag rows (id, comment_text, six flags) as a signal table."""
    need_columns(df, ["id", "comment_text", *FLAG_LABELS])
    tag = F.lit(origin) if isinstance(origin, str) else origin
    renamed = df.select(
        make_uid(FLAG_SOURCE, F.col("id")).alias("uid"),
        F.lit(FLAG_SOURCE).alias("source"),
        tag.alias("origin"),
        F.col("id").cast("string").alias("source_id"),
        F.col("comment_text").alias("text_raw"),
        *[F.col(name).cast("byte").alias(f"j_{name}") for name in FLAG_LABELS],
    )
    return add_text_columns(renamed, rules).select(*SOURCE_COLUMNS, *FLAG_SIGNALS)


def assemble_parts(
    parts: Sequence[tuple[DataFrame, str]], rules: TextRules = TEXT_RULES
) -> DataFrame:
    """Union of the parts, each tagged with its origin. An empty part adds no rows."""
    tagged = [part.withColumn("part_origin", F.lit(origin)) for part, origin in parts]
    union = reduce(lambda x, y: x.unionByName(y), tagged)
    return flag_signals(union, F.col("part_origin"), rules)


# --- annotator source --------------------------------------------------------------------


def _rating(rows: DataFrame, name: str) -> Column:
    fractional = rows.schema[name].dataType.typeName() in ("float", "double")
    return without_nan(F.col(name), "double") if fractional else F.col(name)


def aggregate_annotators(rows: DataFrame, order: str | Column) -> DataFrame:
    """One row per comment: first text, mean ratings, OR of targets, number of annotators.

    ``order`` says which text is the first one. The partial aggregate runs before the shuffle,
    so a comment with very many annotators costs one row per task. A text as an aggregate's value
    makes it a sort aggregate; fetching the text by its key afterwards would cost a second
    shuffle of all texts instead of the sort.
    """
    ordering = F.col(order) if isinstance(order, str) else order
    numeric = [HATE_SCORE, *RATINGS]
    return (
        rows.filter(F.col("comment_id").isNotNull())
        .groupBy("comment_id")
        .agg(
            F.min_by("text", F.when(F.col("text").isNotNull(), ordering)).alias("text_raw"),
            *[
                F.avg(_rating(rows, name)).cast("float").alias(f"m_{name}")
                for name in numeric
            ],
            F.count(F.lit(1)).alias(COUNT_SIGNAL),
            *[
                F.max(raw).alias(signal)
                for raw, signal in zip(RAW_TARGETS, TARGET_COLUMNS, strict=True)
            ],
        )
        .withColumn("source_id", F.col("comment_id").cast("string"))
        .drop("comment_id")
        .select("source_id", "text_raw", *MEAN_SIGNALS, COUNT_SIGNAL, *TARGET_COLUMNS)
    )


def text_conflicts(rows: DataFrame) -> DataFrame:
    """Comments that carry more than one text.

    Compares 120 bits of a digest as two numbers: no text is shuffled, and numbers, unlike
    strings, can be aggregated by hash.
    """
    digest = F.sha2("text", 256)
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 16)]
    return (
        rows.filter(F.col("comment_id").isNotNull())
        .select("comment_id", halves[0].alias("a"), halves[1].alias("b"))
        .groupBy("comment_id")
        .agg(*[f(name).alias(f"{f.__name__}_{name}") for f in (F.min, F.max) for name in "ab"])
        .filter((F.col("min_a") != F.col("max_a")) | (F.col("min_b") != F.col("max_b")))
        .select("comment_id")
    )


def check_conservation(rows: DataFrame, aggregated: DataFrame) -> DataFrame:
    """One row with the comments in, the rows out and their difference."""
    comments = rows.agg(F.count_distinct("comment_id").alias("n"))
    result = aggregated.agg(F.count(F.lit(1)).alias("n"))
    return (
        comments.withColumn("side", F.lit("comments"))
        .unionByName(result.withColumn("side", F.lit("rows")))
        .agg(
            F.max(F.when(F.col("side") == "comments", F.col("n"))).alias("comments"),
            F.max(F.when(F.col("side") == "rows", F.col("n"))).alias("aggregated_rows"),
        )
        .withColumn("difference", F.col("comments") - F.col("aggregated_rows"))
    )


def annotator_signals(aggregated: DataFrame, rules: TextRules = TEXT_RULES) -> DataFrame:
    tagged = aggregated.withColumns(
        {
            "uid": make_uid(SCORE_SOURCE, F.col("source_id")),
            "source": F.lit(SCORE_SOURCE),
            "origin": F.lit(ORIGIN_SCORES),
        }
    )
    return add_text_columns(tagged, rules).select(
        *SOURCE_COLUMNS, *MEAN_SIGNALS, COUNT_SIGNAL, *TARGET_COLUMNS
    )


# --- both --------------------------------------------------------------------------------


def combine_sources(flags: DataFrame, scores: DataFrame) -> DataFrame:
    """UNION ALL by name; a column that one source lacks is null there."""
    return flags.unionByName(scores, allowMissingColumns=True)
