"""The unified schema: enforce it, check it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import REQUIRED_COLUMNS, UNIFIED_SCHEMA
from modloom.functions.counting import count_where


def enforce_schema(df: DataFrame) -> DataFrame:
    """The fixed columns in order and type: missing ones are null, extra ones are dropped."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in UNIFIED_SCHEMA.fields
        ]
    )


def null_counts() -> list[Column]:
    return [count_where(F.col(name).isNull()).alias(f"null_{name}") for name in REQUIRED_COLUMNS]


def need_schema(df: DataFrame) -> None:
    if df.columns != UNIFIED_SCHEMA.names:
        raise ValueError("the columns differ from the unified schema")


def repeated_uids(df: DataFrame) -> DataFrame:
    """One row: the rows whose uid occurs before. Reads the uid alone."""
    per_uid = df.filter(F.col("uid").isNotNull()).groupBy("uid").agg(F.count(F.lit(1)).alias("n"))
    return per_uid.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_uid_rows"))


def validate_schema(df: DataFrame) -> DataFrame:
    """One row of violation counts; raises at once if the column list differs."""
    need_schema(df)
    # First per uid, then over all: the uid shuffle carries counters only.
    per_uid = df.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), *null_counts())
    return per_uid.agg(
        *[F.coalesce(F.sum(f"null_{name}"), F.lit(0)).alias(f"null_{name}") for name in REQUIRED_COLUMNS],
        F.coalesce(
            F.sum(F.when(F.col("uid").isNotNull(), F.col("n") - 1)), F.lit(0)
        ).alias("repeated_uid_rows"),
    )
