"""Queries on labels, folds and samples write and shuffle no text, and find the same rows."""

import pytest
from pyspark.sql import functions as F

from modloom.plans import registry

FIRST = ["class_weights", "split_leakage", "split_summary", "epoch_resample", "sample_rows", "harmful_rows", "length_grouped"]


@pytest.fixture
def folder(spark, tmp_path):
    docs = spark.range(120).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") != 7, F.concat(F.lit("A text of its own, number "), F.col("id") % 40)).alias("text"),
        F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("lang"),
        F.lit("s").alias("source"),
    )
    labels = spark.range(0, 120, 3).select(
        F.col("id").alias("doc_id"), F.lit(1).alias("quality"), (F.col("id") % 2).cast("int").alias("toxic")
    )
    orders = spark.range(60).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority")
    )
    lines = spark.range(240).select(
        (F.col("id") % 61).alias("l_orderkey"),
        (F.col("id") * 7 % 200).alias("l_partkey"),
        (F.col("id") % 10).alias("l_suppkey"),
        (F.col("id") / 61 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") % 50).cast("double").alias("l_quantity"),
        (F.col("id") * 397 % 100_000).cast("double").alias("l_extendedprice"),
        F.lit(0.06).alias("l_discount"),
        F.lit(0.02).alias("l_tax"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
    )
    # repeated rows, on both sides
    tables = {"documents": docs.union(docs.limit(5)), "labels": labels, "orders": orders.union(orders.limit(2)), "lineitem": lines}
    for name, table in tables.items():
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def stages(spark, folder):
    own = (spark.sparkContext.applicationId, folder)
    return {key[2]: spark.read.parquet(path).columns for key, path in registry._STAGES.items() if key[:2] == own}


def results(spark, folder):
    found = {name: registry.queries()[name](spark, folder).collect() for name in FIRST}
    return {name: sorted(map(repr, rows)) for name, rows in found.items()}


def test_no_text_is_written(spark, folder):
    narrow = results(spark, folder)
    made = stages(spark, folder)
    assert made and all("text" not in columns and "text_raw" not in columns for columns in made.values())
    rows = registry.unified_keys(spark, folder)
    # with the whole table written, its columns are read instead
    whole = registry.unified(spark, folder)
    assert "text" in stages(spark, folder)["unified"]
    again = registry.unified_keys(spark, folder)
    assert rows.count() == whole.count() and rows.exceptAll(again.select(rows.columns)).isEmpty()
    assert results(spark, folder) == narrow


def test_moved_rows_hold_no_text(spark, folder):
    """Of the cleaned texts nothing but hash and length reaches a shuffle."""
    plan = registry.split_keys(spark, folder)
    assert plan.columns == ["uid", "source", "text_hash", "label", "length", "has_targets", "split"]
    assert {"unified-keys", "row-keys"} == set(stages(spark, folder))
