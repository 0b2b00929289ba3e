"""Scans of the raw inputs: flag CSV files, annotator tables, training logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.checks import need_columns
from modloom.domains import FLAG_LABELS, HATE_SCORE, RATINGS, RAW_TARGETS
from modloom.operators.runlog import EVAL_METRICS, LOSS_TERMS
from modloom.sources import csv_records

ANNOTATOR_COLUMNS = ("comment_id", "text", HATE_SCORE, *RATINGS, *RAW_TARGETS)
TRAIN_COLUMNS = ("id", "comment_text", *FLAG_LABELS)
TEST_COLUMNS = ("id", "comment_text")
TEST_LABEL_COLUMNS = ("id", *FLAG_LABELS)

CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
}


def _csv_type(name: str) -> T.DataType:
    return T.ByteType() if name in FLAG_LABELS else T.StringType()


def csv_header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    return spark.read.options(**CSV_OPTIONS | {"multiLine": multi_line}).csv(path).columns


def has_quoted_breaks(spark: SparkSession, path: str) -> bool:
    """True if some line ends inside quotes, that is, holds an odd number of them.

    Reads the files as lines, in splits, and stops at the first such line.
    """
    odd = F.regexp_count("value", F.lit('"')) % 2 == 1
    return not spark.read.text(path).filter(odd).isEmpty()


def read_flag_csv(
    spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """Typed scan of the wanted columns. "NA" and line breaks are text; empty text stays empty.

    Large files are read in splits, with or without quoted line breaks (``csv_records``). Files
    that use quotes in other ways than around whole fields need ``multi_line=True``: Spark's own
    reader, one task per file. ``multi_line=False`` says that no line break is quoted.
    """
    header = csv_header(spark, path, multi_line is not False)
    missing = [name for name in columns if name not in header]
    if missing:
        raise KeyError(f"{path} is missing columns {missing}")
    schema = T.StructType([T.StructField(name, _csv_type(name)) for name in header])
    if multi_line is None and has_quoted_breaks(spark, path):
        options = {k: v for k, v in CSV_OPTIONS.items() if k != "header"} | {"mode": "FAILFAST"}
        kinds = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)
        parsed = F.from_csv("record", kinds, options)
        df = csv_records.records(spark, path, header).select(parsed.alias("row")).select("row.*")
    else:
        df = (
            spark.read.schema(schema)
            .options(
                **CSV_OPTIONS | {"multiLine": bool(multi_line)}, mode="FAILFAST", enforceSchema="false"
            )
            .csv(path)
        )
    return df.select(
        *[
            F.coalesce(F.col(name), F.lit("")).alias(name)
            if isinstance(_csv_type(name), T.StringType)
            else F.col(name)
            for name in columns
        ]
    )


def write_flag_csv(df: DataFrame, path: str) -> None:
    (
        df.write.mode("overwrite")
        .option("header", "true")
        .option("quoteAll", "true")
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
        .csv(path)
    )


def read_annotators(spark: SparkSession, path: str) -> DataFrame:
    """The needed columns of an annotator table; the scan reads no others."""
    df = spark.read.parquet(path)
    need_columns(df, ANNOTATOR_COLUMNS)
    return df.select(*ANNOTATOR_COLUMNS)


def file_order(df: DataFrame) -> DataFrame:
    """Adds ``ord``: file name and row number, the order in which a table was written."""
    return df.withColumn(
        "ord", F.struct(F.col("_metadata.file_name"), F.col("_metadata.row_index"))
    )


def source_profile(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(source, n_rows, n_keys) per named table and key column."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(key).alias("n_keys")).select(
            F.lit(name).alias("source"), "n_rows", "n_keys"
        )
        for name, (df, key) in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def profile_flag_files(spark: SparkSession, train: str, test: str, labels: str) -> DataFrame:
    """Rows and ids per file; an error if a file lacks a column it must have."""
    files = {
        "train": (train, TRAIN_COLUMNS),
        "test": (test, TEST_COLUMNS),
        "test_labels": (labels, TEST_LABEL_COLUMNS),
    }
    return source_profile(
        {name: (read_flag_csv(spark, path, cols), "id") for name, (path, cols) in files.items()}
    )


RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("step", T.LongType()),
        *[T.StructField(f"train_loss_{name}", T.DoubleType()) for name in LOSS_TERMS],
        T.StructField("lr", T.DoubleType()),
        *[T.StructField(name, T.DoubleType()) for name in EVAL_METRICS],
        T.StructField("improved", T.BooleanType()),
        T.StructField("best_metric", T.DoubleType()),
        T.StructField("epochs_without_improvement", T.LongType()),
    ]
)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of mixed shape; a field an event lacks is null."""
    return spark.read.schema(RUN_LOG_SCHEMA).option("mode", "FAILFAST").json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
