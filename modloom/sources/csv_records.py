"""CSV files with quoted line breaks, read in splits.

A line begins a record where an even number of quotes stands before it in its file. So one pass
counts the quotes of each split, a running sum over the splits of a file gives the parity at the
start of each, and then every split cuts its lines into records on its own. A record that crosses
a border leaves a piece in each split; the pieces, two a split at most, are put together.

Quotes must be used as RFC 4180 has it: around whole fields, doubled inside them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
#: A record; what a split holds of one that began before it; what it holds of one it cannot end.
WHOLE, REST, BEGUN = 0, 1, 2

PIECES = "file long, start long, kind int, record string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, start): the lines of each split in order, carriage returns kept."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(
        "value",
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_path").alias("path"),
    )


def split_parity(found: DataFrame) -> DataFrame:
    """(p_file, p_start, odd) per split: whether an odd number of quotes stands before it."""
    quotes = F.regexp_count("value", F.lit(QUOTE)).cast("long")
    splits = found.groupBy("file", "start").agg(
        F.sum(quotes).alias("quotes"), F.min("path").alias("low"), F.max("path").alias("high")
    )
    # two files with one key would mix their lines
    same = F.assert_true(F.col("low") == F.col("high"), F.lit("two files have one key"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return splits.select(
        F.col("file").alias("p_file"), F.col("start").alias("p_start"), (odd & same.isNull()).alias("odd")
    )


def pieces(found: DataFrame, header: list[str]) -> DataFrame:
    """(file, start, kind, record): records and parts of records, without the headers."""

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        columns = [pa.array(c, kind) for c, kind in zip(zip(*made, strict=True), kinds, strict=True)]
        made.clear()
        return pa.record_batch(columns, names=["file", "start", "kind", "record"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, kind, inside, top = None, [], WHOLE, False, False
        made: list[tuple] = []

        def emit(what: int) -> None:
            nonlocal top
            record = "\n".join(held)
            held.clear()
            if top:
                names = next(csv.reader([record.removeprefix("\ufeff").removesuffix("\r")], strict=True), [])
                if names != header:
                    raise ValueError(f"a file has the columns {names} instead of {header}")
                top = False
            elif what != WHOLE or record.strip("\r"):
                made.append((*split, what, record))

        for batch in batches:
            values, files, starts, odds = (batch.column(i) for i in range(4))
            counts = pc.count_substring(values, QUOTE).to_pylist()
            rows = zip(values.to_pylist(), counts, files.to_pylist(), starts.to_pylist(), odds.to_pylist(), strict=True)
            for line, quotes, file, start, odd in rows:
                if (file, start) != split:
                    if held:
                        emit(REST if kind == REST else BEGUN)
                    split, inside, top = (file, start), odd, start == 0
                    kind = REST if odd else WHOLE
                held.append(line)
                inside ^= quotes % 2 == 1
                if not inside:
                    emit(kind)
                    kind = WHOLE
            if made:
                yield batch_of(made)
        if held:
            emit(REST if kind == REST else BEGUN)
        if made:
            yield batch_of(made)

    parity = split_parity(found)
    # a broadcast join keeps the lines of a split in order; one small row per split is broadcast
    met = found.join(F.broadcast(parity), (F.col("file") == F.col("p_file")) & (F.col("start") == F.col("p_start")))
    return met.select("value", "file", "start", "odd").mapInArrow(cut, PIECES)


def joined(parts: DataFrame) -> DataFrame:
    """(record): the records that cross a border, from their pieces."""
    upto = Window.partitionBy("file").orderBy("start", "kind")
    numbered = parts.withColumn("number", F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(upto))
    ordered = F.sort_array(F.collect_list(F.struct("start", "kind", "record")))
    whole = numbered.groupBy("file", "number").agg(ordered.alias("parts"))
    return whole.select(F.array_join(F.col("parts.record"), "\n").alias("record"))


def records(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """(record): the text of every record of the files at ``path``, in any order.

    Each file must start with a header of these columns. Empty lines between records are left out.
    """
    found = pieces(lines(spark, path), header)
    record = F.regexp_replace("record", "\r$", "").alias("record")
    return found.filter(F.col("kind") == WHOLE).select(record).unionByName(
        joined(found.filter(F.col("kind") != WHOLE)).select(record)
    )
