"""A table laid out by text, so that later jobs on texts need no shuffle.

The rows of a text lie in one bucket, and every job that groups or joins by text works bucket by
bucket. Rows of hot texts, and rows without a text, would fill a bucket of their own: they lie
beside the buckets, evenly spread, and their groups are few (see ``HOT_SHARES``). No text is in
both parts, so whatever treats each text on its own is the union over the two.

A layout is a folder: ``cold`` (bucketed), ``hot`` (plain) and ``spec`` (key and buckets). It is
written beside an older one and swapped in, and opens in any session, metastore or not.

Defined results: rows without a text take part as the operators have it; repeated rows stay; other
columns pass through; an empty table gives an empty layout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.operators.dedup import stats_of, with_flags
from modloom.operators.groups import HOT_GROUP_ROWS, HOT_SHARES, group_table
from modloom.sources import storage

#: Rows that a bucket is for, and most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 1 << 16
FLAGS = ("is_duplicate", "dup_group_size", "label_conflict")


class ByText(NamedTuple):
    """The two parts of a layout: ``cold`` is bucketed by ``key``, ``hot`` is spread."""

    cold: DataFrame
    hot: DataFrame
    key: str
    buckets: int

    def rows(self) -> DataFrame:
        return self.cold.unionByName(self.hot)


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame:
    """Keys of at least ``hot_rows`` rows and 1 / HOT_SHARES of all, so HOT_SHARES at most."""
    sizes = storage.cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "text-sizes")
    share = sizes.agg(F.ceil(F.sum("n") / HOT_SHARES)).scalar()
    hot = F.col("n") >= F.greatest(F.lit(hot_rows).cast("long"), share)
    return sizes.filter(hot & F.col(key).isNotNull()).select(F.col(key).alias("hot_key"))


def bucket_count(rows: int) -> int:
    """A power of two, so that layouts of like size can be joined bucket by bucket."""
    return 1 << min(max(-(-rows // BUCKET_ROWS) - 1, 0).bit_length(), MOST_BUCKETS.bit_length() - 1)


def write_by_text(
    df: DataFrame,
    path: str,
    key: str = "text_hash",
    buckets: int | None = None,
    hot_rows: int = HOT_GROUP_ROWS,
) -> ByText:
    """Lays ``df`` out at ``path`` and opens it. ``df`` is read up to four times: pass a written table."""
    spark = df.sparkSession
    buckets = buckets or bucket_count(df.count())
    name = f"{_table_name(path)}_new"
    with storage.own_scratch(spark), storage.replacing(spark, path) as new:
        hot = F.broadcast(storage.cut_lineage(hot_keys(df, key, hot_rows), "hot-texts"))
        match = F.col(key) == F.col("hot_key")
        cold = df.filter(F.col(key).isNotNull()).join(hot, match, "left_anti")
        spread = df.join(hot, match, "left").filter(F.col("hot_key").isNotNull() | F.col(key).isNull())
        # The shuffle cuts rows as the buckets do, so each bucket is one file.
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        try:
            (
                cold.repartition(buckets, key)
                .write.option("path", f"{new}/cold")
                .option("compression", "zstd")
                .bucketBy(buckets, key)
                .saveAsTable(name, format="parquet")
            )
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spread.drop("hot_key").write.option("compression", "zstd").parquet(f"{new}/hot")
        spec = spark.createDataFrame([(key, buckets)], "key string, buckets int")
        spec.coalesce(1).write.json(f"{new}/spec")
    return open_by_text(spark, path)


def open_by_text(spark: SparkSession, path: str) -> ByText:
    """The layout at ``path``. The catalog only learns where the buckets are; an older entry goes."""
    storage.restore(spark, path)
    spec = spark.read.schema("key string, buckets int").json(f"{path}/spec").first()
    hot = spark.read.parquet(f"{path}/hot")
    name = _table_name(path)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    where = f"{path}/cold".replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} ({_ddl(hot.schema)}) USING parquet"
        f" CLUSTERED BY (`{spec.key}`) INTO {spec.buckets} BUCKETS LOCATION '{where}'"
    )
    return ByText(spark.table(name), hot, spec.key, spec.buckets)


def _table_name(path: str) -> str:
    return f"modloom_{hashlib.md5(path.rstrip('/').encode()).hexdigest()}"


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)


# --- operators ----------------------------------------------------------------------------


def each_text(laid: ByText, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``operator`` over the whole table, for one that treats every text on its own.

    The buckets need no shuffle; of the hot texts only sums made inside the tasks are moved.
    """
    return operator(laid.cold).unionByName(operator(laid.hot))


def duplicate_stats(laid: ByText) -> DataFrame:
    """``dedup.duplicate_stats``: only the totals are moved."""
    return stats_of(with_flags(each_text(laid, group_table)))


def add_duplicate_flags(laid: ByText) -> DataFrame:
    """``dedup.add_duplicate_flags``, without a shuffle of rows.

    A bucket's rows meet the groups counted in the same bucket. Groups of the other part are at
    most ``HOT_SHARES``, a few numbers each, and are broadcast; rows without a text get the defaults.
    Columns that have the flags' names are replaced.
    """

    def flagged(rows: DataFrame, groups: DataFrame) -> DataFrame:
        rows = rows.drop(*FLAGS)
        joined = rows.join(groups.withColumnRenamed(laid.key, "group_key"), F.col(laid.key) == F.col("group_key"), "left")
        return joined.select(
            *rows.columns,
            F.coalesce("is_duplicate", F.lit(False)).alias("is_duplicate"),
            F.coalesce("dup_group_size", F.lit(1).cast("long")).alias("dup_group_size"),
            F.coalesce("label_conflict", F.lit(False)).alias("label_conflict"),
        )

    def groups_of(rows: DataFrame) -> DataFrame:
        return with_flags(group_table(rows)).select(laid.key, *FLAGS)

    cold = flagged(laid.cold, groups_of(laid.cold).hint("merge"))
    return cold.unionByName(flagged(laid.hot, F.broadcast(groups_of(laid.hot))))
