"""Per-text group statistics and the way back from groups to rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import CLASS_IDS, CLASS_NAMES, SOURCES
from modloom.functions.counting import count_where
from modloom.functions.keys import packed, unpacked

# A group is spread if it has this many rows and at least 1 / HOT_SHARES of all. So at most
# HOT_SHARES groups are spread, and the broadcast below holds at most that many keys with a few
# numbers each, some 10 MB.
HOT_GROUP_ROWS = 10_000
HOT_SHARES = 50_000


def strata(sources: Sequence[str] = SOURCES) -> list[tuple[str, str]]:
    """(source, class) pairs in the order that breaks ties: by name of the joined pair."""
    return sorted(
        ((source, name) for source in sources for name in CLASS_NAMES),
        key=lambda pair: "|".join(pair),
    )


def group_table(df: DataFrame, sources: Sequence[str] = SOURCES) -> DataFrame:
    """One row per text_hash: its size and a histogram over source and class.

    Size, conflict, distinct sources and classes and the dominant stratum all follow from the
    histogram, so duplicates, conflicts and folds share this one shuffle. It moves counters that
    were summed before the shuffle, never texts.
    """
    pairs = strata(sources)
    counts = [
        count_where((F.col("source") == source) & (F.col("label") == CLASS_IDS[name])).alias(f"n{i}")
        for i, (source, name) in enumerate(pairs)
    ]
    # Joins on the key imply the same filter; naming it here lets them share the shuffle.
    keyed = df.filter(F.col("text_hash").isNotNull())
    table = keyed.groupBy("text_hash").agg(F.count(F.lit(1)).alias("group_size"), *counts)
    cells = [F.col(f"n{i}") for i in range(len(pairs))]
    known = reduce(lambda x, y: x + y, cells)
    return table.withColumn(
        "group_size",
        F.when(known == F.col("group_size"), F.col("group_size")).otherwise(
            F.raise_error(F.concat(F.lit("unknown source or class in group "), "text_hash"))
        ),
    )


def written_groups(df: DataFrame) -> DataFrame:
    """``group_table`` for a table that is to be written: its shuffle moves packed keys.

    Not for rows that lie together by ``text_hash`` already, which need no shuffle.
    """
    key = F.col("text_hash")
    return group_table(df.withColumn("text_hash", packed(key))).withColumn("text_hash", unpacked(key))


def cells_where(position: int, value: str, sources: Sequence[str] = SOURCES) -> list[Column]:
    return [F.col(f"n{i}") for i, pair in enumerate(strata(sources)) if pair[position] == value]


def present(position: int, value: str, sources: Sequence[str] = SOURCES) -> Column:
    """True where the group has a row of that source (position 0) or class (position 1)."""
    cells = cells_where(position, value, sources)
    return reduce(lambda x, y: x + y, cells) > 0


def has_conflict(sources: Sequence[str] = SOURCES) -> Column:
    classes = [present(1, name, sources).cast("int") for name in CLASS_NAMES]
    return reduce(lambda x, y: x + y, classes) > 1


def dominant_stratum(sources: Sequence[str] = SOURCES) -> Column:
    """Index of the stratum with most rows in the group, the first by name on a tie."""
    cells = F.array(*[F.col(f"n{i}") for i in range(len(strata(sources)))])
    return (F.array_position(cells, F.array_max(cells)) - 1).cast("int")


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    columns: Sequence[str],
    size: str,
    key: str = "text_hash",
    spread: str = "uid",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """LEFT JOIN ``columns`` of ``groups`` (unique ``key``) to ``rows`` without hot partitions.

    Rows of a hot group take their values from a broadcast of the hot groups, and are then
    spread over the shuffle by ``spread`` instead of meeting in one partition. Everything else
    is an ordinary shuffled join. Which groups count as hot decides the speed, not the result.
    Keys and row ids move packed, a cold row's key only as the key of the join.
    ``groups`` is read three times: pass a written table.
    """
    share = groups.agg(F.ceil(F.sum(size) / HOT_SHARES)).scalar()
    hot = groups.filter(F.col(size) >= F.greatest(F.lit(hot_rows).cast("long"), share)).select(
        F.col(key).alias("hot_key"), *[F.col(name).alias(f"hot_{name}") for name in columns]
    )
    cold = groups.select(
        packed(F.col(key)).alias("cold_key"), *[F.col(name).alias(f"cold_{name}") for name in columns]
    )
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    # A spread key starts with a tilde and so equals no packed key.
    is_hot = F.col("hot_key").isNotNull()
    row_id = packed(F.col(spread).cast("string"))
    join_key = F.when(is_hot, F.concat(F.lit("~").cast("binary"), row_id)).otherwise(packed(F.col(key)))
    moved = marked.withColumn("join_key", join_key).withColumn(spread, row_id)
    joined = moved.join(cold, F.col("join_key") == F.col("cold_key"), "left")
    own = {
        key: F.when(is_hot, F.col("hot_key")).otherwise(unpacked(F.col("join_key"))),
        spread: unpacked(F.col(spread)).cast(rows.schema[spread].dataType),
    }
    return joined.select(
        *[own.get(name, F.col(name)).alias(name) for name in rows.columns],
        *[F.coalesce(f"hot_{name}", f"cold_{name}").alias(name) for name in columns],
    )
