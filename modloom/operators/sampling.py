"""Exact-size deterministic samples, epoch resampling, length-grouped batches.

Order comes from a seeded hash of the row id. Hash prefixes are uniform whatever the data look
like, so slices by prefix stay balanced, and a global position is a slice offset plus a rank
inside the slice. No step sorts or counts the table in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES, IGNORE_ID
from modloom.functions.counting import count_where
from modloom.functions.keys import seeded_key
from modloom.functions.scores import pad, round_up

# Hex digits of a slice prefix: at most 16 ** 4 slices, so slice tables stay below 2 MB.
PREFIX_DIGITS = 4

# Fixed values of the training setup.
MAX_NEITHER_RATIO = 3.0
BATCH_SIZE = 32
MEGA_BATCHES = 50
PAD_MULTIPLE = 8
EVAL_ROWS = 4000
SEED = 42


def slice_of(key: Column) -> Column:
    return F.substring(key, 1, PREFIX_DIGITS)


def key_cutoff(keys: DataFrame, n: Column) -> Column:
    """Scalar: the n-th smallest value of the column ``key``, null if there are fewer."""
    slices = keys.groupBy(slice_of(F.col("key")).alias("slice")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    upto = F.sum("rows").over(Window.orderBy("slice"))
    edge = (
        slices.withColumn("upto", upto)
        .filter((F.col("upto") >= n) & (F.col("upto") - F.col("rows") < n))
        .select("slice", (n - (F.col("upto") - F.col("rows"))).alias("need"))
    )
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("key"))
    return (
        keys.withColumn("slice", slice_of(F.col("key")))
        .join(F.broadcast(edge), "slice")
        .withColumn("rank", rank)
        .filter(F.col("rank") == F.col("need"))
        .select("key")
        .scalar()
    )


def sample_rows(df: DataFrame, n: int, seed: int = SEED, row_id: str = "uid") -> DataFrame:
    """Exactly ``n`` rows, or all of them if there are fewer. ``row_id`` must be unique.

    Two narrow passes over the ids find the cutoff key; the rows themselves are only filtered.
    """
    if n <= 0:
        return df.limit(0)
    key = seeded_key(seed, F.col(row_id))
    cutoff = key_cutoff(df.select(key.alias("key")), F.lit(n))
    return df.filter(F.coalesce(key <= cutoff, F.lit(True)))


def eval_sample(
    df: DataFrame, n: int = EVAL_ROWS, seed: int = SEED, row_id: str = "uid"
) -> DataFrame:
    """The first ``n`` rows with a severity in shuffled order."""
    return sample_rows(df.filter(F.col("severity") != IGNORE_ID), n, seed, row_id)


def neither_quota(df: DataFrame, ratio: float = MAX_NEITHER_RATIO) -> Column:
    """Scalar: ``ratio`` times the size of the largest harmful class, rounded down."""
    sizes = [count_where(F.col("label") == i) for i in range(1, len(CLASS_NAMES))]
    largest = df.agg(F.greatest(*sizes).alias("n")).select(
        F.floor(F.col("n") * F.lit(float(ratio))).alias("n")
    )
    return largest.scalar()


def epoch_resample(
    df: DataFrame,
    epoch: int = 0,
    ratio: float = MAX_NEITHER_RATIO,
    seed: int = SEED,
    row_id: str = "uid",
) -> DataFrame:
    """All harmful rows, and the fallback class cut to the quota by a fresh draw per epoch."""
    key = seeded_key(seed + epoch, F.col(row_id))
    quota = neither_quota(df, ratio)
    neither = df.filter(F.col("label") == 0).select(key.alias("key"))
    drawn = (quota > 0) & F.coalesce(key <= key_cutoff(neither, quota), F.lit(True))
    return df.filter((F.col("label") != 0) | drawn)


def sample_profile(df: DataFrame) -> DataFrame:
    """Size of a sample and its share of rows with targets."""
    return df.agg(
        F.count(F.lit(1)).alias("num_examples"),
        F.coalesce(F.avg(F.col("has_targets").cast("double")), F.lit(0.0)).alias(
            "has_targets_share"
        ),
    )


def with_positions(df: DataFrame, key: Column, name: str = "position") -> DataFrame:
    """Adds the 0-based global rank of ``key``."""
    keyed = df.withColumn("slice", slice_of(key))
    slices = keyed.groupBy("slice").agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("slice")) - F.col("rows")
    offsets = slices.select("slice", before.alias("before"))
    # The key follows from the row, so it is made after the shuffle.
    rank = F.row_number().over(Window.partitionBy("slice").orderBy(key))
    return (
        keyed.repartition("slice")
        .withColumn("rank", rank)
        .join(F.broadcast(offsets), "slice")
        .withColumn(name, F.col("before") + F.col("rank") - 1)
        .drop("slice", "rank", "before")
    )


def length_grouped(
    df: DataFrame,
    epoch: int = 0,
    batch_size: int = BATCH_SIZE,
    mega_batches: int = MEGA_BATCHES,
    seed: int = SEED,
    row_id: str = "uid",
) -> DataFrame:
    """Adds mega_batch, position and batch_id.

    Rows are shuffled, cut into mega-batches, and ordered by falling length inside each.
    """
    return _grouped(df, order_key(F.col(row_id), epoch, seed), batch_size, mega_batches)


def order_key(row_id: Column, epoch: int = 0, seed: int = SEED) -> Column:
    """What the rows of an epoch are shuffled by."""
    return seeded_key(F.lit(f"{seed + epoch}|order"), row_id)


def _grouped(
    df: DataFrame, key: Column, batch_size: int = BATCH_SIZE, mega_batches: int = MEGA_BATCHES
) -> DataFrame:
    mega_rows = batch_size * mega_batches
    shuffled = with_positions(df, key, "shuffled").withColumn(
        "mega_batch", F.floor(F.col("shuffled") / mega_rows)
    )
    inside = Window.partitionBy("mega_batch").orderBy(F.desc("length"), "shuffled")
    position = F.col("mega_batch") * mega_rows + F.row_number().over(inside) - 1
    return (
        shuffled.withColumn("position", position)
        .withColumn("batch_id", F.floor(F.col("position") / batch_size))
        .drop("shuffled")
    )


def padded_lengths(df: DataFrame, multiple: int = PAD_MULTIPLE) -> DataFrame:
    """Adds padded_length: the longest row of the batch, rounded up.

    A batch lies inside one mega-batch, so naming both keeps the partitioning of
    ``length_grouped`` and needs no further shuffle.
    """
    batch = Window.partitionBy("mega_batch", "batch_id")
    return df.withColumn("padded_length", round_up(F.max("length").over(batch), multiple))


def pad_sequences(df: DataFrame, pad_id: int) -> DataFrame:
    """Right-pads input_ids with ``pad_id`` and attention_mask with 0."""
    size = F.col("padded_length")
    return df.withColumns(
        {
            "input_ids": pad(F.col("input_ids"), size, pad_id),
            "attention_mask": pad(F.col("attention_mask"), size, 0),
        }
    )


def padded_batches(
    df: DataFrame,
    pad_id: int,
    epoch: int = 0,
    row_id: str = "uid",
    seed: int = SEED,
    **grouping: int,
) -> DataFrame:
    """``df`` with mega_batch, position, batch_id and padded_length, its sequences padded.

    Order and lengths of the batches follow from id and length alone, and the key of the order
    stands for the id as 20 bytes; the rows with their sequences are shuffled once, to meet them.
    """
    rows = df.filter(F.col(row_id).isNotNull())
    key = F.unhex(order_key(F.col(row_id), epoch, seed))
    # Rows without an id take a place, as they have one in ``length_grouped``, but do not come out.
    narrow = df.select(key.alias("_order_key"), "length")
    grouped = _grouped(narrow, F.lower(F.hex("_order_key")), **grouping)
    places = padded_lengths(grouped).drop("length")
    # the id's own columns come first, as in a join by name
    columns = [row_id, *[name for name in df.columns if name != row_id]]
    joined = rows.select(*columns).join(places, key == F.col("_order_key")).drop("_order_key")
    return pad_sequences(joined, pad_id)
