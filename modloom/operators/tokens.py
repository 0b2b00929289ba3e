"""Training columns, vocabulary and token ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modloom.domains import TARGET_COLUMNS
from modloom.functions.text import WORD
from modloom.sources.storage import cut_lineage

# Special ids and the sequence limit.
START_ID, PAD_ID, END_ID, UNKNOWN_ID = 0, 1, 2, 3
FIRST_WORD_ID = 4
MAX_LENGTH = 128
# A vocabulary up to this size is broadcast; of a larger one, this many entries.
MAX_BROADCAST_VOCAB = 250_000

TOKEN = rf"[{WORD}]+|[^{WORD}\s\p{{Z}}]"

# The columns of a training row.
KEEP_COLUMNS = (
    "input_ids",
    "attention_mask",
    "label",
    "severity",
    "source",
    "uid",
    "split",
    "has_targets",
    "length",
    *TARGET_COLUMNS,
)


def target_prepare(df: DataFrame) -> DataFrame:
    """has_targets (by the first target), 0/1 targets, and the target vector."""
    has_targets = F.col(TARGET_COLUMNS[0]).isNotNull()
    numbers = {
        name: F.coalesce(F.col(name), F.lit(False)).cast("int") for name in TARGET_COLUMNS
    }
    flagged = df.withColumn("has_targets", has_targets).withColumns(numbers)
    return flagged.withColumn(
        "targets", F.array(*[F.col(name).cast("float") for name in TARGET_COLUMNS])
    )


def word_tokens(text: Column) -> Column:
    """Words, and every other visible character on its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def build_vocab(df: DataFrame, size: int | None = None) -> DataFrame:
    """(token, n, token_id) of all tokens, or of the ``size`` most frequent ones, ties by name.

    The counts are sorted over the cluster and written; a token's id is the number of tokens in
    the files before its own plus its row there. Nothing is ranked in one task.
    """
    counts = (
        df.select(F.explode(word_tokens(F.lower("text"))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("token"))
    )
    # The writer numbers its files in the order of the sorted partitions.
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    ranked = cut_lineage(counts, "token-counts").select(
        "token", "n", number.alias("file"), F.col("_metadata.row_index").alias("row")
    )
    # One row per written file.
    files = ranked.groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    token_id = (F.col("before") + F.col("row") + FIRST_WORD_ID).cast("int").alias("token_id")
    numbered = ranked.join(F.broadcast(before), "file").select("token", "n", token_id)
    return numbered if size is None else numbered.filter(F.col("token_id") < size + FIRST_WORD_ID)


def _finish(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "attention_mask": F.array_repeat(F.lit(1), F.size("input_ids")),
            "length": F.size("input_ids"),
        }
    ).select(*KEEP_COLUMNS)


#: Stands in a run for a token outside the broadcast entries, which follows on its own.
RARE = -1
RUNS = "key binary, at int, ids array<int>, token string"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive tokens of a text (key, at, id, token) as one row, and every rare token as another.

    Tokens leave an explode side by side; where they do not, a text has more rows, that is all.
    """
    for batch in batches:
        key, at, code, token = (batch.column(name) for name in ("key", "at", "id", "token"))
        if not batch.num_rows:
            continue
        place = at.to_numpy()
        moved = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
        first = np.concatenate([[True], (place[1:] != place[:-1] + 1) | moved])
        starts = np.flatnonzero(first)
        edges = pa.array(np.append(starts, batch.num_rows), pa.int32())
        ids = pa.ListArray.from_arrays(edges, code.fill_null(RARE))
        rare = np.flatnonzero(token.is_valid().to_numpy(zero_copy_only=False))
        rows = pa.array(np.concatenate([starts, rare]))
        yield pa.RecordBatch.from_arrays(
            [
                key.take(rows),
                at.take(rows),
                pa.concat_arrays([ids, pa.nulls(len(rare), ids.type)]),
                pa.concat_arrays([pa.nulls(len(starts), token.type), token.take(pa.array(rare))]),
            ],
            names=["key", "at", "ids", "token"],
        )


def tokenize(
    df: DataFrame,
    vocab: DataFrame,
    max_length: int | None = MAX_LENGTH,
    max_broadcast: int = MAX_BROADCAST_VOCAB,
) -> DataFrame:
    """Token ids of ``text`` by vocabulary look-up, without padding.

    ``max_length`` counts the two end marks; None keeps every token. ``df`` needs the columns of
    ``target_prepare`` plus uid (unique), source, split, label, severity.

    A vocabulary of up to ``max_broadcast`` rows, counted first, is broadcast; of a larger one the
    entries with the lowest ids, as ids rank tokens by frequency. What these settle is packed into
    runs of ids before anything moves, so that single tokens are shuffled only if they are rare.
    The other columns are joined once, by uid, whose digest stands for it until then.
    """
    words = word_tokens(F.lower("text"))
    if max_length is not None:
        words = F.slice(words, 1, max_length - 2)
    digest = F.unhex(F.md5("uid"))
    exploded = df.select(digest.alias("key"), words.alias("words")).select(
        "key", F.posexplode("words").alias("at", "token")
    )
    lookup = vocab.select("token", "token_id")
    if vocab.limit(max_broadcast + 1).count() <= max_broadcast:
        known = exploded.join(F.broadcast(lookup), "token", "left")
        code = F.coalesce("token_id", F.lit(UNKNOWN_ID))
        found = known.select("key", "at", code.alias("id"), F.lit(None).cast("string").alias("token"))
        coded = found.mapInArrow(_runs, RUNS)
    else:
        last = FIRST_WORD_ID + max_broadcast
        common = lookup.filter(F.col("token_id") < last)
        rare = lookup.filter(F.col("token_id") >= last).withColumnRenamed("token", "rare_token")
        known = exploded.join(F.broadcast(common), "token", "left")
        left = F.when(F.col("token_id").isNull(), F.col("token"))
        runs = known.select("key", "at", F.col("token_id").alias("id"), left.alias("token")).mapInArrow(_runs, RUNS)
        # A token holds no tilde beside other characters, so the spread key of a run equals none.
        spot = F.coalesce("token", F.concat(F.lit("~"), F.substring(F.hex("key"), 1, 4)))
        settled = F.array(F.coalesce("token_id", F.lit(UNKNOWN_ID)))
        coded = (
            runs.withColumn("spot", spot)
            .join(rare, F.col("spot") == F.col("rare_token"), "left")
            .select("key", "at", F.when(F.col("token").isNull(), F.col("ids")).otherwise(settled).alias("ids"))
        )
    grouped = coded.groupBy("key").agg(
        F.collect_list(F.struct("at", "ids")).alias("runs"),
        F.sum(F.size("ids")).alias("total"),
        F.max(F.col("at") + F.size("ids")).alias("end"),
    )
    single = F.flatten(
        F.transform(
            "runs",
            lambda run: F.transform(
                run["ids"], lambda code, i: F.struct((run["at"] + i).alias("at"), code.alias("id"))
            ),
        )
    )
    placed = F.array_sort(F.filter(single, lambda code: code["id"] != RARE))["id"]
    # Without rare tokens, the runs of a text cover it end to end.
    whole = F.col("total") == F.col("end")
    codes = F.when(whole, F.flatten(F.array_sort("runs")["ids"])).otherwise(placed)
    carried = [name for name in KEEP_COLUMNS if name in df.columns and name != "uid"]
    rows = df.filter(F.col("uid").isNotNull()).select("uid", *carried)
    joined = rows.join(grouped.select("key", codes.alias("codes")), digest == F.col("key"), "left")
    middle = F.coalesce(F.col("codes").cast("array<int>"), F.array().cast("array<int>"))
    ids = F.concat(F.array(F.lit(START_ID)), middle, F.array(F.lit(END_ID)))
    return _finish(joined.withColumn("input_ids", ids))


def tokenize_with(
    df: DataFrame,
    load_encoder: Callable[[], Callable[[list[str]], list[list[int]]]],
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """Token ids by a user's encoder, which each Python worker loads once.

    The encoder maps a list of texts to lists of ids and must itself cut to ``max_length`` if
    its end marker matters; longer lists are cut here.
    """

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            encoded = encoder(texts.fillna("").tolist())
            yield pd.Series([list(ids)[:max_length] for ids in encoded])

    return _finish(df.withColumn("input_ids", encode(F.col("text"))))
