"""Every operator as a query over the driver's tables: ``name -> callable(spark, folder)``."""

from __future__ import annotations

import threading
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.domains import (
    CLASS_NAMES,
    FLAG_LABELS,
    FLAG_SIGNALS,
    ORIGIN_TEST,
    ORIGIN_TRAIN,
    TARGET_COLUMNS,
    TARGET_NAMES,
)
from modloom.functions import text as X
from modloom.functions.scores import expected_level, masked_mean
from modloom.operators import by_text, dedup, evaluate, harmonize, heads, joint, labels, losses, runlog, sampling
from modloom.operators import schema as unified_schema
from modloom.operators import severity, split, stats, tokens
from modloom.plans import views
from modloom.plans.build import flag_tables, unify
from modloom.sources import raw, storage
from modloom.streaming import runs
from modloom.streaming.live import write_stream

Query = Callable[[SparkSession, str], DataFrame]


def portable(df: DataFrame) -> DataFrame:
    """Whole numbers as long and fractions as double with 6 places, to compare across engines."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            column = column.cast("long")
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.round(column.cast("double"), 6)
        elif isinstance(kind, T.ArrayType) and isinstance(
            kind.elementType, (T.FloatType, T.DoubleType)
        ):
            column = F.transform(column.cast("array<double>"), lambda x: F.round(x, 6))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegerType):
            column = column.cast("array<long>")
        columns.append(column.alias(field.name))
    return df.select(*columns)


# --- stage outputs -----------------------------------------------------------------------
# Later stages start from written tables, as a pipeline run stage by stage does. A stage is
# written once per application and input folder.

_STAGES: dict[tuple[str, str, str], str] = {}
_ONE_AT_A_TIME = threading.RLock()


def stage(name: str, build: Query) -> Query:
    def load(spark: SparkSession, folder: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, folder, name)
        # Later queries read the table, so no scope that happens to be open may own it.
        with _ONE_AT_A_TIME, storage.outside_scopes():
            if key not in _STAGES or not storage.is_complete(spark, _STAGES[key]):
                path = storage.scratch_path(spark, name)
                with storage.own_scratch(spark):
                    storage.write_table(build(spark, folder), path)
                _STAGES[key] = path
        return spark.read.parquet(_STAGES[key])

    return load


def written(spark: SparkSession, folder: str, name: str) -> bool:
    """True where that stage is written already."""
    key = (spark.sparkContext.applicationId, folder, name)
    with _ONE_AT_A_TIME:
        return key in _STAGES and storage.is_complete(spark, _STAGES[key])


def labeled_flags(spark: SparkSession, folder: str) -> DataFrame:
    flags = views.raw_flags(spark, folder)
    return harmonize.split_labeled(flags)[0]


def flag_rows(spark: SparkSession, folder: str) -> DataFrame:
    origin = F.when(F.col("part") == "train", ORIGIN_TRAIN).otherwise(ORIGIN_TEST)
    return harmonize.flag_signals(labeled_flags(spark, folder), origin)


def aggregated(spark: SparkSession, folder: str) -> DataFrame:
    return harmonize.aggregate_annotators(views.annotator_rows(spark, folder), "ord")


def score_rows(spark: SparkSession, folder: str) -> DataFrame:
    return harmonize.annotator_signals(aggregated(spark, folder))


stored_flags = stage("flags", flag_rows)
stored_scores = stage("scores", score_rows)


def combined_rows(spark: SparkSession, folder: str) -> DataFrame:
    return harmonize.combine_sources(
        labels.label_flags(stored_flags(spark, folder)),
        labels.label_scores(stored_scores(spark, folder)),
    )


def unified_rows(spark: SparkSession, folder: str) -> DataFrame:
    return unify(stored_flags(spark, folder), stored_scores(spark, folder))


unified = stage("unified", unified_rows)


# --- the unified table without its texts -------------------------------------------------
# Labels, folds and samples need keys and numbers of a row only. Where the tables with texts are not
# written yet, these stages write and shuffle no text; where they are, their columns are read.


def without_texts(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select(
        "uid",
        "source",
        "text_hash",
        "label",
        F.length("text").alias("length"),
        F.col("t_race").isNotNull().alias("has_targets"),
        *more,
    )


def keyed_rows(spark: SparkSession, folder: str) -> DataFrame:
    flags = (stored_flags if written(spark, folder, "flags") else flag_rows)(spark, folder)
    scores = (stored_scores if written(spark, folder, "scores") else score_rows)(spark, folder)
    return without_texts(
        harmonize.combine_sources(labels.label_flags(flags), labels.label_scores(scores))
    )


stored_keys = stage("row-keys", keyed_rows)
split_keys = stage(
    "unified-keys", lambda spark, folder: split.assign_split(stored_keys(spark, folder))
)


def unified_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Key, text_hash, source, class, split, length and has_targets of every row of ``unified``."""
    if written(spark, folder, "unified"):
        rows = without_texts(unified(spark, folder), "split")
    else:
        rows = split_keys(spark, folder)
    return rows.withColumn("label_name", labels.class_name(F.col("label")))


def unified_by_text(spark: SparkSession, folder: str) -> by_text.ByText:
    """The unified table laid out by text, written once per application and input folder.

    It holds the columns that jobs on groups read; the texts stay where they are.
    """
    key = (spark.sparkContext.applicationId, folder, "unified-by-text")
    rows = unified_keys(spark, folder).select("uid", "text_hash", "source", "label", "split")
    with _ONE_AT_A_TIME, storage.outside_scopes():
        if key not in _STAGES or not storage.is_complete(spark, f"{_STAGES[key]}/hot"):
            path = storage.scratch_path(spark, key[2])
            by_text.write_by_text(rows, path)
            _STAGES[key] = path
        return by_text.open_by_text(spark, _STAGES[key])


def graded(spark: SparkSession, folder: str) -> DataFrame:
    return severity.derive_severity(unified(spark, folder))


#: One projection over a written table, so severity is derived on reading: a stage would write every
#: text once more, and readers need a few columns.
stored_graded = graded


def train_rows(spark: SparkSession, folder: str) -> DataFrame:
    return unified_keys(spark, folder).filter(F.col("split") == "train").select(
        "uid", "label", "length", "has_targets"
    )


# --- registered queries ------------------------------------------------------------------


def scan_flag_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "flags_csv")
    raw.write_flag_csv(views.raw_flags(spark, folder), path)
    return raw.read_flag_csv(spark, path, raw.TRAIN_COLUMNS)


def scan_annotators(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "annotators")
    storage.write_table(views.annotator_rows(spark, folder), path)
    return raw.read_annotators(spark, path)


def source_profile(spark: SparkSession, folder: str) -> DataFrame:
    return raw.source_profile(
        {
            "flags": (views.raw_flags(spark, folder), "id"),
            "annotators": (views.annotator_rows(spark, folder), "comment_id"),
        }
    )


def first_valid_source(spark: SparkSession, folder: str) -> DataFrame:
    candidates = [f"{folder}/{name}.parquet" for name in ("absent", "labels", "documents")]
    path, df = storage.first_valid_source(spark, candidates, ["doc_id", "text"])
    name = path.rsplit("/", 1)[-1].removesuffix(".parquet")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("source"), "n_rows")


def sink_parquet(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "sink")
    storage.write_table(views.raw_flags(spark, folder), path)
    return spark.read.parquet(path).select("id", "comment_text", *FLAG_LABELS)


def sink_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "by_split")
    storage.write_table(unified(spark, folder), path, ("split",))
    return spark.read.parquet(path).select("uid", "split", "label")


def materialize_cached(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "cached")
    storage.materialize(spark, path, lambda: (stored_flags(spark, folder),))

    def never() -> tuple[DataFrame, ...]:
        raise AssertionError("a cached table was built again")

    (again,) = storage.materialize(spark, path, never)
    return again.select("uid", "origin", "text_hash", *FLAG_SIGNALS)


def source_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """The part of a cache key that depends on the contents; file times are not data."""
    return storage.content_fingerprint(
        views.table(spark, folder, "documents"), ["doc_id", "lang", "source", "text"]
    )


def report_json(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "report")
    storage.write_report(stats.dataset_stats(unified(spark, folder)), path)
    return spark.read.schema("metric string, key1 string, key2 string, value double").json(path)


def runlog_scan(spark: SparkSession, folder: str) -> DataFrame:
    path = storage.scratch_path(spark, "runlog")
    raw.append_run_log(views.run_log(spark, folder), path)
    return raw.read_run_log(spark, path).select(*views.run_log(spark, folder).columns)


def split_labeled(spark: SparkSession, folder: str) -> DataFrame:
    known, unknown = harmonize.split_labeled(views.raw_flags(spark, folder))
    return known.select("id", F.lit("labeled").alias("part")).unionByName(
        unknown.select("id", F.lit("unlabeled").alias("part"))
    )


def assemble_parts(spark: SparkSession, folder: str) -> DataFrame:
    flags = views.raw_flags(spark, folder)
    known, unknown = flag_tables(
        flags.filter(F.col("part") == "train"), flags.filter(F.col("part") == "test")
    )
    columns = ["uid", "origin", "source_id", "text_hash"]
    return known.select(*columns, "j_toxic").unionByName(
        unknown.select(*columns), allowMissingColumns=True
    )


def join_test_labels(spark: SparkSession, folder: str) -> DataFrame:
    texts = views.raw_flags(spark, folder).select("id", "comment_text")
    return harmonize.join_test_labels(texts, views.flag_labels(spark, folder))


def join_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    texts = views.raw_flags(spark, folder).select("id", "comment_text")
    return harmonize.unmatched_texts(texts, views.flag_labels(spark, folder)).select("id")


def check_test_labels(spark: SparkSession, folder: str) -> DataFrame:
    ids = views.raw_flags(spark, folder).select("id")
    return harmonize.check_test_labels(ids, views.flag_labels(spark, folder))


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return views.raw_flags(spark, folder).select("id", "comment_text")


def _text_query(function) -> Query:
    return lambda spark, folder: _texts(spark, folder).select(
        "id", function(F.col("comment_text")).alias("text")
    )


def text_hash(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", X.text_hash(F.col("comment_text")).alias("text_hash"))


def make_uid(spark: SparkSession, folder: str) -> DataFrame:
    return _texts(spark, folder).select("id", X.make_uid("jigsaw", F.col("id")).alias("uid"))


def text_columns(spark: SparkSession, folder: str) -> DataFrame:
    return X.add_text_columns(_texts(spark, folder).withColumnRenamed("comment_text", "text_raw"))


def label_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_flags(spark, folder)
    return labels.label_flags(rows).select("uid", "label", "label_name")


def label_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_scores(spark, folder)
    return labels.label_scores(rows).select("uid", "label", "label_name")


def dup_flags(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.add_duplicate_flags(combined_rows(spark, folder)).select(
        "uid", "is_duplicate", "dup_group_size", "label_conflict"
    )


def laid_out_flags(spark: SparkSession, folder: str) -> DataFrame:
    return by_text.add_duplicate_flags(unified_by_text(spark, folder)).select(
        "uid", "is_duplicate", "dup_group_size", "label_conflict"
    )


def laid_out_stats(spark: SparkSession, folder: str) -> DataFrame:
    return by_text.duplicate_stats(unified_by_text(spark, folder))


def laid_out_summary(spark: SparkSession, folder: str) -> DataFrame:
    return by_text.each_text(unified_by_text(spark, folder), dedup.duplicate_summary)


def laid_out_leakage(spark: SparkSession, folder: str) -> DataFrame:
    return by_text.each_text(unified_by_text(spark, folder), split.split_leakage)


def split_assign(spark: SparkSession, folder: str) -> DataFrame:
    return split.assign_split(combined_rows(spark, folder)).select("uid", "split")


def severity_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_flags(spark, folder)
    return rows.select("uid", severity.flag_score(rows).alias("score")).select(
        "uid", "score", severity.bin_flag_score(F.col("score")).alias("level")
    )


def severity_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_scores(spark, folder)
    return rows.select(
        "uid", severity.score_level(rows).alias("level"), severity.score_sum(rows).alias("score")
    )


def target_prepare(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.target_prepare(unified(spark, folder))
    return rows.select("uid", "has_targets", "targets", *TARGET_COLUMNS)


def vocab(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.build_vocab(unified(spark, folder).filter(F.col("split") == "train"))


stored_vocab = stage("vocab", vocab)


def tokenize(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.target_prepare(stored_graded(spark, folder))
    return tokens.tokenize(rows, stored_vocab(spark, folder))


stored_tokens = stage("tokens", tokenize)


def tokenize_whole(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.target_prepare(stored_graded(spark, folder))
    whole = tokens.tokenize(rows, stored_vocab(spark, folder), max_length=None)
    return whole.select("uid", "input_ids", "length")


def severity_expected(spark: SparkSession, folder: str) -> DataFrame:
    return views.predictions(spark, folder).select(
        "row_id", expected_level(F.col("severity_logits")).alias("expected")
    )


def _loss_rows(spark: SparkSession, folder: str, by: tuple[str, ...] = ()) -> DataFrame:
    rows = views.predictions(spark, folder)
    class_weight = losses.class_weight_vector(rows)
    target_weight = losses.target_weight_vector(rows)
    batched = rows.withColumn("batch_id", F.floor(F.col("row_id") / sampling.BATCH_SIZE))
    return losses.loss_terms(batched, by, class_weight, target_weight)


def _loss_query(term: str) -> Query:
    return lambda spark, folder: _loss_rows(spark, folder).select(F.col(term).alias("loss"))


def loss_total(spark: SparkSession, folder: str) -> DataFrame:
    return losses.mean_batch_losses(losses.with_total(_loss_rows(spark, folder, ("batch_id",))))


# The registered samples are small enough to cut the small tables as well.
SAMPLE = 500
RATIO = 0.3


def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_rows(unified_keys(spark, folder), SAMPLE).select("uid", "label")


def epoch_resample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.epoch_resample(train_rows(spark, folder), 1, RATIO).select("uid", "label")


def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return losses.class_weights(sampling.epoch_resample(train_rows(spark, folder), 0))


def sample_profile(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_profile(sampling.epoch_resample(train_rows(spark, folder), 1, RATIO))


def eval_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = stored_graded(spark, folder).filter(F.col("split") == "val")
    return sampling.eval_sample(rows, SAMPLE).select("uid", "severity")


def length_grouped(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.length_grouped(train_rows(spark, folder)).select(
        "uid", "mega_batch", "position", "batch_id"
    )


def padded_batches(spark: SparkSession, folder: str) -> DataFrame:
    padded = sampling.padded_batches(stored_tokens(spark, folder), tokens.PAD_ID)
    return padded.select("uid", "batch_id", "padded_length", "input_ids", "attention_mask")


WIDTH = 64
HEAD_ROWS = (len(CLASS_NAMES), 4, len(TARGET_NAMES))


def head_weights(rows: int, first: int = 0) -> list[list[float]]:
    """Fixed small weights for the registered linear heads."""
    return [
        [((k * 7 + j * 3) % 11 - 5) / 10 for j in range(WIDTH)] for k in range(first, first + rows)
    ]


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return views.table(spark, folder, "embeddings")


def linear_head(spark: SparkSession, folder: str) -> DataFrame:
    rows = heads.linear_head(
        embeddings(spark, folder), "embedding", head_weights(4), [0.0, 0.1, 0.2, 0.3]
    )
    return rows.select("vec_id", "scores")


def masked_mean_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The embedding as eight vectors of eight, every third of them masked."""
    parts = [F.slice("embedding", 8 * i + 1, 8) for i in range(8)]
    mask = [((F.col("vec_id") + i) % 3 != 0).cast("int") for i in range(8)]
    return embeddings(spark, folder).select(
        "vec_id", masked_mean(F.array(*parts), F.array(*mask), 8).alias("mean")
    )


def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    return heads.mean_pool(embeddings(spark, folder), ["label"], "embedding", WIDTH)


def load_linear_model():
    """A stand-in for a user's model: three linear heads over the embedding."""
    weights = np.array(head_weights(sum(HEAD_ROWS)))
    edges = np.cumsum(HEAD_ROWS)[:-1]

    def model(batch: pd.DataFrame) -> pd.DataFrame:
        parts = np.split(np.stack(batch["embedding"].to_list()) @ weights.T, edges, axis=1)
        names = ("class_logits", "severity_logits", "target_logits")
        return pd.DataFrame(
            {name: list(part.astype("float32")) for name, part in zip(names, parts, strict=True)}
        )

    return model


def score_batches(spark: SparkSession, folder: str) -> DataFrame:
    scored = heads.score_batches(embeddings(spark, folder), load_linear_model)
    return scored.select("vec_id", "class_logits", "severity_logits", "target_logits")


def train_heads(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.target_prepare(stored_graded(spark, folder))
    _, featured = heads.features(rows)
    columns = ["uid", "split", "features", "label", "label_name", "severity", "has_targets", "targets"]
    data = storage.cut_lineage(featured.select(*columns), "features")
    train, val = (data.filter(F.col("split") == name) for name in ("train", "val"))
    models = heads.train_heads(train)
    return heads.head_rows(train, val).filter(F.col("head").isin(list(models)))


def train_joint(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokens.target_prepare(stored_graded(spark, folder)).filter(F.col("split") == "train")
    columns = ["uid", "buckets", "label", "label_name", "severity", "has_targets", "targets"]
    data = storage.cut_lineage(joint.with_buckets(rows).select(*columns), "buckets")
    table = joint.loss_table(data, joint.train(data))
    # the order of a sum may change its last places
    return table.select("head", *[F.round(name, 3).alias(name) for name in ("initial", "loss")])


#: Parts that the log arrives in, at least, and lines per part about which more parts are made.
PARTS, PART_LINES = 4, 5_000_000


def runlog_follow(spark: SparkSession, folder: str) -> DataFrame:
    """The log arrives in parts; the stream is started again for each."""
    path, out, marks = (storage.scratch_path(spark, f"follow-{n}") for n in ("log", "out", "marks"))
    log = storage.cut_lineage(views.run_log(spark, folder), "follow")
    low, high, n = log.agg(F.min("epoch"), F.max("epoch"), F.count(F.lit(1))).first()
    parts = max(PARTS, n // PART_LINES)
    for k in range(parts if n else 0):
        # whole epochs, in order, as a run logs them
        part = F.floor((F.col("epoch") - low) * parts / (high - low + 1))
        storage.write_table(log.filter(part == k), f"{path}/{k}")
        grown = spark.readStream.schema(log.schema).parquet(f"{path}/*")
        query = write_stream(runs.follow_best(grown), out, marks)
        query.awaitTermination()
    return spark.read.schema(runs.EVALUATIONS).parquet(out) if n else runlog.best_so_far(log)


def on(source: Query, operator: Callable[[DataFrame], DataFrame], *columns: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        result = operator(source(spark, folder))
        return result.select(*columns) if columns else result

    return run


def check_conservation(spark: SparkSession, folder: str) -> DataFrame:
    return harmonize.check_conservation(
        views.annotator_rows(spark, folder), stored_scores(spark, folder)
    )


def label_rank(df: DataFrame) -> DataFrame:
    return df.select("uid", dedup.label_rank(F.col("label")).alias("rank"))


def combine_sources(df: DataFrame) -> DataFrame:
    return df.select("uid", "source", "label_name", "j_toxic", "m_insult", "t_race")


def runlog_windows(spark: SparkSession, folder: str) -> DataFrame:
    log = views.run_log(spark, folder)
    steps = runlog.step_windows(log).withColumn("kind", F.lit("window"))
    epochs = runlog.epoch_means(log).withColumn("kind", F.lit("epoch"))
    return steps.withColumnRenamed("window", "unit").unionByName(
        epochs.withColumnRenamed("epoch", "unit")
    )


QUERIES: dict[str, Query] = {
    # scans and sinks
    "scan_flag_csv": scan_flag_csv,
    "scan_annotators": scan_annotators,
    "source_profile": source_profile,
    "first_valid_source": first_valid_source,
    "sink_parquet": sink_parquet,
    "sink_partitioned": sink_partitioned,
    "materialize_cached": materialize_cached,
    "source_fingerprint": source_fingerprint,
    "report_json": report_json,
    "runlog_scan": runlog_scan,
    # text
    "normalize_text": _text_query(X.normalize_text),
    "mask_urls": _text_query(X.mask_urls),
    "mask_mentions": _text_query(X.mask_mentions),
    "collapse_repeats": _text_query(X.collapse_repeats),
    "text_hash": text_hash,
    "make_uid": make_uid,
    "text_columns": text_columns,
    # harmonising
    "flag_signals": flag_rows,
    "annotator_signals": score_rows,
    "split_labeled": split_labeled,
    "check_binary": on(labeled_flags, harmonize.check_binary),
    "join_test_labels": join_test_labels,
    "join_unmatched": join_unmatched,
    "check_test_labels": check_test_labels,
    "aggregate_annotators": aggregated,
    "text_conflicts": on(views.annotator_rows, harmonize.text_conflicts),
    "check_conservation": check_conservation,
    "combine_sources": on(combined_rows, combine_sources),
    "assemble_parts": assemble_parts,
    # labels, duplicates, splits, schema
    "label_flags": label_flags,
    "label_scores": label_scores,
    "label_rank": on(unified_keys, label_rank),
    "class_distribution": on(combined_rows, labels.class_distribution),
    "class_shares": on(combined_rows, labels.class_shares),
    "weak_classes": on(
        combined_rows, lambda df: labels.underrepresented_classes(df, 0.25), "label_name"
    ),
    "dup_flags": dup_flags,
    "dup_stats": on(combined_rows, dedup.duplicate_stats),
    "dup_summary": on(combined_rows, dedup.duplicate_summary),
    "laid_out_flags": laid_out_flags,
    "laid_out_stats": laid_out_stats,
    "laid_out_summary": laid_out_summary,
    "laid_out_leakage": laid_out_leakage,
    "split_assign": split_assign,
    "split_counts": on(unified_keys, split.split_counts),
    "split_summary": on(unified_keys, split.split_summary),
    "split_shares": on(unified_keys, split.split_shares),
    "split_leakage": on(unified_keys, split.split_leakage),
    "enforce_schema": unified_rows,
    "validate_schema": on(unified, unified_schema.validate_schema),
    "length_percentiles": on(unified, stats.length_percentiles),
    "target_counts": on(unified, stats.target_counts),
    "dataset_stats": on(unified, stats.dataset_stats),
    # severity
    "harmful_rows": on(unified_keys, severity.harmful_rows, "uid", "label_name"),
    "severity_flags": severity_flags,
    "severity_scores": severity_scores,
    "severity_derive": on(
        unified, severity.derive_severity, "uid", "severity", "severity_score", "severity_name"
    ),
    "severity_check": on(stored_graded, severity.severity_check),
    "severity_quantiles": on(stored_graded, severity.severity_quantiles),
    "severity_by_source": on(stored_graded, severity.severity_by_source),
    "severity_by_class": on(stored_graded, severity.severity_by_class),
    "severity_shares": on(stored_graded, severity.severity_shares),
    "calibration_report": on(stored_graded, stats.calibration_report),
    # training rows, samples, batches
    "target_prepare": target_prepare,
    "build_vocab": vocab,
    "tokenize": tokenize,
    "tokenize_whole": tokenize_whole,
    "sample_rows": sample_rows,
    "epoch_resample": epoch_resample,
    "sample_profile": sample_profile,
    "eval_sample": eval_sample,
    "length_grouped": length_grouped,
    "padded_batches": padded_batches,
    "class_weights": class_weights,
    "target_weights": on(views.predictions, losses.target_weights),
    # metrics and losses
    "eval_class": on(views.predictions, evaluate.class_metrics),
    "eval_severity": on(views.predictions, evaluate.severity_metrics),
    "eval_targets": on(views.predictions, evaluate.target_metrics),
    "eval_all": on(views.predictions, evaluate.all_metrics),
    "severity_report": on(views.predictions, evaluate.severity_report),
    "severity_confusion": on(views.predictions, evaluate.severity_confusion),
    "severity_distance": on(views.predictions, evaluate.severity_distance),
    "severity_expected": severity_expected,
    "best_threshold": on(views.predictions, evaluate.best_threshold),
    "threshold_table": on(views.predictions, evaluate.threshold_table),
    "loss_class": _loss_query("class"),
    "loss_severity": _loss_query("severity"),
    "loss_target": _loss_query("target"),
    "loss_total": loss_total,
    # training log
    "runlog_windows": runlog_windows,
    "runlog_best": on(views.run_log, runlog.best_so_far),
    "runlog_follow": runlog_follow,
    "runlog_early_stop": on(views.run_log, runlog.early_stop),
    # heads
    "mean_pool": mean_pool,
    "masked_mean": masked_mean_rows,
    "linear_head": linear_head,
    "score_batches": score_batches,
    "train_heads": train_heads,
    "train_joint": train_joint,
}


def queries() -> dict[str, Query]:
    def wrap(query: Query) -> Query:
        return lambda spark, folder: portable(query(spark, folder))

    return {name: wrap(query) for name, query in QUERIES.items()}
