"""Code domains and the unified table schema (fixed values)."""

from __future__ import annotations

from pyspark.sql import types as T

# Class, severity and target codes in id order.
CLASS_NAMES = ("neither", "offensive", "hate", "threat")
SEVERITY_NAMES = ("low", "medium", "high", "critical")
TARGET_NAMES = (
    "race",
    "religion",
    "origin",
    "gender",
    "sexuality",
    "age",
    "disability",
    "politics",
)
FALLBACK_CLASS = "neither"
NO_SEVERITY = "none"
IGNORE_ID = -100

# Source tags, which are part of every uid.
FLAG_SOURCE = "jigsaw"
SCORE_SOURCE = "mhs"
SOURCES = (FLAG_SOURCE, SCORE_SOURCE)
ORIGIN_TRAIN = "jigsaw_train"
ORIGIN_TEST = "jigsaw_test"
ORIGIN_SCORES = "mhs"

SPLITS = ("train", "val", "test")

# Column names of the two raw sources.
FLAG_LABELS = ("toxic", "severe_toxic", "obscene", "threat", "insult", "identity_hate")
RATINGS = (
    "insult",
    "humiliate",
    "dehumanize",
    "violence",
    "genocide",
    "attack_defend",
    "hatespeech",
)
HATE_SCORE = "hate_speech_score"

FLAG_SIGNALS = tuple(f"j_{name}" for name in FLAG_LABELS)
MEAN_SIGNALS = tuple(f"m_{name}" for name in (HATE_SCORE, *RATINGS))
COUNT_SIGNAL = "m_n_annotators"
TARGET_COLUMNS = tuple(f"t_{name}" for name in TARGET_NAMES)
RAW_TARGETS = tuple(f"target_{name}" for name in TARGET_NAMES)

TEXT_COLUMNS = ("text_raw", "text", "text_hash", "is_short")
SOURCE_COLUMNS = ("uid", "source", "origin", "source_id", *TEXT_COLUMNS)

CLASS_IDS = {name: i for i, name in enumerate(CLASS_NAMES)}
SEVERITY_IDS = {**{name: i for i, name in enumerate(SEVERITY_NAMES)}, NO_SEVERITY: IGNORE_ID}


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


# Both counters are LONG: one comment or text may hold a third of all rows.
UNIFIED_SCHEMA = T.StructType(
    [
        *(_field(name, T.StringType()) for name in SOURCE_COLUMNS if name != "is_short"),
        _field("is_short", T.BooleanType()),
        _field("label", T.ByteType()),
        _field("label_name", T.StringType()),
        _field("split", T.StringType()),
        _field("is_duplicate", T.BooleanType()),
        _field("dup_group_size", T.LongType()),
        _field("label_conflict", T.BooleanType()),
        *(_field(name, T.ByteType()) for name in FLAG_SIGNALS),
        *(_field(name, T.FloatType()) for name in MEAN_SIGNALS),
        _field(COUNT_SIGNAL, T.LongType()),
        *(_field(name, T.BooleanType()) for name in TARGET_COLUMNS),
    ]
)
REQUIRED_COLUMNS = ("uid", "source", "text", "label", "label_name", "split")
