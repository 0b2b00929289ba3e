"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, word pairs, and pairs with one or two words between.
Training reads at most ``MAX_ROWS`` labelled documents, those with the smallest digests of their
ids, in that order; L1 leaves few weights, which go to every task as one small array. Scoring
reads each whole text once and shuffles nothing.

Defined results: null and empty texts have no features and get the score of the bias; labels
other than 0 and 1, null ids and repeated label rows for one id (the largest label counts) are
handled; without any label every score is next to 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.llm.tables import cut_lineage, free_name, held_out, text_of

BITS = 20
#: Most labelled documents that training reads.
MAX_ROWS = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.1
#: Log odds of every text where there is nothing to learn from.
NO_LABELS = -30.0
#: Bytes of text that are hashed in one go; a longer text goes alone.
CHUNK = 1 << 20

PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(PRIME), -1, 1 << 64))
#: Odd multipliers for words, neighbours and pairs with one and two words between.
KINDS = tuple(map(np.uint64, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)))
#: Bytes of a word: ASCII letters and digits, and every byte of a longer character.
IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


class Powers:
    """Powers of the hash base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            self.up, self.down = (np.full(size, x, np.uint64) for x in (PRIME, INVERSE))
            self.up[0] = self.down[0] = 1
            np.cumprod(self.up, out=self.up)
            np.cumprod(self.down, out=self.down)
        return self.up[:n], self.down[:n]


def _mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(29))) * np.uint64(0x9FB21C651E98DF25) >> np.uint64(64 - BITS)


def hashed(data: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(place, feature) of all grams; ``place`` is the byte where the first word starts.

    A byte 0x0A parts the texts: no gram reaches over it.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], IS_WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = powers.upto(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up)])
    words = (total[ends] - total[starts]) * down[starts]
    words = (words ^ (words >> np.uint64(31))) * KINDS[0]
    text = np.searchsorted(np.flatnonzero(raw == 10), starts)
    places, features = [starts], [_mix(words)]
    for gap in (1, 2, 3):
        same = text[gap:] == text[:-gap]
        pairs = words[:-gap] * KINDS[gap] + (words[gap:] ^ (words[gap:] >> np.uint64(30)))
        places.append(starts[:-gap][same])
        features.append(_mix(pairs[same]))
    return np.concatenate(places), np.concatenate(features)


def prepared(text: str) -> bytes:
    """Lower case, with line ends as spaces, so that 0x0A can part texts."""
    return text.lower().replace("\n", " ").encode("utf-8", "replace")


def chunks(texts) -> Iterator[tuple[bytes, np.ndarray, int]]:
    """(joined texts, start of each, number of the first) in pieces of about ``CHUNK`` bytes."""
    part: list[bytes] = []
    size = first = 0

    def joined():
        starts = np.cumsum([0, *(len(p) + 1 for p in part[:-1])])
        return b"\n".join(part), starts, first

    for i, text in enumerate(texts):
        data = prepared(text)
        if part and size + len(data) > CHUNK:
            yield joined()
            part, size, first = [], 0, i
        part.append(data)
        size += len(data) + 1
    if part:
        yield joined()


def features(texts) -> Iterator[np.ndarray]:
    """The distinct features of each text, sorted."""
    powers = Powers()
    for data, starts, _ in chunks(texts):
        place, feature = hashed(data, powers)
        owner = np.searchsorted(starts, place, side="right") - 1
        keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | feature)
        bounds = np.searchsorted(keys, np.arange(len(starts) + 1, dtype=np.uint64) << np.uint64(BITS))
        plain = (keys & np.uint64((1 << BITS) - 1)).astype(np.int32)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield plain[a:b]


def scores(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    """Probability per text; only features with a weight are made distinct."""
    powers = Powers()
    out = np.full(len(texts), bias)
    for data, starts, first in chunks(texts):
        place, feature = hashed(data, powers)
        found = np.flatnonzero(weights[feature])
        owner = np.searchsorted(starts, place[found], side="right") - 1
        keys = np.unique((owner.astype(np.uint64) << np.uint64(BITS)) | feature[found])
        own = (keys >> np.uint64(BITS)).astype(np.int64)
        gain = weights[keys & np.uint64((1 << BITS) - 1)]
        out[first : first + len(starts)] += np.bincount(own, gain, len(starts))
    return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


class Ftrl:
    """Per-coordinate FTRL-proximal for log loss; the bias is neither shrunk nor dropped."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.bias = size

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / (rate + L2))

    def step(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, self.bias)
        w = self.weights(at)
        bias = -self.z[self.bias] * ALPHA / (BETA + np.sqrt(self.n[self.bias]))
        w[-1] = bias
        slope = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        grown = self.n[at] + slope * slope
        self.z[at] += slope - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown

    def model(self) -> tuple[np.ndarray, float]:
        w = self.weights(np.arange(self.bias))
        return w, float(-self.z[self.bias] * ALPHA / (BETA + np.sqrt(self.n[self.bias])))


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trains on rows (label, features) in their order, epoch after epoch."""
    rows: list[tuple[int, np.ndarray]] = []
    for batch in batches:
        lists = batch.column("features")
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        ends = ends - ends[0]
        labels = batch.column("label").to_pylist()
        rows += [(y, flat[a:b]) for y, a, b in zip(labels, ends[:-1], ends[1:], strict=True)]
    if not rows:
        return
    learner = Ftrl(1 << BITS)
    for _ in range(EPOCHS):
        for label, at in rows:
            learner.step(at, label)
    weights, bias = learner.model()
    kept = np.flatnonzero(weights)
    yield pa.record_batch(
        {
            "feature": pa.array(np.append(kept, -1).astype(np.int64)),
            "weight": pa.array(np.append(weights[kept], bias)),
        }
    )


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """(digest, text_digest, text, label): at most ``limit`` labelled documents outside the held-out fifth.

    Rows equal in id and text count once; the limit holds for rows, however often an id occurs.
    """
    digest = F.md5(F.col("doc_id").cast("string"))
    chosen = (
        labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("label"))
        .withColumn("digest", digest)
        .orderBy("digest")
        .limit(limit)
    )
    # at most ``limit`` rows of two numbers and a digest
    met = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    met = cut_lineage(met.select("digest", F.md5("text").alias("text_digest"), "text", "label"), "toxic-rows")
    key = ["digest", "text_digest"]
    kept = met.select(*key).distinct().orderBy(*key).limit(limit)
    return met.join(F.broadcast(kept), key).dropDuplicates(key)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_ROWS) -> dict[int, float]:
    """Feature to weight, the bias under -1. One task learns from the bounded sample."""

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["digest", "text_digest", "label"]].assign(features=list(features(rows["text"])))

    made = training_rows(docs, labels, limit).select("digest", "text_digest", "label", "text")
    schema = "digest string, text_digest string, label int, features array<int>"
    made = cut_lineage(made.mapInPandas(grams, schema), "toxic-features")
    ordered = made.repartition(1).sortWithinPartitions("digest", "text_digest").select("label", "features")
    learned = ordered.mapInArrow(_train, "feature long, weight double").collect()
    return {row.feature: row.weight for row in learned}


def with_score(docs: DataFrame, model: dict[int, float], name: str = "toxic_score") -> DataFrame:
    """``docs`` with the score as ``name``. The model has at most 2**BITS + 1 entries."""
    bias = model.get(-1, NO_LABELS)
    kept = sorted(k for k in model if k >= 0)
    values = np.array([model[k] for k in kept])
    shared = docs.sparkSession.sparkContext.broadcast((np.array(kept, np.int64), values))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, values = shared.value
        weights = np.zeros(1 << BITS)
        weights[at] = values
        for texts in batches:
            yield pd.Series(scores(texts, weights, bias))

    made = F.pandas_udf(score, "double")
    return docs.withColumn(name, made(text_of()))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        F.col("toxic_score").alias("score"),
        (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(docs: DataFrame, model: dict[int, float]) -> DataFrame:
    """``docs`` without those that the model calls toxic; columns stay."""
    name = free_name(docs, "toxic_score")
    return with_score(docs, model, name).filter(F.col(name) < 0.5).drop(name)
