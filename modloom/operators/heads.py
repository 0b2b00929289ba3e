"""Model-side operators: vector means, linear heads, batched scoring, multi-head training."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.domains import IGNORE_ID, TARGET_NAMES
from modloom.functions.counting import count_where
from modloom.functions.scores import linear_scores
from modloom.operators.losses import class_weights
from modloom.operators.sampling import epoch_resample, sample_rows
from modloom.operators.tokens import word_tokens

SCORE_SCHEMA = (
    "class_logits array<float>, severity_logits array<float>, target_logits array<float>"
)


def mean_pool(df: DataFrame, by: Sequence[str], vector: str, width: int) -> DataFrame:
    """Mean vector per group: one running mean per dimension, combined before the shuffle."""
    means = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(vector)[i].cast("double")).alias(f"d{i}") for i in range(width)],
    )
    return means.select(*by, "n", F.array(*[f"d{i}" for i in range(width)]).alias("mean"))


def linear_head(
    df: DataFrame,
    features: str,
    weights: Sequence[Sequence[float]],
    bias: Sequence[float],
    output: str = "scores",
) -> DataFrame:
    return df.withColumn(output, linear_scores(F.col(features), weights, bias))


def score_batches(
    df: DataFrame, load_model: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]
) -> DataFrame:
    """Adds the three score vectors of a user's model, loaded once per task.

    The model maps an Arrow-sized batch of rows to a frame with the three score columns.
    """
    names = ("class_logits", "severity_logits", "target_logits")
    kept = [field for field in df.schema.fields if field.name not in names]
    schema = ", ".join(
        [*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], SCORE_SCHEMA]
    )
    columns = [field.name for field in kept]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            scores = model(batch)
            yield pd.concat(
                [batch[columns].reset_index(drop=True), scores[list(names)].reset_index(drop=True)],
                axis=1,
            )

    return df.mapInPandas(score, schema)


def features(
    df: DataFrame, size: int = 1 << 16, fit_on: str = "split = 'train'"
) -> tuple[PipelineModel, DataFrame]:
    """Hashed word frequencies, weighed by inverse document frequency in the rows ``fit_on``."""
    words = df.withColumn("words", word_tokens(F.lower("text")))
    pipeline = Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="tf", numFeatures=size),
            IDF(inputCol="tf", outputCol="features"),
        ]
    )
    model = pipeline.fit(words.filter(fit_on))
    return model, model.transform(words).drop("words", "tf")


def head_masks() -> dict[str, tuple[Column, Column]]:
    """Per head which rows it learns from, and its answer on them."""
    heads = {
        "class": (F.lit(True), F.col("label")),
        "severity": (F.col("severity") != IGNORE_ID, F.col("severity")),
    }
    for i, name in enumerate(TARGET_NAMES):
        heads[f"target_{name}"] = (F.col("has_targets"), F.col("targets")[i])
    return heads


def heads_with_choice(df: DataFrame) -> set[str]:
    """Heads with two or more different answers, from one pass."""
    ranges = []
    for name, (mask, answer) in head_masks().items():
        seen = F.when(mask, answer)
        ranges.append((F.max(seen) > F.min(seen)).alias(name))
    found = df.agg(*ranges).first()
    return {name for name in head_masks() if found[name]}


def train_heads(
    df: DataFrame, max_iter: int = 10, parallelism: int = 4, max_fit_rows: int | None = None
) -> dict[str, LogisticRegressionModel]:
    """One linear classifier per head on the column ``features``; heads are fitted side by side.

    ``df`` is the training split; all its rows are read, unless the caller asks for an exact sample
    of ``max_fit_rows``. The class head weighs rows by the inverse root class size of the resampled first
    epoch. A head without rows, or with a single answer, gets no model.
    """
    # Four rows, one per class.
    weights = F.broadcast(class_weights(epoch_resample(df, 0)).select("label_name", "weight"))
    if max_fit_rows is not None:
        df = sample_rows(df, max_fit_rows)

    def fit(name: str) -> LogisticRegressionModel:
        mask, answer = head_masks()[name]
        data = df.filter(mask).withColumn("answer", answer.cast("double"))
        if name == "class":
            data = data.join(weights, "label_name")
        else:
            data = data.withColumn("weight", F.lit(1.0))
        learner = LogisticRegression(
            featuresCol="features",
            labelCol="answer",
            weightCol="weight",
            family="multinomial" if name in ("class", "severity") else "binomial",
            maxIter=max_iter,
            regParam=0.01,
            rawPredictionCol=f"{name}_raw",
            probabilityCol=f"{name}_probability",
            predictionCol=f"{name}_prediction",
        )
        model = learner.fit(data.select("features", "answer", "weight"))
        # The summary holds the session, which no task can take along once it has observed a frame.
        model._java_obj.setSummary(data.sparkSession._jvm.scala.Option.empty())
        return model

    usable = heads_with_choice(df)
    names = [name for name in head_masks() if name in usable]
    with ThreadPoolExecutor(parallelism) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(fit), names), strict=True))


def head_accuracy(df: DataFrame, models: dict) -> DataFrame:
    """(head, n, accuracy) of trained heads on ``df``, each on its own rows, in one pass."""
    scored = df
    for model in models.values():
        scored = model.transform(scored)
    heads = head_masks()
    counters = []
    for name in models:
        mask, answer = heads[name]
        right = F.col(f"{name}_prediction") == answer.cast("double")
        counters += [
            count_where(mask).alias(f"{name}_n"),
            count_where(mask & right).alias(f"{name}_right"),
        ]
    lines = [
        F.struct(
            F.lit(name).alias("head"),
            F.col(f"{name}_n").alias("n"),
            (F.col(f"{name}_right") / F.greatest(F.col(f"{name}_n"), F.lit(1))).alias("accuracy"),
        )
        for name in models
    ]
    return scored.agg(*counters).select(F.inline(F.array(*lines)))


def head_rows(train: DataFrame, val: DataFrame) -> DataFrame:
    """(head, n_train, n_val): the rows each head learns from and is tested on."""
    sides = []
    for name, df in (("n_train", train), ("n_val", val)):
        counts = [count_where(mask).alias(head) for head, (mask, _) in head_masks().items()]
        lines = [
            F.struct(F.lit(head).alias("head"), F.col(head).alias(name)) for head in head_masks()
        ]
        sides.append(df.agg(*counts).select(F.inline(F.array(*lines))))
    return sides[0].join(sides[1], "head")
