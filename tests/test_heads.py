import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from modloom.domains import IGNORE_ID, TARGET_COLUMNS
from modloom.operators import heads as M
from modloom.plans import registry
from modloom.sources import storage


def test_mean_pool(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("b", [5.0, 5.0])], "k string, v array<float>"
    )
    got = {r.k: (r.n, r["mean"]) for r in M.mean_pool(df, ["k"], "v", 2).collect()}
    assert got == {"a": (2, [2.0, 4.0]), "b": (1, [5.0, 5.0])}


def test_batched_scores(spark):
    def load_model():
        def model(batch: pd.DataFrame) -> pd.DataFrame:
            x = np.stack(batch["x"].to_list())
            return pd.DataFrame(
                {
                    "class_logits": list(np.repeat(x[:, :1], 4, axis=1).astype("float32")),
                    "severity_logits": list(np.repeat(x[:, 1:2], 4, axis=1).astype("float32")),
                    "target_logits": list(np.repeat(x.sum(axis=1)[:, None], 8, axis=1).astype("float32")),
                }
            )

        return model

    df = spark.range(50).select("id", F.array(F.col("id") * 1.0, F.col("id") * 2.0).alias("x"))
    rows = M.score_batches(df.repartition(3), load_model).collect()
    assert sorted(r.id for r in rows) == list(range(50))
    assert all(r.class_logits == [r.id] * 4 and r.target_logits == [3.0 * r.id] * 8 for r in rows)


@pytest.fixture(scope="module")
def corpus(spark):
    words = ["fine day", "rude word", "bad people", "will find you"]
    rows = []
    for i in range(240):
        label = i % 4
        rows.append(
            (
                f"u{i}",
                "train" if i % 7 else "val",
                f"{words[label]} {['red', 'blue'][i % 2]} n{i % 7}",
                label,
                ["neither", "offensive", "hate", "threat"][label],
                -100 if label == 0 else label - 1,
                i % 3 == 0,
                [float(i % 2)] + [0.0] * 7,
            )
        )
    return spark.createDataFrame(
        rows,
        "uid string, split string, text string, label int, label_name string, severity int, has_targets boolean, targets array<float>",
    )


def test_heads_learn_their_own_rows(corpus):
    _, data = M.features(corpus, 1 << 8)
    data = data.cache()
    train, val = data.filter("split = 'train'"), data.filter("split = 'val'")
    models = M.train_heads(train, max_iter=15)
    # targets without a positive have nothing to learn
    assert set(models) == {"class", "severity", "target_race"}
    got = {r.head: (r.n, r.accuracy) for r in M.head_accuracy(data, models).collect()}
    assert got["class"][0] == 240 and got["severity"][0] == 180 and got["target_race"][0] == 80
    assert all(accuracy > 0.95 for _, accuracy in got.values())
    rows = {r.head: (r.n_train, r.n_val) for r in M.head_rows(train, val).collect()}
    assert rows["class"] == (205, 35) and rows["target_race"] == (68, 12)
    data.unpersist()


def test_only_training_rows_weigh_words(corpus):
    model, _ = M.features(corpus, 1 << 8)
    assert model.stages[1].numDocs == 205


def test_fit_reads_a_bounded_sample(corpus):
    _, data = M.features(corpus, 1 << 8)
    models = M.train_heads(data.filter("split = 'train'"), max_iter=2, max_fit_rows=60)
    assert set(models) <= {"class", "severity", "target_race"} and "class" in models


def test_fit_reads_all_rows_unless_asked(corpus, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("the heads were fitted on a sample")

    monkeypatch.setattr(M, "sample_rows", refused)
    _, data = M.features(corpus, 1 << 8)
    models = M.train_heads(data.filter("split = 'train'"), max_iter=2)
    assert set(models) == {"class", "severity", "target_race"}


def test_query_learns_from_every_training_row(spark, monkeypatch):
    """More rows than the former sample of 20,000: the query counts, and fits on, all of them."""
    label = F.when(F.col("id") % 3 == 0, 1).otherwise(0)
    columns = {name: F.lit(False) if i else F.col("id") % 2 == 0 for i, name in enumerate(TARGET_COLUMNS)}
    rows = (
        spark.range(0, 24_000, 1, 4)
        .withColumns(columns | {"label": label, "severity": F.lit(IGNORE_ID)})
        .withColumns(
            {
                "uid": F.concat(F.lit("u"), "id"),
                "split": F.when(F.col("id") % 12 == 0, "val").otherwise("train"),
                "label_name": F.when(F.col("label") == 1, "offensive").otherwise("neither"),
                "text": F.concat(F.lit("word"), F.col("id") % 6),
            }
        )
    )
    monkeypatch.setattr(registry, "stored_graded", lambda *_: rows)
    read, fit = [], M.LogisticRegression.fit
    monkeypatch.setattr(
        M.LogisticRegression, "fit", lambda self, data: read.append(data.count()) or fit(self, data)
    )
    with storage.own_scratch(spark):
        got = {r.head: (r.n_train, r.n_val) for r in registry.train_heads(spark, "").collect()}
    assert got == {"class": (22_000, 2_000), "target_race": (22_000, 2_000)}
    assert read == [22_000, 22_000]


def test_models_score_in_a_session_that_observed_a_frame(spark, corpus):
    seen = Observation()
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 5}
    _, data = M.features(corpus, 1 << 8)
    models = M.train_heads(data.filter("split = 'train'"), max_iter=2)
    assert M.head_accuracy(data, models).count() == 3
