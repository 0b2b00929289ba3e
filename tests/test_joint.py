"""Joint training: gradient, losses and scores against plain forms, and against separate fits."""

import glob
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from modloom.operators import heads, joint, losses
from modloom.sources import storage

SCHEMA = "uid string, text string, label int, label_name string, severity int, has_targets boolean, targets array<float>"
NAMES = ["neither", "offensive", "hate", "threat"]
WORDS = ["fine day", "rude word", "bad people", "will find you"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    data = []
    for i in range(240):
        label = i % 4
        targets = [float(i % 2), float(i % 3 == 1)] + [0.0] * 6 if i % 3 else None
        text = f"{WORDS[label]} {['red', 'blue'][i % 2]} n{i % 7}"
        severity = -100 if label == 0 else i % 3
        data.append((f"u{i}", text, label, NAMES[label], severity, targets is not None, targets))
    data.append(("odd", None, 1, "offensive", -100, False, None))
    data.append(("long", "rude " * 3000, 1, "offensive", 2, False, None))
    path = f"{tmp_path_factory.mktemp('joint')}/rows"
    joint.with_buckets(spark.createDataFrame(data, SCHEMA), 64).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def trained(rows):
    return joint.train(rows, 64, max_jobs=25)


def test_gradient_is_the_slope_of_the_loss(rows, monkeypatch):
    rng = np.random.default_rng(0)
    weights, scale = rng.normal(size=(65, joint.WIDTH)) / 3, joint.setup(rows, 64)
    found, slope = joint.gradient(rows, weights, scale)
    monkeypatch.setattr(joint, "SLICE", 7)
    again = joint.gradient(rows, weights, scale, max_tasks=1)
    assert found == pytest.approx(again[0]) and np.allclose(slope, again[1])
    factors = np.array([1, losses.LAMBDA_SEVERITY, losses.LAMBDA_TARGET])
    way = rng.normal(size=weights.shape)
    up, down = (joint.gradient(rows, weights + h * way, scale)[0] @ factors for h in (1e-5, -1e-5))
    assert (up - down) / 2e-5 == pytest.approx((slope * way).sum(), rel=1e-5)


def test_losses_are_those_of_the_scored_rows(rows, trained):
    """The losses of training equal the evaluation losses of the model's scores."""
    scale = joint.setup(rows, 64)
    scored = joint.with_scores(rows, trained.weights)
    want = losses.loss_terms(
        scored, class_weight=list(scale.class_weight), target_weight=list(scale.target_weight)
    ).first()
    assert trained.losses == pytest.approx({name: want[name] for name in joint.HEADS})
    zero = joint.with_scores(rows, np.zeros_like(trained.weights))
    start = losses.loss_terms(zero, target_weight=list(scale.target_weight)).first()
    assert trained.initial["severity"] == pytest.approx(start["severity"])
    assert trained.initial["target"] == pytest.approx(start["target"])


def test_total_is_below_separate_fits(rows, trained):
    _, data = heads.features(rows.withColumn("split", F.lit("train")).fillna({"text": ""}), 64)
    data = data.cache()
    models = heads.train_heads(data, max_iter=25)
    scored = data
    for model in models.values():
        scored = model.transform(scored)
    none = F.lit(0.0)
    raw = {name: vector_to_array(F.col(f"{name}_raw")) for name in models}
    levels = [raw["severity"][i] if i < 3 else F.lit(-30.0) for i in range(4)]
    aims = [raw[n][1] if n in raw else none for n in (f"target_{t}" for t in joint.TARGET_NAMES)]
    scored = scored.select(
        "label", "severity", "has_targets", "targets",
        raw["class"].alias("class_logits"), F.array(*levels).alias("severity_logits"),
        F.array(*aims).alias("target_logits"),
    )
    scale = joint.setup(rows, 64)
    apart = losses.with_total(
        losses.loss_terms(
            scored, class_weight=list(scale.class_weight), target_weight=list(scale.target_weight)
        )
    ).first()["total"]
    data.unpersist()
    table = {r["head"]: r for r in joint.loss_table(rows, trained).collect()}
    assert table["total"]["loss"] < apart
    assert all(r["loss"] < r["initial"] for r in table.values())


def test_a_step_is_one_job(spark, rows):
    scale = joint.setup(rows, 64)
    spark.sparkContext.setJobGroup("one-gradient", "")
    joint.gradient(rows, np.zeros((65, joint.WIDTH)), scale)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one-gradient")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # adaptive execution submits the map side of the sum as a job of its own
    assert len(jobs) <= 2


def test_rows_without_answers_teach_nothing(spark, rows):
    bare = spark.createDataFrame([("a", "rude", None, None, -100, None, None)], SCHEMA)
    found = joint.train(joint.with_buckets(bare, 64), 64)
    assert set(found.losses.values()) == {0.0} and not found.weights.any() and found.jobs == 1
    assert joint.train(rows.limit(0), 64).losses == dict.fromkeys(joint.HEADS, 0.0)


def test_entries_are_distinct_buckets_of_each_row():
    found = joint.entries_of(pa.array([[3, 1, 3], [], None, [0, 63, 0, 0]], pa.list_(pa.int32())), 64)
    assert found.rows.tolist() == [0, 3] and found.starts.tolist() == [0, 2]
    assert found.bucket.tolist() == [1, 3, 0, 63] and found.count.tolist() == [1, 2, 3, 1]
    assert found.value == pytest.approx([1 / np.sqrt(3), 1, 1, 0.5])
    none = joint.entries_of(pa.array([[], None], pa.list_(pa.int32())), 64)
    weights = np.arange(joint.WIDTH * 65.0).reshape(joint.WIDTH, 65)
    assert np.array_equal(joint.logits_of(none, weights), np.tile(weights[:, -1:], 2))


def test_training_packs_rows_once(rows, monkeypatch):
    """Steps read blocks of entries, not the words of the rows again."""
    made, packed = [], joint.packed

    def counted(*given):
        made.append(packed(*given))
        return made[-1]

    monkeypatch.setattr(joint, "packed", counted)
    found = joint.train(rows, 64, max_jobs=4)
    assert len(made) == 1 and found.jobs == 4
    blocks = [pickle.loads(r.block) for r in made[0].collect()]
    answers = [label for _, label, _, _ in blocks]
    assert sum(map(len, answers)) == rows.count()
    assert max(map(len, answers)) <= joint.ROWS
    want = rows.agg(F.sum(F.size(F.array_distinct("buckets")))).first()[0]
    assert sum(len(entries[3]) for entries, *_ in blocks) == want < rows.agg(F.sum(F.size("buckets"))).first()[0]


def test_training_leaves_no_blocks(spark, rows):
    with storage.own_scratch(spark) as outer:
        joint.train(rows, 64, max_jobs=2)
        assert not outer.paths
    left = glob.glob(f"{storage.shared_folder(spark).removeprefix('file://')}/modloom/blocks-*")
    assert not left


def test_rows_of_a_block_teach_the_same_heads(rows):
    blocks = [pickle.loads(r.block) for r in joint.packed(rows, 64).collect()]
    for _, *answers in blocks:
        taught = joint._taught(*answers)
        assert (taught == taught[:, :1]).all()
