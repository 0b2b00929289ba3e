import math

import numpy as np
import pytest

from modloom.domains import SEVERITY_NAMES, TARGET_NAMES
from modloom.functions.scores import expected_level, linear_scores, masked_mean
from modloom.operators import evaluate as E
from modloom.operators import losses as L

SCHEMA = (
    "row_id long, class_logits array<float>, severity_logits array<float>, "
    "target_logits array<float>, label int, severity int, has_targets boolean, targets array<float>"
)


def make(n=400, seed=0, severity=True, targets=True):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 3))
        sev = int(rng.integers(0, 4)) if label and severity else -100
        has = bool(rng.random() < 0.5) and targets
        rows.append(
            (
                i,
                [float(np.float32(v)) for v in rng.normal(size=4)],
                [float(np.float32(v)) for v in rng.normal(size=4)],
                [float(np.float32(round(v, 1))) for v in rng.normal(size=8)],
                label,
                sev,
                has,
                [float(v) for v in rng.integers(0, 2, 7)] + [0.0],
            )
        )
    return rows


def f1(true, predicted, i):
    tp = sum(t == i and p == i for t, p in zip(true, predicted))
    total = sum(t == i for t in true) + sum(p == i for p in predicted)
    return 2 * tp / total if total else 0.0


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def metrics(df):
    return {r.metric: r.value for r in df.collect()}


def test_class_metrics(df, data):
    true = [r[4] for r in data]
    predicted = [int(np.argmax(r[1])) for r in data]
    got = metrics(E.class_metrics(df))
    scores = [f1(true, predicted, i) for i in range(4)]
    assert got["val_accuracy_class"] == pytest.approx(np.mean(np.equal(true, predicted)))
    assert got["val_macro_f1_class"] == pytest.approx(np.mean(scores))
    support = [true.count(i) for i in range(4)]
    assert got["val_weighted_f1_class"] == pytest.approx(np.average(scores, weights=support))


def test_severity_tables(df, data):
    pairs = [(r[5], int(np.argmax(r[2]))) for r in data if r[5] != -100]
    got = metrics(E.severity_metrics(df))
    assert got["val_num_severity_rows"] == len(pairs)
    assert got["val_accuracy_severity"] == pytest.approx(np.mean([t == p for t, p in pairs]))
    confusion = {r.true_level: r for r in E.severity_confusion(df).collect()}
    for i, a in enumerate(SEVERITY_NAMES):
        for j, b in enumerate(SEVERITY_NAMES):
            assert confusion[a][f"pred_{b}"] == pairs.count((i, j))
    near = sum(abs(t - p) == 1 for t, p in pairs)
    far = sum(abs(t - p) > 1 for t, p in pairs)
    distance = {r.kind: (r.n, r.share) for r in E.severity_distance(df).collect()}
    assert distance == {
        "adjacent": (near, pytest.approx(near / (near + far))),
        "distant": (far, pytest.approx(far / (near + far))),
    }
    report = {r.level: r for r in E.severity_report(df).collect()}
    assert set(report) == {*SEVERITY_NAMES, "accuracy", "macro avg", "weighted avg"}
    true, predicted = [t for t, _ in pairs], [p for _, p in pairs]
    assert report["high"].f1 == pytest.approx(f1(true, predicted, 2))
    assert report["macro avg"].f1 == pytest.approx(np.mean([f1(true, predicted, i) for i in range(4)]))


def test_target_metrics(df, data):
    rows = [r for r in data if r[6]]
    true = np.array([r[7] for r in rows]) > 0
    predicted = 1 / (1 + np.exp(-np.array([r[3] for r in rows]))) >= 0.5
    got = metrics(E.target_metrics(df))
    scores = [f1(true[:, i], predicted[:, i], True) for i in range(8)]
    assert got["val_num_target_rows"] == len(rows)
    assert got["val_macro_f1_target"] == pytest.approx(np.mean(scores))
    assert got["val_subset_accuracy_target"] == pytest.approx(np.mean((true == predicted).all(axis=1)))
    for i, name in enumerate(TARGET_NAMES):
        assert got[f"val_f1_target_{name}"] == pytest.approx(scores[i])
    assert E.all_metrics(df).count() == 3 + 3 + 5 + 24
    assert E.select_metric(E.all_metrics(df), "val_macro_f1_target").first().value == pytest.approx(
        np.mean(scores)
    )


def test_nothing_to_score(spark):
    df = spark.createDataFrame(make(20, severity=False, targets=False), SCHEMA)
    got = metrics(E.all_metrics(df))
    assert got["val_num_severity_rows"] == got["val_num_target_rows"] == 0
    assert got["val_macro_f1_severity"] == got["val_macro_f1_target"] == 0
    assert E.severity_distance(df).collect() == []
    table = E.threshold_table(df).collect()
    assert len(table) == 8 and all((r.best_threshold, r.best_f1) == (0.5, 0.0) for r in table)
    loss = L.loss_terms(df).first()
    assert loss["severity"] == loss["target"] == 0.0
    assert [r.weight for r in L.target_weights(df).collect()] == [1.0] * 8


def test_thresholds_match_brute_force(df, data):
    rows = [r for r in data if r[6]]
    got = {r.target: r for r in E.threshold_table(df).collect()}
    for i, name in enumerate(TARGET_NAMES):
        scores = [1 / (1 + math.exp(-r[3][i])) for r in rows]
        truth = [r[7][i] > 0 for r in rows]
        assert got[name].positives == sum(truth)
        if not any(truth):
            assert (got[name].best_threshold, got[name].best_f1) == (0.5, 0.0)
            continue
        curve = [(f1(truth, [s >= t for s in scores], True), -t) for t in set(scores)]
        best, threshold = max(curve)
        assert got[name].best_f1 == pytest.approx(best)
        assert got[name].best_threshold == pytest.approx(-threshold)
        assert got[name].flat_f1 == pytest.approx(f1(truth, [r[3][i] >= 0 for r in rows], True))


def weights_of(counts):
    inverse = 1 / np.sqrt(np.maximum(counts, 1))
    return inverse * len(counts) / inverse.sum()


def test_weights(df, data):
    counts = np.bincount([r[4] for r in data], minlength=4)
    assert [r.weight for r in L.class_weights(df).collect()] == pytest.approx(weights_of(counts))
    positives = np.array([r[7] for r in data if r[6]]).sum(axis=0)
    got = [r.weight for r in L.target_weights(df).collect()]
    assert got == pytest.approx(weights_of(positives)) and np.mean(got) == pytest.approx(1)


def losses_of(rows, cw, tw):
    part = mass = 0.0
    errors, target = [], []
    for r in rows:
        x = np.array(r[1])
        nll = np.log(np.exp(x - x.max()).sum()) + x.max() - x
        part += 0.95 * cw[r[4]] * nll[r[4]] + 0.05 / 4 * (cw * nll).sum()
        mass += cw[r[4]]
        if r[5] != -100:
            p = np.exp(r[2]) / np.exp(r[2]).sum()
            errors.append(((p * np.arange(4)).sum() - r[5]) ** 2)
        if r[6]:
            z, y = np.array(r[3]), np.array(r[7])
            target.append((tw * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - z * y)).mean())
    return part / mass, np.mean(errors) if errors else 0.0, np.mean(target) if target else 0.0


def test_losses(df, data):
    cw, tw = np.array([0.5, 1.0, 1.5, 1.0]), np.linspace(0.5, 1.5, 8)
    got = L.with_total(L.loss_terms(df, (), cw, tw)).first()
    want = losses_of(data, cw, tw)
    assert (got["class"], got["severity"], got["target"]) == pytest.approx(want)
    assert got["total"] == pytest.approx(want[0] + 0.5 * want[1] + 0.2 * want[2])


def test_weights_from_the_table_itself(df, data):
    got = L.loss_terms(df, (), L.class_weight_vector(df), L.target_weight_vector(df)).first()
    cw = weights_of(np.bincount([r[4] for r in data], minlength=4))
    tw = weights_of(np.array([r[7] for r in data if r[6]]).sum(axis=0))
    assert (got["class"], got["severity"], got["target"]) == pytest.approx(losses_of(data, cw, tw))


def test_batch_losses(df, data):
    batched = df.selectExpr("*", "row_id div 32 AS batch_id")
    got = L.mean_batch_losses(L.with_total(L.loss_terms(batched, ("batch_id",)))).first()
    ones = np.ones(4), np.ones(8)
    batches = [losses_of(data[i : i + 32], *ones) for i in range(0, len(data), 32)]
    want = np.mean(batches, axis=0)
    assert (got["class"], got["severity"], got["target"]) == pytest.approx(tuple(want))


def test_distant_errors_cost_more(spark):
    def loss(level):
        row = (0, [0.0] * 4, [9.0 if i == level else 0.0 for i in range(4)], [0.0] * 8, 1, 0, False, [0.0] * 8)
        return L.loss_terms(spark.createDataFrame([row], SCHEMA)).first()["severity"]

    assert loss(0) < loss(1) < loss(2) < loss(3)


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([1000.0, 0.0, 0.0, 1000.0], [[1.0, 2.0], [3.0, 5.0], [9.0, 9.0]], [1, 1, 0], [2.0, -1.0])],
        "l array<float>, v array<array<float>>, m array<int>, x array<float>",
    )
    row = df.select(
        expected_level(df.l).alias("e"),
        masked_mean(df.v, df.m, 2).alias("mean"),
        linear_scores(df.x, [[1, 2], [0.5, 0]], [1, 0]).alias("y"),
    ).first()
    assert row.e == pytest.approx(1.5) and row["mean"] == [2.0, 3.5] and row.y == [1.0, 1.0]
    empty = df.select(masked_mean(df.v, df.m.cast("array<int>"), 2).alias("m")).first()
    assert len(empty.m) == 2


def target_rows(spark, scored):
    """One target's (logit, positive) pairs; the other seven are empty."""
    rows = [([float(x)] + [0.0] * 7, [float(y)] + [0.0] * 7, True) for x, y in scored]
    return spark.createDataFrame(
        rows, "target_logits array<float>, targets array<float>, has_targets boolean"
    )


@pytest.mark.parametrize(
    "scored",
    [
        [(math.log(p / (1 - p)), y) for p, y in ((0.1234567, 1), (0.01, 0), (0.02, 0), (0.9, 1))],
        [(-15, 1), (-15.5, 1), (-16, 0), (-16.5, 0)],
        [(40.0, 1), (41.0, 1), (39.0, 0)],
    ],
)
def test_best_threshold_attains_its_f1(spark, scored):
    df = target_rows(spark, scored)
    best = E.best_threshold(df).filter("target = 'race'").first()
    assert best.best_f1 == 1.0
    logits = [r.target_logits[0] for r in df.collect()]
    truth = [y for _, y in scored]
    picked = [1 / (1 + math.exp(-x)) >= best.best_threshold for x in logits]
    if max(logits) < 30:  # above, scores of different logits are equal in double precision
        assert picked == [bool(y) for y in truth]


def test_slices_never_fall(column):
    values = sorted([-3e38, -100.0, -1.0, -1e-6, 0.0, 1e-30, 1e-3, 0.5, 7.0, 3e38])
    slices = column(E.logit_slice, values, "double")
    assert slices == sorted(slices) and len(set(slices)) > 6
