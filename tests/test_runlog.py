import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.operators import runlog as R
from modloom.sources import raw


def make_log(seed=0):
    rng = random.Random(seed)
    rows = []
    for run in range(4):
        step = 0
        for epoch in range(1, 9):
            for _ in range(12):
                step += 1
                loss = rng.random()
                rows.append((run, "train_step", epoch, step, None, loss, loss / 2, loss / 4, loss / 8))
                if step % 5 == 0:
                    rows.append((run, "eval", epoch, step, rng.randrange(20) / 20, *[None] * 4))
            step += 1
            rows.append((run, "epoch", epoch, step, rng.randrange(20) / 20, *[None] * 4))
        rows.append((run, "run_end", None, step, None, *[None] * 4))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_log()


@pytest.fixture(scope="module")
def log(spark, rows):
    names = ["run_id", "event", "epoch", "step", "val_macro_f1_class"]
    names += [f"train_loss_{n}" for n in R.LOSS_TERMS]
    kinds = {f.name: f.dataType for f in raw.RUN_LOG_SCHEMA.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    df = spark.createDataFrame(rows, schema)
    missing = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in names}
    return df.withColumns(missing).select(*kinds).repartition(3)


def evaluations(rows, run):
    return [(r[2], r[3], r[4]) for r in rows if r[0] == run and r[1] in ("eval", "epoch")]


@pytest.mark.parametrize("slice_steps", [3, 100_000])
def test_best_so_far(log, rows, slice_steps):
    got = {(r.run_id, r.step): r for r in R.best_so_far(log, slice_steps=slice_steps).collect()}
    n = 0
    for run in range(4):
        best = None
        for epoch, step, value in evaluations(rows, run):
            r = got[run, step]
            assert (r.epoch, r.previous_best) == (epoch, best)
            assert r.improved == (best is None or value > best)
            best = value if best is None else max(best, value)
            n += 1
    assert len(got) == n


@pytest.mark.parametrize("patience", [1, 2, 99])
def test_early_stop(log, rows, patience):
    got = {r.run_id: r for r in R.early_stop(log, patience=patience).collect()}
    for run in range(4):
        best, idle, stop, done, tops = None, 0, None, 0, []
        for epoch in range(1, 9):
            improved = False
            for e, _, value in evaluations(rows, run):
                if e == epoch and (best is None or value > best):
                    best, improved = value, True
            idle = 0 if improved else idle + 1
            done += 1
            tops.append(best)
            if idle >= patience:
                stop = epoch
                break
        r = got[run]
        assert (r.stop_epoch, r.epochs_run, r.epochs_logged) == (stop, done, 8)
        assert r.best_metric == best


def test_windows(log, rows):
    got = {(r.run_id, r.window): r for r in R.step_windows(log).collect()}
    steps = [r for r in rows if r[0] == 2 and r[1] == "train_step" and 11 <= r[3] <= 20]
    mean = sum(r[5] for r in steps) / len(steps)
    assert got[2, 1].n == len(steps)
    assert got[2, 1].train_loss_total == pytest.approx(mean)
    assert got[2, 1].train_loss_target == pytest.approx(mean / 8)
    epochs = {(r.run_id, r.epoch): r.n for r in R.epoch_means(log).collect()}
    assert epochs[0, 1] == 12 and len(epochs) == 32


def test_json_lines_of_mixed_shape(spark, log, tmp_path):
    path = f"{tmp_path}/log"
    raw.append_run_log(log.filter("run_id < 2"), path)
    raw.append_run_log(log.filter("run_id >= 2"), path)
    again = raw.read_run_log(spark, path)
    assert again.exceptAll(log).isEmpty() and again.count() == log.count()


def test_closing_evaluation_comes_last(spark):
    """An epoch's closing evaluation may share its step with one inside the epoch."""
    lines = [
        '{"run_id": 1, "event": "epoch", "epoch": 1, "step": 200, "val_macro_f1_severity": 0.4, "improved": true}',
        '{"run_id": 1, "event": "eval", "epoch": 1, "step": 200, "val_macro_f1_severity": 0.4, "lr": 0.1}',
    ]
    log = spark.createDataFrame([(x,) for x in lines], "v string").select(
        F.from_json("v", raw.RUN_LOG_SCHEMA).alias("r")
    )
    found = R.best_so_far(log.select("r.*"), metric="val_macro_f1_severity").collect()
    assert {r.event: r.improved for r in found} == {"eval": True, "epoch": False}


def test_log_keeps_every_metric():
    names = set(raw.RUN_LOG_SCHEMA.names)
    assert len(R.EVAL_METRICS) == 35 and set(R.EVAL_METRICS) <= names
    assert {"improved", "best_metric", "epochs_without_improvement", "lr"} <= names
