"""A log that grows chunk by chunk: after every chunk the stream has what the batch finds."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.operators import runlog
from modloom.sources import raw
from modloom.streaming import runs
from modloom.streaming.live import write_stream

LOG = raw.RUN_LOG_SCHEMA


def lines(seed):
    """(chunk, line) of three runs; run 2 has losses and metrics missing here and there."""
    rng, rows = random.Random(seed), []
    for run in range(3):
        step = 0
        for epoch in range(1, 8):
            for _ in range(9):
                step += 1
                losses = [None if run == 2 and rng.random() < 0.3 else rng.random() for _ in range(4)]
                rows.append((run, "train_step", epoch, step, None, *losses))
                if step % 4 == 0:
                    value = None if run == 2 and rng.random() < 0.3 else rng.randrange(8) / 8
                    rows.append((run, "eval", epoch, step, value, *[None] * 4))
            rows.append((run, "epoch", epoch, step, rng.randrange(8) / 8, *[None] * 4))
        rows.append((run, "run_end", None, step, None, *[None] * 4))
    last = {run: max(r[3] for r in rows if r[0] == run) for run in range(3)}
    # chunk borders lie inside epochs and windows
    return [(3 if r[1] == "run_end" else min(3, 4 * r[3] // (last[r[0]] + 1)), r) for r in rows]


@pytest.fixture(scope="module")
def chunks(spark):
    names = ["run_id", "event", "epoch", "step", "val_macro_f1_class"]
    names += [f"train_loss_{n}" for n in runlog.LOSS_TERMS]
    kinds = {f.name: f.dataType for f in LOG.fields}
    schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    missing = {n: F.lit(None).cast(k) for n, k in kinds.items() if n not in names}
    parts = []
    for k in range(4):
        rows = [row for chunk, row in lines(5) if chunk == k]
        random.Random(k).shuffle(rows)
        parts.append(spark.createDataFrame(rows, schema).withColumns(missing).select(*kinds))
    return parts


def grow(spark, chunks, folder, follow, write):
    """Writes chunk after chunk; yields the log so far once the restarted stream has read it."""
    for k, chunk in enumerate(chunks):
        chunk.repartition(1).write.json(f"{folder}/log/{k}")
        write(follow(spark.readStream.schema(LOG).json(f"{folder}/log/*")), f"{folder}/marks")
        yield spark.read.schema(LOG).json(f"{folder}/log/*")


def plain(rows):
    """Rows with whole numbers as int and fractions with nine places, in any order."""
    return sorted(
        (tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in rows), key=repr
    )


def append(folder):
    def write(stream, marks):
        query = write_stream(stream, f"{folder}/out", marks)
        assert query.awaitTermination(120) and query.exception() is None

    return write


def test_best_so_far(spark, chunks, tmp_path):
    for log in grow(spark, chunks, tmp_path, runs.follow_best, append(tmp_path)):
        want = runlog.best_so_far(log)
        got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns)
        assert plain(got.collect()) == plain(want.collect())


@pytest.mark.parametrize("patience", [1, 2])
def test_status(spark, chunks, tmp_path, patience):
    seen = {}

    def write(stream, marks):
        def keep(batch, _):
            seen.update({r["run_id"]: r for r in batch.collect()})

        query = (
            stream.writeStream.foreachBatch(keep).outputMode("update")
            .option("checkpointLocation", marks).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120) and query.exception() is None

    def follow(log):
        return runs.follow_status(log, patience=patience)

    for log in grow(spark, chunks, tmp_path, follow, write):
        want = runlog.early_stop(log, patience=patience)
        names = want.columns
        assert plain(tuple(r[n] for n in names) for r in seen.values()) == plain(want.collect())


def test_windows_that_are_over(spark, chunks, tmp_path):
    for log in grow(spark, chunks, tmp_path, runs.follow_windows, append(tmp_path)):
        want = runlog.step_windows(log)
        ended = {r["run_id"] for r in log.filter("event = 'run_end'").collect()}
        rows = want.collect()
        newest = {run: max(r["window"] for r in rows if r["run_id"] == run) for run in range(3)}
        over = [r for r in rows if r["run_id"] in ended or r["window"] < newest[r["run_id"]]]
        got = spark.read.parquet(f"{tmp_path}/out").select(*want.columns).collect()
        assert plain(got) == plain(over)
    assert not any(isinstance(x, float) and math.isnan(x) for r in got for x in r)
