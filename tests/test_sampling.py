import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from modloom.operators import sampling as S


def rows(spark, sizes):
    data, n = [], 0
    for label, size in enumerate(sizes):
        for _ in range(size):
            data.append((f"u{n}", label, n % 2 == 0, 1 + (n * 37) % 90))
            n += 1
    schema = "uid string, label int, has_targets boolean, length int"
    return spark.createDataFrame(data, schema).repartition(5)


def key(seed, uid):
    return hashlib.sha1(f"{seed}|{uid}".encode()).hexdigest()


@pytest.mark.parametrize("n", [0, 1, 7, 199, 200, 500])
def test_sample_is_exact(spark, n):
    df = rows(spark, [200])
    got = {r.uid for r in S.sample_rows(df, n).collect()}
    ordered = sorted((f"u{i}" for i in range(200)), key=lambda uid: key(42, uid))
    assert got == set(ordered[:n])


def test_sample_does_not_depend_on_partitions(spark):
    df = rows(spark, [300])
    a = {r.uid for r in S.sample_rows(df.repartition(2), 50).collect()}
    b = {r.uid for r in S.sample_rows(df.repartition(9), 50).collect()}
    assert a == b != {r.uid for r in S.sample_rows(df, 50, seed=1).collect()}


@pytest.mark.parametrize(
    "sizes, ratio, quota",
    [((100, 10, 5, 3), 3.0, 30), ((50, 7, 4), 2.0, 14), ((9, 10), 3.0, 9), ((20,), 3.0, 0),
     ((100, 7), 0.3, 2), ((100, 3), 0.3, 0)],
)
def test_resample_keeps_harmful_and_caps_neither(spark, sizes, ratio, quota):
    got = Counter(r.label for r in S.epoch_resample(rows(spark, sizes), 0, ratio).collect())
    assert got[0] == quota
    assert all(got[label] == size for label, size in enumerate(sizes) if label)


def test_epochs_draw_anew_but_repeatably(spark):
    df = rows(spark, (200, 20))

    def draw(epoch):
        return {r.uid for r in S.epoch_resample(df, epoch).collect()}

    assert draw(0) == draw(0) != draw(1)


def test_profile(spark):
    df = rows(spark, (4,))
    assert S.sample_profile(df).first().asDict() == {"num_examples": 4, "has_targets_share": 0.5}
    assert S.sample_profile(df.limit(0)).first().has_targets_share == 0.0


def test_positions_are_a_permutation(spark):
    df = S.with_positions(rows(spark, (500,)), S.seeded_key(3, F.col("uid")))
    got = sorted((r.position, r.uid) for r in df.collect())
    assert [p for p, _ in got] == list(range(500))
    assert [u for _, u in got] == sorted((u for _, u in got), key=lambda uid: key(3, uid))


def test_mega_batches_fall_in_length(spark):
    grouped = S.length_grouped(rows(spark, (500,)), batch_size=4)
    got = sorted(grouped.collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(500))
    megas = defaultdict(list)
    for r in got:
        megas[r.mega_batch].append(r.length)
        assert r.batch_id == r.position // 4 and r.mega_batch == r.position // 200
    assert [len(v) for v in megas.values()] == [200, 200, 100]
    assert all(v == sorted(v, reverse=True) for v in megas.values())
    other = S.length_grouped(rows(spark, (500,)), epoch=1, batch_size=4)
    assert {(r.uid, r.mega_batch) for r in got} != {(r.uid, r.mega_batch) for r in other.collect()}


def test_padding(spark):
    df = rows(spark, (70,)).withColumn("input_ids", F.sequence(F.lit(5), F.col("length") + 4))
    df = df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.col("length")))
    padded = S.padded_batches(df, 1, batch_size=4).collect()
    longest = defaultdict(int)
    for r in padded:
        longest[r.batch_id] = max(longest[r.batch_id], r.length)
    for r in padded:
        assert r.padded_length == -(-longest[r.batch_id] // 8) * 8
        assert len(r.input_ids) == len(r.attention_mask) == r.padded_length
        assert r.input_ids == list(range(5, 5 + r.length)) + [1] * (r.padded_length - r.length)
        assert sum(r.attention_mask) == r.length


def test_batches_need_no_extra_shuffle(spark):
    grouped = S.length_grouped(rows(spark, (70,)))
    before = grouped._jdf.queryExecution().executedPlan().toString().count("Exchange hash")
    after = S.padded_lengths(grouped)._jdf.queryExecution().executedPlan().toString()
    assert after.count("Exchange hash") == before


def test_eval_sample(spark):
    df = rows(spark, (60, 60)).withColumn("severity", F.when(F.col("label") == 0, -100).otherwise(1))
    got = {r.uid for r in S.eval_sample(df, 10).collect()}
    ordered = sorted((f"u{i}" for i in range(60, 120)), key=lambda uid: key(42, uid))
    assert got == set(ordered[:10])


def test_batches_are_dealt_by_a_short_key(spark):
    """The id stays with its sequence; 20 bytes of it cross the shuffles that order the rows."""
    rows = [(f"r{i % 90}", 1 + i % 7, [5] * (1 + i % 7), [1] * (1 + i % 7)) for i in range(100)] + [(None, 3, [5] * 3, [1] * 3)]
    df = spark.createDataFrame(rows, "uid string, length int, input_ids array<int>, attention_mask array<int>")
    padded = S.padded_batches(df, 0, batch_size=4, mega_batches=3)
    plan = padded._jdf.queryExecution().optimizedPlan().toString().splitlines()
    (at,) = [i for i, line in enumerate(plan) if "RepartitionByExpression" in line]
    assert "_order_key" in plan[at + 1] and "input_ids" not in plan[at + 1]
    assert padded.columns[:4] == ["uid", "length", "input_ids", "attention_mask"]
    # by definition: places by id and length, then a join by id
    places = S.padded_lengths(S.length_grouped(df.select("uid", "length"), batch_size=4, mega_batches=3))
    want = df.join(places.drop("length"), "uid")
    columns = ["uid", "length", "batch_id", "mega_batch", "padded_length"]
    assert sorted(padded.select(*columns).collect()) == sorted(want.select(*columns).collect())
