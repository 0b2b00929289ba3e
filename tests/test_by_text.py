import random

import pytest
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES
from modloom.operators import by_text, dedup, split
from modloom.sources import storage

SCHEMA = "uid string, text_hash string, source string, label int, label_name string, split string"


def some_rows(n=4000, seed=3):
    """A third of the rows share a text, 40 rows have none, some texts leak into a second split."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = None if i < 40 else "hot" if i % 3 == 0 else f"t{rng.randrange(n // 3)}"
        label = rng.choices(range(4), [6, 3, 2, 1])[0]
        where = "train" if rng.random() < 0.99 else "test"
        rows.append((f"u{i}", text, rng.choice(["jigsaw", "mhs"]), label, CLASS_NAMES[label], where))
    return rows


@pytest.fixture(scope="module")
def df(spark):
    rows = spark.createDataFrame(some_rows(), SCHEMA).repartition(5)
    return storage.cut_lineage(rows, "by-text-input")


@pytest.fixture(scope="module")
def laid(spark, df):
    return by_text.write_by_text(df, storage.scratch_path(spark, "by-text"), buckets=8, hot_rows=500)


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_parts(df, laid):
    """All rows, once; the hot text and the rows without one lie beside the buckets."""
    assert rows_of(laid.rows()) == rows_of(df)
    assert {r.text_hash for r in laid.hot.select("text_hash").distinct().collect()} == {None, "hot"}
    homes = laid.cold.select("text_hash", F.input_file_name().alias("file")).distinct()
    assert homes.groupBy("text_hash").count().filter("count > 1").isEmpty()
    assert laid.cold.filter("text_hash = 'hot' OR text_hash IS NULL").isEmpty()


def test_every_operator_gives_the_plain_result(df, laid):
    keyed = df.filter("text_hash IS NOT NULL")
    pairs = [
        (by_text.each_text(laid, split.split_leakage).filter("text_hash IS NOT NULL"), split.split_leakage(keyed)),
        (by_text.each_text(laid, dedup.duplicate_summary), dedup.duplicate_summary(df)),
        (by_text.duplicate_stats(laid), dedup.duplicate_stats(df)),
        (by_text.add_duplicate_flags(laid), dedup.add_duplicate_flags(df, hot_rows=500)),
    ]
    for got, wanted in pairs:
        assert rows_of(got) == rows_of(wanted)
        assert not got.isEmpty()


def test_buckets_need_no_exchange(laid):
    """Grouping and joining by text inside the buckets moves nothing."""
    for operator in (split.split_leakage, dedup.duplicate_summary):
        assert "Exchange" not in plan_of(operator(laid.cold))
    plan = plan_of(by_text.add_duplicate_flags(laid)).split("== Initial Plan ==")[0]
    # one shuffle alone: the counters of the hot texts
    assert plan.count(" Exchange ") == 1 and plan.count("SortMergeJoin") == 1, plan


def test_opens_again_and_is_replaced(spark, df, laid):
    path = storage.scratch_path(spark, "by-text")
    by_text.write_by_text(df.limit(50), path, buckets=4)
    again = by_text.open_by_text(spark, path)
    assert (again.key, again.buckets, again.rows().count()) == ("text_hash", 4, 50)
    # the new layout may read the old one, with other columns and buckets
    more = by_text.write_by_text(again.rows().withColumn("extra", F.lit(1)), path, buckets=2)
    assert more.buckets == 2 and "extra" in more.cold.columns and more.rows().count() == 50
    assert "Exchange" not in plan_of(split.split_leakage(more.cold))


def test_a_failed_write_leaves_the_old_layout(spark, df):
    path = storage.scratch_path(spark, "by-text")
    before = rows_of(by_text.write_by_text(df, path, buckets=2).rows())
    bad = df.withColumn("uid", F.when(F.col("uid") == "u7", F.raise_error(F.lit("stop"))).otherwise(F.col("uid")))
    with pytest.raises(Exception, match="stop"):
        by_text.write_by_text(bad, path, buckets=2)
    assert rows_of(by_text.open_by_text(spark, path).rows()) == before
    names = [t.name for t in spark.catalog.listTables() if t.name.endswith("_new")]
    assert names == []


def test_empty_and_all_hot(spark, df):
    none = by_text.write_by_text(df.limit(0), storage.scratch_path(spark, "by-text"))
    assert none.buckets == 1 and none.rows().isEmpty()
    assert by_text.add_duplicate_flags(none).isEmpty()
    assert by_text.duplicate_stats(none).first().duplicate_rows == 0
    one = df.filter("text_hash = 'hot'")
    hot = by_text.write_by_text(one, storage.scratch_path(spark, "by-text"), hot_rows=2)
    assert hot.cold.isEmpty()
    clash = hot._replace(cold=hot.cold.withColumn("is_duplicate", F.lit("x")), hot=hot.hot.withColumn("is_duplicate", F.lit("x")))
    assert rows_of(by_text.add_duplicate_flags(clash)) == rows_of(by_text.add_duplicate_flags(hot))
    assert rows_of(by_text.add_duplicate_flags(hot)) == rows_of(dedup.add_duplicate_flags(one))


@pytest.mark.parametrize(
    "rows, buckets", [(0, 1), (1, 1), (2_000_000, 1), (2_000_001, 2), (5_000_000, 4), (10**13, 1 << 16)]
)
def test_bucket_count(rows, buckets):
    assert by_text.bucket_count(rows) == buckets
