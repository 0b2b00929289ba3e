import pytest
from pyspark.sql import functions as F

from modloom.functions.keys import packed, unpacked
from modloom.operators import dedup, groups, split
from modloom.sources.storage import cut_lineage

KEYS = ["", "00", "0", "ab", "ab\n", "AB", "Ab", "abc", "\x01ab", "é", "~ab", "g0", "a" * 40, "0f" * 20, None]
SCHEMA = "uid string, text_hash string, source string, label int, label_name string"


def test_packed_keys_come_back(column):
    assert column(lambda key: unpacked(packed(key)), KEYS) == KEYS
    assert len({bytes(b) for b in column(packed, KEYS) if b is not None}) == len(KEYS) - 1
    assert column(lambda key: F.length(packed(key)), ["0f" * 20, "u1"]) == [21, 3]


def moved(df):
    """Names and types of the columns of each shuffle."""

    def walk(plan):
        if plan.nodeName() == "Exchange":
            out = plan.output()
            yield {out.apply(i).name(): out.apply(i).dataType().typeName() for i in range(out.size())}
        children = plan.children()
        for i in range(children.size()):
            yield from walk(children.apply(i))

    return list(walk(df._jdf.queryExecution().executedPlan()))


@pytest.fixture
def plain_plans(spark):
    for name, value in (("adaptive.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(f"spark.sql.{name}", value)
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_digest_is_shuffled_in_hex(spark, plain_plans):
    rows = spark.range(60).select(
        F.sha1(F.col("id").cast("string")).alias("uid"), F.sha1((F.col("id") % 20).cast("string")).alias("text_hash"),
        F.lit("mhs").alias("source"), (F.col("id") % 4).cast("int").alias("label"), F.lit("neither").alias("label_name"),
    )
    table = cut_lineage(groups.written_groups(rows))
    folded = split.fold_groups(table)
    flagged = dedup.add_duplicate_flags(rows)
    dealt = split.assign_split(rows)
    for df in (groups.written_groups(rows), folded.select("text_hash", "fold"), flagged.select("uid", "text_hash", "label_conflict"), dealt.select("uid", "text_hash", "split")):
        shuffles = moved(df)
        assert shuffles
        for columns in shuffles:
            strings = {name for name, kind in columns.items() if kind == "string"}
            # the key of a hot group moves with its rows, and is null in all others
            assert strings <= {"slice", "source", "label_name", "hot_key"}, strings


@pytest.mark.parametrize("hot_rows", [2, 10_000])
def test_odd_keys_and_ids(spark, hot_rows):
    """Keys that are no digests, null ids and ids that are numbers get the same values and types."""
    rows = [(None if i % 5 == 0 else f"u{i}", KEYS[i % (len(KEYS) - 1)], "mhs", i % 2, "neither") for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA)
    sizes = {}
    for row in rows:
        sizes[row[1]] = sizes.get(row[1], 0) + 1
    for given in (df, df.withColumn("uid", F.monotonically_increasing_id())):
        flagged = dedup.add_duplicate_flags(given, hot_rows=hot_rows)
        assert flagged.schema["uid"].dataType == given.schema["uid"].dataType
        found = flagged.collect()
        assert len(found) == 70 and all(r.dup_group_size == sizes[r.text_hash] for r in found)
        assert flagged.select(*given.columns).exceptAll(given).isEmpty()
