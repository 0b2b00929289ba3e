import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from modloom.domains import CLASS_NAMES
from modloom.functions.keys import seeded_key
from modloom.operators import dedup, split
from modloom.operators.groups import dominant_stratum, group_table
from modloom.rules import SplitRules
from modloom.sources.storage import cut_lineage


def skewed_rows(n=3000, seed=1):
    """A third of the rows share one text; the rest repeat a little."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = "hot" if i % 3 == 0 else f"t{rng.randrange(n // 2)}"
        label = rng.choices(range(4), [5, 3, 2, 1])[0]
        rows.append((f"u{i}", text, rng.choice(["jigsaw", "mhs"]), label, CLASS_NAMES[label]))
    return rows


SCHEMA = "uid string, text_hash string, source string, label int, label_name string"


@pytest.fixture(scope="module")
def rows():
    return skewed_rows()


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.mark.parametrize("hot_rows", [2, 500, 10_000])
def test_flags_match_brute_force(df, rows, hot_rows):
    """The same flags whatever counts as a hot group."""
    labels = defaultdict(list)
    for row in rows:
        labels[row[1]].append(row[3])
    flagged = dedup.add_duplicate_flags(df, hot_rows=hot_rows).collect()
    assert len(flagged) == len(rows)
    for r in flagged:
        group = labels[r.text_hash]
        assert r.dup_group_size == len(group) and r.is_duplicate == (len(group) > 1)
        assert r.label_conflict == (len(set(group)) > 1)
    stats = dedup.duplicate_stats(df).first()
    sizes = [len(g) for g in labels.values()]
    assert stats.duplicate_rows == sum(s for s in sizes if s > 1)
    assert stats.duplicate_groups == sum(s > 1 for s in sizes)
    assert stats.conflicting_groups == sum(len(set(g)) > 1 for g in labels.values())


def test_hot_rows_are_spread_over_the_shuffle(spark, df):
    """No shuffle partition of the join receives the whole hot group."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        flagged = dedup.add_duplicate_flags(df, hot_rows=500)
        plan = flagged._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "FileScan parquet" in plan
        sizes = flagged.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in sizes) < 0.4 * df.count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_summary(df, rows):
    sources, labels = defaultdict(set), defaultdict(set)
    sizes = Counter(r[1] for r in rows)
    for _, text, source, _, name in rows:
        sources[text].add(source)
        labels[text].add(name)
    summary = dedup.duplicate_summary(df).collect()
    assert {r.text_hash for r in summary} == {t for t, n in sizes.items() if n > 1}
    for r in summary:
        assert r.sources == sorted(sources[r.text_hash])
        assert r.labels == sorted(labels[r.text_hash])
    assert dedup.duplicate_summary(df.limit(0)).collect() == []


def test_unknown_source_is_refused(spark):
    bad = spark.createDataFrame([("u", "t", "elsewhere", 0, "neither")], SCHEMA)
    with pytest.raises(Exception, match="unknown source"):
        group_table(bad).collect()


def test_label_rank(spark):
    got = spark.range(4).select(dedup.label_rank(F.col("id")).alias("r")).collect()
    assert [r.r for r in got] == [3, 2, 1, 0]


def test_split_keeps_groups_and_is_repeatable(df):
    first = split.assign_split(df, hot_rows=500)
    assert split.split_leakage(first).isEmpty()
    again = split.assign_split(df.repartition(7), hot_rows=10_000)
    assert sorted(map(tuple, first.select("uid", "split").collect())) == sorted(
        map(tuple, again.select("uid", "split").collect())
    )
    other = split.assign_split(df, SplitRules(seed=7)).select("uid", "split")
    assert first.select("uid", "split").exceptAll(other).count() > 0


def test_split_shares_are_balanced(spark):
    rows = []
    for i in range(2000):
        label = i % 4
        rows.append((f"u{i}", f"h{i}", ["jigsaw", "mhs"][i % 2], label, CLASS_NAMES[label]))
    result = split.assign_split(spark.createDataFrame(rows, SCHEMA))
    shares = {r.split: r.share for r in split.split_shares(result).collect()}
    assert shares == {"train": 0.8, "val": 0.1, "test": 0.1}
    for r in split.split_summary(result).collect():
        total = r.train + r.val + r.test
        assert abs(r.test / total - 0.1) < 0.01 and abs(r.val / total - 0.1) < 0.01


def test_tail_is_dealt_in_turn(spark, df, monkeypatch):
    """Slices change nothing: the deal is one global order in each stratum."""
    monkeypatch.setattr(split, "HEAD_SHARES", 0)
    groups = cut_lineage(group_table(df))
    folded = {r.text_hash: r.fold for r in split.fold_groups(groups).collect()}
    keyed = groups.withColumns({"s": dominant_stratum(), "k": seeded_key(42, F.col("text_hash"))})
    turns = {}
    for r in sorted(keyed.collect(), key=lambda r: (-len(bin(r.group_size)), r.k)):
        turn = turns.setdefault(r.s, r.s)
        assert folded[r.text_hash] == turn % 10
        turns[r.s] += 1
    monkeypatch.setattr(split, "SLICE_DIGITS", 1)
    again = {r.text_hash: r.fold for r in split.fold_groups(groups.repartition(5)).collect()}
    assert again == folded


def heavy_rows(sizes, tail, classes=(0,)):
    rows = [(f"text {k}", classes[k % len(classes)]) for k, size in enumerate(sizes) for _ in range(size)]
    rows += [(f"rare {k}", k % 4) for k in range(tail)]
    return [
        (f"u{i}", text, ("jigsaw", "mhs")[len(text) % 2], label, CLASS_NAMES[label])
        for i, (text, label) in enumerate(rows)
    ]


@pytest.mark.parametrize(
    "sizes, tail, classes",
    [
        ([4000, 3000], 13_000, (0,)),
        ([4000, 3000], 13_000, (0, 1)),
        ([900] * 12, 9200, (0, 1, 2, 3)),
        ([500 - k for k in range(30)], 5000, (0, 2)),
        ([1000] * 9 + [999], 500, (3,)),
        ([60, 40], 100, (0,)),
    ],
)
def test_heavy_texts_leave_the_shares(spark, sizes, tail, classes):
    rows = heavy_rows(sizes, tail, classes)
    table = spark.createDataFrame(rows, SCHEMA)
    first = split.assign_split(table.repartition(3), hot_rows=50)
    shares = {r.split: r.share for r in split.split_shares(first).collect()}
    if sum(sorted(sizes)[-8:]) <= 0.8 * len(rows):
        assert abs(shares["val"] - 0.1) < 0.02 and abs(shares["test"] - 0.1) < 0.02
    again = split.assign_split(table.repartition(7))
    assert sorted(map(tuple, first.select("uid", "split").collect())) == sorted(
        map(tuple, again.select("uid", "split").collect())
    )
    groups = cut_lineage(group_table(table))
    folded = split.fold_groups(groups)
    loads = {r.fold: (r.rows, r.small) for r in folded.groupBy("fold").agg(
        F.sum("group_size").alias("rows"), F.count(F.when(F.col("group_size") == 1, 1)).alias("small")).collect()}
    assert sum(n for n, _ in loads.values()) == len(rows)
    heavy = folded.filter("group_size > 1").groupBy("fold").agg(F.sum("group_size").alias("n")).collect()
    level = max(n for n, small in loads.values() if small)
    assert all(loads[r.fold][1] == 0 for r in heavy if r.n > level + 1)


def test_classes_of_the_head_are_spread(spark):
    """Every fold gets two heavy texts of each class before one gets a third."""
    rows = heavy_rows([100] * 80, 4000, (0, 1, 2, 3))
    table = spark.createDataFrame([(uid, text, "mhs", *own) for uid, text, _, *own in rows], SCHEMA)
    folded = split.fold_groups(cut_lineage(group_table(table))).filter("group_size > 1")
    classes = folded.select("fold", dominant_stratum().alias("s")).groupBy("fold", "s").count().collect()
    assert {r["count"] for r in classes} == {2} and len(classes) == 40


def test_deficits():
    loads = split.Loads([100, 100])
    assert loads.pattern() == [f for _ in range(100) for f in range(10)]
    assert [loads.place([60, 0]), loads.place([0, 30]), loads.place([15, 0]), loads.place([0, 20])] == [2, 3, 4, 5]
    # 75 rows are left: 20 to each held-out fold, the other 35 bring the empty training folds to 8.75
    assert loads.deficits() == [20, 20, 0, 0, 0, 0, 8.75, 8.75, 8.75, 8.75]
    pattern = loads.pattern()
    assert len(pattern) == 1000 and set(pattern) == {0, 1, 6, 7, 8, 9} and pattern.count(0) == 267
    assert split.Loads([0, 0]).pattern() == [0]
    over = split.Loads([100, 0])
    for _ in range(9):
        over.place([11, 0])
    assert over.deficits()[:2] == [0.5, 0.5]


def test_hot_text(spark, df):
    """A text with a third of all rows takes the broadcast, and the plan sorts no groups."""
    copies = df.limit(1).select(*(c for c in df.columns if c != "uid"))
    hot = spark.range(40_000).select(F.concat(F.lit("hot"), "id").alias("uid")).join(copies)
    both = df.unionByName(hot.select(*df.columns))
    flagged = dedup.add_duplicate_flags(both)
    assert flagged.agg(F.max("dup_group_size")).first()[0] >= 40_000
    assert dict(flagged.dtypes)["dup_group_size"] == "bigint"
    result = split.add_groups_and_split(both)
    assert result.filter("uid LIKE 'hot%'").select("split").distinct().count() == 1
    assert "TakeOrdered" not in result._jdf.queryExecution().executedPlan().toString()


def test_equal_folds_are_refused():
    with pytest.raises(ValueError):
        SplitRules(val_fold=0, test_fold=0)


def test_leak_is_found(spark):
    df = spark.createDataFrame(
        [("a", "train"), ("a", "test"), ("b", "val"), ("b", "val")], "text_hash string, split string"
    )
    assert [r.text_hash for r in split.split_leakage(df).collect()] == ["a"]
