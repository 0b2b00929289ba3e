import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from modloom.domains import TARGET_COLUMNS
from modloom.operators import tokens as K
from modloom.plans.build import build_tokens, training_batches

TEXTS = ["the cat, the dog", "", "Über_1 x!", "the " * 200, "unseen words"]


@pytest.fixture
def graded(spark):
    rows = [
        (f"u{i}", ["jigsaw", "mhs"][i % 2], text, i % 4, -100 if i % 4 == 0 else 1, ["train", "val"][i % 2])
        for i, text in enumerate(TEXTS)
    ]
    df = spark.createDataFrame(
        rows, "uid string, source string, text string, label int, severity int, split string"
    )
    mine = F.col("source") == "mhs"
    return df.withColumns({name: F.when(mine, F.lit(name == "t_age")) for name in TARGET_COLUMNS})


def words(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def test_targets(graded):
    for r in K.target_prepare(graded).collect():
        assert r.has_targets == (r.source == "mhs")
        assert r.targets == [1.0 if r.has_targets and n == "t_age" else 0.0 for n in TARGET_COLUMNS]
        assert r.t_age == int(r.has_targets) and r.t_race == 0


def test_vocab(graded):
    counts = Counter(w for t in TEXTS for w in words(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    for size in (None, 4):
        got = {r.token: (r.token_id, r.n) for r in K.build_vocab(graded, size).collect()}
        assert got == {w: (i + 4, counts[w]) for i, w in enumerate(ranked[:size])}


def test_vocab_over_many_files(spark):
    """Ids are ranks over all written files."""
    texts = spark.range(3000).select(F.concat_ws(" ", F.col("id"), F.col("id") % 40, F.col("id") % 7).alias("text"))
    got = K.build_vocab(texts.repartition(6)).collect()
    ranked = sorted(got, key=lambda r: (-r.n, r.token))
    assert [r.token_id for r in ranked] == list(range(4, 3004))


@pytest.mark.parametrize("max_length", [128, None])
@pytest.mark.parametrize("max_broadcast", [2, K.MAX_BROADCAST_VOCAB])
def test_tokens(graded, max_length, max_broadcast):
    vocab = K.build_vocab(graded, 4)
    ids = {r.token: r.token_id for r in vocab.collect()}
    coded = K.tokenize(K.target_prepare(graded), vocab, max_length, max_broadcast)
    got = {r.uid: r for r in coded.collect()}
    assert len(got) == len(TEXTS)
    cut = None if max_length is None else max_length - 2
    for i, text in enumerate(TEXTS):
        row = got[f"u{i}"]
        assert row.input_ids == [0] + [ids.get(w, 3) for w in words(text)][:cut] + [2]
        assert row.length == len(row.input_ids) and row.attention_mask == [1] * row.length
        assert row.source == ["jigsaw", "mhs"][i % 2]


def test_own_corpus_has_no_unknown_token(graded):
    coded = K.tokenize(K.target_prepare(graded), K.build_vocab(graded))
    assert coded.filter(F.array_contains("input_ids", K.UNKNOWN_ID)).isEmpty()


def test_large_vocabulary_is_not_broadcast_whole(graded, spark):
    vocab = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("token"), (F.col("id") + 4).cast("int").alias("token_id")
    )
    plan = K.tokenize(K.target_prepare(graded), vocab)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 1 and "token_id" in plan
    assert str(K.FIRST_WORD_ID + K.MAX_BROADCAST_VOCAB) in plan


def test_columns_and_shuffles(graded, spark):
    vocab = spark.createDataFrame([("the", 4)], "token string, token_id int")
    df = K.tokenize(K.target_prepare(graded), vocab)
    assert df.columns == list(K.KEEP_COLUMNS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the texts' tokens by uid, and the other columns
    assert plan.count("Exchange hashpartitioning") <= 3


def test_users_own_encoder(graded):
    def load():
        return lambda texts: [[len(t)] * 300 for t in texts]

    rows = K.tokenize_with(K.target_prepare(graded), load, max_length=5).collect()
    assert all(r.length == 5 and len(set(r.input_ids)) == 1 for r in rows)


def test_token_table_and_batches(graded, spark, tmp_path):
    stored = build_tokens(graded, f"{tmp_path}/tokens")
    assert sorted(p.name for p in (tmp_path / "tokens").iterdir() if p.is_dir()) == [
        "split=train", "split=val"
    ]
    train = stored.filter("split = 'train'")
    assert "PartitionFilters: [isnotnull(split" in train._jdf.queryExecution().executedPlan().toString()
    batches = training_batches(stored).collect()
    assert {r.batch_id for r in batches} == {0}
    assert {len(r.input_ids) for r in batches} == {128}


@pytest.mark.parametrize("max_broadcast", [2, K.MAX_BROADCAST_VOCAB])
def test_runs_of_long_texts_and_repeated_rows(spark, max_broadcast):
    """Texts longer than an Arrow batch, with rare tokens at both ends; rows of one uid share their tokens."""
    long = " ".join(["first", *["a b c"] * 9000, "last"])
    rows = [("l", long), ("n", None), ("t", "a b x"), ("t", "c a")]
    df = spark.createDataFrame(rows, "uid string, text string").withColumns(
        {"source": F.lit("mhs"), "split": F.lit("train"), "label": F.lit(0), "severity": F.lit(1)}
    ).withColumns({name: F.lit(True) for name in TARGET_COLUMNS})
    vocab = spark.createDataFrame(
        [(t, i + 4) for i, t in enumerate(["a", "b", "c", "last"])], "token string, token_id int"
    )
    got = K.tokenize(K.target_prepare(df), vocab, None, max_broadcast).collect()
    ids = {r.uid: r.input_ids for r in got}
    assert ids["l"] == [0, 3, *[4, 5, 6] * 9000, 7, 2] and ids["n"] == [0, 2]
    assert ids["t"] == [0, 4, 6, 4, 5, 3, 2] and len(got) == 4


def test_single_tokens_are_shuffled_only_if_rare(spark):
    """Texts of common words cross a shuffle as one row each, not as one row per word."""
    df = spark.range(200).select(
        F.col("id").cast("string").alias("uid"), F.repeat(F.lit("a b "), 50).alias("text"),
        *[F.lit(1).alias(name) for name in ("source", "split", "label", "severity")],
        *[F.lit(True).alias(name) for name in TARGET_COLUMNS],
    )
    vocab = spark.createDataFrame([("a", 4), ("b", 5), ("c", 6)], "token string, token_id int")
    coded = K.tokenize(K.target_prepare(df), vocab, max_broadcast=2)
    joined = coded._jdf.queryExecution().optimizedPlan().toString()
    below = joined[joined.index("Aggregate [key"):]
    # the explode lies below the packing, which lies below the join with the rare entries
    assert below.index("rare_token") < below.index("MapInArrow") < below.index("Generate")
    assert all(r.input_ids == [0, *[4, 5] * 50, 2] for r in coded.collect())
