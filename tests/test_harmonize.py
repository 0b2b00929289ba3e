import pytest
from pyspark.sql import functions as F

from modloom.checks import require
from modloom.domains import FLAG_LABELS, RATINGS, RAW_TARGETS, SOURCE_COLUMNS
from modloom.operators import harmonize as H
from modloom.operators.labels import label_flags
from modloom.plans.build import load_annotators, load_flags
from modloom.sources import raw, storage

FLAGS = ", ".join(f"{n} byte" for n in FLAG_LABELS)


def write_files(spark, folder, with_all_labels=True):
    train = spark.createDataFrame(
        [
            ("k7", "a calm remark", 0, 0, 0, 0, 0, 0),
            ("k8", "NA", 0, 0, 1, 0, 0, 0),
            ("k9", 'upper\n"lower" half', 0, 0, 0, 0, 1, 1),
        ],
        f"id string, comment_text string, {FLAGS}",
    )
    test = spark.createDataFrame(
        [("p1", "good point"), ("p2", "wait and see what comes"), ("p3", "nobody rated it"), ("p4", "")],
        "id string, comment_text string",
    )
    labels = [("p1", *[0] * 6), ("p2", 0, 1, 0, 1, 0, 0), ("p4", *[0] * 6)]
    if with_all_labels:
        labels.append(("p3", *[-1] * 6))
    raw.write_flag_csv(train, f"{folder}/train")
    raw.write_flag_csv(test, f"{folder}/test")
    raw.write_flag_csv(spark.createDataFrame(labels, f"id string, {FLAGS}"), f"{folder}/labels")


def openers(spark, folder):
    return (
        lambda: raw.read_flag_csv(spark, f"{folder}/train", raw.TRAIN_COLUMNS),
        lambda: raw.read_flag_csv(spark, f"{folder}/test", raw.TEST_COLUMNS),
        lambda: raw.read_flag_csv(spark, f"{folder}/labels", raw.TEST_LABEL_COLUMNS),
    )


def test_flag_files_end_to_end_and_cache(spark, tmp_path):
    write_files(spark, tmp_path)
    outputs = (f"{tmp_path}/out/labeled", f"{tmp_path}/out/unlabeled")
    known, unknown = load_flags(spark, *openers(spark, tmp_path), *outputs)
    rows = {r.source_id: r for r in label_flags(known).collect()}
    assert sorted(rows) == ["k7", "k8", "k9", "p1", "p2", "p4"]
    assert [rows[i].label_name for i in ("k7", "k8", "k9", "p1", "p2", "p4")] == [
        "neither", "offensive", "hate", "neither", "threat", "neither"
    ]
    assert rows["k8"].text_raw == "NA" and rows["k9"].text_raw == 'upper\n"lower" half'
    assert rows["k9"].text == 'upper "lower" half' and rows["p4"].text_raw == ""
    assert rows["k7"].origin == "jigsaw_train" and rows["p1"].origin == "jigsaw_test"
    assert dict(known.dtypes)["j_threat"] == "tinyint"
    assert unknown.columns == list(SOURCE_COLUMNS)
    assert [r.text_raw for r in unknown.collect()] == ["nobody rated it"]

    def closed():
        raise FileNotFoundError("sources are gone")

    again, _ = load_flags(spark, closed, closed, closed, *outputs)
    assert again.count() == 6
    with pytest.raises(FileNotFoundError):
        load_flags(spark, closed, closed, closed, *outputs, force=True)


def test_missing_test_labels_are_refused(spark, tmp_path):
    write_files(spark, tmp_path, with_all_labels=False)
    with pytest.raises(ValueError, match="texts_without_labels"):
        load_flags(spark, *openers(spark, tmp_path), f"{tmp_path}/a", f"{tmp_path}/b")


def test_repeated_keys_are_refused(spark):
    texts = spark.createDataFrame([("a", "x"), ("a", "y")], "id string, comment_text string")
    labels = spark.createDataFrame([("a", *[0] * 6)], f"id string, {FLAGS}")
    check = H.check_test_labels(texts, labels)
    assert check.first().repeated_texts == 1 and check.first().repeated_labels == 0
    with pytest.raises(ValueError):
        require(check, "bad labels")


def test_missing_csv_column(spark, tmp_path):
    write_files(spark, tmp_path)
    with pytest.raises(KeyError):
        raw.read_flag_csv(spark, f"{tmp_path}/test", raw.TRAIN_COLUMNS)
    paths = [f"{tmp_path}/{name}" for name in ("train", "test", "labels")]
    profile = {r.source: (r.n_rows, r.n_keys) for r in raw.profile_flag_files(spark, *paths).collect()}
    assert profile == {"train": (3, 3), "test": (4, 4), "test_labels": (4, 4)}
    with pytest.raises(KeyError):
        raw.profile_flag_files(spark, paths[1], paths[0], paths[2])


def test_binary_check(spark):
    df = spark.createDataFrame([(0, 1, 0, 0, 0, 2), (0,) * 6, (None,) * 6], FLAGS)
    assert H.check_binary(df).first().invalid_rows == 2


def annotators(spark):
    schema = (
        "comment_id long, ord int, text string, hate_speech_score double, "
        + ", ".join(f"{n} int" for n in RATINGS)
        + ", "
        + ", ".join(f"{n} boolean" for n in RAW_TARGETS)
    )
    def row(key, order, text, score, insult, violence, race):
        ratings = [insult, 0, 0, violence, 0, 0, 0]
        return (key, order, text, score, *ratings, race, *([False] * 7))

    rows = [
        row(1, 2, "second", 1.0, 2, 1, False),
        row(1, 1, None, float("nan"), 4, 0, True),
        row(1, 3, "third", 2.0, 3, 2, None),
        row(2, 1, "ok", -2.0, 0, 4, False),
        row(None, 1, "lost", 0.0, 0, 0, False),
    ]
    return spark.createDataFrame(rows, schema)


def test_annotators_become_comments(spark, tmp_path):
    rows = annotators(spark)
    result = H.aggregate_annotators(rows, "ord")
    got = {r.source_id: r for r in result.collect()}
    assert sorted(got) == ["1", "2"]
    assert got["1"].text_raw == "second"
    assert got["1"].m_insult == 3.0 and got["1"].m_violence == 1.0 and got["2"].m_violence == 4.0
    assert got["1"].m_hate_speech_score == 1.5
    assert got["1"].m_n_annotators == 3 and got["1"].t_race is True and got["2"].t_race is False
    kinds = dict(result.dtypes)
    assert (kinds["m_insult"], kinds["m_n_annotators"], kinds["t_race"]) == (
        "float", "bigint", "boolean"
    )
    assert [r.comment_id for r in H.text_conflicts(rows).collect()] == [1]
    check = H.check_conservation(rows, result).first()
    assert (check.comments, check.aggregated_rows, check.difference) == (2, 2, 0)
    stored = load_annotators(spark, lambda: rows, "ord", f"{tmp_path}/scores")
    assert {r.source_id: r.is_short for r in stored.collect()} == {"1": False, "2": True}


def test_file_order_gives_the_first_text(spark, tmp_path):
    storage.write_table(annotators(spark).drop("ord").coalesce(1), f"{tmp_path}/rows")
    scanned = raw.file_order(spark.read.parquet(f"{tmp_path}/rows"))
    assert scanned.groupBy().agg(F.count_distinct("ord")).first()[0] == 5
    assert H.aggregate_annotators(scanned, "ord").filter("source_id = '1'").first().text_raw == "second"


def test_scan_prunes_columns(spark, tmp_path):
    storage.write_table(annotators(spark).withColumn("extra", F.lit(1)), f"{tmp_path}/rows")
    scan = raw.read_annotators(spark, f"{tmp_path}/rows")
    assert scan.columns == list(raw.ANNOTATOR_COLUMNS)
    assert "extra" not in scan._jdf.queryExecution().executedPlan().toString()


def test_union_fills_missing_columns(spark):
    left = spark.createDataFrame([("a", 1)], "uid string, j_toxic byte")
    right = spark.createDataFrame([("b", 2.0)], "uid string, m_insult float")
    rows = {r.uid: r for r in H.combine_sources(left, right).collect()}
    assert rows["a"].m_insult is None and rows["b"].j_toxic is None


def test_hot_comment(spark):
    """A comment with more annotators than a SMALLINT holds."""
    rows = spark.range(40_000).select(
        F.when(F.col("id") < 39_990, 1).otherwise(F.col("id")).alias("comment_id"),
        F.col("id").alias("ord"),
        F.concat(F.lit("text "), F.col("id")).alias("text"),
        F.lit(0.5).alias("hate_speech_score"),
        *[F.lit(1).alias(name) for name in RATINGS],
        *[F.lit(False).alias(name) for name in RAW_TARGETS],
    )
    signals = H.annotator_signals(H.aggregate_annotators(rows, "ord"))
    found = {r.source_id: r for r in signals.collect()}
    assert found["1"].m_n_annotators == 39_990 and found["1"].text_raw == "text 0"
    assert len(found) == 11


def test_line_based_csv(spark, tmp_path):
    """Files without quoted line breaks may be split; the rows are the same."""
    df = spark.createDataFrame(
        [(f"i{i}", f'say "no {i}", twice' if i % 3 else "", *[i % 2] * 6) for i in range(60)],
        f"id string, comment_text string, {FLAGS}",
    )
    raw.write_flag_csv(df, f"{tmp_path}/lines")
    assert not raw.has_quoted_breaks(spark, f"{tmp_path}/lines")
    whole, lines = (
        raw.read_flag_csv(spark, f"{tmp_path}/lines", raw.TRAIN_COLUMNS, multi_line=flag)
        for flag in (True, False)
    )
    assert sorted(whole.collect()) == sorted(lines.collect()) == sorted(df.collect())
    write_files(spark, tmp_path)
    assert raw.has_quoted_breaks(spark, f"{tmp_path}/train")
