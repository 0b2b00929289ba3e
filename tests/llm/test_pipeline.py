"""Every stage on one small corpus, and the registered queries against their SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from oracle import compare, connect
from modloom.llm import queries, simhash

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory, spark):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 1
        text = rng.choices(words, k=60) + (["villain"] * 2 if toxic else [])
        if i % 50 == 7:
            text += ["token = 0123456789abcdef0123456789abcdef"]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0, "more"))
        labels.append((i, int(toxic)))
    for i in range(400, 440):
        rows.append((i, rows[(i - 400) * 8][1] + " end", "en", "s0", 0, None))
    rows += [(440, None, None, None, None, None), (441, "", "en", "s1", 0, ""), (None, "no id", "en", "s1", 0, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.tables.cut_lineage(stage(spark, docs, corpus), "test-stage")
        steps[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    left = steps["toxicity"]
    assert left.filter("text LIKE '%villain%'").count() == 0 and left.filter("text NOT LIKE '%villain%' OR text IS NULL").count() == left.count()
    assert left.count() == 443 - 50
    once = steps["simhash near-dedup"]
    classes = simhash.near_duplicates(left).select("component_id").distinct().count()
    assert once.count() == classes < left.count()
    clean = steps["secret scans"]
    assert clean.count() == once.count() and clean.filter("text LIKE '%0123456789abcdef%'").count() == 0
    mixed = steps["source mix"]
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    packed = steps["best-fit packing"]
    assert packed.filter("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0


def test_run(spark, corpus):
    assert corpus_pipeline.run(spark, corpus).count() > 0


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_oracle(spark, name):
    assert compare(queries.queries()[name](spark, FOLDER), connect(FOLDER), queries.oracle_sql()[name]) is None


def test_entry_registers_all():
    names = entry_points.queries()
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert set(queries.oracle_sql()) <= set(entry_points.oracle_sql())
