import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from modloom.domains import TARGET_NAMES, UNIFIED_SCHEMA
from modloom.operators.tokens import target_prepare
from modloom.plans import build, registry
from modloom.rules import LevelRule, SeverityRules

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unified(spark, tmp_path_factory):
    flags = registry.stored_flags(spark, FOLDER)
    scores = registry.stored_scores(spark, FOLDER)
    return build.build_unified(flags, scores, str(tmp_path_factory.mktemp("u") / "unified"))


def test_unified_keeps_every_row(spark, unified):
    flags = registry.stored_flags(spark, FOLDER)
    scores = registry.stored_scores(spark, FOLDER)
    assert unified.columns == UNIFIED_SCHEMA.names
    assert unified.count() == flags.count() + scores.count()
    per_source = unified.groupBy("source").agg(
        F.count("j_toxic").alias("j"), F.count("m_insult").alias("m"), F.count(F.lit(1)).alias("n")
    )
    assert {r.source: (r.j == r.n, r.m == r.n) for r in per_source.collect()} == {
        "jigsaw": (True, False), "mhs": (False, True)
    }


def test_sample_is_drawn_after_the_split(spark, unified, tmp_path):
    flags = registry.stored_flags(spark, FOLDER)
    scores = registry.stored_scores(spark, FOLDER)
    part = build.build_unified(flags, scores, f"{tmp_path}/part", sample=50)
    assert part.count() == 50 and part.exceptAll(unified).isEmpty()


def test_score_analysis(spark, unified):
    def load_model():
        def model(batch):
            n = len(batch)
            widths = {"class_logits": 4, "severity_logits": 4, "target_logits": 8}
            size = batch["text"].str.len().to_numpy()
            return pd.DataFrame(
                {name: list(np.tile(size[:, None] % 7 / 7, (1, k)).astype("float32")) for name, k in widths.items()},
                index=range(n),
            )

        return model

    rows = target_prepare(build.build_graded(unified))
    val = rows.filter("split = 'val' AND severity <> -100").count()
    reports = build.analyze_scores(rows, load_model, n=40)
    counted = reports["report"].filter("level = 'accuracy'").first().support
    assert counted == min(40, val)
    assert reports["confusion"].count() == 4
    assert set(reports["distance"].columns) == {"kind", "n", "share"}
    table = build.tune_thresholds(rows, load_model)
    assert table.count() == 8 and {r.target for r in table.collect()} == set(TARGET_NAMES)


def test_graded(unified, tmp_path):
    graded = build.build_graded(unified, f"{tmp_path}/graded")
    assert graded.count() == unified.count()
    # with no threshold at all, every annotated row is low
    rare = SeverityRules(critical=LevelRule(), high=LevelRule(), medium=LevelRule())
    with pytest.raises(ValueError, match="low_share"):
        build.build_graded(unified, rules=rare)


def test_broken_table_is_refused(unified):
    with pytest.raises(ValueError, match="repeated_uid_rows"):
        build.check_unified(unified.unionByName(unified))
    leaky = unified.withColumn("text_hash", F.lit("same"))
    with pytest.raises(ValueError, match="split"):
        build.check_unified(leaky)


def test_a_breach_publishes_nothing(spark, unified, tmp_path):
    """The table that was there stays, whichever check fails, and no folder is left behind."""
    path = f"{tmp_path}/unified"
    flags = registry.stored_flags(spark, FOLDER).limit(40)
    scores = registry.stored_scores(spark, FOLDER).limit(40)
    kept = build.build_unified(flags, scores, path).count()
    with pytest.raises(ValueError, match="repeated_uid_rows"):
        build.build_unified(flags.unionByName(flags), scores, path)
    with pytest.raises(ValueError, match="null_text"):
        build.build_unified(flags.withColumn("text", F.lit(None).cast("string")), scores, path)
    rare = SeverityRules(critical=LevelRule(), high=LevelRule(), medium=LevelRule())
    with pytest.raises(ValueError, match="low_share"):
        build.build_graded(unified, path, rules=rare)
    assert spark.read.parquet(path).count() == kept and len(list(tmp_path.iterdir())) == 1


def test_nulls_are_counted_without_reading_again(spark, tmp_path, monkeypatch):
    """The written table is read for its keys alone."""
    read = []
    plain = build.repeated_uids
    monkeypatch.setattr(build, "repeated_uids", lambda df: read.append(plain(df)) or read[-1])
    flags = registry.stored_flags(spark, FOLDER).limit(40)
    build.build_unified(flags, registry.stored_scores(spark, FOLDER).limit(40), f"{tmp_path}/u")
    plan = read[0]._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<uid:string>" in plan


def test_an_empty_table_passes(spark, tmp_path):
    flags, scores = (load(spark, FOLDER).limit(0) for load in (registry.stored_flags, registry.stored_scores))
    assert build.build_unified(flags, scores, f"{tmp_path}/u").count() == 0


def test_severity_needs_no_second_copy_of_the_texts(spark, monkeypatch):
    """Graded rows are read from the unified table, and their readers see no text."""
    columns = ", ".join(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}" for f in UNIFIED_SCHEMA.fields)
    empty = spark.sql(f"SELECT {columns}").filter("uid IS NOT NULL")
    monkeypatch.setattr(registry, "unified", lambda spark, folder: empty)
    monkeypatch.setattr(registry.storage, "write_table", None)
    assert "severity_name" in registry.stored_graded(spark, "nowhere").columns
