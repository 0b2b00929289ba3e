import json
import os
import shutil
import threading
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from modloom.plans import registry
from modloom.sources import storage


def test_materialize_builds_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return (spark.range(3), spark.range(5))

    paths = (f"{tmp_path}/a", f"{tmp_path}/b")
    for _ in range(2):
        a, b = storage.materialize(spark, paths, build)
        assert (a.count(), b.count()) == (3, 5)
    assert len(calls) == 1
    storage.materialize(spark, paths, build, force=True)
    assert len(calls) == 2
    (tmp_path / "b" / "_SUCCESS").unlink()
    storage.materialize(spark, paths, build)
    assert len(calls) == 3


def test_table_is_zstd_and_whole(spark, tmp_path):
    storage.write_table(spark.range(10), f"{tmp_path}/t")
    names = [p.name for p in (tmp_path / "t").iterdir()]
    assert any(n.endswith(".zstd.parquet") for n in names) and "_SUCCESS" in names
    storage.write_table(spark.range(4), f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4


def test_first_valid_source(spark, tmp_path):
    storage.write_table(spark.range(1).withColumnRenamed("id", "other"), f"{tmp_path}/short")
    storage.write_table(spark.range(2), f"{tmp_path}/good")
    paths = [f"{tmp_path}/{n}" for n in ("absent", "short", "good")]
    path, df = storage.first_valid_source(spark, paths, ["id"])
    assert path.endswith("good") and df.count() == 2
    with pytest.raises(RuntimeError) as error:
        storage.first_valid_source(spark, paths[:2], ["id"])
    assert "absent" in str(error.value) and "lacks ['id']" in str(error.value)


def test_fingerprint_follows_the_files(spark, tmp_path):
    storage.write_table(spark.range(10).coalesce(1), f"{tmp_path}/t")
    one = storage.source_fingerprint(spark, f"{tmp_path}/t").first()
    again = storage.source_fingerprint(spark, f"{tmp_path}/t").first()
    assert one == again and one.files == 1
    other = storage.source_fingerprint(spark, f"{tmp_path}/t", max_length=64).first()
    storage.write_table(spark.range(11).coalesce(1), f"{tmp_path}/t")
    changed = storage.source_fingerprint(spark, f"{tmp_path}/t").first()
    assert len({one.cache_key, other.cache_key, changed.cache_key}) == 3


def test_fingerprint_sees_every_file(spark, tmp_path):
    """Another file of the same size with an older time changes the key."""
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("a", "b"):
        (folder / name).write_bytes(b"12345")
        os.utime(folder / name, (2000, 2000))
    one = storage.source_fingerprint(spark, str(folder)).first()
    os.utime(folder / "a", (1000, 1000))
    other = storage.source_fingerprint(spark, str(folder)).first()
    assert (one.bytes, one.changed_us) == (other.bytes, other.changed_us)
    assert one.cache_key != other.cache_key


def test_content_fingerprint_ignores_order(spark):
    rows = [(i, f"text {i}" if i % 7 else None) for i in range(50)]
    one = spark.createDataFrame(rows, "i long, t string")
    other = spark.createDataFrame(rows[::-1], "i long, t string").repartition(3)
    changed = spark.createDataFrame([*rows[:-1], (49, "other")], "i long, t string")
    keys = [storage.content_fingerprint(df, ["i", "t"]).first() for df in (one, other, changed)]
    assert keys[0] == keys[1] != keys[2]


def here(df):
    """The folder that a scratch table lies in."""
    return Path(urlparse(df.inputFiles()[0]).path).parent


def test_scratch_of_a_plan_is_removed(spark, tmp_path):
    made = []

    def build():
        made.append(here(storage.cut_lineage(spark.range(5), "short-lived")))
        return (spark.read.parquet(str(made[0])),)

    (df,) = storage.materialize(spark, f"{tmp_path}/t", build)
    assert df.count() == 5 and not made[0].exists()


def test_scopes_nest_and_clean_up_after_errors(spark):
    with storage.own_scratch(spark):
        outer = here(storage.cut_lineage(spark.range(3)))
        with pytest.raises(ZeroDivisionError), storage.own_scratch(spark):
            inner = here(storage.cut_lineage(spark.range(4)))
            with storage.outside_scopes():
                free = here(storage.cut_lineage(spark.range(5)))
            1 / 0
        assert outer.exists() and not inner.exists()
    assert not outer.exists() and free.exists()
    assert here(storage.cut_lineage(spark.range(2))).exists()


def test_scopes_of_threads_are_apart(spark):
    opened, made = threading.Event(), threading.Event()
    found = {}

    def other():
        opened.wait(60)
        found["own"] = storage.cut_lineage(spark.range(7))
        with found["scope"].entered():
            found["shared"] = here(storage.cut_lineage(spark.range(8)))
        made.set()

    thread = threading.Thread(target=other)
    thread.start()
    with storage.own_scratch(spark) as found["scope"]:
        opened.set()
        assert made.wait(60)
    thread.join()
    assert found["own"].count() == 7 and not found["shared"].exists()


def test_a_stage_asked_for_inside_materialize_stays(spark, tmp_path):
    """Any query may be the first to ask for a stage, in any order and any share of the queries."""
    build = registry.stage("numbers", lambda spark, folder: spark.range(6))
    key = str(tmp_path)
    storage.materialize(spark, f"{tmp_path}/t", lambda: (build(spark, key),))
    path = Path(urlparse(build(spark, key).inputFiles()[0]).path).parent
    assert build(spark, key).count() == 6
    shutil.rmtree(path)
    assert build(spark, key).count() == 6


def broken(spark):
    return spark.range(4).withColumn("x", F.raise_error(F.lit("no")).cast("long"))


def left(path):
    return sorted(p.name for p in path.iterdir())


def test_a_failed_overwrite_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/t"
    storage.write_table(spark.range(10), path)

    def refuse(rows):
        assert rows.count() == 3
        raise ValueError("not these")

    with pytest.raises(ValueError, match="not these"):
        storage.write_table(spark.range(3), path, accept=refuse)
    with pytest.raises(Exception, match="no"):
        storage.write_table(broken(spark), path)
    assert spark.read.parquet(path).count() == 10 and left(tmp_path) == ["t"]
    storage.write_table(spark.read.parquet(path).filter("id < 4"), path)
    assert spark.read.parquet(path).count() == 4 and left(tmp_path) == ["t"]


def test_a_failed_first_write_leaves_nothing(spark, tmp_path):
    with pytest.raises(Exception, match="no"):
        storage.materialize(spark, f"{tmp_path}/t", lambda: (broken(spark),))
    assert left(tmp_path) == []


def test_a_swap_cut_short_is_made_good(spark, tmp_path):
    path = f"{tmp_path}/t"
    storage.write_table(spark.range(5), path)
    (tmp_path / "t").rename(tmp_path / "_t.old")
    assert storage.is_complete(spark, path) and spark.read.parquet(path).count() == 5
    storage.write_table(spark.range(2), f"{tmp_path}/_t.old")
    storage.write_table(spark.range(6), path)
    assert spark.read.parquet(path).count() == 6 and left(tmp_path) == ["t"]


def test_accept_sees_partitions(spark, tmp_path):
    seen = []
    rows = spark.range(6).withColumn("part", F.col("id") % 2)
    storage.write_table(rows, f"{tmp_path}/t", ("part",), lambda df: seen.append(df.groupBy("part").count().count()))
    assert seen == [2]


def test_report(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0)], "metric string, value double")
    storage.write_report(df, f"{tmp_path}/r")
    (part,) = [p for p in (tmp_path / "r").iterdir() if p.name.endswith(".json")]
    lines = [json.loads(line) for line in part.read_text().splitlines()]
    assert lines == [{"metric": "a", "value": 2.0}, {"metric": "b", "value": 1.0}]


def test_scratch_lies_in_the_shared_folder(spark):
    folder = storage.shared_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    cut = storage.cut_lineage(spark.range(3).withColumn("x", F.col("id") * 2), "t")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Range" not in plan and cut.count() == 3
    assert cut.select("x").schema["x"].dataType.typeName() == "long"
