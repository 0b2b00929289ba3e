"""CSV with quoted line breaks in splits, against a scan of the whole file and Python's reader."""

import csv
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from modloom.sources import csv_records, raw

HEADER = list(raw.TRAIN_COLUMNS)


def texts(count, seed=9):
    rng = random.Random(seed)
    parts = ["plain", "NA", '"', '""', "\n", "\n\n", ",", " ", "é日", '"\n"', "\r\n", "''", "7"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(count)]


def write(path, rows, end="\n", last=True, header=HEADER):
    with open(path, "w", encoding="utf-8", newline="") as file:
        writer = csv.writer(file, lineterminator=end)
        writer.writerow(header)
        writer.writerows(rows)
    if not last:
        path.write_bytes(path.read_bytes().removesuffix(end.encode()))


def rows_of(values, first=0):
    return [(f"id{first + i}", text, *(((first + i) >> k) % 2 for k in range(6))) for i, text in enumerate(values)]


@contextmanager
def split_size(spark, size):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    for name, value in zip(names, (str(size), "1", "1"), strict=True):
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in names:
            spark.conf.unset(name)


def found(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("size", [40, 300, 3000, 1 << 20])
def test_splits_give_the_rows_of_one_task(spark, tmp_path, size):
    rows = rows_of(texts(150))
    write(tmp_path / "a.csv", rows)
    write(tmp_path / "b.csv", rows_of(texts(80, 2), 1000), last=False)
    whole = found(raw.read_flag_csv(spark, str(tmp_path), HEADER, multi_line=True))
    expected = sorted([*rows, *rows_of(texts(80, 2), 1000)])
    assert whole == expected
    with split_size(spark, size):
        assert found(raw.read_flag_csv(spark, str(tmp_path), HEADER)) == expected
        splits = csv_records.lines(spark, str(tmp_path)).select("file", "start").distinct().count()
    assert splits >= 4 or size > 3000


def test_a_record_over_many_splits(spark, tmp_path):
    long = '"quoted",\n' * 400 + "\n" * 50
    rows = [("1", "x", *[0] * 6), ("2", long, *[1] * 6), ("3", "NA", *[0] * 6), ("4", long, *[0] * 6)]
    write(tmp_path / "a.csv", rows)
    with split_size(spark, 100):
        pieces = csv_records.pieces(csv_records.lines(spark, str(tmp_path)), HEADER)
        assert pieces.filter("kind = 1").count() > 20
        assert found(raw.read_flag_csv(spark, str(tmp_path), HEADER)) == sorted(rows)


def test_line_ends_and_empty_lines(spark, tmp_path):
    rows = rows_of(["a\r\nb", "", "NA", "c\n"])
    write(tmp_path / "a.csv", rows, end="\r\n")
    with open(tmp_path / "a.csv", "ab") as file:
        file.write(b"\r\n\n")
    for size in (30, 4000):
        with split_size(spark, size):
            assert found(raw.read_flag_csv(spark, str(tmp_path), HEADER)) == sorted(rows)


def test_wanted_columns_and_other_orders(spark, tmp_path):
    header = ["more", *reversed(HEADER)]
    write(tmp_path / "a.csv", [("m\n", *reversed(row)) for row in rows_of(["x\ny", "z"])], header=header)
    df = raw.read_flag_csv(spark, str(tmp_path), ["id", "comment_text", "toxic"])
    assert found(df) == [("id0", "x\ny", 0), ("id1", "z", 1)]
    assert dict(df.dtypes)["toxic"] == "tinyint"


def test_bad_files_are_refused(spark, tmp_path):
    write(tmp_path / "a.csv", rows_of(["x\ny"]))
    write(tmp_path / "b.csv", rows_of(["z\n"]), header=[*HEADER[:-1], "other"])
    with pytest.raises(Exception, match="has the columns|header"):
        raw.read_flag_csv(spark, str(tmp_path), HEADER).collect()
    (tmp_path / "b.csv").write_text(",".join(HEADER) + '\n1,"x\ny",0,0,0,0,0,none\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        raw.read_flag_csv(spark, str(tmp_path), HEADER).collect()


def test_header_only(spark, tmp_path):
    write(tmp_path / "a.csv", [])
    assert raw.read_flag_csv(spark, str(tmp_path), HEADER).count() == 0
    write(tmp_path / "b.csv", rows_of(["x\ny"]))
    assert raw.read_flag_csv(spark, str(tmp_path), HEADER).agg(F.max("comment_text")).first()[0] == "x\ny"
