from modloom.domains import FLAG_LABELS
from modloom.sources import storage
from modloom.streaming.live import moderate_flags, write_stream

SCHEMA = "id string, comment_text string, " + ", ".join(f"{n} byte" for n in FLAG_LABELS)


def rows(spark, first, n):
    data = [
        (f"d{i}", f"see www.a{i}.com &amp; Ｆ{'o' * 9}", *[(i >> k) & 1 for k in range(6)])
        for i in range(first, first + n)
    ]
    return spark.createDataFrame(data, SCHEMA)


def test_stream_equals_batch_and_appends_once(spark, tmp_path):
    source, out, marks = (f"{tmp_path}/{n}" for n in ("in", "out", "marks"))

    def drain():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{source}/*")
        query = write_stream(moderate_flags(stream, "jigsaw_train"), out, marks)
        query.awaitTermination(120)
        assert query.exception() is None

    storage.write_table(rows(spark, 0, 40), f"{source}/a")
    drain()
    assert spark.read.parquet(out).count() == 40
    storage.write_table(rows(spark, 40, 30), f"{source}/b")
    drain()
    drain()
    streamed = spark.read.parquet(out)
    batch = moderate_flags(rows(spark, 0, 70), "jigsaw_train")
    assert streamed.count() == 70
    assert streamed.exceptAll(batch).isEmpty()
    assert streamed.filter("uid is null or severity is null").isEmpty()
    assert streamed.first().text.startswith("see <url> & Fooo")
