"""Written tables: scratch space, sinks, load-or-build, fingerprints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="modloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Scratch tables of one piece of work: it owns the paths made through it and no others."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    @contextmanager
    def entered(self) -> Iterator[Scratch]:
        """New scratch tables of this thread belong to this scope; what is there stays."""
        token = _SCOPE.set(self)
        try:
            yield self
        finally:
            _SCOPE.reset(token)

    def clear(self) -> None:
        while self.paths:
            drop_table(self.spark, self.paths.pop())


#: The scope that new scratch tables belong to. A new thread has none, until it enters one.
_SCOPE: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; the current scope, if there is one, removes it."""
    path = f"{shared_folder(spark)}/modloom/{name}-{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.paths.append(path)
    return path


@contextmanager
def own_scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A scope whose scratch tables go at its end, also after an error.

    What reads them must be written by then. Scopes nest: an inner one removes its own tables
    only. Another thread joins in with ``scope.entered()``; otherwise its tables are not touched.
    """
    scope = Scratch(spark)
    try:
        with scope.entered():
            yield scope
    finally:
        scope.clear()


@contextmanager
def outside_scopes() -> Iterator[None]:
    """Scratch tables made inside belong to no scope: they outlive the work that asked for them."""
    token = _SCOPE.set(None)
    try:
        yield
    finally:
        _SCOPE.reset(token)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def drop_table(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def _beside(spark: SparkSession, path: str, what: str) -> str:
    """A hidden sibling of ``path``, in the same file system."""
    _, where = _hadoop(spark, path)
    return f"{where.getParent().toString()}/_{where.getName()}.{what}"


def _move(spark: SparkSession, old: str, new: str) -> None:
    files, where = _hadoop(spark, old)
    if not files.rename(where, _hadoop(spark, new)[1]):
        raise OSError(f"cannot rename {old} to {new}")


def _exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def restore(spark: SparkSession, path: str) -> None:
    """Puts the old table back where a writer died between the two renames of a swap."""
    old = _beside(spark, path, "old")
    if _exists(spark, old):
        if _exists(spark, path):
            drop_table(spark, old)
        else:
            _move(spark, old, path)


def _save(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), **options: str) -> None:
    writer = df.write.option("compression", "zstd").options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


@contextmanager
def replacing(spark: SparkSession, path: str) -> Iterator[str]:
    """A hidden folder beside ``path`` that takes its place by two renames if the block ends well.

    After any error before that the old one is as it was. One writer at a time.
    """
    new, old = _beside(spark, path, f"new-{uuid.uuid4().hex}"), _beside(spark, path, "old")
    restore(spark, path)
    try:
        yield new
        if _exists(spark, path):
            _move(spark, path, old)
        _move(spark, new, path)
    except BaseException:
        restore(spark, path)
        drop_table(spark, new)
        raise
    drop_table(spark, old)


def write_table(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    accept: Callable[[DataFrame], None] | None = None,
) -> None:
    """Replaces the table at ``path`` by ``df``, which may read the old one.

    The rows are written beside it and take its place after the job has committed and
    ``accept``, which gets the written rows, has not raised; else the old table stays.
    """
    with replacing(df.sparkSession, path) as new:
        _save(df, new, partition_by)
        if accept is not None:
            # a glob, as Spark takes no path with a hidden name
            accept(df.sparkSession.read.schema(df.schema).option("basePath", new).parquet(f"{new}/[!_]*"))


def cut_lineage(df: DataFrame, name: str = "cut", **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder, with ``options`` of the writer, and reads it back.

    For tables that feed several branches: lost executors restart from the files, and later
    branches read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _save(df, path, **options)
    return spark.read.schema(df.schema).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """True where a committed table lies at ``path``."""
    restore(spark, path)
    return _exists(spark, f"{path}/_SUCCESS")


class Checked(NamedTuple):
    """Rows that are published only if ``accept`` does not raise on what was written."""

    rows: DataFrame
    accept: Callable[[DataFrame], None] | None = None


def materialize(
    spark: SparkSession,
    paths: str | tuple[str, ...],
    build: Callable[[], tuple[DataFrame | Checked, ...]],
    force: bool = False,
) -> tuple[DataFrame, ...]:
    """The tables at ``paths``; built and written only if one is missing or ``force`` is set."""
    targets = (paths,) if isinstance(paths, str) else tuple(paths)
    if force or not all(is_complete(spark, path) for path in targets):
        with own_scratch(spark):
            for made, path in zip(build(), targets, strict=True):
                checked = made if isinstance(made, Checked) else Checked(made)
                write_table(checked.rows, path, accept=checked.accept)
    return tuple(spark.read.parquet(path) for path in targets)


def source_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modificationTime) per file; the contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )


def source_fingerprint(
    spark: SparkSession, path: str, tokenizer: str = "words", max_length: int = 128
) -> DataFrame:
    """One row: files, bytes, newest change, and the cache key of a token table made from them.

    The key follows from path, length and time of every file, whatever their order.
    """
    changed = F.unix_micros("modificationTime")
    one = F.xxhash64("path", "length", changed).cast("decimal(20,0)")
    totals = source_files(spark, path).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("length").alias("bytes"),
        F.max(changed).alias("changed_us"),
        F.sum(one).cast("string").alias("mixed"),
    )
    payload = F.concat_ws("|", F.lit(tokenizer), F.lit(str(max_length)), "mixed")
    return totals.withColumn("cache_key", F.substring(F.sha2(payload, 256), 1, 16)).drop("mixed")


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of rows and two sums over the digests of all rows, in any order."""
    parts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in columns]
    digest = F.md5(F.concat_ws("|", *parts))

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring("digest", start, 8), 16, 10).cast("long"))

    return df.select(digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("n_rows"), part(1).alias("first_sum"), part(9).alias("second_sum")
    )


def first_valid_source(
    spark: SparkSession, paths: list[str], required: list[str]
) -> tuple[str, DataFrame]:
    """The first readable table with all ``required`` columns; an error lists every reason."""
    problems = []
    for path in paths:
        try:
            df = spark.read.parquet(path)
        except Exception as error:
            problems.append(f"{path}: {type(error).__name__}")
            continue
        missing = [name for name in required if name not in df.columns]
        if not missing:
            return path, df
        problems.append(f"{path}: lacks {missing}")
    raise RuntimeError("no usable source: " + "; ".join(problems))


def write_report(df: DataFrame, path: str) -> None:
    """A small report as JSON lines, sorted and in one file."""
    ordered = df.orderBy(*df.columns[: max(len(df.columns) - 1, 1)])
    ordered.coalesce(1).write.mode("overwrite").json(path)
