"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a fixed shuffled order. A copy of a document finishes at its
source's words up to it, divided by the source's target. All copies, those of a second round
after the first, are ranged by that virtual finish time and taken until the budget is reached.

Only a narrow table (source, order key, size) is shuffled; the texts meet the decision as two
cut-off keys per source. A hot source is spread over slices of its order.

Defined results: a null text has no words; a null source is a source of its own and the last;
rows equal in id and text share a place in the order and are taken together; empty documents
finish with the document before them. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modloom.llm.tables import cut_lineage, text_of

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Budget over all sizes, and the most rounds of one source.
BUDGET_NUMERATOR, BUDGET_DENOMINATOR = 3, 2
ROUNDS = 2
#: Hex digits of the key that name a slice of a source, and slices of a virtual time unit.
SLICE_DIGITS = 3
TIME_SLICES = 1 << 16


def words(text: str = "text") -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def order_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The shuffled order: a digest of id and text."""
    return F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), text_of(text)))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", order_key().alias("key"), words().alias("size"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, total, target) with targets filled up to ``ROUNDS`` times the size.

    In the order of size per weight the capped sources come first; the level of the others is
    the budget left over the weight left. All sums are whole numbers.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1
    )
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    table = table.withColumn("weight", weight.cast("long"))
    # The cap over the weight, without a fraction: sizes times a common multiple of the weights.
    ratio = F.expr("source_size * 6 div weight")
    order = Window.orderBy(ratio.asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    n, d = BUDGET_NUMERATOR, BUDGET_DENOMINATOR
    table = (
        table.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn(
            "open",
            F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        )
        # budget left times d, with all earlier sources at their cap
        .withColumn("left", F.col("total") * n - F.col("capped") * (ROUNDS * d))
    )
    fits = F.col("left") * F.col("weight") <= F.col("source_size") * F.col("open") * (ROUNDS * d)
    first_open = F.min(F.when(fits, F.struct("capped", "left", "open"))).over(everything)
    level = F.col("level")
    shared = (level["left"] * F.col("weight")).cast("double") / (level["open"] * d).cast("double")
    cap = (F.col("source_size") * ROUNDS).cast("double")
    return table.withColumn("level", first_open).select(
        "source",
        "source_size",
        "total",
        F.when(F.col("capped") < level["capped"], cap)
        .otherwise(F.least(shared, cap))
        .alias("target"),
    )


def _slice(key: str = "key") -> Column:
    return F.substring(key, 1, SLICE_DIGITS)


def finish_times(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, key, size, copy, finish): every copy's virtual finish time.

    Sums inside a source are slice offsets plus sums inside the slice, so no window holds more
    than 1/4096 of a source.
    """
    pieces = sizes.withColumn("slice", _slice())
    offsets = pieces.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    offsets = offsets.withColumnsRenamed({"source": "o_source", "slice": "o_slice"}).drop("words")
    inside = Window.partitionBy("source", "slice").orderBy("key")
    placed = pieces.join(
        offsets,
        F.col("source").eqNullSafe(F.col("o_source")) & (F.col("slice") == F.col("o_slice")),
    ).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    named = targets.withColumnRenamed("source", "t_source")
    copies = F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1)))
    words_upto = F.col("upto") + F.col("copy") * F.col("source_size")
    finish = F.when(F.col("target") > 0, words_upto / F.col("target")).otherwise(F.lit(0.0))
    return (
        placed.join(named, F.col("source").eqNullSafe(F.col("t_source")))
        .select("source", "key", "size", "upto", "source_size", "target", "total", copies.alias("copy"))
        .select("source", "key", "size", "copy", "total", finish.alias("finish"))
    )


def cutoffs(times: DataFrame) -> DataFrame:
    """(source, key_1, key_2): the last key that the mix takes in each round; null if none.

    The budget falls into one slice of the virtual time; only that slice is put in order.
    """
    # All that finishes after two time units shares a slice: the budget ends close to one.
    at = F.floor(F.least(F.col("finish"), F.lit(2.0)) * TIME_SLICES)
    sliced = cut_lineage(times.withColumn("at", at), "mix-times")
    n, d = BUDGET_NUMERATOR, BUDGET_DENOMINATOR
    per_slice = sliced.groupBy("at").agg(F.sum("size").alias("words"), F.max("total").alias("total"))
    upto = F.sum("words").over(Window.orderBy("at"))
    edge = (
        per_slice.select("at", "total", (upto - F.col("words")).alias("before"), upto.alias("upto"))
        .filter(F.col("upto") * d > F.col("total") * n)
        .agg(F.min("at").alias("at"), F.min("before").alias("before"))
        .first()
    )
    running = F.sum("size").over(
        Window.partitionBy("at").orderBy("finish", "copy", F.col("source").asc_nulls_last(), "key")
    )
    if edge["at"] is None:
        inside, on_edge = sliced, sliced.filter(F.lit(False))
    else:
        inside = sliced.filter(F.col("at") < edge["at"])
        on_edge = (
            sliced.filter(F.col("at") == edge["at"])
            .withColumn("running", running + F.lit(edge["before"]))
            .filter(F.col("running") * d <= F.col("total") * n)
        )
    taken = inside.select("source", "key", "copy").unionByName(on_edge.select("source", "key", "copy"))
    return taken.groupBy("source").agg(
        *(F.max(F.when(F.col("copy") == i, F.col("key"))).alias(f"key_{i + 1}") for i in range(ROUNDS))
    )


def plan(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, key_1, key_2), one row per source. ``sizes`` as ``sized``."""
    targets = cut_lineage(source_targets(sizes), "mix-targets")
    last = cutoffs(finish_times(sizes, targets)).withColumnRenamed("source", "c_source")
    joined = targets.join(last, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return cut_lineage(joined.drop("c_source", "total"), "mix-plan")


def with_copies(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """``rows`` (with source and key) and its source's plan, with ``copies``, 0 to ``ROUNDS``."""
    named = mix.withColumnRenamed("source", "p_source")
    copies = sum(
        F.coalesce((F.col("key") <= F.col(f"key_{i + 1}")).cast("int"), F.lit(0))
        for i in range(ROUNDS)
    )
    joined = rows.join(named, F.col("source").eqNullSafe(F.col("p_source")))
    return joined.withColumn("copies", copies).drop(
        "p_source", *(f"key_{i + 1}" for i in range(ROUNDS))
    )


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, a row for each copy; columns stay."""
    names = docs.columns
    plan_table = plan(cut_lineage(sized(docs), "mix-sizes"))
    bare = plan_table.select("source", "key_1", "key_2")
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), "source", order_key().alias("key")
    )
    return (
        with_copies(keyed, bare)
        .filter("copies > 0")
        .select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
        .select(*(F.col("doc")[c].alias(c) for c in names))
    )


def mix_report(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every document."""
    sizes = cut_lineage(sized(docs), "mix-sizes")
    return with_copies(sizes, plan(sizes)).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), names AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([3, 1, 2])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w
  FROM names
), ordered AS (
  SELECT *, sum(s) OVER ()::BIGINT AS total,
    coalesce(sum(s) OVER before, 0)::BIGINT AS capped,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::BIGINT AS open
  FROM weighted
  WINDOW before AS (ORDER BY s * 6 // w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT capped AS c, total * 3 - capped * 4 AS l, open AS o FROM ordered
  WHERE (total * 3 - capped * 4) * w <= s * open * 4 ORDER BY 1, 2, 3 LIMIT 1
), targets AS (
  SELECT source, s, total, CASE WHEN capped < c THEN (s * 2)::DOUBLE
    ELSE least((l * w)::DOUBLE / (o * 2)::DOUBLE, (s * 2)::DOUBLE) END AS target
  FROM ordered, level
), upto AS (
  SELECT d.*, t.s, t.total, t.target,
    sum(size) OVER (PARTITION BY d.source ORDER BY key)::BIGINT AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT doc_id, source, key, size, total, c.copy,
    CASE WHEN target > 0 THEN (upto + c.copy * s)::DOUBLE / target ELSE 0 END AS finish
  FROM upto, (SELECT unnest([0, 1]) AS copy) c
), running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, copy, source NULLS LAST, key)::BIGINT AS r FROM copies
), taken AS (
  SELECT source, key, count(DISTINCT copy) FILTER (r * 2 <= total * 3) AS n
  FROM running GROUP BY source, key
)
SELECT u.doc_id, u.size, u.s AS source_size, u.target, (u.size * t.n)::BIGINT AS taken
FROM upto u JOIN taken t ON u.source IS NOT DISTINCT FROM t.source AND u.key = t.key
"""
