"""Exact quantiles with linear interpolation by radix selection: nothing is ever ordered."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.sources.storage import cut_lineage

# Buckets of one range and round. A round brings BUCKETS rows per open range to the driver at most.
BUCKETS = 1024


@dataclass
class Range:
    """The values from ``low`` to ``high`` of one group, both among them, and the ranks inside."""

    group: int
    low: float
    high: float
    before: int
    ranks: list[int]


def clamped(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(-sys.float_info.max)), F.lit(sys.float_info.max))


def magnitude(v: Column) -> Column:
    """A rising function of ``v`` that spreads its exponents evenly: signed, zero at zero."""
    size = F.abs(clamped(v))
    return F.signum(v) * F.when(size > 0, F.log2(size) + 1076).otherwise(0.0)


def bucket_of(v: Column, low: Column, high: Column, by_magnitude: bool) -> Column:
    """The bucket of a value in its range; never falls as the value rises, so ranks add up."""
    scale = magnitude if by_magnitude else lambda x: clamped(x) / 2
    part = (scale(v) - scale(low)) / (scale(high) - scale(low))
    inner = F.least(F.greatest(F.floor(part * BUCKETS).cast("int"), F.lit(0)), F.lit(BUCKETS - 1))
    return F.when(v <= low, 0).when(v >= high, BUCKETS - 1).otherwise(inner)


def narrowed(old: Range, found: list) -> tuple[dict[int, float], list[Range]]:
    """What one round says of a range: values of ranks that are known now, and smaller ranges."""
    known, smaller, before = {}, [], old.before
    for row in found:
        last = before + row.n - 1
        inside = [rank for rank in old.ranks if before <= rank <= last]
        known |= {rank: row.low if rank == before else row.high for rank in inside if rank in (before, last)}
        left = [rank for rank in inside if rank not in known]
        if left and row.low == row.high:
            known |= dict.fromkeys(left, row.low)
        elif left:
            smaller.append(Range(old.group, row.low, row.high, before, left))
        before = last + 1
    return known, smaller


def select_ranks(data: DataFrame, ranges: list[Range]) -> dict[tuple[int, int], float]:
    """(group, rank) -> value, from ``data`` (group, v, n), n being how often a value counts.

    Every round counts the values of each open range by bucket, sums inside the tasks first, and
    goes on with the buckets that hold a wanted rank. The first round parts the exponents, each
    later one takes ten more bits, so seven rounds settle any doubles.
    """
    spark, values = data.sparkSession, {}
    settled = [r for r in ranges if r.low == r.high]
    values |= {(r.group, rank): r.low for r in settled for rank in r.ranks}
    ranges = [r for r in ranges if r.low != r.high]
    schema = "p_group int, open array<struct<id:int,low:double,high:double>>"
    by_magnitude = True
    while ranges:
        by_group: dict[int, list[tuple[int, float, float]]] = {}
        for number, r in enumerate(ranges):
            by_group.setdefault(r.group, []).append((number, r.low, r.high))
        plan = spark.createDataFrame(list(by_group.items()), schema)
        v, own = F.col("v"), F.col("own")
        inside = F.filter("open", lambda r: (v >= r["low"]) & (v <= r["high"]))
        met = data.join(F.broadcast(plan), F.col("group") == F.col("p_group"))
        counted = (
            met.select("v", "n", F.explode(inside).alias("own"))
            .groupBy(own["id"].alias("id"), bucket_of(v, own["low"], own["high"], by_magnitude).alias("bucket"))
            .agg(F.sum("n").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        )
        found: dict[int, list] = {}
        for row in counted.orderBy("id", "bucket").collect():
            found.setdefault(row.id, []).append(row)
        smaller = []
        for number, old in enumerate(ranges):
            known, rest = narrowed(old, found[number])
            values |= {(old.group, rank): value for rank, value in known.items()}
            smaller += rest
        ranges, by_magnitude = smaller, False
    return values


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    few_values: bool = False,
) -> DataFrame:
    """(*by, q, value) per probability; ``by`` must have few distinct values.

    The values are written once, eight bytes a row, and every round reads them in place: no row
    is shuffled and no task gets more than counters. With ``few_values`` (such as lengths) only the
    distinct values are written, with their counts. Nulls and NaN take no part.
    """
    keys = list(by)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v")
    )
    if few_values:
        rows = rows.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    else:
        rows = rows.withColumn("n", F.lit(1).cast("long"))
    rows = cut_lineage(rows, "quantile-values")
    totals = rows.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.min("v").alias("low"), F.max("v").alias("high")
    )
    groups = [row for row in totals.collect() if row.total]
    spots = [{q: q * (row.total - 1) for q in map(float, probabilities)} for row in groups]
    ranges = []
    for i, row in enumerate(groups):
        ranks = sorted({end(spot) for spot in spots[i].values() for end in (math.floor, math.ceil)})
        ranges.append(Range(i, row.low, row.high, 0, ranks))
    if keys:
        named = [(i, *(row[key] for key in keys)) for i, row in enumerate(groups)]
        kinds = [T.StructField(f"g_{key}", rows.schema[key].dataType) for key in keys]
        table = df.sparkSession.createDataFrame(named, T.StructType([T.StructField("group", T.IntegerType()), *kinds]))
        same = [F.col(key).eqNullSafe(F.col(f"g_{key}")) for key in keys]
        data = rows.join(F.broadcast(table), same).select("group", "v", "n")
    else:
        data = rows.select(F.lit(0).alias("group"), "v", "n")
    values = select_ranks(data, ranges)
    result = []
    for i, row in enumerate(groups):
        for q, spot in spots[i].items():
            low, high = values[i, math.floor(spot)], values[i, math.ceil(spot)]
            between = low if low == high else low + (high - low) * (spot - math.floor(spot))
            result.append((*(row[key] for key in keys), q, between))
    fields = [rows.schema[key] for key in keys]
    added = T.StructType.fromDDL("q double, value double").fields
    return df.sparkSession.createDataFrame(result, T.StructType([*fields, *added]))
