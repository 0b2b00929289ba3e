"""Column helpers over one row: bound values, running totals and maxima, spans of a pattern.

Everything stays inside the JVM and inside the row, so no operator built on it shuffles. Prefix
values are taken over blocks of about the square root of the array's size, which keeps a
document with 100,000 matches at some 30 million steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda inside uses it."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only; lengths and all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def _prefix(values: Column, start: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element, ``merge`` over all elements before it."""

    def over(values: Column, size: Column) -> Column:
        def total(part: Column) -> Column:
            return F.aggregate(part, start, merge)

        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")),
            lambda b: total(F.slice(values, b * size + 1, size)),
        )

        def at(i: Column, blocks: Column) -> Column:
            block = F.floor(i / size).cast("int")
            return merge(
                total(F.slice(blocks, F.lit(1), block)),
                total(F.slice(values, block * size + 1, i - block * size)),
            )

        return let(blocks, lambda blocks: F.transform(values, lambda v, i: at(i, blocks)))

    return let(
        values,
        lambda values: F.when(F.size(values) == 0, F.slice(values, 1, 0)).otherwise(
            let(size_of(values), lambda size: over(values, size))
        ),
    )


def size_of(values: Column) -> Column:
    """Block size for an array: about the square root of its size, 1 at least."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(values))).cast("int"))


def totals_before(values: Column) -> Column:
    """For each whole number, the sum of those before it."""
    return _prefix(values, F.lit(0), lambda a, b: a + b)


def largest_before(values: Column) -> Column:
    """For each whole number, the largest before it; -1 for the first. Values are 0 or more."""
    return _prefix(values, F.lit(-1), lambda a, b: F.greatest(a, b))


def spans(text: Column, pattern: Column | str, group: int | None = None) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,inner>>, in code points.

    ``inner`` is the length of ``group``, or of the match. The pattern must not match empty
    text. Starts follow from the lengths of the pieces between the matches.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern

    def of(text: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        found = F.transform(F.regexp_extract_all(text, pattern, 0), F.length)
        if group is None:
            inner = found
        else:
            inner = F.transform(F.regexp_extract_all(text, pattern, group), F.length)
        return let(F.struct(gaps.alias("gap"), found.alias("len"), inner.alias("inner")), place)

    def place(parts: Column) -> Column:
        gaps, found, inner = parts["gap"], parts["len"], parts["inner"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: g + m)
        return let(
            totals_before(steps),
            lambda before: F.transform(
                found,
                lambda m, i: F.struct(
                    (before[i] + gaps[i]).alias("start"),
                    (before[i] + gaps[i] + m).alias("end"),
                    inner[i].alias("inner"),
                ),
            ),
        )

    return let(text, of)
