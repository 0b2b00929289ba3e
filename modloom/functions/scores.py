"""Math on short score vectors: arg-max, sigmoid, soft-max, pooling, linear maps.

Vectors of a known small width are unrolled into plain expressions, which stay inside
whole-stage code generation; higher-order functions do not. The latter serve long vectors.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def elements(values: Column, width: int) -> list[Column]:
    return [values[i].cast("double") for i in range(width)]


def total(parts: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x + y, parts)


def argmax(values: Column) -> Column:
    """Position of the first maximum, counted from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def sigmoid(value: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-value))


def log_sum_exp(values: Column, width: int) -> Column:
    parts = elements(values, width)
    top = F.greatest(*parts)
    return top + F.log(total([F.exp(part - top) for part in parts]))


def expected_level(logits: Column, width: int = 4) -> Column:
    """Mean position under the soft-max of ``logits``."""
    parts = elements(logits, width)
    top = F.greatest(*parts)
    weights = [F.exp(part - top) for part in parts]
    return total([weight * float(i) for i, weight in enumerate(weights)]) / total(weights)


def bce_with_logits(logit: Column, target: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that cannot overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, value: acc + value)


def dot(left: Column, right: Column) -> Column:
    return array_sum(F.zip_with(left, right, lambda x, y: x * y))


def linear_scores(
    features: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]
) -> Column:
    """``W x + b`` with one output per row of ``weights``."""
    x = features.cast("array<double>")
    rows = [
        dot(x, F.array(*[F.lit(float(w)) for w in row])) + F.lit(float(b))
        for row, b in zip(weights, bias, strict=True)
    ]
    return F.array(*rows)


def masked_mean(vectors: Column, mask: Column, width: int) -> Column:
    """Mean of the vectors whose mask is 1; zeros where the mask is empty."""
    kept = F.zip_with(
        vectors, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m.cast("double"))
    )
    zeros = F.array_repeat(F.lit(0.0), width)
    summed = F.aggregate(kept, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    count = F.greatest(array_sum(mask.cast("array<double>")), F.lit(1e-9))
    return F.transform(summed, lambda value: value / count)


def round_up(value: Column, multiple: int) -> Column:
    return (F.ceil(value / F.lit(multiple)) * multiple).cast("int")


def pad(values: Column, size: Column, filler: int) -> Column:
    return F.concat(values, F.array_repeat(F.lit(filler), (size - F.size(values)).cast("int")))
