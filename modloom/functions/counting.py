"""Conditional counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_where(condition: Column | str) -> Column:
    """Rows for which ``condition`` is true.

    ``count_if`` plans a helper column with a fresh name each time, which keeps Spark from
    reusing the shuffle of an equal aggregate elsewhere in the plan.
    """
    test = F.col(condition) if isinstance(condition, str) else condition
    return F.count(F.when(test, F.lit(1)))
