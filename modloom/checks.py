"""Turn one-row check tables into errors.

A check operator returns a one-row DataFrame, so it can be joined into a report or run
on its own. ``require`` is the only place where such a row reaches the driver. ``watched`` takes the same counts while a
table is written, so that the table need not be read again for them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation


def need_columns(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise KeyError(f"missing columns {missing}")


def require(check: DataFrame, message: str) -> None:
    """Raise unless every value of the one-row ``check`` table is zero."""
    require_zero(check.first().asDict(), message)


def require_zero(counts: dict[str, int], message: str) -> None:
    broken = {name: value for name, value in counts.items() if value}
    if broken:
        raise ValueError(f"{message}: {broken}")


def watched(df: DataFrame, counts: list[Column]) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """``df``, and what gives its ``counts`` once an action has run over it."""
    seen = Observation()
    return df.observe(seen, *counts), lambda: {name: value or 0 for name, value in seen.get.items()}
