"""Seeded hash keys: the engine's only source of order and chance.

A key depends on the seed and the row id alone, so every sample, shuffle and fold is the same
on any cluster size and after any lost executor.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: int | Column, row_id: Column) -> Column:
    seed_column = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.sha1(F.concat_ws("|", seed_column.cast("string"), row_id.cast("string")))


def hash_number(key: Column) -> Column:
    """The first 32 bits of a hex digest as a number."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long")


_DIGEST, _OTHER = bytearray(b"\x01"), bytearray(b"\x00")


def packed(key: Column) -> Column:
    """``key`` as bytes, for a shuffle: a hex digest takes half its length, any other string its own.

    A leading byte tells which, so no two keys are packed alike.
    """
    digest = key.rlike(r"^[0-9a-f]+\z") & (F.octet_length(key) % 2 == 0)
    return F.when(digest, F.concat(F.lit(_DIGEST), F.unhex(key))).otherwise(
        F.concat(F.lit(_OTHER), key.cast("binary"))
    )


def unpacked(key: Column) -> Column:
    """The string that ``packed`` took."""
    rest = F.substring(key, 2, 2**31 - 1)
    return F.when(F.substring(key, 1, 1) == F.lit(_DIGEST), F.lower(F.hex(rest))).otherwise(rest.cast("string"))
