"""Fill-in-the-middle rearrangement with memoised content-defined chunks.

A unit is a run of ASCII letters or any other code point. A rolling hash over ``WINDOW`` code
points cuts a text into chunks that depend on their content alone, so passages that documents
share give equal chunks. A chunk's boundary summary (its units, and whether it starts and ends
with a letter) is worked out once and kept under the chunk's whole content, which a look-up
compares; a task keeps at most ``2 * KEPT`` of them. Units of a text are the sum over its chunks,
less one for every letter run that crosses a border, and running sums say which chunk holds a cut:
only that one is scanned. One pass over the rows, nothing is shuffled.

Defined results: a null or empty text has no units and stays plain, like a text that holds a mark;
a null id draws as the empty text; repeated rows each appear, with the same draw; very long texts
are hashed in blocks; an empty table gives no rows; other columns of the input take no part.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.llm.tables import text_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rearranged are draws below PLAIN_FROM of 100, of them suffix first those below SUFFIX_FIRST.
PLAIN_FROM, SUFFIX_FIRST = 90, 20
SEED = 1

UNITS = re.compile("[A-Za-z]+|[^A-Za-z]")

WINDOW = 32
#: A border falls where this many leading bits of the rolling hash are zero.
ZERO_BITS = 9
#: Code points of a chunk.
LEAST, MOST = 128, 4096
#: Code points that are hashed at a time.
BLOCK = 1 << 16
#: Summaries in a generation of the cache.
KEPT = 4096
#: Characters of output in one Arrow batch.
BATCH = 1 << 23


# --- chunks -------------------------------------------------------------------------------


def rolling(points: np.ndarray) -> np.ndarray:
    """For each code point, a hash of it and the WINDOW - 1 before it."""
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    width = 1
    while width < WINDOW:
        # a window of twice the width: the near half and, shifted, the far one
        far = mixed[:-width] << np.uint64(width)
        mixed[width:] += far
        width *= 2
    return mixed


def borders(text: str) -> Iterator[int]:
    """Places after which the rolling hash allows a cut, in order."""
    for at in range(0, len(text), BLOCK):
        low = max(0, at - WINDOW + 1)
        raw = text[low : at + BLOCK].encode("utf-32-le", "surrogatepass")
        found = np.flatnonzero(rolling(np.frombuffer(raw, "<u4")) >> np.uint64(64 - ZERO_BITS) == 0)
        yield from (found[found >= at - low] + (low + 1)).tolist()


def chunks(text: str) -> Iterator[str]:
    """``text`` in pieces of at most MOST code points; all but the last have LEAST at least."""
    start = 0
    for stop in chain(borders(text), [len(text)]):
        while stop - start > MOST:
            yield text[start : start + MOST]
            start += MOST
        if stop - start >= LEAST or start < stop == len(text):
            yield text[start:stop]
            start = stop


class Summary(NamedTuple):
    units: int
    starts: bool
    ends: bool


def is_letter(point: str) -> bool:
    return point.isascii() and point.isalpha()


def summarize(chunk: str) -> Summary:
    return Summary(len(UNITS.findall(chunk)), is_letter(chunk[0]), is_letter(chunk[-1]))


class Summaries:
    """Summaries under the content of their chunk; the older half goes when there are too many."""

    def __init__(self, kept: int = KEPT):
        self.kept, self.young, self.old = kept, {}, {}

    def __call__(self, chunk: str) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or summarize(chunk)
            if len(self.young) >= self.kept:
                self.old, self.young = self.young, {}
            self.young[chunk] = found
        return found


class Units:
    """The units of one text, counted over its chunks."""

    def __init__(self, text: str, summary_of: Callable[[str], Summary]):
        self.chunks = list(chunks(text))
        self.starts = [0, *accumulate(map(len, self.chunks))]
        #: Units that have begun by the end of each chunk, and the number of each chunk's first.
        self.begun, self.first = [], []
        total, inside = 0, False
        for chunk in self.chunks:
            found = summary_of(chunk)
            crossing = inside and found.starts
            self.first.append(total - crossing)
            total += found.units - crossing
            self.begun.append(total)
            inside = found.ends
        self.total = total

    def place(self, number: int) -> int:
        """Where unit ``number`` starts, in code points; the end of the text for the total."""
        if number == self.total:
            return self.starts[-1]
        at = bisect_right(self.begun, number)
        own = islice(UNITS.finditer(self.chunks[at]), number - self.first[at], None)
        return self.starts[at] + next(own).start()


# --- the transformation -------------------------------------------------------------------


class Arranged(NamedTuple):
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def arrange(text: str, draws: list[int], summary_of: Callable[[str], Summary]) -> Arranged:
    units = Units(text, summary_of)
    marked = any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE))
    if not text or marked or draws[2] % 100 >= PLAIN_FROM:
        return Arranged(units.total, "plain", None, None, text)
    low, high = sorted(units.place(draw % (units.total + 1)) for draw in draws[:2])
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if draws[3] % 100 < SUFFIX_FIRST:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return Arranged(units.total, form, len(prefix), len(middle), output)


def draw_of(key: Column, seed: int = SEED) -> Column:
    """64 hex digits drawn for a row by its key."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)


ADDED = "n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, id_column: str = "doc_id", seed: int = SEED) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row; output is the rearranged text."""
    rows = docs.select(
        F.col(f"`{id_column}`"),
        draw_of(F.col(f"`{id_column}`"), seed).alias("fim_draw"),
        text_of().alias("fim_text"),
    )
    schema = T.StructType([rows.schema[id_column], *T.StructType.fromDDL(ADDED).fields])
    arrow = pa.schema(
        [(name, pa.int64()) if name[-1] != "m" and name != "output" else (name, pa.string()) for name in schema.names[1:]]
    )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary_of = Summaries()

        def full(batch: pa.RecordBatch, first: int, found: list[Arranged]) -> pa.RecordBatch:
            own = batch.column(0).slice(first, len(found))
            made = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), arrow.types, strict=True)]
            return pa.record_batch([own, *made], names=[id_column, *arrow.names])

        for batch in batches:
            first, found, size = 0, [], 0
            for draw, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                draws = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
                found.append(arrange(text.as_py(), draws, summary_of))
                size += len(found[-1].output)
                if size > BATCH:
                    yield full(batch, first, found)
                    first, found, size = first + len(found), [], 0
            if found:
                yield full(batch, first, found)

    return rows.mapInArrow(make, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of; marks stand in it only where the operator put them."""
    part = [F.get(F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1), F.lit(i)) for i in range(4)]
    return (
        F.when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
        .otherwise(output)
    )


def middle_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    output, form = F.col("output"), F.col("form")
    return fill_in_middle(docs).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, form), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
d AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
      THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:lo], '') AS a, array_to_string(u[lo + 1:hi], '') AS m,
    array_to_string(u[hi + 1:], '') AS s
  FROM f)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || a || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
