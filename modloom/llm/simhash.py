"""SimHash near-dedup with bit-sliced comparison.

Fingerprints are made per text in Arrow batches. Equal ones collapse first, so a group of copies
is one node. Two fingerprints within ``RADIUS`` = 4 bits agree in at least two of six blocks, so
the pairs of blocks are the 15 keys under which candidates meet; that loses no pair.

A set of candidates is compared bit-sliced: bit planes stand vertically, 64 fingerprints to a
word; carry-save counters add the differing planes for many pairs at once, and a word is
abandoned once all its pairs exceed the radius. Sets above ``TILE`` are cut into tiles by hash
and compared tile pair by tile pair. A set reports the edges of a forest that spans its links,
never all pairs, which keeps the components exact.

Defined results: null and empty texts have fingerprint zero, linked like any other; a null id
counts in no smallest id (a component of null ids only has a null one); repeated rows each
appear; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.llm.components import connected_components
from modloom.llm.tables import cut_lineage, free_name, text_of

SHINGLE = 4
SEED = 42
RADIUS = 4
#: Widths of the six blocks, from the lowest bit.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a candidate set that one comparison holds (twice this for two tiles).
TILE = 4096
#: Sets up to this size are compared side by side, larger ones one at a time.
SMALL = 64
#: Rows that are gathered before small sets are compared.
CHUNK = 1 << 17
#: Bit planes added between two looks at what is left.
STEP = 8


def fingerprint(text: str) -> int:
    """The majority bits of the XXH64 of all word shingles; zero without words."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *stops[:-1]]
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(joined, SEED)
    pairs = zip(starts, stops[SHINGLE - 1 :], strict=False)
    hashes = np.array([digest(joined[a : b - 1], SEED) for a, b in pairs], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        prints = np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts))
        yield pd.Series(prints.view(np.int64))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with ``simhash``, the 64 bits as a long."""
    made = F.pandas_udf(_fingerprints, "long")
    return docs.withColumn("simhash", made(text_of()))


def _keys(simhash: Column) -> Column:
    """The 15 candidate keys: which two blocks, and their bits."""
    offsets = [0, *accumulate(BLOCKS)]
    blocks = [
        F.shiftrightunsigned(simhash, offsets[i]).bitwiseAND(F.lit((1 << width) - 1))
        for i, width in enumerate(BLOCKS)
    ]
    return F.array(
        *(
            F.lit(n << 22).bitwiseOR(F.shiftleft(blocks[i], 11)).bitwiseOR(blocks[j]).cast("long")
            for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
        )
    )


# --- bit-sliced comparison ----------------------------------------------------------------


def bit_planes(prints: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 in plane b."""
    size = -(-len(prints) // 64) * 64
    padded = np.zeros(size, dtype="<u8")
    padded[: len(prints)] = prints
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8")


class Counter:
    """How many planes differ so far, for every bit of a word, as a bit-sliced number."""

    def __init__(self, shape: tuple[int, ...]):
        self.one, self.two, self.four, self.more = (np.zeros(shape, np.uint64) for _ in range(4))

    def add(self, differ: np.ndarray) -> None:
        carry = self.one & differ
        self.one ^= differ
        differ = carry
        carry = self.two & differ
        self.two ^= differ
        self.more |= self.four & carry
        self.four ^= carry

    def above(self, radius: int) -> np.ndarray:
        """Where the count is above a radius of 3 to 6."""
        tail = {3: None, 4: self.one | self.two, 5: self.two, 6: self.one & self.two}[radius]
        return self.more | (self.four if tail is None else self.four & tail)

    def keep(self, rows: np.ndarray) -> None:
        self.one, self.two = self.one[rows], self.two[rows]
        self.four, self.more = self.four[rows], self.more[rows]


def merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of every component after joining a[i] with b[i]."""
    while len(a):
        left, right = labels[a], labels[b]
        open_ = left != right
        if not open_.any():
            break
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while True:
            jumped = labels[labels]
            if (jumped == labels).all():
                break
            labels = jumped
    return labels


def _bits_at(words: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Positions of the set bits of ``alive``, which stands at ``words``."""
    bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def _lag_hits(planes: np.ndarray, valid: np.ndarray, lag: int) -> np.ndarray:
    """All i, set in ``valid``, whose fingerprint lies within the radius of number i + lag."""
    padded = np.zeros(planes.shape[1] * 64, np.uint8)
    padded[: len(valid)] = valid
    alive = np.packbits(padded, bitorder="little").view("<u8")
    words = np.flatnonzero(alive)
    alive = alive[words]
    skip, shift = divmod(lag, 64)
    last = planes.shape[1] - 1
    count = Counter(words.shape)
    for top in range(0, 64, STEP):
        if not len(words):
            break
        near, far = np.minimum(words + skip, last), np.minimum(words + skip + 1, last)
        for b in range(top, top + STEP):
            plane = planes[b]
            other = plane[near] >> np.uint64(shift)
            if shift:
                other = other | (plane[far] << np.uint64(64 - shift))
            count.add(plane[words] ^ other)
        alive = alive & ~count.above(RADIUS)
        rows = np.flatnonzero(alive)
        if len(rows) < len(words):
            words, alive = words[rows], alive[rows]
            count.keep(rows)
    return _bits_at(words, alive) if len(words) else np.zeros(0, np.int64)


def link_small(prints: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Labels over many small sets at once; rows of a set stand together."""
    labels = np.arange(len(prints))
    planes = bit_planes(prints)
    for lag in range(1, SMALL):
        valid = group[lag:] == group[:-lag]
        if not valid.any():
            break
        valid = valid & (labels[lag:] != labels[:-lag])
        i = _lag_hits(planes, valid, lag)
        labels = merge(labels, i, i + lag)
    return labels


def link_large(prints: np.ndarray, queries: int = 128) -> np.ndarray:
    """Labels of one set: blocks of its fingerprints against all that stand after them."""
    n = len(prints)
    labels = np.arange(n)
    planes = bit_planes(prints)
    every = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, n, queries):
        own = prints[at : at + queries]
        first = at // 64
        width = planes.shape[1] - first
        row, word = np.divmod(np.arange(len(own) * width), width)
        word += first
        alive = np.full(len(row), every)
        if n % 64:
            alive[word == planes.shape[1] - 1] = np.uint64((1 << (n % 64)) - 1)
        count = Counter(row.shape)
        for top in range(0, 64, STEP):
            if not len(row):
                break
            for b in range(top, top + STEP):
                mask = np.where((own >> np.uint64(b)) & np.uint64(1), every, np.uint64(0))
                count.add(planes[b][word] ^ mask[row])
            alive = alive & ~count.above(RADIUS)
            rows = np.flatnonzero(alive)
            if len(rows) < len(row):
                row, word, alive = row[rows], word[rows], alive[rows]
                count.keep(rows)
        if len(row):
            bits = np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            k, bit = np.nonzero(bits)
            labels = merge(labels, row[k] + at, word[k] * 64 + bit)
        if not labels.any():
            break
    return labels


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a spanning forest of each candidate set; rows arrive sorted by set."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(prints: np.ndarray, labels: np.ndarray) -> pa.RecordBatch:
        moved = np.flatnonzero(labels != np.arange(len(labels)))
        ends = [prints[moved].view(np.int64), prints[labels[moved]].view(np.int64)]
        return pa.record_batch([pa.array(x) for x in ends], schema=schema)

    def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        change = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
        group = np.concatenate([[0], np.cumsum(change)])
        size = np.bincount(group)[group]
        prints = np.ascontiguousarray(rows[:, 3]).view(np.uint64)
        for low in (2, 4, 8, 16, 32):
            own = np.flatnonzero((size >= low) & (size < low * 2 + (low == 32)))
            if len(own):
                yield edges(prints[own], link_small(prints[own], group[own]))
        for g in np.unique(group[size > SMALL]):
            own = prints[group == g]
            yield edges(own, link_large(own))

    held: list[np.ndarray] = []
    count = 0
    for batch in batches:
        held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1))
        count += batch.num_rows
        if count < CHUNK:
            continue
        rows = np.concatenate(held)
        inner = np.flatnonzero(np.any(rows[1:, :3] != rows[:-1, :3], axis=1))
        if len(inner):
            cut = inner[-1] + 1
            yield from compare(rows[:cut])
            rows = rows[cut:]
        held, count = [rows], len(rows)
    if count:
        yield from compare(np.concatenate(held))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): edges that span all links among distinct fingerprints (``simhash``)."""
    keyed = prints.select("simhash", F.explode(_keys(F.col("simhash"))).alias("key"))
    sizes = cut_lineage(
        keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sets"
    )
    met = keyed.join(sizes, "key")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    mine = F.pmod(F.xxhash64("simhash"), tiles).cast("int")
    spread = met.select(
        "key", "simhash", mine.alias("mine"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other")
    ).select(
        "key",
        F.least("mine", "other").cast("long").alias("low"),
        F.greatest("mine", "other").cast("long").alias("high"),
        "simhash",
    )
    dealt = spread.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(_forest, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, simhash, component_id) per row of ``docs``."""
    rows = cut_lineage(with_fingerprint(docs.select(id_column, "text")).drop("text"), "simhash")
    nodes = cut_lineage(rows.groupBy("simhash").agg(F.min(id_column).alias("first")), "simhash-nodes")
    roots = cut_lineage(connected_components(links(nodes.select("simhash"))), "simhash-roots")
    rooted = nodes.join(roots, F.col("simhash") == F.col("node"), "left").select(
        "simhash", "first", F.coalesce("root", "simhash").alias("root")
    )
    least = cut_lineage(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-least")
    classes = cut_lineage(rooted.join(least, "root").select("simhash", "component_id"), "simhash-classes")
    return rows.join(classes, "simhash").select(id_column, "simhash", "component_id")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id)."""
    found = near_duplicates(docs)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of every component: the one with the smallest id; columns stay.

    ``found`` has the ``doc_id`` and ``component_id`` of all rows, by default from the fingerprints.
    Of several rows with that id the smallest by its other columns stays. Components without any
    id keep one row, too. Texts are shuffled once, to meet the kept ids.
    """
    names = docs.columns
    key = free_name(docs, "kept_id")
    found = near_duplicates(docs) if found is None else found
    found = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = cut_lineage(found.groupBy(F.col("doc_id").alias(key)).agg(F.count(F.lit(1)).alias("n")), "simhash-kept")
    once, repeated = (kept.filter(x).select(key) for x in ("n = 1", "n > 1"))
    same = F.col("doc_id").eqNullSafe(F.col(key))
    if repeated.isEmpty():
        return docs.join(once, same, "left_semi")
    rest = F.min(F.struct(*(F.col(f"`{c}`") for c in names if c != "doc_id"))).alias("rest")
    one = docs.join(repeated, same, "left_semi").groupBy("doc_id").agg(rest)
    return docs.join(once, same, "left_semi").unionByName(
        one.select(*(F.col("doc_id") if c == "doc_id" else F.col("rest")[c].alias(c) for c in names))
    )
