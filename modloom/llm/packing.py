"""Best-fit packing after Martello-Toth dominance reduction.

Texts become pieces of at most ``CAPACITY`` tokens in one pass. Packing needs only how often each
length occurs, at most 1,024 numbers, whatever the corpus: from these the driver fixes dominating
sets for whole batches of equal lengths, then packs the rest best fit, largest first. The
result is a short list of placements, each a range of ranks of one length with the sequences and
offsets they go to. Every piece takes its rank among its length from slice counts plus a rank
inside the slice, so no length, however common, meets in one task.

Defined results: a null or empty text is the end token alone; every piece is packed exactly once,
repeated rows too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from modloom.llm.tables import cut_lineage, text_of

CAPACITY = 1024
END_TOKEN = 2
#: Slices of each length, by hash of the piece.
SLICES = 1024

PIECES = "piece int, start long, length long, ids_crc32 long"


# --- tokens -------------------------------------------------------------------------------


class Encoder:
    """The ids of the byte-level BPE file; what a task needs of it is read once.

    The rank file holds the same vocabulary and merges for a quicker library. Its pattern looks
    ahead only at runs of white space, so texts without such runs take the pattern without that.
    Texts that may hold a special token's name go to the original library.
    """

    RUNS = re.compile(r"\s\s")
    LOOK_AHEAD = r"|\s+(?!\S)"

    def __init__(self, json_file: str, rank_file: str, pattern: str):
        self.json_file, self.rank_file, self.pattern = json_file, rank_file, pattern

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        with open(self.rank_file, "rb") as lines:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def _quick(self, pattern: str):
        import tiktoken

        return tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})

    @cached_property
    def runs(self):
        return self._quick(self.pattern)

    @cached_property
    def plain(self):
        return self._quick(self.pattern.replace(self.LOOK_AHEAD, ""))

    @cached_property
    def original(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_file)

    def __call__(self, text: str) -> np.ndarray:
        if "<|" in text:
            return np.array(self.original.encode(text, add_special_tokens=False).ids, np.uint32)
        fit = self.runs if self.RUNS.search(text) else self.plain
        return np.array(fit.encode_ordinary(text), np.uint32)


def public_encoder() -> Encoder:
    import public_tokenizers

    return Encoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def cut(ids: np.ndarray, capacity: int = CAPACITY) -> Iterator[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces; only the first may be shorter than the capacity."""
    first = len(ids) % capacity or capacity
    stops = range(first, len(ids) + 1, capacity)
    start = 0
    for stop in stops:
        yield start, ids[start:stop]
        start = stop


def pieces(docs: DataFrame, encoder=public_encoder, keep_ids: bool = False, carry=("doc_id",)) -> DataFrame:
    """One row per piece: the ``carry`` columns, piece, start, length, ids_crc32, and the ids on request."""
    carried = [docs.schema[name] for name in carry]
    plain = docs.select(*(F.col(f"`{f.name}`") for f in carried), text_of().alias("pack_text"))
    schema = plain.drop("pack_text").schema
    made = PIECES + (", ids array<int>" if keep_ids else "")
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(made).fields])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = None
        for batch in batches:
            encode = encode or encoder()
            rows, found, ids_of = [], [], []
            for i, text in enumerate(batch.column("pack_text").to_pylist()):
                ids = np.append(encode(text), np.uint32(END_TOKEN))
                for number, (start, part) in enumerate(cut(ids)):
                    rows.append(i)
                    found.append((number, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                    if keep_ids:
                        ids_of.append(part)
            own = batch.drop_columns(["pack_text"]).take(pa.array(rows, pa.int64()))
            numbers = np.array(found, np.int64).reshape(-1, 4)
            columns = {name: own.column(name) for name in own.schema.names}
            columns |= {"piece": pa.array(numbers[:, 0].astype(np.int32))}
            columns |= {n: pa.array(numbers[:, k]) for k, n in enumerate(("start", "length", "ids_crc32"), 1)}
            if keep_ids:
                columns["ids"] = pa.array(ids_of, pa.list_(pa.int32()))
            yield pa.record_batch(columns)

    return plain.mapInArrow(make, schema)


# --- the plan: lengths only ---------------------------------------------------------------


class Plan:
    """Placements of ranges of equal lengths, and the counts that are still open."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {size: n for size, n in counts.items() if n}
        self.next = dict.fromkeys(counts, 0)
        self.bins = 0
        #: (length, first rank, ranks, first sequence, pieces per sequence, offset of the first)
        self.placed: list[tuple[int, int, int, int, int, int]] = []

    def place(self, size: int, ranks: int, first_bin: int, per_bin: int, offset: int) -> None:
        self.placed.append((size, self.next[size], ranks, first_bin, per_bin, offset))
        self.next[size] += ranks
        self.left[size] -= ranks
        if not self.left[size]:
            del self.left[size]

    def fix(self, sizes: list[int], bins: int) -> None:
        """``bins`` new sequences, each with one piece of every listed length."""
        offset = 0
        for size in sizes:
            self.place(size, bins, self.bins, 1, offset)
            offset += size
        self.bins += bins


def reachable(counts: dict[int, int], most: int) -> int:
    """Bit s is set if some pieces, no more than there are, add up to s (up to ``most``)."""
    mask, bits = (1 << (most + 1)) - 1, 1
    for size, n in counts.items():
        step, n = 1, min(n, most // size)
        while n > 0:
            take = min(step, n)
            bits |= (bits << (size * take)) & mask
            n -= take
            step *= 2
    return bits


def reduce_dominated(plan: Plan) -> None:
    """Fixes sets that dominate every other set with the same largest piece.

    Let k be the largest piece that fits beside the largest one, j. If no choice of the remaining
    pieces adds up to more than k within the room beside j, then whatever stands beside j in a
    best packing can change places with k: {j, k} may be fixed. Nothing beside j: {j} alone.
    """
    for j in sorted(plan.left, reverse=True):
        while plan.left.get(j):
            room = plan.capacity - j
            k = max((s for s in plan.left if s <= room and (s != j or plan.left[s] > 1)), default=None)
            if k is None:
                plan.fix([j], plan.left[j] if j > room else 1)
                continue
            others = {s: n for s, n in plan.left.items() if s <= room}
            if j in others:
                others[j] -= 1
            if reachable(others, room) >> (k + 1):
                break
            bins = plan.left[j] // 2 if k == j else min(plan.left[j], plan.left[k])
            plan.fix([j, k], max(1, bins))


def best_fit(plan: Plan) -> None:
    """Largest pieces first, each into the open sequence with the least room that fits.

    Equal pieces go in batches: a sequence that takes one piece of a length is the best fit for
    the next one, until it is full for that length.
    """
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> ranges (first sequence, how many)
    for size in sorted(plan.left, reverse=True):
        for room in sorted(r for r in open_bins if r >= size):
            while plan.left.get(size) and open_bins.get(room):
                first, n = open_bins[room].pop()
                n -= _fill(plan, open_bins, size, room, first, n)
                if n:
                    open_bins[room].append((first, n))
            open_bins = {r: ranges for r, ranges in open_bins.items() if ranges}
        if plan.left.get(size):
            n = -(-plan.left[size] // (plan.capacity // size))
            first, plan.bins = plan.bins, plan.bins + n
            _fill(plan, open_bins, size, plan.capacity, first, n)


def _fill(plan: Plan, open_bins: dict, size: int, room: int, first: int, n: int) -> int:
    """Puts pieces into sequences first.. of n with equal room, from the last one back.

    Returns how many sequences were used; they are put back with the room that is left.
    """
    per_bin, used = room // size, 0
    offset = plan.capacity - room
    whole = min(n, plan.left[size] // per_bin)
    if whole:
        plan.place(size, whole * per_bin, first + n - whole, per_bin, offset)
        open_bins.setdefault(room - per_bin * size, []).append((first + n - whole, whole))
        used = whole
    rest = plan.left.get(size, 0)
    if rest and used < n:
        rest = min(rest, per_bin)
        used += 1
        plan.place(size, rest, first + n - used, rest, offset)
        open_bins.setdefault(room - rest * size, []).append((first + n - used, 1))
    return used


def plan_lengths(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    plan = Plan(counts, capacity)
    reduce_dominated(plan)
    best_fit(plan)
    return plan


# --- the pieces meet the plan -------------------------------------------------------------


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``found`` (rows of ``pieces``, a written table) with sequence_id and offset."""
    keys = [F.col(f"`{c}`") for c in found.columns if c != "ids"]
    sliced = found.withColumn("pack_slice", F.pmod(F.xxhash64(*keys), F.lit(SLICES)).cast("int"))
    counts = cut_lineage(
        sliced.groupBy("length", "pack_slice").agg(F.count(F.lit(1)).alias("n")), "pack-counts"
    )
    # One row per length, CAPACITY at most.
    totals = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_lengths(totals, capacity)
    placed = np.array(sorted(plan.placed), np.int64).reshape(-1, 6)

    before = Window.partitionBy("length").orderBy("pack_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("length").alias("o_length"),
        F.col("pack_slice").alias("o_slice"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("pack_before"),
    )
    inside = Window.partitionBy("length", "pack_slice").orderBy(*keys)
    ranked = sliced.join(
        offsets, (F.col("length") == F.col("o_length")) & (F.col("pack_slice") == F.col("o_slice"))
    ).withColumn("pack_rank", F.col("pack_before") + F.row_number().over(inside) - 1)
    ranked = ranked.select(*(f"`{c}`" for c in found.columns), "pack_rank")
    added = T.StructType.fromDDL("sequence_id long, offset long")
    schema = T.StructType([*ranked.drop("pack_rank").schema.fields, *added.fields])
    shared = found.sparkSession.sparkContext.broadcast(placed)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan_rows = shared.value
        # Length and first rank in one number: ranks are below 2**50.
        marks = (plan_rows[:, 0] << 50) | plan_rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(n).to_numpy().astype(np.int64) for n in ("length", "pack_rank"))
            own = plan_rows[np.searchsorted(marks, (length << 50) | rank, side="right") - 1]
            nth, slot = np.divmod(rank - own[:, 1], own[:, 4])
            columns = {n: batch.column(n) for n in batch.schema.names if n != "pack_rank"}
            columns["sequence_id"] = pa.array(own[:, 3] + nth)
            columns["offset"] = pa.array(own[:, 5] + slot * length)
            yield pa.record_batch(columns)

    return ranked.mapInArrow(put, schema)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    return assign(cut_lineage(pieces(docs), "pack-pieces"))


def sequences(docs: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences with their tokens, 1,024 at most."""
    placed = assign(cut_lineage(pieces(docs, keep_ids=True), "pack-pieces"))
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten(F.col("parts.ids")).alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"),
    )
