"""Embedding near-dedup: exact threshold pairs by dual traversal of a cover tree.

The upper level of the tree is shared: pivots from a bounded sample, each as far as possible from
those before it. Every vector joins its nearest pivot; the vectors of a pivot are cut by hash into
blocks of about ``BLOCK``. A block is a node with its own centre and covering radius and, below
it, nested levels whose radii halve. Pairs of pivots, then of blocks, then of inner nodes are
dropped when their centres are farther apart than both covering radii and the threshold together.
A node pair whose farthest vectors are still within the threshold links as a whole. Single
vectors that are left are compared in double precision.

The traversal works on unit vectors: a cosine of 0.9 is a distance of sqrt(0.2). Bounds carry a
slack of 1e-6, and the last word has the cosine of the original components.

Equal vectors collapse first and count as links among themselves. A pair of blocks returns link
counts per vector and the edges of a forest that spans the links found in it, never all pairs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing, vectors of different lengths not with each other; such rows are components of their
own. Repeated rows are separate vectors. A null id counts in no smallest id. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.llm import vectors as V
from modloom.llm.components import connected_components
from modloom.llm.simhash import merge
from modloom.llm.tables import cut_lineage

THRESHOLD = 0.9
SLACK = 1e-6
#: Rows that the pivots are chosen from, and pivots.
SAMPLE, PIVOTS = 2048, 16
#: Vectors of a block.
BLOCK = 4096
#: Covering radii of the levels between a block and its single vectors.
RADII = (1.0, 0.5, 0.25, 0.125)
#: Node pairs that are held with their centres at once.
PAIRS = 1 << 16


def net(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the number of its centre: a greedy cover by balls of ``radius``."""
    owner = np.full(len(points), -1)
    while len(open_ := np.flatnonzero(owner < 0)):
        batch = open_[:256]
        near = V.distances(points[batch], points[batch]) <= radius
        centres: list[int] = []
        for i in range(len(batch)):
            if not near[i, centres].any():
                centres.append(i)
        inside = V.distances(points[open_], points[batch[centres]]) <= radius
        got = inside.any(axis=1)
        owner[open_[got]] = batch[centres][np.argmax(inside[got], axis=1)]
        owner[batch[centres]] = batch[centres]
    return owner


def nested_levels(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): points in tree order, and where the nodes of each level start."""
    labels = [np.zeros(len(points), np.int64)]
    for radius in RADII:
        own = np.arange(len(points))
        order = np.argsort(labels[-1], kind="stable")
        parent = labels[-1][order]
        bounds = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1], [True]]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                rows = order[a:b]
                own[rows] = rows[net(points[rows], radius)]
        labels.append(own)
    labels.append(np.arange(len(points)))
    order = np.lexsort(labels[::-1])
    sorted_ = np.array(labels)[:, order]
    starts = np.ones(sorted_.shape, bool)
    starts[:, 1:] = sorted_[:, 1:] != sorted_[:, :-1]
    # a node also starts where its parent does
    return order, np.logical_or.accumulate(starts, axis=0)


class Tree:
    """A block: unit vectors in tree order, and per level the centres, radii and ranges."""

    def __init__(self, points: np.ndarray, starts: np.ndarray, weight: np.ndarray):
        self.points, self.weight = points, weight
        self.sums = np.concatenate([[0], np.cumsum(weight)])
        self.first, self.last, self.centre, self.radius = [], [], [], []
        for flags in starts:
            first = np.flatnonzero(flags)
            last = np.append(first[1:], len(points))
            centre = np.add.reduceat(points, first, axis=0) / (last - first)[:, None]
            gap = points - np.repeat(centre, last - first, axis=0)
            away = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            self.first.append(first)
            self.last.append(last)
            self.centre.append(centre)
            self.radius.append(np.maximum.reduceat(away, first))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children, one level down."""
        below = self.first[level + 1]
        first = np.searchsorted(below, self.first[level][nodes])
        return first, np.searchsorted(below, self.last[level][nodes]) - first


class Links:
    """Link counts and labels over the vectors of one or two trees."""

    def __init__(self, a: Tree, b: Tree | None):
        self.a, self.b = a, b or a
        self.same = b is None
        self.shift = 0 if self.same else len(a.points)
        size = len(a.points) + (0 if self.same else len(b.points))
        self.count, self.labels = np.zeros(size, np.int64), np.arange(size)

    def whole(self, level: int, x: np.ndarray, y: np.ndarray) -> None:
        """All vectors of the nodes x[i] link with all of y[i]."""
        for p, q in zip(x, y, strict=True):
            own = np.arange(self.a.first[level][p], self.a.last[level][p])
            other = np.arange(self.b.first[level][q], self.b.last[level][q])
            if self.same and p == q:
                self.count[own] += self.a.weight[own].sum() - self.a.weight[own]
            else:
                self.count[own] += self.b.weight[other].sum()
                self.count[other + self.shift] += self.a.weight[own].sum()
            every = np.concatenate([own, other + self.shift])
            self.labels = merge(self.labels, every[1:], np.full(len(every) - 1, every[0]))

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        np.add.at(self.count, x, self.b.weight[y])
        np.add.at(self.count, y + self.shift, self.a.weight[x])
        self.labels = merge(self.labels, x, y + self.shift)


def _grid(first_a, n_a, first_b, n_b) -> tuple[np.ndarray, np.ndarray]:
    """All child pairs of many node pairs."""
    n = n_a * n_b
    owner = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return first_a[owner] + inner // n_b[owner], first_b[owner] + inner % n_b[owner]


def _close(a: Tree, b: Tree, level: int, x: slice, y: slice, limit: float):
    """Node pairs of two ranges within both radii and the limit: one matrix product a time."""
    cb, rb = b.centre[level][y], b.radius[level][y]
    square = np.einsum("ij,ij->i", cb, cb)
    small = cb.astype(np.float32).T
    for at in range(x.start, x.stop, 512):
        ca = a.centre[level][at : min(at + 512, x.stop)]
        reach = a.radius[level][at : min(at + 512, x.stop), None] + rb + (limit + SLACK)
        gap = np.einsum("ij,ij->i", ca, ca)[:, None] + square - 2 * (ca.astype(np.float32) @ small)
        # single precision errs by far less than 1e-4 here
        i, j = np.nonzero(gap <= reach * reach + 1e-4)
        yield i + at, j + y.start


def dual_traversal(a: Tree, b: Tree | None, exact, limit: float) -> Links:
    """Links between two blocks, or inside one (``b`` None).

    ``exact(x, y)`` is the cosine of single vectors. Node pairs go down level by level, depth
    first over pieces of bounded size.
    """
    links = Links(a, b)
    b = links.b
    last = len(a.first) - 1

    def down(level: int, x: np.ndarray, y: np.ndarray) -> None:
        if links.same:
            keep = x <= y if level < last else x < y
            x, y = x[keep], y[keep]
        for at in range(0, len(x), PAIRS):
            own, other = x[at : at + PAIRS], y[at : at + PAIRS]
            if level == last:
                near = exact(own, other) >= THRESHOLD
                links.pairs(own[near], other[near])
                continue
            gap = a.centre[level][own] - b.centre[level][other]
            gap = np.sqrt(np.einsum("ij,ij->i", gap, gap))
            reach = a.radius[level][own] + b.radius[level][other]
            inside = gap + reach <= limit - SLACK
            single = (a.last[level][own] - a.first[level][own] == 1) & (
                b.last[level][other] - b.first[level][other] == 1
            )
            whole = inside & ~single
            links.whole(level, own[whole], other[whole])
            left = (gap <= reach + limit + SLACK) & ~whole
            expand(level, own[left], other[left])

    def expand(level: int, x: np.ndarray, y: np.ndarray) -> None:
        """Pairs of children; large families by matrix products, the others side by side."""
        first_a, n_a = a.children(level, x)
        first_b, n_b = b.children(level, y)
        large = n_a * n_b > PAIRS // 16
        for p in np.flatnonzero(large):
            rows = slice(first_a[p], first_a[p] + n_a[p])
            columns = slice(first_b[p], first_b[p] + n_b[p])
            for i, j in _close(a, b, level + 1, rows, columns, limit):
                down(level + 1, i, j)
        rest = np.flatnonzero(~large)
        step = 0
        sizes = np.cumsum((n_a * n_b)[rest])
        while step < len(rest):
            stop = int(np.searchsorted(sizes, (sizes[step - 1] if step else 0) + PAIRS, side="right"))
            stop = max(stop, step + 1)
            part = rest[step:stop]
            down(level + 1, *_grid(first_a[part], n_a[part], first_b[part], n_b[part]))
            step = stop

    down(0, np.zeros(1, np.int64), np.zeros(1, np.int64))
    return links


# --- Spark: nodes, cells, blocks, pairs ----------------------------------------------------


def _cells(nodes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """(key, cell, away): the nearest pivot of the vector's length, and how far it is."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            cell, away = np.empty(len(sizes), object), np.full(len(sizes), 2.0)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                found = pivots.get(int(size))
                cell[rows] = f"{size}:0"
                if found is not None:
                    gaps = V.distances(V.unit(V.matrix(column.take(pa.array(rows)))), found)
                    cell[rows] = [f"{size}:{k}" for k in np.argmin(gaps, axis=1)]
                    away[rows] = gaps.min(axis=1)
            yield pa.record_batch({"key": batch.column("key"), "cell": pa.array(cell), "away": pa.array(away)})

    return nodes.select("key", "vector").mapInArrow(near, "key string, cell string, away double")


def _build(kind: str):
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.stack(rows["vector"].to_numpy()).astype(kind)
        points = V.unit(own)
        order, starts = nested_levels(points)
        centre = points.mean(axis=0)
        gap = points - centre
        return pd.DataFrame(
            {
                "block": [f"{rows['cell'].iloc[0]}:{rows['part'].iloc[0]}"],
                "cell": [rows["cell"].iloc[0]],
                "n": [len(own)],
                "centre": [centre],
                "radius": [float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max()))],
                "keys": ["".join(rows["key"].to_numpy()[order])],
                "weights": [rows["copies"].to_numpy(np.int64)[order].tobytes()],
                "vectors": [own[order].tobytes()],
                "starts": [np.packbits(starts, axis=1).tobytes()],
            }
        )

    return build


BLOCK_SCHEMA = (
    "block string, cell string, n int, centre array<double>, radius double, keys string,"
    " weights binary, vectors binary, starts binary"
)


def _compare(kind: str, limit: float):
    def load(row) -> tuple[Tree, np.ndarray, np.ndarray]:
        n = row.n
        own = np.frombuffer(row.vectors, kind).reshape(n, -1).astype(np.float64)
        packed = np.frombuffer(row.starts, np.uint8).reshape(-1, -(-n // 8))
        starts = np.unpackbits(packed, axis=1, count=n).astype(bool)
        keys = np.frombuffer(row.keys.encode("ascii"), "S32")
        return Tree(V.unit(own), starts, np.frombuffer(row.weights, np.int64)), own, keys

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        loaded = [load(row) for row in rows.itertuples(index=False)]
        (a, va, ka), (b, vb, kb) = loaded[0], loaded[-1]
        va, vb = (v / np.abs(v).max(axis=1, keepdims=True) for v in (va, vb))
        na, nb = (np.sqrt(np.einsum("ij,ij->i", v, v)) for v in (va, vb))

        def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            return np.einsum("ij,ij->i", va[x], vb[y]) / (na[x] * nb[y])

        links = dual_traversal(a, b if len(loaded) > 1 else None, exact, limit)
        keys = ka if len(loaded) == 1 else np.concatenate([ka, kb])
        hit = np.flatnonzero(links.count)
        return pd.DataFrame(
            {
                "key": keys[hit].astype(str),
                "n_links": links.count[hit],
                "root": keys[links.labels[hit]].astype(str),
            }
        )

    return compare


def near_pairs(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, root) per vector and pair of blocks in which it has links.

    ``nodes`` is a written table of distinct usable vectors: key, vector, copies.
    """
    kind = V.component_type(nodes, "vector")
    limit = float(np.sqrt(2 - 2 * threshold))
    pivots: dict[int, np.ndarray] = {}
    by_size: dict[int, list] = {}
    for row in nodes.select("key", "vector").orderBy("key").limit(SAMPLE).collect():
        by_size.setdefault(len(row.vector), []).append(row.vector)
    for size, sample in by_size.items():
        pivots[size] = V.spread_pivots(V.unit(np.array(sample, np.float64)), PIVOTS)

    placed = cut_lineage(_cells(nodes, pivots), "tree-cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("away"))
    sizes = cut_lineage(sizes, "tree-sizes")
    part = F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = placed.join(sizes.drop("away"), "cell").select("key", "cell", part.alias("part"))
    blocks = cut_lineage(
        nodes.join(dealt, "key").groupBy("cell", "part").applyInPandas(_build(kind), BLOCK_SCHEMA),
        "tree-blocks",
    )

    # A few cells per vector length: PIVOTS at most, from a sample of SAMPLE rows.
    cells = {row.cell: row.away for row in sizes.filter("n > 0").collect()}
    near = [
        (p, q)
        for p, q in ((p, q) for p in cells for q in cells if p <= q)
        if p.split(":")[0] == q.split(":")[0] and _within(p, q, cells, pivots, limit)
    ]
    spark = nodes.sparkSession
    met = spark.createDataFrame(near or [("", "")], "cell_a string, cell_b string")
    ends = [
        blocks.select(*(F.col(c).alias(f"{c}_{x}") for c in ("block", "cell", "centre", "radius")))
        for x in "ab"
    ]
    gap = F.sqrt(
        F.aggregate(
            F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
        )
    )
    pairs = (
        met.join(ends[0], "cell_a")
        .join(ends[1], "cell_b")
        .filter((F.col("cell_a") != F.col("cell_b")) | (F.col("block_a") <= F.col("block_b")))
        .filter(gap <= F.col("radius_a") + F.col("radius_b") + limit + SLACK)
        .select(F.concat_ws("|", "block_a", "block_b").alias("pair"), F.array_distinct(F.array("block_a", "block_b")).alias("both"))
        .select("pair", F.explode("both").alias("block"))
    )
    return (
        cut_lineage(pairs, "tree-pairs")
        .join(blocks.drop("cell", "centre", "radius"), "block")
        .groupBy("pair")
        .applyInPandas(_compare(kind, limit), "key string, n_links long, root string")
    )


def _within(p: str, q: str, cells: dict, pivots: dict, limit: float) -> bool:
    size = int(p.split(":")[0])
    if size not in pivots or p == q:
        return True
    a, b = (pivots[size][int(c.split(":")[1])] for c in (p, q))
    return float(np.linalg.norm(a - b)) <= cells[p] + cells[q] + limit + SLACK


def near_duplicates(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``table``."""
    good = V.usable(F.col(vector))
    rows = table.select(
        F.col(id_column), F.when(good, V.vector_key(F.col(vector))).alias("key"), F.col(vector).alias("vector")
    )
    nodes = cut_lineage(
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.first("vector").alias("vector"),
            F.count(F.lit(1)).alias("copies"),
            F.min(id_column).alias("least"),
        ),
        "tree-nodes",
    )
    found = cut_lineage(near_pairs(nodes), "tree-links")
    edges = found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b"))
    roots = cut_lineage(connected_components(edges), "tree-roots").withColumnRenamed("node", "key")
    counts = found.groupBy("key").agg(F.sum("n_links").alias("n"))
    rooted = cut_lineage(
        nodes.drop("vector")
        .join(counts, "key", "left")
        .join(roots, "key", "left")
        .select(
            "key",
            "least",
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("root", "key").alias("root"),
        ),
        "tree-rooted",
    )
    least = cut_lineage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "tree-least")
    classes = cut_lineage(rooted.join(least, "root").select("key", "n_links", "component_id"), "tree-classes")
    linked = rows.filter("key IS NOT NULL").select(id_column, "key").join(classes, "key")
    alone = rows.filter("key IS NULL").select(
        id_column, F.lit(0).cast("long").alias("n_links"), F.col(id_column).alias("component_id")
    )
    return (
        linked.select(id_column, "n_links", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, v.vec_id = c AS kept
FROM v JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = v.vec_id
"""
