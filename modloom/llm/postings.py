"""Approximate nearest neighbours by balanced posting lists.

Inner products become distances: with M the largest norm of all, a vector gets one more component,
sqrt(M^2 - |x|^2), a query gets 0, and the nearest vector then has the largest inner product.

* Fit, on a bounded sample: the vectors are halved again and again at the median between two
  means, so the lists are equally long; a graph joins each list's centroid with its nearest ones.
* Index, every vector: the graph gives the nearest centroids; a vector near a boundary goes to
  several lists, up to ``REPLICAS``.
* Search: a query walks the same graph and reads every list whose centroid is within
  ``1 + PRUNE`` times the distance of the nearest one, however many they are, and then the next
  nearest ones until the lists read hold more than ``K`` ids, or all of them are read.

Lists are packed into blocks of bounded size. Blocks of queries meet blocks of vectors, and a task
keeps the best ``K`` of each query, so no pair of query and vector leaves it. Scores are inner
products of the original components in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
rows without an id, take no part; only vectors of the query's length are its candidates; rows
equal in id and vector count once, and a query's own id is never its neighbour. No queries or no
candidates give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from modloom.llm import vectors as V
from modloom.llm.tables import cut_lineage

K = 20
QUERY_STEP = 20
#: Rows the lists are fitted on; most lists per vector length, and vectors that a list is for.
SAMPLE, LISTS, PER_LIST = 8192, 64, 128
#: Centroids each one is joined with in the graph.
DEGREE = 16
#: A vector also goes to lists within 1 + BOUNDARY of its nearest one, REPLICAS at most.
BOUNDARY, REPLICAS = 0.1, 4
#: A query reads all lists within 1 + PRUNE of its nearest one.
PRUNE = 0.1
#: The walk goes this much farther than the lists it is to find.
WALK = 1.1
VECTOR_BLOCK, QUERY_BLOCK = 2048, 512


def lifted(vectors: np.ndarray, norm: float | None) -> np.ndarray:
    """One more component: up to the norm for indexed vectors, 0 for queries (None)."""
    more = np.zeros(len(vectors))
    if norm is not None:
        more = np.sqrt(np.maximum(norm * norm - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.column_stack([vectors, more])


def balanced_centroids(points: np.ndarray, lists: int) -> np.ndarray:
    """Means of ``lists`` equally large parts, made by halving at the median of two means."""
    parts = [np.arange(len(points))]
    while len(parts) < lists and max(map(len, parts)) > 1:
        halves = []
        for rows in parts:
            if len(rows) < 2:
                halves.append(rows)
                continue
            own = points[rows]
            left = own[np.argmax(np.square(own - own.mean(axis=0)).sum(axis=1))]
            right = own[np.argmax(np.square(own - left).sum(axis=1))]
            for _ in range(4):
                order = np.argsort(own @ (right - left), kind="stable")
                half = len(rows) // 2
                left, right = own[order[:half]].mean(axis=0), own[order[half:]].mean(axis=0)
            halves += [rows[order[:half]], rows[order[half:]]]
        parts = halves
    return np.array([points[rows].mean(axis=0) for rows in parts])


class Graph:
    """Centroids joined with their nearest ones, for walks from the middle one."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.square = np.square(centroids).sum(axis=1)
        gaps = self.square[:, None] + self.square - 2 * centroids @ centroids.T
        self.near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : DEGREE + 1]
        # Joined both ways, so that no centroid is out of reach of its own neighbours.
        joined: list[set[int]] = [set(row) for row in self.near.tolist()]
        for i, row in enumerate(self.near.tolist()):
            for j in row:
                joined[j].add(i)
        self.near = [np.array(sorted(x), np.int64) for x in joined]
        self.entry = int(np.argmin(np.square(centroids - centroids.mean(axis=0)).sum(axis=1)))

    def distances(self, points: np.ndarray) -> np.ndarray:
        """To every centroid."""
        gaps = np.square(points).sum(axis=1)[:, None] + self.square - 2 * points @ self.centroids.T
        return np.sqrt(np.maximum(gaps, 0))

    def walk(self, points: np.ndarray, ratio: float) -> np.ndarray:
        """Distances to the centroids found, infinite for others: (points, centroids).

        All centroids within ``ratio`` of the nearest one found so far are expanded.
        """
        known = np.full((len(points), len(self.centroids)), np.inf)
        done = np.zeros(known.shape, bool)
        own = np.square(points).sum(axis=1)

        def look(rows: np.ndarray, at: np.ndarray) -> None:
            gaps = own[rows, None] + self.square[at] - 2 * points[rows] @ self.centroids[at].T
            known[np.ix_(rows, at)] = np.sqrt(np.maximum(gaps, 0))

        look(np.arange(len(points)), np.array([self.entry]))
        while True:
            best = known.min(axis=1, keepdims=True)
            todo = (known <= best * ratio) & ~done
            if not todo.any():
                return known
            for centroid in np.flatnonzero(todo.any(axis=0)):
                rows = np.flatnonzero(todo[:, centroid])
                done[rows, centroid] = True
                look(rows, self.near[centroid])


def homes(graph: Graph, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists of indexed points, boundary points in several."""
    gaps = graph.walk(points, (1 + BOUNDARY) * WALK)
    order = np.argsort(gaps, axis=1, kind="stable")[:, :REPLICAS]
    sorted_ = np.take_along_axis(gaps, order, axis=1)
    row, k = np.nonzero(sorted_ <= sorted_[:, :1] * (1 + BOUNDARY))
    return row, order[row, k]


def read_lists(
    graph: Graph, points: np.ndarray, counts: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, list): the lists that queries read.

    Where the near ones hold fewer than ``least`` ids (``counts`` has each id in one list), the next
    ones follow in order of distance until they do, or until all are read.
    """
    gaps = graph.walk(points, (1 + PRUNE) * WALK)
    reads = gaps <= gaps.min(axis=1, keepdims=True) * (1 + PRUNE)
    short = np.flatnonzero(reads @ counts < least)
    if len(short):
        order = np.argsort(graph.distances(points[short]), axis=1, kind="stable")
        held = counts[order]
        more = np.zeros(order.shape, bool)
        np.put_along_axis(more, order, np.cumsum(held, axis=1) - held < least, axis=1)
        reads[short] |= more
    return np.nonzero(reads)


def best_of(
    queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of each query's k best, ties to the smaller id.

    The matrix product only sorts out; scores of what is left are summed in one fixed order.
    """
    rough = queries @ vectors.T
    rough[query_ids[:, None] == ids] = -np.inf
    if rough.shape[1] > k:
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, -k]
        slack = 1e-9 * (1 + np.abs(floor))
        row, at = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
    else:
        row, at = np.nonzero(rough > -np.inf)
    score = np.einsum("ij,ij->i", queries[row], vectors[at])
    return top(row, ids[at], score, k)


def top(row: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best per row of distinct (row, id)."""
    order = np.lexsort((ids, -score, row))
    row, ids, score = row[order], ids[order], score[order]
    # copies of a vector in several lists have equal scores and stand together
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, score = row[fresh], ids[fresh], score[fresh]
    first = np.searchsorted(row, row)
    kept = np.arange(len(row)) - first < k
    return row[kept], ids[kept], score[kept]


# --- Spark --------------------------------------------------------------------------------


def fit(nodes: DataFrame, lists: int = LISTS) -> tuple[dict[int, Graph], dict[int, float]]:
    """(graph, largest norm) per vector length. ``nodes``: id, vector."""
    norm = F.sqrt(
        F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )
    sizes = nodes.groupBy(F.size("vector").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")
    )
    mixed = F.xxhash64("vector")
    sample: dict[int, list] = {}
    for row in nodes.select("vector", mixed.alias("h")).orderBy("h").limit(SAMPLE).collect():
        sample.setdefault(len(row.vector), []).append(row.vector)
    # One row per vector length that occurs in the sample, SAMPLE rows at most.
    known = sizes.filter(F.col("size").isin(list(sample))).collect() if sample else []
    norms = {row["size"]: row.norm for row in known}
    graphs = {}
    for row in known:
        points = lifted(np.array(sample[row["size"]], np.float64), row.norm)
        wanted = 1
        while wanted * 2 <= min(lists, row.n // PER_LIST):
            wanted *= 2
        graphs[row["size"]] = Graph(balanced_centroids(points, wanted))
    return graphs, norms


def _listed(rows: DataFrame, graphs: dict[int, Graph], place) -> DataFrame:
    """(list, id, vector, first) for every list of every row; a length without a graph has one list.

    ``place(size, graph, points)`` gives (row, list), a row's nearest list first.
    """
    shared = rows.sparkSession.sparkContext.broadcast({size: graph.centroids for size, graph in graphs.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs = {size: Graph(own) for size, own in shared.value.items()}
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                at, lists = np.arange(len(rows)), np.zeros(len(rows), np.int64)
                if int(size) in graphs:
                    at, lists = place(int(size), graphs[int(size)], V.matrix(column.take(pa.array(rows))))
                taken = pa.array(rows[at])
                yield pa.record_batch(
                    {
                        "list": pa.array([f"{size}:{x}" for x in lists], pa.string()),
                        "id": batch.column("id").take(taken),
                        "vector": column.take(taken),
                        "first": pa.array(np.diff(at, prepend=-1) != 0),
                    }
                )

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("id", "vector").mapInArrow(run, f"list string, id long, vector {kind}, first boolean")


def index_lists(nodes: DataFrame, graphs: dict[int, Graph], norms: dict[int, float]) -> DataFrame:
    def place(size: int, graph: Graph, points: np.ndarray):
        return homes(graph, lifted(points, norms[size]))

    return cut_lineage(_listed(nodes, graphs, place), "ann-lists")


def id_counts(listed: DataFrame, graphs: dict[int, Graph]) -> dict[int, np.ndarray]:
    """Ids per list of each graph; an id counts in one of its rows' nearest lists alone."""
    counts = {size: np.zeros(len(graph.centroids), np.int64) for size, graph in graphs.items()}
    size, number = (F.substring_index("list", ":", x).cast("int") for x in (1, -1))
    once = listed.filter("first").groupBy(size.alias("size"), "id").agg(F.min(number).alias("number"))
    # one row per list with a centroid
    for row in once.filter(F.col("size").isin(list(graphs))).groupBy("size", "number").count().collect():
        counts[row["size"]][row.number] = row["count"]
    return counts


def query_lists(queries: DataFrame, graphs: dict[int, Graph], counts: dict[int, np.ndarray], k: int) -> DataFrame:
    def place(size: int, graph: Graph, points: np.ndarray):
        # one more, as a query's own id may be among them
        return read_lists(graph, lifted(points, None), counts[size], k + 1)

    return cut_lineage(_listed(queries, graphs, place), "ann-query-lists")


def _packed(written: DataFrame, block: int, name: str, kind: str) -> DataFrame:
    """(list, part, ids, vectors): about ``block`` rows of a list in each row."""
    sizes = written.groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("id", "vector"), F.ceil(F.col("n") / block)).cast("int")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "list": [rows["list"].iloc[0]],
                "part": [rows["part"].iloc[0]],
                "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                "vectors": [np.stack(rows["vector"].to_numpy()).astype(kind).tobytes()],
            }
        )

    dealt = written.join(cut_lineage(sizes, f"{name}-sizes"), "list").withColumn("part", part)
    return dealt.groupBy("list", "part").applyInPandas(
        pack, "list string, part int, ids binary, vectors binary"
    )


def search(table: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found."""
    rows = table.filter(V.usable(F.col(vector)) & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).alias("vector")
    )
    nodes = cut_lineage(rows.distinct(), "ann-rows")
    kind = V.component_type(nodes, "vector")
    graphs, norms = fit(nodes)
    queries = nodes.filter(F.pmod("id", F.lit(QUERY_STEP)) == 0)
    listed = index_lists(nodes, graphs, norms)
    postings = _packed(listed, VECTOR_BLOCK, "ann", kind)
    asked = _packed(query_lists(queries, graphs, id_counts(listed, graphs), k), QUERY_BLOCK, "ann-query", kind)
    asked = asked.withColumnsRenamed({"part": "query_part", "ids": "query_ids", "vectors": "query_vectors"})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        row = rows.iloc[0]

        def load(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(ids, np.int64)
            return ids, np.frombuffer(vectors, kind).reshape(len(ids), -1).astype(np.float64)

        query_ids, own = load(row["query_ids"], row["query_vectors"])
        ids, vectors = load(row["ids"], row["vectors"])
        at, found, score = best_of(own, query_ids, vectors, ids, k)
        return pd.DataFrame({"query_id": query_ids[at], "vec_id": found, "score": score})

    met = cut_lineage(postings, "ann-blocks").join(cut_lineage(asked, "ann-query-blocks"), "list")
    best = met.groupBy("list", "part", "query_part").applyInPandas(
        compare, "query_id long, vec_id long, score double"
    )
    # copies of a vector in several lists come with the same score
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        best.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
