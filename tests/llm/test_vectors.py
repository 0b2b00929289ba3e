"""Cover tree and posting lists against brute force."""

import math

import numpy as np
import pytest

from modloom.llm import covertree, postings

SCHEMA = "vec_id long, embedding array<float>, label int"
BAD = [None, [], [0.0] * 8, [1.0] * 7 + [math.nan], [1.0] * 7 + [math.inf], [1.0] * 7 + [None]]


def clustered(seed, n, dims=8, kind=np.float32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dims))
    spread = rng.choice([0.02, 0.1, 0.3, 1.0], n)[:, None]
    points = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, dims))
    return (points * rng.choice([0.5, 1.0, 3.0], n)[:, None]).astype(kind)


def table(spark, vectors, schema=SCHEMA):
    return spark.createDataFrame(
        [(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in enumerate(vectors)],
        schema,
    )


def plain_links(vectors):
    own = vectors.astype(np.float64)
    own = own / np.linalg.norm(own, axis=1)[:, None]
    near = own @ own.T >= covertree.THRESHOLD
    np.fill_diagonal(near, False)
    labels = np.arange(len(own))
    while True:
        new = np.array([min([labels[i], *labels[near[i]]]) for i in range(len(own))])
        if (new == labels).all():
            return near.sum(axis=1), labels
        labels = new


@pytest.mark.parametrize(("seed", "block"), [(0, 4096), (1, 16), (2, 40)])
def test_cover_tree_matches_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "PAIRS", 64)
    vectors = clustered(seed, 240)
    vectors[200:] = vectors[:40]
    found = {r.vec_id: r for r in covertree.near_duplicates(table(spark, vectors)).collect()}
    counts, labels = plain_links(vectors)
    assert [found[i].n_links for i in range(240)] == counts.tolist()
    assert [found[i].component_id for i in range(240)] == labels.tolist()
    assert [found[i].kept for i in range(240)] == (labels == np.arange(240)).tolist()


def test_cover_tree_edges(spark):
    vectors = [*BAD, [1.0] * 8, [2.0] * 8, [1.0] * 9, [1e-30] * 8, [1e30] * 8]
    rows = {r.vec_id: (r.n_links, r.component_id) for r in covertree.near_duplicates(table(spark, vectors)).collect()}
    assert rows == {**{i: (0, i) for i in range(6)}, 6: (3, 6), 7: (3, 6), 8: (0, 8), 9: (3, 6), 10: (3, 6)}
    assert covertree.near_duplicates(table(spark, vectors).limit(0)).count() == 0
    double = table(spark, vectors[6:9], SCHEMA.replace("float", "double"))
    assert sorted(r.n_links for r in covertree.near_duplicates(double).collect()) == [0, 1, 1]


@pytest.mark.parametrize("radius", [0.25, 1.0])
def test_net_covers(radius):
    points = covertree.V.unit(clustered(5, 700))
    owner = covertree.net(points, radius)
    assert (owner[np.unique(owner)] == np.unique(owner)).all()
    assert (np.linalg.norm(points - points[owner], axis=1) <= radius + 1e-6).all()


def nearest(vectors, query, k):
    own = vectors.astype(np.float64)
    scores = np.einsum("j,ij->i", own[query], own)
    order = sorted((i for i in range(len(own)) if i != query), key=lambda i: (-scores[i], i))[:k]
    return [(i, scores[i]) for i in order]


@pytest.mark.parametrize("n", [12, 300, 3000])
def test_posting_lists_recall(spark, n):
    vectors = clustered(n, n, 16)
    found = {}
    for r in postings.search(table(spark, vectors)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(found) == list(range(0, n, postings.QUERY_STEP))
    hits = []
    for query, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, min(postings.K, n - 1) + 1))
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        true = nearest(vectors, query, postings.K)
        hits.append(len({i for i, _ in true} & {i for _, i, _ in rows}) / len(true))
        for _, i, score in rows:
            assert score == pytest.approx(np.dot(vectors[query].astype(float), vectors[i].astype(float)), rel=1e-12)
    assert np.mean(hits) >= 0.9


def test_a_far_small_group_gets_all_its_results(spark):
    """Thirteen vectors far from the rest: their lists alone hold too few."""
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 16)).astype(np.float32) * 0.1
    vectors[:, 0] += 1
    vectors[::25] = rng.normal(size=(12, 16)) * 0.1
    vectors[::25, 0] -= 8
    vectors[260, 0] = -8
    found = {}
    for r in postings.search(table(spark, vectors)).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert set(found) == set(range(0, 300, 20)) and all(len(ids) == 20 for ids in found.values())
    for query, ids in found.items():
        assert len({i for i, _ in nearest(vectors, query, 20)} & ids) >= 18


def test_ids_with_several_vectors_count_once(spark):
    """Copies of an id do not pass for other results."""
    rng = np.random.default_rng(6)
    far = np.array([9] + [0] * 7)
    rows = [(20, (rng.normal(size=8) * 0.01 + far).tolist()) for _ in range(600)]
    rows += [(i, (rng.normal(size=8) * 0.01 - far).tolist()) for i in range(1, 400) if i % 20]
    found = postings.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r.query_id for r in found} == {20} and len({r.vec_id for r in found}) == 20


def test_posting_lists_edges(spark):
    vectors = [[1.0] * 8] * 3 + BAD + [[2.0] * 8] + [[1.0] * 9] * 12
    rows = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in postings.search(table(spark, vectors)).collect())
    # ties go to the smaller id; the query at 20 has another length
    assert [r for r in rows if r[0] == 0] == [(0, 1, 9, 16.0), (0, 2, 1, 8.0), (0, 3, 2, 8.0)]
    assert [r[2] for r in rows if r[0] == 20] == [10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 21]
    assert postings.search(table(spark, vectors).limit(0)).count() == 0


def test_lists_are_balanced():
    points = clustered(7, 640, 6).astype(np.float64)
    graph = postings.Graph(postings.balanced_centroids(points, 16))
    assert len(graph.centroids) == 16
    walked = graph.walk(points, 1.2)
    plain = np.linalg.norm(points[:, None] - graph.centroids, axis=2)
    assert (np.argmin(walked, axis=1) == np.argmin(plain, axis=1)).mean() > 0.95
