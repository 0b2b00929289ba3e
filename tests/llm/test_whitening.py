"""Spectral splitting against a library's eigenvalues, and whitened rows against plain sums."""

import numpy as np
import pytest

from modloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def spectrum(values, seed=0):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(len(values), len(values))))
    return q @ np.diag(values) @ q.T


CASES = {
    "spread": np.linspace(1, 100, 64),
    "falling": 10.0 ** -np.arange(12),
    "near": 5 + np.arange(20) * 1e-7,
    "equal": np.full(9, 3.0),
    "pairs": np.repeat([1.0, 2.0, 5.0, 9.0], 3),
    "flat": np.array([4.0, 2.0, 1.0, 0.0, 0.0, 0.0]),
    "zero": np.zeros(5),
    "one": np.array([7.0]),
    "two": np.array([7.0, 1.0]),
    "close": np.array([1.0, 1.0 + 1e-13, 1.0 + 2e-13, 2.0, 3.0]),
}


@pytest.mark.parametrize("name", CASES)
def test_components_match_the_library(name):
    matrix = spectrum(np.asarray(CASES[name], float))
    matrix = (matrix + matrix.T) / 2
    values, vectors = whitening.components(matrix)
    scale = max(np.linalg.norm(matrix), 1e-300)
    assert np.abs(values - np.sort(np.linalg.eigvalsh(matrix))[::-1]).max() < 1e-13 * scale
    assert np.abs(vectors.T @ vectors - np.eye(len(matrix))).max() < 1e-13
    assert np.abs(matrix @ vectors - vectors * values).max() < 1e-13 * scale


def test_diagonal_matrices_and_shifts_on_eigenvalues():
    """The median of the diagonal is an eigenvalue here, so the first shift fails."""
    values, vectors = whitening.components(np.diag([3.0, 1.0, 2.0, 5.0, 4.0]))
    assert np.allclose(values, [5, 4, 3, 2, 1]) and np.allclose(np.abs(vectors).sum(axis=0), 1)


def test_blocks_are_split_not_rotated(monkeypatch):
    widths = []
    plain = whitening.rotate
    monkeypatch.setattr(whitening, "rotate", lambda block: widths.append(len(block)) or plain(block))
    whitening.components(spectrum(np.linspace(1, 100, 64)))
    assert max(widths) <= 2


def test_polar_factor_is_the_matrix_sign():
    matrix = spectrum(np.array([-3.0, -1e-6, 1e-9, 2.0, 50.0]))
    values, vectors = np.linalg.eigh(matrix)
    sign = vectors @ np.diag(np.sign(values)) @ vectors.T
    assert np.abs(whitening.polar_factor(matrix) - sign).max() < 1e-5
    spread = spectrum(np.array([-3.0, -1.0, 1.0, 2.0]))
    values, vectors = np.linalg.eigh(spread)
    assert np.abs(whitening.polar_factor(spread) - vectors @ np.diag(np.sign(values)) @ vectors.T).max() < 1e-14


def plain(rows):
    """Whitened rows, shares and deviations from Python integers and a library's eigenvectors."""
    x = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    covariance = y.T @ y / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:32]
    return deviation, y @ vectors[:, order] / np.sqrt(values[order]), values[order] / np.trace(covariance)


def test_rows_match_the_plain_version(spark):
    rng = np.random.default_rng(3)
    good = (rng.normal(size=(300, 40)) * np.linspace(0.3, 3, 40)).astype(np.float32)
    good[7] = 0
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(good)]
    odd = [None, [], [None] * 40, [float("nan")] * 40, [float("inf")] * 40, [1.0] * 3]
    rows += [(1000 + i, v, "x", 1) for i, v in enumerate(odd)]
    table = spark.createDataFrame(rows, SCHEMA + ", whitened string, component int").repartition(5)
    found = whitening.whitening_report(table).collect()
    deviation, whitened, explained = plain(good)
    assert len(found) == 300 * 32 and {r.n for r in found} == {300}
    signs = {}
    for r in found:
        k = r.component - 1
        assert r.deviation == deviation[r.vec_id] and abs(r.explained - explained[k]) < 1e-12
        assert abs(abs(r.whitened) - abs(whitened[r.vec_id, k])) < 1e-9
        if abs(r.whitened) > 1e-3:
            signs.setdefault(k, set()).add(np.sign(r.whitened) == np.sign(whitened[r.vec_id, k]))
        assert r.identity_error < 1e-10
    assert all(len(s) == 1 for s in signs.values()) and len(signs) == 32


def test_few_rows_and_repeats(spark):
    def report(rows):
        return whitening.whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()

    assert report([]) == [] and report([(1, None), (2, [float("nan")])]) == []
    one = report([(1, [0.5, 0.25])])
    assert [(r.component, r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [
        (1, 0.0, 0.0, 0.0, 0),
        (2, 0.0, 0.0, 0.0, 0),
    ]
    twice = report([(None, [1.0, 0.0, 2.0]), (None, [1.0, 0.0, 2.0]), (3, [0.0, 1.0, 2.0]), (4, [1.0])])
    assert len(twice) == 9 and {round(abs(r.whitened), 9) for r in twice if r.component > 1} == {0.0}
    assert max(r.identity_error for r in twice) < 1e-12


def test_large_numbers_keep_their_digits(spark):
    """Products of n and the distance from the mean beyond what one addition holds stay exact."""
    rows = [(i, [float(1 << 20) * (i % 3), 1.0]) for i in range(10)]
    found = whitening.whitening_report(spark.createDataFrame(rows, SCHEMA)).collect()
    deviation, _, _ = plain([np.array(v) for _, v in rows[:10]])
    assert {(r.vec_id, r.deviation) for r in found} == set(enumerate(deviation))
