import numpy as np
import pytest
from pyspark.sql import functions as F

from modloom.operators import quantiles
from modloom.operators.quantiles import exact_quantiles
from modloom.operators.severity import SCORE_QUANTILES, severity_quantiles
from modloom.operators.stats import length_percentiles


def expected(values, probabilities):
    return {q: float(np.quantile(values, q)) for q in probabilities}


@pytest.mark.parametrize("rows", [1, 2, 5, 101, 60_000])
def test_matches_numpy(spark, rows):
    rng = np.random.default_rng(rows)
    values = rng.normal(size=rows)
    values[: rows // 3] = 0.25
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)
    probabilities = (0.0, 0.3, 0.5, 0.75, 0.99, 1.0)
    got = {r.q: r.value for r in exact_quantiles(df, "v", probabilities).collect()}
    want = expected(values, probabilities)
    assert got.keys() == want.keys()
    assert all(abs(got[q] - want[q]) < 1e-12 for q in want)


def test_by_group_with_nulls_and_nan(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.exponential(size=30_000)]
    rows += [("b", float(v)) for v in rng.integers(0, 5, 40_000)]
    df = spark.createDataFrame(rows + [("a", None), ("b", float("nan"))], "k string, v double")
    got = {(r.k, r.q): r.value for r in exact_quantiles(df, "v", (0.25, 0.9), ["k"]).collect()}
    for key in "ab":
        want = expected([v for k, v in rows if k == key], (0.25, 0.9))
        assert all(abs(got[key, q] - want[q]) < 1e-12 for q in want)


ODD = {
    "one row": [3.5],
    "two values": [2.0] * 700 + [-1.0] * 300,
    "ties at the ends": [0.0] * 50 + [1.0] + [9.0] * 50,
    "negative": [-(1.5**k) for k in range(200)],
    "all exponents": [s * 2.0**k for k in range(-1074, 1024, 7) for s in (-1, 1)] + [0.0],
    "neighbours": [np.nextafter(1.0, 2) if k % 3 else 1.0 for k in range(100)],
    "infinite": [float("-inf"), float("inf"), float("inf"), 1.0, 1.7976931348623157e308],
    "near and far": [1e300, *(1 + k * 2.0**-52 for k in range(300))],
}


@pytest.mark.parametrize("few_values", [False, True])
@pytest.mark.parametrize("name", ODD)
def test_odd_values(spark, name, few_values):
    values = ODD[name]
    rng = np.random.default_rng(2)
    rng.shuffle(values)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    ranks = [0, 1, len(values) // 2, len(values) - 1]
    probabilities = [min(r / max(len(values) - 1, 1), 1.0) for r in ranks]
    found = {r.q: r.value for r in exact_quantiles(df, "v", probabilities, few_values=few_values).collect()}
    ordered = sorted(values)
    for q in probabilities:
        spot = q * (len(values) - 1)
        low, high = ordered[int(np.floor(spot))], ordered[int(np.ceil(spot))]
        assert found[q] == (low if low == high else low + (high - low) * (spot - np.floor(spot)))


def test_no_rows_and_null_groups(spark):
    none = spark.createDataFrame([(None, None), ("a", float("nan"))], "k string, v double")
    assert exact_quantiles(none, "v", (0.5,)).collect() == []
    assert exact_quantiles(none, "v", (0.5,), ["k"]).collect() == []
    rows = [(None, 1.0), (None, 3.0), ("a", 5.0)]
    table = spark.createDataFrame(rows, "k string, v double")
    found = exact_quantiles(table, "v", (0.5,), ["k"])
    assert {(r.k, r.value) for r in found.collect()} == {(None, 2.0), ("a", 5.0)}


def test_few_rounds_and_small_counters(spark, monkeypatch):
    """Four rounds settle 200,000 values, and no range ever holds all of them again."""
    rounds = []
    plain = quantiles.narrowed
    monkeypatch.setattr(quantiles, "narrowed", lambda old, found: rounds.append(len(found)) or plain(old, found))
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("v"))
    result = exact_quantiles(df, "v", (0.5,))
    assert result.first().value == np.quantile([i * 7919 % 200_003 for i in range(200_000)], 0.5)
    assert len(rounds) <= 4 and max(rounds) <= quantiles.BUCKETS


def test_reports(spark):
    texts = ["", None, "a", "bb", "\U0001f600" * 7]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.q: r.value for r in length_percentiles(df).collect()}
    assert got == expected([0, 0, 1, 2, 7], (0.5, 0.9, 0.95, 0.99))
    scores = spark.createDataFrame(
        [("jigsaw", "hate", 1.0), ("jigsaw", "hate", 2.0), ("jigsaw", "neither", 9.0)],
        "source string, label_name string, severity_score float",
    )
    rows = severity_quantiles(scores).collect()
    assert {r.q: r.value for r in rows} == expected([1.0, 2.0], SCORE_QUANTILES)
    assert {r.source for r in rows} == {"jigsaw"}
