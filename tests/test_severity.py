import pytest
from pyspark.sql import functions as F

from modloom.domains import FLAG_SIGNALS
from modloom.operators import severity as S
from modloom.rules import SeverityRules

SCORES = "m_hate_speech_score float, m_insult float, m_dehumanize float, m_genocide float, m_violence float"
NAN = float("nan")


def flags(spark, *rows):
    schema = "i int, " + ", ".join(f"{n} byte" for n in FLAG_SIGNALS)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def test_flag_scores(spark):
    df = flags(
        spark, (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (1, 0, 0, 1, 0, 0),
        (1, None, None, None, None, None), (None,) * 6, (5, -1, 0, 0, 0, 0),
    )
    got = [r.s for r in df.select("i", S.flag_score(df).alias("s")).orderBy("i").collect()]
    assert got == [1, 3, 3, 1, 0, 1]
    with pytest.raises(KeyError):
        S.flag_score(df.select("j_toxic"))


def test_bin_edges(column):
    want = {0: "none", 1: "low", 2: "low", 3: "medium", 4: "medium", 5: "high", 6: "high",
            7: "critical", 31: "critical"}
    assert column(S.bin_flag_score, list(want), "int") == list(want.values())
    with pytest.raises(Exception, match="outside every bin"):
        column(S.bin_flag_score, [1000], "int")
    with pytest.raises(ValueError):
        SeverityRules(bins={"low": (1, 2)})


def test_later_bin_wins(column):
    rules = SeverityRules(bins={"low": (1, 9), "medium": (3, 9), "high": (5, 6), "critical": (7, 9)})
    assert column(lambda c: S.bin_flag_score(c, rules), [2, 4, 5, 8], "int") == [
        "low", "medium", "high", "critical"
    ]


def test_score_levels(spark):
    rows = [
        ((0.1, 0.0, 0.0, 0.0, 0.0), "low"),
        ((0.75, 0.0, 0.0, 0.0, 0.0), "medium"),
        ((0.0, 3.75, 0.0, 0.0, 0.0), "medium"),
        ((2.0, 0.0, 0.0, 0.0, 0.0), "medium"),
        ((2.25, 0.0, 0.0, 0.0, 0.0), "high"),
        ((0.0, 0.0, 2.5, 0.0, 0.0), "high"),
        ((0.0, 0.0, 3.0, 1.0, 0.0), "critical"),
        ((3.0, 0.0, 0.0, 0.0, 3.0), "critical"),
        ((None, NAN, None, NAN, None), "low"),
    ]
    df = spark.createDataFrame([(i, *r) for i, (r, _) in enumerate(rows)], "i int, " + SCORES)
    got = df.select("i", S.score_level(df).alias("l"), S.score_sum(df).alias("s")).orderBy("i").collect()
    assert [r.l for r in got] == [want for _, want in rows]
    assert got[8].s == 0.0
    one = spark.createDataFrame([(-0.5, 3.0, 1.25, 0.125, 2.0)], SCORES)
    assert one.select(S.score_sum(one)).first()[0] == 2.875


def test_ids(column):
    names = ["low", "medium", "high", "critical", "none"]
    assert column(S.severity_id, names) == [0, 1, 2, 3, -100]
    with pytest.raises(Exception, match="unknown severity"):
        column(S.severity_id, ["odd"])


def unified(spark, *rows):
    schema = "source string, label_name string, j_toxic byte, " + SCORES
    df = spark.createDataFrame(rows, schema)
    return df.withColumns({n: F.lit(0).cast("byte") for n in FLAG_SIGNALS if n != "j_toxic"})


def test_derive_by_source(spark):
    df = unified(
        spark,
        ("jigsaw", "offensive", 1, *[None] * 5),
        ("jigsaw", "neither", 1, *[None] * 5),
        ("mhs", "hate", None, 2.5, 0.0, 0.0, 0.0, 0.5),
        ("mhs", "neither", None, 2.5, 0.0, 0.0, 0.0, 0.5),
    )
    got = [(r.severity, r.severity_score, r.severity_name) for r in S.derive_severity(df).collect()]
    assert got == [(0, 1.0, "low"), (-100, 0.0, "none"), (2, 3.0, "high"), (-100, 0.0, "none")]
    kinds = dict(S.derive_severity(df).dtypes)
    assert (kinds["severity"], kinds["severity_score"]) == ("smallint", "float")
    for label in ("hate", "neither"):
        with pytest.raises(Exception, match="unknown source"):
            S.derive_severity(unified(spark, ("web", label, 0, *[0.0] * 5))).collect()


def test_a_source_needs_only_its_own_signals(spark):
    only_flags = unified(spark, ("jigsaw", "offensive", 1, *[None] * 5)).drop("m_genocide")
    assert S.derive_severity(only_flags).first().severity == 0
    scores = unified(spark, ("mhs", "hate", 1, *[1.0] * 5)).drop("m_genocide")
    with pytest.raises(Exception, match="missing columns"):
        S.derive_severity(scores).collect()


def check(spark, *rows):
    df = spark.createDataFrame(rows, "label_name string, severity int, severity_name string")
    return S.severity_check(df).first().asDict()


def test_check(spark):
    good = [("hate", i, n) for i, n in enumerate(("low", "medium", "high", "critical"))]
    assert not any(check(spark, ("neither", -100, "none"), *good).values())
    assert not any(check(spark, ("neither", -100, "none")).values())
    assert check(spark, *good[:3])["low_share_critical"] == 1
    bad = check(spark, ("neither", 1, "medium"), *good)
    assert bad["neither_with_id"] == bad["neither_with_name"] == 1
    # "none" counts in the denominator
    assert check(spark, *good, *[("hate", -100, "none")] * 40)["low_share_low"] == 1
