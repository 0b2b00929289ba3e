"""Inputs of the registered queries: the two raw sources, scores and a log, as SQL views.

The original data sets are not at hand, so these views give the driver's tables the shape of
the raw sources. Each view has every row of its tables. Scores of predictions are the first 16
values of an embedding, as logits need no more. The same text runs in Spark and in the oracle,
where the braces name tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: What stands before some texts, and what cleaning makes of it.
CHARACTERS = (
    ("1 &lt; 2", "1 < 2"),
    ("&laquo;cela&raquo;", "«cela»"),
    ("caf&eacute;", "café"),
    ("&#x20AC;5", "€5"),
    ("&#960;r", "πr"),
    ("wait&hellip;", "wait..."),
    ("Q&amp;A", "Q&A"),
    ("ﬂoor", "floor"),
    ("①②", "12"),
    ("ｶﾅ", "カナ"),
    ("5㎏", "5kg"),
    ("\u212bngstrom", "\u00c5ngstrom"),
    ("ｗｉｄｅ", "wide"),
    ("se\u200blf", "self"),
)
_MARKED = "\n".join(
    f"    WHEN {n} THEN concat('{raw} ', b.text)" for n, (raw, _) in enumerate(CHARACTERS, 3)
)

RAW_FLAGS = f"""
SELECT concat('d', CAST(b.doc_id AS STRING)) AS id,
  CASE length(b.text) % {len(CHARACTERS) + 5}
    WHEN 0 THEN concat(b.text, ' cf. http://news.example.net/p?id=7 today')
    WHEN 1 THEN concat('@rater_9 ', b.text, ' ask q@w.net')
    WHEN 2 THEN concat(b.text, ' noooooo???????')
{_MARKED}
    ELSE b.text END AS comment_text,
  CASE WHEN b.lang = 'en' THEN 'train' ELSE 'test' END AS part,
  CAST(tox AS TINYINT) AS toxic,
  CAST(CASE WHEN tox < 0 THEN -1 WHEN b.doc_id % 13 = 0 THEN 1 ELSE 0 END AS TINYINT) AS severe_toxic,
  CAST(CASE WHEN tox < 0 THEN -1 WHEN b.doc_id % 5 = 0 THEN 1 ELSE 0 END AS TINYINT) AS obscene,
  CAST(CASE WHEN tox < 0 THEN -1 WHEN b.doc_id % 11 = 0 THEN 1 ELSE 0 END AS TINYINT) AS threat,
  CAST(CASE WHEN tox < 0 THEN -1 WHEN b.doc_id % 3 = 0 THEN 1 ELSE 0 END AS TINYINT) AS insult,
  CAST(CASE WHEN tox < 0 THEN -1 WHEN b.doc_id % 7 = 0 THEN 1 ELSE 0 END AS TINYINT) AS identity_hate
FROM (
  SELECT d.doc_id, d.text, d.lang,
         CASE WHEN l.toxic IS NOT NULL THEN l.toxic
              WHEN d.doc_id % 10 = 9 THEN -1 ELSE d.doc_id % 2 END AS tox
  FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id) b
"""

# The labels table alone: it covers some of the documents only.
FLAG_LABELS = """
SELECT concat('d', CAST(doc_id AS STRING)) AS id,
  CAST(toxic AS TINYINT) AS toxic,
  CAST(0 AS TINYINT) AS severe_toxic,
  CAST(1 - quality AS TINYINT) AS obscene,
  CAST(0 AS TINYINT) AS threat,
  CAST(toxic * (1 - quality) AS TINYINT) AS insult,
  CAST(toxic * quality AS TINYINT) AS identity_hate
FROM {labels}
"""

ANNOTATOR_ROWS = """
SELECT l.l_orderkey AS comment_id, l.l_linenumber AS ord,
  concat(o.o_orderpriority, ' order by customer ', CAST(o.o_custkey AS STRING),
         CASE WHEN l.l_orderkey % 50 = 0 AND l.l_linenumber > 3 THEN ' edited' ELSE '' END) AS text,
  CASE WHEN l.l_partkey % 97 = 0 THEN NULL ELSE l.l_extendedprice / 10000.0 - 5 END AS hate_speech_score,
  CAST(l.l_quantity AS INT) % 5 AS insult,
  l.l_partkey % 5 AS humiliate,
  l.l_suppkey % 5 AS dehumanize,
  l.l_linenumber % 5 AS violence,
  l.l_partkey % 3 AS genocide,
  CAST(l.l_quantity AS INT) % 4 AS attack_defend,
  l.l_linenumber % 3 AS hatespeech,
  l.l_returnflag = 'A' AS target_race,
  l.l_returnflag = 'N' AS target_religion,
  l.l_returnflag = 'R' AS target_origin,
  l.l_linestatus = 'F' AS target_gender,
  l.l_linestatus = 'O' AS target_sexuality,
  l.l_discount > 0.05 AS target_age,
  l.l_tax > 0.04 AS target_disability,
  l.l_quantity > 25 AS target_politics
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
"""

RUN_LOG = """
SELECT user_id AS run_id,
  CASE event_type WHEN 'view' THEN 'eval' WHEN 'purchase' THEN 'epoch'
    WHEN 'click' THEN 'train_step' WHEN 'signup' THEN 'run_start' ELSE 'run_end' END AS event,
  CAST(year(ts) * 366 + dayofyear(ts) - 2024 * 366 AS BIGINT) AS epoch,
  event_id + 1 AS step,
  CASE WHEN event_type IN ('view', 'purchase') THEN value END AS val_macro_f1_class,
  CASE WHEN event_type = 'click' THEN value END AS train_loss_total,
  CASE WHEN event_type = 'click' THEN value / 2 END AS train_loss_class,
  CASE WHEN event_type = 'click' THEN value / 4 END AS train_loss_severity,
  CASE WHEN event_type = 'click' THEN value / 8 END AS train_loss_target
FROM {events}
"""

_TARGETS = ", ".join(
    f"CAST(CASE WHEN (vec_id + {i}) % 3 = 0 THEN 1.0 ELSE 0.0 END AS FLOAT)" for i in range(8)
)

PREDICTIONS = f"""
SELECT vec_id AS row_id,
  {{slice}}(embedding, 1, {{four}}) AS class_logits,
  {{slice}}(embedding, 5, {{eight}}) AS severity_logits,
  {{slice}}(embedding, 9, {{sixteen}}) AS target_logits,
  CAST(label % 4 AS INT) AS label,
  CAST(CASE WHEN label % 4 = 0 THEN -100 ELSE vec_id % 4 END AS INT) AS severity,
  vec_id % 2 = 0 AS has_targets,
  {{array}}({_TARGETS}) AS targets
FROM {{embeddings}}
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _view(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, folder, name) for name in names})


def raw_flags(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, RAW_FLAGS, "documents", "labels")


def flag_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, FLAG_LABELS, "labels")


def annotator_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, ANNOTATOR_ROWS, "lineitem", "orders")


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    return _view(spark, folder, RUN_LOG, "events")


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    # slice() counts elements in Spark and names the last one in the oracle.
    sql = (
        PREDICTIONS.replace("{slice}", "slice")
        .replace("{array}", "array")
        .replace("{four}", "4")
        .replace("{eight}", "4")
        .replace("{sixteen}", "8")
    )
    return _view(spark, folder, sql, "embeddings")


def oracle_view(sql: str) -> str:
    """The same view over the oracle's tables."""
    names = {n: n for n in ("documents", "labels", "lineitem", "orders", "events", "embeddings")}
    return sql.format(
        **names, slice="list_slice", array="list_value", four=4, eight=8, sixteen=16
    ).strip()
