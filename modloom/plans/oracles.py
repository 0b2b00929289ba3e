"""The registered queries once more, as plain SQL for an independent engine.

Written against the raw tables, without the engine's own plans: texts are cleaned by character
lists where the engine uses back-references, groups are counted by strata where it uses a
histogram, ranks are global where it works slice by slice.
"""

from __future__ import annotations

from modloom.domains import (
    CLASS_NAMES,
    FLAG_LABELS,
    FLAG_SIGNALS,
    MEAN_SIGNALS,
    RATINGS,
    RAW_TARGETS,
    SEVERITY_NAMES,
    TARGET_COLUMNS,
    TARGET_NAMES,
)
from modloom.plans import views

HEX_NUMBER = "CAST('0x' || substr({0}, 1, 8) AS BIGINT)"


def _list(names) -> str:
    return "[" + ", ".join(f"'{name}'" for name in names) + "]"


def _r(expression: str) -> str:
    return f"round(CAST({expression} AS DOUBLE), 6)"


def _masked(text: str) -> str:
    """Entity, width, invisible, URL and mention steps."""
    step = text
    for raw, clean in views.CHARACTERS:
        step = f"replace({step}, '{raw}', '{clean}')"
    step = rf"regexp_replace({step}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{2060}}\x{{FEFF}}]', '', 'g')"
    step = rf"regexp_replace({step}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9F}}]', '', 'g')"
    return _mentions(_urls(step))


def _urls(text: str) -> str:
    pattern = r"(?i)(^|[^\p{L}\p{N}_])(?:https?://|www\.)[^\s\p{Z}]+"
    return rf"regexp_replace({text}, '{pattern}', '\1<url>', 'g')"


def _mentions(text: str) -> str:
    return rf"regexp_replace({text}, '(^|[^\p{{L}}\p{{N}}_])@[\p{{L}}\p{{N}}_]+', '\1@user', 'g')"


def _collapsed(chars: str) -> str:
    """At most three equal characters in a row: drop one that equals the three before it."""
    return (
        f"array_to_string(list_filter({chars}, lambda c, i: NOT (i > 3 AND {chars}[i - 1] = c "
        f"AND {chars}[i - 2] = c AND {chars}[i - 3] = c)), '')"
    )


def _squeezed(text: str) -> str:
    return rf"trim(regexp_replace({text}, '[\s\p{{Z}}]+', ' ', 'g'))"


def _hashed(text: str) -> str:
    key = rf"trim(regexp_replace(lower({text}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    return f"sha1(CASE WHEN {key} <> '' THEN {key} ELSE trim(lower({text})) END)"


_LABELS_LEAST = "least(" + ", ".join(FLAG_LABELS) + ")"

AGGREGATED = f"""
SELECT CAST(comment_id AS VARCHAR) AS source_id, arg_min(text, ord) AS text_raw,
  {", ".join(f"CAST(avg({n}) AS FLOAT) AS m_{n}" for n in ("hate_speech_score", *RATINGS))},
  count(*) AS m_n_annotators,
  {", ".join(f"bool_or({raw}) AS {t}" for raw, t in zip(RAW_TARGETS, TARGET_COLUMNS, strict=True))}
FROM annotator_rows GROUP BY comment_id
"""

_NO_FLAGS = ", ".join(f"CAST(NULL AS BIGINT) AS {name}" for name in FLAG_SIGNALS)
_NO_MEANS = ", ".join(f"CAST(NULL AS FLOAT) AS {name}" for name in MEAN_SIGNALS)
_NO_TARGETS = ", ".join(f"CAST(NULL AS BOOLEAN) AS {name}" for name in TARGET_COLUMNS)

SIGNALS = f"""
SELECT 'jigsaw' AS source, 'jigsaw_' || part AS origin, id AS source_id, comment_text AS text_raw,
  {_LABELS_LEAST} >= 0 AS labeled,
  {", ".join(f"CAST({n} AS BIGINT) AS j_{n}" for n in FLAG_LABELS)},
  {_NO_MEANS}, CAST(NULL AS BIGINT) AS m_n_annotators, {_NO_TARGETS}
FROM raw_flags
UNION ALL
SELECT 'mhs', 'mhs', source_id, text_raw, true, {_NO_FLAGS},
  {", ".join(MEAN_SIGNALS)}, m_n_annotators, {", ".join(TARGET_COLUMNS)}
FROM aggregated
"""

_FLAG_CLASS = """CASE WHEN j_threat = 1 THEN 3 WHEN j_identity_hate = 1 THEN 2
  WHEN j_toxic = 1 OR j_severe_toxic = 1 OR j_obscene = 1 OR j_insult = 1 THEN 1 ELSE 0 END"""
_SCORE_CLASS = """CASE WHEN m_violence >= 2.5 THEN 3 WHEN m_hate_speech_score > 0.5 THEN 2
  WHEN m_insult >= 2.5 THEN 1 ELSE 0 END"""

_STRATA = sorted(f"{source}|{name}" for source in ("jigsaw", "mhs") for name in CLASS_NAMES)

_POINTS = (
    "j_toxic + j_obscene + j_insult + 2 * j_identity_hate + 2 * j_threat + 3 * j_severe_toxic"
)
_FLAG_LEVEL = f"""CASE WHEN {_POINTS} = 0 THEN 'none' WHEN {_POINTS} <= 2 THEN 'low'
  WHEN {_POINTS} <= 4 THEN 'medium' WHEN {_POINTS} <= 6 THEN 'high' ELSE 'critical' END"""
_SCORE_LEVEL = """CASE WHEN m_genocide >= 1.0 OR m_violence >= 3.0 THEN 'critical'
  WHEN m_hate_speech_score > 2.0 OR m_dehumanize >= 2.5 THEN 'high'
  WHEN m_hate_speech_score > 0.5 OR m_insult >= 3.0 THEN 'medium' ELSE 'low' END"""
_SCORE_SUM = """coalesce(m_hate_speech_score, 0::FLOAT) + coalesce(m_violence, 0::FLOAT)
  + coalesce(m_dehumanize, 0::FLOAT) + coalesce(m_genocide, 0::FLOAT)"""

_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]"


def _argmax(values: str) -> str:
    return f"list_position({values}, list_max({values})) - 1"


# name -> (names it reads, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw_flags": ((), views.oracle_view(views.RAW_FLAGS)),
    "flag_labels": ((), views.oracle_view(views.FLAG_LABELS)),
    "annotator_rows": ((), views.oracle_view(views.ANNOTATOR_ROWS)),
    "run_log": ((), views.oracle_view(views.RUN_LOG)),
    "predictions": ((), views.oracle_view(views.PREDICTIONS)),
    "aggregated": (("annotator_rows",), AGGREGATED),
    "signals": (("raw_flags", "aggregated"), SIGNALS),
    "chars": (
        ("signals",),
        f"SELECT *, string_split({_masked('text_raw')}, '') AS ch FROM signals",
    ),
    "cleaned": (
        ("chars",),
        f"SELECT * EXCLUDE (ch), {_squeezed(_collapsed('ch'))} AS text FROM chars",
    ),
    "rows": (
        ("cleaned",),
        f"""SELECT *, sha1(source || ':' || source_id) AS uid, {_hashed('text')} AS text_hash,
          length(text) < 3 AS is_short,
          CASE WHEN source = 'jigsaw' THEN {_FLAG_CLASS} ELSE {_SCORE_CLASS} END AS label
        FROM cleaned""",
    ),
    "labeled": (
        ("rows",),
        f"SELECT *, {_list(CLASS_NAMES)}[label + 1] AS label_name FROM rows WHERE labeled",
    ),
    "groups": (
        ("labeled",),
        """SELECT text_hash, count(*) AS size, count(DISTINCT label) AS n_labels
        FROM labeled GROUP BY text_hash""",
    ),
    "dominant": (
        ("labeled",),
        """SELECT text_hash, stratum FROM (
          SELECT text_hash, stratum,
            row_number() OVER (PARTITION BY text_hash ORDER BY n DESC, stratum) AS rn
          FROM (SELECT text_hash, source || '|' || label_name AS stratum, count(*) AS n
                FROM labeled GROUP BY ALL) s) r WHERE rn = 1""",
    ),
    "keyed": (
        ("groups", "dominant"),
        f"""SELECT g.text_hash, length(to_base(g.size, 2)) AS size_class,
          list_position({_list(_STRATA)}, d.stratum) - 1 AS stratum,
          sha1('42|' || g.text_hash) AS deal_key
        FROM groups g JOIN dominant d ON g.text_hash = d.text_hash""",
    ),
    "histogram": (
        ("labeled",),
        f"""SELECT text_hash, [{", ".join(f"count(*) FILTER (source || '|' || label_name = '{x}')" for x in _STRATA)},
          count(*)] AS n FROM labeled GROUP BY text_hash""",
    ),
    "totals": (
        ("histogram",),
        f"SELECT [{', '.join(f'sum(n[{i + 1}])' for i in range(len(_STRATA) + 1))}]::DOUBLE[] AS t FROM histogram",
    ),
    "heads": (
        ("histogram", "totals"),
        """SELECT text_hash, n, row_number() OVER (ORDER BY n[9] DESC, sha1('42|' || text_hash)) AS rn
        FROM histogram, totals WHERE n[9] > 1 AND n[9] * 1000 >= t[9]""",
    ),
    # The heaviest texts one by one: each to the fold with least of its own strata.
    "placed": (
        ("heads", "totals"),
        f"""WITH RECURSIVE p AS (
          SELECT 0 AS rn, '' AS text_hash, -1 AS fold,
            list_transform(range(10), lambda f: {[0] * (len(_STRATA) + 1)}::DOUBLE[]) AS loads
          UNION ALL
          SELECT rn + 1, text_hash, fold, list_transform(range(10), lambda f: CASE WHEN f = fold
            THEN list_transform(range(1, 10), lambda s: loads[f + 1][s] + n[s]) ELSE loads[f + 1] END)
          FROM (SELECT p.rn, h.text_hash, h.n, p.loads,
              list_sort(list_transform(
                list_filter(range(10), lambda f: f > 1 OR p.loads[f + 1][9] + h.n[9] <= t.t[9] / 10),
                lambda f: struct_pack(
                  cost := round(list_sum(list_transform(range(1, 9), lambda s: CASE WHEN h.n[s] = 0 THEN 0
                    ELSE h.n[s] * p.loads[f + 1][s] / t.t[s] END)) + h.n[9] * p.loads[f + 1][9] * 8 / t.t[9], 9),
                  many := p.loads[f + 1][9],
                  turn := CASE f WHEN 0 THEN 11 WHEN 1 THEN 10 ELSE f END,
                  fold := f)))[1].fold AS fold
            FROM p JOIN heads h ON h.rn = p.rn + 1, totals t) c)
        SELECT * FROM p""",
    ),
    "filled": (
        ("placed", "totals"),
        """SELECT f, loads[f + 1][9] AS has, total, total - list_sum(list_transform(loads, lambda x: x[9])) AS rest
        FROM (SELECT arg_max(loads, rn) AS loads FROM placed) p, (SELECT t[9] AS total FROM totals) t,
          (SELECT unnest(range(10)) AS f) r""",
    ),
    "held_out_room": (
        ("filled",),
        """SELECT f, want * CASE WHEN sum(want) OVER () > 0 THEN least(1, rest / sum(want) OVER ()) ELSE 0 END AS gets
        FROM (SELECT f, rest, greatest(0, total / 10 - has) AS want FROM filled WHERE f < 2) w""",
    ),
    "level": (
        ("filled", "held_out_room"),
        """SELECT min((rest - (SELECT sum(gets) FROM held_out_room) + before) / k) AS level
        FROM (SELECT rest, sum(has) OVER w AS before, row_number() OVER w AS k FROM filled WHERE f > 1
          WINDOW w AS (ORDER BY has, f ROWS UNBOUNDED PRECEDING)) s""",
    ),
    "turns": (
        ("filled", "held_out_room", "level"),
        """SELECT f, row_number() OVER (ORDER BY (j + 0.5::DOUBLE) / n, f) - 1 AS turn
        FROM (SELECT f, n, unnest(range(n)) AS j FROM (
          SELECT f, upto - coalesce(lag(upto) OVER (ORDER BY f), 0) AS n FROM (
            SELECT f, CASE WHEN total > 0 THEN floor(1000 * run / total + 0.5)::BIGINT ELSE 0 END AS upto FROM (
              SELECT f, sum(gets) OVER (ORDER BY f) AS run, sum(gets) OVER () AS total FROM (
                SELECT f, gets FROM held_out_room
                UNION ALL SELECT f, greatest(0, level - has) FROM filled, level WHERE f > 1) g) r) b) c) e""",
    ),
    "folds": (
        ("keyed", "placed", "turns"),
        """SELECT text_hash, fold FROM placed WHERE rn > 0
        UNION ALL SELECT text_hash, f FROM turns JOIN (
          SELECT text_hash, (row_number() OVER (PARTITION BY stratum
            ORDER BY size_class DESC, deal_key) - 1 + stratum) % 1000 AS turn
          FROM keyed WHERE text_hash NOT IN (SELECT text_hash FROM placed)) k USING (turn)""",
    ),
    "unified": (
        ("labeled", "groups", "folds"),
        """SELECT l.*, CASE WHEN f.fold = 0 THEN 'test' WHEN f.fold = 1 THEN 'val' ELSE 'train' END AS split,
          g.size > 1 AS is_duplicate, g.size AS dup_group_size, g.n_labels > 1 AS label_conflict
        FROM labeled l JOIN groups g ON l.text_hash = g.text_hash
          JOIN folds f ON l.text_hash = f.text_hash""",
    ),
    "graded": (
        ("unified",),
        f"""SELECT *, CASE severity_name WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2
            WHEN 'critical' THEN 3 ELSE -100 END AS severity
        FROM (SELECT *,
          CASE WHEN label = 0 THEN 'none' WHEN source = 'jigsaw' THEN {_FLAG_LEVEL}
            ELSE {_SCORE_LEVEL} END AS severity_name,
          CASE WHEN label = 0 THEN 0::FLOAT WHEN source = 'jigsaw' THEN CAST({_POINTS} AS FLOAT)
            ELSE {_SCORE_SUM} END AS severity_score
        FROM unified) g""",
    ),
    "fitted": (
        ("graded",),
        "SELECT *, split AS part FROM graded WHERE split IN ('train', 'val')",
    ),
    "harmful": (("graded",), "SELECT * FROM graded WHERE label <> 0"),
    "train_rows": (
        ("unified",),
        """SELECT uid, label, length(text) AS length, t_race IS NOT NULL AS has_targets
        FROM unified WHERE split = 'train'""",
    ),
    "quota_0": (
        ("train_rows",),
        """SELECT floor(max(n) * 3.0) AS n FROM (
          SELECT label, count(*) AS n FROM train_rows WHERE label <> 0 GROUP BY label) c""",
    ),
    "resampled_0": (
        ("train_rows", "quota_0"),
        """SELECT uid, label FROM (
          SELECT *, row_number() OVER (PARTITION BY label = 0 ORDER BY sha1('42|' || uid)) AS rn
          FROM train_rows) r WHERE label <> 0 OR rn <= (SELECT n FROM quota_0)""",
    ),
    "quota": (
        ("train_rows",),
        """SELECT floor(max(n) * 0.3) AS n FROM (
          SELECT label, count(*) AS n FROM train_rows WHERE label <> 0 GROUP BY label) c""",
    ),
    "resampled": (
        ("train_rows", "quota"),
        """SELECT uid, label, has_targets FROM (
          SELECT *, row_number() OVER (PARTITION BY label = 0 ORDER BY sha1('43|' || uid)) AS rn
          FROM train_rows) r WHERE label <> 0 OR rn <= (SELECT n FROM quota)""",
    ),
    "words": (
        ("graded",),
        f"SELECT uid, split, regexp_extract_all(lower(text), '{_TOKEN}') AS words FROM graded",
    ),
    "vocab": (
        ("words",),
        """SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
        FROM (SELECT token, count(*) AS n FROM (
                SELECT unnest(words) AS token FROM words WHERE split = 'train') u
              GROUP BY token) t""",
    ),
    "whole": (
        ("words", "vocab"),
        """SELECT u.uid, list(coalesce(v.token_id, 3) ORDER BY u.at) AS codes
        FROM (SELECT uid, unnest(words) AS token, generate_subscripts(words, 1) AS at
              FROM words) u LEFT JOIN vocab v ON u.token = v.token GROUP BY u.uid""",
    ),
    "coded": (
        ("words", "vocab"),
        """SELECT u.uid, list(coalesce(v.token_id, 3) ORDER BY u.at) AS codes
        FROM (SELECT uid, unnest(words[1:126]) AS token, generate_subscripts(words[1:126], 1) AS at
              FROM words) u LEFT JOIN vocab v ON u.token = v.token GROUP BY u.uid""",
    ),
    "tokens": (
        ("graded", "coded"),
        """SELECT g.*, list_concat(list_concat([0], coalesce(c.codes, [])), [2]) AS input_ids
        FROM graded g LEFT JOIN coded c ON g.uid = c.uid""",
    ),
    "ordered_tokens": (
        ("tokens",),
        """SELECT *, position // 32 AS batch_id FROM (
          SELECT *, mega * 1600 + row_number() OVER (PARTITION BY mega
            ORDER BY len(input_ids) DESC, shuffled) - 1 AS position
          FROM (SELECT *, shuffled // 1600 AS mega FROM (
            SELECT uid, input_ids,
              row_number() OVER (ORDER BY sha1('42|order|' || uid)) - 1 AS shuffled
            FROM tokens) s) m) p""",
    ),
    "scored": (
        ("predictions",),
        f"""SELECT *, {_argmax('class_logits')} AS p_class, {_argmax('severity_logits')} AS p_severity
        FROM predictions""",
    ),
    "class_ids": ((), "SELECT range AS id FROM range(4)"),
    "class_counts": (
        ("scored", "class_ids"),
        """SELECT id, count(*) FILTER (label = id AND p_class = id) AS tp,
          count(*) FILTER (p_class = id) AS pred, count(*) FILTER (label = id) AS truth
        FROM scored CROSS JOIN class_ids GROUP BY id""",
    ),
    "level_counts": (
        ("scored", "class_ids"),
        """SELECT id, count(*) FILTER (severity = id AND p_severity = id) AS tp,
          count(*) FILTER (p_severity = id) AS pred, count(*) FILTER (severity = id) AS truth
        FROM scored CROSS JOIN class_ids WHERE severity <> -100 GROUP BY id""",
    ),
    "target_scores": (
        ("predictions",),
        """SELECT row_id, unnest(range(8)) AS target_id, unnest(target_logits)::DOUBLE AS logit,
          unnest(targets)::INT AS truth FROM predictions WHERE has_targets""",
    ),
    "target_counts": (
        ("target_scores",),
        """SELECT target_id, count(*) FILTER (truth = 1 AND logit >= 0) AS tp,
          count(*) FILTER (logit >= 0) AS pred, count(*) FILTER (truth = 1) AS truth
        FROM target_scores GROUP BY target_id""",
    ),
    "class_eval": (
        ("class_counts", "scored"),
        """SELECT 'val_accuracy_class' AS metric,
          (SELECT avg((label = p_class)::INT) FROM scored) AS value
        UNION ALL SELECT 'val_macro_f1_class', avg(CASE WHEN pred + truth > 0 THEN 2.0 * tp / (pred + truth) ELSE 0 END) FROM class_counts
        UNION ALL SELECT 'val_weighted_f1_class', sum(truth * CASE WHEN pred + truth > 0 THEN 2.0 * tp / (pred + truth) ELSE 0 END) / sum(truth) FROM class_counts""",
    ),
    "severity_eval": (
        ("level_counts", "scored"),
        """SELECT 'val_accuracy_severity' AS metric,
          (SELECT avg((severity = p_severity)::INT) FROM scored WHERE severity <> -100) AS value
        UNION ALL SELECT 'val_macro_f1_severity', avg(CASE WHEN pred + truth > 0 THEN 2.0 * tp / (pred + truth) ELSE 0 END) FROM level_counts
        UNION ALL SELECT 'val_num_severity_rows', (SELECT count(*) FROM scored WHERE severity <> -100)""",
    ),
    "target_lines": (
        ("target_counts",),
        f"""SELECT {_list(TARGET_NAMES)}[target_id + 1] AS name,
          CASE WHEN pred > 0 THEN 1.0 * tp / pred ELSE 0 END AS p,
          CASE WHEN truth > 0 THEN 1.0 * tp / truth ELSE 0 END AS r,
          CASE WHEN pred + truth > 0 THEN 2.0 * tp / (pred + truth) ELSE 0 END AS f FROM target_counts""",
    ),
    "target_eval": (
        ("target_lines", "target_scores"),
        """SELECT 'val_precision_target_' || name AS metric, p AS value FROM target_lines
        UNION ALL SELECT 'val_recall_target_' || name, r FROM target_lines
        UNION ALL SELECT 'val_f1_target_' || name, f FROM target_lines
        UNION ALL SELECT 'val_macro_f1_target', avg(f) FROM target_lines
        UNION ALL SELECT 'val_macro_precision_target', avg(p) FROM target_lines
        UNION ALL SELECT 'val_macro_recall_target', avg(r) FROM target_lines
        UNION ALL SELECT 'val_num_target_rows', count(DISTINCT row_id) FROM target_scores
        UNION ALL SELECT 'val_subset_accuracy_target', avg(ok::INT) FROM (
          SELECT bool_and((logit >= 0) = (truth = 1)) AS ok FROM target_scores GROUP BY row_id) s""",
    ),
    "level_lines": (
        ("level_counts",),
        f"""SELECT {_list(SEVERITY_NAMES)}[id + 1] AS level,
          CASE WHEN pred > 0 THEN 1.0 * tp / pred ELSE 0 END AS precision,
          CASE WHEN truth > 0 THEN 1.0 * tp / truth ELSE 0 END AS recall,
          CASE WHEN pred + truth > 0 THEN 2.0 * tp / (pred + truth) ELSE 0 END AS f1,
          truth AS support FROM level_counts""",
    ),
    "curve": (
        ("target_scores",),
        """SELECT target_id, logit, sum(n) OVER down AS pred, sum(pos) OVER down AS tp,
          sum(pos) OVER (PARTITION BY target_id) AS truth
        FROM (SELECT target_id, logit, count(*) AS n, sum(truth) AS pos
              FROM target_scores GROUP BY ALL) h
        WINDOW down AS (PARTITION BY target_id ORDER BY logit DESC)""",
    ),
    "best": (
        ("curve",),
        """SELECT target_id, 1 / (1 + exp(-logit)) AS score, f1, truth FROM (
          SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY f1 DESC, logit) AS rn
          FROM (SELECT *, 2.0 * tp / (pred + truth) AS f1 FROM curve) c) b WHERE rn = 1""",
    ),
    "class_weight": (
        ("predictions", "class_ids"),
        """SELECT id, w * 4 / sum(w) OVER () AS weight FROM (
          SELECT id, 1 / sqrt(greatest(count(*) FILTER (label = id), 1)) AS w
          FROM predictions CROSS JOIN class_ids GROUP BY id) c""",
    ),
    "target_weight": (
        ("target_scores",),
        """SELECT target_id, n, w * 8 / sum(w) OVER () AS weight FROM (
          SELECT target_id, sum(truth) AS n, 1 / sqrt(greatest(sum(truth), 1)) AS w
          FROM target_scores GROUP BY target_id) c""",
    ),
    "class_nll": (
        ("predictions",),
        """SELECT row_id, label, id, lse - x AS nll FROM (
          SELECT row_id, label, unnest(range(4)) AS id, unnest(class_logits)::DOUBLE AS x,
            ln(list_sum(list_transform(class_logits, lambda v: exp(v::DOUBLE)))) AS lse
          FROM predictions) u""",
    ),
    "class_terms": (
        ("class_nll", "class_weight"),
        """SELECT row_id, sum(CASE WHEN n.id = label THEN 0.95 * weight * nll ELSE 0 END)
            + 0.05 / 4 * sum(weight * nll) AS part,
          sum(CASE WHEN n.id = label THEN weight END) AS mass
        FROM class_nll n JOIN class_weight w ON n.id = w.id GROUP BY row_id""",
    ),
    "levels": (
        ("predictions",),
        """SELECT row_id, severity, (e[2] + 2 * e[3] + 3 * e[4]) / list_sum(e) AS expected FROM (
          SELECT *, list_transform(severity_logits, lambda v: exp(v::DOUBLE)) AS e
          FROM predictions) s""",
    ),
    "target_terms": (
        ("target_scores", "target_weight"),
        """SELECT row_id, avg(weight * (ln(1 + exp(logit)) - logit * s.truth)) AS part
        FROM target_scores s JOIN target_weight w ON s.target_id = w.target_id GROUP BY row_id""",
    ),
    "batch_losses": (
        ("class_terms", "levels", "target_terms"),
        """SELECT c.row_id // 32 AS batch_id, sum(c.part) / sum(mass) AS class,
          coalesce(avg(CASE WHEN severity <> -100 THEN (expected - severity) ** 2 END), 0) AS severity,
          coalesce(avg(t.part), 0) AS target
        FROM class_terms c JOIN levels l ON c.row_id = l.row_id
          LEFT JOIN target_terms t ON c.row_id = t.row_id GROUP BY ALL""",
    ),
    "evals": (
        ("run_log",),
        """SELECT run_id, epoch, step, event, val_macro_f1_class AS value FROM run_log
        WHERE event IN ('eval', 'epoch')""",
    ),
    "eval_best": (
        ("evals",),
        """SELECT *, max(value) OVER (PARTITION BY run_id ORDER BY epoch, step, event = 'epoch'
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_best FROM evals""",
    ),
    "epochs": (
        ("eval_best",),
        """SELECT run_id, epoch, max(value) AS top,
          bool_or(previous_best IS NULL OR value > previous_best) AS improved,
          row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS rank
        FROM eval_best GROUP BY run_id, epoch""",
    ),
    "idle": (
        ("epochs",),
        """SELECT *, rank - max(CASE WHEN improved THEN rank END) OVER (
            PARTITION BY run_id ORDER BY epoch) AS idle FROM epochs""",
    ),
    "stops": (
        ("idle",),
        """SELECT run_id, min(CASE WHEN idle >= 2 THEN epoch END) AS stop_epoch,
          count(*) AS epochs_logged FROM idle GROUP BY run_id""",
    ),
    "level_quantiles": (
        ("harmful",),
        """SELECT source, unnest([0.5, 0.75, 0.9, 0.95, 0.99]) AS q, unnest(v) AS value FROM (
          SELECT source, quantile_cont(severity_score::DOUBLE, [0.5, 0.75, 0.9, 0.95, 0.99]) AS v
          FROM harmful GROUP BY source) s""",
    ),
    "length_quantiles": (
        ("unified",),
        """SELECT unnest([0.5, 0.9, 0.95, 0.99]) AS q, unnest(v) AS value FROM (
          SELECT quantile_cont(length(text)::DOUBLE, [0.5, 0.9, 0.95, 0.99]) AS v
          FROM unified) s""",
    ),
    "head": (
        (),
        """SELECT vec_id, k, sum(x * (((k * 7 + j * 3) % 11 - 5) / 10.0)) AS y
        FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings) e
          CROSS JOIN (SELECT range AS k FROM range(16)) h GROUP BY vec_id, k""",
    ),
}


def sql(final: str, *names: str) -> str:
    """``final`` behind the WITH clauses that ``names`` need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in PARTS[name][0]:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return final
    # Each part is computed once, as the engine would not.
    clauses = ",\n".join(f"{name} AS MATERIALIZED ({PARTS[name][1].strip()})" for name in ordered)
    return f"WITH {clauses}\n{final}"


def _counts(values, column: str) -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS {v}" for v in values)


_TARGET_ARRAY_HEADS = _list(f"target_{name}" for name in TARGET_NAMES)
_FLAG_BIGINT = ", ".join(f"CAST({name} AS BIGINT) AS {name}" for name in FLAG_LABELS)
_MEANS = ", ".join(f"{_r(name)} AS {name}" for name in MEAN_SIGNALS)
_SOURCE = "uid, source, origin, source_id, text_raw, text, text_hash, is_short"
_LEVELS = (*SEVERITY_NAMES, "none")
_RAW_ANNOTATORS = ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in RATINGS)
_CLASS_ARRAY = _list(CLASS_NAMES)
_TARGET_ARRAY = _list(TARGET_NAMES)

_DUPLICATES = """sum(CASE WHEN is_duplicate THEN 1 ELSE 0 END)::BIGINT AS duplicate_rows,
  count(DISTINCT CASE WHEN is_duplicate THEN text_hash END) AS duplicate_groups,
  count(DISTINCT CASE WHEN label_conflict THEN text_hash END) AS conflicting_groups"""


def _unpivot(metric: str, key: str, names, source: str) -> str:
    return f"""SELECT '{metric}' AS metric, {key} AS key1, name AS key2,
      count(*) FILTER (what = name)::DOUBLE AS value
    FROM ({source}) s CROSS JOIN (SELECT unnest({_list(names)}) AS name) d GROUP BY 1, 2, 3"""


_STATS = f"""
SELECT 'total_rows' AS metric, '' AS key1, '' AS key2, count(*)::DOUBLE AS value FROM unified
UNION ALL {_unpivot("class_counts_by_source", "source", CLASS_NAMES, "SELECT source, label_name AS what FROM unified")}
UNION ALL {_unpivot("split_counts_by_source", "source", ("train", "val", "test"), "SELECT source, split AS what FROM unified")}
UNION ALL SELECT 'text_length_percentiles', (q * 100)::INT::VARCHAR, '', round(value, 6) FROM length_quantiles
UNION ALL SELECT 'duplicates', '', 'duplicate_rows', count(*) FILTER (is_duplicate) FROM unified
UNION ALL SELECT 'duplicates', '', 'duplicate_groups', count(DISTINCT text_hash) FILTER (is_duplicate) FROM unified
UNION ALL SELECT 'duplicates', '', 'conflicting_groups', count(DISTINCT text_hash) FILTER (label_conflict) FROM unified
UNION ALL SELECT 'target_group_counts', name, '', n FROM (
  {" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) FILTER ({t}) AS n FROM unified" for t in TARGET_COLUMNS)}) t
"""

_CALIBRATION = f"""
SELECT 'severity_score_quantiles' AS metric, source AS key1, (q * 100)::INT::VARCHAR AS key2, round(value, 6) AS value FROM level_quantiles
UNION ALL {_unpivot("severity_by_source", "source", _LEVELS, "SELECT source, severity_name AS what FROM harmful")}
UNION ALL {_unpivot("severity_by_class", "label_name", _LEVELS, "SELECT label_name, severity_name AS what FROM harmful")}
UNION ALL SELECT 'severity_share_overall', severity_name, '', round(count(*) / (SELECT count(*) FROM harmful), 6)
  FROM harmful GROUP BY severity_name
"""

_STEP_MEANS = ", ".join(
    f"round(avg(train_loss_{n}), 6) AS train_loss_{n}" for n in ("total", "class", "severity", "target")
)

_UNIFIED_OUT = f"""{_SOURCE}, CAST(label AS BIGINT) AS label, label_name, split, is_duplicate,
  dup_group_size, label_conflict, {", ".join(FLAG_SIGNALS)}, {_MEANS}, m_n_annotators,
  {", ".join(TARGET_COLUMNS)}"""


def oracle_sql() -> dict[str, str]:
    flags = "FROM raw_flags"
    return {
        "scan_flag_csv": sql(f"SELECT id, comment_text, {_FLAG_BIGINT} {flags}", "raw_flags"),
        "scan_annotators": sql(
            f"""SELECT comment_id, text, {_r("hate_speech_score")} AS hate_speech_score,
              {_RAW_ANNOTATORS}, {", ".join(RAW_TARGETS)} FROM annotator_rows""",
            "annotator_rows",
        ),
        "source_profile": sql(
            """SELECT 'flags' AS source, count(*) AS n_rows, count(DISTINCT id) AS n_keys FROM raw_flags
            UNION ALL SELECT 'annotators', count(*), count(DISTINCT comment_id) FROM annotator_rows""",
            "raw_flags",
            "annotator_rows",
        ),
        "first_valid_source": "SELECT 'documents' AS source, count(*) AS n_rows FROM documents",
        "sink_parquet": sql(f"SELECT id, comment_text, {_FLAG_BIGINT} {flags}", "raw_flags"),
        "sink_partitioned": sql(
            "SELECT uid, split, CAST(label AS BIGINT) AS label FROM unified", "unified"
        ),
        "materialize_cached": sql(
            f"""SELECT uid, origin, text_hash, {", ".join(FLAG_SIGNALS)} FROM labeled
            WHERE source = 'jigsaw'""",
            "labeled",
        ),
        "report_json": sql(_STATS, "unified", "length_quantiles"),
        "runlog_scan": sql(
            f"""SELECT run_id, event, epoch, step, round(val_macro_f1_class, 6) AS val_macro_f1_class,
              {", ".join(f"round(train_loss_{n}, 6) AS train_loss_{n}" for n in ("total", "class", "severity", "target"))}
            FROM run_log""",
            "run_log",
        ),
        # text
        "normalize_text": sql(
            "SELECT source_id AS id, text FROM cleaned WHERE source = 'jigsaw'", "cleaned"
        ),
        "mask_urls": sql(f"SELECT id, {_urls('comment_text')} AS text {flags}", "raw_flags"),
        "mask_mentions": sql(
            f"SELECT id, {_mentions('comment_text')} AS text {flags}", "raw_flags"
        ),
        "collapse_repeats": sql(
            f"""SELECT id, {_collapsed('ch')} AS text
            FROM (SELECT id, string_split(comment_text, '') AS ch {flags}) c""",
            "raw_flags",
        ),
        "text_hash": sql(f"SELECT id, {_hashed('comment_text')} AS text_hash {flags}", "raw_flags"),
        "make_uid": sql(f"SELECT id, sha1('jigsaw:' || id) AS uid {flags}", "raw_flags"),
        "text_columns": sql(
            """SELECT source_id AS id, text_raw, text, text_hash, is_short FROM rows
            WHERE source = 'jigsaw'""",
            "rows",
        ),
        # harmonising
        "flag_signals": sql(
            f"SELECT {_SOURCE}, {', '.join(FLAG_SIGNALS)} FROM labeled WHERE source = 'jigsaw'",
            "labeled",
        ),
        "annotator_signals": sql(
            f"""SELECT {_SOURCE}, {_MEANS}, m_n_annotators, {", ".join(TARGET_COLUMNS)}
            FROM labeled WHERE source = 'mhs'""",
            "labeled",
        ),
        "split_labeled": sql(
            f"SELECT id, CASE WHEN {_LABELS_LEAST} < 0 THEN 'unlabeled' ELSE 'labeled' END AS part {flags}",
            "raw_flags",
        ),
        "check_binary": sql(
            f"""SELECT count(*) FILTER (NOT ({" AND ".join(f"{n} IN (0, 1)" for n in FLAG_LABELS)})) AS invalid_rows
            {flags} WHERE {_LABELS_LEAST} >= 0""",
            "raw_flags",
        ),
        "join_test_labels": sql(
            f"""SELECT r.id, r.comment_text, {", ".join(f"CAST(l.{n} AS BIGINT) AS {n}" for n in FLAG_LABELS)}
            FROM raw_flags r LEFT JOIN flag_labels l ON r.id = l.id""",
            "raw_flags",
            "flag_labels",
        ),
        "join_unmatched": sql(
            "SELECT id FROM raw_flags WHERE id NOT IN (SELECT id FROM flag_labels)",
            "raw_flags",
            "flag_labels",
        ),
        "aggregate_annotators": sql(
            f"""SELECT source_id, text_raw, {_MEANS}, m_n_annotators, {", ".join(TARGET_COLUMNS)}
            FROM aggregated""",
            "aggregated",
        ),
        "text_conflicts": sql(
            """SELECT comment_id FROM annotator_rows GROUP BY comment_id
            HAVING count(DISTINCT text) > 1""",
            "annotator_rows",
        ),
        "check_conservation": sql(
            """SELECT count(DISTINCT comment_id) AS comments,
              (SELECT count(*) FROM aggregated) AS aggregated_rows,
              count(DISTINCT comment_id) - (SELECT count(*) FROM aggregated) AS difference
            FROM annotator_rows""",
            "annotator_rows",
            "aggregated",
        ),
        "combine_sources": sql(
            f"SELECT uid, source, label_name, j_toxic, {_r('m_insult')} AS m_insult, t_race FROM labeled",
            "labeled",
        ),
        "assemble_parts": sql(
            """SELECT uid, origin, source_id, text_hash, CASE WHEN labeled THEN j_toxic END AS j_toxic
            FROM rows WHERE source = 'jigsaw'""",
            "rows",
        ),
        # labels, duplicates, splits, schema
        "label_flags": sql(
            """SELECT uid, CAST(label AS BIGINT) AS label, label_name FROM labeled
            WHERE source = 'jigsaw'""",
            "labeled",
        ),
        "label_scores": sql(
            """SELECT uid, CAST(label AS BIGINT) AS label, label_name FROM labeled
            WHERE source = 'mhs'""",
            "labeled",
        ),
        "label_rank": sql("SELECT uid, CAST(3 - label AS BIGINT) AS rank FROM labeled", "labeled"),
        "class_distribution": sql(
            f"SELECT source, {_counts(CLASS_NAMES, 'label_name')} FROM labeled GROUP BY source",
            "labeled",
        ),
        "class_shares": sql(
            f"""SELECT {_CLASS_ARRAY}[id + 1] AS label_name, id AS position,
              count(*) FILTER (label = id) AS n,
              round(count(*) FILTER (label = id) / count(*), 6) AS share
            FROM labeled CROSS JOIN class_ids GROUP BY id""",
            "labeled",
            "class_ids",
        ),
        "weak_classes": sql(
            f"""SELECT {_CLASS_ARRAY}[id + 1] AS label_name FROM labeled CROSS JOIN class_ids
            GROUP BY id HAVING count(*) FILTER (label = id) / count(*) < 0.25""",
            "labeled",
            "class_ids",
        ),
        "dup_flags": sql(
            "SELECT uid, is_duplicate, dup_group_size, label_conflict FROM unified", "unified"
        ),
        "dup_stats": sql(f"SELECT {_DUPLICATES} FROM unified", "unified"),
        "dup_summary": sql(
            """SELECT text_hash, count(*) AS dup_group_size,
              list_sort(list_distinct(list(source))) AS sources,
              list_sort(list_distinct(list(label_name))) AS labels,
              bool_or(label_conflict) AS label_conflict
            FROM unified WHERE is_duplicate GROUP BY text_hash""",
            "unified",
        ),
        "laid_out_flags": sql(
            """SELECT uid, count(*) OVER t > 1 AS is_duplicate, count(*) OVER t AS dup_group_size,
              min(label_name) OVER t <> max(label_name) OVER t AS label_conflict
            FROM unified WINDOW t AS (PARTITION BY text_hash)""",
            "unified",
        ),
        "laid_out_stats": sql(
            """SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_rows,
              count(*) FILTER (n > 1) AS duplicate_groups, count(*) FILTER (labels > 1) AS conflicting_groups
            FROM (SELECT count(*) AS n, count(DISTINCT label_name) AS labels FROM unified GROUP BY text_hash) g""",
            "unified",
        ),
        "laid_out_summary": sql(
            """SELECT text_hash, count(*) AS dup_group_size,
              list_sort(list_distinct(list(source))) AS sources,
              list_sort(list_distinct(list(label_name))) AS labels,
              count(DISTINCT label_name) > 1 AS label_conflict
            FROM unified GROUP BY text_hash HAVING count(*) > 1""",
            "unified",
        ),
        "laid_out_leakage": sql(
            "SELECT text_hash FROM unified GROUP BY text_hash HAVING min(split) <> max(split)",
            "unified",
        ),
        "split_assign": sql("SELECT uid, split FROM unified", "unified"),
        "split_counts": sql(
            f"SELECT source, {_counts(('train', 'val', 'test'), 'split')} FROM unified GROUP BY source",
            "unified",
        ),
        "split_summary": sql(
            f"""SELECT source, label_name, {_counts(('train', 'val', 'test'), 'split')}
            FROM unified GROUP BY source, label_name""",
            "unified",
        ),
        "split_shares": sql(
            """SELECT split, round(count(*) / (SELECT count(*) FROM unified), 3) AS share
            FROM unified GROUP BY split""",
            "unified",
        ),
        "split_leakage": sql(
            "SELECT text_hash FROM unified GROUP BY text_hash HAVING count(DISTINCT split) > 1",
            "unified",
        ),
        "enforce_schema": sql(f"SELECT {_UNIFIED_OUT} FROM unified", "unified"),
        "validate_schema": sql(
            f"""SELECT {", ".join(f"count(*) FILTER ({n} IS NULL) AS null_{n}" for n in ("uid", "source", "text", "label", "label_name", "split"))},
              count(*) - count(DISTINCT uid) AS repeated_uid_rows FROM unified""",
            "unified",
        ),
        "length_percentiles": sql(
            "SELECT CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM length_quantiles",
            "length_quantiles",
        ),
        "target_counts": sql(
            " UNION ALL ".join(
                f"SELECT '{t}' AS target, count(*) FILTER ({t}) AS n FROM unified"
                for t in TARGET_COLUMNS
            ),
            "unified",
        ),
        "dataset_stats": sql(_STATS, "unified", "length_quantiles"),
        # severity
        "harmful_rows": sql("SELECT uid, label_name FROM labeled WHERE label <> 0", "labeled"),
        "severity_flags": sql(
            f"""SELECT uid, CAST({_POINTS} AS BIGINT) AS score, {_FLAG_LEVEL} AS level FROM labeled
            WHERE source = 'jigsaw'""",
            "labeled",
        ),
        "severity_scores": sql(
            f"""SELECT uid, {_SCORE_LEVEL} AS level, {_r(_SCORE_SUM)} AS score FROM labeled
            WHERE source = 'mhs'""",
            "labeled",
        ),
        "severity_derive": sql(
            f"""SELECT uid, CAST(severity AS BIGINT) AS severity,
              {_r("severity_score")} AS severity_score, severity_name FROM graded""",
            "graded",
        ),
        "severity_check": sql(
            f"""SELECT count(*) FILTER (label = 0 AND severity <> -100) AS neither_with_id,
              count(*) FILTER (label = 0 AND severity_name <> 'none') AS neither_with_name,
              {", ".join(f"CAST(count(*) FILTER (label <> 0 AND severity_name = '{n}') < 0.03 * count(*) FILTER (label <> 0) AS BIGINT) AS low_share_{n}" for n in SEVERITY_NAMES)}
            FROM graded""",
            "graded",
        ),
        "severity_quantiles": sql(
            "SELECT source, CAST(q AS DOUBLE) AS q, round(value, 6) AS value FROM level_quantiles",
            "level_quantiles",
        ),
        "severity_by_source": sql(
            f"SELECT source, {_counts(_LEVELS, 'severity_name')} FROM harmful GROUP BY source",
            "harmful",
        ),
        "severity_by_class": sql(
            f"SELECT label_name, {_counts(_LEVELS, 'severity_name')} FROM harmful GROUP BY label_name",
            "harmful",
        ),
        "severity_shares": sql(
            """SELECT severity_name, count(*) AS n,
              round(count(*) / (SELECT count(*) FROM harmful), 6) AS share
            FROM harmful GROUP BY severity_name""",
            "harmful",
        ),
        "calibration_report": sql(_CALIBRATION, "harmful", "level_quantiles"),
        # training rows, samples, batches
        "target_prepare": sql(
            f"""SELECT uid, t_race IS NOT NULL AS has_targets,
              [{", ".join(f"CASE WHEN {t} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for t in TARGET_COLUMNS)}] AS targets,
              {", ".join(f"CAST(coalesce({t}, false) AS BIGINT) AS {t}" for t in TARGET_COLUMNS)}
            FROM unified""",
            "unified",
        ),
        "build_vocab": sql("SELECT token, n, token_id FROM vocab", "vocab"),
        "tokenize": sql(
            f"""SELECT input_ids, list_transform(input_ids, lambda x: CAST(1 AS BIGINT)) AS attention_mask,
              CAST(label AS BIGINT) AS label, CAST(severity AS BIGINT) AS severity, source, uid, split,
              t_race IS NOT NULL AS has_targets, len(input_ids) AS length,
              {", ".join(f"CAST(coalesce({t}, false) AS BIGINT) AS {t}" for t in TARGET_COLUMNS)}
            FROM tokens""",
            "tokens",
        ),
        "tokenize_whole": sql(
            """SELECT g.uid, list_concat(list_concat([0], coalesce(c.codes, [])), [2]) AS input_ids,
              len(coalesce(c.codes, [])) + 2 AS length
            FROM graded g LEFT JOIN whole c ON g.uid = c.uid""",
            "graded",
            "whole",
        ),
        "sample_rows": sql(
            """SELECT uid, CAST(label AS BIGINT) AS label FROM labeled
            ORDER BY sha1('42|' || uid) LIMIT 500""",
            "labeled",
        ),
        "epoch_resample": sql(
            "SELECT uid, CAST(label AS BIGINT) AS label FROM resampled", "resampled"
        ),
        "sample_profile": sql(
            """SELECT count(*) AS num_examples, round(avg(has_targets::INT), 6) AS has_targets_share
            FROM resampled""",
            "resampled",
        ),
        "eval_sample": sql(
            """SELECT uid, CAST(severity AS BIGINT) AS severity FROM graded
            WHERE split = 'val' AND severity <> -100 ORDER BY sha1('42|' || uid) LIMIT 500""",
            "graded",
        ),
        "length_grouped": sql(
            """SELECT uid, mega AS mega_batch, position, position // 32 AS batch_id FROM (
              SELECT uid, mega, mega * 1600 + row_number() OVER (PARTITION BY mega
                ORDER BY length DESC, shuffled) - 1 AS position
              FROM (SELECT *, shuffled // 1600 AS mega FROM (
                SELECT uid, length, row_number() OVER (ORDER BY sha1('42|order|' || uid)) - 1 AS shuffled
                FROM train_rows) s) m) p""",
            "train_rows",
        ),
        "padded_batches": sql(
            """SELECT uid, batch_id, size AS padded_length,
              list_resize(input_ids, size, 1) AS input_ids,
              list_resize(list_transform(input_ids, lambda x: CAST(1 AS BIGINT)), size, 0) AS attention_mask
            FROM (SELECT *, CAST(ceil(max(len(input_ids)) OVER (PARTITION BY batch_id) / 8.0) * 8 AS BIGINT) AS size
                  FROM ordered_tokens) p""",
            "ordered_tokens",
        ),
        "class_weights": sql(
            f"""SELECT {_CLASS_ARRAY}[id + 1] AS label_name, n, round(w * 4 / sum(w) OVER (), 6) AS weight
            FROM (SELECT id, count(*) FILTER (label = id) AS n,
                    1 / sqrt(greatest(count(*) FILTER (label = id), 1)) AS w
                  FROM resampled_0 CROSS JOIN class_ids GROUP BY id) c""",
            "resampled_0",
            "class_ids",
        ),
        "target_weights": sql(
            f"""SELECT {_TARGET_ARRAY}[target_id + 1] AS target, CAST(n AS DOUBLE) AS n,
              round(weight, 6) AS weight FROM target_weight""",
            "target_weight",
        ),
        # metrics and losses
        "eval_class": sql(
            f"SELECT metric, {_r('value')} AS value FROM class_eval", "class_eval"
        ),
        "eval_severity": sql(
            f"SELECT metric, {_r('value')} AS value FROM severity_eval", "severity_eval"
        ),
        "eval_targets": sql(
            f"SELECT metric, {_r('value')} AS value FROM target_eval", "target_eval"
        ),
        "eval_all": sql(
            f"""SELECT metric, {_r('value')} AS value FROM (SELECT * FROM class_eval
            UNION ALL SELECT * FROM severity_eval UNION ALL SELECT * FROM target_eval) e""",
            "class_eval",
            "severity_eval",
            "target_eval",
        ),
        "severity_report": sql(
            f"""SELECT level, {_r('precision')} AS precision, {_r('recall')} AS recall,
              {_r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM (
              SELECT * FROM level_lines
              UNION ALL SELECT 'accuracy', a, a, a, n FROM (
                SELECT avg((severity = p_severity)::INT) AS a, count(*) AS n FROM scored WHERE severity <> -100) x
              UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM level_lines
              UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support),
                sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM level_lines) r""",
            "level_lines",
            "scored",
        ),
        "severity_confusion": sql(
            f"""SELECT {_list(SEVERITY_NAMES)}[id + 1] AS true_level,
              {", ".join(f"count(*) FILTER (severity = id AND p_severity = {j}) AS pred_{n}" for j, n in enumerate(SEVERITY_NAMES))}
            FROM scored CROSS JOIN class_ids GROUP BY id""",
            "scored",
            "class_ids",
        ),
        "severity_distance": sql(
            """SELECT kind, n, round(n / sum(n) OVER (), 6) AS share FROM (
              SELECT 'adjacent' AS kind, count(*) FILTER (abs(severity - p_severity) = 1) AS n
              FROM scored WHERE severity <> -100
              UNION ALL SELECT 'distant', count(*) FILTER (abs(severity - p_severity) > 1)
              FROM scored WHERE severity <> -100) k""",
            "scored",
        ),
        "severity_expected": sql("SELECT row_id, round(expected, 6) AS expected FROM levels", "levels"),
        "best_threshold": sql(
            f"""SELECT {_TARGET_ARRAY}[target_id + 1] AS target, round(score, 6) AS best_threshold,
              round(f1, 6) AS best_f1 FROM best""",
            "best",
        ),
        "threshold_table": sql(
            f"""SELECT {_TARGET_ARRAY}[b.target_id + 1] AS target, CAST(b.truth AS BIGINT) AS positives,
              round(2.0 * c.tp / (c.pred + c.truth), 6) AS flat_f1, round(score, 6) AS best_threshold,
              round(f1, 6) AS best_f1 FROM best b JOIN target_counts c ON b.target_id = c.target_id""",
            "best",
            "target_counts",
        ),
        "loss_class": sql(
            "SELECT round(sum(part) / sum(mass), 6) AS loss FROM class_terms", "class_terms"
        ),
        "loss_severity": sql(
            """SELECT round(avg((expected - severity) ** 2), 6) AS loss FROM levels
            WHERE severity <> -100""",
            "levels",
        ),
        "loss_target": sql("SELECT round(avg(part), 6) AS loss FROM target_terms", "target_terms"),
        "loss_total": sql(
            """SELECT round(avg(class), 6) AS class, round(avg(severity), 6) AS severity,
              round(avg(target), 6) AS target,
              round(avg(class + 0.5 * severity + 0.2 * target), 6) AS total FROM batch_losses""",
            "batch_losses",
        ),
        # training log
        "runlog_windows": sql(
            f"""SELECT 'window' AS kind, run_id, (step - 1) // 10 AS unit, count(*) AS n, {_STEP_MEANS}
            FROM run_log WHERE event = 'train_step' GROUP BY ALL
            UNION ALL SELECT 'epoch', run_id, epoch, count(*), {_STEP_MEANS}
            FROM run_log WHERE event = 'train_step' GROUP BY ALL""",
            "run_log",
        ),
        "runlog_best": sql(
            """SELECT run_id, epoch, step, event, round(value, 6) AS value,
              round(previous_best, 6) AS previous_best,
              previous_best IS NULL OR value > previous_best AS improved FROM eval_best""",
            "eval_best",
        ),
        "runlog_follow": sql(
            """SELECT run_id, epoch, step, event, round(value, 6) AS value,
              round(previous_best, 6) AS previous_best,
              previous_best IS NULL OR value > previous_best AS improved FROM eval_best""",
            "eval_best",
        ),
        "runlog_early_stop": sql(
            """SELECT i.run_id, max(stop_epoch) AS stop_epoch, count(*) AS epochs_run,
              max(epochs_logged) AS epochs_logged, round(max(top), 6) AS best_metric
            FROM idle i JOIN stops s ON i.run_id = s.run_id
            WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY i.run_id""",
            "idle",
            "stops",
        ),
        # heads
        "mean_pool": """SELECT label::BIGINT AS label, max(n) AS n, list(round(m, 6) ORDER BY j) AS mean
            FROM (SELECT label, j, count(*) AS n, avg(x) AS m FROM (
              SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings) e
              GROUP BY label, j) d GROUP BY label""",
        "masked_mean": """SELECT vec_id, list(round(m, 6) ORDER BY k) AS mean FROM (
            SELECT vec_id, j % 8 AS k,
              sum(CASE WHEN (vec_id + j // 8) % 3 <> 0 THEN x ELSE 0 END)
                / sum(CASE WHEN (vec_id + j // 8) % 3 <> 0 THEN 1 ELSE 0 END) AS m
            FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS j FROM embeddings) e
            GROUP BY vec_id, j % 8) d GROUP BY vec_id""",
        "linear_head": sql(
            """SELECT vec_id, list(round(y + k / 10.0, 6) ORDER BY k) AS scores FROM head
            WHERE k < 4 GROUP BY vec_id""",
            "head",
        ),
        "score_batches": sql(
            """SELECT vec_id,
              list(round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) ORDER BY k) FILTER (k < 4) AS class_logits,
              list(round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) ORDER BY k) FILTER (k BETWEEN 4 AND 7) AS severity_logits,
              list(round(CAST(CAST(y AS FLOAT) AS DOUBLE), 6) ORDER BY k) FILTER (k > 7) AS target_logits
            FROM head GROUP BY vec_id""",
            "head",
        ),
        "train_heads": sql(
            f"""SELECT head, n_train, n_val FROM (
              SELECT 'class' AS head, count(*) FILTER (part = 'train') AS n_train,
                count(*) FILTER (part = 'val') AS n_val,
                count(DISTINCT label) FILTER (part = 'train') AS answers FROM fitted
              UNION ALL
              SELECT 'severity', count(*) FILTER (part = 'train'), count(*) FILTER (part = 'val'),
                count(DISTINCT severity) FILTER (part = 'train') FROM fitted WHERE severity <> -100
              UNION ALL
              SELECT head, count(*) FILTER (part = 'train'), count(*) FILTER (part = 'val'),
                count(DISTINCT answer) FILTER (part = 'train') FROM (
                SELECT part, unnest({_TARGET_ARRAY_HEADS}) AS head,
                  unnest([{", ".join(f"coalesce({t}, false)" for t in TARGET_COLUMNS)}]) AS answer
                FROM fitted WHERE t_race IS NOT NULL) t GROUP BY head) h
            WHERE answers > 1""",
            "fitted",
        ),
        "source_fingerprint": f"""SELECT count(*) AS n_rows,
            sum({HEX_NUMBER.format("h")})::BIGINT AS first_sum,
            sum({HEX_NUMBER.format("substr(h, 9)")})::BIGINT AS second_sum
          FROM (SELECT md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(lang, ''),
            coalesce(source, ''), coalesce(text, ''))) AS h FROM documents) d""",
        "check_test_labels": sql(
            """SELECT count(*) FILTER (t > 1) AS repeated_texts, count(*) FILTER (l > 1) AS repeated_labels,
              count(*) FILTER (t > 0 AND l = 0) AS texts_without_labels
            FROM (SELECT id, sum(t) AS t, sum(l) AS l FROM (
              SELECT id, 1 AS t, 0 AS l FROM raw_flags
              UNION ALL SELECT id, 0, 1 FROM flag_labels) s GROUP BY id) k""",
            "raw_flags",
            "flag_labels",
        ),
    }
