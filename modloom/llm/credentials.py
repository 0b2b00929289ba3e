"""Secret scans: base kinds, and multipart credentials linked inside a scope.

Base spans are assignments, access identifiers and hex runs. Weak parts (log-in names, long mixed
runs, endpoints) count only with their complement: an interval join inside the row looks for the
nearest identifier and the nearest secret within ``SCOPE`` code points. A weak secret needs an
identifier, a log-in name needs a secret, an endpoint needs both.

One projection, no shuffle, no Python. Defined results: a null text is empty; an empty text has no
spans and the digest of nothing; repeated rows each get their own result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.llm.arrays import largest_before, let, spans
from modloom.llm.tables import free_name, text_of

# The base patterns, with either case spelled out.
NAMES = (
    "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    "|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
)
ASSIGN = rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24
#: The same spans without the short runs, of which a long text holds one per word: both patterns
#: take whole runs, so a run that fails holds no other match.
LONG_ACCESS = f"AKIA[A-Z0-9]{{{ACCESS_LENGTH - 4},}}"
LONG_HEX = f"[0-9a-f]{{{HEX_LENGTH},}}"

LOGIN_NAMES = (
    "[Uu][Ss][Ee][Rr](?:_?[Nn][Aa][Mm][Ee])?|[Ll][Oo][Gg][Ii][Nn]"
    "|[Cc][Ll][Ii][Ee][Nn][Tt]_?[Ii][Dd]|[Aa][Cc][Cc][Oo][Uu][Nn][Tt](?:_?[Ii][Dd])?"
)
LOGIN = rf"""(?:{LOGIN_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{{3,}}"""
WEAK = "[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?:https?|postgres(?:ql)?|mysql|redis|amqp|mongodb)://[A-Za-z0-9.:@/?&=_%~+-]+"""
KINDS = ("assign", "access", "hex", "endpoint", "login", "weak")
BASE_KINDS = 3
#: Code points between the parts of one credential.
SCOPE = 240
MASK = "[secret]"

NONE = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _kind(text: Column, kind: str, pattern: str, keep, gate: Column, group=None) -> Column:
    """Spans of one kind as array<struct<start,kind,end>>, where the gate is open."""
    number = F.lit(KINDS.index(kind))
    found = F.transform(
        F.filter(spans(text, pattern, group), keep),
        lambda s: F.struct(s["start"].alias("start"), number.alias("kind"), s["end"].alias("end")),
    )
    return F.when(gate, found).otherwise(F.expr(NONE))


def base_spans(text: Column) -> Column:
    """All base spans by start, then kind."""
    return F.sort_array(
        F.concat(
            _kind(
                text,
                "assign",
                ASSIGN,
                lambda s: s["inner"] >= ASSIGN_LENGTH,
                F.rlike(text, F.lit(f"(?:{NAMES})[\"']?\\x20*[:=]")),
                2,
            ),
            _kind(
                text,
                "access",
                LONG_ACCESS,
                lambda s: F.lit(True),
                F.contains(text, F.lit("AKIA")),
            ),
            _kind(
                text,
                "hex",
                LONG_HEX,
                lambda s: F.lit(True),
                F.rlike(text, F.lit(f"[0-9a-f]{{{HEX_LENGTH}}}")),
            ),
        )
    )


def _mixed(text: Column):
    """A weak run counts as key material only if it mixes both cases and digits."""

    def keep(span: Column) -> Column:
        run = F.substring(text, span["start"] + 1, span["end"] - span["start"])
        return F.rlike(run, F.lit("[a-z]")) & F.rlike(run, F.lit("[A-Z]")) & F.rlike(run, F.lit("[0-9]"))

    return keep


def _near(parts: Column, wanted: tuple[str, ...]) -> Column:
    """For each part, by start, whether one of the wanted kinds lies within the scope.

    The nearest one before ends last among those before; the nearest one after starts first
    among those after, which is the largest negative start in reversed order.
    """
    kinds = [KINDS.index(k) for k in wanted]
    far = 1 << 30

    def ends(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.when(p["kind"].isin(kinds), p["end"]).otherwise(-1))

    def starts(parts: Column) -> Column:
        return F.transform(
            F.reverse(parts),
            lambda p: F.when(p["kind"].isin(kinds), far - p["start"]).otherwise(-1),
        )

    both = F.struct(
        largest_before(ends(parts)).alias("before"),
        F.reverse(largest_before(starts(parts))).alias("after"),
    )
    return let(
        both,
        lambda b: F.transform(
            parts,
            lambda p, i: ((b["before"][i] >= 0) & (p["start"] - b["before"][i] <= SCOPE))
            | ((b["after"][i] >= 0) & (far - b["after"][i] - p["end"] <= SCOPE)),
        ),
    )


def _free(parts: Column) -> Column:
    """Drops weak runs and log-ins that overlap a base span, which says the same already.

    An endpoint stays: a base span inside it is only a part of it.
    """

    def ends(parts: Column) -> Column:
        return F.transform(parts, lambda p: F.when(p["kind"] < BASE_KINDS, p["end"]).otherwise(-1))

    def starts(parts: Column) -> Column:
        return F.transform(
            F.reverse(parts),
            lambda p: F.when(p["kind"] < BASE_KINDS, (1 << 30) - p["start"]).otherwise(-1),
        )

    both = F.struct(
        largest_before(ends(parts)).alias("before"),
        F.reverse(largest_before(starts(parts))).alias("after"),
    )
    return let(
        both,
        lambda b: F.filter(
            parts,
            lambda p, i: (p["kind"] < BASE_KINDS)
            | (p["kind"] == KINDS.index("endpoint"))
            | ((b["before"][i] <= p["start"]) & ((1 << 30) - b["after"][i] >= p["end"])),
        ),
    )


def link(parts: Column) -> Column:
    """Base spans, and the weak parts whose complement lies within the scope."""

    def of(parts: Column) -> Column:
        near = F.struct(
            _near(parts, ("access", "login")).alias("identifier"),
            _near(parts, ("assign", "hex", "weak")).alias("secret"),
        )

        def keep(near: Column) -> Column:
            return F.filter(
                parts,
                lambda p, i: F.when(p["kind"] < BASE_KINDS, True)
                .when(p["kind"] == KINDS.index("weak"), near["identifier"][i])
                .when(p["kind"] == KINDS.index("login"), near["secret"][i])
                .otherwise(near["identifier"][i] & near["secret"][i]),
            )

        return let(near, keep)

    return let(let(parts, _free), of)


def all_spans(text: Column) -> Column:
    """Base and linked spans of a text by start, then kind."""

    def of(text: Column) -> Column:
        identifier = F.rlike(text, F.lit(f"AKIA|(?:{LOGIN_NAMES})[\"']?\\x20*[:=]"))
        weak = F.concat(
            _kind(text, "endpoint", ENDPOINT, lambda s: F.lit(True), F.contains(text, F.lit("://"))),
            _kind(text, "login", LOGIN, lambda s: F.lit(True), F.lit(True)),
            _kind(text, "weak", WEAK, _mixed(text), F.lit(True)),
        )
        return let(
            base_spans(text),
            lambda base: F.when(identifier, link(F.sort_array(F.concat(base, weak)))).otherwise(base),
        )

    return let(text, of)


def scan(docs: DataFrame, name: str = "secrets") -> DataFrame:
    """``docs`` with ``name``: array<struct<start,kind,end>>, kind as a place in ``KINDS``."""
    return docs.withColumn(name, all_spans(text_of()))


def masked(text: Column, found: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by ``MASK``."""

    def of(found: Column) -> Column:
        def build(reach: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                done = F.greatest(reach[i], F.lit(0))
                between = F.substring(text, done + 1, s["start"] - done)
                return F.when(s["start"] >= reach[i], F.concat(between, F.lit(MASK))).otherwise("")

            tail = F.greatest(reach[F.size(found) - 1], found[F.size(found) - 1]["end"])
            return F.concat(
                F.array_join(F.transform(found, piece), ""),
                F.substring(text, tail + 1, F.length(text)),
            )

        return F.when(F.size(found) == 0, text).otherwise(
            let(largest_before(F.transform(found, lambda s: s["end"])), build)
        )

    return let(found, of)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``; ``n_chars`` follows where it exists."""
    name = free_name(docs, "secrets")
    clean = F.size(name) == 0
    text = F.when(clean, F.col("text")).otherwise(masked(F.col("text"), F.col(name)))
    found = scan(docs, name).withColumn("text", text)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        found = found.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(length))
    return found.drop(name)


def secret_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans)."""
    names = F.array(*map(F.lit, KINDS))

    def listed(found: Column) -> Column:
        return F.array_join(
            F.transform(
                found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    base = F.filter("secrets", lambda s: s["kind"] < BASE_KINDS)

    def of_kind(number: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == number)).cast("long")

    counts = {f"n_{kind}": of_kind(k) for k, kind in enumerate(KINDS[:BASE_KINDS])}
    return scan(docs).select(
        "doc_id",
        *(column.alias(name) for name, column in counts.items()),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )


def oracle() -> str:
    """The report in DuckDB SQL, every short run matched and dropped as the base kinds say."""

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def matched(kind: str, pattern: str, inner: int, least: int, more: str = "TRUE") -> str:
        return rf"""
SELECT nr, {KINDS.index(kind)} AS kind, b, e FROM (
  SELECT nr, text, list_sum(gaps[1:i]) + coalesce(list_sum(found[1:i - 1]), 0) AS b,
    list_sum(gaps[1:i]) + list_sum(found[1:i]) AS e, parts[i] AS n FROM (
    SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (
      SELECT nr, text,
        list_transform(regexp_extract_all(text, {quoted(pattern)}), lambda x: length(x)) AS found,
        list_transform(regexp_extract_all(text, {quoted(pattern)}, {inner}), lambda x: length(x)) AS parts,
        list_transform(string_split_regex(text, {quoted(pattern)}), lambda x: length(x)) AS gaps
      FROM docs WHERE regexp_matches(text, {quoted(pattern)})))
  WHERE parts[i] >= {least})
WHERE {more}"""

    mixed = " AND ".join(
        f"regexp_matches(substr(text, b::BIGINT + 1, (e - b)::BIGINT), '[{c}]')" for c in ("a-z", "A-Z", "0-9")
    )
    kinds = {k: KINDS.index(k) for k in KINDS}

    def near(*wanted: str) -> str:
        return (
            f"EXISTS (SELECT 1 FROM free o WHERE o.nr = s.nr AND o.kind IN ({', '.join(str(kinds[k]) for k in wanted)})"
            f" AND (o.b, o.kind, o.e) <> (s.b, s.kind, s.e)"
            f" AND o.b - s.e <= {SCOPE} AND s.b - o.e <= {SCOPE})"
        )

    names = ", ".join(f"'{k}'" for k in KINDS)
    listed = f"string_agg(([{names}])[kind + 1] || ':' || b::BIGINT || ':' || e::BIGINT, ',' ORDER BY b, kind)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
base AS ({matched("assign", ASSIGN, 2, ASSIGN_LENGTH)}
UNION ALL {matched("access", ACCESS, 0, ACCESS_LENGTH)}
UNION ALL {matched("hex", HEX, 0, HEX_LENGTH)}),
weak AS ({matched("endpoint", ENDPOINT, 0, 1)}
UNION ALL {matched("login", LOGIN, 0, 1)}
UNION ALL {matched("weak", WEAK, 0, 1, mixed)}),
free AS (
  SELECT * FROM base UNION ALL
  SELECT * FROM weak w WHERE kind = {kinds["endpoint"]} OR NOT EXISTS (SELECT 1 FROM base o WHERE o.nr = w.nr AND o.b < w.e AND o.e > w.b)
), kept AS (
  SELECT * FROM free s WHERE CASE WHEN kind < {BASE_KINDS} THEN TRUE
    WHEN kind = {kinds["weak"]} THEN {near("access", "login")}
    WHEN kind = {kinds["login"]} THEN {near("assign", "hex", "weak")}
    ELSE {near("access", "login")} AND {near("assign", "hex", "weak")} END
), per_doc AS (
  SELECT nr, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS c,
    count(*) FILTER (kind = 2) AS h, {listed} AS spans,
    {listed} FILTER (kind < {BASE_KINDS}) AS base
  FROM kept GROUP BY nr
)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access,
  coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM docs LEFT JOIN per_doc USING (nr)
"""
