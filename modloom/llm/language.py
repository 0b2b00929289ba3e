"""Language identification by Bayesian evidence fusion.

A text's language follows from four independent pieces of evidence: the likelihood of its byte
trigrams, the language that its markup declares, its address suffix, and its host. The priors of
host, site and suffix are smoothed one by the next, down to the share over everything; they are
counts of text-only decisions by host, summed by grouped aggregation, without the row's own one.

Trigram counts come from all labelled documents outside the held-out fifth. Their table has one
row of 65,536 counts per language, whatever the corpus. A task holds the table of ``AT_ONCE``
languages; where there are more, the texts are scored once for each such part.

Documents carry no markup: their host is their source. Defined results: null and empty texts have
no likelihood and rest on the other evidence; a null or odd address gives no host, site or suffix;
repeated rows each get their own result; without any labelled text the language is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.llm.tables import cut_lineage, held_out, text_of

BUCKETS = 1 << 16
#: Languages of one table, which bounds it to some 70 MB; more of them take several.
AT_ONCE = 256
#: Languages that a task counts before it hands its counts on.
COUNTED = 64
#: Added to every trigram count; most log odds that one text may bring; trust in a declaration.
SMOOTH, MOST_ODDS, DECLARED = 0.5, 30.0, 0.7
#: Pseudo-rows of the level below in each prior: site in host, suffix in site, all in suffix.
PRIOR_ROWS = 8.0
#: Parts that a hot host's rows are dealt to.
SALTS = 16
MARKUP = re.compile(r"(?s)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>")
LANG = r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})"


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of letters, lower case, runs of other characters as one space."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    letter = ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    raw = np.where(letter, raw, 32)
    raw = raw[(raw != 32) | np.concatenate([[True], raw[:-1] != 32])].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    code = (raw[:-2] * 65536 + raw[1:-1] * 256 + raw[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(16)).astype(np.int64)


def visible(html: str) -> str:
    return MARKUP.sub(" ", html)


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n, docs) over all rows; one row per language and bucket from each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                at = np.flatnonzero(own)
                yield pa.record_batch(
                    {"lang": pa.array([lang] * len(at), pa.string()), "bucket": pa.array(at), "n": pa.array(own[at])}
                )
            counts.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                own[:BUCKETS] += np.bincount(trigrams(text), minlength=BUCKETS)
                own[BUCKETS] += 1
                if len(counts) > COUNTED:
                    yield from emptied()
        yield from emptied()

    rows = docs.select(text_of().alias("text"), F.col("lang").cast("string").alias("lang"))
    made = rows.mapInArrow(count, "lang string, bucket long, n long")
    return made.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], DataFrame]:
    """(languages, trigram counts of each), from the labelled training rows."""
    rows = docs.filter(F.col("lang").isNotNull() & ~held_out("doc_id"))
    counts = cut_lineage(count_trigrams(rows), "language-counts")
    return sorted(row.lang for row in counts.filter(F.col("bucket") == BUCKETS).select("lang").collect()), counts


def likelihoods(counts: DataFrame, languages: list[str]) -> np.ndarray:
    """Log likelihood per bucket and language; AT_ONCE rows of BUCKETS numbers at most."""
    table = np.full((BUCKETS, len(languages)), SMOOTH)
    place = {lang: i for i, lang in enumerate(languages)}
    known = counts.filter(F.col("lang").isin(languages) & (F.col("bucket") < BUCKETS))
    packed = known.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    for row in packed.toLocalIterator():
        table[np.array(row.b, np.int64), place[row.lang]] += np.array(row.n, np.float64)
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def scored(rows: DataFrame, table: np.ndarray, name: str) -> DataFrame:
    """``rows`` with ``name``: the log likelihood of the text in each language of ``table``."""
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        for texts, html in batches:
            found = []
            for text, marked in zip(texts, html, strict=True):
                grams = trigrams(visible(text) if marked else text)
                odds = np.zeros(table.shape[1])
                # in parts, so that a long text does not need a row of the table for each gram
                for at in range(0, len(grams), 1 << 16):
                    odds += table[grams[at : at + (1 << 16)]].sum(axis=0, dtype=np.float64)
                found.append(odds)
            yield pd.Series(found)

    made = F.pandas_udf(score, "array<double>")
    return rows.withColumn(name, made("text", "is_html"))


def with_likelihood(rows: DataFrame, languages: list[str], counts: DataFrame) -> DataFrame:
    """``rows`` (``text``, ``is_html``, others) with ``odds``: log likelihoods, the best one 0, in place of the text.

    Each AT_ONCE languages take a pass of their own, so no task holds the tables of all.
    """
    parts = []
    for first in range(0, len(languages), AT_ONCE):
        if parts:
            rows = cut_lineage(rows, "language-part")
        parts.append(f"odds_{first}")
        rows = scored(rows, likelihoods(counts, languages[first : first + AT_ONCE]), parts[-1])
    every = F.concat(*parts) if parts else F.array().cast("array<double>")
    rows = rows.withColumn("odds", every).drop("text", "is_html", *parts)
    best = F.array_max("odds")
    return rows.withColumn("odds", F.transform("odds", lambda x: F.greatest(x - best, F.lit(-MOST_ODDS))))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def _shares(counts: DataFrame, key: str, languages: int) -> DataFrame:
    return counts.groupBy(key).agg(F.array(*(F.sum(F.col("votes")[i]) for i in range(languages))).alias(f"{key}_votes"))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``rows`` with ``language`` and ``confidence``; they hold odds, host, site, suffix, declared."""
    n = len(languages)
    if not n:
        return rows.withColumns(
            {"language": F.lit(None).cast("string"), "confidence": F.lit(0.0), "text_language": F.lit(None).cast("string")}
        )
    names = F.array(*map(F.lit, languages))
    best = F.array_position("odds", F.array_max("odds")).cast("int") - 1
    # a text without evidence has equal odds and votes for nothing
    decided = F.array_max("odds") > F.array_min("odds") if n > 1 else F.lit(True)
    vote = F.when(decided, best)
    rows = rows.withColumn("vote", vote)
    counts = cut_lineage(
        rows.groupBy("host", "site", "suffix").agg(
            F.array(*(F.count(F.when(F.col("vote") == i, 1)).cast("double") for i in range(n))).alias("votes")
        ),
        "language-hosts",
    )
    sites, suffixes = (_shares(counts.filter(F.col(k).isNotNull()), k, n) for k in ("site", "suffix"))
    every = counts.agg(F.array(*(F.sum(F.col("votes")[i]) for i in range(n))).alias("votes")).first()["votes"]
    total = F.array(*(F.lit(float(x or 0.0)) for x in (every or [0.0] * n)))
    levels = counts.filter("host IS NOT NULL").join(sites, "site", "left").join(suffixes, "suffix", "left")
    levels = levels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    levels = cut_lineage(
        levels.select(F.col("host").alias("l_host"), F.col("salt").alias("l_salt"), F.col("votes").alias("host_votes"), "site_votes", "suffix_votes"),
        "language-levels",
    )
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "odds"), F.lit(SALTS)).cast("int"))
    joined = salted.join(levels, (F.col("host") == F.col("l_host")) & (F.col("salt") == F.col("l_salt")), "left")

    # Arrays over the languages throughout: the plan is as large for 200 of them as for four.
    def own(i: Column) -> Column:
        return F.when(F.col("vote") == i, 1.0).otherwise(0.0)

    any_own = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
    none = F.array_repeat(F.lit(0.0), n)

    def smoothed(name: str, below: Column) -> Column:
        votes = F.coalesce(F.col(name), none)
        seen = F.greatest(F.aggregate(votes, F.lit(0.0), lambda s, x: s + x) - any_own, F.lit(0.0))
        return F.transform(
            below,
            lambda p, i: (F.greatest(votes[i] - own(i), F.lit(0.0)) + PRIOR_ROWS * p) / (seen + PRIOR_ROWS),
        )

    joined = joined.withColumn("every_votes", total).withColumn("prior", F.array_repeat(F.lit(1.0 / n), n))
    for name in ("every_votes", "suffix_votes", "site_votes", "host_votes"):
        joined = joined.withColumn("prior", smoothed(name, F.col("prior")))
    known = F.coalesce(F.array_contains(names, F.col("declared")), F.lit(False))

    def said(i: Column) -> Column:
        other = (1 - DECLARED) / max(n - 1, 1)
        return F.when(~known, 1.0 / n).when(F.get(names, i) == F.col("declared"), DECLARED).otherwise(other)

    # Value and place in one, so that neither is worked out twice; ties go to the first language.
    ranked = F.transform(
        "prior",
        lambda p, i: F.struct(
            (F.get(F.col("odds"), i) + F.log(p) + F.log(said(i))).alias("log"), (-i).alias("nr")
        ),
    )
    scored = joined.withColumn("ranked", ranked).withColumn("best", F.array_max("ranked"))
    mass = F.aggregate(
        F.transform("ranked", lambda x: F.exp(x["log"] - F.col("best.log"))), F.lit(0.0), lambda s, x: s + x
    )
    return scored.withColumns(
        {
            "language": F.get(names, -F.col("best.nr")),
            "confidence": 1.0 / mass,
            "text_language": F.get(names, F.col("vote")),
        }
    )


def language_report(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, doc_id, page_id, declared, language, text_language, confidence, held_out) for all rows.

    ``kind`` is 'page' or 'document'; the other table's id is null.
    """
    languages, counts = fit(docs)
    host = host_of(F.col("url"))
    page_rows = pages.select(
        F.col("page_id").alias("id"),
        F.lit("page").alias("kind"),
        host.alias("host"),
        F.nullif(F.lower(F.regexp_extract(text_of("html"), LANG, 1)), F.lit("")).alias("declared"),
        text_of("html").alias("text"),
        F.lit(True).alias("is_html"),
    )
    doc_rows = docs.select(
        F.col("doc_id").alias("id"),
        F.lit("document").alias("kind"),
        F.concat(F.lit("source:"), F.col("source").cast("string")).alias("host"),
        F.lit(None).cast("string").alias("declared"),
        text_of().alias("text"),
        F.lit(False).alias("is_html"),
    )
    found = cut_lineage(with_likelihood(page_rows.unionByName(doc_rows), languages, counts), "language-odds")
    named = found.withColumns(
        {"site": site_of(F.col("host")), "suffix": F.when(F.col("kind") == "page", F.substring_index("host", ".", -1))}
    )
    fused = fuse(named, languages)
    return fused.select(
        "kind",
        F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"),
        F.when(F.col("kind") == "page", F.col("id")).alias("page_id"),
        "declared",
        "language",
        "text_language",
        F.round("confidence", 6).alias("confidence"),
        F.when(F.col("kind") == "document", held_out("id")).alias("held_out"),
    )
