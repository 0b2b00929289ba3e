"""License scans: ordered signature rules behind a keyword check.

A rule is tried only if the document holds the rule's keyword, a literal of every match. Words of
a rule may stand on different lines, with comment marks between them. Detections lie in four ranks: tag, grant or notice, address, name. A
detection whose interval lies inside that of another of equal or better rank is suppressed.

Everything is one projection: no shuffle, no Python. Defined results: a null text is empty; an
empty text has no words, no labels and score 0; repeated rows each get their own result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modloom.llm.arrays import LOWER, UPPER, largest_before, let, lower_ascii, spans
from modloom.llm.tables import text_of

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_LOWERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base labels.
BASE = (
    (("mit", "license"), "mit"),
    (("apache", "license"), "apache"),
    (("general", "public", "license"), "gpl"),
)
TAG, GRANT, ADDRESS, NAME = 1, 2, 3, 4
#: How sure a detection of each rank is; a base phrase alone counts as a name.
SCORES = (1.0, 0.9, 0.8, 0.6)

V = r"[ ,]{0,2}(?:version )?v? ?"
#: (label, keyword, name, address or None, notice phrase or None). Names follow a non-letter.
FAMILIES = (
    ("mit", "mit", r"(?:the )?mit licen[sc]e", r"opensource\.org/licenses/mit", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-0", "mit", r"mit no attribution(?: licen[sc]e)?", r"github\.com/aws/mit-0", None),
    ("apache-1.1", "apache", r"apache (?:software )?licen[sc]e" + V + r"1\.1", r"apache\.org/licenses/license-1\.1", None),
    ("apache-2.0", "apache", r"apache (?:software )?licen[sc]e" + V + r"2(?:\.0)?", r"apache\.org/licenses/license-2\.0", r"you may not use this file except in compliance with the licen[sc]e"),
    ("gpl-1.0", "general public", r"(?:gnu )?general public licen[sc]e" + V + r"1(?:\.0)?", r"gnu\.org/licenses/old-licenses/gpl-1\.0", None),
    ("gpl-2.0", "general public", r"(?:gnu )?general public licen[sc]e" + V + r"2(?:\.0)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0", r"either version 2 of the licen[sc]e, or \(at your option\) any later version"),
    ("gpl-3.0", "general public", r"(?:gnu )?general public licen[sc]e" + V + r"3(?:\.0)?", r"gnu\.org/licenses/gpl-3\.0", r"either version 3 of the licen[sc]e, or \(at your option\) any later version"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e" + V + r"2\.1", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1", None),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e" + V + r"3(?:\.0)?", r"gnu\.org/licenses/lgpl-3\.0", None),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?:" + V + r"3(?:\.0)?)?", r"gnu\.org/licenses/agpl-3\.0", None),
    ("gfdl-1.3", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?:" + V + r"1\.[1-3])?", r"gnu\.org/licenses/fdl", r"no invariant sections, no front-cover texts"),
    ("bsd-2-clause", "bsd", r"(?:2|two)[- ]clause bsd(?: licen[sc]e)?|simplified bsd licen[sc]e", r"opensource\.org/licenses/bsd-2-clause", None),
    ("bsd-3-clause", "bsd", r"(?:3|three)[- ]clause bsd(?: licen[sc]e)?|(?:new|modified) bsd licen[sc]e", r"opensource\.org/licenses/bsd-3-clause", None),
    ("bsd-4-clause", "bsd", r"(?:4|four)[- ]clause bsd(?: licen[sc]e)?|original bsd licen[sc]e", None, None),
    ("bsd", "bsd", r"(?:the )?bsd(?:-style)? licen[sc]e", None, r"redistribution and use in source and binary forms, with or without modification"),
    ("isc", "isc", r"isc licen[sc]e", r"opensource\.org/licenses/isc", r"permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e" + V + r"1\.1", r"mozilla\.org/mpl/1\.1", None),
    ("mpl-2.0", "mozilla", r"mozilla public licen[sc]e(?:" + V + r"2(?:\.0)?)?", r"mozilla\.org/mpl/2\.0", r"subject to the terms of the mozilla public licen[sc]e"),
    ("epl-1.0", "eclipse", r"eclipse public licen[sc]e" + V + r"1(?:\.0)?", r"eclipse\.org/legal/epl-v10", None),
    ("epl-2.0", "eclipse", r"eclipse public licen[sc]e(?:" + V + r"2(?:\.0)?)?", r"eclipse\.org/legal/epl-(?:2\.0|v20)", None),
    ("cddl-1.0", "common development", r"common development and distribution licen[sc]e(?:" + V + r"1(?:\.[01])?)?", r"opensource\.org/licenses/cddl", None),
    ("cpl-1.0", "common public", r"common public licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"opensource\.org/licenses/cpl", None),
    ("eupl-1.2", "european union", r"european union public licen[sc]e(?:" + V + r"1\.[12])?", r"joinup\.ec\.europa\.eu/[a-z/]*eupl", None),
    ("artistic-1.0", "artistic", r"artistic licen[sc]e" + V + r"1(?:\.0)?", r"opensource\.org/licenses/artistic-1\.0", None),
    ("artistic-2.0", "artistic", r"artistic licen[sc]e(?:" + V + r"2(?:\.0)?)?", r"opensource\.org/licenses/artistic-2\.0", None),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"opensource\.org/licenses/zlib", r"provided 'as-is', without any express or implied warranty"),
    ("bsl-1.0", "boost", r"boost software licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"boost\.org/license_1_0", None),
    ("busl-1.1", "business source", r"business source licen[sc]e(?:" + V + r"1\.1)?", r"mariadb\.com/bsl11", None),
    ("sspl-1.0", "server side", r"server side public licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"mongodb\.com/licensing/server-side-public-license", None),
    ("elastic-2.0", "elastic", r"elastic licen[sc]e(?:" + V + r"2(?:\.0)?)?", r"elastic\.co/licensing/elastic-license", None),
    ("unlicense", "unlicense", r"the unlicense", r"unlicense\.org", r"free and unencumbered software released into the public domain"),
    ("wtfpl", "do what", r"do what the f[a-z*]{3} you want to public licen[sc]e", r"wtfpl\.net", None),
    ("psf-2.0", "python", r"python (?:software foundation )?licen[sc]e(?:" + V + r"2(?:\.0)?)?", r"docs\.python\.org/[0-9/]*license", None),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", r"opensource\.org/licenses/postgresql", None),
    ("ofl-1.1", "open font", r"sil open font licen[sc]e(?:" + V + r"1\.1)?", r"scripts\.sil\.org/ofl", None),
    ("odbl-1.0", "database", r"open (?:data commons open )?database licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"opendatacommons\.org/licenses/odbl", None),
    ("odc-by-1.0", "open data commons", r"open data commons attribution licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"opendatacommons\.org/licenses/by", None),
    ("pddl-1.0", "public domain", r"public domain dedication and licen[sc]e(?:" + V + r"1(?:\.0)?)?", r"opendatacommons\.org/licenses/pddl", None),
    ("cc0-1.0", "cc0", r"cc0(?:[ -]1\.0)?(?: universal)?", r"creativecommons\.org/publicdomain/zero", r"waived all copyright and related or neighboring rights"),
    ("public-domain", "public domain", r"(?:in|into) the public domain", r"creativecommons\.org/publicdomain/mark", r"dedicated to the public domain"),
    ("cc-by-3.0", "cc", r"cc[ -]by[ -]3\.0", r"creativecommons\.org/licenses/by/3\.0", None),
    ("cc-by-4.0", "cc", r"cc[ -]by[ -]4\.0", r"creativecommons\.org/licenses/by/4\.0", None),
    ("cc-by-sa-3.0", "cc", r"cc[ -]by-sa[ -]3\.0", r"creativecommons\.org/licenses/by-sa/3\.0", None),
    ("cc-by-sa-4.0", "cc", r"cc[ -]by-sa[ -]4\.0", r"creativecommons\.org/licenses/by-sa/4\.0", None),
    ("cc-by-nc-3.0", "cc", r"cc[ -]by-nc[ -]3\.0", r"creativecommons\.org/licenses/by-nc/3\.0", None),
    ("cc-by-nc-4.0", "cc", r"cc[ -]by-nc[ -]4\.0", r"creativecommons\.org/licenses/by-nc/4\.0", None),
    ("cc-by-nd-4.0", "cc", r"cc[ -]by-nd[ -]4\.0", r"creativecommons\.org/licenses/by-nd/4\.0", None),
    ("cc-by-nc-sa-4.0", "cc", r"cc[ -]by-nc-sa[ -]4\.0", r"creativecommons\.org/licenses/by-nc-sa/4\.0", None),
    ("cc-by-nc-nd-4.0", "cc", r"cc[ -]by-nc-nd[ -]4\.0", r"creativecommons\.org/licenses/by-nc-nd/4\.0", None),
    ("cc-by", "attribution", r"creative commons attribution(?: (?:licen[sc]e|[1-4]\.0))?", None, None),
    ("cc-by-sa", "attribution", r"creative commons attribution[- ]share[- ]?alike(?: [1-4]\.0)?", None, None),
    ("cc-by-nc", "attribution", r"creative commons attribution[- ]non-?commercial(?: [1-4]\.0)?", None, None),
    ("openrail", "rail", r"(?:creativeml |bigscience )?open ?rail(?:-?[ms]{1,2})?(?: licen[sc]e)?", None, None),
    ("llama-community", "llama", r"llama [23](?:\.[0-9])? community licen[sc]e", r"ai\.meta\.com/llama/license", None),
    ("all-rights-reserved", "copyright", r"copyright (?:\(c\) )?[0-9]{4}[^\n]{0,60}all rights reserved", None, r"unauthorized (?:copying|reproduction) of this (?:file|work) is strictly prohibited"),
    ("proprietary", "licen", r"commercial licen[sc]e agreement|end[- ]user licen[sc]e agreement", None, r"this software is proprietary and confidential"),
)
GRANTED = r"(?:licen[sc]ed|released|distributed|available|published|covered|provided) (?:under|by) (?:the )?(?:terms of )?(?:the )?"


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, pattern, rank) in order, for lower-cased text."""
    found = []
    for label, keyword, name, address, notice in FAMILIES:
        tag = label.replace(".", r"\.")
        found.append((label, "spdx", rf"spdx-license-identifier:? {{0,4}}{tag}", TAG))
        found.append((label, keyword, rf"{GRANTED}(?:{name})", GRANT))
        if notice:
            found.append((label, notice.split()[0].strip("(?:"), notice, GRANT))
        if address:
            found.append((label, address.split(r"\.")[0], address, ADDRESS))
        found.append((label, keyword, rf"(?:^|[^a-z0-9])(?:{name})", NAME))
    return [(label, _plain(word), pattern, rank) for label, word, pattern, rank in found]


def _plain(word: str) -> str:
    """A keyword that needs no choice between letters: cut at the first special character."""
    cut = min((word.find(c) for c in "([|?*" if c in word), default=len(word))
    return word[:cut]


#: Between two words: white space, also line breaks with the marks of a comment.
GAP = r"[\t-\r ][\t-\r *#/;%!>|-]*"
#: A number on the next line is a version only after that word.
SPACED_V = rf"(?:,?(?:{GAP})?version{GAP}v?|[ ,]{{0,2}}v? ?)"
SPACED = {"[- ]": rf"(?:-|{GAP})", "[ -]": rf"(?:-|{GAP})", r"[^\n]{0,60}": rf"[^\n]{{0,60}}(?:{GAP})?", " ": GAP, V: SPACED_V}
#: (label, words before "general public license") of the headers that name the version later.
HEADERS = (
    ("gpl-1.0", "", "1"),
    ("gpl-2.0", "", "2"),
    ("gpl-3.0", "", "3"),
    ("lgpl-2.0", "library ", "2"),
    ("lgpl-2.1", "lesser ", r"2\.1"),
    ("lgpl-3.0", "lesser ", "3"),
    ("agpl-3.0", "affero ", "3"),
)


#: A header's version ends there: "2.1" is not "2".
NO_NUMBER = "(?![0-9.]*[0-9])"


def spaced(pattern: str) -> str:
    """``pattern`` with every gap between words as wide as ``GAP``."""
    kept = r" \?| \{0,4\}"
    gaps = "|".join(map(re.escape, (V, "[- ]", "[ -]", r"[^\n]{0,60}")))
    return re.sub(f"{gaps}|{kept}| ", lambda m: SPACED.get(m[0], m[0]), pattern)


def literal(pattern: str) -> str:
    """The longest text without white space that is in every match; empty if none is certain."""
    while True:
        less = re.sub(r"\((?:\?:)?(?:[^()\\]|\\.)*\)[?*+]?", "\0", pattern)
        if less == pattern:
            break
        pattern = less
    if "|" in re.sub(r"\[[^]]*\]", "", pattern):
        return ""
    pattern = re.sub(r"\[[^]]*\](?:[?*+]|\{[^}]*\})?|(?:\\.|[^\\])(?:[?*]|\{[^}]*\})", "\0", pattern)
    return max((re.sub(r"\\(.)", r"\1", part) for part in re.split(r"[\0\s]|\\[()]", pattern)), key=len)


def spaced_rules() -> list[tuple[str, str, str, int]]:
    """``rules()`` over line breaks, each with a keyword of its own, and the headers."""
    found = []
    for label, keyword, pattern, rank in rules():
        words = keyword.split() or [keyword]
        own = next((name for other, _, name, *_ in FAMILIES if other == label and pattern.endswith(f"(?:{name})")), pattern)
        found.append((label, max([*words, literal(own)], key=len), spaced(pattern), rank))
    for label, kind, version in HEADERS:
        header = (
            rf"(?:gnu )?{kind}general public licen[sc]e,? (?:\(l?gpl\) )?as published by the free software foundation[;,:.]?"
            rf" (?:either )?version {version}(?:\.0)?(?: of the licen[sc]e)?(?:, or \(at your option\) any later version)?{NO_NUMBER}"
        )
        found.append((label, "foundation", spaced(header), GRANT))
    return found


def _rule_array() -> Column:
    return F.array(
        *(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(keyword).alias("keyword"),
                F.lit(pattern).alias("pattern"),
                F.lit(rank).alias("rank"),
                F.lit(i).alias("rule"),
            )
            for i, (label, keyword, pattern, rank) in enumerate(spaced_rules())
        )
    )


def keywords_in(lowered: Column) -> Column:
    """The keywords of rules that a lower-cased text holds."""
    words = sorted({keyword for _, keyword, _, _ in spaced_rules()})
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(lowered, w))


def base_places(words: Column) -> Column:
    """array<struct<first,last,label>> of all places of the base phrases in a word array."""

    def of(phrase: tuple[str, ...], label: str) -> Column:
        def hit(word: Column, i: Column) -> Column:
            fits = word == phrase[0]
            for k, other in enumerate(phrase[1:], 1):
                fits = fits & (F.get(words, i + k) == other)
            return F.when(fits, F.struct(i.cast("long").alias("first"), F.lit(label).alias("label")))

        return F.filter(F.transform(words, hit), lambda x: x.isNotNull())

    return F.concat(*(of(phrase, label) for phrase, label in BASE))


def detections(lowered: Column) -> Column:
    """All rule matches as array<struct<start,back,rank,rule,end,label>>, containers first."""

    def of(rule: Column) -> Column:
        return F.transform(
            spans(lowered, rule["pattern"]),
            lambda s: F.struct(
                s["start"].alias("start"),
                (-s["end"]).alias("back"),
                rule["rank"].alias("rank"),
                rule["rule"].alias("rule"),
                s["end"].alias("end"),
                rule["label"].alias("label"),
            ),
        )

    apply = let(
        keywords_in(lowered),
        lambda held: F.filter(_rule_array(), lambda r: F.array_contains(held, r["keyword"])),
    )
    return F.sort_array(F.flatten(F.transform(apply, of)))


def unsuppressed(found: Column) -> Column:
    """Keeps detections that lie in no earlier one of equal or better rank."""

    def reach(rank: int) -> Column:
        ends = F.transform(found, lambda d: F.when(d["rank"] <= rank, d["end"]).otherwise(-1))
        return largest_before(ends)

    ranks = (TAG, GRANT, ADDRESS, NAME)
    return let(
        F.array(*map(reach, ranks)),
        lambda ends: F.filter(found, lambda d, i: ends[d["rank"] - 1][i] < d["end"]),
    )


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with one struct column ``licenses``: n_words, base, found.

    ``base`` holds the places of the base phrases by word, ``found`` the surviving detections
    with start, end (code points, end exclusive), rank and label.
    """
    text = text_of()
    no_base = F.expr("cast(array() as array<struct<first:bigint,label:string>>)")

    def of(lowered: Column) -> Column:
        # every base phrase ends in this word
        base = F.when(
            F.contains(lowered, F.lit("license")),
            let(F.regexp_extract_all(lowered, F.lit(WORD_LOWERED), 0), base_places),
        ).otherwise(no_base)
        found = F.transform(
            let(detections(lowered), unsuppressed),
            lambda d: F.struct(d["start"], d["end"], d["rank"], d["label"]),
        )
        return F.struct(base.alias("base"), found.alias("found"))

    looked = let(lower_ascii(text), of)
    return docs.withColumns(
        {"licenses": looked, "license_words": F.regexp_count(text, F.lit(WORD)).cast("long")}
    )


def license_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    base, found = F.col("licenses.base"), F.col("licenses.found")

    def names(*labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*labels))), ",")

    base_names = F.transform(base, lambda b: b["label"])
    found_names = F.transform(found, lambda d: d["label"])
    best = F.array_min(
        F.concat(
            F.transform(found, lambda d: d["rank"]),
            F.transform(base, lambda b: F.lit(NAME)),
        )
    )
    firsts = F.transform(base, lambda b: b["first"])
    return scan(docs).select(
        "doc_id",
        F.col("license_words").alias("n_words"),
        F.size(base).cast("long").alias("n_base"),
        F.array_min(firsts).alias("first_word"),
        F.array_max(firsts).alias("last_word"),
        names(base_names).alias("base_labels"),
        names(base_names, found_names).alias("labels"),
        F.coalesce(F.get(F.array(*map(F.lit, SCORES)), best - 1), F.lit(0.0)).alias("score"),
    )


def oracle() -> str:
    """The report in DuckDB SQL: rules as a table, spans from the pieces between matches.

    DuckDB's patterns cannot look ahead, so what follows a header is looked at in the next piece.
    """

    def quoted(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    table = ",\n".join(
        f"({quoted(label)}, {quoted(word)}, {quoted(pattern.removesuffix(NO_NUMBER))}, {rank}, {i},"
        f" {pattern.endswith(NO_NUMBER)})"
        for i, (label, word, pattern, rank) in enumerate(spaced_rules())
    )
    phrases = "\nUNION ALL\n".join(
        f"SELECT nr, i - 1 AS first, '{label}' AS label FROM placed WHERE "
        + " AND ".join(f"words[i + {k}] = '{word}'" for k, word in enumerate(phrase))
        for phrase, label in BASE
    )
    scores = ", ".join(map(str, SCORES))
    return rf"""
WITH rules(label, word, pattern, rank, rule, ends) AS (VALUES {table}),
docs AS (SELECT row_number() OVER () AS nr, doc_id, coalesce(text, '') AS text FROM documents),
low AS (
  SELECT nr, translate(text, '{UPPER}', '{LOWER}') AS t FROM docs
), worded AS (
  SELECT nr, regexp_extract_all(t, '{WORD_LOWERED}') AS words FROM low
), placed AS (
  SELECT nr, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), base AS ({phrases}),
matched AS (
  SELECT nr, label, rank, rule, ends, list_transform(regexp_extract_all(t, pattern), lambda x: length(x)) AS found,
    list_transform(pieces, lambda x: length(x)) AS gaps,
    list_transform(pieces, lambda x: regexp_matches(x, '^[0-9.]*[0-9]')) AS number
  FROM (SELECT *, string_split_regex(t, pattern) AS pieces FROM low JOIN rules ON contains(t, word))
), numbered AS (
  SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched
), spans AS (
  SELECT nr, label, rank, rule, list_sum(gaps[1:i]) + coalesce(list_sum(found[1:i - 1]), 0) AS b,
    list_sum(gaps[1:i]) + list_sum(found[1:i]) AS e
  FROM numbered WHERE NOT (ends AND number[i + 1])
), kept AS (
  SELECT * FROM spans s WHERE NOT EXISTS (
    SELECT 1 FROM spans o WHERE o.nr = s.nr AND o.rank <= s.rank AND o.b <= s.b AND o.e >= s.e
      AND (o.b < s.b OR o.e > s.e OR o.rank < s.rank OR o.rule < s.rule))
), per_base AS (
  SELECT nr, count(*) AS n, min(first) AS f, max(first) AS l,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS names
  FROM base GROUP BY nr
), per_doc AS (
  SELECT nr, array_to_string(list_sort(list_distinct(list(label))), ',') AS names, min(rank) AS best
  FROM (SELECT nr, label, {NAME} AS rank FROM base UNION ALL SELECT nr, label, rank FROM kept) GROUP BY nr
)
SELECT doc_id, len(regexp_extract_all(text, '{WORD}'))::BIGINT AS n_words,
  coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
  coalesce(b.names, '') AS base_labels, coalesce(p.names, '') AS labels,
  coalesce(([{scores}])[best]::DOUBLE, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN per_base b USING (nr) LEFT JOIN per_doc p USING (nr)
"""
