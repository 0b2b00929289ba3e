"""Text cleaning, fingerprints and ids as Column expressions.

All but one step run inside the JVM. HTML unescaping and Unicode NFKC have no built-in, so they
share one Arrow UDF, and only texts that can change under them are sent to Python.
"""

from __future__ import annotations

import html
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modloom.checks import need_columns
from modloom.rules import TEXT_RULES, TextRules

# The masks and the removed code points.
URL_TOKEN = "<url>"
MENTION_TOKEN = "@user"
INVISIBLE_CLASS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\u200b\u200c\u200d\u2060\ufeff]"

WORD = r"\p{L}\p{N}_"
SPACE = r"[\s\p{Z}]"
URL = rf"(?i)(?<![{WORD}])(?:https?://|www\.)[^\s\p{{Z}}]+"
MENTION = rf"(?<![{WORD}])@[{WORD}]+"
ALNUM = r"[\p{L}\p{N}]"



def _runs_but_one_space(kind: str) -> str:
    """Runs of ``kind`` that a single space is to replace, so not the spaces that stand alone."""
    return rf"{kind}(?:(?<! ){kind}*|{kind}+)"


SPACES = _runs_but_one_space(SPACE)
# The a-z0-9 range comes first only because it is quicker to test.
NON_ALNUM = _runs_but_one_space(r"[^a-z0-9\p{L}\p{N}]")

# Both classes below are long. The first test is therefore a short range that most ASCII text
# fails, and a look-behind then tests the character just found.
RESTLESS_ASCII = r"[^\t\n\r -~]"
INVISIBLE = rf"{RESTLESS_ASCII}(?<={INVISIBLE_CLASS})"

# Ranges of code points that cleaning keeps: visible or plain white space, and NFKC leaves them
# alone whatever stands before them. tests/test_text.py proves it against the Unicode tables.
QUIET_RANGES = (
    (0x0009, 0x000A),
    (0x000D, 0x000D),
    (0x0020, 0x007E),
    (0x00A1, 0x00A7),
    (0x00BF, 0x0131),
    (0x014A, 0x017E),
    (0x0180, 0x01C3),
    (0x01CD, 0x01F0),
    (0x01F4, 0x02AF),
    (0x038E, 0x03A1),
    (0x03A3, 0x03CF),
    (0x0400, 0x0482),
    (0x048A, 0x052F),
    (0x05D0, 0x05EA),
    (0x061B, 0x064A),
    (0x0660, 0x066F),
    (0x0904, 0x0928),
    (0x0E01, 0x0E32),
    (0x2013, 0x2016),
    (0x2018, 0x2023),
    (0x20AC, 0x20AC),
    (0x3001, 0x3029),
    (0x3041, 0x3096),
    (0x30A1, 0x30FE),
    (0x4E00, 0x9FFF),
    (0xAC00, 0xD7A3),
    (0x1F300, 0x1F64F),
    (0x1F680, 0x1F6C5),
)


def _regex_class(ranges: tuple[tuple[int, int], ...]) -> str:
    # As characters, not escapes: a look-behind sees code points above U+FFFF as one character
    # only if the pattern itself contains such a character.
    return "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges)


RESTLESS = rf"{RESTLESS_ASCII}(?<![{_regex_class(QUIET_RANGES[3:])}])"
ENTITY = "&[#A-Za-z]"


#: Texts that are Python strings at a time, which take several times the space of a batch's bytes.
PIECE = 256


@F.arrow_udf(T.StringType())
def _unescape_and_compose(texts: pa.Array) -> pa.Array:
    done = []
    for start in range(0, len(texts), PIECE):
        piece = texts[start : start + PIECE].to_pylist()
        done.append(pa.array([None if x is None else _composed(x) for x in piece], texts.type))
    return pa.concat_arrays(done) if done else texts


def _composed(value: str) -> str:
    return unicodedata.normalize("NFKC", html.unescape(value))


def may_change(text: Column) -> Column:
    """True where HTML entities, NFKC or invisible characters can matter; mostly false."""
    ascii_only = F.length(text) == F.octet_length(text)
    entity = F.contains(text, F.lit("&")) & text.rlike(ENTITY)
    return entity | F.when(ascii_only, text.rlike(RESTLESS_ASCII)).otherwise(text.rlike(RESTLESS))


def canonical_chars(text: Column) -> Column:
    """HTML entities resolved, Unicode NFKC, then zero-width and control characters dropped."""
    # A when() around the UDF would not spare the call, a null argument does.
    changed = _unescape_and_compose(F.when(may_change(text), text))
    return F.coalesce(drop_invisible(changed), text)


def drop_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def mask_urls(text: Column) -> Column:
    lowered = F.lower(text)
    possible = F.contains(lowered, F.lit("://")) | F.contains(lowered, F.lit("www."))
    return F.when(possible, F.regexp_replace(text, URL, URL_TOKEN)).otherwise(text)


def mask_mentions(text: Column) -> Column:
    possible = F.contains(text, F.lit("@"))
    return F.when(possible, F.regexp_replace(text, MENTION, MENTION_TOKEN)).otherwise(text)


def collapse_repeats(text: Column, max_repeat: int = TEXT_RULES.max_repeat) -> Column:
    if max_repeat < 1:
        raise ValueError("max_repeat must be 1 or more")
    return F.regexp_replace(text, rf"(?s)(.)\1{{{max_repeat},}}", "$1" * max_repeat)


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def normalize_text(text: Column, max_repeat: int = TEXT_RULES.max_repeat) -> Column:
    cleaned = mask_mentions(mask_urls(canonical_chars(text)))
    return squeeze_spaces(collapse_repeats(cleaned, max_repeat))


def text_hash(text: Column) -> Column:
    """sha1 of the lower-cased alphanumeric words, or of the text itself if it has none."""
    lowered = F.lower(text)
    key = F.trim(F.regexp_replace(lowered, NON_ALNUM, " "))
    return F.sha1(F.when(lowered.rlike(ALNUM), key).otherwise(squeeze_ends(lowered)))


def squeeze_ends(text: Column) -> Column:
    """White space off both ends, by two anchored patterns, which look at no inner white space."""
    ahead = F.regexp_replace(text, rf"^{SPACE}+", "")
    return F.reverse(F.regexp_replace(F.reverse(ahead), rf"^{SPACE}+", ""))


def make_uid(source: Column | str, source_id: Column) -> Column:
    tag = F.lit(source) if isinstance(source, str) else source
    return F.sha1(F.concat_ws(":", tag, source_id.cast("string")))


def add_text_columns(df: DataFrame, rules: TextRules = TEXT_RULES) -> DataFrame:
    """``text_raw`` in, ``text_raw, text, text_hash, is_short`` out; keeps every row."""
    need_columns(df, ["text_raw"])
    raw = df.withColumn("text_raw", F.coalesce(F.col("text_raw"), F.lit("")))
    cleaned = raw.withColumn("text", normalize_text(F.col("text_raw"), rules.max_repeat))
    return cleaned.withColumns(
        {
            "text_hash": text_hash(F.col("text")),
            "is_short": F.length("text") < rules.min_chars,
        }
    )
