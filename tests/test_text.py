import hashlib
import html
import itertools
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modloom.functions import text as X

# One table per step, made from what the step says: (raw, clean).

#: What may stand before a mask, and whether it is a word character, which forbids the mask.
BEFORE = {"": False, "-": False, "(": False, "\u3002": False, "k": True, "7": True, "_": True, "\u00f1": True}


def entity_cases():
    for point in (0x26, 0x3C, 0xE6, 0x2211, 0x1F9EA):
        for form in (f"&#{point};", f"&#x{point:x};", f"&#X{point:04X};", f"&#{point} "):
            yield f"m{form}n", f"m{chr(point)}{' ' if form[-1] == ' ' else ''}n"
    for name in ("copy", "alpha", "rarr", "hellip", "frac12", "nosuchname"):
        yield f"{name} &{name};", unicodedata.normalize("NFKC", html.unescape(f"{name} &{name};"))


def invisible_cases():
    points = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, *range(0x09), 0x0B, 0x0C, *range(0x0E, 0x20), *range(0x7F, 0xA0)]
    for point in points:
        yield f"pq{chr(point)}rs", "pqrs"


def compatibility_cases():
    for raw, plain in (("\u2460", "1"), ("\ufb03", "ffi"), ("\uff21\uff42", "Ab"), ("o\u0308", "\u00f6"), ("\u33a5", "m3")):
        yield f"x {raw} y", f"x {plain} y"


def mask_cases():
    for before, word in BEFORE.items():
        for link in ("ftp.www.q", "www.q.tld/~u", "hTTp://10.0.0.1:8/", "https://\u4f8b.tld"):
            masked = not word and not link.startswith("ftp")
            rest = "ftp.<url>" if link.startswith("ftp") else link
            yield f"{before}{link} z", f"{before}{'<url>' if masked else rest} z"
        for name in ("@Zoe_3", "@\u00dcn", "@4"):
            yield f"{before}{name}! z", f"{before}{name if word else '@user'}! z"
    yield from ((x, x) for x in ("www.", "http:// z", "@ z", "@-z"))


def run_cases():
    for char in "v8~\u0416\U0001f9ea":
        for count in range(1, 8):
            yield f"{char * count}|", f"{char * min(count, 3)}|"
    yield "vVvVvV", "vVvVvV"


def space_cases():
    for point in (0x09, 0x0A, 0x0D, 0x20, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000):
        yield f"{chr(point)}g {chr(point)}h{chr(point)}", "g h"
    yield " \n ", ""


STEPS = {
    "runs": run_cases,
    "white space": space_cases,
    "masks": mask_cases,
    "invisible": invisible_cases,
    "entities": entity_cases,
    "compatibility": compatibility_cases,
}


def is_word(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")


def scan(text: str, ends) -> str:
    """Replaces what ``ends(i)`` finds at a place that no word character precedes."""
    out, i = [], 0
    while i < len(text):
        found = None if is_word(text, i - 1) else ends(text, i)
        if found:
            out.append(found[1])
            i = found[0]
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def url_at(text: str, i: int):
    for start in ("https://", "http://", "www."):
        stop = i + len(start)
        if text[i:stop].lower() == start:
            while stop < len(text) and not text[stop].isspace():
                stop += 1
            return (stop, "<url>") if stop > i + len(start) else None
    return None


def mention_at(text: str, i: int):
    stop = i + 1
    while text[i] == "@" and is_word(text, stop):
        stop += 1
    return (stop, "@user") if stop > i + 1 else None


def plain_clean(text: str, keep: int = 3) -> str:
    """The steps once more, character by character, as the expected result."""
    text = unicodedata.normalize("NFKC", html.unescape(text))
    invisible = "\u200b\u200c\u200d\u2060\ufeff"
    text = "".join(
        c for c in text if c not in invisible and (c in "\t\n\r" or unicodedata.category(c) != "Cc")
    )
    text = scan(scan(text, url_at), mention_at)
    out: list[str] = []
    for c in text:
        if len(out) < keep or any(o != c for o in out[-keep:]):
            out.append(c)
    return " ".join("".join(out).split())


def plain_hash(text: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return hashlib.sha1((" ".join(words) or text.lower().strip()).encode()).hexdigest()


@pytest.mark.parametrize("step", STEPS)
def test_each_step(column, step):
    raw, clean = zip(*STEPS[step](), strict=True)
    assert column(X.normalize_text, raw) == list(clean)
    assert list(map(plain_clean, raw)) == list(clean)


def test_no_text(column):
    assert column(X.normalize_text, ["", None]) == ["", None]


def test_max_repeat(column):
    for most in (1, 2, 5):
        assert column(lambda c, most=most: X.normalize_text(c, most), ["u" * 9 + "-" * 4]) == ["u" * most + "-" * min(most, 4)]
    with pytest.raises(ValueError):
        X.normalize_text(F.lit("x"), 0)


#: Pieces that no step turns into something that an earlier step looks for.
STEADY = st.sampled_from(["ba", "Dc", "\u00e9", "5", " ", "\n\t", "?", "@nym", "https://h/p", "\u200b", "\ufb01", "\u2461"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(STEADY, max_size=30).map("".join), min_size=40, max_size=40))
def test_cleaning_twice_changes_nothing(column, texts):
    once = column(X.normalize_text, texts)
    assert column(X.normalize_text, once) == once


PIECES = st.sampled_from(
    ["a", "B", "é", "ß", "1", "_", " ", "\n", "\t", "\r\n", "!", "@", "@ab", "www.", "http://x",
     "&amp;", "&", "#", ";", "​", "\x07", "ﬁ", "Å", "é", "ｗ", "中", "한", "ᅡ",
     "я", "😀", "\U0001d400", " ", " ", "…", "½", "Σ", "aaaa", "....", "&#39;", "²"]
)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(PIECES, max_size=25).map("".join), min_size=60, max_size=60))
def test_against_plain_python(column, texts):
    cleaned = column(X.normalize_text, texts)
    assert cleaned == [plain_clean(t) for t in texts]
    assert column(X.text_hash, cleaned) == [plain_hash(t) for t in cleaned]


def test_quiet_ranges_survive_cleaning():
    """No quiet character is changed by NFKC, joins the one before it, or is dropped."""
    joins = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))
    for point in range(0x110000):
        parts = unicodedata.decomposition(chr(point)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(int(parts[1], 16))
    invisible = {0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF}
    for low, high in X.QUIET_RANGES:
        for point in range(low, high + 1):
            c = chr(point)
            assert unicodedata.is_normalized("NFKC", c), hex(point)
            assert unicodedata.combining(c) == 0 and point not in joins, hex(point)
            assert point not in invisible
            assert unicodedata.category(c) != "Cc" or c in "\t\n\r", hex(point)


def test_only_restless_texts_go_to_python(column):
    texts = ["plain", "Straße für Ünïcode, Привет 中文 😀", "a & b", "a &amp; b", "ﬁ", "x\x00", None]
    assert column(X.may_change, texts) == [False, False, False, True, True, True, None]


def test_hash(column):
    """Words alone count, whatever their case and what stands between them."""
    spellings = [f"{a}one{b}tWo{c}" for a in ("", "(") for b in (" ", "_", " - ", "...") for c in ("", "?")]
    found = column(X.text_hash, [*spellings, "onetwo", "two one"])
    assert len(set(found[:-2])) == 1 and len(set(found)) == 3
    marks = ["+", "-", "+ +", "++", ""]
    assert len(set(column(X.text_hash, marks))) == len(marks)
    assert column(X.text_hash, [" +\n", "+"]) == column(X.text_hash, ["+", "+"])


def test_uid(spark):
    row = spark.range(1).select(
        X.make_uid("mhs", F.lit(7)).alias("a"),
        X.make_uid("mhs", F.lit("7")).alias("b"),
        X.make_uid("jigsaw", F.lit("7")).alias("c"),
    ).first()
    assert row.a == row.b == hashlib.sha1(b"mhs:7").hexdigest() != row.c


def test_text_columns_keep_every_row(spark):
    df = spark.createDataFrame(
        [(0, None), (1, "no"), (2, " two  words"), (3, "yes"), (4, "")], "i int, text_raw string"
    )
    rows = X.add_text_columns(df).orderBy("i").collect()
    assert [r.text_raw for r in rows] == ["", "no", " two  words", "yes", ""]
    assert [r.text for r in rows] == ["", "no", "two words", "yes", ""]
    assert [r.is_short for r in rows] == [True, True, False, False, True]


def test_long_inner_white_space_is_no_trouble(column):
    text = "!" + " " * 200_000 + "!"
    assert column(X.squeeze_ends, [f" {text}\n"]) == [text]


def test_lone_spaces_are_not_replaced_by_themselves(spark):
    """The patterns pass over single spaces, which most white space is, and give the same texts."""
    parts = [" ", "  ", "\t", " ", "-", "a", "é", ""]
    texts = ["".join(p) for p in itertools.product(parts, repeat=4)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(
        X.squeeze_spaces(F.col("text")).alias("new"),
        F.trim(F.regexp_replace("text", rf"{X.SPACE}+", " ")).alias("old"),
        F.regexp_replace("text", X.NON_ALNUM, " ").alias("new_words"),
        F.regexp_replace("text", r"[^a-z0-9\p{L}\p{N}]+", " ").alias("old_words"),
    )
    assert df.filter("new <> old OR new_words <> old_words").isEmpty()
    found = spark.sql("SELECT 'a b' AS text").select(
        *[F.col("text").rlike(pattern) for pattern in (X.SPACES, X.NON_ALNUM)]
    )
    assert not any(found.first())


def test_characters_of_a_batch_are_composed_piece_by_piece(spark):
    """More texts than a piece holds, nulls among them, keep their order; only a piece is strings at a time."""
    texts = [None if i % 5 == 0 else f"ﬂ{i}&lt;" for i in range(2 * X.PIECE + 3)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = rows.select("id", X.canonical_chars(F.col("text")).alias("t")).collect()
    assert {r.id: r.t for r in got} == {i: x and x.replace("ﬂ", "fl").replace("&lt;", "<") for i, x in enumerate(texts)}
    sizes = []

    class Texts(list):
        type = pa.string()

        def __getitem__(self, part):
            return Texts(super().__getitem__(part))

        def to_pylist(self):
            sizes.append(len(self))
            return list(self)

    done = X._unescape_and_compose.func(Texts(texts))
    assert len(done) == len(texts) and max(sizes) == X.PIECE
