"""The transducer lexicon and the merges against the tokenizers library and plain versions."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from modloom.llm import lexicon

ENCODING = lexicon.public_encoding()
LIBRARY = Tokenizer.from_file(ENCODING.path)
LIBRARY.no_truncation()
LIBRARY.no_padding()

TEXTS = [
    "",
    " ",
    "\n\n  x  \t\n",
    "It's we'll THEY'RE don't 'tis",
    "a<|endoftext|>b<|endoftext|><|endoftext|> c <|endof text|>",
    "naïve Straße año 日本語のテキスト 한국어 ру́сский 🙂👩‍👩‍👧",
    "x" * 700,
    "1234567890 3.14 ½ ²",
    "\x00\x1c\x1f\x85\xa0 tail ",
    "՘࢏\U00010940 new",
    "aaaa abababab  " * 30,
]


def expected(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def random_texts(count, seed=4):
    rng = random.Random(seed)
    letters = "etaoinshr  lu.,'\n-0129éßñ 日🙂"
    return ["".join(rng.choices(letters, k=rng.randint(0, 300))) for _ in range(count)]


def test_merges_match_the_library():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdehilnorst", k=rng.randint(1, 40))) for _ in range(500)]
    for word in [*words, "a" * 5000, "ab" * 3000, "é", "日本語"]:
        assert ENCODING.vocabulary.merge(word.encode()) == expected(word)
    assert ENCODING.vocabulary.merge(b"") == []
    for word in words:
        ids = [ENCODING.vocabulary.first[b] for b in word.encode()]
        assert ENCODING.vocabulary._merge_long(ids) == expected(word)


@pytest.mark.parametrize("lockstep", [1, 7, 4096])
def test_words_in_lockstep_merge_like_one_word(monkeypatch, lockstep):
    monkeypatch.setattr(lexicon, "LOCKSTEP", lockstep)
    rng = random.Random(lockstep)
    words = ["", "a", "aaaaaaa", "é", " the", "x" * 64, "x" * 65, "ab" * 300, "𝔘nicode", "\0"]
    letters = "etaoin shrdlu" if lockstep > 1 else "ab"
    words += ["".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(300)]
    words += [bytes(rng.choices(range(256), k=rng.randint(1, 20))).decode("latin-1") for _ in range(100)]
    raw = [w.encode() for w in words]
    own = ENCODING.vocabulary
    assert own.merge_all(raw) == [lexicon.packed(own.merge(w)) for w in raw]
    assert own.merge_all([]) == []


def test_classes_agree_where_the_quick_split_is_used():
    splitter = ENCODING.splitter()
    agreed = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF and lexicon.AGREED.fullmatch(chr(c))]
    assert len(agreed) > 30_000
    letter = lexicon.regex.compile(r"\p{L}")
    assert all(chr(c).isalpha() == bool(letter.match(chr(c))) for c in agreed)
    for at in range(0, len(agreed), 2000):
        text = "".join(f"\na{chr(c)}1{chr(c)}.{chr(c)} {chr(c)}x" for c in agreed[at : at + 2000])
        assert splitter.words(text) == splitter._by_library(text)


def words_of(text):
    splitter = ENCODING.splitter()
    for part in ENCODING.parts(text)[::2]:
        for first, others in splitter.blocks(part):
            yield from splitter.words(first)
            for field in others:
                yield from splitter.words(" " + field)


def test_fields_do_not_cut_words():
    """Also for code points that the two libraries class differently."""
    splitter = ENCODING.splitter()
    points = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF][::7]
    points += [*range(0x3000), 0x180E, 0xFEFF, 0x1680]
    for at in range(0, len(points), 4000):
        text = "".join(f"a {chr(c)} \n {chr(c)}b  {chr(c)}\t 1 x" for c in points[at : at + 4000])
        assert list(words_of(text)) == splitter._by_library(text)


def test_automaton_is_exact_and_minimal():
    rng = random.Random(7)
    words = {"".join(rng.choices("abc", k=rng.randint(1, 8))).encode() for _ in range(1500)}
    entries = {w: list(w) for w in words}
    found = lexicon.Lexicon.compile(entries)
    asked = sorted(words) + [w + b"x" for w in list(words)[:50]] + [b"", b"zz", b"a" * 60]
    ranks = found.ranks(asked)
    assert list(ranks[: len(words)]) == list(range(len(words)))
    for word, rank in zip(asked, ranks, strict=True):
        assert (rank >= 0) == (word in words) and (rank < 0 or found.packed_at(rank) == lexicon.packed(list(word)))
    # states of the smallest automaton: distinct sets of continuations of the prefixes
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    tails = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(found.final) == len(tails) < len(prefixes) / 2


def test_no_words_and_one_word(tmp_path):
    none = lexicon.Lexicon.compile({})
    assert list(none.ranks([b"a", b""])) == [-1, -1]
    one = lexicon.Lexicon.compile({b"ab": [5, 6]})
    (tmp_path / "one").write_bytes(one.to_bytes())
    mapped = lexicon.Lexicon.mapped(str(tmp_path / "one"))
    assert isinstance(mapped.ids, np.memmap) and list(mapped.ranks([b"ab", b"a", b"abc"])) == [0, -1, -1]
    assert mapped.packed_at(0) == lexicon.packed([5, 6])


@pytest.mark.parametrize("size", [0, 3, 10_000])
def test_the_lexicon_changes_no_id(size):
    texts = [*TEXTS, *random_texts(150)]
    words = sorted({w for t in texts for w in words_of(t)})
    entries = {w.encode(): ENCODING.vocabulary.merge(w.encode()) for w in words[:size]}
    encoder = lexicon.Encoder(ENCODING, lexicon.Lexicon.compile(entries))
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == expected(text)
        assert ENCODING.vocabulary.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_blocks_change_no_id(monkeypatch):
    monkeypatch.setattr(lexicon, "BLOCK", 40)
    monkeypatch.setattr(lexicon, "KEPT", 5)
    monkeypatch.setattr(lexicon, "FIELDS", 9)
    texts = [*TEXTS, *random_texts(60), "word and  spaces\n\n end " * 100]
    encoder = lexicon.Encoder(ENCODING, lexicon.Lexicon.compile({b" and": ENCODING.vocabulary.merge(b" and")}))
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == expected(text)


def test_broken_ids_decode_like_the_library():
    rng = random.Random(8)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(12)]
        assert ENCODING.vocabulary.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_rows_match_the_library(spark, docs, monkeypatch):
    monkeypatch.setattr(lexicon, "BATCH", 2000)
    rows = [(i, t, "s") for i, t in enumerate([None, *TEXTS, *random_texts(120)])]
    rows += [(None, "no id", "s"), (3, "again", "s"), (3, "again", "s")]
    table = docs([(*row, b"", "mine") for row in rows], "ids binary, decoded string").repartition(3)
    found = lexicon.encoding_report(table).collect()

    def sha(raw):
        return hashlib.sha256(raw).hexdigest()

    wanted = []
    for doc_id, text, _ in rows:
        ids = expected(text or "")
        wanted.append((doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha((text or "").encode())))
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in found)
    small = lexicon.fit_lexicon(table, ENCODING, size=10)
    arrays = lexicon.unpacked(lexicon.encode(table, lexicon=small)).collect()
    assert sorted(repr((i, expected(t or ""))) for i, t, _ in rows) == sorted(repr((r.doc_id, list(r.ids))) for r in arrays)


def test_words_are_counted_over_all_rows(spark, docs):
    table = docs(["one two two", None, "two<|endoftext|>", " two " + "x" * 60]).repartition(3)
    counts = {r.word: r.n for r in lexicon.word_counts(table, ENCODING).collect()}
    assert counts == {"one": 1, " two": 3, "two": 1}


@pytest.mark.parametrize("size", [0, 1, 2, 5, 100])
def test_frequent_words(spark, size):
    rows = [("a", 100), ("b", 50), ("c", 3), ("d", 3), ("e", 1), ("f", 1), ("g", 1)]
    counts = spark.createDataFrame(rows, "word string, n long")
    found = {r.word for r in lexicon.frequent_words(counts, size).collect()}
    assert found == set({0: "", 1: "a", 2: "ab", 5: "abcd", 100: "abcdefg"}[size])


def test_empty_table(empty_docs):
    assert lexicon.encoding_report(empty_docs).count() == 0


def test_report_decodes_in_the_pass_that_encodes(spark, docs, capsys):
    table = docs([*TEXTS, None, *random_texts(20, 9)])
    small = lexicon.fit_lexicon(table, ENCODING, 50)
    both = lexicon.round_trip(table, lexicon=small)
    assert sorted(map(tuple, both.collect())) == sorted(
        map(tuple, lexicon.decode(lexicon.encode(table, lexicon=small)).collect())
    )
    capsys.readouterr()
    lexicon.encoding_report(table).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_ids_of_many_words(tmp_path):
    words = {b" the": [5], b"ab": [6, 7], b"abc": [8, 9, 10]}
    path = tmp_path / "lexicon.bin"
    path.write_bytes(lexicon.Lexicon.compile(words).to_bytes())
    mapped = lexicon.Lexicon.mapped(str(path))
    ranks = mapped.ranks([b"abc", b"no", b" the", b"ab", b""])
    assert mapped.packed_all(ranks) == [lexicon.packed(ids) for ids in ([8, 9, 10], [], [5], [6, 7], [])]
    none = lexicon.Lexicon.compile({})
    assert none.packed_all(none.ranks([b"a"])) == [b""]


def test_blocks_of_texts_are_cut_without_python_per_word(monkeypatch):
    """Words come from arrays; only code points of which the libraries may differ are cut field by field."""
    texts = [t for t in [*TEXTS, *random_texts(100, 10)] if t.isascii() or lexicon.AGREED.fullmatch(t)]
    monkeypatch.setattr(lexicon.Splitter, "words", lambda *_: pytest.fail("a field was cut on its own"))
    encoder = lexicon.Encoder(ENCODING, lexicon.Lexicon.compile({b" the": ENCODING.vocabulary.merge(b" the")}))
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == expected(text)


@pytest.mark.parametrize("letters", ["'strevmld S ", "' \n\ta1.'s", "'lé \x1c\xa0½-", "'s 🙂日 \u0915\u1680x"])
def test_words_of_many_texts_at_once(letters):
    rng = random.Random(len(letters))
    texts = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(3000)]
    splitter = ENCODING.splitter()
    words, counts = splitter.cut(texts)
    found = iter([w.decode() for w in words.to_pylist()])
    for text, count in zip(texts, counts.tolist(), strict=True):
        assert [next(found) for _ in range(count)] == splitter._by_library(text)


@pytest.mark.parametrize("kept", [0, 1, 40, 10_000])
def test_remembered_words_keep_their_ids(monkeypatch, kept):
    monkeypatch.setattr(lexicon, "KEPT", kept)
    monkeypatch.setattr(lexicon, "BLOCK", 200)
    monkeypatch.setattr(lexicon, "FIELDS", 3)
    encoder = lexicon.Encoder(ENCODING, lexicon.Lexicon.compile({}))
    texts = [*TEXTS, *random_texts(80, 11)] * 2
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == expected(text)
    assert len(encoder.known) <= kept and len(encoder.places) == len(encoder.known) + 1


def test_long_texts_decode_in_blocks(monkeypatch):
    monkeypatch.setattr(lexicon, "TOKENS", 3)
    for text in TEXTS:
        assert ENCODING.vocabulary.decode(expected(text)) == text


@pytest.mark.parametrize("counted", [1, 20, 1 << 17])
def test_counts_handed_on_in_parts(spark, docs, monkeypatch, counted):
    monkeypatch.setattr(lexicon, "COUNTED", counted)
    monkeypatch.setattr(lexicon, "BLOCK", 50)
    texts = [*TEXTS, *random_texts(40, 12)]
    wanted = {}
    for word in (w for t in texts for w in words_of(t)):
        if len(word.encode()) <= lexicon.LONGEST:
            wanted[word] = wanted.get(word, 0) + 1
    assert {r.word: r.n for r in lexicon.word_counts(docs([*texts, None]).coalesce(1), ENCODING).collect()} == wanted
