"""Fill-in-the-middle against a plain version that lists all units."""

import hashlib
import random

import pytest

from modloom.llm import fim

TEXTS = [None, "", " \n", "word", "a1b", "x" * 9000, "\U0001d518" * 300, "<P> marked", "cut <S", "<M", "é" * 700]


def plain(doc_id, text):
    text = text or ""
    units = fim.UNITS.findall(text)
    draw = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    a, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or h[2] % 100 >= 90 or any(mark in text for mark in ("<P>", "<S>", "<M>")):
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(a), len(m), f"<S>{s}<P>{a}<M>{m}"
    return len(units), "psm", len(a), len(m), f"<P>{a}<S>{s}<M>{m}"


def mixed_texts(count, seed=3):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abc de,1\né\U0001d518", k=rng.randint(200, 3000))) for _ in range(5)]
    for _ in range(count):
        own = "".join(rng.choices("abcXYZ  .\n", k=rng.randint(0, 2000)))
        yield own + rng.choice(shared) + own[::-1] + rng.choice(shared)


def test_chunks_are_whole_and_follow_content():
    texts = list(mixed_texts(60))
    for text in [*texts, "", "a" * 10_000, "ab" * (fim.BLOCK + 7)]:
        found = list(fim.chunks(text))
        assert "".join(found) == text and all(len(c) <= fim.MOST for c in found)
        assert all(len(c) >= fim.LEAST for c in found[:-1])
    rng = random.Random(5)
    body = "".join(rng.choices("abcdef gh", k=20_000))
    first, second = (set(fim.chunks(head + body)) for head in ("one ", "quite another start "))
    assert len(first & second) > 0.8 * len(first)


def test_blocks_do_not_move_borders(monkeypatch):
    text = "".join(mixed_texts(30))
    whole = list(fim.borders(text))
    monkeypatch.setattr(fim, "BLOCK", 100)
    assert list(fim.borders(text)) == whole and len(whole) > 50


@pytest.mark.parametrize("kept", [1, 4096])
def test_every_place_matches_the_list_of_units(kept, monkeypatch):
    monkeypatch.setattr(fim, "LEAST", 4)
    monkeypatch.setattr(fim, "MOST", 16)
    monkeypatch.setattr(fim, "ZERO_BITS", 3)
    summary_of = fim.Summaries(kept)
    for text in [*(t[:400] for t in mixed_texts(40)), "abc" * 30, "ab " * 30, "1"]:
        units = fim.Units(text, summary_of)
        assert len(units.chunks) == 1 or max(map(len, units.chunks)) <= 16
        places = [m.start() for m in fim.UNITS.finditer(text)] + [len(text)]
        assert units.total == len(places) - 1
        assert [units.place(k) for k in range(len(places))] == places
    assert len(summary_of.young) <= kept


def test_a_shared_chunk_is_summarised_once(monkeypatch):
    calls = []
    plain_summary = fim.summarize
    monkeypatch.setattr(fim, "summarize", lambda chunk: calls.append(chunk) or plain_summary(chunk))
    summary_of, text = fim.Summaries(), "".join(mixed_texts(3))
    once = fim.Units(text, summary_of).total
    distinct = len(calls)
    assert fim.Units(text, summary_of).total == once and len(calls) == distinct == len(set(calls))


def test_rows_match_the_plain_version(spark, docs):
    rows = [(i, t, "s") for i, t in enumerate([*TEXTS, *mixed_texts(150)])]
    rows += [(None, "no id here", "s"), (5, "x" * 9000, "s")]
    table = docs([(*row, 1, "mine") for row in rows], "n int, output string")
    found = fim.fill_in_middle(table).collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(repr((i, *plain(i, t))) for i, t, _ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    digests = fim.middle_report(table).collect()
    sha = lambda text: hashlib.sha256((text or "").encode()).hexdigest()
    expected = [(i, sha(plain(i, t)[-1]), sha(t)) for i, t, _ in rows]
    assert sorted(map(repr, expected)) == sorted(
        repr((r.doc_id, r.output_sha256, r.restored_sha256)) for r in digests
    )


def test_large_outputs_leave_in_several_batches(spark, docs):
    texts = ["word " * 400_000] * 6 + ["end"]
    found = {r.doc_id: r for r in fim.fill_in_middle(docs(texts).coalesce(1)).collect()}
    assert all(tuple(found[i])[1:] == plain(i, t) for i, t in enumerate(texts))


def test_empty_table(empty_docs):
    assert fim.middle_report(empty_docs).count() == 0
