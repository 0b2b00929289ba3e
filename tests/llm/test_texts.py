"""Toxicity, language, packing, fingerprints and extraction against plain versions."""

import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from modloom.llm import components, extraction, language, packing, simhash, toxicity

ODD = [None, "", " \n", "é" * 40, "𝔘 𝔘", "word " * 30_000]


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- toxicity


def test_features_do_not_depend_on_neighbours():
    texts = ["You FOOL you", "", "b c", "straße\nist lang", "x" * 50, "a b c d e f"]
    together = list(toxicity.features(texts))
    alone = [next(toxicity.features([t])) for t in texts]
    assert all((a == b).all() for a, b in zip(together, alone, strict=True))
    # words, pairs, and pairs with one and two words between
    assert [len(x) for x in together] == [5, 0, 3, 6, 1, 6 + 5 + 4 + 3]


def test_long_texts_are_whole(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500))
    whole = next(toxicity.features([text]))
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert (next(toxicity.features([text])) == whole).all()


def test_toxicity_learns_held_out_rows(spark, docs):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        text = rng.choices(words, k=rng.randint(5, 60)) + (["vile", "scoundrel"][: 1 + i % 2] if toxic else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    result = toxicity.toxicity_report(docs([*rows, (None, None, "s")]), table).collect()
    truth = dict(labels)
    held = [r for r in result if r.held_out and r.doc_id is not None]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in result if r.doc_id is not None)
    assert len(held) > 200
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    model = toxicity.fit(docs(rows), table)
    assert len(model) < 2000
    kept = toxicity.reject_toxic(docs(rows).withColumn("toxic_score", F.lit(1)), model)
    assert kept.columns[-1] == "toxic_score" and 1150 < kept.count() < 1230


def test_repeated_ids_do_not_exceed_the_limit(spark, docs):
    rows = [(7, f"text {i % 1000}", "s") for i in range(3000)] + [(i, f"own {i}", "s") for i in range(10, 40)]
    table = spark.createDataFrame([(7, 1), *((i, 0) for i in range(10, 40))], "doc_id long, toxic int")
    chosen = toxicity.training_rows(docs(rows), table, 50).collect()
    assert len(chosen) == 50 == len({(r.digest, r.text_digest) for r in chosen})
    every = toxicity.training_rows(docs(rows), table).collect()
    assert len(every) == 1000 + sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(10, 40))
    assert len(toxicity.fit(docs(rows), table, 50)) > 0


def test_toxicity_without_labels(spark, docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.toxicity_report(docs(ODD), none).collect()
    assert {r.predicted for r in rows} == {0} and len(rows) == len(ODD)
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (3, 1), (3, 0)], "doc_id long, toxic int")
    assert toxicity.toxicity_report(docs(ODD), odd).count() == len(ODD)
    assert toxicity.toxicity_report(empty_docs, odd).count() == 0


# --- language


def test_language_fuses_evidence(spark, docs):
    rng = random.Random(2)
    syllables = {"de": ["sch", "ung", "ein", "ver"], "en": ["the", "ing", "wh", "ou"]}

    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=3)) for _ in range(n))

    rows = [(i, text("de" if i % 2 else "en", 20), "s") for i in range(200)]
    table = docs(rows).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "de").otherwise("en"))
    pages = [(i, "http://a.example.de/x", f"<p>{text('de', 30)}</p>") for i in range(60)]
    pages += [(i, "http://b.example.com/x", f"<p>{text('en', 30)}</p>") for i in range(60, 120)]
    # no text: the host, the suffix and the declaration are left
    pages += [
        (200, "http://a.example.de/y", ""),
        (201, "http://new.other.de/", None),
        (202, None, '<html lang="de"></html>'),
        (203, "http://b.example.com/", ""),
    ]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    result = language.language_report(pages, table.withColumn("host", F.lit(1)))
    found = {r.page_id: r for r in result.collect() if r.kind == "page"}
    assert all(found[i].language == ("de" if i < 60 else "en") for i in range(120))
    assert [found[i].language for i in (200, 201, 202, 203)] == ["de", "de", "de", "en"]
    held = [r for r in result.collect() if r.kind == "document" and r.held_out]
    assert held and all(r.language == ("de" if r.doc_id % 2 else "en") for r in held)
    assert result.count() == 124 + 200


def test_language_edges(spark, docs, empty_docs):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.language_report(none, empty_docs).count() == 0
    rows = language.language_report(none, docs(ODD)).collect()
    assert len(rows) == len(ODD)


def test_three_hundred_languages(spark, docs, monkeypatch):
    """More languages than one table holds: each is still found, and a declared one counts."""
    monkeypatch.setattr(language, "AT_ONCE", 128)
    monkeypatch.setattr(language, "COUNTED", 7)
    syllables = ["".join(x) for x in itertools.product("bcdfghjk", "aeiou", "lmnprstv")]
    rows = [(i, " ".join([syllables[i % 300] + "z"] * 40), "s") for i in range(900)]
    table = docs(rows).withColumn("lang", F.concat(F.lit("l"), (F.col("doc_id") % 300).cast("string")))
    pages = [(i, None, f"<p>{rows[i][1]}</p>") for i in range(300)]
    schema = "page_id long, url string, html string"
    found = language.language_report(spark.createDataFrame(pages, schema), table).collect()
    # the language's three documents may all be held out
    held = [i for i in range(300) if all(zlib.crc32(str(j).encode()) % 5 == 0 for j in (i, i + 300, i + 600))]
    pages = {r.page_id: r.language for r in found if r.kind == "page"}
    assert len(held) < 10 and all(pages[i] == f"l{i}" for i in range(300) if i not in held)


def test_trigram_counts_cover_all_rows(docs):
    texts = ["abc abc", "xyz", None, "äöü"]
    counts = {r.bucket: r.n for r in language.count_trigrams(docs(texts)).collect()}
    assert counts.pop(language.BUCKETS) == 4
    assert sum(counts.values()) == sum(len(language.trigrams(t or "")) for t in texts)


# --- packing


def pack_rows(df):
    rows = packing.pack(df).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return rows, bins


def test_pieces_hold_the_tokens(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [*ODD, "two  spaces \n\n and\ttabs  ", "<|endoftext|> x", "it's they'll 12 345", "a  b c", "naïve 你好 🙂"]
    rows, _ = pack_rows(docs(texts))
    for i, text in enumerate(texts):
        ids = [*encode.encode(text or "", add_special_tokens=False).ids, packing.END_TOKEN]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == packing.CAPACITY for r in own[1:])
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32


def test_sequences_hold_every_token(docs):
    rows = packing.sequences(docs(["a b c", "d e", None, (7, "word " * 3000, "s")])).collect()
    assert all(len(r.ids) <= packing.CAPACITY for r in rows)
    assert sum(len(r.ids) for r in rows) == (3 + 1) + (2 + 1) + 1 + (3001 + 1)


def test_repeated_rows_and_empty_tables(docs, empty_docs):
    rows, bins = pack_rows(docs([(1, "same text", "s")] * 50 + [(None, "other", "s")] * 3))
    assert len(rows) == 53 and len(bins) == 1
    assert packing.pack(empty_docs).count() == 0


def fewest(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(sizes)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= sizes[i]}):
            left = list(rooms)
            left.remove(r)
            put(i + 1, [*left, r - sizes[i]])
        put(i + 1, [*rooms, capacity - sizes[i]])

    put(0, [])
    return best[0]


def unpacked(plan):
    bins = {}
    for size, _, ranks, first, per_bin, offset in plan.placed:
        for t in range(ranks):
            bins.setdefault(first + t // per_bin, []).append((offset + t % per_bin * size, size))
    return bins


def counts_of(sizes):
    return {s: sizes.count(s) for s in set(sizes)}


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
    plan = packing.Plan(counts_of(sizes), 20)
    packing.reduce_dominated(plan)
    rest = [s for s, n in plan.left.items() for _ in range(n)]
    assert plan.bins + fewest(sorted(rest, reverse=True), 20) == fewest(sizes, 20)
    packing.best_fit(plan)
    assert plan.bins >= fewest(sizes, 20)


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_all(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 64) for _ in range(rng.randint(1, 3000))]
    plan = packing.plan_lengths(counts_of(sizes), 64)
    bins = unpacked(plan)
    assert sorted(s for parts in bins.values() for _, s in parts) == sorted(sizes)
    assert sorted(bins) == list(range(plan.bins))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == list(itertools.accumulate([s for _, s in sorted(parts)], initial=0))[:-1]
        assert sum(s for _, s in parts) <= 64
    assert plan.bins <= math.ceil(sum(sizes) / 64 * 1.25) + 1


# --- fingerprints


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(prints, ids):
    roots = list(range(len(ids)))

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for i, j in itertools.combinations(range(len(ids)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4:
            roots[find(j)] = find(i)
    least = {}
    for i, doc_id in enumerate(ids):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least[find(i)] for i in range(len(ids))]


def test_simhash_matches_brute_force(docs):
    rng = random.Random(4)
    texts = list(ODD)
    for _ in range(40):
        words = [f"w{rng.randint(0, 500)}" for _ in range(rng.randint(1, 80))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 4)):
            near = list(words)
            near[rng.randrange(len(near))] = "Changed"
            texts.append("  ".join(near))
    rows = by_id(simhash.near_duplicate_report(docs(texts)))
    prints = [plain_fingerprint(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i].component_id for i in range(len(texts))] == plain_components(prints, range(len(texts)))


@pytest.mark.parametrize("size", [2, 3, 63, 64, 65, 200, 700])
def test_bit_slices_find_all_links(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 1 << 63, 8, dtype=np.uint64)
    prints = base[rng.integers(0, 8, size)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
    near = np.bitwise_count(prints[:, None] ^ prints) <= simhash.RADIUS
    expected = simhash.merge(np.arange(size), *np.nonzero(near))
    assert (simhash.link_large(prints) == expected).all()
    if size < simhash.SMALL:
        assert (simhash.link_small(prints, np.zeros(size, np.int64)) == expected).all()


def test_tiles_lose_no_link(docs, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(60):
        near = list(words)
        near[rng.randrange(len(near))] = f"x{rng.randint(0, 9)}"
        texts.append(" ".join(near))
    rows = by_id(simhash.near_duplicate_report(docs(texts)))
    prints = [plain_fingerprint(t) for t in texts]
    assert [rows[i].component_id for i in range(60)] == plain_components(prints, range(60))


def test_keep_one(docs, empty_docs):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(5, long, "a"), (3, long, "b"), (3, long, "a"), (9, "another text of words", "a"), (None, "only null", "a")]
    df = docs(rows).withColumn("kept_id", F.lit(0))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.source) for r in kept.collect()) == [(-1, "a"), (3, "a"), (9, "a")]
    assert simhash.keep_one(empty_docs).count() == 0
    assert simhash.near_duplicate_report(empty_docs).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    found = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    labels = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                labels[a] = labels[b] = min(labels[a], labels[b])
    assert found == labels


# --- extraction

ARTICLE = "<article><h1>Head&amp;line</h1><p>First <b>bold</b> part.<br>Next&nbsp;line<p>Short.</p></article>"
EXPECTED = "Head&line First bold part. Next line Short."
NOISE = [
    "<nav><ul><li><a href='/x'>Menu entry one</a><li><a href='/y'>Menu two</a></ul></nav>",
    "<header><h1>Site name</h1></header>",
    "<div class='ad'>Buy this very good product now, it is cheap.</div>",
    "<aside>Sidebar text with many words in it.</aside>",
    "<div id=cookie-notice>We use cookies, you know.</div>",
    "<form><label>Your name</label><input></form>",
    "<script>var x = '<p>not text</p>';</script><style>p{}</style>",
    "<div class='comments'><p>A reader's remark that is long and has no links at all.</p></div>",
    "<footer>&copy; someone</footer>",
]


@pytest.mark.parametrize("noise", NOISE)
def test_noise_is_left_out(noise):
    for page in (noise + ARTICLE, ARTICLE + noise, ARTICLE.replace("<p>First", noise + "<p>First")):
        if noise.startswith("<header") and page not in (noise + ARTICLE, ARTICLE + noise):
            continue
        assert extraction.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>") == EXPECTED


def test_pages_without_an_article():
    text = " ".join(f"Sentence number {i} of the story." for i in range(12))
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(20))
    page = f"<body><div><ul>{links}</ul></div><div id=m><p>{text}</p><p>{text}</p><p>{text}</p></div></body>"
    assert extraction.main_text(page) == " ".join([text] * 3)


@pytest.mark.parametrize(
    ("name", "noise"),
    [("ad", True), ("sidebar-left", True), ("cookie_notice", True), ("ad2", True), ("has-sidebar", False)]
    + [("admin", False), ("no-ads", False), ("post-content", False), ("comment-list", True), ("", False)],
)
def test_noisy_names(name, noise):
    assert extraction.noisy_name(name) is noise


def test_layout_names_keep_the_text():
    text = "A sentence of the story that is long enough. " * 5
    for wrapper in ("<div class='has-sidebar'>", "<div id='widget-page'><main>"):
        page = f"<body>{wrapper}<div class='main-content'><h1>Head</h1><p>{text}</p></div></body>"
        assert extraction.main_text(page) == f"Head {text}".strip()


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("plain words only", "plain words only"),
        ("<article><p>open <b>bold<p>next", "open bold next"),
        ("<article>a<!-- <p>b</p> -->c</article>", "ac"),
        ("</p></div><article><p>x</p></span> y</article></article>", "x y"),
        ("<article><p>1 < 2 &lt; 3</p></article>", "1 < 2 < 3"),
        ("<article>a<div>b</div>c<td>d</article", "a b c d"),
    ],
)
def test_odd_pages(page, text):
    assert extraction.main_text(page) == text


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "y"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    result = extraction.extraction_report(pages).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in result) == [
        (0, "", 0),
        (1, EXPECTED, len(EXPECTED)),
        (1, EXPECTED, len(EXPECTED)),
    ]
    assert extraction.extraction_report(pages.limit(0)).count() == 0
