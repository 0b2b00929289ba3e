"""Pages whose story stands outside an article, or in several."""

import math
import random

import pytest

from modloom.llm import extraction

STORY = [f"Sentence number {i} of the story is long enough to count as text." * 3 for i in range(6)]
CARDS = "".join(f"<article><h3><a href='/{i}'>Card {i}</a></h3><p><a href='/{i}'>Read this</a></p></article>" for i in range(4))


def paragraphs(parts):
    return "".join(f"<p>{p}</p>" for p in parts)


@pytest.mark.parametrize("latest", [CARDS, CARDS[: CARDS.index("</article>") + 10]])
@pytest.mark.parametrize("first", [True, False])
def test_cards_do_not_replace_a_story(latest, first):
    parts = [f"<div id=story>{paragraphs(STORY)}</div>", f"<div class=latest>{latest}</div>"]
    assert extraction.main_text(f"<body>{''.join(parts if first else parts[::-1])}</body>") == " ".join(STORY)


def test_cards_do_not_replace_a_story_without_an_element():
    page = f"<body>{paragraphs(STORY)}<div class=latest>{CARDS}</div></body>"
    assert extraction.main_text(page).startswith(" ".join(STORY))


@pytest.mark.parametrize("sizes", [(2, 2, 2), (4, 1, 1), (1, 1, 4), (1, 5)])
@pytest.mark.parametrize("around", ["<body>{}</body>", "<body><div>{}</div></body>"])
def test_all_articles_of_a_story(sizes, around):
    at, parts = 0, []
    for size in sizes:
        parts.append(f"<article>{paragraphs(STORY[at : at + size])}</article>")
        at += size
    assert extraction.main_text(around.format("".join(parts))) == " ".join(STORY)


def test_articles_beside_a_story_may_be_cards():
    page = f"<body><article>{paragraphs(STORY)}</article>{CARDS}</body>"
    assert extraction.main_text(page) == " ".join(STORY)


@pytest.mark.parametrize(("name", "noise"), [("comment", True), ("ad-box", True), ("post tag-social", False), ("", False)])
def test_class_names_of_articles(name, noise):
    other = "A remark of a reader that is long enough to be a text of its own. " * 4
    page = f"<body><article>{paragraphs(STORY)}</article><article class='{name}'><p>{other}</p></article></body>"
    assert extraction.main_text(page) == " ".join(STORY if noise else [*STORY, other.strip()])


@pytest.mark.parametrize("name", ["class=share-price", "class=social-history", "id=menu-design", "class='notice-period x'"])
@pytest.mark.parametrize("page", ["<body>{}</body>", "<body><nav><a href=/>Home</a></nav><div class=wrap>{}</div></body>"])
def test_names_by_topic_do_not_cost_the_story(name, page):
    assert extraction.main_text(page.format(f"<div {name}>{paragraphs(STORY)}</div>")) == " ".join(STORY)
    around = f"<div {name}><article>{paragraphs(STORY)}</article></div>"
    assert extraction.main_text(page.format(around)) == " ".join(STORY)


@pytest.mark.parametrize("name", ["share-price", "ad-box", "comment-list", "sidebar-left", "user-feedback", "teaser"])
def test_names_decide_beside_a_story(name):
    other = f"<section class='{name}'><p>A remark that is long and holds no link at all.</p></section>"
    for around in ("<div>{}</div>", "<article>{}</article>", "<main>{}</main>"):
        page = around.format(paragraphs(STORY) + other)
        assert extraction.main_text(f"<body>{page}</body>") == " ".join(STORY)
        page = around.format(paragraphs(STORY)) + other * 3
        assert extraction.main_text(f"<body>{page}</body>") == " ".join(STORY)


def test_long_comments_stay_out():
    remarks = paragraphs([f"Remark {i} of a reader, longer than the story." * 9 for i in range(9)])
    page = f"<body><div id=story>{paragraphs(STORY)}</div><div class=comments>{remarks}</div></body>"
    assert extraction.main_text(page) == " ".join(STORY)


def test_link_blocks_in_a_main_go():
    links = "".join(f"<p><a href='/{i}'>Another story, number {i}</a></p>" for i in range(3))
    intro = "<p>See <a href='/a'>the first part of this</a></p>"
    page = f"<body><main><div>{intro}{paragraphs(STORY)}</div><div class=more>{links}</div></main></body>"
    assert extraction.main_text(page) == " ".join(["See the first part of this", *STORY])


def plain_densities(tree, inside_link=False):
    """(density or sums, ...) of nested (tag, children) by the formula, nothing shared with the operator."""
    tag, children = tree
    link = inside_link or tag == "a"
    sums, below = [0, 0, 0, int(tag == "a")], []
    for child in children:
        if isinstance(child, str):
            size = len("".join(child.split()))
            sums[0] += size
            sums[2] += size * link
        else:
            found = plain_densities(child, link)
            below += found
            c, t, lc, lt = found[0]
            sums = [sums[0] + c, sums[1] + t + 1, sums[2] + lc, sums[3] + lt]
    return [tuple(sums), *below]


def test_densities_by_the_formula():
    rng = random.Random(3)

    def grow(depth):
        size = 0 if depth > 4 else rng.randint(0, 3)
        children = [grow(depth + 1) for _ in range(size)]
        children.insert(rng.randint(0, size), " ".join(["word"] * rng.randint(0, 20)))
        return (rng.choice(["div", "section", "b"]) if size else rng.choice(["a", "b", "div"]), children)

    def html(tree):
        tag, children = tree
        return f"<{tag}>{''.join(c if isinstance(c, str) else html(c) for c in children)}</{tag}>"

    for _ in range(200):
        # inline elements hold no blocks here, so no element is closed early
        tree = ("body", [grow(0) for _ in range(4)])
        page = extraction.Page(html(tree))
        sums = plain_densities(tree)
        rc, _, rl, _ = sums[0]
        want = []
        for c, t, lc, lt in sums:
            if not c:
                want.append(0.0)
                continue
            base = math.log(c / max(c - lc, 1) * lc + rl / rc * c + math.e)
            ratio = max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1.0)
            want.append(c / max(t, 1) * math.log(ratio) / math.log(base + math.e - 1))
        assert page.densities()[1:] == pytest.approx(want)
