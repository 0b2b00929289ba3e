"""HTML extraction by composite text density.

Every page becomes a flat tree of elements. Each element has its characters, tags, link
characters and link tags; from these its link-adjusted characters per tag. The sum over an
element's children finds the element whose children carry most text; the least density on the way
from it up to the body is the threshold above which other parts count as text, too. The article
that holds the found element, if there is one, is taken whole, with the articles beside it that
have as many link-free characters per tag as the way up; else all articles inside it, if they hold most of its text. Menus, page headers, footers,
sidebars, notices, adverts, forms, scripts, styles and comments never count.

A class or id that consists of noise and container words ("ad-box") settles that an element is noise.
One that only begins or ends with a noise word ("share-price") is a suspicion: the element stays if it
holds most of the page's link-free text, or its densest part while no article or main stands elsewhere.
Of a main without articles, blocks beside the story that are mostly links go.

One Arrow pass without a shuffle. Defined results: null, empty and text-free pages give an empty
text; unclosed and stray tags are closed and ignored as far as needed; repeated rows each get
their own result; an empty table gives no rows.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modloom.llm.tables import text_of

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
NAME_PARTS = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that end an open paragraph.
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An element of the first kind ends open ones of the second, up to the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
NOISE_TAGS = frozenset(
    "nav footer aside form script style noscript template iframe svg math button select textarea"
    " input object embed canvas dialog menu title head datalist xmp".split()
)
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion"
    " sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer masthead"
    " cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup"
    " comment comments disqus reply replies share sharing social related recommended widget"
    " toolbar pagination pager skip hidden feedback teaser teasers".split()
)
#: Words that say where or how an element stands, not what it is about.
CONTAINER_NAMES = frozenset(
    "area bar bars block body bottom box button buttons col column container content count desktop"
    " dialog first fixed floating form global group icon icons inner item items js last latest left"
    " link links list main mobile new outer page panel primary reader right row secondary section"
    " site slot sticky text thread title top unit user wrap wrapper zone".split()
)
LAYOUT = frozenset("has with without no not is".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search alert dialog menu menubar toolbar".split()
)
KEEPERS = frozenset(["article", "main"])
#: Elements that may hold a list of links beside a story.
GROUPS = frozenset("div section ul ol table dl".split())


def noisy_name(name: str, topics: bool = False) -> bool:
    """True if a class or id begins or ends with a noise name; "has-sidebar" names a layout.

    With ``topics`` the end does not count: an article's "tag-social" names what it is about.
    """
    parts = [part for part in NAME_PARTS.split(name) if part]
    ends = parts[:1] if topics else (parts[:1] + parts[-1:])
    return bool(parts) and parts[0] not in LAYOUT and not NOISE_NAMES.isdisjoint(ends)


def settled_name(name: str) -> bool:
    """True if a noisy name holds noise and container words, digits and single letters only."""
    known = NOISE_NAMES | CONTAINER_NAMES
    return all(len(part) < 2 or part.isdigit() or part in known for part in NAME_PARTS.split(name))


class Page:
    """The elements of a page in page order, as parallel lists."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise = ["#page"], [-1], [False]
        #: Elements that are noise by the look of their names, until the densities are known.
        self.suspects: set[int] = set()
        self.chars, self.tags = [0], [0]
        self.link_chars, self.link_tags = [0], [0]
        #: (element, text) in page order; None is a block's edge.
        self.parts: list[tuple[int, str | None]] = []
        self.body = 0
        self._read(source)
        own = [list(values) for values in (self.chars, self.tags, self.link_chars, self.link_tags)]
        self._add_up()
        if self.suspects:
            self._settle()
            self.chars, self.tags, self.link_chars, self.link_tags = own
            self._add_up()

    def _settle(self) -> None:
        """Turns suspects into noise, with all they hold, unless they carry the story."""
        best, _, inside = self._densest(self.densities())
        if best is None:
            return
        up, around = best, set()
        while up > 0:
            around.add(up)
            up = self.parent[up]
        root = self.body
        most = (self.chars[root] - self.link_chars[root]) / 2
        suspected = set(self.suspects)
        for node in range(1, len(self.tag)):
            if self.parent[node] in suspected and self.tag[node] != "main":
                suspected.add(node)
        elsewhere = any(self.tag[n] in KEEPERS and n not in suspected for n in inside)
        for node in range(1, len(self.tag)):
            if node in self.suspects:
                carries = self.chars[node] - self.link_chars[node] > most
                if not (carries or node in around and not elsewhere):
                    self.noise[node] = True
            if self.noise[self.parent[node]] and self.tag[node] != "main":
                self.noise[node] = True

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        while True:
            found = MARKUP.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at:
                self._text(stack[-1], source[at:stop])
            if not found:
                break
            at = found.end()
            if found["name"] is None:
                continue
            name = found["name"].lower()
            if found["close"]:
                self._end(stack, name)
                continue
            self._start(stack, name, found["attrs"])
            if name in RAW and not found["attrs"].endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
                at = close.end() if close else len(source)
                self._end(stack, name)

    def _text(self, node: int, text: str) -> None:
        if not self.noise[node]:
            text = html.unescape(text) if "&" in text else text
            self.parts.append((node, text))
            size = len("".join(text.split()))
            self.chars[node] += size
            if self._in_link(node):
                self.link_chars[node] += size

    def _in_link(self, node: int) -> bool:
        while node > 0 and self.tag[node] in INLINE:
            if self.tag[node] == "a":
                return True
            node = self.parent[node]
        return False

    def _start(self, stack: list[int], name: str, attrs: str) -> None:
        if name in BLOCKS:
            self._close(stack, {"p"}, BLOCKS - {"p"})
        if name in ENDS:
            self._close(stack, *ENDS[name])
        if name == "body" and self.body:
            return
        parent = stack[-1]
        self.tag.append(name)
        self.parent.append(parent)
        # main content counts whatever its wrappers are called
        self.noise.append(name != "main" and self.noise[parent] or self._is_noise(stack, name, attrs))
        for values, first in (
            (self.chars, 0), (self.tags, 0), (self.link_chars, 0), (self.link_tags, int(name == "a"))
        ):
            values.append(first)
        node = len(self.tag) - 1
        if name == "body":
            self.body = node
        if name not in INLINE:
            self.parts.append((node, None))
        if name not in VOID:
            stack.append(node)

    def _is_noise(self, stack: list[int], name: str, attrs: str) -> bool:
        if name in NOISE_TAGS:
            return True
        if name in ("main", "html", "body"):
            return False
        if name == "header":
            return not any(self.tag[n] in KEEPERS for n in stack)
        if not attrs or "=" not in attrs and "hidden" not in attrs:
            return False
        suspect = False
        for key, value in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                noisy = [v for v in value.split() if noisy_name(v, name == "article")]
                if any(settled_name(v) for v in noisy):
                    return True
                suspect = suspect or bool(noisy)
            if key == "role" and value in NOISE_ROLES:
                return True
            if key == "style" and "display:none" in value.replace(" ", ""):
                return True
        if re.search(r"(?:^|\s)hidden(?:\s|/|$)", attrs):
            return True
        if suspect:
            self.suspects.add(len(self.tag) - 1)
        return False

    def _end(self, stack: list[int], name: str) -> None:
        """Closes the innermost open element of that name and all inside; else does nothing.

        An inline element never closes a block around it.
        """
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag == name:
                if name not in INLINE:
                    self.parts.append((self.parent[stack[depth]], None))
                del stack[depth:]
                return
            if name in INLINE and tag not in INLINE:
                return

    def _close(self, stack: list[int], names: set[str], upto) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[depth]]
            if tag in names:
                del stack[depth:]
                return
            if tag in upto:
                return

    def _add_up(self) -> None:
        for node in range(len(self.tag) - 1, 0, -1):
            if self.noise[node]:
                continue
            up = self.parent[node]
            self.chars[up] += self.chars[node]
            self.tags[up] += self.tags[node] + 1
            self.link_chars[up] += self.link_chars[node]
            self.link_tags[up] += self.link_tags[node]

    def densities(self) -> list[float]:
        """Composite density of every element: characters per tag, cut down by its links.

        The logarithm's base grows with the element's and the page's share of link characters;
        it is shifted so that an element of a page without links has base e.
        """
        root = self.body
        share = self.link_chars[root] / max(self.chars[root], 1)
        found = []
        for c, t, lc, lt in zip(self.chars, self.tags, self.link_chars, self.link_tags, strict=True):
            if not c:
                found.append(0.0)
                continue
            t, base = max(t, 1), math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = c / max(lc, 1) * t / max(lt, 1)
            found.append(c / t * math.log(max(ratio, 1.0)) / math.log(base + math.e - 1))
        return found

    def _densest(self, density: list[float]) -> tuple[int | None, list[float], list[int]]:
        """The element with the largest sum over its children, all sums, the elements with text."""
        total = [0.0] * len(density)
        for node in range(len(density) - 1, 0, -1):
            if not self.noise[node]:
                total[self.parent[node]] += density[node]
        inside = [node for node in range(self.body, len(total)) if not self.noise[node] and self.chars[node]]
        best = max(inside, key=lambda node: (total[node], self.chars[node], -node), default=None)
        return best, total, inside

    def chosen(self) -> list[int]:
        """The elements whose subtrees are the main text."""
        density = self.densities()
        best, total, inside = self._densest(density)
        if best is None:
            return []
        threshold, plain, node = density[best], self._plain(best), best
        while node > self.body:
            node = self.parent[node]
            threshold, plain = min(threshold, density[node]), min(plain, self._plain(node))
        keeper = self._keeper(best)
        if keeper is not None and self.tag[keeper] == "main":
            return self._without_link_blocks(keeper, best)
        if keeper is not None:
            up = self.parent[keeper]
            beside = [n for n in inside if self.tag[n] == "article" and self.parent[n] == up]
            return [keeper, *(n for n in beside if self._plain(n) >= plain)]
        within = self._articles(best)
        if sum(self.chars[n] for n in within) * 2 > self.chars[best]:
            return within
        # the element with the largest sum in each subtree
        top = list(range(len(total)))
        for node in range(len(total) - 1, 0, -1):
            up = self.parent[node]
            if not self.noise[node] and total[top[node]] > total[top[up]]:
                top[up] = top[node]
        return [best, *{top[node] for node in inside if density[node] >= threshold and node != self.body}]

    def _plain(self, node: int) -> float:
        """Characters outside links per tag: unlike the density free of the element's size."""
        return (self.chars[node] - self.link_chars[node]) / max(self.tags[node], 1)

    def _keeper(self, node: int) -> int | None:
        """The innermost article (else main) around a node."""
        for name in ("article", "main"):
            up = node
            while up > 0:
                if self.tag[up] == name:
                    return up
                up = self.parent[up]
        return None

    def _without_link_blocks(self, main: int, best: int) -> list[int]:
        """``main``; blocks in it beside the way to ``best`` that are mostly links become noise."""
        way, up = set(), best
        while up >= main:
            way.add(up)
            up = self.parent[up]
        for node in range(main + 1, len(self.tag)):
            up = self.parent[node]
            links = self.link_tags[node] > 0 and self.link_chars[node] * 2 > self.chars[node]
            beside = up in way and up != best and node not in way
            if beside and links and self.tag[node] in GROUPS:
                self.noise[node] = True
            elif up > main and self.noise[up]:
                self.noise[node] = True
        return [main]

    def _articles(self, node: int) -> list[int]:
        """The outermost articles inside a node."""
        inner, found = {node}, []
        for n in range(node + 1, len(self.tag)):
            if self.parent[n] in inner and not self.noise[n]:
                if self.tag[n] != "article":
                    inner.add(n)
                elif self.chars[n]:
                    found.append(n)
        return found

    def text(self) -> str:
        marked = [False] * len(self.tag)
        for node in self.chosen():
            marked[node] = True
        for node in range(1, len(self.tag)):
            marked[node] = not self.noise[node] and (marked[node] or marked[self.parent[node]])
        pieces = [" " if t is None else t for node, t in self.parts if marked[node] or t is None]
        return " ".join("".join(pieces).split())


def main_text(source: str) -> str:
    return Page(source).text() if source else ""


def with_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text``, the main text of ``column``."""

    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for sources in batches:
            yield sources.map(main_text).astype(object)

    return pages.withColumn("text", F.pandas_udf(extract, "string")(text_of(column)))


def extraction_report(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars)."""
    found = with_main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
