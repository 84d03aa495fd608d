"""Main text of web pages by shallow text features.

A page is cut into flat text blocks at block-level tags. Each block is
described by its word count and link density, those of its neighbours, whether
it is a heading, and whether a containing element names itself boilerplate or
content; a decision tree trained on a small labelled table (below) keeps or
drops it. Names in class, id and role are weak: they are void for an element
that holds the page's first heading or article and running text, and, where a
name holds other words too, for a page of which nothing else would be left.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import slices, text_bytes, trim

# Names of HTML elements, and words in class, id and role that tell what an element is for.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("aside button datalist dialog fieldset footer form head header label legend menu nav noscript optgroup option select".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_WORDS = frozenset(
    """ad ads advert adverts advertisement advertising adsense alert alertdialog banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies
    dialog disclaimer discussion disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted
    recommended related replies respond search share sharing sidebar signup social sponsor sponsored subscribe subscription tags toolbar widget widgets""".split()
)
CONTENT_WORDS = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

_RAW = "script|style|template|svg|math|iframe|object|textarea|xmp|noembed|noframes"
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>{_RAW})\b(?:[^>"']|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<[a-z/!?][^>]*(?:>|\Z)""",
    re.S | re.I,
)
_NAMING = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


RUNNING, ENOUGH = 20, 40  # words of a block that is running text, and of a page's worth of text
TAG, NAME, PART = 1, 2, 3  # what calls an element boilerplate: its tag, a whole name, or a part of a name


class Block(NamedTuple):
    text: str
    words: int
    density: float  # words in links of all words
    hint: int  # innermost element around it that calls itself boilerplate, 0 if none
    content: int  # 1 inside an element of content
    heading: int  # 1 in an element of heading


def _naming(tag: str, rest: str, inside: bool) -> tuple[int, int]:
    """How an element calls itself boilerplate (0 if it doesn't), and 1 if content. In content, a header is a part of it."""
    if tag in BOILER_TAGS:
        return (0, 0) if tag == "header" and inside else (TAG, 0)
    if tag in CONTENT_TAGS:
        return 0, 1
    if tag in ("html", "body") or not rest:
        return 0, 0
    boiler = content = 0
    for m in _NAMING.finditer(rest):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = [w for w in _SPLIT.split(name) if w]
            own = not CONTENT_WORDS.isdisjoint(words)
            content |= own
            bad = [w for w in words if w in BOILER_WORDS and not (w == "header" and (inside or own))]
            if bad:
                boiler = min(boiler or PART, NAME if len(bad) == len(words) else PART)
    return boiler, content


def _parse(page: str) -> tuple[list[Block], list[tuple[int, int]], int, int]:
    """Flat text blocks in page order, the elements of boilerplate (outer one, kind), and the innermost of these around the first h1 and around the first article."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, hint of its own, content
    now: Counter[str] = Counter()  # open elements by name
    hints = [(0, 0)]
    hint = content = links = heads = 0
    first = {"h1": -1, "article": -1}
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            own = len(html.unescape(" ".join(linked)).split()) if linked else 0
            out.append(Block(text, n, min(1.0, own / n), hint, int(content > 0), int(heads > 0)))
        parts.clear()
        linked.clear()

    def take(text: str) -> None:
        if text:
            parts.append(text)
            if links:
                linked.append(text)

    def leave() -> str:
        nonlocal hint, content, links, heads
        name, own, c = stack.pop()
        now[name] -= 1
        if own:
            hint = hints[own][0]
        content, links, heads = content - c, links - (name == "a"), heads - (name in HEADINGS)
        return name

    at = 0
    for m in _TOKEN.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            parts.append(" ")
        if m["end"]:
            if now[tag]:
                while leave() != tag:
                    pass
        elif tag not in VOID and not (m["rest"] or "").endswith("/"):
            while stack and stack[-1][0] in _CLOSES.get(tag, ()):
                leave()
            kind, c = _naming(tag, m["rest"], content > 0)
            if kind:
                hints.append((hint, kind))
                hint = len(hints) - 1
            mark = "article" if tag in CONTENT_TAGS else tag
            if first.get(mark) == -1:
                first[mark] = hint
            content, links, heads = content + c, links + (tag == "a"), heads + (tag in HEADINGS)
            stack.append((tag, hint if kind else 0, c))
            now[tag] += 1
    take(page[at:])
    flush()
    return out, hints, first["h1"], first["article"]


def _within(hints: list[tuple[int, int]], marked: Iterable[int]) -> list[bool]:
    """For each element of boilerplate, whether one of the marked places is inside it."""
    out = [False] * len(hints)
    for h in marked:
        if h > 0:
            out[h] = True
    for h in range(len(hints) - 1, 0, -1):
        if out[h]:
            out[hints[h][0]] = True
    return out


def features(page: str, ignore: int = 0) -> tuple[list[Block], list[tuple]]:
    """Blocks and their rows of features; elements called boilerplate in the way ``ignore`` don't count."""
    own, hints, h1, article = _parse(page)
    main = _within(hints, [h1, article])
    running = _within(hints, [b.hint for b in own if b.words >= RUNNING and b.density < 0.5])
    counts = [False] * len(hints)
    for h in range(1, len(hints)):
        outer, kind = hints[h]
        counts[h] = counts[outer] or (kind != ignore and not (kind != TAG and main[h] and running[h]))
    edge = Block("", 0, 0.0, 0, 0, 0)
    rows = [
        (x.words, x.density, b.words, b.density, y.words, y.density, int(counts[b.hint]), b.content, b.heading)
        for x, b, y in zip([edge, *own], own, [*own[1:], edge], strict=False)
    ]
    return own, rows


# The labelled table, as short pages. A block is its words, the tenths of them in links, n in an element
# named boilerplate, c in one of content, h for a heading, and whether it is kept.
LABELLED = """
1,10- 1,10- 2,10- 1,10- 8,0h+ 60,0+ 45,1+ 70,0+ 3,0- 6,10-
3,10- 12,0n- 9,0h+ 80,0+ 40,0+ 55,2+ 30,0n- 25,4n- 4,10-
4,10- 50,0+ 60,0+ 40,2+ 6,10- 3,10- 4,0- 2,10-
6,10n- 1,10n- 1,10n- 9,0n- 12,0hc+ 80,0c+ 60,1c+ 5,0c+ 40,0c+ 20,0n- 30,0n-
1,10n- 1,10n- 1,10n- 8,0n- 7,0hc+ 3,0c+ 120,0c+ 2,0c+ 90,0c+ 12,0n- 200,0n- 60,0n-
10,10- 30,0+ 25,0+ 9,0+ 45,0+ 4,0+ 38,0+ 2,0+ 28,0+
12,10- 18,0+ 40,0+ 14,0+ 35,0+ 33,7- 3,10- 8,9-
5,10- 5,0h+ 100,0+ 6,0h+ 70,0+ 4,0h+ 90,0+ 5,0- 3,10- 3,10-
2,10- 2,10- 11,10hc+ 65,0c+ 12,10c- 50,1c+ 8,10c- 6,10c- 15,0n-
7,0hc+ 30,3c+ 9,10c- 22,0c+ 18,9c- 44,0c+ 5,8c- 5,9n- 5,0n-
4,0- 3,10- 6,10- 150,0+ 130,0+ 20,8- 16,6- 110,0+
1,10n- 3,0hc+ 2,0c+ 1,0c+ 3,0c+ 4,0n- 9,0n-
16,0n- 10,0hc+ 1,0c+ 3,0c+ 12,0c+ 2,0n- 40,0n- 1,0n-
2,0n- 5,0hc+ 7,0c+ 7,2c+ 3,0c+ 80,0n- 90,1n- 70,0n-
40,10- 24,9- 60,10- 15,0h+ 26,0+ 200,1+ 300,0+ 50,7- 30,6-
3,0- 4,10- 5,0- 2,10- 6,0h- 5,10- 4,0h- 7,10-
3,0hn- 40,0n- 6,0hn- 35,2n- 2,10n- 6,0hc+ 34,0c+ 4,0hn- 7,10n- 9,10n-
14,0c+ 16,0c+ 11,0c+ 6,4c+ 8,5c+ 35,5c+ 60,6c- 9,7c- 13,10c-
2,0hc+ 1,0c+ 4,0c+ 2,0c+ 3,0c+ 1,0c+ 150,0c+ 3,0c+ 19,0c+ 6,0c+ 6,0c+ 35,0c+ 4,0c+ 13,0c+ 13,0c+ 2,0c+
1,0c+ 90,0c+ 12,0hc+ 22,0c+ 5,0hc+ 4,0c+ 3,0c+ 10,0c+ 80,0c+ 17,0c+ 1,0c+ 20,0c+ 9,0c+ 7,0c+ 250,0c+ 1,0c+
8,0n- 3,0c+ 11,0c+ 5,0n- 9,0c+ 2,0c+ 1,10n- 14,0c+ 4,0c+ 24,0n- 18,0c+ 5,0c+ 60,0n- 7,0c+ 45,0c+ 3,0n-
6,3c+ 12,4c+ 4,2c+ 9,3c+ 2,0c+ 15,4c+ 20,3c+ 3,3c+ 30,4c+ 10,2c+ 8,4c+ 3,10c- 5,10c- 7,10c- 2,10c- 20,10c-
4,0c+ 3,10c- 5,0c+ 4,10c- 6,0c+ 2,10c- 3,0c+ 9,10c- 7,0c+ 5,10c- 6,0hc+ 12,10c- 1,0c+ 4,10c- 5,0c+ 3,10n- 4,0c+ 1,10-
3,10- 20,0+ 22,0+ 18,0+ 25,0+ 21,0+ 17,0+ 24,1+ 19,0+ 40,0+ 20,0+
16,0+ 24,0+ 19,0+ 4,10- 3,10- 28,0+ 35,0+ 21,0+ 2,10- 6,10-
22,0+ 35,0+ 20,0+ 50,0+ 27,0+ 23,1+ 4,0- 4,0- 2,10- 3,0- 21,0+ 22,0+ 5,0-
21,0+ 21,0+
2,10- 26,0+ 26,0+
5,0h+ 35,0+ 18,0+
80,0+ 30,0+ 3,0-
15,0+ 22,0+ 60,0+ 5,0-
24,0+ 28,0+ 33,0+ 2,0-
18,0+ 90,0+ 45,0+
7,0h+ 23,0+ 32,0+ 16,0+
40,0+ 75,0+ 6,0-
28,0+ 200,0+ 70,0+
3,0- 30,10- 4,0- 45,10- 5,0- 35,9- 2,0- 28,10- 6,0- 50,10-
4,10- 9,0- 5,10- 11,0- 6,10- 12,0- 7,10- 8,0- 5,10- 10,0- 6,9- 13,0- 4,10-
4,10c- 9,0c+ 5,10c- 11,0c+ 6,10c- 3,0c+ 40,10c- 12,0c+ 5,10c-
1,0h+ 21,0+ 22,0+ 2,0h+ 18,0+ 4,0h+ 16,0+ 1,0h+ 19,0+ 3,0h+ 24,0+ 2,0h+ 15,0+ 3,0- 3,10-
10,10c- 3,0c+ 30,0c+ 8,10c- 5,0c+ 22,0c+ 5,10c- 2,0c+ 18,0c+ 9,10c- 4,0c+ 3,0c+ 2,10c- 1,0c+ 50,0c+
300,0+ 20,0+ 250,0+ 500,1+ 15,0+ 12,0+ 21,2+ 17,4+ 23,6-
500,0c+ 1,0c+ 400,0c+ 25,1n- 600,0n- 350,2n- 50,0n-
20,10- 14,10- 30,10- 9,8- 11,10- 3,6- 3,0- 5,0- 4,0- 6,10-
""".split("\n")
_MARK = re.compile(r"(\d+),(\d+)([nch]*)([+-])")


def labelled(table: Iterable[str] = LABELLED) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features and whether each is kept."""
    rows, kept = [], []
    for line in table:
        own = [(int(m[1]), int(m[2]) / 10, *(int(f in m[3]) for f in "nch"), m[4] == "+") for m in _MARK.finditer(line)]
        for x, b, y in zip([(0, 0.0), *own], own, [*own[1:], (0, 0.0)], strict=False):
            rows.append((*x[:2], *b[:2], *y[:2], *b[2:5]))
            kept.append(b[5])
    return np.array(rows, float).reshape(-1, 9), np.array(kept, float)


class Tree:
    """Binary decision tree by Gini impurity; ties take the first feature and the lowest cut."""

    def __init__(self, rows: np.ndarray, kept: np.ndarray, depth: int = 10):
        self.keep = bool(kept.mean() >= 0.5) if len(kept) else False
        self.feature = -1
        if depth == 0 or len(set(kept.tolist())) < 2:
            return
        best = (self._gini(kept) * len(kept) - 1e-9, -1, 0.0)
        for f in range(rows.shape[1]):
            values = np.unique(rows[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                low = rows[:, f] <= cut
                cost = self._gini(kept[low]) * low.sum() + self._gini(kept[~low]) * (~low).sum()
                if cost < best[0] - 1e-12:
                    best = (cost, f, float(cut))
        if best[1] >= 0:
            _, self.feature, self.cut = best
            low = rows[:, self.feature] <= self.cut
            self.low, self.high = Tree(rows[low], kept[low], depth - 1), Tree(rows[~low], kept[~low], depth - 1)

    @staticmethod
    def _gini(kept: np.ndarray) -> float:
        p = kept.mean() if len(kept) else 0.0
        return 2 * p * (1 - p)

    def __call__(self, row: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if row[node.feature] <= node.cut else node.high
        return node.keep


def train(table: Iterable[str] = LABELLED) -> Tree:
    return Tree(*labelled(table))


def main_text(page: str, tree: Tree) -> str:
    """Kept blocks of a page, joined by an empty line."""
    own, rows = features(page)
    kept = [b.text for b, row in zip(own, rows, strict=True) if tree(row)]
    if not kept:
        own, rows = features(page, ignore=PART)
        again = [b for b, row in zip(own, rows, strict=True) if tree(row)]
        if sum(b.words for b in again) >= ENOUGH:
            kept = [b.text for b in again]
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row; null and empty pages give an empty text.

    Repeated rows appear each; other columns are ignored; an empty table gives no
    rows. Long pages are read whole, in time that grows with their length.
    """
    tree = train()
    kept = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept.schema] + ["text string", "n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for b in slices(batches):
            texts = [main_text(p.decode(), tree) for p in text_bytes(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html")).mapInArrow(run, schema)
