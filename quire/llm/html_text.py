"""Main text of HTML pages: flat text blocks classified by a decision tree over word counts and link densities.

A page is read as a flat list of text blocks, one for each stretch between block-level tags, in one pass over the page
whose cost is linear in its length. Every block carries the word count and link density of itself and of its neighbours,
a count of enclosing elements that mark page furniture, and whether it stands in the page's article. A small decision
tree, trained here on the labelled blocks of a table of page layouts, decides which blocks are main text. Where a page
marks its article, that decides most; where it does not, words, links and neighbours do.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>=]")
_QUOTE = re.compile(r"\s*([\"'])")
#: Elements nested deeper than this are read as standing beside one another, as browsers do.
MAX_DEPTH = 512
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noframes", "svg", "math", "template")}

#: Elements whose text flows in the block around them; all others end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never read.
HIDDEN = frozenset("head script style noscript template iframe object svg math select option textarea button datalist audio video canvas map title xmp noframes applet".split())
FURNITURE = frozenset("nav header footer aside form menu dialog fieldset address".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role values that name page furniture.
FURNITURE_WORDS = re.compile(
    r"(?:ads?|advert\w*|adbox|adslot|banners?|breadcrumbs?|comment\w*|complementary|consent|contentinfo|cookies?\w*|copyright|dialog|disclaimer|disqus\w*|footer\w*|gdpr|header|masthead|menu\w*|modal|"
    r"nav\w*|newsletter\w*|notices?|notifications?|pager|pagination|paywall|popup|privacy|promo\w*|recommend\w*|related\w*|repl(?:y|ies)|respond|search\w*|share\w*|sharing|sidebar\w*|signup|skip|social\w*|"
    r"sponsor\w*|subscri\w*|tags|teasers?|toc|toolbar|tracking|widget\w*|alert)\Z",
    re.I,
)
#: Parts of a value that say what a page has or lacks, not what the element is, and parts that make a header the text's own.
_ABOUT = re.compile(r"(?:has|no|with|without|is|js)\Z", re.I)
_OWN_HEADER = re.compile(r"(?:article|entry|post|story|content|title|headline)\Z", re.I)
#: p, li and the like end where a like one begins, whatever stands between in inline elements.
_SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body nav aside header footer form blockquote".split())

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "furniture", "in_main")


class Block:
    __slots__ = ("text", "words", "linked", "furniture", "in_main", "heading", "loose")

    def __init__(self, text: str, linked: int, furniture: int, in_main: int, heading: int, loose: tuple[int, ...] = ()):
        self.text, self.words, self.linked, self.furniture, self.in_main, self.heading = text, len(text.split()), linked, furniture, in_main, heading
        self.loose = loose  # numbers of the enclosing elements that are furniture only if they do not hold the page's text


def _names_furniture(value: str, in_main: int) -> bool:
    for name in value.replace("sideBar", "sidebar").replace("side-bar", "sidebar").split():
        parts = re.split(r"[-_]+", name)
        if any(map(_ABOUT.match, parts)):
            continue
        for part in parts:
            if FURNITURE_WORDS.match(part) and not (part.lower() == "header" and (in_main or any(map(_OWN_HEADER.match, parts)))):
                return True
    return False


FIRM, LOOSE = 1, 2


def _furniture(tag: str, attributes: str, in_main: int) -> int:
    """0, FIRM, or LOOSE for a form or a name, which can also be that of an element around the whole text."""
    kind = 0
    if tag in FURNITURE and not (tag in ("header", "address") and in_main):
        if tag != "form":
            return FIRM
        kind = LOOSE
    if not attributes or tag in ("body", "html", "main"):
        return kind
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role", "data-role") and _names_furniture(value, in_main):
            kind = LOOSE
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return FIRM
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return FIRM
    return kind


#: A block of more unlinked words than this, outside all furniture, is text that a page has beside a loose element.
TEXT_WORDS = 20


def _settle(found: list[Block]) -> None:
    """Count loose elements as furniture, but for those around the page's text.

    Such an element holds most of the page's words, and its title (h1) or all of its longer text.
    """
    held: dict[int, int] = {}
    titled: set[int] = set()
    total, outside = 0, False
    for b in found:
        if b.furniture:
            continue
        total += b.words
        outside |= not b.loose and b.words - b.linked > TEXT_WORDS
        for e in b.loose:
            held[e] = held.get(e, 0) + b.words
        if b.heading == 1:
            titled.update(b.loose)
    around = {e for e, words in held.items() if 2 * words > total and (e in titled or not outside)}
    for b in found:
        b.furniture += sum(e not in around for e in b.loose)


def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
    """The place of the > that ends a tag, or -1. Quotes count after = only, and only if they are closed (last: where each quote last stands)."""
    while m := _STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        q = _QUOTE.match(page, at)
        if q and last[q[1]] >= q.end():
            at = page.index(q[1], q.end()) + 1
    return -1


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order; unclosed and stray tags are read as browsers do, in outline."""
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    loose: list[int] = []
    titles: list[int] = []
    furniture = in_main = anchors = hidden = elements = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, len(html.unescape(" ".join(linked)).split()), furniture, in_main, min(titles, default=0), tuple(loose)))
            parts.clear()
            linked.clear()

    def pop() -> None:
        nonlocal furniture, in_main, anchors, hidden
        tag, was_furniture = stack.pop()
        open_[tag] -= 1
        if tag not in INLINE:
            flush()
        furniture -= was_furniture == FIRM
        if was_furniture == LOOSE:
            loose.pop()
        in_main -= tag in MAIN
        anchors -= tag == "a"
        hidden -= tag in HIDDEN
        if tag in HEADINGS:
            titles.pop()

    def text(value: str) -> None:
        if value and not hidden:
            parts.append(value)
            if anchors:
                linked.append(value)

    at = 0
    n = len(page)
    last = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        start = page.find("<", at)
        text(page[at:start] if start >= 0 else page[at:])
        if start < 0:
            break
        if m := _MARK.match(page, start):
            if m[0].startswith("<![CDATA["):
                text(html.escape(m[0][9:].removesuffix("]]>")))
            at = m.end()
            continue
        m = _NAME.match(page, start)
        if m is None:
            # </ before what is no name begins a comment that ends at >
            at = page.find(">", start) + 1 or n if page.startswith("</", start) else start + 1
            if at == start + 1:
                text("<")
            continue
        end = _tag_end(page, m.end(), last)
        if end < 0:  # a tag cut off by the end of the page is no text
            break
        attributes, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if open_[tag]:
                if tag in INLINE:
                    # an inline end tag does not close the blocks opened inside it
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            if all(s[0] in INLINE for s in stack[i:]):
                                while len(stack) > i:
                                    pop()
                            else:
                                anchors -= tag == "a"
                                open_[tag] -= 1
                                open_["span"] += 1
                                stack[i] = ("span", stack[i][1])
                            break
                else:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
            elif tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            ends = _SELF_CLOSING.get(tag)
            if ends or tag not in INLINE:
                ends = ends or {"p"}
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in _SCOPE:
                        break
        elif tag == "br":
            text(" ")
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = n if close < 0 else close + 1
            continue
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if len(stack) >= MAX_DEPTH:
            pop()
        is_furniture = _furniture(tag, attributes, in_main)
        stack.append((tag, is_furniture))
        open_[tag] += 1
        furniture += is_furniture == FIRM
        if is_furniture == LOOSE:
            elements += 1
            loose.append(elements)
        in_main += tag in MAIN
        anchors += tag == "a"
        hidden += tag in HIDDEN
        if tag in HEADINGS:
            titles.append(int(tag[1]))
    flush()
    _settle(out)
    return out


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; beyond the ends stand empty blocks.

    in_main is 1 in the page's article or main element and 0 beside it. Where a page has none, or only furniture in it, it
    is 0.5 for all blocks.
    """
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    if not n:
        return x
    w = np.array([b.words for b in found], float)
    d = np.array([min(1.0, b.linked / b.words) for b in found])
    x[:, 0], x[:, 1] = w, d
    x[1:, 2], x[1:, 3] = w[:-1], d[:-1]
    x[:-1, 4], x[:-1, 5] = w[1:], d[1:]
    x[:, 6] = [min(b.furniture, 1) for b in found]
    x[:, 7] = [min(b.in_main, 1) for b in found] if any(b.in_main and not b.furniture for b in found) else 0.5
    return x


# Labelled blocks, as layouts of ordinary pages. A line is markup, or a block: 1 for main text or 0, its element, its
# words and how many of them are linked. Pages with an article or main element, pages without, pages without any names.
LAYOUTS = """
<nav> / 0 li 1 1 / 0 li 2 2 / 0 li 1 1 / </nav><article> / 1 h1 7 0 / 0 div.share 3 3 / 1 p 60 2 / 1 p 1 0 / 1 p 35 0 / 1 h2 3 0 / 1 li 6 6 / 1 li 9 9 / 1 li 4 0 / 1 p 80 4 / 0 div.related 5 5 / </article> / 0 footer 12 3
<header> / 0 p 4 4 / </header><main> / 1 h1 2 0 / 1 p 3 0 / 1 p 2 2 / 1 p 14 0 / 1 td 1 0 / 1 td 2 0 / 1 p 22 11 / </main><aside> / 0 p 40 0 / 0 p 25 3 / </aside> / 0 div 30 0 / 0 div 6 6
<div> / 0 div 25 1 / 0 p 6 1 / </div><article> / 1 p 120 0 / 1 p 70 9 / 0 div.ad 20 0 / 1 p 2 0 / </article><section> / 0 h3 1 0 / 0 p 45 0 / 0 p 80 0 / </section>
<nav> / 0 a 1 1 / 0 a 1 1 / </nav><main><article> / 1 h1 9 0 / 1 li 1 1 / 1 li 2 2 / 1 li 1 1 / 1 p 5 5 / 0 form 8 0 / 0 nav 2 2 / </article></main> / 0 p 50 0
0 div 14 2 / 0 li 1 1 / 0 li 1 1 / 0 li 2 2 / 0 li 1 1 / 1 h1 8 0 / 1 p 70 0 / 1 p 45 3 / 1 h2 4 0 / 1 p 90 1 / 1 p 12 0 / 1 p 55 0 / 0 li 6 6 / 0 li 7 7 / 0 li 5 5 / 0 p 9 0 / 0 p 5 2
0 p 10 0 / 0 a 2 2 / 0 a 1 1 / 1 h1 5 0 / 1 p 40 0 / 1 p 30 2 / 1 p 8 0 / 1 p 65 0 / 0 div.comments 30 0 / 0 div.comments 60 0 / 0 p 7 4
0 div 22 1 / 0 div 1 1 / 0 div 3 3 / 0 div 2 2 / 1 h2 6 0 / 1 div 33 0 / 1 div 48 6 / 1 h3 2 0 / 1 div 28 0 / 0 div 4 4 / 0 div 3 3 / 0 div 6 1
0 td 2 2 / 0 td 3 3 / 0 td 1 1 / 0 td 4 4 / 1 td 85 2 / 1 td 60 0 / 1 td 110 8 / 0 td 3 3 / 0 td 2 2 / 0 td 8 0
0 span 3 1 / 0 div 18 1 / 0 li 2 2 / 0 li 2 2 / 1 h1 11 0 / 1 p 26 0 / 1 p 18 0 / 1 p 37 5 / 1 p 24 0 / 1 li 10 0 / 1 li 14 0 / 1 li 9 0 / 1 p 31 0 / 0 p 6 3 / 0 p 4 4 / 0 p 3 0
<div.sidebar> / 0 p 30 0 / 0 li 3 3 / 0 p 60 2 / </div> / 1 h1 4 0 / 1 p 52 0 / 1 blockquote 16 0 / 1 p 44 1 / <footer> / 0 p 20 0 / 0 p 35 4 / </footer>
1 p 4 0 / 1 p 9 0 / 1 p 6 0 / 1 p 11 0
1 h1 3 0 / 1 p 25 0
0 li 1 1 / 0 li 1 1 / 0 li 3 3 / 0 li 2 2
1 p 75 0 / 1 p 42 2 / 1 p 130 0
1 p 12 0
1 p 1 0
<article> / 1 p 1 0
<article> / 1 p 20 8 / 1 p 50 0 / 1 p 25 10 / </article>
<article> / 1 p 3 1 / 1 p 40 0 / 1 p 2 1 / 1 p 60 2 / </article>
<article> / 1 h2 6 2 / 1 p 90 3 / </article>
<main> / 1 h1 8 0 / 1 p 18 2 / 1 p 14 0 / </main>
<article> / 1 h1 3 0 / 1 p 16 0 / 1 p 28 1 / </article>
1 h1 6 0 / 1 p 18 0 / 1 p 30 0
<article> / 1 p 1 0 / 1 p 1 0 / </article>
<main> / 1 h1 2 0 / 1 p 30 12 / </main> / 0 li 2 2
<main> / 1 p 3 1 / 1 p 9 4 / 1 p 14 7 / </main> / 0 p 30 2
<article> / 1 p 7 3 / 1 p 5 2 / 1 li 8 3 / 1 li 12 5 / 1 li 9 4 / </article> / 0 p 3 0
<article> / 1 p 8 8 / </article> / 0 p 8 8 / 0 p 12 0
0 li 1 1 / 0 li 2 2 / 0 li 1 1 / 1 h1 5 0 / 1 p 60 20 / 1 p 48 15 / 1 p 33 14 / 1 p 90 12 / 1 p 41 17 / 1 p 25 9 / 1 p 55 9 / 0 li 5 5 / 0 li 6 5 / 0 li 7 6 / 0 p 3 2
0 p 5 5 / 0 p 4 3 / 1 h1 4 0 / 1 p 36 6 / 1 p 70 24 / 1 p 29 5 / 1 p 44 0 / 0 p 6 2 / 0 p 4 4 / 0 p 9 3
0 p 16 1 / 0 li 1 1 / 0 li 2 2 / 1 h1 6 0 / 1 p 21 0 / 1 p 3 0 / 1 p 50 0 / 1 p 2 0 / 1 p 34 0 / 0 li 4 4 / 0 li 8 8 / 0 p 11 2
"""


def _layout(line: str) -> tuple[str, list[int]]:
    """A page of LAYOUTS and the labels of its blocks. name.class: an element with a class."""
    parts, labels = [], []
    for item in line.split(" / "):
        if item.startswith("<"):
            parts.append(re.sub(r"<(\w+)\.(\w+)>", r"<\1 class='\2'>", item))
            continue
        label, tag, words, linked = item.split()
        tag, _, name = tag.partition(".")
        labels.append(int(label))
        parts.append(f"<div><{tag} class='{name}'><a>{'x ' * int(linked)}</a>{'x ' * (int(words) - int(linked))}</{tag}></div>")
    return "".join(parts), labels


def labelled(layouts: str = LAYOUTS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of all blocks of the layouts."""
    xs, ys = [], []
    for line in layouts.strip().split("\n"):
        page, labels = _layout(line)
        x = features(blocks(page))
        assert len(x) == len(labels), line
        xs.append(x)
        ys += labels
    return np.concatenate(xs), np.array(ys)


class Tree:
    """A binary decision tree: Gini splits, grown until leaves are pure or depth is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 10):
        self.label = bool(y.mean() >= 0.5)
        self.feature: int | None = None
        if depth == 0 or y.min() == y.max():
            return
        best = (self._gini(y) - 1e-9, None, None)
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for cut in (values[:-1] + values[1:]) / 2:
                left = x[:, f] <= cut
                score = (left.sum() * self._gini(y[left]) + (~left).sum() * self._gini(y[~left])) / len(y)
                if score < best[0] - 1e-12:
                    best = (score, f, cut)
        if best[1] is None:
            return
        _, self.feature, self.cut = best
        left = x[:, self.feature] <= self.cut
        self.low, self.high = Tree(x[left], y[left], depth - 1), Tree(x[~left], y[~left], depth - 1)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None:
            return np.full(len(x), self.label)
        left = x[:, self.feature] <= self.cut
        out = np.empty(len(x), bool)
        out[left], out[~left] = self.low.predict(x[left]), self.high.predict(x[~left])
        return out

    def rules(self, indent: str = "") -> str:
        if self.feature is None:
            return f"{indent}{'main' if self.label else 'no'}\n"
        at = f"{FEATURES[self.feature]} <= {self.cut:g}"
        return f"{indent}if {at}\n{self.low.rules(indent + '  ')}{indent}else\n{self.high.rules(indent + '  ')}"


@lru_cache(1)
def trained() -> Tree:
    return Tree(*labelled())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The main text of one page: chosen blocks in page order, joined by two line feeds."""
    found = blocks(page or "")
    chosen = (tree or trained()).predict(features(found)) if found else []
    return "\n\n".join(b.text for b, keep in zip(found, chosen, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages.

    A null or empty html, or one without main text, gives an empty text. Repeated rows give repeated results; other
    columns are not read; an empty table gives an empty result. Narrow map over whole pages: no shuffle, one page at a
    time in memory beside its Arrow batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = trained()
        for batch in batches:
            texts = [main_text(p.as_py(), tree) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
