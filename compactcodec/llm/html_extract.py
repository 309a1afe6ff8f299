"""Main text of web pages by the maximum-scoring contiguous run of tokens.

A page is a sequence of words and tags.  Words score positive, the more so the likelier their
surroundings hold content; tags score negative, the more so the likelier they stand outside it.  Both
weights come from labelled pages, which mark their article in the markup: their elements and their
words of class, id and role are the features.  Labels serve for fitting only; every page, marked or
not, is scored by weights, and one linear scan finds the best run.  Of that run, text is left out that
stands in an element whose kind or whole name weighs as heavily for the outside as ``OUT``.

Labelled pages that never show a form, a notice or readers' comments can't teach their weights, so the
fit starts from a prior of a few words outside for elements and names that say so by themselves.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: most pages from which weights are fitted, and most bytes of each
SAMPLE, SAMPLE_BYTES = 400, 1 << 18
SMOOTH = 1.0
LEAST_WORD, MOST_WORD = 0.005, 6.0
LEAST_TAG, MOST_TAG, MOST_INLINE = 0.02, 2.0, 0.5
#: a word in surroundings that no labelled page has
UNSEEN_WORD = 0.5

#: words outside, by which the fit starts for the elements and names below, and the weight of what is left out within a run
PRIOR, OUT = 20, -2.0
#: elements whose text is never content
OUTSIDE = frozenset("nav footer aside form script style noscript template iframe object svg math canvas select option button textarea input label dialog menu head title audio video".split())
#: whole classes, ids and roles that say the same
OUTSIDE_NAMES = frozenset("ad ads advert advertisement sponsored menu navigation breadcrumb breadcrumbs sidebar complementary contentinfo cookie-notice cookie-banner notice newsletter related comment comments reply replies".split())
#: elements whose content is text up to their own end tag
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: elements that leave no gap in the text around them
UNSEEN = INLINE | frozenset("script style template noscript meta link".split())
#: elements that mark the article; they are labels and no features
LABELS = frozenset(("article", "main"))
#: features that the fit takes for outside until pages say otherwise
PRIORS = OUTSIDE | frozenset(f"={x}" for x in OUTSIDE_NAMES) | frozenset(("header", "hidden"))
#: elements that say nothing of the text in them, and those of which only names do
PLAIN = INLINE | LABELS | frozenset(("", "html", "body"))
GENERIC = frozenset(("div", "section"))
#: elements whose kind says something of all that stands in them, however deep
SECTIONS = OUTSIDE | GENERIC | frozenset(("header", "inner header", "hidden"))
#: start tags that end an open element of these names, and what bounds the search
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = frozenset("ul ol dl table select".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: elements beyond which an implied end tag does not look
BOUNDS = frozenset("html body article main section div table ul ol dl td th blockquote aside nav footer header form".split())

_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}\s*(?:>|\Z)", re.IGNORECASE) for tag in RAW}


def _names(attrs: str) -> tuple[list[str], bool]:
    """Whole classes, id and role in lower case, and whether the element is hidden."""
    if "=" not in attrs and "hidden" not in attrs:
        return [], False
    whole, hidden = [], False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            whole += value.lower().split()
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
    return whole, hidden


class Element:
    """An open or closed element: its features, what it stands in, and what its text inherits."""

    __slots__ = ("tag", "parent", "features", "kinds", "wide", "inside", "outside", "block", "names", "link", "bound_at", "p_at", "level")

    def __init__(self, tag: str, parent: Element | None, names: list[str], hidden: bool, level: int):
        self.tag, self.parent, self.level = tag, parent, level
        self.inside = tag in LABELS or bool(parent and parent.inside)
        named = names if tag not in PLAIN - INLINE else []
        words = sorted({f".{w}" for x in named for w in _NAME.findall(x)})
        # a header belongs to what it stands in, at the top to the site
        kind = "inner header" if tag == "header" and (self.inside or parent is not None and parent.bound_at >= 0 and parent.block == "section") else tag
        self.kinds = [f for f in (kind, *[f"={x}" for x in named], *["hidden"] * hidden) if f not in PLAIN]
        self.features = [f for f in self.kinds if not (f in GENERIC and words)] + words
        self.wide = [f for f in self.features if f[0] in ".=" or f in SECTIONS]
        self.outside = not PRIORS.isdisjoint(self.kinds) or bool(parent and parent.outside)
        self.block, self.names = (parent.block, parent.names) if tag in INLINE and parent else (tag, "".join(words))
        self.link = tag == "a" or tag in INLINE and bool(parent and parent.link)
        self.bound_at = level if tag in BOUNDS else parent.bound_at if parent else -1
        self.p_at = level if tag == "p" else -1 if tag in BOUNDS or not parent else parent.p_at


class Token:
    """A tag with its features, or a piece of text, and the element around it."""

    __slots__ = ("text", "tag", "features", "element", "outside")

    def __init__(self, text: str | None, tag: str, features: list[str], element: Element, outside: bool):
        self.text, self.tag, self.features, self.element, self.outside = text, tag, features, element, outside


class Tokeniser:
    """Tags and texts of a page in order.  Open elements are found by name, so that nesting of any depth costs no search."""

    def __init__(self, page: str):
        self.tokens: list[Token] = []
        self.elements = [Element("", None, [], False, -1)]
        self.stack: list[Element] = []
        self.open: dict[str, list[int]] = defaultdict(list)
        self.run(page)

    def top(self) -> Element:
        return self.stack[-1] if self.stack else self.elements[0]

    def text(self, piece: str) -> None:
        if piece:
            e = self.top()
            self.tokens.append(Token(html.unescape(piece), "", [], e, e.outside))

    def pop_to(self, level: int) -> None:
        while len(self.stack) > level:
            self.open[self.stack.pop().tag].pop()

    def close(self, tag: str) -> None:
        if levels := self.open[tag]:
            # an inline element is not closed from beyond a bound
            if not (tag in INLINE and self.top().bound_at > levels[-1]):
                self.pop_to(levels[-1])

    def imply(self, tag: str) -> None:
        """End what this start tag ends."""
        if tag in ENDS_P and (p := self.top().p_at) >= 0:
            self.pop_to(p)
        if tag in CLOSES:
            bound = max((x[-1] for t in LISTS if (x := self.open[t])), default=-1)
            found = max((x[-1] for t in CLOSES[tag] if (x := self.open[t])), default=-1)
            if found > bound:
                self.pop_to(found)

    def run(self, page: str) -> None:
        at = 0
        for m in _MARK.finditer(page):
            if m.start() < at:
                continue
            self.text(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.text(m[0][9:].removesuffix("]]>"))
                continue
            tag = m[2].lower()
            if m[1]:
                e = self.stack[levels[-1]] if (levels := self.open[tag]) else self.top()
                self.tokens.append(Token(None, tag, e.features if e.tag == tag and e.features else [tag], self.top(), e.outside if e.tag == tag else self.top().outside))
                self.close(tag)
                continue
            self.imply(tag)
            attrs, parent = m[3] or "", self.top()
            names, hidden = _names(attrs)
            e = Element(tag, parent, names, hidden, len(self.stack))
            self.tokens.append(Token(None, tag, e.features or [tag], parent, e.outside))
            if tag in RAW:
                end = _RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                self.elements.append(e)
                self.stack.append(e)
                self.open[tag].append(e.level)
        self.text(page[at:])


def _surroundings(e: Element) -> tuple[str, str]:
    """Block, its names and whether a link is around; and the same without names."""
    block, link = e.block if e.block not in PLAIN else "", " a" if e.link else ""
    return f"{block}{e.names}{link}", f"{block}{link}"


def fit_weights(pages: list[str]) -> dict[str, dict[str, float]]:
    """Log-odds weights from pages that mark their article; others are passed over.

    ``words``: by block and link around them; ``within``: by each feature of the elements around them;
    ``tags``: by element and by each word of class, id and role.
    """
    words = {True: Counter(), False: Counter()}
    within, tags = ({True: Counter(), False: Counter(dict.fromkeys(PRIORS, PRIOR))} for _ in range(2))
    for page in pages:
        made = Tokeniser(page or "")
        if not any(e.inside for e in made.elements):
            continue
        held: dict[int, list[int]] = defaultdict(lambda: [0, 0])
        for t in made.tokens:
            content = t.element.inside and not t.outside
            if t.text is None:
                tags[content].update(t.features)
            else:
                n = len(t.text.split())
                words[content].update(dict.fromkeys(_surroundings(t.element), n))
                held[id(t.element)][content] += n
        for e in reversed(made.elements):  # those within come later, so sums go outwards
            out, content = held[id(e)]
            for f in e.wide:
                within[False][f] += out
                within[True][f] += content
            if e.parent is not None:
                above = held[id(e.parent)]
                above[0] += out
                above[1] += content
    odds = lambda c, f: math.log((c[True][f] + SMOOTH) / (c[False][f] + SMOOTH))
    return {
        "words": {f: odds(words, f) for f in words[True] | words[False]},
        "within": {f: min(0.0, odds(within, f)) for f in within[True] | within[False]},
        "tags": {f: -min(MOST_INLINE if f in INLINE else MOST_TAG, max(LEAST_TAG, -odds(tags, f))) for f in tags[True] | tags[False]},
    }


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run with the largest sum, the longest of such; start and end."""
    best, at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and i + 1 - start > at[1] - at[0]:
            best, at = total, (start, i + 1)
    return at


def main_text(page: str | None, weights: dict[str, dict[str, float]]) -> str:
    """Blocks of the best run, each with single spaces, joined by a space."""
    if not page:
        return ""
    made = Tokeniser(page)
    words, within, tags = weights["words"], weights["within"], weights["tags"]
    # the least of the weights of all elements around, from the outermost inwards, and what is left out
    around: dict[int, float] = {}
    left_out: dict[int, bool] = {}
    for e in made.elements:
        own = min((within.get(f, 0.0) for f in e.wide), default=0.0)
        out = any(within.get(f, 0.0) <= OUT for f in e.kinds)
        around[id(e)] = min(own, around[id(e.parent)]) if e.parent is not None else own
        left_out[id(e)] = out or e.parent is not None and left_out[id(e.parent)]
    scores = []
    for t in made.tokens:
        if t.text is None:
            least = -LEAST_TAG if t.tag in LABELS or t.tag in RAW else min(tags.get(f, -LEAST_TAG) for f in t.features)
            # an element that is left out is no sign that the text around it ends
            scores.append(max(least, -MOST_INLINE) if t.outside else least)
        elif left_out[id(t.element)]:
            scores.append(LEAST_WORD * len(t.text.split()))
        else:
            named, plain = _surroundings(t.element)
            one = words.get(named, words.get(plain, UNSEEN_WORD))
            scores.append(min(MOST_WORD, max(LEAST_WORD, one + around[id(t.element)])) * len(t.text.split()))
    start, end = best_run(scores)
    blocks, held = [], []
    for t in made.tokens[start:end]:
        if t.text is None:
            if t.tag not in UNSEEN:
                blocks.append("".join(held))
                held = []
        elif not left_out[id(t.element)]:
            held.append(t.text)
    blocks.append("".join(held))
    return " ".join(x for x in (" ".join(b.split()) for b in blocks) if x)


def labelled_sample(pages: DataFrame, html_col: str = "html", most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[str]:
    """``most`` pages of at most ``most_bytes`` that mark their article, the first by a hash; they alone reach the driver."""
    small = pages.select(F.col(html_col).alias("html"), F.xxhash64(html_col).alias("h")).where(F.octet_length(html_col) <= most_bytes)
    mark = F.col("html").rlike("(?i)<(?:article|main)[ >]")
    # hashes alone find the last of them, so that no task sends pages that others push out
    first = [r["h"] for r in small.where(mark).select("h").orderBy("h").limit(most).collect()]
    if not first:
        return []
    chosen = small.where((F.col("h") <= first[-1]) & mark).groupBy("h").agg(F.first("html").alias("html"))
    return [r["html"] for r in chosen.orderBy("h").collect()]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    """``pages`` with ``text_col``, the main text of each page.

    A null or empty page has an empty text, and so has one without content.  Pages are read whole.
    Rows are independent: repeated rows, null ids and extra columns pass, a column of the result's
    name is replaced.  If none are given, weights are fitted on at most ``SAMPLE`` pages of at most
    ``SAMPLE_BYTES`` that mark their article, chosen by a hash and so the same at any layout; without
    any labelled page all words weigh the same.
    """
    weights = weights or fit_weights(labelled_sample(pages, html_col))
    passed = [c for c in pages.columns if c != text_col]
    source = pages.select(*[pages[c].alias(f"p{i}") for i, c in enumerate(passed)], pages[html_col].alias("__html"))
    schema = ", ".join([f"p{i} {pages.schema[c].dataType.simpleString()}" for i, c in enumerate(passed)] + ["__text string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py(), weights) for x in batch.columns[-1]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], found], [*batch.schema.names[:-1], "__text"])

    out = source.mapInArrow(run, schema)
    return out.select(*[out[f"p{i}"].alias(c) for i, c in enumerate(passed)], out["__text"].alias(text_col))
