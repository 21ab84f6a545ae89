"""HTML extraction: flat text blocks, classified by a decision tree over them and their neighbours.

A page is cut into blocks at block-level tags; inline tags leave no mark, and a line break counts
as white space. A block knows its words, the share of them inside links, the same of the blocks
before and after it, whether it is a heading, and whether it stands in an article. An element may
be marked as no main text, by its kind (menu, header, footer, sidebar, form) or by the words of a
class, id or role. Such a mark decides nothing by itself: a block knows how far the nearest marked
element is, and how much of the page that holds and leaves. Scripts, styles, comments and the head
hold no blocks. A CART tree, trained on the blocks of the labelled pages in ``html_labels``, tells
main text from the rest. Character references are decoded, white space inside a block becomes one space, and the main
blocks are joined in page order by a blank line.

Null and empty pages, and pages without a main block, give an empty text. Tags that are never
closed end with the element around them, a head at the first tag or text that cannot stand in it;
an unclosed script or style reaches to the end of the page. Tags cut off there are dropped. Every
row gives one, whether ids and urls are null or repeat; other columns than these are left out.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm.html_labels import MAIN, PAGES

# Elements whose tags part blocks, that hold no text, and that have no end tag.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
SILENT_TAGS = ("script", "style", "noscript", "template", "textarea", "head", "svg", "iframe",
               "select", "button", "object", "canvas", "math", "audio", "video")
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HEAD_TAGS = frozenset("title meta link base style script noscript template".split())
ASIDE_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
ASIDE_WORDS = re.compile(
    r"\b(?:ads?|advert\w*|banner\w*|breadcrumb\w*|comment\w*|consent|cookie\w*|disqus\w*|foot(?:er)?|"
    r"head(?:er)?bar|masthead|menu\w*|modal|nav\w*|newsletter\w*|notice\w*|pagination|pager|popup|"
    r"promo\w*|related\w*|repl(?:y|ies)|respond|share\w*|sharing|side(?:bar)?|social\w*|sponsor\w*|"
    r"subscribe\w*|toolbar|widget\w*|alert\w*|login|signup|complementary|navigation|contentinfo)\b")
#: Names that tell how a page is laid out, and not what an element holds.
LAYOUT_WORDS = re.compile(r"(?:no|not|non|with|without|has|hide)-.*|.*-(?:open|opened|closed|collapsed|"
                          r"hidden|enabled|disabled)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY = {"p": BLOCK_TAGS - {"html", "body"}, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]),
             "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]),
             "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
             "option": frozenset(["option"])}

#: What may end by the start of another element.
_ENDERS = frozenset().union(*CLOSED_BY.values())

_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
_SILENT = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style)\b(?:" + _ATTRIBUTES
    + r">.*?</\1\s*>|" + _ATTRIBUTES + r"(?<=/)>|.*\Z)", re.S | re.I)
_SAME = {name: re.compile(rf"<(/?){name}(?![a-zA-Z0-9:-])[^<>]*>", re.I) for name in SILENT_TAGS}
# Outside of quotes a tag holds no other tag's start, so each try ends before the next one.
_NAME = r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)"
_TAG = re.compile(_NAME + r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|" + _NAME + r"([^<>]*)>|"
                  r"<[!?/][^<>]*>|<[!?/a-zA-Z][^<>]*\Z")
_MARKS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after",
            "heading", "article", "mark", "mark_tag", "mark_main", "mark_share", "mark_rest")


@dataclass
class Mark:
    """An element that a name, or its kind, marks as no main text: the blocks ``start`` to ``end``
    stand in it."""

    depth: int
    tag: bool
    start: int
    end: int = -1


@dataclass
class Open:
    """An open element, with what holds for blocks in it."""

    name: str
    main: int = 0  # depth of the innermost article or main element, from 1
    mark: Mark | None = None
    link: bool = False
    silent: bool = False


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    heading: bool = False
    main: int = 0
    mark: Mark | None = None
    distance: int = 0
    place: int = 0
    text: str = ""

    def close(self) -> str:
        whole = "".join(self.parts)
        self.text = " ".join((html.unescape(whole) if "&" in whole else whole).split())
        return self.text


def _marked(attributes: str) -> bool:
    marks = " ".join("".join(m) for m in _MARKS.findall(attributes)).lower().replace("_", "-")
    return any(ASIDE_WORDS.search(m) and not LAYOUT_WORDS.fullmatch(m) for m in marks.split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page that hold text, in page order. The time is in proportion to the page."""
    page = _SILENT.sub(" ", page)
    found, stack, names = [Block()], [], Counter()
    outside = Open("")

    def top() -> Open:
        return stack[-1] if stack else outside

    def turn() -> None:
        t = top()
        found.append(Block(heading=any(s.name in HEADINGS for s in stack[-2:]), main=t.main, mark=t.mark,
                           distance=len(stack) - t.mark.depth if t.mark else 0))

    def pop() -> str:
        e = stack.pop()
        names[e.name] -= 1
        if e.mark and e.mark.depth == len(stack) + 1:
            e.mark.end = len(found)
        return e.name

    def put(text: str) -> None:
        if stack and stack[-1].name == "head" and text.strip():
            pop()
            turn()
        if text and not top().silent:
            found[-1].parts.append(text)
            if top().link:
                found[-1].linked.append(text)

    at = 0
    while tag := _TAG.search(page, at):
        put(page[at: tag.start()])
        at = tag.end()
        ends, name, attributes = tag[1] or tag[4], (tag[2] or tag[5] or "").lower(), tag[3] or tag[6] or ""
        if not name:
            continue
        if not ends and names["head"] and (
                name == "body" or stack[-1].name == "head" and name not in HEAD_TAGS):
            while pop() != "head":
                pass
            turn()
        if name == "br":
            put(" ")
        if name in VOID_TAGS:
            if name == "hr" and not top().silent:
                turn()
            continue
        silent = top().silent
        if ends:
            if names[name]:
                while pop() != name:
                    pass
                silent = top().silent
        else:
            closed = attributes.endswith("/")
            if name in _SAME and name != "head" and not closed:
                end = _SAME[name].search(page, at)
                if end and end[1]:  # nothing inside is text, whatever its tags
                    at = end.end()
                    put(" ")
                    continue
            if name in _ENDERS:
                for i in range(len(stack) - 1, -1, -1):  # end tags that may be left out
                    if name in CLOSED_BY.get(stack[i].name, ()):
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i].name in BLOCK_TAGS:
                        break
            t = top()
            silent = t.silent
            if not closed:
                depth = len(stack) + 1
                kind = name in ASIDE_TAGS or (name == "header" and not t.main)
                start = len(found) if name in BLOCK_TAGS else len(found) - 1
                own = (Mark(depth, kind and name != "form", start)
                       if kind or name not in ("html", "body") and _marked(attributes) else None)
                stack.append(Open(name, depth if name in ("article", "main") else t.main,
                                  own or t.mark, t.link or name == "a", silent or name in _SAME))
                names[name] += 1
        if name in BLOCK_TAGS and not silent:
            turn()
    put(page[at:])
    while stack:
        pop()
    for i, b in enumerate(found):
        b.place = i
    return [b for b in found if b.parts and b.close()]


def features(found: list[Block], texts: list[str]) -> np.ndarray:
    """One row of FEATURES per block; words are counted up to 50, as more tell nothing.

    ``mark`` tells how near the nearest marked element is (1 for the block's own, 0 for none),
    ``mark_tag`` whether its kind marks it, ``mark_main`` whether an article or main element is it
    or lies between, ``mark_share`` the share of the page's words without links that it holds, and
    ``mark_rest`` how many such words stand outside of it.
    """
    words = np.array([len(t.split()) for t in texts], dtype=float)
    linked = np.array([len("".join(b.linked).split()) for b in found], dtype=float)
    density = np.minimum(1.0, linked / np.maximum(words, 1))
    free = np.zeros(1 + max([b.place for b in found] + [b.mark.end for b in found if b.mark], default=0))
    free[[b.place for b in found]] = np.maximum(words - linked, 0)
    reach = np.concatenate([[0.0], np.cumsum(free)])
    total = reach[-1]
    marks = np.zeros((len(found), 5))
    for i, b in enumerate(found):
        if b.mark:
            inside = reach[b.mark.end] - reach[b.mark.start]
            marks[i] = (1 / (1 + b.distance), b.mark.tag, b.main >= b.mark.depth,
                        inside / max(total, 1.0), min(total - inside, 50))
    words = np.minimum(words, 50)
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    return np.column_stack([
        words, density, before(words), before(density), after(words), after(density),
        np.array([b.heading for b in found], dtype=float), np.array([b.main > 0 for b in found], dtype=float),
        marks])


@dataclass
class Tree:
    """A binary decision: rows with ``feature <= cut`` go left; a leaf has a ``share`` of main text."""

    share: float
    feature: int = -1
    cut: float = 0.0
    left: Tree | None = None
    right: Tree | None = None

    def main(self, rows: np.ndarray) -> np.ndarray:
        if self.left is None or self.right is None:
            return np.full(rows.shape[0], self.share >= 0.5)
        out = np.empty(rows.shape[0], dtype=bool)
        low = rows[:, self.feature] <= self.cut
        out[low], out[~low] = self.left.main(rows[low]), self.right.main(rows[~low])
        return out


def grow(rows: np.ndarray, main: np.ndarray, depth: int = 9) -> Tree:
    """CART: the split that leaves the least Gini impurity, while it lessens it."""
    tree = Tree(float(main.mean()) if main.size else 0.0)
    gini = lambda y: 2 * y.size * y.mean() * (1 - y.mean()) if y.size else 0.0
    best = gini(main) - 1e-9
    if depth and best > 0:
        for k in range(rows.shape[1]):
            values = np.unique(rows[:, k])
            for cut in (values[1:] + values[:-1]) / 2:
                low = rows[:, k] <= cut
                left = gini(main[low]) + gini(main[~low])
                if left < best - 1e-9:
                    best, tree.feature, tree.cut = left, k, float(cut)
    if tree.feature >= 0:
        low = rows[:, tree.feature] <= tree.cut
        tree.left = grow(rows[low], main[low], depth - 1)
        tree.right = grow(rows[~low], main[~low], depth - 1)
    return tree


def trained() -> Tree:
    """The tree of the labelled pages."""
    rows, main = [], []
    for page in PAGES:
        found = blocks(page)
        texts = [b.text for b in found]
        main += [MAIN in t for t in texts]
        rows.append(features(found, [t.replace(MAIN, "") for t in texts]))
    return grow(np.concatenate(rows), np.array(main, dtype=bool))


def main_text(page: str | None, tree: Tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    texts = [b.text for b in found]
    return "\n\n".join(t for t, keep in zip(texts, tree.main(features(found, texts)), strict=True)
                       if keep)


def _extracted(tree: Tree, column: str) -> Callable:
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            texts = pa.array([main_text(p, tree) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [texts if i == at else c for i, c in enumerate(batch.columns)],
                names=batch.schema.names)

    return run


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    plain = pages.select("page_id", "url", F.col("html").cast("string").alias("text"))
    return plain.mapInArrow(_extracted(trained(), "text"), plain.schema).withColumn(
        "n_chars", F.length("text").cast("long"))
