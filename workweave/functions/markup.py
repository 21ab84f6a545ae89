"""Elements of a page: where each begins and ends.

Where an element ends depends on all tags before it, so this is a fold over the tags of a page that
carries a stack of open elements. It runs inside the row, in Arrow batches; text, references and
addresses of what it cuts out are left to column expressions. Markup comes without comments and
scripts. End tags may be missing: an element ends with the one around it, and list items, cells,
rows and paragraphs also where a sibling begins. An end tag without a start is passed over.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9-]*)([^<>]*)>")

# Elements without content
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param",
         "source", "track", "wbr"}
# Elements before which a paragraph ends
BLOCKS = {"address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre",
          "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
# What the start of an element ends, and what this does not reach beyond
_SECTIONS = {"thead", "tbody", "tfoot"}
_CELLS = {"td", "th"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": (_CELLS, {"tr", "table"}), "th": (_CELLS, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    **{name: (_SECTIONS | {"tr"}, {"table"}) for name in _SECTIONS},
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
_PARAGRAPH = {"p"}
_BESIDE_PARAGRAPHS = {"td", "th", "caption", "table", "button", "object"}
# An end tag does not reach beyond an open element of a higher rank
RANK = {"div": 1, "article": 1, "section": 1, "main": 1, "td": 2, "th": 2, "tr": 3, "thead": 4,
        "tbody": 4, "tfoot": 4, "table": 5, "body": 6, "html": 7}

# Flat selectors: ``tag``, ``.class``, ``tag.class.class``, each optionally with ``@attribute``
SELECTOR = (r"^\s*(?:[A-Za-z][A-Za-z0-9-]*)?(?:\.[^\s.@,>+~#()\[\]*\\]+)*\s*(?:@\s*[\w:-]+\s*)?$")
PSEUDO = (r":(?:first|last|nth|only|not|is|has|where|hover|focus|active|visited|link|empty|root|"
          r"checked|disabled|enabled|before|after|contains)\b")


class Element:
    """A start tag from ``at`` to ``inner``, and content from there to ``stop``."""

    __slots__ = ("tag", "at", "inner", "stop", "attributes")

    def __init__(self, tag: str, at: int, inner: int, stop: int, attributes: str):
        self.tag, self.at, self.inner, self.stop, self.attributes = tag, at, inner, stop, attributes

    def classes(self) -> list[str]:
        return attribute(self.attributes, "class").split() if "class" in self.attributes.lower() else []


@lru_cache(maxsize=512)
def _attribute_pattern(name: str) -> re.Pattern:
    return re.compile(
        rf"""(?is)(?:^|\s){re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def attribute(attributes: str, name: str) -> str:
    found = _attribute_pattern(name).search(attributes)
    return next((g for g in found.groups() if g is not None), "") if found else ""


def elements(html: str) -> list[Element]:
    """All elements in the order of their start tags."""
    found: list[Element] = []
    stack: list[Element] = []
    names: dict[str, int] = {}
    size, opened = len(html), names.get

    def close(depth: int, at: int) -> None:
        while len(stack) > depth:
            e = stack.pop()
            e.stop = at
            names[e.tag] -= 1

    def end_siblings(ends: set[str], border: set[str], at: int) -> None:
        """Close the outermost element of ``ends`` that lies within the nearest border."""
        depth = len(stack)
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in border:
                break
            if stack[i].tag in ends:
                depth = i
        close(depth, at)

    for m in _TAG.finditer(html):
        end, name, attributes = m.groups()
        tag, at = name.lower(), m.start()
        if end:
            if opened(tag):
                depth, rank = len(stack) - 1, RANK.get(tag, 0)
                while stack[depth].tag != tag and RANK.get(stack[depth].tag, 0) <= rank:
                    depth -= 1
                if stack[depth].tag == tag:
                    close(depth, at)
            continue
        if tag in BLOCKS and opened("p"):
            end_siblings(_PARAGRAPH, _BESIDE_PARAGRAPHS, at)
        if tag in SIBLINGS:
            ends, border = SIBLINGS[tag]
            if any(map(opened, ends)):
                end_siblings(ends, border, at)
        e = Element(tag, at, m.end(), size, attributes)
        found.append(e)
        if tag in EMPTY:
            e.stop = e.inner
        else:
            stack.append(e)
            names[tag] = opened(tag, 0) + 1
    return found


class Page:
    """The elements of a page, and those within another."""

    def __init__(self, html: str | None):
        self.html = html or ""
        self.all = elements(self.html)
        self._starts = [e.at for e in self.all]

    def within(self, e: Element) -> list[Element]:
        return self.all[bisect_left(self._starts, e.inner): bisect_left(self._starts, e.stop)]

    def body(self, e: Element) -> str:
        return self.html[e.inner: e.stop]


# -- columns -----------------------------------------------------------------------------
#: Pages whose results are held as Python objects at a time
HELD = 64


def _by_page(kind: pa.DataType, find: Callable, *columns: pa.Array) -> pa.Array:
    """``find`` of each row, as an array. Few rows at a time are Python objects, so that a batch
    takes little more memory than its Arrow data."""
    parts = []
    for at in range(0, len(columns[0]), HELD):
        rows = zip(*(c.slice(at, HELD).to_pylist() for c in columns), strict=True)
        parts.append(pa.array([find(*row) for row in rows], kind))
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def bodies(html: Column, *tags: str) -> Column:
    """Markup within every element of each name: an array for every name, in the order of the start
    tags. A page is read once for all names, and not at all if it has none of their start tags."""
    some = re.compile(rf"(?i)<(?:{'|'.join(tags)})(?![A-Za-z0-9-])")

    def find(text: str | None) -> list[list[str]]:
        if not text or not some.search(text):
            return [[] for _ in tags]
        page, found = Page(text), {tag: [] for tag in tags}
        for e in page.all:
            if e.tag in found:
                found[e.tag].append(page.body(e))
        return list(found.values())

    @F.arrow_udf("array<array<string>>")
    def run(html: pa.Array) -> pa.Array:
        return _by_page(pa.list_(pa.list_(pa.string())), find, html)

    return run(html)


def _tables(html: pa.Array) -> pa.Array:
    def find(text: str | None) -> list[dict]:
        page = Page(text)
        tables = []
        for t in page.all:
            if t.tag == "table":
                inside = page.within(t)
                tables.append({
                    "heads": [page.body(e) for e in inside if e.tag == "th"],
                    "rows": [[page.body(c) for c in page.within(e) if c.tag in _CELLS]
                             for e in inside if e.tag == "tr"]})
        return tables

    cells = pa.list_(pa.string())
    return _by_page(pa.list_(pa.struct([("heads", cells), ("rows", pa.list_(cells))])), find, html)


def tables(html: Column) -> Column:
    """Markup of heads and of the cells of each row, table by table; a table, row or cell within
    another is a part of that one and comes by itself too."""
    return F.arrow_udf("array<struct<heads: array<string>, rows: array<array<string>>>>")(
        _tables)(html)


@lru_cache(maxsize=4096)
def _parsed(selector: str) -> tuple[str, frozenset[str], str]:
    """Tag and classes (both may be empty), and the attribute wanted."""
    node, _, wanted = selector.partition("@")
    tag, *classes = node.strip().split(".")
    return tag.lower(), frozenset(c for c in classes if c), wanted.strip()


def _matches(e: Element, tag: str, classes: frozenset[str]) -> bool:
    return (not tag or e.tag == tag) and (not classes or classes.issubset(e.classes()))


def _picked(html: pa.Array, container: pa.Array, selectors: pa.Array) -> pa.Array:
    def find(text: str | None, box: str, wanted: list[str]) -> list[list[str]]:
        page = Page(text)
        tag, classes, _ = _parsed(box)
        boxes = ([e for e in page.all if _matches(e, tag, classes)] if box.strip() else
                 [Element("", 0, 0, len(page.html), "")])
        rows = []
        for e in boxes:
            inside = page.within(e)
            row = []
            for selector in wanted:
                tag, classes, name = _parsed(selector)
                hit = (next((x for x in inside if _matches(x, tag, classes)), None)
                       if tag or classes else e)
                row.append("" if hit is None else
                           attribute(hit.attributes, name) if name else page.body(hit))
            rows.append(row)
        return rows

    return _by_page(pa.list_(pa.list_(pa.string())), find, html, container, selectors)


def picked(html: Column, container: Column, selectors: Column) -> Column:
    """For each element that the container matches (the whole page, if that is empty) what each
    selector reads: the markup or attribute of the first element within that it matches, of the
    container itself without a tag and class, else nothing."""
    return F.arrow_udf("array<array<string>>")(_picked)(html, container, selectors)


def checked(selector: Column) -> Column:
    """The selector; one beyond the flat form raises an error instead of matching nothing."""
    good = selector.rlike(SELECTOR) & ~selector.rlike(PSEUDO)
    return F.when(good, selector).when(selector.isNotNull(), F.raise_error(F.concat(
        F.lit("not a flat selector: "), selector)))


def _structures(most_classes: int, junk: frozenset[str]):
    def find(text: str | None) -> list[dict]:
        page = Page(text)
        marked = [(i, e, f"{e.tag}." + ".".join(c[:most_classes]))
                  for i, e in enumerate(page.all)
                  if e.tag not in junk and (c := e.classes())]
        starts = [e.at for _, e, _ in marked]
        boxes: dict[str, dict] = {}
        for n, (i, e, signature) in enumerate(marked):
            box = boxes.setdefault(signature, {"pos": i, "n": 0, "inside": {}})
            box["n"] += 1
            seen: dict[str, int] = {}
            for k, _, inner in marked[n + 1: bisect_left(starts, e.stop, n + 1)]:
                seen.setdefault(inner, k - i)
            for inner, at in seen.items():
                part = box["inside"].setdefault(inner, [0, at])
                part[0] += 1
                part[1] = min(part[1], at)
        return [{"container": s, "pos": b["pos"], "n": b["n"], "inside": [
            {"signature": x, "n": n, "pos": at} for x, (n, at) in b["inside"].items()]}
            for s, b in boxes.items()]

    inner = pa.struct([("signature", pa.string()), ("n", pa.int64()), ("pos", pa.int64())])
    kind = pa.list_(pa.struct([("container", pa.string()), ("pos", pa.int64()), ("n", pa.int64()),
                               ("inside", pa.list_(inner))]))

    def run(html: pa.Array) -> pa.Array:
        return _by_page(kind, find, html)

    return run


def structures(html: Column, most_classes: int, junk: list[str]) -> Column:
    """Of a page every ``tag.class...`` with its first place and number, and what stands within:
    each signature with the number of such elements that hold it and its least distance."""
    inner = "array<struct<signature: string, n: long, pos: long>>"
    return F.arrow_udf(f"array<struct<container: string, pos: long, n: long, inside: {inner}>>")(
        _structures(most_classes, frozenset(junk)))(html)
