"""Text and markup helpers as column expressions.

Patterns avoid look-around wherever possible, so that they mean the same in other engines.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, as a pattern and as characters
SPACE = (r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
         r"\x{205f}\x{3000}]")
SPACE_CHARS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b)))
               + "\u2028\u2029\u202f\u205f\u3000")
_WORD = r"\p{L}\p{N}_"

# Contact data and prices
EMAIL = rf"[{_WORD}.+-]+@[{_WORD}-]+\.[{_WORD}.-]{{2,}}"
# The same matches in Java, each run of characters read once: a match begins where a run does or
# where the match before it ended
EMAIL_RUNS = rf"(?:\G|(?<![{_WORD}.+-]))[{_WORD}.+-]++@[{_WORD}-]++\.[{_WORD}.-]{{2,}}"
PHONE = (rf"(?:(?:\+|00)\p{{Nd}}{{1,3}}(?:{SPACE}|[./-])?)?"
         rf"(?:\(?\p{{Nd}}{{2,5}}\)?(?:{SPACE}|[./-])?){{2,4}}\p{{Nd}}{{2,}}")
PRICE = (rf"(?:(?:€|EUR|\$|USD|£|CHF){SPACE}?\p{{Nd}}[\p{{Nd}}.,]*)"
         rf"|(?:\p{{Nd}}[\p{{Nd}}.,]*{SPACE}?(?:€|EUR|\$|USD|£|CHF))")

# Elements without use for extraction, and page furniture
JUNK = ["script", "style", "noscript", "svg", "canvas", "iframe", "template", "link", "meta",
        "picture", "source", "track", "object", "embed"]
VOID = ["link", "meta", "source", "track", "embed"]
FURNITURE = ["nav", "header", "footer", "aside", "form"]
UNSEEN = ["script", "style", "noscript"]

# Named character references that end in a semicolon; a no-break space is read as a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"nbsp": " ", "apos": "'"}
_REFERENCE = "&(?=(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);)"

URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def squeeze(text: Column) -> Column:
    """Collapse white space and trim."""
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def decode(text: Column) -> Column:
    """Named, decimal and hexadecimal character references, each once and in one pass."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def resolved(part: Column) -> Column:
        name = F.substring_index(part, ";", 1)
        code = F.when(F.lower(F.substring(name, 1, 2)) == "#x",
                      F.conv(F.substr(name, F.lit(3)), 16, 10)).when(
            F.startswith(name, F.lit("#")), F.substr(name, F.lit(2))).cast("long")
        # a code point as UTF-32, read back as text
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        known = F.coalesce(F.when(valid, char), F.try_element_at(named, name))
        rest = F.substr(part, F.length(name) + 2)
        return F.when(known.isNull(), F.concat(F.lit("&"), part)).otherwise(F.concat(known, rest))

    def joined(parts: Column) -> Column:
        # what stands before the first reference, then the references with what follows them
        return F.array_join(F.transform(
            parts, lambda p, i: F.when(i == 0, p).otherwise(resolved(p))), "")

    return let(text, lambda t: F.when(
        F.contains(t, F.lit("&")), joined(F.split(t, _REFERENCE))).otherwise(t))


def block_pattern(tags: list[str]) -> str:
    """Comments and whole elements of the given tags, in one pass from left to right."""
    parts = ["<!--.*?-->"]
    for tag in tags:
        if tag in VOID:
            parts.append(rf"<{tag}(?:\s[^>]*)?>")
        else:
            parts.append(rf"<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>")
    return "(?is)" + "|".join(parts)


def _one_start(pattern: str) -> str:
    """Alternatives that all begin with ``<``, as one: other characters are passed over at once."""
    flags, parts = pattern[:5], pattern[5:].split("|<")
    return f"{flags}<(?:{'|'.join([parts[0][1:], *parts[1:]])})"


def without(html: Column, tags: list[str]) -> Column:
    return F.regexp_replace(html, _one_start(block_pattern(tags)), " ")


def inner_text(markup: Column) -> Column:
    """Text of a markup fragment: tags become spaces, entities characters."""
    return squeeze(decode(F.regexp_replace(markup, "<[^>]*>", " ")))


def visible_text(html: Column) -> Column:
    return inner_text(without(html, UNSEEN))


def readable_text(html: Column, max_chars: int | None = None) -> Column:
    """Text nodes on lines of their own, without junk and page furniture."""
    marked = F.regexp_replace(without(html, JUNK + FURNITURE), "<[^>]*>", "\u0001")
    nodes = F.transform(F.split(decode(marked), "\u0001"), strip_space)
    text = F.array_join(F.filter(nodes, lambda x: x != ""), "\n")
    return text if max_chars is None else F.substring(text, 1, max_chars)


def attribute(attrs: Column, name: str) -> Column:
    """Value of an attribute within a start tag; empty when missing."""
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    bare = let(F.regexp_extract(attrs, pattern, 1), lambda v: F.when(
        v.startswith('"') | v.startswith("'"), F.substr(v, F.lit(2), F.length(v) - 2)).otherwise(v))
    return decode(bare)


def has_attribute(attrs: Column, name: str) -> Column:
    return attrs.rlike(rf"(?is)(?:^|\s){name}\s*=")


def element_pattern(tag: str) -> str:
    """Group 1: attributes, group 2: content."""
    return rf"(?is)<{tag}((?:\s[^>]*)?)>(.*?)</{tag}\s*>"


def page_title(html: Column) -> Column:
    return strip_space(decode(F.regexp_extract(html, element_pattern("title"), 2)))


# -- URLs ------------------------------------------------------------------------------
def host(url: Column) -> Column:
    return F.regexp_extract(url, URL_PARTS, 2)


def normalise_url(url: Column) -> Column:
    """Trim, add a scheme, cut fragment and trailing slashes."""
    raw = strip_space(F.coalesce(url, F.lit("")))
    full = F.when(raw.rlike(SCHEME), raw).otherwise(F.concat(F.lit("https://"), raw))
    cut = F.regexp_replace(F.regexp_extract(full, r"(?s)^[^#]*", 0), "/+$", "")
    return F.when(raw == "", "").when(cut == "", full).otherwise(cut)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(x))))
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(path.contains("/."), F.array_join(closed, "/")).otherwise(path)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on page ``base``."""
    return let(base, lambda b: let(href, lambda h: _resolved(b, h)))


def _resolved(base: Column, href: Column) -> Column:
    scheme = F.regexp_extract(base, URL_PARTS, 1)
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, URL_PARTS, 2))
    path = F.regexp_extract(base, URL_PARTS, 3)
    unfragmented = F.regexp_extract(base, r"(?s)^[^#]*", 0)
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"^.*/", 0)
    own_path = F.regexp_extract(href, r"(?s)^[^?#]*", 0)
    rest = F.substr(href, F.length(own_path) + 1)
    return (
        F.when(href.rlike(SCHEME), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, _without_dots(own_path), rest))
        .when(href.startswith("?"), F.concat(root, path, href))
        .when(href.startswith("#"), F.concat(unfragmented, href))
        .when(href == "", base)
        .otherwise(F.concat(root, _without_dots(F.concat(folder, own_path)), rest))
    )
