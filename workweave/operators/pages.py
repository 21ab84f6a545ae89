"""Record tables from captured pages.

Input is a page table ``(page_id, url, html)``. Every preset gives records
``(page_id, url, kind, preset, pos, fields)`` with ``fields`` as a map of text. Work is regular
expressions inside Catalyst, but for elements that nest or lack end tags (paragraphs, list items,
tables), whose ends a fold over the tags finds. Any number of presets reads the pages once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.functions import markup as M
from workweave.functions import text as X

# Shares of a reduced page that is cut in the middle
HEAD_SHARE, TAIL_SHARE = 0.75, 0.25
KEPT_ATTRIBUTES = ["class", "id", "href", "src", "type", "name", "itemprop", "role"]
KEPT_CLASSES = 4


# -- presets as expressions ------------------------------------------------------------
# Each gives an array of structs (pos, fields) for one page. ``PREPARED`` names the columns
# they read; a projection computes those once per page, whatever the number of presets.
PREPARED = {
    "clean": lambda: X.without(F.col("html"), X.UNSEEN),
    "seen": lambda: X.inner_text(F.col("clean")),
    "head": lambda: X.without(F.col("html"), ["script", "style"]),
    "uncommented": lambda: F.regexp_replace("html", "(?s)<!--.*?-->", " "),
    "table_parts": lambda: M.tables(F.col("clean")),
}
# Elements whose markup presets read; one pass over the tags of a page finds all that are wanted
ELEMENTS = {"paragraph_parts": "p", "list_parts": "li"}


def _parts(markup: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(markup, F.lit(pattern), F.lit(group))


def _numbered(items: Column, make: Callable[[Column], dict[str, Column]]) -> Column:
    """Structs of ``make`` with their position in the list."""
    return F.transform(items, lambda e, i: F.struct(
        i.cast("long").alias("pos"), *[v.alias(n) for n, v in make(e).items()]))


def _fields(items: Column, names: dict[str, str]) -> Column:
    """Struct fields as a map: ``names`` maps field names to struct fields."""
    return F.transform(items, lambda e: F.struct(e["pos"].alias("pos"), F.create_map(*[
        x for name, at in names.items() for x in (F.lit(name), e[at])]).alias("fields")))


def _texts(bodies: Column) -> Column:
    """Non-empty inner texts of elements, as field ``text``."""
    found = _numbered(bodies, lambda e: {"text": X.inner_text(e)})
    return _fields(F.filter(found, lambda e: e.text != ""), {"text": "text"})


def _text_items() -> Column:
    t = F.col("seen")
    one = F.struct(F.lit(0).cast("long").alias("pos"), F.create_map(
        F.lit("text"), t, F.lit("laenge"), F.length(t).cast("string")).alias("fields"))
    return F.filter(F.array(one), lambda e: F.length(t) > 0)


def _heading_items() -> Column:
    """By level, then position; one pass finds all levels."""
    pattern = r"(?is)<(h[1-6])(?:\s[^>]*)?>(.*?)</\1\s*>"
    found = F.transform(_parts(F.col("clean"), pattern, 0), lambda e, i: F.struct(
        F.lower(F.regexp_extract(e, pattern, 1)).alias("level"), i.alias("i"),
        F.regexp_extract(e, pattern, 2).alias("body")))
    listed = _numbered(F.array_sort(found), lambda e: {
        "level": e.level, "text": X.inner_text(e.body)})
    return _fields(F.filter(listed, lambda e: e.text != ""), {"ebene": "level", "text": "text"})


def _anchor_items() -> Column:
    """Structs (pos, text, href) of all anchors with a target."""
    pattern = X.element_pattern("a")
    found = F.transform(_parts(F.col("clean"), pattern, 0), lambda e, i: F.struct(
        i.cast("long").alias("pos"), F.regexp_extract(e, pattern, 1).alias("attrs"),
        F.regexp_extract(e, pattern, 2).alias("body")))
    linked = F.filter(found, lambda e: X.has_attribute(e.attrs, "href"))
    return F.transform(linked, lambda e: F.struct(
        e.pos.alias("pos"), X.inner_text(e.body).alias("text"),
        X.attribute(e.attrs, "href").alias("href")))


def _link_items() -> Column:
    resolved = F.transform(_anchor_items(), lambda e: F.struct(
        e.pos.alias("pos"), e.text.alias("text"),
        X.resolve_url(F.col("url"), e.href).alias("target")))
    return _fields(resolved, {"text": "text", "url": "target"})


def _image_items() -> Column:
    tags = _numbered(_parts(F.col("clean"), r"(?is)<img(\s[^>]*)>"), lambda a: {
        "attrs": a, "src": F.coalesce(F.nullif(X.attribute(a, "src"), F.lit("")),
                                      X.attribute(a, "data-src"))})
    shown = F.transform(F.filter(tags, lambda e: e.src != ""), lambda e: F.struct(
        e.pos.alias("pos"), X.resolve_url(F.col("url"), e.src).alias("target"),
        X.squeeze(X.attribute(e.attrs, "alt")).alias("alt"),
        X.squeeze(X.attribute(e.attrs, "title")).alias("title")))
    return _fields(shown, {"url": "target", "alt": "alt", "titel": "title"})


def _table_items() -> Column:
    """Rows keyed by header or ``spalte_n``; header rows come out as rows too."""
    def texts(parts: Column) -> Column:
        return F.transform(parts, X.inner_text)

    def rows(table: Column, t: Column) -> Column:
        return F.transform(table.rows, lambda row, n: F.struct(
            (t.cast("long") * 1_000_000 + n).alias("pos"), t.alias("t"),
            texts(table.heads).alias("heads"), texts(row).alias("cells")))

    def fields(e: Column) -> Column:
        head = lambda i: F.coalesce(F.get(e.heads, i), F.lit(""))
        named = F.transform(e.cells, lambda c, i: F.struct(
            F.when(head(i) != "", head(i)).otherwise(
                F.concat(F.lit("spalte_"), (i + 1).cast("string"))).alias("k"), c.alias("v")))
        # a repeated heading keeps the last cell, as assignment by name does
        latest = F.filter(named, lambda x, i: ~F.exists(
            F.slice(named, i + 2, F.size(named)), lambda o: o.k == x.k))
        number = F.create_map(F.lit("tabelle"), (e.t + 1).cast("string"))
        return F.map_concat(number, F.map_from_entries(latest))

    found = F.flatten(F.transform("table_parts", rows))
    filled = F.filter(found, lambda e: F.exists(e.cells, lambda c: c != ""))
    return F.transform(filled, lambda e: F.struct(e.pos.alias("pos"), fields(e).alias("fields")))


def _match_items(text: Column, pattern: str, min_digits: int = 0) -> Column:
    """Distinct matches of a pattern, in order of first appearance."""
    found = _numbered(F.array_distinct(_parts(text, pattern, 0)), lambda m: {
        "text": X.strip_space(m)})
    if min_digits:
        found = F.filter(found, lambda e: F.length(
            F.regexp_replace(e.text, r"\P{Nd}", "")) >= min_digits)
    return _fields(found, {"wert": "text"})


def _meta_items() -> Column:
    """The title, then meta tags with a name (or property) and a content."""
    html = F.col("head")
    title = X.squeeze(X.decode(F.regexp_extract(html, X.element_pattern("title"), 2)))
    first = F.filter(F.array(F.struct(F.lit("title").alias("k"), title.alias("v"))),
                     lambda _: F.regexp_like(html, F.lit(r"(?is)<title(?:\s[^>]*)?>")))
    tags = F.transform(_parts(html, r"(?is)<meta(\s[^>]*)>"), lambda a: F.struct(
        F.coalesce(F.nullif(X.attribute(a, "name"), F.lit("")), X.attribute(a, "property"))
        .alias("k"), X.squeeze(X.attribute(a, "content")).alias("v")))
    named = F.filter(tags, lambda e: (e.k != "") & (e.v != ""))
    rows = _numbered(F.concat(first, named), lambda e: {"k": e.k, "v": e.v})
    return _fields(rows, {"feld": "k", "wert": "v"})


def _json_ld_items() -> Column:
    """Objects of JSON-LD scripts, scalar fields only; unreadable scripts are passed over."""
    pattern = X.element_pattern("script")
    scripts = F.filter(_parts(F.col("uncommented"), pattern, 0), lambda e: X.attribute(
        F.regexp_extract(e, pattern, 1), "type") == "application/ld+json")
    parsed = _numbered(scripts, lambda e: {
        "v": F.try_parse_json(F.regexp_extract(e, pattern, 2))})

    def objects(s: Column) -> Column:
        kind = F.coalesce(F.schema_of_variant(s.v), F.lit(""))
        items = F.when(kind.startswith("ARRAY"), F.try_variant_get(s.v, "$", "array<variant>")
                       ).when(kind.startswith("OBJECT"), F.array(s.v)
                              ).otherwise(F.array().cast("array<variant>"))
        return F.transform(items, lambda v, i: F.struct(
            (s.pos * 1_000_000 + i).alias("pos"), v.alias("item")))

    def scalars(item: Column) -> Column:
        whole = F.try_variant_get(item, "$", "map<string,variant>")
        plain = F.map_filter(whole, lambda _, v: F.schema_of_variant(v).rlike(
            "^(STRING|BIGINT|DOUBLE|DECIMAL|BOOLEAN)"))
        return F.transform_values(plain, lambda _, v: F.try_variant_get(v, "$", "string"))

    found = F.filter(F.flatten(F.transform(parsed, objects)),
                     lambda e: F.schema_of_variant(e["item"]).startswith("OBJECT"))
    return F.transform(found, lambda e: F.struct(
        e["pos"].alias("pos"), scalars(e["item"]).alias("fields")))


# preset: (kind of record, columns it reads, items)
PRESETS: dict[str, tuple[str, list[str], Callable[[], Column]]] = {
    "text": ("text", ["clean", "seen"], _text_items),
    "headings": ("ueberschrift", ["clean"], _heading_items),
    "links": ("link", ["clean"], _link_items),
    "images": ("bild", ["clean"], _image_items),
    "tables": ("tabellenzeile", ["clean", "table_parts"], _table_items),
    "lists": ("listeneintrag", ["clean", "list_parts"], lambda: _texts(F.col("list_parts"))),
    "emails": ("email", ["clean", "seen"], lambda: _match_items(F.col("seen"), X.EMAIL_RUNS)),
    "phones": ("telefon", ["clean", "seen"], lambda: _match_items(F.col("seen"), X.PHONE, 7)),
    "prices": ("preis", ["clean", "seen"], lambda: _match_items(F.col("seen"), X.PRICE)),
    "meta": ("meta", ["head"], _meta_items),
    "jsonld": ("jsonld", ["uncommented"], _json_ld_items),
    "paragraphs": ("absatz", ["clean", "paragraph_parts"],
                   lambda: _texts(F.col("paragraph_parts"))),
}


def _prepared(pages: DataFrame, needed: list[str]) -> DataFrame:
    """The columns presets read, each computed once; ``html`` itself is left behind."""
    ready = pages
    for name, build in PREPARED.items():
        if name in needed:
            ready = ready.withColumn(name, build())
    parts = [name for name in ELEMENTS if name in needed]
    if parts:
        ready = ready.withColumn("parts", M.bodies(
            F.col("clean"), *[ELEMENTS[name] for name in parts])).withColumns(
            {name: F.get("parts", F.lit(i)) for i, name in enumerate(parts)}).drop("parts")
    return ready.drop("html")


def extract(pages: DataFrame, presets: list[str], min_length: int = 0) -> DataFrame:
    """Records of several presets in one pass; ``preset`` keeps their order within a page."""
    def tagged(n: int, name: str) -> Column:
        kind, _reads, items = PRESETS[name]
        return F.transform(items(), lambda e: F.struct(
            F.lit(kind).alias("kind"), F.lit(n).alias("preset"), e["pos"].alias("pos"),
            e["fields"].alias("fields")))

    needed = [c for name in presets for c in PRESETS[name][1]]
    lists = [tagged(n, name) for n, name in enumerate(presets)]
    found = _prepared(pages, needed).select(
        "page_id", "url", F.explode(F.concat(*lists)).alias("r")
    ).select("page_id", "url", "r.kind", "r.preset", "r.pos", "r.fields")
    return long_enough(found, min_length) if min_length else found


def matches(texts: DataFrame, kind: str, text: Column, pattern: str, min_digits: int = 0
            ) -> DataFrame:
    """Distinct matches of any pattern in a text column, as records."""
    return texts.select("page_id", "url", F.explode(_match_items(text, pattern, min_digits))
                        .alias("r")).select(
        "page_id", "url", F.lit(kind).alias("kind"), F.lit(0).alias("preset"), "r.pos", "r.fields")


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, text, href) of all anchors with a target."""
    return _prepared(pages, ["clean"]).select(
        "page_id", "url", F.explode(_anchor_items()).alias("r")).select("page_id", "url", "r.*")


def long_enough(records: DataFrame, n: int) -> DataFrame:
    """Minimum length of ``text``, or of ``wert`` where there is no text."""
    text = F.coalesce(F.nullif(F.element_at("fields", F.lit("text")), F.lit("")),
                      F.element_at("fields", F.lit("wert")), F.lit(""))
    return records.filter(F.length(text) >= n)


# -- whole pages -----------------------------------------------------------------------
def readable(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    return pages.select("page_id", "url",
                        X.readable_text(F.col("html"), max_chars).alias("text"))


def reduced_html(html: Column, max_chars: int | None = None, keep_links: bool = True,
                 value_chars: int | None = None) -> Column:
    """The frame of a page: junk and most attributes dropped. On request the middle of a page
    longer than ``max_chars`` and the rest of values longer than ``value_chars`` go, too."""
    whole = F.regexp_replace(html, X.block_pattern(X.JUNK), "")
    body = F.regexp_extract(whole, r"(?is)<body(?:\s[^>]*)?>.*", 0)
    text = F.when(body != "", F.regexp_replace(body, r"(?is)(</body\s*>).*", "$1")).otherwise(whole)
    kept = "|".join(KEPT_ATTRIBUTES if keep_links else
                    [a for a in KEPT_ATTRIBUTES if a != "href"])
    value = r"""(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?"""
    keep = rf"(?:{kept})(?=[\s=/>])"
    # from each tag name (or the place of the last removal) over kept attributes to one
    # that goes; the scan stays inside start tags
    text = F.regexp_replace(
        text, rf"(?is)((?:<[a-z][a-z0-9]*|(?!\A)\G)(?:\s+{keep}{value})*)"
              rf"\s+(?!{keep})[a-z_:@][a-z0-9_:.@-]*{value}", "$1")
    text = F.regexp_replace(
        text, rf"""(?is)(\sclass\s*=\s*["'])((?:[^\s"']+\s+){{{KEPT_CLASSES - 1}}}[^\s"']+)"""
              r"""\s[^"'<>]*(["'])""", "$1$2$3")
    if value_chars is not None:
        text = F.regexp_replace(text, rf'(?s)="([^"<>]{{{value_chars}}})[^"<>]+"', '="$1..."')
    text = F.regexp_replace(text, r"\n\s*\n+", "\n")
    text = F.regexp_replace(text, r">\s+<", "><")
    if max_chars is None:
        return text
    head, tail = int(max_chars * HEAD_SHARE), int(max_chars * TAIL_SHARE)
    cut = F.concat(
        F.substring(text, 1, head), F.lit("\n<!-- ... "),
        (F.length(text) - max_chars).cast("string"), F.lit(" Zeichen gekürzt ... -->\n"),
        F.right(text, F.lit(tail)))
    return F.when(F.length(text) > max_chars, cut).otherwise(text)


def reduction_profile(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Per host: characters before and after, and the share saved."""
    sized = pages.select(X.host(F.col("url")).alias("host"), F.length("html").alias("before"),
                         F.length(reduced_html(F.col("html"), max_chars)).alias("after"))
    return sized.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("before").alias("before"),
        F.sum("after").alias("after")).withColumn(
        "saved", 1 - F.col("after") / F.col("before"))


def signatures(pages: DataFrame) -> DataFrame:
    """(page_id, url, pos, signature): ``tag.class1.class2`` of start tags with classes."""
    html = F.regexp_replace("html", X.block_pattern(X.JUNK), " ")
    pattern = r"(?is)<([a-z][a-z0-9]*)(\s[^>]*)>"
    tags = F.transform(_parts(html, pattern, 0), lambda e, i: F.struct(
        i.alias("pos"), F.lower(F.regexp_extract(e, pattern, 1)).alias("tag"),
        F.slice(F.split(X.squeeze(X.attribute(F.regexp_extract(e, pattern, 2), "class")), " "),
                1, KEPT_CLASSES).alias("classes")))
    marked = F.filter(tags, lambda e: F.get(e.classes, F.lit(0)) != "")
    return pages.select("page_id", "url", F.explode(marked).alias("r")).select(
        "page_id", "url", "r.pos", F.concat_ws(".", "r.tag", "r.classes").alias("signature"))


def repeated_signatures(found: DataFrame, keys: list[str]) -> DataFrame:
    """Signatures that occur more than once per key, with their first place."""
    return found.groupBy(*keys, "signature").agg(
        F.count("*").alias("n"), F.min(F.struct("page_id", "pos")).alias("first")
    ).filter("n > 1")


def page_results(pages: DataFrame, fetches: DataFrame, records: DataFrame) -> DataFrame:
    """One row per page: title, size, status, elapsed time and number of records."""
    counted = records.groupBy("page_id").agg(F.count("*").alias("rows"))
    described = pages.select("page_id", "url", X.page_title(F.col("html")).alias("title"),
                             F.octet_length("html").alias("bytes"))
    return (
        described.join(fetches.select("page_id", "status", "error",
                                      F.round("elapsed", 3).alias("elapsed")), "page_id")
        .join(counted, "page_id", "left")
        .withColumn("rows", F.coalesce("rows", F.lit(0)))
    )


def successful(fetches: DataFrame) -> DataFrame:
    return fetches.filter((F.col("error") == "") & F.col("status").between(200, 299))


def job_summary(fetches: DataFrame, records: DataFrame) -> DataFrame:
    """Per job: pages, successes, errors, records and duration.

    Records are counted per page before anything is shuffled.
    """
    ok = (F.col("error") == "") & F.col("status").between(200, 299)
    counted = records.groupBy("page_id").agg(F.count("*").alias("rows"))
    return fetches.join(counted, "page_id", "left").groupBy("job_id").agg(
        F.count("*").alias("pages"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("errors"),
        F.round(F.sum("elapsed"), 2).alias("duration"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))
