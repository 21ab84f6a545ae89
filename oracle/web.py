"""Oracle statements for captured pages: records, templates, quality, link graph."""

from __future__ import annotations

from oracle.ctes import statement as _
from workweave.functions import text as X


# -- SQL text builders ---------------------------------------------------------------
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, by: str = "' '") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {by}, 'g')"


# the references that the captured pages hold, the ampersand last
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&apos;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&euro;", "€"), ("&amp;", "&")]


def decode(x: str) -> str:
    for entity, char in ENTITIES:
        x = f"replace({x}, {q(entity)}, {q(char)})"
    return x


def squeeze(x: str) -> str:
    return f"trim({sub(x, X.SPACE + '+')}, ' ')"


def strip(x: str) -> str:
    return sub(x, f"^{X.SPACE}+|{X.SPACE}+$", "''")


def inner(x: str) -> str:
    return squeeze(decode(sub(x, "<[^>]*>")))


def clean(x: str = "html") -> str:
    return sub(x, X.block_pattern(X.UNSEEN))


def vis(x: str = "html") -> str:
    return inner(clean(x))


def every(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract_all({x}, {q(pattern)}, {group})"


def first(x: str, pattern: str, group: int) -> str:
    return f"regexp_extract({x}, {q(pattern)}, {group})"


def attr(x: str, name: str) -> str:
    pattern = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return decode(" || ".join(first(x, pattern, i) for i in (1, 2, 3)))


def each(source: str, lists: dict[str, str], keep: str = "page_id, url") -> str:
    """Rows (page_id, url, pos, names...) of parallel lists."""
    named = ", ".join(f"{sql} AS l_{n}" for n, sql in lists.items())
    one = next(iter(lists))
    items = ", ".join(f"l_{n}[pos + 1] AS {n}" for n in lists)
    return (f"SELECT {keep}, pos, {items} FROM (SELECT *, unnest(range(len(l_{one}))) AS pos "
            f"FROM (SELECT {keep}, {named} FROM {source}))")


def host(x: str) -> str:
    return first(x, X.URL_PARTS, 2)


def resolve(base: str, href: str) -> str:
    """Links of the fixtures: absolute, from the root, or below the page's folder."""
    root = f"{first(base, X.URL_PARTS, 1)} || '://' || {host(base)}"
    folder = f"regexp_extract({first(base, X.URL_PARTS, 3)}, '^.*/')"
    return (f"CASE WHEN regexp_matches({href}, {q(X.SCHEME)}) THEN {href} "
            f"WHEN starts_with({href}, '/') THEN {root} || {href} "
            f"ELSE {root} || {folder} || {href} END")


def norm(x: str) -> str:
    full = f"CASE WHEN regexp_matches({strip(x)}, {q(X.SCHEME)}) THEN {strip(x)} ELSE 'https://' || {strip(x)} END"
    return f"CASE WHEN {strip(x)} = '' THEN '' ELSE regexp_replace(regexp_extract({full}, '^[^#]*'), '/+$', '') END"


# -- tables ----------------------------------------------------------------------------
def _card(i: int) -> str:
    return (f"""'<article class="karte gross" data-x="' || k || '"><h2 class="name">Teil ' || (p_size + {i})
      || '</h2><span class="preis">' || price{i} || ' €</span><a class="mehr" href="details/' || k || '-{i}?v=1">mehr</a>'
      || '<img src="/img/' || k || '-{i}.png" alt="Bild  {i}"></article>'""")


PART = """SELECT *, p_partkey AS k, lower(replace(p_brand, '#', '')) || '.example.com' AS host, """ + ", ".join(
    f"replace(CAST(CAST(CAST(p_retailprice AS DECIMAL(12,2)) * {i} AS DECIMAL(14,2)) AS VARCHAR), '.', ',') AS price{i}"
    for i in (1, 2, 3)) + " FROM part"
SHOP = f"""SELECT k + 1000000000 AS page_id, 'https://' || host || '/katalog/' || k AS url,
    '<!DOCTYPE html><html><head><title>' || p_name || '</title><meta name="description" content="' || p_type
    || '"><meta property="og:title" content="' || p_name || '"><meta name="leer" content=""><style>p{{margin:0}}</style>'
    || '<script>var x="<h2>no</h2>";</script><script type="application/ld+json">{{"@type":"Product","name":"' || p_name
    || '","size":' || p_size || ',"sale":true,"offer":{{"price":1}}}}</script></head><body data-page="' || k
    || '"><h1 id="top">' || p_name || '</h1>' || {_card(1)}
    || CASE WHEN p_brand LIKE '%1' THEN repeat('<div class="sep"><span class="x"> </span></div>', 5) ELSE '' END
    || {_card(2)} || {_card(3)}
    || '<table><tr><th>Merkmal</th><th></th></tr><tr><td>Marke</td><td>' || p_brand
    || '</td></tr><tr><td></td><td> </td></tr></table><p class="kontakt">Mail verkauf' || k
    || '@firma.example, Tel. +49 221 ' || (k + 1000000) || '</p></body></html>' AS html FROM prt"""
WEB = "SELECT page_id, url, html FROM pages UNION ALL SELECT page_id, url, html FROM shop"
W = dict(prt=PART, shop=SHOP, web=WEB)

EL = X.element_pattern


def headings(src: str) -> str:
    lists = ", ".join(
        f"list_transform({every(clean(), EL(f'h{n}'), 2)}, lambda b: {{'lv': 'h{n}', 'b': b}})" for n in range(1, 7))
    rows = each(src, {"e": f"flatten([{lists}])"})
    return (f"SELECT page_id, url, 'ueberschrift' AS kind, pos, 'ebene=' || e.lv || chr(10) || 'text=' || t AS fields, "
            f"['ebene', 'text'] AS ks, [e.lv, t] AS vs FROM (SELECT *, {inner('e.b')} AS t FROM ({rows})) WHERE t <> ''")


def anchors(src: str) -> str:
    rows = each(src, {"a": every(clean(), EL("a"), 1), "b": every(clean(), EL("a"), 2)})
    return (f"SELECT page_id, url, pos, {inner('b')} AS text, {attr('a', 'href')} AS href FROM ({rows}) "
            r"WHERE regexp_matches(a, '(?is)(?:^|\s)href\s*=')")


def links(src: str) -> str:
    return (f"SELECT page_id, url, 'link' AS kind, pos, 'text=' || text || chr(10) || 'url=' || target AS fields, "
            f"['text', 'url'] AS ks, [text, target] AS vs FROM (SELECT *, {resolve('url', 'href')} AS target FROM ({anchors(src)}))")


def texts(src: str, kind: str, tag: str) -> str:
    rows = each(src, {"b": every(clean(), EL(tag), 2)})
    return (f"SELECT page_id, url, '{kind}' AS kind, pos, 'text=' || t AS fields, ['text'] AS ks, [t] AS vs "
            f"FROM (SELECT *, {inner('b')} AS t FROM ({rows})) WHERE t <> ''")


def paragraphs(src: str) -> str:
    rows = each(src, {"b": f"string_split({sub(clean(), r'(?is)<p(?:\s[^>]*)?>', 'chr(1)')}, chr(1))[2:]"})
    cut = first("b", r"(?is)^(.*?)(?:</p|</article|\z)", 1)
    return (f"SELECT page_id, url, 'absatz' AS kind, pos, 'text=' || t AS fields, ['text'] AS ks, [t] AS vs "
            f"FROM (SELECT *, {inner(cut)} AS t FROM ({rows})) WHERE t <> ''")


def matches(src: str, kind: str, pattern: str, text: str, digits: int = 0) -> str:
    rows = each(src, {"m": every(text, pattern, 0)})
    num = "length(regexp_replace(m, '\\P{Nd}', '', 'g'))"
    return (f"SELECT page_id, url, '{kind}' AS kind, pos, 'wert=' || t AS fields, ['wert'] AS ks, [t] AS vs FROM ("
            f"SELECT page_id, url, {strip('m')} AS t, {num} AS d, "
            f"row_number() OVER (PARTITION BY page_id, url ORDER BY p) - 1 AS pos FROM ("
            f"SELECT page_id, url, m, min(pos) AS p FROM ({rows}) GROUP BY ALL)) WHERE d >= {digits}")


def both(kind: str, pattern: str, digits: int = 0) -> str:
    docs = "(SELECT doc_id AS page_id, source AS url, text FROM documents)"
    return matches("web", kind, pattern, vis(), digits) + " UNION ALL " + matches(docs, kind, pattern, "text", digits)


def meta(src: str) -> str:
    html = sub("html", X.block_pattern(["script", "style"]))
    rows = each(src, {"a": every(html, r"(?is)<meta(\s[^>]*)>", 1)})
    key = f"coalesce(nullif({attr('a', 'name')}, ''), {attr('a', 'property')})"
    title = squeeze(decode(first(html, EL("title"), 2)))
    return (f"SELECT page_id, url, 'meta' AS kind, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS pos, "
            f"'feld=' || k || chr(10) || 'wert=' || v AS fields, ['feld', 'wert'] AS ks, [k, v] AS vs FROM ("
            f"SELECT page_id, url, -1 AS o, 'title' AS k, {title} AS v FROM {src} "
            rf"WHERE regexp_matches({html}, '(?is)<title(?:\s[^>]*)?>') "
            f"UNION ALL SELECT page_id, url, pos, k, v FROM (SELECT page_id, url, pos, {key} AS k, "
            f"{squeeze(attr('a', 'content'))} AS v FROM ({rows})) WHERE k <> '' AND v <> '')")


IMAGES = " UNION ALL ".join(
    f"""SELECT k + 1000000000 AS page_id, 'https://' || host || '/katalog/' || k AS url, 'bild' AS kind, {i - 1} AS pos,
      'alt=Bild {i}' || chr(10) || 'titel=' || chr(10) || 'url=https://' || host || '/img/' || k || '-{i}.png' AS fields,
      ['alt', 'titel', 'url'] AS ks, ['Bild {i}', '', 'https://' || host || '/img/' || k || '-{i}.png'] AS vs FROM prt"""
    for i in (1, 2, 3))
FLAT = "SELECT page_id, kind, pos, fields FROM "


def flat(sql: str, **ctes: str) -> str:
    return _(f"{FLAT}({sql})", **ctes)


def job(src: str, presets: list[str]) -> str:
    build = {"headings": headings, "links": links, "paragraphs": paragraphs, "meta": meta,
             "images": lambda s: IMAGES, "lists": lambda s: texts(s, "listeneintrag", "li"),
             "emails": lambda s: matches(s, "email", X.EMAIL, vis()),
             "prices": lambda s: matches(s, "preis", X.PRICE, vis())}
    return " UNION ALL ".join(f"SELECT *, {n} AS preset FROM ({build[p](src)})" for n, p in enumerate(presets))


JOB = ["headings", "links", "lists", "paragraphs", "emails", "meta"]
DISTINCT = """SELECT page_id, kind, pos, fields FROM job
  QUALIFY row_number() OVER (PARTITION BY kind, fields ORDER BY page_id, preset, pos) = 1"""

_TAGS = r"(?is)<([a-z][a-z0-9]*)(\s[^>]*)>"
_JUNKED = sub("html", X.block_pattern(X.JUNK))
_CLS = f"string_split({squeeze(attr('a', 'class'))}, ' ')[1:4]"
SIG = (f"SELECT page_id, url, pos, lower(t) || '.' || array_to_string(c, '.') AS signature "
       f"FROM (SELECT *, {_CLS} AS c FROM ({each('web', {'t': every(_JUNKED, _TAGS, 1), 'a': every(_JUNKED, _TAGS, 2)})})) "
       "WHERE c[1] <> ''")

_READ = (lambda: strip(sub(decode(sub(sub("html", X.block_pattern(X.JUNK + X.FURNITURE)), "<[^>]*>", "chr(1)")),
                           rf"(?:{X.SPACE}|\x01)*\x01(?:{X.SPACE}|\x01)*", "chr(10)")))()
_RED = sub(sub(f"CASE WHEN regexp_matches(w, '(?is)<body') THEN regexp_replace({first('w', r'(?is)<body(?:\s[^>]*)?>.*', 0)}, "
               r"'(?is)(</body\s*>).*', '\1') ELSE w END", r"\n\s*\n+", "chr(10)"), r">\s+<", "'><'")

TARGETS = f"""SELECT page_id, target, min(pos) AS pos, arg_min(text, pos) AS text
  FROM (SELECT page_id, url, pos, text, {norm(resolve('url', strip('href')))} AS target FROM anc
    WHERE NOT regexp_matches({strip('href')}, '^(?:mailto:|tel:|javascript:|#)'))
  WHERE regexp_matches(target, '^https?://') AND {host('target')} = {host('url')} GROUP BY page_id, target"""

# links of pages that were fetched, then one level after the other with all that was found before
_EDGE = f"""MATERIALIZED SELECT h.page_id AS src, min([0, 2, 5][k]) AS link_pos, d.dst FROM pages h, range(1, 4) t(k)
    JOIN (SELECT page_id, min(page_id) OVER (PARTITION BY {norm('url')}) AS dst FROM pages) d
      ON d.page_id = (h.page_id * 7 + k) % (SELECT max(page_id) + 1 FROM pages)
  WHERE h.page_id % 13 <> 0 AND h.page_id % 17 <> 0 AND h.page_id % 19 <> 0 GROUP BY ALL"""
_WALK = """SELECT 0 AS depth, list(page_id ORDER BY page_id) AS found, list(page_id) AS seen FROM pages WHERE page_id % 50 = 7
  UNION ALL
  SELECT any_value(depth) + 1, list(dst ORDER BY k), list_concat(any_value(seen), list(dst)) FROM (
    SELECT f.depth, f.seen, e.dst, min({'a': f.place, 'b': e.link_pos}) AS k
    FROM (SELECT depth, seen, unnest(found) AS src, unnest(range(len(found))) AS place FROM walk) f JOIN edge e ON e.src = f.src
    WHERE NOT list_contains(f.seen, e.dst) GROUP BY ALL) HAVING count(*) > 0"""
_FOUND = """SELECT page, depth, row_number() OVER (ORDER BY depth, place) AS rn
  FROM (SELECT depth, unnest(found) AS page, unnest(range(len(found))) AS place FROM walk)"""

_FOLDER = f"regexp_extract({first('url', X.URL_PARTS, 3)}, '^.*/')"
_ROOT = f"{first('url', X.URL_PARTS, 1)} || '://' || {host('url')}"

_CARDS = " UNION ALL ".join(
    f"""SELECT k, host, p_brand, {i} AS i, 'Teil ' || (p_size + {i}) AS name, price{i} || ' €' AS preis FROM prt"""
    for i in (1, 2, 3))

STATEMENTS: dict[str, str] = {
    "a3_stored_job_rows": _("""SELECT event_id AS job_id, 0 AS pos,
        'art=' || event_type || chr(10) || 'n=' || event_id || chr(10) || 'typ=link' AS fields FROM events
      UNION ALL SELECT event_id, 1, 'props=' || replace(props, ' ', '') || chr(10) || 'typ=meta' FROM events"""),
    "a4_page_scan": _("SELECT page_id, url, length(html) AS chars FROM pages"),
    "a5_seed_list": _(f"""SELECT url, min(ord) AS ord FROM (SELECT page_id AS ord, {norm('line')} AS url FROM (
        SELECT page_id, CASE page_id % 7 WHEN 0 THEN '  ' || chr(9) || url || ' ' WHEN 1 THEN '   '
          WHEN 2 THEN {host('url')} ELSE url END AS line FROM pages)) WHERE url <> '' GROUP BY url"""),
    "a6_template_lines": _("""SELECT p_brand AS owner, 'f' || (p_partkey % 4) AS name,
        arg_max('p.' || lower(replace(p_type, ' ', '.')) || ' = x', p_partkey) AS selector
      FROM part WHERE p_partkey % 5 > 1 GROUP BY ALL"""),
    "j1_squeezed_text": _(f"SELECT doc_id, {squeeze('text')} AS text FROM documents"),
    "j2_normalised_urls": _(f"""SELECT page_id, {norm('raw')} AS url FROM (SELECT page_id,
        CASE WHEN page_id % 3 = 0 THEN ' ' || regexp_replace(url, '^https?://', '') || '// ' ELSE url END AS raw FROM pages)"""),
    "j3_resolved_links": _(f"""SELECT page_id, href, CASE href
          WHEN '../a/./b?x=../y' THEN {_ROOT} || regexp_replace({_FOLDER}, '[^/]+/$', '') || 'a/b?x=../y'
          WHEN '?q=1' THEN {_ROOT} || {first('url', X.URL_PARTS, 3)} || '?q=1'
          WHEN '#teil' THEN regexp_extract(url, '^[^#]*') || '#teil'
          WHEN '//other.example/z' THEN {first('url', X.URL_PARTS, 1)} || '://other.example/z'
          WHEN 'rel/path/..' THEN {_ROOT} || {_FOLDER} || 'rel/'
          WHEN '/x/../../y/.' THEN {_ROOT} || '/y/' WHEN '' THEN url WHEN './' THEN {_ROOT} || {_FOLDER}
          ELSE href END AS target
      FROM pages, (SELECT unnest(['../a/./b?x=../y', '?q=1', '#teil', '//other.example/z', 'mailto:a@b.example',
        'rel/path/..', 'https://c.example/../d', '/x/../../y/.', '', './']) AS href)"""),
    "j4_values_as_text": _("""SELECT vec_id, CAST(label AS VARCHAR) AS label, '[' || vec_id || ',' || label || ']' AS nested,
        CASE WHEN label > 2 THEN CAST(label AS VARCHAR) ELSE '' END AS gap,
        '[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(x * 1000) AS BIGINT)), ',') || ']' AS thousandths
      FROM embeddings"""),
    "k1_body_text": _(f"""SELECT page_id, 'text' AS kind, 0 AS pos, 'laenge=' || length(t) || chr(10) || 'text=' || t AS fields
      FROM (SELECT page_id, {vis()} AS t FROM pages) WHERE t <> ''"""),
    "k2_paragraphs": flat(paragraphs("pages")),
    "k2_paragraphs_open": _("""SELECT p_partkey AS page_id, 'absatz' AS kind, unnest([0, 1, 2]) AS pos,
        unnest(['text=' || p_name, 'text=' || p_type, 'text=' || p_brand]) AS fields FROM part"""),
    "k3_headings": flat(headings("web"), **W),
    "k4_links": flat(links("web"), **W),
    "k5_images": flat(IMAGES, prt=PART),
    "k6_tables": _("""SELECT k + 1000000000 AS page_id, 'tabellenzeile' AS kind, 0 AS pos,
        'Merkmal=Merkmal' || chr(10) || 'spalte_2=' || chr(10) || 'tabelle=1' AS fields FROM prt
      UNION ALL SELECT k + 1000000000, 'tabellenzeile', 1,
        'Merkmal=Marke' || chr(10) || 'spalte_2=' || p_brand || chr(10) || 'tabelle=1' FROM prt""", prt=PART),
    "k6_tables_nested": _("""SELECT p_partkey AS page_id, 'tabellenzeile' AS kind, unnest([0, 1, 2, 1000000]) AS pos,
        unnest(['A=A' || chr(10) || 'B=B' || chr(10) || 'tabelle=1',
          'A=' || p_brand || chr(10) || 'B=' || p_partkey || ' x' || chr(10) || 'spalte_3=' || p_partkey || chr(10) || 'tabelle=1',
          'A=' || p_partkey || chr(10) || 'tabelle=1', 'spalte_1=' || p_partkey || chr(10) || 'tabelle=2']) AS fields FROM part"""),
    "k7_list_items_nested": _("""SELECT p_partkey AS page_id, 'listeneintrag' AS kind, unnest([0, 1, 2, 3]) AS pos,
        unnest(['text=Gruppe ' || p_size || ' ' || p_brand || ' ' || p_type, 'text=' || p_brand, 'text=' || p_type, 'text=Ende']) AS fields
      FROM part"""),
    "k7_list_items": flat(texts("pages", "listeneintrag", "li")),
    "k8_emails": flat(both("email", X.EMAIL), **W),
    "k9_phones": flat(both("telefon", X.PHONE, 7), **W),
    "k10_prices": flat(both("preis", X.PRICE), **W),
    "k11_metadata": flat(meta("web"), **W),
    "k12_json_ld": _("""SELECT k + 1000000000 AS page_id, 'jsonld' AS kind, 0 AS pos, '@type=Product' || chr(10) || 'name=' || p_name
        || chr(10) || 'sale=true' || chr(10) || 'size=' || p_size AS fields FROM prt""", prt=PART),
    "j9_scalar_fields": _("""SELECT field, count(*) AS objects, count(DISTINCT value) AS "values" FROM (
        SELECT unnest(['@type', 'name', 'sale', 'size']) AS field, unnest(['Product', p_name, 'true', CAST(p_size AS VARCHAR)]) AS value
        FROM part) GROUP BY field"""),
    "k14_reduction_profile": _(f"""SELECT host, count(*) AS pages, CAST(sum(b) AS BIGINT) AS before, CAST(sum(a) AS BIGINT) AS after,
        round(1 - sum(a) / sum(b), 9) AS saved
      FROM (SELECT {host('url')} AS host, length(html) AS b, length({_RED}) AS a
        FROM (SELECT *, {sub('html', X.block_pattern(X.JUNK), "''")} AS w FROM pages)) GROUP BY host"""),
    "k15_readable_text": _(f"SELECT page_id, {_READ} AS text FROM pages"),
    "k16_structure_per_page": _("""SELECT page_id, signature, count(*) AS n, min(pos) AS pos FROM sig GROUP BY ALL HAVING count(*) > 1""",
        **W, sig=SIG),
    "h10_top_structures": _(f"""SELECT host, rank, signature, n FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY n DESC, f) AS rank
        FROM (SELECT {host('url')} AS host, signature, count(*) AS n, min({{'a': page_id, 'b': pos}}) AS f
          FROM sig GROUP BY ALL HAVING count(*) > 1)) WHERE rank <= 40""", **W, sig=SIG),
    "k21_preset_job": _(DISTINCT, **W, job=job("web", JOB)),
    "i1_column_union": _("""SELECT "column", f.a AS page_id, f.b AS preset, f.c AS pos, f.d AS "at" FROM (
        SELECT "column", min({'a': page_id, 'b': preset, 'c': pos, 'd': x}) AS f FROM (
          SELECT page_id, preset, pos, x, CASE kind WHEN 'link' THEN ['text', 'url'] WHEN 'ueberschrift' THEN ['ebene', 'text']
            ELSE ks END[x + 1] AS "column" FROM (SELECT *, unnest(range(len(ks))) AS x FROM job)) GROUP BY "column")""",
        **W, job=job("web", JOB)),
    "i2_distinct_records": _(DISTINCT, job=job("pages", ["lists", "links"])),
    "i3_distinct_matches": flat(matches("pages", "wort", "[A-Z][a-z]{7,}", vis())),
    "i6_sorted_columns": _('SELECT DISTINCT unnest(ks) AS "column" FROM job', **W, job=job("web", JOB)),
    "c6_any_column_filter": _(FLAT + """job WHERE len(list_filter(vs, lambda v: contains(lower(v), 'ean'))) > 0
      OR contains(kind, 'ean') OR contains(lower(url), 'ean')""", **W, job=job("web", JOB)),
    "c7_successful_pages": _(f"""SELECT page_id, {host('url')} AS job_id, 200 AS status FROM pages
      WHERE page_id % 13 <> 0 AND page_id % 17 <> 0 AND page_id % 19 <> 0"""),
    "c8_minimum_length": _(FLAT + """job WHERE length(CASE kind WHEN 'meta' THEN vs[2] ELSE vs[1] END) >= 40""",
        job=job("pages", ["paragraphs", "lists", "meta"])),
    "c10_non_empty_records": _(f"{FLAT} ({texts('pages', 'listeneintrag', 'li')}) WHERE pos % 3 <> 0"),
    "c14_remove_records": _(f"{FLAT} ({texts('pages', 'listeneintrag', 'li')}) WHERE length(vs[1]) >= 4"),
    "h4_mixed_sort": _(r"""SELECT page_id, kind, pos, CASE WHEN v = '' THEN 2 WHEN num IS NOT NULL THEN 0 ELSE 1 END AS sort_class,
        round(CASE WHEN v <> '' AND num IS NOT NULL THEN num ELSE 0.0 END, 6) AS sort_number,
        CASE WHEN v <> '' AND num IS NULL THEN lower(v) ELSE '' END AS sort_text
      FROM (SELECT page_id, kind, pos, v, TRY_CAST(nullif(regexp_replace(replace(replace(v, '.', ''), ',', '.'), '[^\p{Nd}.-]', '', 'g'), '') AS DOUBLE) AS num
        FROM (SELECT page_id, kind, pos, CASE kind WHEN 'preis' THEN vs[1] ELSE vs[2] END AS v FROM job))""",
        **W, job=job("shop", ["prices", "headings"])),
    "h5_german_alphabet": _(f"""SELECT page_id, name, row_number() OVER (PARTITION BY page_id
        ORDER BY name COLLATE NOCASE.NOACCENT.DE, name) AS rank
      FROM (SELECT DISTINCT page_id, vs[1] AS name FROM ({texts('pages', 'listeneintrag', 'li')}))
      WHERE regexp_full_match(name, '\\p{{L}}+')"""),
    "h11_summary_sample": _("""SELECT page_id, kind, pos, greatest(0, (SELECT count(*) FROM job) - 60) AS left_out FROM job
      ORDER BY page_id, preset, pos LIMIT 60""", job=job("pages", ["links", "lists"])),
    "b4_record_table": _("""SELECT kind AS typ, url AS quelle, CASE kind WHEN 'ueberschrift' THEN vs[1] ELSE '' END AS ebene,
        CASE kind WHEN 'ueberschrift' THEN vs[2] WHEN 'link' THEN vs[1] ELSE '' END AS text,
        CASE kind WHEN 'link' THEN vs[2] WHEN 'bild' THEN vs[3] ELSE '' END AS url, CASE kind WHEN 'meta' THEN vs[1] ELSE '' END AS feld,
        CASE kind WHEN 'meta' THEN vs[2] ELSE '' END AS wert, CASE kind WHEN 'bild' THEN vs[1] ELSE '' END AS alt,
        CASE kind WHEN 'bild' THEN vs[2] ELSE '' END AS titel FROM job""", **W, job=job("web", ["headings", "links", "meta", "images"])),
    "e14_records_to_pages": _("""SELECT page_id, count(*) AS rows FROM (
        SELECT CASE WHEN i.pos = 0 THEN (SELECT min(page_id) FROM pages) ELSE p.page_id END AS page_id
        FROM items i LEFT JOIN pages p ON p.url = i.url AND i.pos <> 0) GROUP BY page_id""",
        items=texts("pages", "listeneintrag", "li")),
    "k20_page_results": _(f"""SELECT p.page_id, {strip(decode(first('html', EL('title'), 2)))} AS title, strlen(html) AS bytes,
        CASE WHEN page_id % 13 = 0 THEN 404 WHEN page_id % 17 = 0 THEN 500 ELSE 200 END AS status,
        CASE WHEN page_id % 19 = 0 THEN 'timeout' ELSE '' END AS error, round(length(html) * 0.5, 3)::DOUBLE AS elapsed,
        (SELECT count(*) FROM job j WHERE j.page_id = p.page_id) AS rows FROM pages p""", job=job("pages", JOB)),
    "f12_job_summary": _(f"""SELECT {host('url')} AS job_id, count(*) AS pages,
        count(*) FILTER (WHERE page_id % 13 <> 0 AND page_id % 17 <> 0 AND page_id % 19 <> 0) AS ok,
        count(*) FILTER (WHERE page_id % 13 = 0 OR page_id % 17 = 0 OR page_id % 19 = 0) AS errors,
        round(sum(length(html) * 0.5), 2)::DOUBLE AS duration, CAST(sum(rows) AS BIGINT) AS rows
      FROM (SELECT *, (SELECT count(*) FROM job j WHERE j.page_id = p.page_id) AS rows FROM pages p) GROUP BY job_id""",
        job=job("pages", JOB)),
    "e9_apply_templates": _(f"""SELECT page_id, 'datensatz' AS kind, pos, 'name=' || n || chr(10) || 'ziel=' || z AS fields
      FROM (SELECT page_id, pos, {inner(first('b', r'(?is)<a(?:\s[^>]*)?>(.*?)(?:</a\s*>|\z)', 1))} AS n,
          {resolve('url', attr(first('b', r'(?is)<a((?:\s[^>]*)?)>', 1), 'href'))} AS z
        FROM ({each('pages', {'b': every(clean(), EL('li'), 2)})})) WHERE n <> '' OR z <> ''"""),
    "k13_repeated_records": _("""SELECT k + 1000000000 AS page_id, 'datensatz' AS kind, i - 1 AS pos,
        'bild=https://' || host || '/img/' || k || '-' || i || '.png' || chr(10) || 'fehlt=' || chr(10) || 'name=' || name
        || chr(10) || 'preis=' || preis || chr(10) || 'ziel=https://' || host || '/katalog/details/' || k || '-' || i || '?v=1' AS fields
      FROM cards""", prt=PART, cards=_CARDS),
    "k13_nested_records": _("""SELECT p_partkey AS page_id, 'datensatz' AS kind, unnest([0, 1]) AS pos,
        unnest(['art=karte' || chr(10) || 'name=' || p_name || chr(10) || 'preis=' || p_partkey || ' €',
          'art=karte klein' || chr(10) || 'name=Teil ' || p_size || chr(10) || 'preis=']) AS fields FROM part"""),
    "k17_learned_templates": _("""SELECT DISTINCT host, CASE WHEN p_brand LIKE '%1' THEN 2 ELSE 1 END AS rank,
        'article.karte.gross' AS container, 'mehr=a.mehr' || chr(10) || 'name=h2.name' || chr(10) || 'preis=span.preis' AS fields FROM prt
      UNION ALL SELECT DISTINCT host, 1, 'div.sep', 'x=span.x' FROM prt WHERE p_brand LIKE '%1'""", prt=PART),
    "f14_empty_shares": _("""SELECT j.host, j."column", round_even(1 - count(*) FILTER (WHERE trim(v) <> '') / any_value(t.n), 2)::DOUBLE AS empty
      FROM (SELECT host, unnest(ks) AS "column", unnest(vs) AS v FROM job) j
        JOIN (SELECT host, count(*) AS n FROM job GROUP BY host) t ON t.host = j.host GROUP BY j.host, j."column" """,
        **W, job=f"SELECT {host('url')} AS host, ks, vs FROM ({headings('web')} UNION ALL {meta('web')} UNION ALL {IMAGES})"),
    "g11_boundary_sample": _(f"""SELECT host, page_id, preset, pos, rn AS "at" FROM (SELECT *, {host('url')} AS host,
          row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY {host('url')}) AS n FROM job
          WINDOW w AS (PARTITION BY {host('url')} ORDER BY page_id, preset, pos))
      WHERE rn IN (0, n // 2, n - 1)""", job=job("pages", ["links", "lists"])),
    "k18_quality_gate": _(f"""SELECT h.host, count(j.host) AS rows, coalesce(max(s.empty), 0.0)::DOUBLE AS worst,
        CASE WHEN count(j.host) = 0 OR max(s.empty) >= 1 THEN 'FIX' ELSE 'PASS' END AS verdict
      FROM (SELECT DISTINCT {host('url')} AS host FROM web) h LEFT JOIN job j ON j.host = h.host
        LEFT JOIN (SELECT host, max(empty) AS empty FROM shares GROUP BY host) s ON s.host = h.host GROUP BY h.host""",
        **W, job=f"SELECT {host('url')} AS host, ks, vs FROM ({IMAGES} UNION ALL {matches('web', 'email', X.EMAIL, vis())})",
        shares="""SELECT j.host, j.c, round_even(1 - count(*) FILTER (WHERE v <> '') / any_value(t.n), 2) AS empty
          FROM (SELECT host, unnest(ks) AS c, unnest(vs) AS v FROM job) j
            JOIN (SELECT host, count(*) AS n FROM job GROUP BY host) t ON t.host = j.host GROUP BY j.host, j.c"""),
    "k22_fallback_chain": _("""SELECT k + 1000000000 AS page_id, 'datensatz' AS kind, 0 AS preset, i - 1 AS pos,
        'mehr=mehr' || chr(10) || 'name=' || name || chr(10) || 'preis=' || preis AS fields FROM cards
      UNION ALL SELECT page_id, kind, preset, pos, fields FROM job""", prt=PART, cards=_CARDS,
        job=job("pages", ["headings", "lists"])),
    "k22_fallback_outcome": _(f"""SELECT DISTINCT host, CASE WHEN p_brand LIKE '%1' THEN 2 ELSE 1 END AS rank FROM prt
      UNION ALL SELECT DISTINCT {host('url')}, 0 FROM pages""", prt=PART),
    "c9_followable_links": _("SELECT page_id, pos, target, text FROM targets", **W, anc=anchors("web"), targets=TARGETS),
    "e10_robots": _(f"""SELECT page_id, CASE WHEN starts_with(h, 'm.') THEN NOT starts_with(path, '/de/')
        ELSE starts_with(path, '/fr/7') OR NOT starts_with(path, '/fr/') END AS allowed
      FROM (SELECT page_id, {host('url')} AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages)"""),
    "e10_robots_agents": _(f"""SELECT agent, page_id, CASE WHEN starts_with(h, 'm.') THEN agent <> 'other' AND NOT starts_with(path, '/de/')
        ELSE agent = 'fetcher' AND (starts_with(path, '/fr/7') OR NOT starts_with(path, '/fr/')) END AS allowed
      FROM (SELECT page_id, {host('url')} AS h, regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1) AS path FROM pages),
        (SELECT unnest(['fetcher', 'other', 'nobody-else']) AS agent)"""),
    "e11_unseen_links": _(f"""SELECT target, f.page_id, f.pos FROM (
        SELECT target, min({{'page_id': page_id, 'pos': pos}}) AS f FROM targets
        WHERE target NOT IN (SELECT {norm('url')} FROM web) GROUP BY target)""", **W, anc=anchors("web"), targets=TARGETS),
    "k19_link_graph": _("SELECT src, dst, link_pos FROM edge", edge=_EDGE),
    "k19_link_expansion": _("SELECT page, depth FROM reached", edge=_EDGE, walk=_WALK, reached=_FOUND),
    "h12_page_limit": _("SELECT page, depth FROM reached WHERE rn <= 100", edge=_EDGE, walk=_WALK, reached=_FOUND),
    "k23_relevant_links": _(f"""SELECT host, rank, page_id, pos, target, score FROM (
        SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id, pos) AS rank FROM (
          SELECT page_id, pos, target, {host('target')} AS host,
            len(list_intersect(['the', 'der', 'la', 'und', 'mehr'],
              regexp_split_to_array(lower(text || ' ' || target), '[^\\p{{L}}\\p{{N}}]+'))) AS score FROM targets) WHERE score > 0)
      WHERE rank <= 3""", anc=anchors("pages"), targets=TARGETS),
}
