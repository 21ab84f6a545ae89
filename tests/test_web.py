import random
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from workweave.functions import text as X
from workweave.operators import links as L
from workweave.operators import pages as P
from workweave.operators import records as R
from workweave.operators import templates as T
from workweave.session import spread

HTML = """<!DOCTYPE html><html><head><title> Laden &amp; Mehr </title>
<meta name="description" content="Gute  Ware"><meta property="og:type" content="shop">
<meta name="x" content=""><style>h2{color:red}</style>
<script>var a = "<h2>nicht</h2> x@y.example";</script>
<script type="application/ld+json">[{"@type": "Shop", "open": true, "n": 3, "geo": {"a": 1}}, 5]</script>
<script type="application/ld+json">{kaputt</script></head>
<body style="margin:0" onload='go()'><!-- <h1>weg</h1> --><nav><a href="/">Start</a></nav>
<h2 class="titel">Zwei</h2><h1>Eins</h1>
<article class="karte a b c d e" data-id="1"><h2 class="name">Tisch</h2><span class="preis">19,99 €</span>
  <a class="mehr" href="p/1#x">mehr</a><img data-src="/i/1.png" alt=" Ein  Tisch "></article>
<article class="karte" data-id="2"><h2 class="name">Stuhl</h2><span class="preis">5 EUR</span>
  <a href="https://other.example/q" class='mehr'>mehr</a></article>
<article class="karte"><h2 class="name"></h2></article>
<table><tr><th>Name</th><th></th></tr><tr><td>A</td><td>B</td><td>C</td></tr><tr><td> </td></tr></table>
<p class="kontakt">Schreib an info@laden.example oder +49 221 123456, info@laden.example</p><p>Zwei<p>Drei</p>
</body></html>"""


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame([(1, "https://shop.example/liste/a", HTML)],
                                 "page_id long, url string, html string")


def _fields(df):
    return [r.fields for r in df.orderBy("page_id", "preset", "pos").collect()]


def test_presets(shop):
    one = lambda name: _fields(P.extract(shop, [name]))
    assert [(f["ebene"], f["text"]) for f in one("headings")] == [
        ("h1", "Eins"), ("h2", "Zwei"), ("h2", "Tisch"), ("h2", "Stuhl")]
    assert [f["url"] for f in one("links")] == [
        "https://shop.example/", "https://shop.example/liste/p/1#x", "https://other.example/q"]
    assert one("images") == [{"url": "https://shop.example/i/1.png", "alt": "Ein Tisch", "titel": ""}]
    assert one("tables") == [{"tabelle": "1", "Name": "Name", "spalte_2": ""},
                             {"tabelle": "1", "Name": "A", "spalte_2": "B", "spalte_3": "C"}]
    assert one("emails") == [{"wert": "info@laden.example"}]
    assert one("phones") == [{"wert": "+49 221 123456"}]
    assert one("prices") == [{"wert": "19,99 €"}, {"wert": "5 EUR"}]
    assert [(f["feld"], f["wert"]) for f in one("meta")] == [
        ("title", "Laden & Mehr"), ("description", "Gute Ware"), ("og:type", "shop")]
    assert one("jsonld") == [{"@type": "Shop", "open": "true", "n": "3"}]
    assert [f["text"] for f in one("paragraphs")] == [
        "Schreib an info@laden.example oder +49 221 123456, info@laden.example", "Zwei", "Drei"]
    text = one("text")[0]
    assert "nicht" not in text["text"] and "weg" not in text["text"]
    assert int(text["laenge"]) == len(text["text"])


def test_templates_from_selectors(spark, shop):
    fields = {"name": "h2.name", "preis": ".preis", "ziel": "a.mehr@href", "leer": "em"}
    table = spark.createDataFrame([("shop.example", "article.karte", fields)],
                                  "host string, container string, fields map<string,string>")
    got = _fields(T.apply_templates(shop, table))
    assert got == [
        {"name": "Tisch", "preis": "19,99 €", "ziel": "https://shop.example/liste/p/1#x", "leer": ""},
        {"name": "Stuhl", "preis": "5 EUR", "ziel": "https://other.example/q", "leer": ""}]
    whole = spark.createDataFrame([("shop.example", "", {"titel": "title", "h": "h1"})],
                                  "host string, container string, fields map<string,string>")
    assert _fields(T.apply_templates(shop, whole)) == [{"titel": "Laden & Mehr", "h": "Eins"}]


def test_learning_and_fallback(spark):
    card = '<div class="k"><b class="n">{0}</b><i class="p">{1}</i></div>'
    full = "".join(card.format(i, i) for i in range(3))
    bare = "".join('<div class="s"><u class="z"> </u></div>' for _ in range(5))
    pages = spark.createDataFrame([
        (1, "http://a.example/1", f"<body>{full}</body>"), (2, "http://a.example/2", f"<body>{full}</body>"),
        (3, "http://b.example/1", f"<body>{bare}{full}</body>"), (4, "http://c.example/1", "<h1>nur Titel</h1>")],
        "page_id long, url string, html string")
    found, outcome = T.extract_with_fallback(pages, ["headings"])
    assert {r.host: r["rank"] for r in outcome.collect()} == {
        "a.example": 1, "b.example": 2, "c.example": None}
    rows = found.collect()
    assert sorted((r.page_id, r.kind) for r in rows) == (
        [(1, "datensatz")] * 3 + [(2, "datensatz")] * 3 + [(3, "datensatz")] * 3 + [(4, "ueberschrift")])
    assert {"n": "0", "p": "0"} in [r.fields for r in rows]


def test_urls(spark):
    base = "https://h.example:8080/a/b/c.html?q=1#f"
    hrefs = ["x", "./x", "../x", "../../../x", "/x/./y/../z", "?z=2", "#g", "", "//o.example/p",
             "http://z.example/a/../b", "mailto:a@b.example", "x/..", "a/b/?c=../d", "..", "."]
    df = spark.createDataFrame([(base, h) for h in hrefs], "b string, h string")
    got = [r[0] for r in df.select(X.resolve_url(F.col("b"), F.col("h"))).collect()]
    want = [urljoin(base, h) for h in hrefs]
    want[hrefs.index("")] = base
    assert got == want
    raw = ["example.com/", " https://a.example/x//#y ", "", "http://a.example", "a.example#b", "https:///"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in raw], "u string").select(
        X.normalise_url(F.col("u"))).collect()]
    assert got == ["https://example.com", "https://a.example/x", "", "http://a.example", "https://a.example",
                   "https:"]


def test_reduced_page(spark, shop):
    short = shop.select(P.reduced_html(F.col("html"))).first()[0]
    assert short.startswith('<body>') and short.endswith("</body>")
    assert "data-id" not in short and "onload" not in short and "style" not in short
    assert 'class="karte a b c"' in short and "script" not in short and "<!--" not in short
    assert len(short) < len(HTML)
    no_links = shop.select(P.reduced_html(F.col("html"), keep_links=False)).first()[0]
    assert "href" not in no_links and 'class="mehr"' in no_links
    cut = shop.select(P.reduced_html(F.col("html"), 100)).first()[0]
    assert cut == f"{short[:75]}\n<!-- ... {len(short) - 100} Zeichen gekürzt ... -->\n{short[-25:]}"
    long_value = "<body><a href=\"" + "x" * 200 + "\">a = b c = d</a></body>"
    df = spark.createDataFrame([(long_value,)], "html string")
    assert df.select(P.reduced_html(F.col("html"))).first()[0] == long_value
    assert df.select(P.reduced_html(F.col("html"), value_chars=120)).first()[0] == (
        "<body><a href=\"" + "x" * 120 + "...\">a = b c = d</a></body>")


def test_readable_text(shop):
    text = P.readable(shop).first().text
    assert "Start" not in text and "Tisch\n19,99 €\nmehr" in text


def test_signatures(shop):
    found = {r.signature: r.n for r in P.repeated_signatures(P.signatures(shop), ["page_id"]).collect()}
    assert found == {"h2.name": 3, "span.preis": 2, "a.mehr": 2, "article.karte": 2}


def test_records(spark):
    rows = [(1, "u1", "k", 0, 0, {"a": "1", "b": ""}), (2, "u2", "k", 0, 0, {"b": "", "a": "1"}),
            (2, "u2", "k", 0, 1, {"c": "", "b": ""}), (3, "u3", "j", 0, 0, {"a": "1", "b": ""})]
    df = spark.createDataFrame(rows, "page_id long, url string, kind string, preset int, pos long, "
                                     "fields map<string,string>")
    assert {(r.page_id, r.pos) for r in R.distinct_records(df).collect()} == {(1, 0), (2, 1), (3, 0)}
    assert R.column_names(df) == ["a", "b", "c"]
    assert R.non_empty(df).count() == 3
    assert R.filter_any(df, "U3").count() == 1
    values = ["19,99 €", "5 EUR", "12.50", "", "b", "A", "0", "-", None, "1.2.3,4"]
    v = spark.createDataFrame([(x,) for x in values], "v string")
    got = [r.v for r in R.sort_by(v, F.col("v")).collect()]
    assert got[:5] == ["0", "5 EUR", "19,99 €", "1.2.3,4", "12.50"]
    assert got[5:8] == ["-", "A", "b"] and set(got[8:]) == {"", None}


def _queue(seeds, links, limit=None, max_depth=None):
    """First in, first out; ``links`` gives the targets of a page in order."""
    queue, seen, pages = [(s, 0) for s in seeds], set(seeds), []
    while queue and (limit is None or len(pages) < limit):
        page, depth = queue.pop(0)
        pages.append((page, depth))
        for dst in links(page) if max_depth is None or depth < max_depth else []:
            if dst not in seen:
                seen.add(dst)
                queue.append((dst, depth + 1))
    return pages


def test_expansion_matches_a_queue(spark):
    rnd = random.Random(3)
    edges = [(s, rnd.randrange(60), k) for s in range(60) for k in range(4)]
    edges += [(s, 7, 9) for s in range(60)]  # a page linked from everywhere
    df = spark.createDataFrame(edges, "src long, dst long, link_pos int")
    start = spark.createDataFrame([(0, 0), (5, 1)], "page long, ord long")
    links = lambda p: [d for _, d, _ in sorted((e for e in edges if e[0] == p), key=lambda e: e[2])]
    for limit, deepest in ((1, 3), (2, 3), (9, None), (30, 3), (None, 3), (None, None)):
        got = L.expand(start, df, deepest, limit).orderBy("ord").collect()
        assert [(r.page, r.depth) for r in got] == _queue([0, 5], links, limit, deepest), (limit, deepest)


def test_expansion_ends_by_itself(spark, monkeypatch):
    monkeypatch.setattr(L, "LEVELS_TOGETHER", 3)
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(9)] + [(9, 2, 0), (50, 51, 0)],
                                  "src long, dst long, link_pos int")
    start = spark.createDataFrame([(0, 0)], "page long, ord long")
    got = L.expand(start, chain).orderBy("ord").collect()
    assert [(r.page, r.depth) for r in got] == [(i, i) for i in range(10)]
    assert L.expand(start.limit(0), chain).count() == 0


def test_links_between_pages(spark):
    pages = spark.createDataFrame([
        (1, "https://a.example/x/", '<a href="y#p">1</a><a href="mailto:q@a.example">2</a><a href="/x/y/">3</a>'
            '<a href="https://b.example">4</a><a href="gone">5</a>'),
        (2, "https://a.example/x/y", '<a href="/x#f">back</a>'), (3, "b.example/", '<a href="https://a.example/x">a</a>'),
        (4, "https://a.example/x/y#again", "")], "page_id long, url string, html string")
    fetches = spark.createDataFrame([(1, 200, ""), (2, 404, ""), (3, 200, ""), (4, 200, "x")],
                                    "page_id long, status int, error string")
    edges = lambda *a: {tuple(r) for r in L.link_graph(pages, *a).collect()}
    assert edges() == {(1, 2, 0), (2, 1, 0)}
    assert edges(None, False) == {(1, 2, 0), (1, 3, 3), (2, 1, 0), (3, 1, 0)}
    # a page that failed is reached and leads nowhere
    assert edges(fetches, False) == {(1, 2, 0), (1, 3, 3), (3, 1, 0)}


ROBOTS = """Disallow: /lost
User-agent: one
User-agent: Two

User-agent: Two
Allow: /a/b
# still the same block
Disallow: /a
Disallow: /caf%C3%A9
Crawl-delay: 3
User-agent: three
Disallow:
   
Disallow: /late

User-agent: five
Crawl-delay: 1

User-agent: *
Disallow: /x*y
Disallow: /q?a=1
Allow: /all
Disallow: *

User-agent: *
Allow: /

User-agent: four"""


def test_robots_follow_the_standard_parser(spark):
    from urllib.robotparser import RobotFileParser
    urls = ["https://h.example" + p for p in (
        "", "/", "/a", "/a/b/c", "/ab", "/caf%C3%A9/x", "/caf%c3%a9", "/café", "/lost", "/x*y", "/xzy", "/q?a=1",
        "/q", "/all/1", "/100%", "/a+b", "/*", "/late")] + ["https://other.example/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = L.robots_rules(spark.createDataFrame([("h.example", ROBOTS)], "host string, text string"))
    plain = RobotFileParser()
    plain.parse(ROBOTS.splitlines())
    for agent in ("Two/1.0", "one", "three", "four", "five", "unknown", "TWOfold"):
        got = {r.url: r.allowed for r in L.allowed(pages, rules, agent).collect()}
        assert got == {u: "other" in u or plain.can_fetch(agent, u) for u in urls}, agent
    plan = L.allowed(pages, rules, "two")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "StartsWith" not in plan


def test_followable_links(spark, shop):
    targets = [r.target for r in L.followable(shop).orderBy("pos").collect()]
    assert targets == ["https://shop.example", "https://shop.example/liste/p/1"]
    assert L.followable(shop, same_host=False, containing="other").count() == 1


def test_template_lines(spark):
    lines = ["# Kommentar", "", "a = .x", " b=p@href ", "ohne", "a = .y = z", "= q", "c ="]
    df = spark.createDataFrame([("o", n, t) for n, t in enumerate(lines)], "owner string, line_no int, line string")
    assert {r.name: r.selector for r in T.template_lines(df).collect()} == {"a": ".y = z", "b": "p@href"}


def test_references_are_decoded_once(spark):
    from workweave.functions import text as X
    rows = [("Gr&ouml;&szlig;e &ndash; x", "Größe – x"), ("&amp;lt; &#8364;&#x41;", "&lt; €A"),
            ("&amp &nope; a&b; &#0;", "&amp &nope; a&b; &#0;"), (None, None), ("&amp;", "&")]
    df = spark.createDataFrame(rows, "given string, wanted string")
    assert all(r.got == r.wanted for r in df.withColumn("got", X.decode(df.given)).collect())


def test_request_words_ignore_punctuation(spark):
    from workweave.operators import links as L
    found = spark.createDataFrame([(1, 0, "Unsere Preise", "https://a.de/x")],
                                  "page_id long, pos int, text string, target string")
    for request in ("Preise, bitte", "Preise bitte"):
        assert L.relevant(found, request, limit=5).count() == 1


NESTED = """<body><div class="c a"><div class="c b"><h2>in</h2></div><h2 class="t">out</h2></div>
<div class="c"><b class="t">two</b><a href='/x?a=1&amp;b=2'>go</a></div></span>
<ul><li>one<ul><li>one a<li>one b</ul><li>two<p>in two</li><li><table><tr><td><ul><li>deep</ul></table></ul>
<table><tr><th>A<th>B<tr><td>1<td><table><tr><th>C</th></tr><tr><td>inner</td></tr></table>after
<tr><td></td><td>2</td></tr></table>
<p>first<b>bold<p>second<div>block</div>loose<p>third<table><tr><td><p>cell</table>
<article><p>open</article><p>last</p></p></body>"""


def test_elements_nest_and_end_by_themselves(spark):
    page = spark.createDataFrame([(1, "https://h.example/", NESTED)], "page_id long, url string, html string")
    one = lambda name: _fields(P.extract(page, [name]))
    assert [f["text"] for f in one("lists")] == [
        "one one a one b", "one a", "one b", "two in two", "deep", "deep"]
    assert [f["text"] for f in one("paragraphs")] == [
        "in two", "first bold", "second", "third", "cell", "open", "last"]
    assert one("tables") == [
        {"tabelle": "1", "spalte_1": "deep"},
        {"tabelle": "2", "A": "A", "B": "B"},
        {"tabelle": "2", "A": "1", "B": "C inner after", "C": "C", "spalte_4": "inner"},
        {"tabelle": "2", "A": "C"}, {"tabelle": "2", "A": "inner"},
        {"tabelle": "2", "A": "", "B": "2"},
        {"tabelle": "3", "C": "C"}, {"tabelle": "3", "C": "inner"},
        {"tabelle": "4", "spalte_1": "cell"}]


def _template(spark, container, **fields):
    return spark.createDataFrame([("h.example", container, fields)],
                                 "host string, container string, fields map<string,string>")


def test_containers_hold_what_nests_in_them(spark):
    page = spark.createDataFrame([(1, "https://h.example/", NESTED)], "page_id long, url string, html string")
    read = lambda *a, **k: _fields(T.apply_templates(page, _template(spark, *a, **k)))
    assert read("div.c", kopf="h2", titel=".t", ziel="a@href") == [
        {"kopf": "in", "titel": "out", "ziel": ""}, {"kopf": "in", "titel": "", "ziel": ""},
        {"kopf": "", "titel": "two", "ziel": "https://h.example/x?a=1&b=2"}]
    assert read("div.c", text="", art="@class")[0] == {"text": "in out", "art": "c a"}
    assert read("div.b.c", text="") == [{"text": "in"}]
    for bad in ("div > p", "ul li", "a:hover", "#x", "a[href]", "a, b", "*"):
        with pytest.raises(Exception, match="not a flat selector"):
            read("div.c", x=bad)
        with pytest.raises(Exception, match="not a flat selector"):
            read(bad, x="a")
    with pytest.raises(Exception, match="no attribute"):
        read("div@class", x="a")


def test_templates_are_learned_from_all_pages(spark):
    row = '<li class="r"><div class="w"><b class="n">x</b></div></li>'
    pages = spark.createDataFrame([
        (1, "http://a.example/1", '<p class="s"></p><p class="s"></p><p class="s"></p>'),
        (2, "http://a.example/2", f"<ul>{row * 2}</ul>"), (3, "http://a.example/3", f"<ul>{row * 2}</ul>"),
        (4, "http://b.example/1", '<div class="top"><b class="n">once</b></div>'),
        (5, "http://b.example/2", '<div class="top"><b class="n">once</b></div>')],
        "page_id long, url string, html string")
    found = {(r.host, r.rank, r.container): r.fields for r in T.learn_templates(pages, 3).collect()}
    # p.s holds nothing, div.top stands once on every page
    assert found == {("a.example", 1, "li.r"): {"w": "div.w", "n": "b.n"}, ("a.example", 2, "div.w"): {"n": "b.n"}}


def test_long_pages_are_folded_in_linear_time():
    import time

    from workweave.functions import markup as M
    for text in ("<a x" * 60_000, "<div>" * 60_000, "<b>x " * 60_000, "<li>" * 60_000,
                 "<p><i>" * 40_000, "</div>" * 60_000, "<td>" * 60_000):
        t = time.time()
        M.elements(text)
        assert time.time() - t < 3, text[:9]


def test_files_hold_every_column(spark, tmp_path):
    from workweave.sinks import tables
    rows = [(1, "u1", "k", 0, 0, {"a": "1", "b": "x, \"y\""}), (2, "u2", "k", 0, 0, {"b": "", "f": "zwei\nZeilen"}),
            (2, "u2", "j", 0, 1, {"sechs": "6", "a": " "})]
    df = spark.createDataFrame(rows, "page_id long, url string, kind string, preset int, pos long, "
                                     "fields map<string,string>").repartition(2)
    tables.write_csv(df, str(tmp_path / "csv"))
    back = tables.read_csv(spark, str(tmp_path / "csv"))
    assert back.columns == ["typ", "quelle", "a", "b", "f", "sechs"]
    assert sorted(tuple(r) for r in back.collect()) == [
        ("j", "u2", " ", "", "", "6"), ("k", "u1", "1", 'x, "y"', "", ""), ("k", "u2", "", "", "zwei\nZeilen", "")]
    # the files one after the other are a table for any reader
    import csv
    text = "".join(f.read_text() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert [r["sechs"] for r in csv.DictReader(text.splitlines(keepends=True)) if r["typ"] == "j"] == ["6"]


def test_records_are_extracted_once_for_a_table(spark, tmp_path):
    from workweave.sinks import tables
    seen = spark.sparkContext.accumulator(0)

    @F.udf("map<string,string>")
    def made(n):
        seen.add(1)
        return {f"c{n % 3}": str(n)}

    records = spark.range(30).select(
        F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("k").alias("kind"), F.lit(0).alias("preset"),
        F.col("id").alias("pos"), made.asNondeterministic()("id").alias("fields"))
    table = R.as_table(records)
    assert table.columns == ["typ", "quelle", "c0", "c1", "c2"] and table.count() == 30
    assert seen.value == 30
    tables.write_csv(records, str(tmp_path / "csv"))
    assert tables.read_csv(spark, str(tmp_path / "csv")).count() == 30
    assert seen.value == 60


def test_pages_are_folded_once_for_all_elements(spark, monkeypatch):
    from workweave.functions import markup as M
    html = "<ul><li>a<LI class=x>b</ul><link href=x><p>c<pre>d</pre>"
    page = spark.createDataFrame([(1, "u", html), (2, "u", None), (3, "u", "<pre>x<link>")] * 100,
                                 "page_id long, url string, html string").coalesce(1)
    both = P.extract(page, ["lists", "paragraphs"])
    plan = both._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("run(") <= 2
    for n in (1, 64, 1000):
        monkeypatch.setattr(M, "HELD", n)
        assert sorted(r.fields["text"] for r in both.collect()) == ["a"] * 100 + ["b"] * 100 + ["c"] * 100
    assert both.groupBy("kind").count().orderBy("kind").collect() == [("absatz", 100), ("listeneintrag", 200)]


def test_addresses_and_attributes_as_before(spark):
    texts = ["a@b.cc+d@e.ff x@y.zz", "..@a.bb", "no mail+at@all", "a.b-c+d@e_f.gg-h, @x.yy", "x@y.z", "a@b@c.dd", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", F.regexp_extract_all("t", F.lit(X.EMAIL), F.lit(0)).alias("a"),
                       F.regexp_extract_all("t", F.lit(X.EMAIL_RUNS), F.lit(0)).alias("b")).collect():
        assert r.a == r.b, r.t
    tags = [' src="a\'b\'" x', " src='\"q\"'", " src = bare y", ' src=""', " data-src=no", ' SRC="x&amp;y"', " src=\"open"]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(X.attribute(F.col("t"), "src")).collect()
    assert [r[0] for r in got] == ["a'b'", '"q"', "bare", "", "", "x&y", ""]


def test_rows_of_one_row_group_are_spread(spark, tmp_path):
    """A file of one row group has many splits, of which one holds all rows."""
    name, path = "spark.sql.files.maxPartitionBytes", str(tmp_path / "one.parquet")
    spark.range(20_000).selectExpr("id", "sha2(string(id), 256) AS html").coalesce(1).write.parquet(path)
    before = spark.conf.get(name)
    spark.conf.set(name, "16k")
    try:
        pages = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert pages.rdd.getNumPartitions() >= cores
        dealt = spread(pages, "id")
        most = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert most <= 6_000 and dealt.distinct().count() == 20_000
        even = spark.range(0, 8_000, 1, 4 * cores)
        assert spread(even, "id") is even
        assert spread(spark.range(0, 0, 1, 4 * cores), "id").count() == 0
    finally:
        spark.conf.set(name, before)
