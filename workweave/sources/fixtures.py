"""Plan, log and page tables derived from the driver's parquet tables.

Everything is arithmetic on keys and attributes, so a SQL oracle can derive the same rows.
All rows of the underlying tables take part.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.functions.text import host
from workweave.operators import calendar as C
from workweave.operators import hierarchy as H
from workweave.operators import links as L
from workweave.session import broadcast_if_small, settle, spread
from workweave.sources.reference import ABSENCE_TYPES, STATUSES, TASK_STATES


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


class Plan:
    """Departments, people, memberships, absences and the calendar of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, regions: list[str] | None = None):
        self.spark, self.sf_dir, self.regions = spark, sf_dir, regions

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- structure ---------------------------------------------------------
    @cached_property
    def tree(self) -> DataFrame:
        """Departments without limits: regions on top, nations below."""
        top = self.table("region").select(
            F.col("r_regionkey").alias("ord"),
            F.concat(F.lit("R"), "r_regionkey").alias("dept_id"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("string").alias("parent_id"),
        )
        low = self.table("nation").select(
            (F.col("n_nationkey") + 100).alias("ord"),
            F.concat(F.lit("N"), "n_nationkey").alias("dept_id"),
            F.col("n_name").alias("name"),
            F.concat(F.lit("R"), "n_regionkey").alias("parent_id"),
        )
        return top.unionByName(low)

    @cached_property
    def closure(self) -> DataFrame:
        return self._shared("closure", lambda: settle(H.closure(self.tree)))

    def _shared(self, name: str, build) -> DataFrame:
        """Small dimension tables are settled once per application and data folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]

    @cached_property
    def person(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.table("customer").select(
            key.alias("ord"), key.alias("person_id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("role"),
            (key % 9 + 24).cast("double").alias("entitlement"),
            ((key % 11) * 0.5).cast("double").alias("carryover"),
        )

    @cached_property
    def member(self) -> DataFrame:
        key, nation = F.col("c_custkey"), F.col("c_nationkey")
        first = F.struct(F.concat(F.lit("N"), nation).alias("dept_id"), F.lit(0).alias("pos"))
        second = F.struct(
            F.concat(F.lit("N"), (nation + 5) % 25).alias("dept_id"), F.lit(1).alias("pos"))
        places = (
            F.when(key % 50 == 0, F.filter(F.array(first), lambda _: F.lit(False)))
            .when(key % 7 == 0, F.array(first, second))
            .otherwise(F.array(first))
        )
        return self.table("customer").select(
            key.alias("person_id"), F.explode(places).alias("p")
        ).select("person_id", "p.dept_id", "p.pos")

    @cached_property
    def person_dept(self) -> DataFrame:
        return H.person_departments(self.person, self.member, self.closure)

    @cached_property
    def dept(self) -> DataFrame:
        """Departments with a limit that grows with the size of the branch."""
        load = F.col("size") * 0.018
        limit = F.greatest(F.lit(1), F.floor(load + 1.5 * F.sqrt(load)).cast("int"))
        sizes = H.branch_sizes(self.person_dept).select("dept_id", "size", limit.alias("cap"))
        return self._shared("dept", lambda: settle(
            self.tree.join(sizes, "dept_id", "left").select(
                "ord", "dept_id", "name", "parent_id",
                F.coalesce("cap", F.lit(1)).alias("max_absent"),
            )
        ))

    @cached_property
    def tree_order(self) -> DataFrame:
        return self._shared("tree_order", lambda: settle(H.tree_order(self.tree, self.closure)))

    @cached_property
    def limits(self) -> DataFrame:
        return broadcast_if_small(H.limits(self.dept))

    # -- intervals ---------------------------------------------------------
    @cached_property
    def absence(self) -> DataFrame:
        key = F.col("o_orderkey")
        types = F.array(*[F.lit(t) for t, *_ in ABSENCE_TYPES])
        pending, approved, rejected = (F.lit(s) for s, _ in STATUSES)
        status = (
            F.when(F.col("o_orderstatus") == "F", approved)
            .when(F.col("o_orderstatus") == "O", pending).otherwise(rejected)
        )
        start = F.col("o_orderdate").cast("date")
        return self.table("orders").select(
            key.alias("ord"), key.alias("absence_id"), F.col("o_custkey").alias("person_id"),
            F.element_at(types, (key % 8 + 1).cast("int")).alias("type"),
            status.alias("status"),
            start.alias("start"),
            F.date_add(start, (key % 14).cast("int")).alias("end"),
            (key % 5 == 0).alias("half_start"), (key % 6 == 0).alias("half_end"),
            F.col("o_orderpriority").alias("note"),
        )

    @cached_property
    def years(self) -> DataFrame:
        return C.years_spanned(self.absence)

    @cached_property
    def calendar(self) -> DataFrame:
        """The day dimension, settled once: years x regions x 366 rows at most."""
        name = "calendar:" + ",".join(self.regions or [])
        return self._shared(name, lambda: settle(C.calendar(self.years, self.regions)))

    @cached_property
    def proposal(self) -> DataFrame:
        """Every entry asked to move by 30 days, replacing itself; a few go to a later year."""
        shift = F.when(F.col("absence_id") % 97 == 0, 400).otherwise(30)
        return self.absence.select(
            F.col("absence_id").alias("proposal_id"), "person_id", "type", "status",
            F.date_add("start", shift).alias("start"), F.date_add("end", shift).alias("end"),
            "half_start", "half_end", F.col("absence_id").alias("ignore_absence_id"),
        )

    @cached_property
    def planning_years(self) -> DataFrame:
        return C.years_spanned(self.absence, self.proposal)

    @cached_property
    def planning_calendar(self) -> DataFrame:
        """The calendar over stored and proposed entries."""
        return self._shared("planning", lambda: settle(
            C.calendar(self.planning_years, self.regions)))

    @cached_property
    def versions(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Base, mine and theirs of a person table, so that every merge case occurs."""
        c = self.table("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("balance"))
        newcomer = F.col("role") == "MACHINERY"
        bal = F.col("balance")

        def bump(frm: float, to: float, by: float):
            return F.when(~newcomer & bal.between(frm, to), bal + by).otherwise(bal)

        base = c.filter(~newcomer)
        mine = c.filter(
            (~newcomer & (bal >= 0)) | (newcomer & (bal >= 3000))
        ).withColumn("balance", bump(2000, 4000, 1.0))
        theirs = c.filter(
            (~newcomer & ~bal.between(-500, 2200)) | (newcomer & ((bal < 500) | (bal >= 6000)))
        ).withColumn("balance", bump(3000, 5000, 2.0))
        return base, mine, theirs

    @cached_property
    def year_versions(self) -> tuple[tuple[DataFrame, ...], tuple[DataFrame, ...]]:
        """Rows and years of base, mine and theirs. Here 1993 is deleted and 1994 emptied, there
        1995 and 1999 are deleted and 1996 emptied; 1999 is as it was. Years can be locked."""
        nation = self.table("customer").select(
            F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 1990).alias("year"))
        base, mine, theirs = (v.join(nation, "id") for v in self.versions)
        year = F.col("year")
        base = base.filter(year < 2010)
        mine = mine.filter(~year.isin(1993, 1994, 1999, 2014)).unionByName(
            base.filter(year == 1999))
        theirs = theirs.filter(~year.isin(1995, 1996, 1999, 2010))
        every = self.table("nation").select((F.col("n_nationkey") + 1990).alias("year"))
        held = (
            every.filter(year < 2010).withColumn("locked", year % 5 == 0),
            every.filter(~year.isin(1993, 2014)).withColumn(
                "locked", (year % 5 == 0) | (year % 7 == 0)),
            every.filter(~year.isin(1995, 1999, 2010)).withColumn("locked", year % 3 == 0))
        return (base, mine, theirs), held

    @cached_property
    def ordered_people(self) -> DataFrame:
        """(list_id, ord, person_id, dept_ids): the people of a nation as one list, each in up to
        two of five departments."""
        c = self.table("customer")
        key = F.col("c_custkey")
        first, second = (F.concat(F.lit("D"), (key % n).cast("string")) for n in (5, 3))
        depts = F.when(key % 4 == 0, F.array().cast("array<string>")).when(
            (key % 4 == 1) & (first != second), F.array(first, second)).otherwise(F.array(first))
        return c.select(F.col("c_nationkey").alias("list_id"), key.alias("ord"),
                        key.alias("person_id"), depts.alias("dept_ids"))

    @cached_property
    def ordered_edits(self) -> DataFrame:
        """(list_id, seq, op, person_id, from_dept, to_dept, before_id): one edit per event, some of
        people who are not in the list, or without a department or a person to stand before."""
        key, people = F.col("event_id"), self.table("customer").agg(F.max("c_custkey")).scalar()
        customer = self.table("customer").select(
            F.col("c_custkey").alias("person_id"), F.col("c_nationkey").alias("list_id"))
        dept = lambda n, none: F.when(key % none != 0, F.concat(
            F.lit("D"), (F.floor(key / n) % 5).cast("string")))
        edits = self.table("events").select(
            key.alias("seq"),
            F.when(key % 5 == 0, "assign").when(key % 5 == 1, "unassign").otherwise("move").alias("op"),
            (key * 7 % people + 1).alias("person_id"), dept(3, 6).alias("from_dept"),
            dept(11, 8).alias("to_dept"),
            F.when(key % 3 == 0, key * 7 % people + 1 + 25 * (key % 9)).alias("before_id"))
        return edits.join(customer, "person_id").select(
            F.when(F.col("seq") % 41 == 0, (F.col("list_id") + 1) % 25).otherwise(F.col("list_id"))
            .alias("list_id"), "seq", "op", "person_id", "from_dept", "to_dept", "before_id")

    # -- logs --------------------------------------------------------------
    @cached_property
    def revision(self) -> DataFrame:
        rev = F.col("event_id")
        return self.table("events").select(
            rev.alias("rev"),
            F.when(rev % 17 == 0, rev - 2).otherwise(rev - 1).alias("base_rev"),
            F.col("ts").alias("created_at"), F.col("user_id").alias("client"),
            F.col("props").alias("data"),
        )

    @cached_property
    def task_event(self) -> DataFrame:
        states = F.array(*map(F.lit, TASK_STATES))
        return self.table("events").select(
            F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"),
            F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"),
            F.col("event_id").alias("seq"), F.col("ts"),
        )

    @cached_property
    def call(self) -> DataFrame:
        tier = (
            F.when(F.col("role") == "user", "worker").when(F.col("role") == "assistant", "verifier")
            .otherwise("advisor")
        )
        tokens = F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int"))
        return spread(self.table("conversations"), "conv_id").select(
            F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"),
            tier.alias("tier"), tokens.alias("input_tokens"),
            F.floor(tokens / 4).cast("int").alias("output_tokens"), "text",
        )

    @cached_property
    def page(self) -> DataFrame:
        return spread(self.table("pages").select("page_id", "url", "html"), "page_id")

    @cached_property
    def document(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id")

    @cached_property
    def job_page(self) -> DataFrame:
        """One fetch result per page; the job is the page's host."""
        key = F.col("page_id")
        status = F.when(key % 13 == 0, 404).when(key % 17 == 0, 500).otherwise(200)
        return self.table("pages").select(
            "page_id", F.parse_url("url", F.lit("HOST")).alias("job_id"), "url",
            status.alias("status"),
            F.when(key % 19 == 0, "timeout").otherwise("").alias("error"),
            (F.length("html") * 0.5).alias("elapsed"),
        )



    # -- documents -----------------------------------------------------------
    @cached_property
    def documents(self) -> DataFrame:
        """(plan_id, data): one small, untidy plan document per order, as JSON text.

        The four shapes of the department tree are: an unknown parent, two departments
        pointing at each other, a department ahead of such a pair, and a ring of three.
        """
        key = F.col("o_orderkey")
        text = F.lit(None).cast("string")
        shape = key % 4

        def dept(id_: str, parents: list[str | None], name=None, limit=None):
            parent = F.element_at(
                F.array(*[F.lit(p) for p in parents]).cast("array<string>"),
                (shape + 1).cast("int"))
            return F.struct(
                F.lit(id_).alias("id"), (text if name is None else F.lit(name)).alias("name"),
                parent.alias("parentId"),
                (F.lit(None).cast("int") if limit is None else F.lit(limit)).alias("maxAbsent"),
                F.lit(True).alias("collapsed"))

        a = dept("A", ["B", "B", "B", "B"], name="Werk", limit=3)
        b = dept("B", [None, "A", "A", "C"])
        c = dept("C", ["Z", "A", "A", "A"], name="Lager")
        departments = F.when(shape == 2, F.array(c, a, b)).otherwise(F.array(a, b, c))
        person = F.struct(
            F.concat(F.lit("P"), "o_custkey").alias("id"),
            F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Kunde "), "o_custkey"))
            .alias("name"),
            F.when(key % 5 != 0, F.array(F.lit("A"), F.lit("X"), F.lit("C"), F.lit("A")))
            .alias("deptIds"),
            F.when(key % 10 == 0, "B").when(key % 5 == 0, "Y").alias("deptId"),
            F.when(key % 2 == 0, (key % 9 + 24).cast("double")).alias("entitlement"))
        start = F.col("o_orderdate").cast("date")
        types = F.array(*[F.lit(t) for t, *_ in ABSENCE_TYPES], F.lit("urlaub2"))
        entry = F.struct(
            F.col("o_orderkey").cast("string").alias("id"),
            F.concat(F.lit("P"), "o_custkey").alias("personId"),
            F.element_at(types, (key % 9 + 1).cast("int")).alias("type"),
            F.when(F.col("o_orderstatus") == "F", "beantragt").when(
                F.col("o_orderstatus") == "P", "abgelehnt").alias("status"),
            start.cast("string").alias("start"),
            F.when(key % 7 != 0, F.date_add(start, (key % 14).cast("int")).cast("string"))
            .alias("end"),
            F.when(key % 3 == 0, True).alias("halfStart"), F.lit("x").alias("unknownField"))
        closure = F.struct(
            F.lit("").alias("id"), start.cast("string").alias("start"),
            F.when(key % 2 == 0, start.cast("string")).alias("end"))
        year = F.struct(
            departments.alias("departments"), F.array(person).alias("people"),
            F.array(entry).alias("absences"), F.array(closure).alias("closures"))
        doc = F.struct(
            F.lit(1).alias("v"), F.struct(F.lit("DE-NW").alias("region")).alias("settings"),
            F.create_map(F.year(start).cast("string"), year).alias("years"))
        return spread(self.table("orders"), "o_orderkey").select(
            key.cast("string").alias("plan_id"), F.to_json(doc).alias("data"))

    # -- pages ---------------------------------------------------------------
    @cached_property
    def shop_page(self) -> DataFrame:
        """One catalogue page per part: cards, a table, images, metadata and JSON-LD.

        Hosts are brands. Brands ending in 1 put empty separators between their cards.
        """
        def text(*parts):
            return F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])

        key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
        site = text(F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))), ".example.com")
        price = F.col("p_retailprice").cast("decimal(12,2)")

        def card(i: int):
            amount = F.replace((price * F.lit(i)).cast("decimal(14,2)").cast("string"),
                               F.lit("."), F.lit(","))
            return text(
                '<article class="karte gross" data-x="', key, '"><h2 class="name">Teil ', size + i,
                '</h2><span class="preis">', amount, ' €</span><a class="mehr" href="details/', key,
                f'-{i}?v=1">mehr</a><img src="/img/', key, f'-{i}.png" alt="Bild  {i}"></article>')

        rule = '<div class="sep"><span class="x"> </span></div>'
        separators = F.when(F.col("p_brand").endswith("1"), rule * 5).otherwise("")
        html = text(
            "<!DOCTYPE html><html><head><title>", name, '</title><meta name="description" content="',
            F.col("p_type"), '"><meta property="og:title" content="', name,
            '"><meta name="leer" content=""><style>p{margin:0}</style>'
            '<script>var x="<h2>no</h2>";</script><script type="application/ld+json">'
            '{"@type":"Product","name":"', name, '","size":', size,
            ',"sale":true,"offer":{"price":1}}</script></head><body data-page="', key,
            '"><h1 id="top">', name, "</h1>", card(1), separators, card(2), card(3),
            "<table><tr><th>Merkmal</th><th></th></tr><tr><td>Marke</td><td>", F.col("p_brand"),
            '</td></tr><tr><td></td><td> </td></tr></table><p class="kontakt">Mail verkauf', key,
            "@firma.example, Tel. +49 221 ", key + 1_000_000, "</p></body></html>")
        return spread(self.table("part"), "p_partkey").select(
            (key + 1_000_000_000).alias("page_id"),
            text("https://", site, "/katalog/", key).alias("url"), html.alias("html"))

    @cached_property
    def nested_page(self) -> DataFrame:
        """A page per part on which cards, lists and tables hold others of their kind, and most
        paragraphs, items, cells and rows have no end tag."""
        html = F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in (
            '<div class="karte"><div class="kopf"><h2 class="name">', F.col("p_name"),
            '</h2></div><div class="karte klein"><h2 class="name">Teil ', F.col("p_size"),
            '</h2></div><span class="preis">', F.col("p_partkey"), " €</span></div><ul><li>Gruppe ",
            F.col("p_size"), "<ul><li>", F.col("p_brand"), "<li>", F.col("p_type"),
            "</ul><li>Ende</ul><table><tr><th>A<th>B<tr><td>", F.col("p_brand"),
            "<td><table><tr><td>", F.col("p_partkey"), "</td></tr></table>x</table><p>",
            F.col("p_name"), "<p>", F.col("p_type"), "<div>dazwischen</div>lose<p>",
            F.col("p_brand"))])
        return spread(self.table("part"), "p_partkey").select(
            F.col("p_partkey").alias("page_id"),
            F.concat(F.lit("https://nest.example/"), "p_partkey").alias("url"), html.alias("html"))

    @cached_property
    def web_page(self) -> DataFrame:
        """Captured and catalogue pages together."""
        return self.page.unionByName(self.shop_page)

    @cached_property
    def site_page(self) -> DataFrame:
        """The captured pages with links to three others each, whose ids follow by arithmetic.

        Links come with fragments, slashes and spaces, twice, and among others that lead nowhere.
        """
        pages = self.table("pages").select("page_id", "url")
        n = pages.agg(F.max("page_id") + 1).scalar()
        hops = pages.select("page_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("hop"))
        targets = (
            hops.select("page_id", "hop", ((F.col("page_id") * 7 + F.col("hop")) % n).alias("to"))
            .join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("target")), "to")
            .groupBy("page_id").agg(*[F.max(F.when(F.col("hop") == i, F.col("target"))).alias(f"t{i}")
                                      for i in (1, 2, 3)])
        )
        html = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in (
            '<p><a href="', F.col("t1"), '#teil">eins</a> <a href="mailto:x@y.example">Post</a>'
            '<a href="', F.col("t2"), '//">zwei</a><a href="https://unknown.example/',
            F.col("page_id").cast("string"), '">fort</a><a href="', F.col("t2"),
            '">noch einmal</a><a href=" ', F.col("t3"), ' ">drei</a>')])
        return pages.join(targets, "page_id").select("page_id", "url", html.alias("html"))

    @cached_property
    def edge(self) -> DataFrame:
        """The links of the site's pages that were fetched."""
        return self._shared("edge", lambda: settle(
            L.link_graph(self.site_page, self.job_page, same_host=False)))

    @cached_property
    def robots_text(self) -> DataFrame:
        """(host, text): mobile hosts forbid ``/de/``, and all to one agent; all others forbid all
        but to an agent that may fetch what is not below ``/fr/``, and ``/fr/7``."""
        mobile = F.col("host").startswith("m.")
        hosts = self.table("pages").select(host(F.col("url")).alias("host")).distinct()
        return hosts.select("host", F.when(mobile, F.lit(
            "Disallow: /outside\n# all\nUser-agent: other # one\ndisallow: /\n\nUser-agent: *\n"
            "Disallow: /%64e/\nSitemap: /x.xml\n")).otherwise(F.lit(
                "User-Agent: nobody-else\r\n\r\nUser-agent: strange\r\nUser-agent: Fetch\r\n"
                "Allow: /fr/7\r\nDisallow: /fr/\r\nUser-agent: *\r\nDisallow: /\r\n"))
            .alias("text"))

    @cached_property
    def stored_job(self) -> DataFrame:
        """One stored job per event with its rows as JSON text."""
        row = F.concat(
            F.lit('[{"typ":"link","n":'), F.col("event_id").cast("string"),
            F.lit(',"art":"'), F.col("event_type"), F.lit('"},{"typ":"meta","props":'),
            F.col("props"), F.lit("}]"))
        return self.table("events").select(F.col("event_id").alias("job_id"),
                                           F.col("ts").alias("started_at"), row.alias("rows_json"))
