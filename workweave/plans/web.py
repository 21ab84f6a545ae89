"""Queries on captured pages: records, templates, quality, link graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workweave.functions import text as X
from workweave.operators import links as L
from workweave.operators import pages as P
from workweave.operators import records as R
from workweave.operators import templates as T
from workweave.plans.registry import query
from workweave.sources import jobs as J
from workweave.sources.fixtures import Plan

# Presets of the mixed extraction job
JOB_PRESETS = ["headings", "links", "lists", "paragraphs", "emails", "meta"]


def _flat(records: DataFrame) -> DataFrame:
    """Records with their fields as key-sorted text."""
    return records.select("page_id", "kind", "pos", _text(F.col("fields")).alias("fields"))


def _text(fields: Column) -> Column:
    return F.array_join(F.transform(
        F.array_sort(F.map_entries(fields)), lambda e: F.concat(e.key, F.lit("="), e.value)), "\n")


# -- sources -----------------------------------------------------------------------
@query("a3_stored_job_rows")
def _(p: Plan) -> DataFrame:
    return J.stored_rows(p.stored_job).select("job_id", "pos", _text(F.col("fields")).alias("fields"))


@query("a4_page_scan")
def _(p: Plan) -> DataFrame:
    return p.page.select("page_id", "url", F.length("html").alias("chars"))


@query("a5_seed_list")
def _(p: Plan) -> DataFrame:
    key = F.col("page_id")
    line = (
        F.when(key % 7 == 0, F.concat(F.lit("  \t"), "url", F.lit(" ")))
        .when(key % 7 == 1, F.lit("   "))
        .when(key % 7 == 2, X.host(F.col("url"))).otherwise(F.col("url"))
    )
    return L.seeds(p.page.select(key.alias("ord"), line.alias("line")))


@query("a6_template_lines")
def _(p: Plan) -> DataFrame:
    key = F.col("p_partkey")
    line = (
        F.when(key % 5 == 0, F.concat(F.lit("# "), "p_name"))
        .when(key % 5 == 1, F.lit(""))
        .otherwise(F.concat(F.lit(" f"), (key % 4).cast("string"), F.lit(" =  p."),
                            F.lower(F.replace("p_type", F.lit(" "), F.lit("."))), F.lit(" = x ")))
    )
    return T.template_lines(p.table("part").select(
        F.col("p_brand").alias("owner"), key.alias("line_no"), line.alias("line")))


# -- URLs and text --------------------------------------------------------------------
@query("j1_squeezed_text")
def _(p: Plan) -> DataFrame:
    return p.document.select("doc_id", X.squeeze(F.col("text")).alias("text"))


@query("j2_normalised_urls")
def _(p: Plan) -> DataFrame:
    bare = F.regexp_replace("url", "^https?://", "")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), bare, F.lit("// "))).otherwise(
        F.col("url"))
    return p.page.select("page_id", X.normalise_url(raw).alias("url"))


@query("j3_resolved_links")
def _(p: Plan) -> DataFrame:
    forms = F.array(*map(F.lit, [
        "../a/./b?x=../y", "?q=1", "#teil", "//other.example/z", "mailto:a@b.example", "rel/path/..",
        "https://c.example/../d", "/x/../../y/.", "", "./"]))
    href = F.explode(forms)
    return p.page.select("page_id", "url", href.alias("href")).select(
        "page_id", "href", X.resolve_url(F.col("url"), F.col("href")).alias("target"))


@query("j4_values_as_text")
def _(p: Plan) -> DataFrame:
    e = p.table("embeddings").select("vec_id", "label", F.array(
        F.col("vec_id"), F.col("label").cast("long")).alias("nested"),
        F.when(F.col("label") > 2, F.col("label")).alias("gap"),
        F.transform("embedding", lambda x: F.floor(x * 1000)).alias("thousandths"))
    types = dict(e.dtypes)
    return e.select("vec_id", *[R.stringify(F.col(c), types[c]).alias(c)
                                for c in ("label", "nested", "gap", "thousandths")])


# -- presets ------------------------------------------------------------------------------
@query("k1_body_text")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.page, ["text"]))


@query("k2_paragraphs")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.page, ["paragraphs"]))


@query("k2_paragraphs_open")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.nested_page, ["paragraphs"]))


@query("k3_headings")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["headings"]))


@query("k4_links")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["links"]))


@query("k5_images")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.shop_page, ["images"]))


@query("k6_tables")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.shop_page, ["tables"]))


@query("k6_tables_nested")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.nested_page, ["tables"]))


@query("k7_list_items_nested")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.nested_page, ["lists"]))


@query("k7_list_items")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.page, ["lists"]))


def _documents(p: Plan) -> DataFrame:
    return p.document.select(F.col("doc_id").alias("page_id"),
                                       F.col("source").alias("url"), "text")


@query("k8_emails")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["emails"]).unionByName(
        P.matches(_documents(p), "email", F.col("text"), X.EMAIL)))


@query("k9_phones")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["phones"]).unionByName(
        P.matches(_documents(p), "telefon", F.col("text"), X.PHONE, min_digits=7)))


@query("k10_prices")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["prices"]).unionByName(
        P.matches(_documents(p), "preis", F.col("text"), X.PRICE)))


@query("k11_metadata")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["meta"]))


@query("k12_json_ld")
def _(p: Plan) -> DataFrame:
    return _flat(P.extract(p.web_page, ["jsonld"]))


@query("j9_scalar_fields")
def _(p: Plan) -> DataFrame:
    return P.extract(p.web_page, ["jsonld"]).select(F.explode("fields").alias("field", "value")).groupBy(
        "field").agg(F.count("*").alias("objects"), F.count_distinct("value").alias("values"))


@query("k14_reduction_profile")
def _(p: Plan) -> DataFrame:
    return P.reduction_profile(p.page).withColumn("saved", F.round("saved", 9))


@query("k15_readable_text")
def _(p: Plan) -> DataFrame:
    return P.readable(p.page).select("page_id", "text")


@query("k16_structure_per_page")
def _(p: Plan) -> DataFrame:
    found = P.repeated_signatures(P.signatures(p.web_page), ["page_id"])
    return found.select("page_id", "signature", "n", F.col("first.pos").alias("pos"))


@query("h10_top_structures")
def _(p: Plan) -> DataFrame:
    placed = P.signatures(p.web_page).withColumn("host", X.host(F.col("url")))
    w = W.partitionBy("host").orderBy(F.desc("n"), "first")
    ranked = P.repeated_signatures(placed, ["host"]).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= T.LISTED_STRUCTURES).select("host", "rank", "signature", "n")


# -- records ------------------------------------------------------------------------------
def _job(p: Plan) -> DataFrame:
    return P.extract(p.web_page, JOB_PRESETS)


@query("k21_preset_job")
def _(p: Plan) -> DataFrame:
    return _flat(R.distinct_records(_job(p)))


@query("i1_column_union")
def _(p: Plan) -> DataFrame:
    return R.column_union(_job(p)).select("column", "first.page_id", "first.preset", "first.pos",
                                          "first.at")


@query("i2_distinct_records")
def _(p: Plan) -> DataFrame:
    return _flat(R.distinct_records(P.extract(p.page, ["lists", "links"])))


@query("i3_distinct_matches")
def _(p: Plan) -> DataFrame:
    words = P.matches(p.page, "wort", X.visible_text(F.col("html")), r"[A-Z][a-z]{7,}")
    return _flat(words)


@query("i6_sorted_columns")
def _(p: Plan) -> DataFrame:
    return R.sorted_columns(_job(p))


@query("c6_any_column_filter")
def _(p: Plan) -> DataFrame:
    return _flat(R.filter_any(_job(p), "EAN"))


@query("c7_successful_pages")
def _(p: Plan) -> DataFrame:
    return P.successful(p.job_page).select("page_id", "job_id", "status")


@query("c8_minimum_length")
def _(p: Plan) -> DataFrame:
    return _flat(P.long_enough(P.extract(p.page, ["paragraphs", "lists", "meta"]), 40))


@query("c10_non_empty_records")
def _(p: Plan) -> DataFrame:
    blanked = P.extract(p.page, ["lists"]).withColumn("fields", F.when(
        F.col("pos") % 3 == 0, F.create_map(F.lit("text"), F.lit(""))).otherwise(F.col("fields")))
    return _flat(R.non_empty(blanked))


@query("c14_remove_records")
def _(p: Plan) -> DataFrame:
    short = F.length(F.element_at("fields", F.lit("text"))) < 4
    return _flat(R.without_chosen(P.extract(p.page, ["lists"]), short))


@query("h4_mixed_sort")
def _(p: Plan) -> DataFrame:
    found = P.extract(p.shop_page, ["prices", "headings"])
    value = F.coalesce(F.element_at("fields", F.lit("wert")), F.element_at("fields", F.lit("text")))
    return R.sort_by(found, value).select("page_id", "kind", "pos", "sort_class",
                                          F.round("sort_number", 6).alias("sort_number"), "sort_text")


@query("h5_german_alphabet")
def _(p: Plan) -> DataFrame:
    named = P.extract(p.page, ["lists"]).select("page_id", F.element_at("fields", F.lit("text")).alias("name"))
    words = named.filter(F.col("name").rlike(r"^\p{L}+$")).distinct()
    order = W.partitionBy("page_id").orderBy(F.collate("name", "de_CI_AI"), "name")
    return words.withColumn("rank", F.row_number().over(order))


@query("h11_summary_sample")
def _(p: Plan) -> DataFrame:
    found = R.head_sample(P.extract(p.page, ["links", "lists"]), ["page_id", "preset", "pos"])
    return found.select("page_id", "kind", "pos", "left_out")


@query("b4_record_table")
def _(p: Plan) -> DataFrame:
    return R.as_table(P.extract(p.web_page, ["headings", "links", "meta", "images"]))


@query("e14_records_to_pages")
def _(p: Plan) -> DataFrame:
    items = P.extract(p.page, ["lists"]).withColumn("url", F.when(
        F.col("pos") == 0, F.concat("url", F.lit("/lost"))).otherwise(F.col("url")))
    attached = R.attach_to_pages(p.page, items)
    return attached.groupBy("page_id").agg(F.count("*").alias("rows"))


@query("k20_page_results")
def _(p: Plan) -> DataFrame:
    return P.page_results(p.page, p.job_page, P.extract(p.page, JOB_PRESETS)).select(
        "page_id", "title", "bytes", "status", "error", "elapsed", "rows")


@query("f12_job_summary")
def _(p: Plan) -> DataFrame:
    return P.job_summary(p.job_page, P.extract(p.page, JOB_PRESETS))


# -- templates ------------------------------------------------------------------------------
@query("e9_apply_templates")
def _(p: Plan) -> DataFrame:
    hosts = p.page.select(X.host(F.col("url")).alias("host")).distinct()
    table = hosts.select(
        "host", F.lit("li").alias("container"),
        F.create_map(F.lit("ziel"), F.lit("a@href"), F.lit("name"), F.lit("a")).alias("fields"))
    return _flat(T.apply_templates(p.page, table))


@query("k13_repeated_records")
def _(p: Plan) -> DataFrame:
    hosts = p.shop_page.select(X.host(F.col("url")).alias("host")).distinct()
    fields = {"name": "h2.name", "preis": ".preis", "ziel": "a.mehr@href", "bild": "img@src",
              "fehlt": "em"}
    table = hosts.select(
        "host", F.lit("article.karte").alias("container"),
        F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]).alias("fields"))
    return _flat(T.apply_templates(p.shop_page, table))


@query("k13_nested_records")
def _(p: Plan) -> DataFrame:
    fields = {"name": "h2.name", "preis": ".preis", "art": "@class"}
    table = p.nested_page.sparkSession.createDataFrame(
        [("nest.example", "div.karte", fields)],
        "host string, container string, fields map<string,string>")
    return _flat(T.apply_templates(p.nested_page, table))


@query("k17_learned_templates")
def _(p: Plan) -> DataFrame:
    return T.learn_templates(p.web_page, ranks=2).withColumn("fields", _text(F.col("fields")))


@query("f14_empty_shares")
def _(p: Plan) -> DataFrame:
    records = P.extract(p.web_page, ["headings", "meta", "images"]).withColumn(
        "host", X.host(F.col("url")))
    return T.empty_shares(records, ["host"])


@query("g11_boundary_sample")
def _(p: Plan) -> DataFrame:
    records = P.extract(p.page, ["links", "lists"]).withColumn("host", X.host(F.col("url")))
    return T.boundary_sample(records, "host").select("host", "page_id", "preset", "pos", "at")


@query("k18_quality_gate")
def _(p: Plan) -> DataFrame:
    records = P.extract(p.web_page, ["images", "emails"]).withColumn("host", X.host(F.col("url")))
    hosts = p.web_page.select(X.host(F.col("url")).alias("host"))
    return T.verdicts(records, hosts, ["host"])


@query("k22_fallback_chain")
def _(p: Plan) -> DataFrame:
    found, _outcome = T.extract_with_fallback(p.web_page, ["headings", "lists"])
    return found.select("page_id", "kind", "preset", "pos", _text(F.col("fields")).alias("fields"))


@query("k22_fallback_outcome")
def _(p: Plan) -> DataFrame:
    _found, outcome = T.extract_with_fallback(p.web_page, ["headings", "lists"])
    return outcome.select("host", F.coalesce("rank", F.lit(0)).alias("rank"))


# -- link graph ---------------------------------------------------------------------------
@query("c9_followable_links")
def _(p: Plan) -> DataFrame:
    return L.followable(p.web_page)


@query("e10_robots")
def _(p: Plan) -> DataFrame:
    rules = L.robots_rules(p.robots_text)
    return L.allowed(p.page, rules, "Fetcher/2.0 (+x)").select("page_id", "allowed")


@query("e10_robots_agents")
def _(p: Plan) -> DataFrame:
    rules = L.robots_rules(p.robots_text)
    return reduce(DataFrame.unionByName, [
        L.allowed(p.page, rules, agent).select(F.lit(agent).alias("agent"), "page_id", "allowed")
        for agent in ("fetcher", "other", "nobody-else")])


@query("e11_unseen_links")
def _(p: Plan) -> DataFrame:
    return L.unseen(L.followable(p.web_page), p.web_page)


def _seed_pages(p: Plan) -> DataFrame:
    """Every fiftieth page."""
    return p.table("pages").filter("page_id % 50 = 7").select(
        F.col("page_id").alias("page"), F.col("page_id").alias("ord"))


@query("k19_link_graph")
def _(p: Plan) -> DataFrame:
    return p.edge


@query("k19_link_expansion")
def _(p: Plan) -> DataFrame:
    return L.expand(_seed_pages(p), p.edge).select("page", "depth")


@query("h12_page_limit")
def _(p: Plan) -> DataFrame:
    return L.expand(_seed_pages(p), p.edge, max_pages=100).select("page", "depth")


@query("k23_relevant_links")
def _(p: Plan) -> DataFrame:
    return L.relevant(L.followable(p.page), "the der la und mehr", limit=3).select(
        "host", "rank", "page_id", "pos", "target", "score")
