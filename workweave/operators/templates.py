"""Extraction templates: applying, learning, judging and falling back.

A template names a repeated container and its fields by flat selectors: ``tag``, ``.class``,
``tag.class`` (several classes allowed), each optionally with ``@attribute``; any other selector
raises an error. Selectors are data, so one plan serves all sites. Elements nest, and may lack
their end tags (``functions.markup``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workweave.functions import markup as M
from workweave.functions import text as X
from workweave.operators import pages as P
from workweave.operators import records as R
from workweave.operators import sequences as S
from workweave.session import broadcast_if_small, settle

# A column empty in at least this share of rows fails the gate
EMPTY_LIMIT = 1.0
# How many repeated structures a report lists
LISTED_STRUCTURES = 40
# A template takes a few kilobytes
BROADCAST_TEMPLATES = 20_000


def template_lines(lines: DataFrame) -> DataFrame:
    """(owner, name, selector) from lines ``name = selector``.

    Blank lines and ``#`` comments are skipped; the last line of a name wins.
    """
    line = X.strip_space(F.col("line"))
    cut = F.instr(line, "=")
    name = X.strip_space(F.substr(line, F.lit(1), cut - 1))
    selector = X.strip_space(F.substr(line, cut + 1))
    parsed = lines.filter((line != "") & ~line.startswith("#") & (cut > 0)).select(
        "owner", "line_no", name.alias("name"), selector.alias("selector"))
    return parsed.filter("name <> '' and selector <> ''").groupBy("owner", "name").agg(
        F.max_by("selector", "line_no").alias("selector"))


# -- applying ----------------------------------------------------------------------------
def _checked(templates: DataFrame, extra: list[str]) -> DataFrame:
    """Templates with their selectors as a list; one that is not flat raises an error."""
    def reads(f: Column) -> Column:
        selector = F.coalesce(M.checked(f.value), F.lit(""))
        wanted = F.when(F.contains(selector, F.lit("@")),
                        F.trim(F.substring_index(selector, "@", -1)))
        return F.struct(f.key.alias("key"), selector.alias("selector"), wanted.alias("wanted"))

    container = F.coalesce("container", F.lit(""))
    return templates.select("host", *extra, F.when(
        ~F.contains(container, F.lit("@")), M.checked(container)).otherwise(F.raise_error(
            F.concat(F.lit("a container has no attribute: "), container))).alias("container"),
        F.transform(F.map_entries("fields"), reads).alias("reads"))


def _value(raw: Column, r: Column, base: Column) -> Column:
    """Text of markup, or an attribute; addresses are resolved."""
    value = X.decode(raw)
    target = F.when(r.wanted.isin("href", "src") & (value != ""), X.resolve_url(base, value)
                    ).otherwise(value)
    return F.when(r.wanted.isNotNull(), X.squeeze(target)).otherwise(X.inner_text(raw))


def apply_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Records of every page by its host's template; all-empty records are dropped.

    ``templates`` has ``host, container, fields`` and may carry ``rank``. The template table is
    broadcast while it is small, so a site with very many pages stays spread over the cluster.
    """
    extra = [c for c in templates.columns if c not in ("host", "container", "fields")]
    table = broadcast_if_small(settle(_checked(templates, extra)), limit=BROADCAST_TEMPLATES)
    html = X.without(F.col("html"), X.UNSEEN)
    selectors = F.transform("reads", lambda r: r.selector)
    rows = pages.select(
        "page_id", "url", html.alias("html"), X.host(F.col("url")).alias("host")
    ).join(table, "host").select(
        "page_id", "url", "host", *extra, "reads",
        F.posexplode(M.picked(F.col("html"), F.col("container"), selectors)).alias("pos", "raw"))
    fields = F.map_from_entries(F.transform("reads", lambda r, i: F.struct(
        r.key, _value(F.get("raw", i), r, F.col("url")))))
    found = rows.select("page_id", "url", F.lit("datensatz").alias("kind"),
                        F.lit(0).alias("preset"), F.col("pos").cast("long").alias("pos"), "host",
                        *extra, fields.alias("fields"))
    return R.non_empty(found)


# -- learning --------------------------------------------------------------------------
def learn_templates(pages: DataFrame, ranks: int = 1) -> DataFrame:
    """(host, rank, container, fields): the ``ranks`` best templates per host.

    All pages of a host decide. Candidates are the signatures that repeat on a page, most frequent
    first; fields are the signatures that stand in at least half of such elements, named by their
    last class. A candidate without fields is no template. Pages are read once, and each is reduced
    to one row for every two signatures of which one holds the other.
    """
    html = X.without(F.col("html"), X.JUNK)
    boxes = pages.select(
        "page_id", X.host(F.col("url")).alias("host"),
        F.explode(M.structures(html, P.KEPT_CLASSES, X.JUNK)).alias("b")
    ).select("page_id", "host", "b.*")
    itself = F.struct(F.lit(None).cast("string").alias("signature"), F.col("n").alias("n"),
                      F.lit(0).cast("long").alias("pos"))
    counted = settle(
        boxes.select("host", "container", F.struct("page_id", "pos").alias("at"),
                     F.explode(F.concat(F.array(itself), "inside")).alias("i"))
        .groupBy("host", "container", "i.signature").agg(
            F.sum("i.n").alias("n"), F.max("i.n").alias("most"), F.min("i.pos").alias("pos"),
            F.min("at").alias("first")))
    repeated = counted.filter("signature is null and most > 1").select(
        "host", "container", F.col("n").alias("boxes"), "first")
    name = F.element_at(F.split("signature", r"\."), -1)
    usable = F.col("signature").rlike(M.SELECTOR) & ~F.col("signature").rlike(M.PSEUDO)
    fields = (
        counted.filter(usable).select("host", "container", "signature", "n", "pos")
        .join(repeated, ["host", "container"])
        .filter(F.col("n") * 2 >= F.col("boxes"))
        .groupBy("host", "container", name.alias("name"))
        .agg(F.min_by("signature", F.struct("pos", "signature")).alias("signature"),
             F.first("boxes").alias("boxes"), F.first("first").alias("first"))
        .groupBy("host", "container")
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "signature"))))
             .alias("fields"), F.first("boxes").alias("boxes"), F.first("first").alias("first"))
        .filter(F.col("container").rlike(M.SELECTOR) & ~F.col("container").rlike(M.PSEUDO))
    )
    best = W.partitionBy("host").orderBy(F.desc("boxes"), "first")
    return fields.withColumn("rank", F.row_number().over(best)).filter(
        F.col("rank") <= ranks).select("host", "rank", "container", "fields")


# -- judging -----------------------------------------------------------------------------
def _filled(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column, n, filled, total): per column in how many records it is present and not
    blank, and how many records there are; a column of null stands for the records themselves.

    One pass over the records: they are counted beside their columns, before the shuffle.
    """
    itself = F.struct(F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"))
    counted = (
        records.select(*keys, F.explode(F.concat(F.array(itself), F.map_entries("fields"))).alias("f"))
        .groupBy(*keys, F.col("f.key").alias("column"))
        .agg(F.count("*").alias("n"), F.count_if(X.strip_space(F.col("f.value")) != "").alias("filled"))
    )
    return counted.withColumn("total", F.max(F.when(F.col("column").isNull(), F.col("n"))).over(
        W.partitionBy(*keys)))


def _empty() -> Column:
    return F.bround(1 - F.col("filled") / F.col("total"), 2)


def empty_shares(records: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, column, empty): share of records in which a column is missing or blank."""
    return _filled(records, keys).filter("column is not null").select(
        *keys, "column", _empty().alias("empty"))


def verdicts(records: DataFrame, groups: DataFrame, keys: list[str],
             empty_limit: float = EMPTY_LIMIT) -> DataFrame:
    """PASS or FIX per group: there are records and no column is empty throughout."""
    judged = _filled(records, keys).groupBy(*keys).agg(
        F.first("total").alias("rows"),
        F.max(F.when(F.col("column").isNotNull(), _empty())).alias("worst"))
    verdict = F.when(F.col("rows").isNull() | (F.col("worst") >= empty_limit), "FIX").otherwise("PASS")
    return (
        groups.select(*keys).distinct().join(judged, keys, "left")
        .select(*keys, F.coalesce("rows", F.lit(0)).alias("rows"),
                F.coalesce("worst", F.lit(0.0)).alias("worst"), verdict.alias("verdict"))
    )


def boundary_sample(records: DataFrame, key: str, size: int = 3) -> DataFrame:
    """First, middle and last record of each group, by page and place.

    Ranks are found in blocks of pages, so that one large group is never sorted by a
    single task.
    """
    place = ["page_id", "preset", "pos"]
    slim = settle(records.select(key, *place))
    total = broadcast_if_small(settle(slim.groupBy(key).agg(F.count("*").alias("n"))))
    ranked = S.running_sums(slim, [key], place, F.floor(F.col("page_id") / 256), {"rn": F.lit(1)},
                            levels=2)
    at = F.col("rn") - 1
    wanted = F.array_sort(F.array_distinct(F.array(
        F.lit(0).cast("long"), F.floor(F.col("n") / 2), F.col("n") - 1)))
    chosen = ranked.join(total, key).filter(
        F.array_contains(F.slice(wanted, 1, size), at)).select(*place, at.alias("at"))
    return records.join(broadcast_if_small(settle(chosen)), place)


# -- fallback ------------------------------------------------------------------------------
def extract_with_fallback(pages: DataFrame, presets: list[str], ranks: int = 2,
                          empty_limit: float = EMPTY_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Records and per-host outcome: the first template that passes, else the presets."""
    hosts = pages.select(X.host(F.col("url")).alias("host")).distinct()
    templates = settle(learn_templates(pages, ranks))
    tried = settle(apply_templates(pages, templates.select("host", "container", "fields", "rank")))
    judged = verdicts(tried, templates, ["host", "rank"], empty_limit)
    chosen = judged.filter("verdict = 'PASS'").groupBy("host").agg(F.min("rank").alias("rank"))
    outcome = settle(hosts.join(chosen, "host", "left"))
    small = broadcast_if_small(outcome)
    by_template = tried.join(small, ["host", "rank"], "left_semi").drop("rank")
    left_over = pages.withColumn("host", X.host(F.col("url"))).join(
        small.filter("rank is null").select("host"), "host", "left_semi")
    by_preset = P.extract(left_over.drop("host"), presets).withColumn(
        "host", X.host(F.col("url")))
    return by_template.unionByName(by_preset), outcome
