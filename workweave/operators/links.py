"""The link graph: followable links, robots rules, breadth-first expansion, selection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workweave.functions import text as X
from workweave.operators import pages as P
from workweave.session import broadcast_if_small, settle


# Levels of an expansion after which their tables become one
LEVELS_TOGETHER = 16


def seeds(lines: DataFrame) -> DataFrame:
    """(ord, url): trimmed, blank lines dropped, normalised, first occurrence kept."""
    url = X.normalise_url(F.col("line"))
    return lines.select("ord", url.alias("url")).filter("url <> ''").groupBy("url").agg(
        F.min("ord").alias("ord"))


def followable(pages: DataFrame, same_host: bool = True, containing: str = "") -> DataFrame:
    """(page_id, pos, target, text): links a crawl would follow, once per page."""
    href = X.strip_space(F.col("href"))
    found = P.anchors(pages).filter(
        ~href.rlike("^(?:mailto:|tel:|javascript:|#)")
    ).select("page_id", "url", "pos", "text",
             X.normalise_url(X.resolve_url(F.col("url"), href)).alias("target"))
    kept = found.filter(F.col("target").rlike("^https?://"))
    if same_host:
        kept = kept.filter(X.host(F.col("target")) == X.host(F.col("url")))
    if containing:
        kept = kept.filter(F.contains("target", F.lit(containing)))
    return kept.groupBy("page_id", "target").agg(
        F.min(F.struct("pos", "text")).alias("m")
    ).select("page_id", "m.pos", "target", "m.text")


# -- robots --------------------------------------------------------------------------------
def _unquoted(path: Column) -> Column:
    """Without percent encoding, so that paths and rules compare however they are written."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def robots_rules(texts: DataFrame) -> DataFrame:
    """(host, block, kind, value, allow, ord) from ``texts(host, text)``: the ``agent``, ``rule``
    and ``pace`` lines of every file, numbered, with the block that they belong to.

    A block is a run of user agents and the rules behind it. It ends at an empty line and where a
    user agent follows a rule; rules outside of blocks and other lines count for nothing. A rule's
    path is no pattern.
    """
    def line(x: Column, i: Column) -> Column:
        text = F.trim(F.substring_index(x, "#", 1))
        name = F.lower(F.trim(F.substring_index(text, ":", 1)))
        known = F.contains(text, F.lit(":"))
        kind = (F.when(known & (name == "user-agent"), "agent")
                .when(known & name.isin("allow", "disallow"), "rule")
                .when(known & name.isin("crawl-delay", "request-rate"), "pace")
                .when(x == "", "blank"))
        value = F.trim(F.substr(text, F.instr(text, ":") + 1))
        return F.struct(kind.alias("kind"), value.alias("value"),
                        ((name == "allow") | (value == "")).alias("allow"), i.alias("ord"))

    lines = F.filter(F.transform(F.split(F.col("text"), r"\r\n|\r|\n"), line),
                     lambda x: x.kind.isNotNull())
    # mode: 0 outside of a block, 1 behind user agents, 2 behind rules
    start = F.struct(F.lit(0).alias("block"), F.lit(0).alias("mode"),
                     F.array().cast("array<int>").alias("blocks"))

    def step(acc: Column, x: Column) -> Column:
        opens = (x.kind == "agent") & (acc["mode"] != 1)
        block = acc["block"] + opens.cast("int")
        mode = F.when(x.kind == "blank", 0).when(x.kind == "agent", 1).when(
            acc["mode"] != 0, 2).otherwise(0)
        return F.struct(block.alias("block"), mode.alias("mode"), F.concat(
            acc["blocks"], F.array(F.when(mode != 0, block))).alias("blocks"))

    return (
        texts.select("host", lines.alias("lines"))
        .select("host", F.explode(F.arrays_zip(
            "lines", F.aggregate("lines", start, step, lambda acc: acc["blocks"]).alias("block")))
            .alias("z"))
        .select("host", "z.block", "z.lines.kind", "z.lines.value", "z.lines.allow", "z.lines.ord")
        .filter("block is not null")
    )


def rules_for(rules: DataFrame, agent: str) -> DataFrame:
    """(host, ord, prefix, allow): the rules of each host that hold for a user agent.

    The first block with rules that names a part of the agent's name, else the first for ``*``.
    """
    name = agent.split("/")[0].lower()
    value = F.lower("value")
    blocks = rules.groupBy("host", "block").agg(
        F.bool_or((F.col("kind") == "agent") & F.contains(F.lit(name), value)).alias("named"),
        F.bool_or((F.col("kind") == "agent") & (value == "*")).alias("any"),
        F.bool_or(F.col("kind") != "agent").alias("ruled")).filter("ruled")
    chosen = blocks.groupBy("host").agg(F.coalesce(
        F.min(F.when(F.col("named") & ~F.col("any"), F.col("block"))),
        F.min(F.when(F.col("any"), F.col("block")))).alias("block"))
    return rules.filter("kind = 'rule'").join(chosen, ["host", "block"]).select(
        "host", "ord", _unquoted(F.col("value")).alias("prefix"), "allow")


def allowed(pages: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """Adds ``allowed``: of the rules that hold for the agent the first whose path the page's path
    begins with decides; none means yes.

    ``rules`` comes from ``robots_rules``. A path is cut to the lengths that rules of its host have,
    and these beginnings meet the rules by equality, so a host of many rules costs no comparison
    of each page with each of them.
    """
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    first = settle(rules_for(rules, agent).groupBy("host", "prefix").agg(
        F.min(F.struct("ord", "allow")).alias("rule")))
    lengths = first.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    placed = pages.select("page_id", X.host(F.col("url")).alias("host"),
                          _unquoted(F.when(path == "", "/").otherwise(path)).alias("path"))
    beginnings = (
        placed.join(broadcast_if_small(settle(lengths)), "host")
        .select("page_id", "host", "path", F.explode(F.filter(
            "lengths", lambda n: n <= F.length("path"))).alias("n"))
        .select("page_id", "host", F.expr("left(path, n)").alias("prefix"))
    )
    decided = beginnings.join(broadcast_if_small(first), ["host", "prefix"]).groupBy(
        "page_id").agg(F.min("rule").alias("rule"))
    return pages.join(decided, "page_id", "left").withColumn(
        "allowed", F.coalesce("rule.allow", F.lit(True))).drop("rule")


def unseen(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Targets that are not among the pages yet, each once with its first place."""
    known = pages.select(X.normalise_url(F.col("url")).alias("target"))
    first = links.groupBy("target").agg(F.min(F.struct("page_id", "pos")).alias("m"))
    return first.join(known, "target", "left_anti").select("target", "m.page_id", "m.pos")


def link_graph(pages: DataFrame, fetches: DataFrame | None = None, same_host: bool = True
               ) -> DataFrame:
    """(src, dst, link_pos): the followable links of pages to pages of the table, by their
    normalised URLs (of several pages with one URL the lowest id). With ``fetches`` only pages
    that were fetched successfully have links.
    """
    read = pages if fetches is None else pages.join(
        P.successful(fetches).select("page_id"), "page_id", "left_semi")
    known = pages.groupBy(X.normalise_url(F.col("url")).alias("target")).agg(
        F.min("page_id").alias("dst"))
    return followable(read, same_host).join(known, "target").select(
        F.col("page_id").alias("src"), "dst", F.col("pos").alias("link_pos"))


def _first_rows(ordered: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by rising ``id``, whose upper bits are the sort partition.

    Ranks follow from the partition sizes, so no task holds the ``n`` rows.
    """
    part = F.shiftright("id", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    rank = F.col("start") + F.col("id").bitwiseAND(F.lit(2**33 - 1))
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").filter(
        rank < n).select("page", "id")


def expand(start: DataFrame, edges: DataFrame, max_depth: int | None = None,
           max_pages: int | None = None) -> DataFrame:
    """(page, depth, ord): breadth-first from the seeds in discovery order, the order of a queue.

    ``start`` has ``page, ord``; ``edges`` has ``src, dst, link_pos``. One round per level, until
    a level is empty: targets are reduced to their earliest link before the shuffle, so a page
    linked from everywhere does not gather its links in one task. Every level is checkpointed. A
    page limit takes the prefix of the discovery order. ``ord`` sorts by depth, then place.
    """
    def in_order(df: DataFrame, depth: int, room: int | None) -> tuple[DataFrame, int]:
        # ids rise with the global sort order; the checkpoint fixes them
        ordered = settle(df.orderBy("key").select(
            "page", F.monotonically_increasing_id().alias("id")))
        found = ordered.count()
        if room is not None and found > room:
            ordered, found = settle(_first_rows(ordered, room)), room
        return ordered.select("page", F.lit(depth).alias("depth"),
                              F.struct(F.lit(depth).alias("depth"), "id").alias("ord")), found

    first = start.groupBy("page").agg(F.min(F.struct(F.col("ord"), F.lit(0))).alias("key"))
    frontier, found = in_order(first, 0, max_pages)
    seen, room, depth = frontier, max_pages, 0
    while found and (max_depth is None or depth < max_depth):
        room = None if room is None else room - found
        if room == 0:
            break
        depth += 1
        step = frontier.select(F.col("page").alias("src"), "ord")
        targets = (
            edges.join(broadcast_if_small(step), "src")
            .groupBy(F.col("dst").alias("page"))
            .agg(F.min(F.struct("ord", "link_pos")).alias("key"))
            .join(seen.select("page"), "page", "left_anti")
        )
        frontier, found = in_order(targets, depth, room)
        seen = seen.unionByName(frontier)
        if depth % LEVELS_TOGETHER == 0:
            seen = settle(seen)
    return seen


def _words(text):
    return F.array_distinct(F.filter(
        F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def relevant(links: DataFrame, request: str, limit: int = 20) -> DataFrame:
    """The best links of each host for a request, by shared words in URL and text.

    Request and links are cut into words alike, at everything but letters and digits.

    Only the best ``limit`` rows of a host leave a task, so a large host is cut down
    before the shuffle.
    """
    words = F.array(*[F.lit(w) for w in sorted(set(re.findall(r"[^\W_]+", request.lower())))])
    score = F.size(F.array_intersect(words, _words(F.concat_ws(" ", "text", "target"))))
    w = W.partitionBy("host").orderBy(F.desc("score"), "page_id", "pos")
    return (
        links.withColumn("host", X.host(F.col("target"))).withColumn("score", score)
        .filter("score > 0").withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= limit)
    )
