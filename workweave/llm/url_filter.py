"""URL filters: pattern rules indexed by their rarest literal token.

Domain rules come first: one fits its host and all subdomains if the path starts with the rule's
path, and the longest that fits decides. Where none fits, pattern rules decide: each has a regular
expression over the lower-cased url and literal tokens (runs of ASCII letters and digits) that any
match must hold as whole tokens of the url. A rule is indexed by that of its tokens which the fewest urls hold, the
tokens of an url fetch the rules indexed by them, and only these run their expression. One match
blocks; an url with none, or without a host, is allowed. The least name of the rules that match is
told.

Everything is DataFrame functions. Urls that are null or hold no ``://`` have an empty host and
path; rows that repeat are each judged; other columns are ignored. An index of rules is joined by
its tokens, so Spark may send it to all tasks or shuffle it, as its size asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.llm.tables import save


@dataclass(frozen=True)
class DomainRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    name: str
    tokens: tuple[str, ...]
    pattern: str


DOMAIN_RULES = (
    DomainRule("net", "/", "block"),
    DomainRule("example.net", "/en/", "allow"),
    DomainRule("example.com", "/de/", "block"),
    DomainRule("org", "/fr/", "allow"),
)

#: Pages that hold no prose: sessions, shops, feeds, files, trackers.
PATTERN_RULES = (
    PatternRule("login", ("login",), r"://[^?#]*/login([/?#.]|$)"),
    PatternRule("signup", ("signup",), r"://[^?#]*/signup([/?#.]|$)"),
    PatternRule("cart", ("cart",), r"://[^?#]*/cart([/?#.]|$)"),
    PatternRule("checkout", ("checkout",), r"://[^?#]*/checkout([/?#.]|$)"),
    PatternRule("search results", ("search", "q"), r"/search/?\?([^#]*&)?q="),
    PatternRule("paged listing with referrer", ("page", "ref"), r"\?([^#]*&)?page=\d+&([^#]*&)?ref="),
    PatternRule("session in query", ("sid",), r"\?([^#]*&)?sid=[0-9a-f]{8,}"),
    PatternRule("feed", ("feed",), r"://[^?#]*/feed/?([?#]|$)"),
    PatternRule("tag page", ("tag",), r"://[^/?#]+/tag/"),
    PatternRule("calendar day", ("calendar",), r"/calendar/\d{4}/\d{1,2}"),
    PatternRule("print view", ("print",), r"\?([^#]*&)?print=(1|true|yes)"),
    PatternRule("advert host", ("ads",), r"://ads\.[^/?#]+"),
    PatternRule("tracker", ("track",), r"://track\.[^/?#]+"),
    PatternRule("adult host", ("xxx",), r"://([^/?#]*\.)?xxx[./:-]"),
    PatternRule("casino host", ("casino",), r"://([^/?#]*[.-])?casino[./:-]"),
    PatternRule("mobile duplicate of a fragment", ("m", "top"), r"://m\.[^#]*#top$"),
)


def fold(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://``, up to ``/ ? #``; and from there up to ``? #``."""
    has = F.locate("://", F.coalesce(url, F.lit(""))) > 0
    rest = F.expr("substring(url, locate('://', url) + 3)")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, fold(host)).otherwise(""), F.when(has, path).otherwise("")


def _fits(rule: DomainRule) -> Column:
    host = (F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)
    return host & F.col("path").startswith(rule.path)


def tokens(url: Column) -> Column:
    """The distinct tokens of an url."""
    return F.array_distinct(F.regexp_extract_all(fold(F.coalesce(url, F.lit(""))),
                                                 F.lit("([a-z0-9]+)"), F.lit(1)))


def index(pages: DataFrame, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``token, name, pattern``: every rule by the token of its own that the fewest urls hold."""
    literal = [F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"),
                        F.lit(t).alias("token")) for r in rules for t in r.tokens]
    needed = (pages.sparkSession.range(1)
              .select(F.explode(F.array(*literal)).alias("rule")).select("rule.*"))
    asked = F.array(*[F.lit(t) for t in sorted({t for r in rules for t in r.tokens})])
    counts = (pages.select(F.explode(F.array_intersect(tokens(F.col("url")), asked)).alias("token"))
              .groupBy("token").agg(F.count("*").alias("n")))
    # min_by over the few literal rows: a token no url holds is the rarest of all
    return (needed.join(counts, "token", "left")
            .groupBy("name", "pattern").agg(F.min(F.struct(
                F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("best"))
            .select("best.token", "name", "pattern"))


def judge(pages: DataFrame, domain: tuple[DomainRule, ...] = DOMAIN_RULES,
          rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern_rule`` of every ``pages(page_id, url)``."""
    plain = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    named = plain.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule = verdict = None
    for r in sorted(domain, key=lambda r: len(r.name)):  # a longer one is asked before
        rule = F.when(_fits(r), F.lit(r.name)).otherwise(F.lit(None) if rule is None else rule)
        verdict = F.when(_fits(r), F.lit(r.verdict)).otherwise(
            F.lit(None) if verdict is None else verdict)
    fetched = (plain.select("url", F.explode(tokens(F.col("url"))).alias("token"))
               .join(index(plain, rules), "token"))
    matched = (fetched.where(F.regexp_like(fold(F.col("url")), F.col("pattern")))
               .groupBy("url").agg(F.min("name").alias("pattern_rule")))
    judged = (named.withColumn("rule", rule).withColumn("base", verdict)
              .join(save(matched, "matched"), "url", "left"))
    own = F.when((F.col("host") != "") & F.col("pattern_rule").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("base", own).alias("verdict"), "pattern_rule")
