"""Call ledgers: prices, totals, budgets, cache lookups, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.operators import sequences as S
from workweave.sources import reference as R


# Token prices have two decimals per million tokens, so nine decimals are exact
MONEY, SUM = "decimal(18,9)", "decimal(28,9)"


def estimated_tokens(text: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def priced(calls: DataFrame) -> DataFrame:
    """Adds ``cost``; unknown tiers are charged like the worker."""
    prices = F.broadcast(R.tier_prices(calls.sparkSession))
    _, usd_in, usd_out = next(p for p in R.TIER_PRICES if p[0] == R.FALLBACK_TIER)
    cost = (
        F.col("input_tokens") / 1e6 * F.coalesce("usd_in", F.lit(usd_in))
        + F.col("output_tokens") / 1e6 * F.coalesce("usd_out", F.lit(usd_out))
    )
    return calls.join(prices, "tier", "left").withColumn("cost", cost).drop("usd_in", "usd_out")


def totals(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Usage per key: tokens, calls and cost, combined before the shuffle. Money is added as
    decimals, so a total does not depend on how the sum was split up."""
    return calls.groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.count("*").alias("calls"), F.sum(F.col("cost").cast(MONEY)).cast("double").alias("cost"))


def admitted(calls: DataFrame, max_usd: float = R.MAX_RUN_USD,
             max_calls: int = R.MAX_RUN_CALLS) -> DataFrame:
    """Adds ``allowed``: whether the budget lets a call of a run start.

    The check looks at what was spent before, so the call that crosses the money limit
    still runs. Limits of 0 mean unlimited. A refused call stays refused and adds nothing,
    hence sums over all earlier calls decide exactly. Money is added as decimals, so the
    verdict at the very limit does not depend on how the sum was split up.
    """
    before = S.running_sums(
        calls, ["run_id"], ["seq"], S.block_of("seq"),
        {"spent": F.col("cost").cast(MONEY), "made": F.lit(1)}, current=False)
    money = (F.lit(max_usd) == 0) | (F.col("spent") < F.lit(max_usd).cast(MONEY))
    number = (F.lit(max_calls) == 0) | (F.col("made") < max_calls)
    return before.withColumn("allowed", money & number)


def budget_left(usage: DataFrame, max_usd: float = R.MAX_RUN_USD,
                max_calls: int = R.MAX_RUN_CALLS) -> DataFrame:
    """Remaining money and calls of each run with a warning level: ok while more than half of the
    money is left, warn while more than 15 % is. Shares are taken of decimals, so exactly half is
    not more than half."""
    money = F.lit(max_usd).cast(SUM)
    left = F.greatest(F.lit(0).cast(SUM), money - F.col("cost").cast(SUM))

    def more_than(percent: int) -> Column:
        return (left * 100 > money * percent) & F.lit(max_usd > 0)

    return usage.select(
        "*", left.cast("double").alias("usd_left"),
        F.greatest(F.lit(0), F.lit(max_calls) - F.col("calls")).alias("calls_left"),
        F.when(more_than(50), "ok").when(more_than(15), "warn").otherwise("error").alias("level"))


def avoided(runs: DataFrame) -> DataFrame:
    """Avoided calls and what the run would have cost without reuse.

    Needs per run ``calls, cost, pages, learn_attempts, cache_hits``.
    """
    _, usd_in, usd_out = next(p for p in R.TIER_PRICES if p[0] == R.FALLBACK_TIER)
    tokens_in, tokens_out = R.UNTRIED_CALL_TOKENS
    untried = tokens_in / 1e6 * usd_in + tokens_out / 1e6 * usd_out
    saved = (
        F.col("learn_attempts") * F.greatest(F.lit(0), F.col("pages") - 1) + F.col("cache_hits")
    )
    per_call = F.when(F.col("calls") > 0, F.col("cost") / F.col("calls")).otherwise(untried)
    return runs.withColumn("saved", saved).withColumn(
        "without_reuse", per_call * (F.col("calls") + F.col("saved")))


# -- cache ------------------------------------------------------------------------
def cache_key(model: Column, system: Column, prompt: Column) -> Column:
    """SHA-256 over the three parts with zero bytes between."""
    return F.sha2(F.concat_ws("\u0000", model, system, prompt), 256)


def cache_lookup(asked: DataFrame, stored: DataFrame, hours: int = R.CACHE_HOURS,
                 block_hours: int = 24) -> DataFrame:
    """Newest cache entry of each question's key that is still alive (left as-of).

    ``asked`` has ``key, asked_at``; ``stored`` has ``key, created_at, response``. Both
    are laid on one time line per key and the newest earlier entry is a running maximum,
    so a key asked very often is scanned in blocks of time instead of being joined.
    """
    extra = [c for c in asked.columns if c not in ("key", "asked_at")]
    question = F.struct(*extra) if extra else F.lit(None)
    line = asked.select(
        "key", F.col("asked_at").alias("at"), F.lit(1).alias("is_question"),
        question.alias("question"),
        F.lit(None).cast("struct<created_at:timestamp_ntz,response:string>").alias("entry"),
    ).unionByName(stored.select(
        "key", F.col("created_at").alias("at"), F.lit(0).alias("is_question"),
        F.lit(None).cast(line_type(asked, extra)).alias("question"),
        F.struct("created_at", "response").alias("entry")))
    block = F.floor(F.unix_timestamp(F.col("at").cast("timestamp")) / (block_hours * 3600))
    seen = S.running_max(line, ["key"], ["at", "is_question"], block,
                         {"newest": F.col("entry")})
    alive = F.col("newest.created_at") > F.col("asked_at") - F.expr(f"INTERVAL '{hours}' HOUR")
    return (
        seen.filter("is_question = 1")
        .select("key", F.col("at").alias("asked_at"), "question.*", "newest")
        .withColumn("hit", F.coalesce(alive, F.lit(False)))
        .withColumn("response", F.when(F.col("hit"), F.col("newest.response")))
        .drop("newest")
    )


def line_type(asked: DataFrame, extra: list[str]) -> str:
    return asked.select(*extra).schema.simpleString() if extra else "void"


def cache_size(stored: DataFrame) -> DataFrame:
    return stored.agg(
        F.count("*").alias("entries"),
        F.coalesce(F.sum(F.length("response")), F.lit(0)).alias("characters"))


# -- answers ----------------------------------------------------------------------
def usable_json(text: Column) -> Column:
    """Whether an answer holds JSON: a fenced block, else the outermost brackets."""
    space = r"^[\s]+|[\s]+$"
    trimmed = F.regexp_replace(text, space, "")
    fenced = F.regexp_extract(trimmed, r"(?s)```(?:json)?[\s]*(.+?)```", 1)
    body = F.when(fenced != "", F.regexp_replace(fenced, space, "")).otherwise(trimmed)
    listed = F.regexp_extract(body, r"(?s)(\[.*\])", 1)
    braced = F.regexp_extract(body, r"(?s)(\{.*\})", 1)

    def valid(c: Column) -> Column:
        parsed = F.try_parse_json(F.when(c != "", c))
        return parsed.isNotNull() & ~F.is_variant_null(parsed)

    return F.coalesce(valid(body) | valid(listed) | valid(braced), F.lit(False))


def usable_share(answers: DataFrame, key: str = "tier") -> DataFrame:
    return answers.groupBy(key).agg(
        F.count("*").alias("answers"), F.avg(usable_json(F.col("answer")).cast("double"))
        .alias("usable"))
