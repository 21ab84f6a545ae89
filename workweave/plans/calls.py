"""Queries on call ledgers, budgets, the response cache and model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.operators import usage as U
from workweave.plans.registry import query
from workweave.sources import reference as R
from workweave.sources.fixtures import Plan


def _ledger(p: Plan) -> DataFrame:
    return U.priced(p.call)


@query("a9_tier_prices")
def _(p: Plan) -> DataFrame:
    used = _ledger(p).groupBy("tier").agg(
        F.count("*").alias("calls"), F.round(F.sum("cost"), 6).alias("cost"))
    return R.tier_prices(p.spark).join(used, "tier", "left").fillna(0)


@query("e13_priced_calls")
def _(p: Plan) -> DataFrame:
    odd = p.call.withColumn("tier", F.when(F.col("seq") > 2, "unknown").otherwise(F.col("tier")))
    return U.priced(odd).select("run_id", "seq", "tier", F.round("cost", 9).alias("cost"))


@query("f13_usage_totals")
def _(p: Plan) -> DataFrame:
    return U.totals(_ledger(p), ["run_id"]).withColumn("cost", F.round("cost", 9))


@query("f16_avoided_calls")
def _(p: Plan) -> DataFrame:
    hit = F.col("input_tokens") % 5 == 0
    runs = _ledger(p).groupBy("run_id").agg(
        F.count_if(~hit).alias("calls"),
        F.coalesce(F.sum(F.when(~hit, F.col("cost"))), F.lit(0.0)).alias("cost"),
        F.count("*").alias("pages"),
        F.count_if(~hit & (F.col("tier") == "worker")).alias("learn_attempts"),
        F.count_if(hit).alias("cache_hits"))
    return U.avoided(runs).select("run_id", "calls", "saved",
                                  F.round("without_reuse", 10).alias("without_reuse"))


@query("f17_budget_left")
def _(p: Plan) -> DataFrame:
    left = U.budget_left(U.totals(_ledger(p), ["run_id"]), max_usd=0.01, max_calls=6)
    return left.select("run_id", "calls_left", "level", F.round("usd_left", 9).alias("usd_left"))


@query("g7_admitted_calls")
def _(p: Plan) -> DataFrame:
    return U.admitted(_ledger(p), max_usd=0.002, max_calls=5).select("run_id", "seq", "allowed")


@query("j5_token_estimate")
def _(p: Plan) -> DataFrame:
    return p.call.select("run_id", "seq", U.estimated_tokens(F.col("text")).alias("tokens"))


def _questions(p: Plan) -> DataFrame:
    """Calls as cache questions: one per turn, one minute apart, a run every hour."""
    prompt = F.concat_ws("/", "tier", F.floor(F.length("text") / 40).cast("string"))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, run_id, seq, 0)")
    return p.call.select("run_id", "seq", at.alias("asked_at"),
                         U.cache_key(F.col("tier"), F.lit("extract"), prompt).alias("key"), "text")


@query("e12_cache_lookup")
def _(p: Plan) -> DataFrame:
    q = _questions(p)
    stored = q.filter(F.col("seq") == 1).select(
        "key", F.col("asked_at").alias("created_at"), F.col("text").alias("response"))
    return U.cache_lookup(q.select("key", "asked_at", "run_id", "seq"), stored).select(
        "run_id", "seq", "key", "hit", F.coalesce("response", F.lit("")).alias("response"))


@query("f15_cache_size")
def _(p: Plan) -> DataFrame:
    latest = _questions(p).groupBy("key").agg(
        F.max(F.struct("asked_at", "run_id", "seq", "text")).alias("m"))
    return U.cache_size(latest.select(F.col("m.text").alias("response")))


@query("j8_usable_answers")
def _(p: Plan) -> DataFrame:
    kind = (F.col("run_id") + F.col("seq")) % 6
    obj = F.format_string('{"run": %d, "turn": %d}', "run_id", "seq")
    answer = (
        F.when(kind == 0, obj)
        .when(kind == 1, F.concat(F.col("text"), F.lit("\n```json\n"), obj, F.lit("\n```\n")))
        .when(kind == 2, F.concat(F.lit("Ergebnis: "), obj, F.lit(" "), F.col("text")))
        .when(kind == 3, F.concat(F.col("text"), F.lit(" [1, 2, "), F.col("seq").cast("string"),
                                  F.lit("] Ende")))
        .when(kind == 4, F.concat(F.lit('{"open": [1, 2 '), F.col("text")))
        .otherwise(F.col("text"))
    )
    return U.usable_share(p.call.select("tier", answer.alias("answer"))).withColumn(
        "usable", F.round("usable", 9))
