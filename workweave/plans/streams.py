"""Streaming queries: each reads the events table as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.plans.registry import query
from workweave.sources.fixtures import Plan
from workweave.streaming import feeds as S
from workweave.streaming import stateful as X
from workweave.streaming.runner import event_stream, rocksdb_state, to_table

# Rules scaled to the pace of the events table
THROTTLE = X.Throttle(limit=3, window=172_800, block=86_400)
DAY_CACHE = X.ExpiringCache(hours=168)
GAP, DELAY = "45 minutes", "10 minutes"


def _events(p: Plan) -> DataFrame:
    return event_stream(p.spark, p.sf_dir)


def _timed(events: DataFrame) -> DataFrame:
    """Events as attempts; time as exact microseconds in seconds."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.filter(F.col("event_type").isin("error", "signup")).select(
        "user_id", F.col("event_id").alias("seq"), at.alias("at"),
        (F.col("event_type") == "signup").alias("success"))


def _asked(events: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return events.select("user_id", "event_type", F.col("event_id").alias("seq"), at.alias("at"),
                         F.lit(True).alias("success"))


@query("s1_revision_feed")
def _(p: Plan) -> DataFrame:
    first = p.table("events").groupBy("user_id").agg(
        F.min_by("props", "event_id").alias("props"),
        F.min_by("event_type", "event_id").alias("kind"))
    edited = F.when(F.col("kind") == "view", "local").otherwise(F.col("props"))
    mine = first.filter("kind <> 'error'").withColumn("props", edited).drop("kind")
    first = first.drop("kind")
    feed = _events(p).select("user_id", "props", "event_id")
    return S.follow_revisions(feed, first, mine, ["user_id"], "event_id", "revision-feed")


def _stamps(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("s2_bursts")
def _(p: Plan) -> DataFrame:
    e = p.table("events").select("user_id", F.col("ts").cast("timestamp").alias("ts"),
                                 F.col("event_id").alias("seq"), "props")
    return _stamps(S.bursts(e, "user_id", "props", GAP))


@query("s2_closed_bursts")
def _(p: Plan) -> DataFrame:
    # bursts that the watermark has not passed at the end of the stream are still open, not lost
    e = _events(p).select("user_id", "ts", F.col("event_id").alias("seq"), "props")
    return _stamps(S.closed_bursts(e, "user_id", "props", GAP, DELAY, "bursts"))


@query("s3_latest_task_state")
def _(p: Plan) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("PENDING", "DISPATCHED", "PASS", "FIX", "ESCALATED")])
    e = _events(p).select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("task_id"),
        F.col("event_id").alias("seq"),
        F.element_at(states, (F.col("event_id") % 5 + 1).cast("int")).alias("state"))
    return S.latest_state(e, ["run_id", "task_id"], "seq", "state", "task-state")


@query("s4_throttle")
def _(p: Plan) -> DataFrame:
    return X.replay(_timed(p.table("events")), ["user_id"], THROTTLE)


@query("s4_throttle_stream")
def _(p: Plan) -> DataFrame:
    with rocksdb_state(p.spark):
        return to_table(X.follow(_timed(_events(p)), ["user_id"], THROTTLE), "throttle")


@query("s5_expiring_cache")
def _(p: Plan) -> DataFrame:
    return X.replay(_asked(p.table("events")), ["user_id", "event_type"], DAY_CACHE)


@query("s5_expiring_cache_stream")
def _(p: Plan) -> DataFrame:
    with rocksdb_state(p.spark):
        return to_table(X.follow(_asked(_events(p)), ["user_id", "event_type"], DAY_CACHE), "cache")


@query("s5_first_asked")
def _(p: Plan) -> DataFrame:
    e = _events(p).select("user_id", "event_type", "ts")
    found = S.first_asked(e, ["user_id", "event_type"], "168 hours", "first-asked")
    return found.groupBy("user_id", "event_type").agg(F.count("*").alias("misses"))


@query("s6_running_usage")
def _(p: Plan) -> DataFrame:
    e = _events(p).select("user_id", "value")
    totals = S.running_totals(e, "user_id", {"spent": F.sum("value"), "calls": F.count("*")},
                              "usage", alert=F.col("calls") >= 60)
    return totals.withColumn("spent", F.round("spent", 4))


@query("s7_progress")
def _(p: Plan) -> DataFrame:
    return S.running_totals(_events(p), "user_id", {
        "done": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")}, "progress")


@query("s8_offline_queue")
def _(p: Plan) -> DataFrame:
    e = _events(p).select("user_id", "event_type", "event_id", "props")
    return S.offline_queue(e, ["user_id", "event_type"], "event_id", "offline-queue")
