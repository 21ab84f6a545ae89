"""The append-only revision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.operators import sequences as S

# Kept revisions, kept daily backups, listed revisions
KEPT_REVISIONS = 300
KEPT_BACKUPS = 60
LISTED_REVISIONS = 60


def listing(log: DataFrame) -> DataFrame:
    return log.select("rev", "created_at", "client", F.length("data").alias("bytes"))


def newest(df: DataFrame, order: str, n: int) -> DataFrame:
    """The newest ``n`` rows, found by a distributed top-k."""
    return df.orderBy(F.desc(order)).limit(n)


def retained(log: DataFrame, keep: int = KEPT_REVISIONS) -> DataFrame:
    """The revisions that survive retention, by one scalar maximum."""
    top = log.agg(F.max("rev")).scalar()
    return log.filter(F.col("rev") > top - keep)


def stale_writes(log: DataFrame) -> DataFrame:
    """Revisions written on another base than the one accepted before them."""
    before = S.previous(log, [], "rev", S.block_of("rev"), ["client"])
    return before.filter(F.col("prev.rev") != F.col("base_rev")).select(
        "rev", "base_rev", F.col("prev.rev").alias("accepted_rev"), "client")


def deltas(log: DataFrame) -> DataFrame:
    """Change of size and of author between neighbouring revisions."""
    sized = log.select("rev", "client", F.length("data").alias("bytes"))
    before = S.previous(sized, [], "rev", S.block_of("rev"), ["client", "bytes"])
    return before.select(
        "rev", "client", "bytes",
        F.coalesce(F.col("bytes") - F.col("prev.bytes"), F.lit(0)).alias("grown"),
        F.coalesce(F.col("client") != F.col("prev.client"), F.lit(False)).alias("other_client"))


def daily_backups(log: DataFrame, keep: int = KEPT_BACKUPS) -> DataFrame:
    """The first revision of each day, newest ``keep`` days."""
    day = F.to_date("created_at").alias("day")
    first = log.groupBy(day).agg(F.min_by(F.struct("rev", "data"), "created_at").alias("m"))
    return first.orderBy(F.desc("day")).limit(keep).select("day", "m.rev", "m.data")


def restore(log: DataFrame, rev: int, stamp: str) -> DataFrame:
    """Append an old revision as the newest one."""
    top = log.agg(F.max("rev")).scalar()
    again = log.filter(F.col("rev") == rev).select(
        (top + 1).alias("rev"), top.alias("base_rev"), F.lit(stamp).cast(log.schema["created_at"].dataType)
        .alias("created_at"),
        F.lit(None).cast(log.schema["client"].dataType).alias("client"), "data",
        F.lit(f"wiederhergestellt aus {rev}").alias("note"))
    return log.withColumn("note", F.lit("")).unionByName(again)


def latest(events: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The newest version per key; combined before the shuffle, so hot keys do not matter."""
    return events.groupBy(*keys).agg(
        F.max(F.struct(order, *columns)).alias("m")).select(*keys, "m.*")


def attempts(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``attempt`` (from 1) and ``retries`` per key."""
    counted = S.running_sums(events, keys, [order], S.block_of(order), {"attempt": F.lit(1)})
    return counted.withColumn("retries", F.col("attempt") - 1)


def age_buckets(jobs: DataFrame, at: str, now: str) -> DataFrame:
    """Jobs per age: just now, minutes, hours, days, older."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(
        F.col(at).cast("timestamp"))
    bucket = (
        F.when(age < 60, "just now").when(age < 3600, "minutes").when(age < 86_400, "hours")
        .when(age < 604_800, "days").otherwise("older")
    )
    return jobs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("jobs"))
