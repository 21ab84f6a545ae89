"""Day calendar, holidays, week buckets and bridge days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workweave.functions import dates as D
from workweave.sources.reference import DEFAULT_REGION, holiday_rules

# What makes a bridge worth listing
BRIDGE_MAX_COST = 4
BRIDGE_MIN_RATIO = 2.2


def years_spanned(*intervals: DataFrame) -> DataFrame:
    """Every year between the first start and the last end of all tables, as column ``year``."""
    ends = [df.agg(F.min(F.year("start")).alias("lo"), F.max(F.year("end")).alias("hi"))
            for df in intervals]
    span = reduce(DataFrame.unionByName, ends).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("year"))


def _with_holidays(years: DataFrame, regions: list[str]) -> DataFrame:
    """(region, year, found): the year's holidays as structs (day, name) in rule order."""
    year = F.col("year")

    def day(rule: Column) -> Column:
        return (
            F.when(rule.kind == "fixed", F.make_date(year, rule.a, rule.b))
            .when(rule.kind == "easter", F.date_add(F.col("easter"), rule.a))
            .otherwise(F.col("penance"))
        )

    per_region = years.select(
        "year", F.explode(F.array(*map(F.lit, regions))).alias("region"),
        D.easter_sunday(year).alias("easter"), D.wednesday_before_nov_23(year).alias("penance"))
    valid = F.filter(holiday_rules(), lambda r: F.array_contains(r.regions, F.col("region")) & (
        (r.only_year == 0) | (r.only_year == year)))
    return per_region.select("region", "year", F.transform(valid, lambda r: F.struct(
        day(r).alias("day"), r["name"].alias("name"))).alias("found"))


def holidays(years: DataFrame, regions: list[str]) -> DataFrame:
    """(region, year, day, holiday_name); the later rule names a shared day."""
    named = F.filter("found", lambda h, i: ~F.exists(
        F.slice("found", i + 2, F.size("found")), lambda later: later.day == h.day))
    return _with_holidays(years, regions).select(
        "region", "year", F.explode(named).alias("h")
    ).select("region", "year", "h.day", F.col("h.name").alias("holiday_name"))


def calendar(years: DataFrame, regions: list[str] | None = None) -> DataFrame:
    """One row per region and day. Rows are bounded by years x regions x 366.

    Holidays travel with their year as a short list, so nothing is shuffled.
    """
    year, day = F.col("year"), F.col("day")
    days = _with_holidays(years, regions or [DEFAULT_REGION]).select(
        "region", "year", "found",
        F.explode(F.sequence(D.year_start(year), D.year_end(year))).alias("day"))
    on_day = F.try_element_at(F.filter("found", lambda h: h.day == day), F.lit(-1))
    weekend = F.weekday(day) >= 5
    return days.withColumn("holiday_name", on_day["name"]).select(
        "region", "year", "day",
        (F.dayofyear(day) - 1).alias("i"),
        (F.dayofweek(day) - 1).alias("dow"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("dom"),
        F.weekofyear(day).alias("iso_week"),
        weekend.alias("weekend"),
        "holiday_name",
        (~weekend & F.col("holiday_name").isNull()).alias("workday"),
    )


def year_index(cal: DataFrame) -> DataFrame:
    """One row per year: arrays over the day of the year for constant-time lookups.

    ``workday[i]`` is the flag of day ``i`` and ``worked[i]`` the number of workdays
    before it, so the workdays of a clipped interval are one subtraction. At most one
    row per calendar year, each of 366 entries, hence always safe to broadcast.
    """
    per_year = cal.groupBy("year").agg(
        F.array_sort(F.collect_list(F.struct("i", "workday"))).alias("d")
    )
    flags = F.transform("d", lambda x: x.workday)
    ones = F.transform("d", lambda x: x.workday.cast("int"))
    running = F.aggregate(
        ones,
        F.array(F.lit(0)),
        lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)),
    )
    return per_year.select("year", flags.alias("workday"), running.alias("worked"))


def week_buckets(cal: DataFrame) -> DataFrame:
    """Adds ``bucket``: the open week bucket of each day.

    A bucket opens when an ISO week number is first seen in the calendar year, so late
    December days numbered week 1 stay in the bucket open at that moment.
    """
    week = W.partitionBy("region", "year", "iso_week").orderBy("day")
    run = W.partitionBy("region", "year").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    first = (F.row_number().over(week) == 1).cast("int")
    flagged = cal.withColumn("opens", first)
    bucketed = flagged.withColumn("bucket", F.sum("opens").over(run).cast("int"))
    named = W.partitionBy("region", "year", "bucket")
    return bucketed.withColumn("bucket_week", F.first("iso_week").over(
        named.orderBy("day"))).drop("opens")


def bridges(cal: DataFrame) -> DataFrame:
    """Short runs of workdays enclosed by free days next to a holiday."""
    year = W.partitionBy("region", "year").orderBy("i")
    running = year.rowsBetween(W.unboundedPreceding, 0)
    changed = F.coalesce(F.lag("workday").over(year) != F.col("workday"), F.lit(True))
    runs = (
        cal.withColumn("changed", changed.cast("int"))
        .withColumn("run", F.sum("changed").over(running))
        .groupBy("region", "year", "run", "workday")
        .agg(
            F.min("day").alias("first"), F.max("day").alias("last"),
            F.count("*").alias("len"),
            F.min_by("holiday_name", F.when(F.col("holiday_name").isNotNull(), F.col("i")))
            .alias("first_holiday"),
            F.max_by("holiday_name", F.when(F.col("holiday_name").isNotNull(), F.col("i")))
            .alias("last_holiday"),
        )
    )
    by_run = W.partitionBy("region", "year").orderBy("run")
    framed = runs.select(
        "*",
        F.lag("len").over(by_run).alias("before"),
        F.lead("len").over(by_run).alias("after"),
        F.coalesce(F.lag("last_holiday").over(by_run), F.lead("first_holiday").over(by_run))
        .alias("cause"),
        F.lag("first").over(by_run).alias("free_from"),
        F.lead("last").over(by_run).alias("free_to"),
    )
    free = F.col("before") + F.col("len") + F.col("after")
    return (
        framed.filter("workday and before is not null and after is not null "
                      "and cause is not null")
        .filter(F.col("len") <= BRIDGE_MAX_COST)
        .select(
            "region", "year", F.col("first").alias("from"), F.col("last").alias("to"),
            F.col("len").alias("cost"), free.alias("free"),
            (free / F.col("len")).alias("ratio"), "cause", "free_from", "free_to",
        )
        .filter(F.col("ratio") >= BRIDGE_MIN_RATIO)
    )


def best_bridges(found: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` best bridges of each region and year: ratio, then date."""
    order = W.partitionBy("region", "year").orderBy(F.desc("ratio"), "from")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def holiday_list(cal: DataFrame) -> DataFrame:
    return cal.filter(F.col("holiday_name").isNotNull()).select(
        "region", "year", "day", "dow", "holiday_name", "weekend"
    )
