"""Working days of entries and allowance accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.functions import dates as D
from workweave.operators import calendar as C
from workweave.operators import occupancy as O
from workweave.session import broadcast_if_small
from workweave.sources.reference import APPROVED, PENDING, REJECTED, counting_types, quota_types


def entry_workdays(absence: DataFrame, cal: DataFrame, every: bool = False) -> DataFrame:
    """Adds ``year`` and ``workdays``: one row per entry and calendar year it touches.

    The interval is clipped to the year. Half-day flags refer to the clipped first and last
    day and only take effect on workdays; a single day with both flags stays whole.
    Two array lookups per row replace the expansion into days. Parts in years that the calendar
    lacks are left out, or with ``every`` an error.
    """
    index = F.broadcast(C.year_index(cal))
    parts = O._by_year(absence).join(index, "year", "left" if every else "inner")
    s, e = F.col("s"), F.col("e")
    worked = F.coalesce("worked", F.raise_error(F.concat(
        F.lit("the calendar lacks the year "), F.col("year").cast("string")))
    ) if every else F.col("worked")
    n = F.get(worked, e + 1) - F.get(worked, s)
    half = F.lit(0.5)
    none = F.lit(0.0)
    less_start = F.when(F.col("half_start") & F.get("workday", s), half).otherwise(none)
    less_end = F.when(F.col("half_end") & (e != s) & F.get("workday", e), half).otherwise(none)
    both = F.when(F.col("half_start") & F.col("half_end") & (e == s), half).otherwise(none)
    value = F.when(n == 0, none).otherwise(
        F.greatest(none, n.cast("double") - less_start - less_end + both))
    return parts.withColumn("workdays", value).drop("s", "e", "worked", "workday")


def entry_workdays_by_days(absence: DataFrame, cal: DataFrame) -> DataFrame:
    """(absence_id, year, workdays) by expanding every entry to its days."""
    parts = O._by_year(absence).select(
        "absence_id", "year", "half_start", "half_end",
        F.greatest("start", D.year_start(F.col("year"))).alias("start"),
        F.least("end", D.year_end(F.col("year"))).alias("end"))
    day, worked = F.col("day"), F.count("*").cast("double")
    flags = ["half_start", "half_end"]
    counted = (
        O.days_of(parts).join(O.workdays(cal).select("day"), "day")
        .groupBy("absence_id", "year", "start", "end", *flags)
        .agg(worked.alias("n"), F.bool_or(day == F.col("start")).alias("first"),
             F.bool_or(day == F.col("end")).alias("last"))
    )
    single = F.col("start") == F.col("end")
    cut = (
        (F.col("half_start") & F.col("first")).cast("int")
        + (F.col("half_end") & ~single & F.col("last")).cast("int")
        - (F.col("half_start") & F.col("half_end") & single).cast("int")
    )
    return counted.select("absence_id", "year",
                          F.greatest(F.lit(0.0), F.col("n") - cut * 0.5).alias("workdays"))


def _per_year(df: DataFrame, years: DataFrame) -> DataFrame:
    """Repeat every row for each calendar year, without a join."""
    lo = years.agg(F.min("year")).scalar()
    hi = years.agg(F.max("year")).scalar()
    return df.withColumn("year", F.explode(F.sequence(lo, hi)))


def accounts(person: DataFrame, absence: DataFrame, cal: DataFrame,
             years: DataFrame) -> DataFrame:
    """Allowance account of every person and year; all people are listed."""
    spent = entry_workdays(
        absence.filter(F.col("status") != REJECTED)
        .select("person_id", "type", "status", "start", "end", "half_start", "half_end"), cal)
    quota = F.col("type").isin(*quota_types())
    counts = F.col("type").isin(*counting_types())
    approved = F.col("status") == APPROVED
    days = F.col("workdays")
    sums = spent.groupBy("person_id", "year").agg(
        F.sum(F.when(quota & approved, days)).alias("approved"),
        F.sum(F.when(quota & ~approved, days)).alias("pending"),
        F.sum(F.when(~quota & counts, days)).alias("other"),
    )
    total = F.col("entitlement") + F.col("carryover")
    return (
        _per_year(person, years).join(sums, ["person_id", "year"], "left")
        .fillna(0.0, ["approved", "pending", "other"])
        .withColumn("total", total)
        .withColumn("planned", F.col("approved") + F.col("pending"))
        .withColumn("remaining", D.half_day_round(F.col("total") - F.col("planned")))
    )


def account_figures(account: DataFrame, absence: DataFrame, tree: DataFrame) -> DataFrame:
    """Per year: people, planned and remaining days, open requests, oddities."""
    rest = F.col("remaining")
    figures = account.groupBy("year").agg(
        F.count("*").alias("people"),
        D.half_day_round(F.sum("planned")).alias("planned"),
        D.half_day_round(F.sum("remaining")).alias("remaining"),
        F.count_if(rest < 0).alias("overdrawn"),
        F.count_if(F.col("planned") == 0).alias("unplanned"),
    )
    open_ = (
        O._by_year(absence.filter(F.col("status") == PENDING).select("start", "end"))
        .groupBy("year").agg(F.count("*").alias("open_requests"))
    )
    departments = tree.agg(F.count("*")).scalar()
    return figures.join(F.broadcast(open_), "year", "left").fillna(0).withColumn(
        "departments", departments)


def month_distribution(absence: DataFrame, cal: DataFrame) -> DataFrame:
    """(year, month, days): whole workdays of allowance types, all twelve months."""
    per_day = O._steps(O._by_year(O.uses_allowance(absence).select("start", "end")), [])
    days = cal.select("year", "month", "i", "workday")
    return (
        days.join(per_day, ["year", "i"], "left")
        .groupBy("year", "month")
        .agg(F.coalesce(F.sum(F.when(F.col("workday"), F.col("n"))), F.lit(0)).alias("days"))
    )


def department_shares(account: DataFrame, person_dept: DataFrame, dept: DataFrame) -> DataFrame:
    """Planned share per branch and year; departments without people are left out."""
    caps = broadcast_if_small(dept.select("dept_id", "name"))
    return (
        account.select("person_id", "year", "planned", "total")
        .join(person_dept, "person_id")
        .select("year", "planned", "total", F.explode("dept_ids").alias("dept_id"))
        .groupBy("dept_id", "year")
        .agg(F.sum("planned").alias("planned"), F.sum("total").alias("total"),
             F.count("*").alias("people"))
        .join(caps, "dept_id")
        .withColumn("share", F.when(F.col("total") == 0, 0.0)
                    .otherwise(F.col("planned") / F.col("total")))
    )


def remaining_per_department(account: DataFrame, member: DataFrame) -> DataFrame:
    """Remaining days per directly assigned department; a person counts in each."""
    return (
        account.select("person_id", "year", "remaining").join(member, "person_id")
        .groupBy("dept_id", "year").agg(F.sum("remaining").alias("remaining"))
    )


def entries_per_person(person: DataFrame, absence: DataFrame) -> DataFrame:
    counted = absence.groupBy("person_id").agg(F.count("*").alias("c"))
    return person.select("person_id").join(counted, "person_id", "left").select(
        "person_id", F.coalesce("c", F.lit(0)).alias("entries"))


def roll_forward(account: DataFrame) -> DataFrame:
    """People of the following year: same allowance, what is left is carried over."""
    carried = D.half_day_round(F.greatest(F.lit(0.0), F.col("remaining")))
    return account.select(
        (F.col("year") + 1).alias("plan_year"), "person_id", "name", "role", "entitlement",
        carried.alias("carryover"))


def after_request(proposal: DataFrame, absence: DataFrame, account: DataFrame,
                  cal: DataFrame) -> DataFrame:
    """Remaining days if a proposal were taken, in the year it starts.

    A replaced entry is given back first. Proposals of types without allowance leave the
    account as it is. Calendar and accounts must reach over all proposals; nothing is known of
    what remains to a person without an account.
    """
    asked = entry_workdays(proposal, cal, every=True).filter(F.col("year") == F.year("start"))
    old = entry_workdays(absence, cal).filter(
        (F.col("status") != REJECTED) & F.col("type").isin(*quota_types())
    ).select(F.col("absence_id").alias("ignore_absence_id"), "year",
             F.col("workdays").alias("given_back"))
    quota = F.col("type").isin(*quota_types())
    taken = F.when(F.col("status") == REJECTED, 0.0).otherwise(F.col("workdays"))
    after = F.when(
        quota, F.col("remaining") + F.coalesce("given_back", F.lit(0.0)) - taken
    ).otherwise(F.col("remaining"))
    return (
        asked.join(old, ["ignore_absence_id", "year"], "left")
        .join(account.select("person_id", "year", "remaining"), ["person_id", "year"], "left")
        .select("proposal_id", "person_id", "year", "workdays", after.alias("rest_after"),
                (quota & (after < 0)).alias("overdraws"),
                D.days_between(F.col("start"), F.col("end")).alias("calendar_days"))
    )


# -- orders --------------------------------------------------------------------
def sorted_accounts(account: DataFrame, names: DataFrame, by: str = "name",
                    ascending: bool = True) -> DataFrame:
    """Accounts by name, department, total, planned or remaining."""
    dept = F.coalesce(F.array_join("dept_names", ", "), F.lit("Ohne Abteilung"))
    listed = account.join(names, "person_id", "left").withColumn("department", dept)
    keys = {"name": ["name"], "department": ["department", "name"], "total": ["total"],
            "planned": ["planned"], "remaining": ["remaining"]}[by]
    return listed.drop("dept_names").orderBy(*keys, "person_id", ascending=ascending)


def sorted_people(person: DataFrame, ranks: DataFrame, account: DataFrame | None = None
                  ) -> DataFrame:
    """People by first department position (999 if none), then name or remaining days."""
    ranked = person.join(ranks, "person_id", "left").withColumn(
        "dept_rank", F.coalesce("dept_rank", F.lit(999)))
    if account is None:
        return ranked.orderBy("dept_rank", "name", "person_id")
    rest = account.select("person_id", "remaining")
    return ranked.join(rest, "person_id").orderBy("dept_rank", F.desc("remaining"), "person_id")
