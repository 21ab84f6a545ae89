"""Queries on the calendar, the department tree, occupancy and accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.functions import dates as D
from workweave.operators import accounts as A
from workweave.operators import calendar as C
from workweave.operators import hierarchy as H
from workweave.operators import lanes as L
from workweave.operators import occupancy as O
from workweave.plans.registry import query
from workweave.session import broadcast_if_small, settle
from workweave.sinks import reports
from workweave.sources import reference as R
from workweave.sources.fixtures import Plan

# -- reference tables and row filters -------------------------------------------
@query("a7_holiday_rules", R.REGIONS)
def _(p: Plan) -> DataFrame:
    starts = p.absence.groupBy(F.col("start").alias("day")).agg(F.count("*").alias("n"))
    found = C.holidays(p.years, R.REGIONS)
    return found.join(starts, "day", "left").groupBy("region").agg(
        F.count("*").alias("holidays"), F.coalesce(F.sum("n"), F.lit(0)).alias("starts"))


@query("a8_absence_types")
def _(p: Plan) -> DataFrame:
    used = p.absence.groupBy("type").agg(F.count("*").alias("entries"))
    return R.absence_types(p.spark).join(used, "type", "left").select(
        "type", "type_ord", "counts", "quota", F.coalesce("entries", F.lit(0)).alias("entries"))


@query("c2_countable")
def _(p: Plan) -> DataFrame:
    return O.countable(p.absence).select("absence_id", "type", "status")


@query("c3_uses_allowance")
def _(p: Plan) -> DataFrame:
    return O.uses_allowance(p.absence).select("absence_id", "type", "status")


@query("c4_ordered_ends")
def _(p: Plan) -> DataFrame:
    swapped = p.absence.select(
        "absence_id", F.when(F.col("half_start"), F.col("end")).otherwise(F.col("start"))
        .alias("start"),
        F.when(F.col("half_start"), F.col("start")).otherwise(F.col("end")).alias("end"))
    return O.ordered_ends(swapped)


@query("c5_person_search")
def _(p: Plan) -> DataFrame:
    term = "mach"
    hit = F.lower("name").contains("99") | F.lower("role").contains(term)
    return p.person.filter(hit).select("person_id", "name", "role")


@query("c12_delete_people")
def _(p: Plan) -> DataFrame:
    doomed = p.person.filter(F.col("role") == "FURNITURE").select("person_id")
    people = p.person.join(doomed, "person_id", "left_anti")
    entries = p.absence.join(doomed, "person_id", "left_anti")
    return people.select(F.lit("person").alias("kind"), F.col("person_id").alias("id")).unionByName(
        entries.select(F.lit("absence").alias("kind"), F.col("absence_id").alias("id")))


@query("c13_delete_departments")
def _(p: Plan) -> DataFrame:
    doomed = p.tree.filter(F.col("name").isin("NATION_7", "AFRICA", "ASIA")
                           | F.col("dept_id").isin("R1"))
    tree, member = H.delete_departments(p.tree, p.member, p.closure, doomed)
    sizes = H.direct_sizes(tree, member)
    return tree.join(sizes, "dept_id").select(
        "dept_id", F.coalesce("parent_id", F.lit("")).alias("parent_id"), "direct_size")


# -- calendar ------------------------------------------------------------------
@query("d1_easter")
def _(p: Plan) -> DataFrame:
    days = p.years.select("year", D.easter_sunday(F.col("year")).alias("easter"))
    return O.with_entries(days, p.absence, p.calendar, "easter")


@query("d2_wednesday_rule")
def _(p: Plan) -> DataFrame:
    days = p.years.select("year", D.wednesday_before_nov_23(F.col("year")).alias("day"))
    return O.with_entries(days, p.absence, p.calendar)


@query("d3_holidays")
def _(p: Plan) -> DataFrame:
    return O.with_entries(C.holidays(p.years, R.REGIONS), p.absence, p.calendar)


@query("d4_calendar")
def _(p: Plan) -> DataFrame:
    days = C.calendar(p.years, ["DE-NW", "DE-BY", "AT", "NONE"]).withColumn(
        "holiday_name", F.coalesce("holiday_name", F.lit("")))
    return O.with_entries(days, p.absence, p.calendar)


@query("d5_iso_week")
def _(p: Plan) -> DataFrame:
    return p.absence.groupBy(
        F.extract(F.lit("YEAROFWEEK"), "start").cast("int").alias("iso_year"),
        F.weekofyear("start").alias("iso_week"),
    ).agg(F.count("*").alias("starts"))


@query("d6_day_offsets")
def _(p: Plan) -> DataFrame:
    return p.absence.select(
        "absence_id", (F.dayofyear("start") - 1).alias("i"),
        F.datediff("end", D.year_start(F.year("start"))).alias("end_offset"),
        F.date_add("end", 1).alias("day_after"))


@query("d7_month_lengths")
def _(p: Plan) -> DataFrame:
    return p.absence.groupBy(F.trunc("start", "month").alias("month")).agg(
        F.count("*").alias("starts")).select(
        "month", F.dayofmonth(F.last_day("month")).alias("days_in_month"),
        D.days_between(D.year_start(F.year("month")), D.year_end(F.year("month")))
        .alias("days_in_year"), "starts")


@query("d8_workdays")
def _(p: Plan) -> DataFrame:
    return A.entry_workdays(p.absence, p.calendar).select("absence_id", "year", "workdays")


@query("d8_workdays_by_days")
def _(p: Plan) -> DataFrame:
    return A.entry_workdays_by_days(p.absence, p.calendar)


@query("d9_calendar_days")
def _(p: Plan) -> DataFrame:
    return p.absence.select("absence_id", D.days_between(F.col("start"), F.col("end")).alias("days"))


@query("d10_german_texts")
def _(p: Plan) -> DataFrame:
    d = A.entry_workdays(p.absence, p.calendar)
    return d.select(
        "absence_id", "year", D.german_date(F.col("start")).alias("from"),
        D.german_range(F.col("start"), F.col("end")).alias("span"),
        F.concat_ws(" ", D.german_number(F.col("workdays")), F.when(
            F.col("workdays") == 1, "Arbeitstag").otherwise("Arbeitstage")).alias("length"))


@query("d11_holiday_list", R.REGIONS)
def _(p: Plan) -> DataFrame:
    return O.with_entries(C.holiday_list(p.calendar), p.absence, p.calendar)


# -- joins -----------------------------------------------------------------------
@query("e1_workdays_of_entries")
def _(p: Plan) -> DataFrame:
    return O.workdays_of(O.countable(p.absence), p.calendar).select("absence_id", "person_id", "day")


@query("e2_person_departments")
def _(p: Plan) -> DataFrame:
    return H.membership(p.person_dept)


@query("e3_closure")
def _(p: Plan) -> DataFrame:
    counted = p.member.groupBy("dept_id").agg(F.count("*").alias("members"))
    return p.closure.join(counted, "dept_id", "left").fillna(0, ["members"])


@query("e3_tree_order")
def _(p: Plan) -> DataFrame:
    clo = p.closure
    return H.tree_order(p.tree, clo).join(H.allowed_parents(p.tree, clo), "dept_id").select(
        "dept_id", "name", "depth", "path", "tree_key", "branch", "candidates")


@query("e4_absent_on")
def _(p: Plan) -> DataFrame:
    return O.absent_on(p.absence, p.person)


@query("e4_absent_in_branch")
def _(p: Plan) -> DataFrame:
    return O.branch_filter(O.absent_on(p.absence, p.person), p.person_dept, "R2")


@query("e4_absent_without_department")
def _(p: Plan) -> DataFrame:
    return O.branch_filter(O.absent_on(p.absence, p.person), p.person_dept, R.NO_DEPARTMENT)


@query("e5_known_people")
def _(p: Plan) -> DataFrame:
    kept = p.person.filter(F.col("role") != "FURNITURE").select("person_id", "name")
    return p.absence.join(kept, "person_id").select("absence_id", "person_id", "name")


def _conflicts(p: Plan) -> DataFrame:
    return O.conflicts(O.occupancy(p.absence, p.person_dept, p.calendar), p.limits)


@query("e6_conflicted_entries")
def _(p: Plan) -> DataFrame:
    return O.flag_conflicted(p.absence, _conflicts(p), p.person_dept).select(
        "absence_id", "conflicted")


@query("e7_entries_in_conflicts")
def _(p: Plan) -> DataFrame:
    named = O.conflict_people(_conflicts(p), p.absence, p.person_dept).select("absence_id")
    return p.absence.join(named, "absence_id", "left_semi").select("absence_id", "person_id")


@query("e8_screening")
def _(p: Plan) -> DataFrame:
    found = O.screen(p.proposal, p.absence, p.person_dept, p.limits, p.planning_calendar)
    return found.withColumn(
        "first_over", F.coalesce(F.col("first_over").cast("string"), F.lit(""))
    ).orderBy(F.desc("margin"), "proposal_id", "dept_id")


@query("e8_screened_people")
def _(p: Plan) -> DataFrame:
    return O.screened_people(
        p.proposal, p.absence, p.person_dept, p.limits, p.planning_calendar
    ).withColumn("first_day", F.col("first_day").cast("string"))


@query("e15_without_department")
def _(p: Plan) -> DataFrame:
    return H.without_department(p.person, p.member).select("person_id", "name")


@query("e15_people_under")
def _(p: Plan) -> DataFrame:
    return H.people_under(p.person, p.member, p.closure, "R3").select("person_id", "name")


@query("e17_also_in")
def _(p: Plan) -> DataFrame:
    return H.other_departments(p.member, p.tree)


# -- aggregates --------------------------------------------------------------------
@query("f1_occupancy")
def _(p: Plan) -> DataFrame:
    return O.occupancy(p.absence, p.person_dept, p.calendar).select("dept_id", "year", "day", "n")


@query("f1_occupancy_by_days")
def _(p: Plan) -> DataFrame:
    return O.occupancy_by_days(p.absence, p.person_dept, p.calendar).select(
        "dept_id", "year", "day", "n")


@query("f2_total_absent")
def _(p: Plan) -> DataFrame:
    return O.total_absent(p.absence, p.person, p.calendar).select("year", "day", "n")


def _accounts(p: Plan) -> DataFrame:
    return A.accounts(p.person, p.absence, p.calendar, p.years)


@query("f3_accounts")
def _(p: Plan) -> DataFrame:
    return _accounts(p).select("person_id", "year", "entitlement", "carryover", "total",
                               "approved", "pending", "planned", "other", "remaining")


@query("f4_account_figures")
def _(p: Plan) -> DataFrame:
    return A.account_figures(_accounts(p), p.absence, p.tree)


@query("f5_conflict_figures")
def _(p: Plan) -> DataFrame:
    return O.conflict_figures(_conflicts(p), O.total_absent(p.absence, p.person, p.calendar))


@query("f6_month_distribution")
def _(p: Plan) -> DataFrame:
    return A.month_distribution(p.absence, p.calendar)


@query("f7_department_shares")
def _(p: Plan) -> DataFrame:
    return A.department_shares(_accounts(p), p.person_dept, p.dept).withColumn(
        "share", F.round("share", 9))


@query("f8_branch_sizes")
def _(p: Plan) -> DataFrame:
    sizes = H.branch_sizes(p.person_dept)
    return H.direct_sizes(p.tree, p.member).join(sizes, "dept_id", "left").select(
        "dept_id", "direct_size", F.coalesce("size", F.lit(0)).alias("size"))


@query("f9_remaining_per_department")
def _(p: Plan) -> DataFrame:
    return A.remaining_per_department(_accounts(p), p.member)


@query("f10_conflicts_per_department")
def _(p: Plan) -> DataFrame:
    return O.conflicts_per_department(_conflicts(p), p.dept)


@query("f11_heatmap")
def _(p: Plan) -> DataFrame:
    occ = O.occupancy(p.absence, p.person_dept, p.calendar)
    return O.heatmap(occ, C.week_buckets(p.calendar), p.limits).select(
        "dept_id", "year", "bucket", "bucket_week", "peak", "peak_day", "level")


@query("f18_entries_per_person")
def _(p: Plan) -> DataFrame:
    return A.entries_per_person(p.person, p.absence)


@query("f19_day_detail")
def _(p: Plan) -> DataFrame:
    occ = O.occupancy(p.absence, p.person_dept, p.calendar, workdays_only=False)
    return O.day_detail(occ, p.limits).select("dept_id", "day", "n", "max_absent", "level")


# -- windows -----------------------------------------------------------------------
@query("g1_conflicts")
def _(p: Plan) -> DataFrame:
    return _conflicts(p).select("dept_id", "dept_name", "from", "to", "workdays", "peak",
                                "max_absent", "over")


@query("g1_conflict_people")
def _(p: Plan) -> DataFrame:
    return O.conflict_people(_conflicts(p), p.absence, p.person_dept).select(
        "dept_id", "period", "person_id", "absence_id", "day")


def _tight(p: Plan) -> DataFrame:
    return O.tight_periods(O.occupancy(p.absence, p.person_dept, p.calendar), p.dept)


@query("g2_tight_periods")
def _(p: Plan) -> DataFrame:
    return _tight(p).select("dept_id", "from", "to", "workdays", "max_absent")


@query("g3_bridges", R.REGIONS)
def _(p: Plan) -> DataFrame:
    return O.bridge_takers(C.bridges(p.calendar), p.absence).withColumn(
        "ratio", F.round("ratio", 9))


@query("g4_load_runs")
def _(p: Plan) -> DataFrame:
    return O.load_runs(O.occupancy(p.absence, p.person_dept, p.calendar), p.calendar)


@query("g5_week_buckets", ["DE-NW"])
def _(p: Plan) -> DataFrame:
    return O.with_entries(C.week_buckets(p.calendar), p.absence, p.calendar).select(
        "year", "day", "iso_week", "bucket", "bucket_week", "entries")


@query("g6_lanes")
def _(p: Plan) -> DataFrame:
    return L.assign_lanes(p.absence)


@query("g6_lane_counts")
def _(p: Plan) -> DataFrame:
    return L.lane_counts(L.assign_lanes(p.absence))


@query("g12_shown_on_top")
def _(p: Plan) -> DataFrame:
    return O.shown_on_top(p.absence)


# -- orders ------------------------------------------------------------------------
@query("h1_conflicts_by_severity")
def _(p: Plan) -> DataFrame:
    return O.by_severity(_conflicts(p), p.tree_order).select(
        "dept_id", "dept_name", "year", "from", "to", "workdays", "peak", "max_absent", "over",
        "severity")


@query("h2_longest_tight_periods")
def _(p: Plan) -> DataFrame:
    ords = p.dept.select("dept_id", F.col("ord").alias("dept_ord"))
    found = _tight(p).join(broadcast_if_small(ords), "dept_id")
    return O.longest_tight(found).select("year", "rank", "dept_id", "from", "to", "workdays",
                                         "left_out")


@query("h3_best_bridges", R.REGIONS)
def _(p: Plan) -> DataFrame:
    return C.best_bridges(O.bridge_takers(C.bridges(p.calendar), p.absence)).select(
        "region", "year", "rank", "from", "to", "cost", "free", "cause", "takers")


@query("h6_sorted_accounts")
def _(p: Plan) -> DataFrame:
    names = H.departments_by_person_order(p.member, p.tree)
    return A.sorted_accounts(_accounts(p), names, by="remaining").select(
        "person_id", "year", "department", "total", "planned", "remaining")


@query("h7_sorted_people")
def _(p: Plan) -> DataFrame:
    return A.sorted_people(p.person, H.first_rank(p.member, p.tree)).select(
        "person_id", "name", "dept_rank")


@query("h8_entries_by_start")
def _(p: Plan) -> DataFrame:
    return p.absence.select("person_id", "start", "ord", "absence_id").orderBy(
        "person_id", "start", "ord")


# -- rounding, roll-forward, requests ------------------------------------------------
@query("j10_half_day_rounding")
def _(p: Plan) -> DataFrame:
    return p.table("customer").select(
        "c_custkey", D.half_day_round(F.col("c_acctbal")).cast("double").alias("rounded"))


@query("j11_roll_forward")
def _(p: Plan) -> DataFrame:
    return A.roll_forward(_accounts(p))


@query("j12_after_request")
def _(p: Plan) -> DataFrame:
    cal = p.planning_calendar
    account = A.accounts(p.person, p.absence, cal, p.planning_years)
    return A.after_request(p.proposal, p.absence, account, cal)


# -- reports -------------------------------------------------------------------------
@query("b1_account_report")
def _(p: Plan) -> DataFrame:
    names = H.departments_by_person_order(p.member, p.tree)
    return reports.account_rows(_accounts(p), names)


@query("b2_entry_report")
def _(p: Plan) -> DataFrame:
    names = H.departments_by_person_order(p.member, p.tree)
    return reports.entry_rows(A.entry_workdays(p.absence, p.calendar), p.person, names)


@query("b3_conflict_report")
def _(p: Plan) -> DataFrame:
    found = settle(_conflicts(p))
    return reports.conflict_rows(
        found, O.conflict_people(found, p.absence, p.person_dept), p.person)


@query("b8_calendar_events")
def _(p: Plan) -> DataFrame:
    names = H.departments_by_person_order(p.member, p.tree)
    return reports.calendar_events(A.entry_workdays(p.absence, p.calendar), p.person, names)
