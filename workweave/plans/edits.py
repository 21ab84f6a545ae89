"""Queries on plan documents, edits, merges and the revision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.operators import merge as M
from workweave.operators import ordering as O
from workweave.operators import revlog as V
from workweave.plans.registry import query
from workweave.sources import plan_document as P
from workweave.sources.fixtures import Plan


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


# -- plan documents ------------------------------------------------------------------
def _years(p: Plan) -> DataFrame:
    return P.years(P.parse_plans(p.documents))


@query("a1_plan_tables")
def _(p: Plan) -> DataFrame:
    raw = P.rows_of(_years(p), "absences")
    return raw.select(
        "plan_id", "plan_year", "ord", "id", "personId", "type",
        F.coalesce("status", F.lit("")).alias("status"), "start",
        F.coalesce("end", F.lit("")).alias("end"))


@query("c1_clean_departments")
def _(p: Plan) -> DataFrame:
    return P.clean_departments(_years(p)).withColumn(
        "parent_id", F.coalesce("parent_id", F.lit("")))


@query("c1_clean_people")
def _(p: Plan) -> DataFrame:
    return P.clean_people(_years(p)).withColumn("dept_ids", F.array_join("dept_ids", ","))


@query("c1_clean_absences")
def _(p: Plan) -> DataFrame:
    return P.clean_absences(_years(p))


@query("c1_clean_closures")
def _(p: Plan) -> DataFrame:
    return P.clean_closures(_years(p))


@query("c11_known_fields")
def _(p: Plan) -> DataFrame:
    known = F.from_json("data", P.PLAN_SCHEMA)
    entry = F.get(F.element_at(known.years, F.year("start").cast("string")).absences, 0)
    docs = p.documents.join(
        p.absence.select(F.col("absence_id").cast("string").alias("plan_id"), "start"), "plan_id")
    fields = F.map_keys(F.from_json(F.to_json(entry), "map<string,string>"))
    return docs.select("plan_id", F.array_join(F.array_sort(fields), ",").alias("fields"))


# -- merges -----------------------------------------------------------------------------
def _ordered(v: DataFrame) -> DataFrame:
    return v.withColumn("ord", F.col("id"))


@query("j7_canonical_rows")
def _(p: Plan) -> DataFrame:
    rows = p.table("customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_nationkey").alias("dept"))
    return rows.select("id", M.canonical(rows).alias("form"))


@query("j13_merge")
def _(p: Plan) -> DataFrame:
    return M.merge_rows(*map(_ordered, p.versions), ["id"], "ord").select(
        "id", "name", "role", "balance", "taken_from", "part", "ord")


@query("j14_merge_settings")
def _(p: Plan) -> DataFrame:
    flat = [v.select(F.col("name").alias("key"), F.col("balance").alias("value"))
            for v in p.versions]
    return M.merge_settings(*flat, "key")


@query("j15_merge_years")
def _(p: Plan) -> DataFrame:
    rows, held = p.year_versions
    return M.merge_years(*rows, "year", ["id"], held).select(
        "year", "id", "name", "balance", "taken_from")


@query("j15_year_verdicts")
def _(p: Plan) -> DataFrame:
    rows, held = p.year_versions
    return M.year_verdicts(*rows, "year", ["id"], held)


@query("j16_true_conflicts")
def _(p: Plan) -> DataFrame:
    return M.true_conflicts(*p.versions, ["id"])


@query("j19_first_meeting")
def _(p: Plan) -> DataFrame:
    base, mine, theirs = map(_ordered, p.versions)
    return M.first_meeting(None, mine, theirs, ["id"], "ord").select(
        "id", "name", "balance", "taken_from")


@query("i4_import_years")
def _(p: Plan) -> DataFrame:
    dated = p.absence.select("absence_id", "status", F.year("start").alias("plan_year"))
    current = dated.filter("plan_year <= 1999")
    incoming = dated.filter("plan_year >= 1999").withColumn("status", F.lit("genehmigt"))
    return M.import_years(current, incoming, "plan_year")


@query("i5_key_union")
def _(p: Plan) -> DataFrame:
    rows = M.aligned(*p.versions, ["id"])
    return rows.select("id", *[F.col(c).isNotNull().alias(f"in_{n}") for c, n in
                               (("b", "base"), ("m", "mine"), ("t", "theirs"))])


# -- change sets ---------------------------------------------------------------------------
@query("j17_apply_changes")
def _(p: Plan) -> DataFrame:
    table = p.person.select("person_id", "name", "role", "entitlement")
    kind = F.col("event_type")
    op = F.when(kind == "signup", "add").when(kind == "error", "delete").otherwise("update")
    changes = p.table("events").select(
        (F.col("user_id") * 2).alias("person_id"), F.col("event_id").alias("seq"), op.alias("op"),
        F.when(kind.isin("signup", "click"), F.concat(F.lit("E"), "event_id")).alias("name"),
        F.when(kind.isin("signup", "view"), kind).alias("role"),
        F.when(kind.isin("signup", "purchase"), F.col("value")).alias("entitlement"))
    return M.apply_changes(table, changes, "person_id")


@query("j17_ordered_people")
def _(p: Plan) -> DataFrame:
    return O.replayed(p.ordered_people, p.ordered_edits).select(
        "list_id", "pos", "person_id", F.array_join("dept_ids", ",").alias("dept_ids"))


@query("j17_accepted_parents")
def _(p: Plan) -> DataFrame:
    n = p.table("nation")
    sideways = n.select(F.concat(F.lit("N"), "n_nationkey").alias("dept_id"), F.concat(
        F.lit("N"), (F.col("n_nationkey") + 5) % 25).alias("new_parent"))
    down = n.select(F.concat(F.lit("R"), F.col("n_nationkey") % 4).alias("dept_id"),
                    F.concat(F.lit("N"), "n_nationkey").alias("new_parent"))
    members = p.member.groupBy(F.col("dept_id").alias("new_parent")).agg(
        F.count("*").alias("members"))
    return M.accepted_parents(sideways.unionByName(down), p.closure).join(members, "new_parent")


# -- revision log ------------------------------------------------------------------------------
@query("a2_revision_listing")
def _(p: Plan) -> DataFrame:
    return V.listing(p.revision).withColumn("created_at", _stamp("created_at"))


@query("e16_stale_writes")
def _(p: Plan) -> DataFrame:
    return V.stale_writes(p.revision)


@query("g8_retained_revisions")
def _(p: Plan) -> DataFrame:
    return V.retained(p.revision).select("rev", "client", "data")


@query("g9_latest_versions")
def _(p: Plan) -> DataFrame:
    return V.latest(p.task_event, ["run_id", "task_id"], "seq", ["state"])


@query("g10_daily_backups")
def _(p: Plan) -> DataFrame:
    return V.daily_backups(p.revision)


@query("g13_attempts")
def _(p: Plan) -> DataFrame:
    return V.attempts(p.task_event.select("run_id", "task_id", "seq"), ["run_id", "task_id"], "seq")


@query("g14_revision_deltas")
def _(p: Plan) -> DataFrame:
    return V.deltas(p.revision)


@query("h9_newest_revisions")
def _(p: Plan) -> DataFrame:
    return V.newest(V.listing(p.revision), "rev", V.LISTED_REVISIONS).withColumn(
        "created_at", _stamp("created_at"))


@query("h9_newest_jobs")
def _(p: Plan) -> DataFrame:
    return V.newest(p.stored_job.select("started_at", "job_id"), "started_at", 100).select("job_id")


@query("j6_job_ages")
def _(p: Plan) -> DataFrame:
    return V.age_buckets(p.task_event, "ts", "2024-01-31 00:00:00")


@query("j18_restore")
def _(p: Plan) -> DataFrame:
    done = V.restore(p.revision, 123, "2024-02-01 00:00:00")
    return done.select("rev", "base_rev", "data", "note")
