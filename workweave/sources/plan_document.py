"""Plan documents: one JSON object per plan with all its years, read into flat tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.sources.reference import (
    ABSENCE_TYPES, APPROVED, DEFAULT_ENTITLEMENT, DEFAULT_LIMIT, STATUSES,
)

# Fixed shape of a document; unknown keys are ignored on reading.
_YEAR = (
    "STRUCT<locked: BOOLEAN, "
    "departments: ARRAY<STRUCT<id: STRING, name: STRING, parentId: STRING, maxAbsent: INT>>, "
    "people: ARRAY<STRUCT<id: STRING, name: STRING, deptIds: ARRAY<STRING>, deptId: STRING, "
    "role: STRING, entitlement: DOUBLE, carryover: DOUBLE>>, "
    "absences: ARRAY<STRUCT<id: STRING, personId: STRING, type: STRING, status: STRING, "
    "start: STRING, `end`: STRING, halfStart: BOOLEAN, halfEnd: BOOLEAN, note: STRING>>, "
    "closures: ARRAY<STRUCT<id: STRING, name: STRING, start: STRING, `end`: STRING>>>"
)
PLAN_SCHEMA = (
    "v INT, settings STRUCT<region: STRING, defaultEntitlement: DOUBLE, defaultMaxAbsent: INT, "
    f"defaultStatus: STRING>, years MAP<STRING, {_YEAR}>"
)

# Names given to unnamed rows
UNNAMED = {"department": "Abteilung", "person": "Unbenannt", "closure": "Betriebsruhe"}


def read_plans(spark: SparkSession, path: str) -> DataFrame:
    """(plan_id, plan): one row per JSON file; the file name identifies the plan."""
    return (
        spark.read.schema(PLAN_SCHEMA).option("multiLine", True).json(path)
        .select(F.col("_metadata.file_name").alias("plan_id"), F.struct("v", "settings", "years")
                .alias("plan"))
    )


def parse_plans(docs: DataFrame) -> DataFrame:
    """(plan_id, plan) from (plan_id, data) with ``data`` as JSON text."""
    return docs.select("plan_id", F.from_json("data", PLAN_SCHEMA).alias("plan"))


def years(plans: DataFrame) -> DataFrame:
    return plans.select("plan_id", F.explode("plan.years").alias("y", "d")).select(
        "plan_id", F.col("y").cast("int").alias("plan_year"), "d")


def rows_of(year: DataFrame, part: str) -> DataFrame:
    """(plan_id, plan_year, ord, fields...) of one list, in stored order."""
    return year.select("plan_id", "plan_year", F.posexplode(f"d.{part}").alias("ord", "r")).select(
        "plan_id", "plan_year", "ord", "r.*")


def _one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(default)


def _filled(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def _own_id(prefix: str) -> Column:
    """Rows without an id get one from their place in the document."""
    return F.coalesce(F.nullif(F.col("id"), F.lit("")),
                      F.concat(F.lit(prefix), F.col("ord").cast("string")))


def _department_ids() -> Column:
    """Ids of a year's departments in stored order, missing ones made up from the place."""
    return F.transform("d.departments", lambda d, i: F.coalesce(
        F.nullif(d["id"], F.lit("")), F.concat(F.lit("d"), i.cast("string"))))


def _repaired(above: Column, own: Column) -> Column:
    """Places of parents (-1 for none) without cycles, by a fold in stored order.

    ``above[i]`` is the place of a department's parent and ``own[i]`` that of the first department
    with its id. A department from which the way up meets itself, or never ends, loses its parent;
    those behind it see that.
    """
    def loops(up: Column, i: Column) -> Column:
        # as many steps as there are departments; -1 is the top, -2 a way that came back
        end = F.aggregate(up, F.get(up, i), lambda at, _: F.when(at < 0, at).when(
            at == F.get(own, i), F.lit(-2)).otherwise(F.get(up, at)))
        return end != -1

    def step(up: Column, i: Column) -> Column:
        return F.when(loops(up, i), F.transform(
            up, lambda x, j: F.when(j == i, F.lit(-1)).otherwise(x))).otherwise(up)

    return F.aggregate(F.transform(above, lambda _, i: i), above, step)


def clean_departments(year: DataFrame) -> DataFrame:
    """Defaults filled; unknown parents and cycles removed.

    All of it happens inside the document's own row: nothing is shuffled or written. Where every
    parent is stored before its children there can be no cycle, and nothing is folded.
    """
    def place(of: Column) -> Column:
        return (F.array_position("known", F.coalesce(of, F.lit(""))) - 1).cast("int")

    listed = year.withColumn("known", _department_ids()).withColumns({
        "above": F.transform("d.departments", lambda d: place(d["parentId"])),
        "own": F.transform("known", place)})
    tangled = F.exists(F.transform("above", lambda a, i: a >= F.get("own", i)), lambda x: x)
    return (
        listed.withColumn("above", F.when(tangled, _repaired(F.col("above"), F.col("own")))
                          .otherwise(F.col("above")))
        .select("plan_id", "plan_year", "known", "above",
                F.posexplode("d.departments").alias("ord", "r"))
        .select("plan_id", "plan_year", "ord", F.get("known", "ord").alias("dept_id"),
                F.when(F.get("above", "ord") >= 0, F.col("r.parentId")).alias("parent_id"),
                _filled(F.col("r.name"), UNNAMED["department"]).alias("name"),
                F.coalesce("r.maxAbsent", F.lit(DEFAULT_LIMIT)).alias("max_absent"))
    )


def clean_people(year: DataFrame) -> DataFrame:
    """Defaults filled; memberships reduced to known departments, each once, in order.

    The known ids are taken from the same document row, so nothing is joined.
    """
    people = year.select("plan_id", "plan_year", _department_ids().alias("known"),
                         F.posexplode("d.people").alias("ord", "r")).select(
        "plan_id", "plan_year", "ord", "known", "r.*")
    single = F.when(F.col("deptId").isNotNull() & (F.col("deptId") != ""), F.array("deptId"))
    wanted = F.coalesce("deptIds", single, F.array().cast("array<string>"))
    valid = F.filter(wanted, lambda x: F.array_contains(F.col("known"), x))
    return people.select(
        "plan_id", "plan_year", "ord", _own_id("p").alias("person_id"),
        _filled(F.col("name"), UNNAMED["person"]).alias("name"),
        F.array_distinct(F.when(F.col("known").isNotNull(), valid)
                         .otherwise(F.array().cast("array<string>"))).alias("dept_ids"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("entitlement", F.lit(DEFAULT_ENTITLEMENT)).alias("entitlement"),
        F.coalesce("carryover", F.lit(0.0)).alias("carryover"))


def clean_absences(year: DataFrame) -> DataFrame:
    """Types and statuses from the fixed lists; incomplete entries dropped."""
    raw = rows_of(year, "absences")
    complete = " and ".join(f"coalesce({c}, '') <> ''" for c in ("personId", "start", "`end`"))
    return raw.filter(complete).select(
        "plan_id", "plan_year", "ord", _own_id("a").alias("absence_id"),
        F.col("personId").alias("person_id"),
        _one_of(F.col("type"), [t for t, *_ in ABSENCE_TYPES], ABSENCE_TYPES[0][0]).alias("type"),
        _one_of(F.col("status"), [s for s, _ in STATUSES], APPROVED).alias("status"),
        F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"),
        F.coalesce("halfStart", F.lit(False)).alias("half_start"),
        F.coalesce("halfEnd", F.lit(False)).alias("half_end"),
        F.coalesce("note", F.lit("")).alias("note"))


def clean_closures(year: DataFrame) -> DataFrame:
    raw = rows_of(year, "closures").filter(
        "coalesce(start, '') <> '' and coalesce(`end`, '') <> ''")
    return raw.select(
        "plan_id", "plan_year", "ord", _own_id("c").alias("closure_id"),
        _filled(F.col("name"), UNNAMED["closure"]).alias("name"),
        F.col("start").cast("date").alias("start"), F.col("end").cast("date").alias("end"))
