"""Department tree: closure, paths, sizes, memberships and structural edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.session import broadcast_if_small, settle
from workweave.sources.reference import DEFAULT_LIMIT, NO_DEPARTMENT, NO_DEPARTMENT_NAME


def reachable(dept: DataFrame) -> DataFrame:
    """(dept_id, anc_id, depth) with depth >= 1: everything met on the walk upwards.

    Pointer doubling: each round extends the ancestor at exactly the current reach by that
    ancestor's own list, so a tree of height h needs about log2(h) rounds. The members of a
    cycle reach themselves; every pair is kept once, with its shortest distance.
    """
    edges = dept.select("dept_id", F.col("parent_id").alias("anc_id")).filter("anc_id is not null")
    known = dept.select(F.col("dept_id").alias("anc_id"))
    pairs = edges.join(known, "anc_id", "left_semi").select(
        "dept_id", "anc_id", F.lit(1).alias("depth"))
    reach, size = 1, -1
    while True:
        pairs = settle(pairs)
        now, deepest = pairs.agg(F.count("*"), F.max("depth")).first()
        if now == size or deepest is None or deepest < reach:
            return pairs
        size = now
        edge = pairs.filter(F.col("depth") == reach).select(
            "dept_id", F.col("anc_id").alias("via"), F.col("depth").alias("so_far"))
        above = pairs.select(F.col("dept_id").alias("via"), "anc_id", "depth")
        longer = edge.join(above, "via").select(
            "dept_id", "anc_id", (F.col("so_far") + F.col("depth")).alias("depth"))
        pairs = (
            pairs.unionByName(longer).groupBy("dept_id", "anc_id")
            .agg(F.min("depth").alias("depth"))
        )
        reach *= 2


def closure(dept: DataFrame) -> DataFrame:
    """(dept_id, anc_id, depth): every department with itself and all ancestors."""
    itself = dept.select("dept_id", F.col("dept_id").alias("anc_id"), F.lit(0).alias("depth"))
    return itself.unionByName(reachable(dept).filter("dept_id <> anc_id"))


def tree_order(dept: DataFrame, clo: DataFrame) -> DataFrame:
    """Adds ``depth``, ``path`` (ancestor names, top first) and ``tree_key``.

    Sorting by ``tree_key`` lists the tree depth first, siblings in stored order. Each
    array holds one entry per level, so it is bounded by the height of the tree.
    """
    up = dept.select(F.col("dept_id").alias("anc_id"), F.col("ord").alias("anc_ord"),
                     F.col("name").alias("anc_name"))
    chain = (
        clo.join(up, "anc_id")
        .groupBy("dept_id")
        .agg(F.max("depth").alias("depth"),
             F.sort_array(F.collect_list(F.struct("depth", "anc_ord", "anc_name")), asc=False)
             .alias("chain"))
    )
    key = F.array_join(
        F.transform("chain", lambda c: F.lpad(c.anc_ord.cast("string"), 9, "0")), "/")
    above = F.filter("chain", lambda c: c.depth > 0)
    path = F.array_join(F.transform(above, lambda c: c.anc_name), " / ")
    return dept.join(
        chain.select("dept_id", F.col("depth").alias("depth"), path.alias("path"),
                     key.alias("tree_key")),
        "dept_id",
    )


def subtree(clo: DataFrame, dept_id: str) -> DataFrame:
    """The department itself and everything below it."""
    return clo.filter(F.col("anc_id") == dept_id).select("dept_id", "depth")


def allowed_parents(dept: DataFrame, clo: DataFrame) -> DataFrame:
    """(dept_id, candidates): how many departments could become the parent.

    Everything but the department itself and what lies below it. The number is derived
    from the size of the subtree; no pairs are formed.
    """
    total = dept.agg(F.count("*").alias("n"))
    below = clo.groupBy(F.col("anc_id").alias("dept_id")).agg(F.count("*").alias("branch"))
    return below.select("dept_id", "branch", (total.scalar() - F.col("branch")).alias("candidates"))


def person_departments(person: DataFrame, member: DataFrame, clo: DataFrame) -> DataFrame:
    """(person_id, dept_ids): all assigned departments and their ancestors, once each.

    The list is bounded by a person's own assignments times the height of the tree. People
    without any valid assignment get the no-department bucket.
    """
    reached = (
        member.select("person_id", "dept_id").join(broadcast_if_small(clo), "dept_id")
        .groupBy("person_id").agg(F.collect_set("anc_id").alias("dept_ids"))
    )
    return person.select("person_id").join(reached, "person_id", "left").select(
        "person_id",
        F.coalesce("dept_ids", F.array(F.lit(NO_DEPARTMENT))).alias("dept_ids"),
    )


def membership(person_dept: DataFrame) -> DataFrame:
    """(person_id, dept_id), one row per pair."""
    return person_dept.select("person_id", F.explode("dept_ids").alias("dept_id"))


def branch_sizes(person_dept: DataFrame) -> DataFrame:
    """(dept_id, size): distinct people in the whole branch."""
    return membership(person_dept).groupBy("dept_id").agg(F.count("*").alias("size"))


def direct_sizes(dept: DataFrame, member: DataFrame) -> DataFrame:
    counted = (
        member.select("dept_id", "person_id").distinct().groupBy("dept_id")
        .agg(F.count("*").alias("n"))
    )
    return dept.select("dept_id").join(counted, "dept_id", "left").select(
        "dept_id", F.coalesce("n", F.lit(0)).alias("direct_size"))


def limits(dept: DataFrame) -> DataFrame:
    """(dept_id, dept_name, max_absent) including the no-department bucket."""
    spark = dept.sparkSession
    none = spark.createDataFrame(
        [(NO_DEPARTMENT, NO_DEPARTMENT_NAME, DEFAULT_LIMIT)],
        "dept_id string, dept_name string, max_absent int",
    )
    return dept.select("dept_id", F.col("name").alias("dept_name"), "max_absent").unionByName(none)


def without_department(person: DataFrame, member: DataFrame) -> DataFrame:
    return person.join(member.select("person_id"), "person_id", "left_anti")


def people_under(person: DataFrame, member: DataFrame, clo: DataFrame, dept_id: str) -> DataFrame:
    """People of a branch, each once."""
    inside = member.join(subtree(clo, dept_id), "dept_id").select("person_id")
    return person.join(inside, "person_id", "left_semi")


def other_departments(member: DataFrame, dept: DataFrame) -> DataFrame:
    """(person_id, dept_id, also_in): names of a member's further departments, in order.

    One list per person is built first and then filtered per row, so no self-join of the
    membership table is needed; the list is as long as the person's own assignments.
    """
    names = dept.select("dept_id", F.col("name").alias("dept_name"))
    joined = member.join(names, "dept_id")
    lists = joined.groupBy("person_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "dept_id", "dept_name"))).alias("all"))
    return lists.select(
        "person_id", F.explode("all").alias("own"), "all",
    ).select(
        "person_id", F.col("own.dept_id").alias("dept_id"), "own", "all",
    ).select(
        "person_id", "dept_id",
        F.expr("array_join(transform(filter(all, x -> x.dept_id <> own.dept_id), "
               "x -> x.dept_name), ', ')").alias("also_in"),
    )


def delete_departments(dept: DataFrame, member: DataFrame, clo: DataFrame,
                       doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove departments: children move to the nearest surviving ancestor."""
    gone = doomed.select("dept_id").distinct()
    survivors = dept.join(gone, "dept_id", "left_anti")
    upward = (
        clo.filter("depth > 0")
        .join(gone.select(F.col("dept_id").alias("anc_id")), "anc_id", "left_anti")
        .groupBy("dept_id").agg(F.min_by("anc_id", "depth").alias("new_parent"))
    )
    kept = (
        survivors.join(upward, "dept_id", "left")
        .withColumn("parent_id", F.col("new_parent")).drop("new_parent")
    )
    return kept.select(*dept.columns), member.join(gone, "dept_id", "left_anti")


def repair_parents(dept: DataFrame) -> DataFrame:
    """Clear parents that do not exist and break cycles.

    Departments count in stored order (``ord``). The first member of a cycle loses its
    parent. A department that only leads into a cycle loses its parent as well, if it comes
    before that member and before everything on its own way to the cycle.
    """
    walk = reachable(dept)
    on_cycle = walk.filter("dept_id = anc_id").select("dept_id")
    ordered = dept.select("dept_id", "ord").join(
        on_cycle.withColumn("cyclic", F.lit(True)), "dept_id", "left")
    above = ordered.select(F.col("dept_id").alias("anc_id"), F.col("ord").alias("anc_ord"),
                           F.coalesce("cyclic", F.lit(False)).alias("anc_cyclic"))
    met = (
        walk.join(above, "anc_id").groupBy("dept_id")
        .agg(F.min(F.when(F.col("anc_cyclic"), F.col("anc_ord"))).alias("cycle_ord"),
             F.min(F.when(~F.col("anc_cyclic"), F.col("anc_ord"))).alias("way_ord"))
    )
    never = F.lit(2**62)
    first_on_cycle = F.col("cyclic") & (F.col("ord") == F.col("cycle_ord"))
    leads_into = (
        F.col("cyclic").isNull() & (F.col("ord") < F.col("cycle_ord"))
        & (F.col("ord") < F.coalesce("way_ord", never))
    )
    cut = ordered.join(met, "dept_id").filter(first_on_cycle | leads_into).select(
        "dept_id", F.lit(True).alias("cut"))
    known = dept.select(F.col("dept_id").alias("parent_id"), F.lit(True).alias("known"))
    return (
        dept.join(cut, "dept_id", "left").join(known, "parent_id", "left")
        .withColumn("parent_id", F.when(F.col("known") & F.col("cut").isNull(),
                                        F.col("parent_id")))
        .select(*dept.columns)
    )


def departments_by_person_order(member: DataFrame, dept: DataFrame) -> DataFrame:
    """(person_id, dept_names): names joined by `` | `` in assignment order."""
    names = dept.select("dept_id", F.col("name").alias("dept_name"))
    return (
        member.join(names, "dept_id").groupBy("person_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "dept_name"))).alias("l"))
        .select("person_id", F.transform("l", lambda x: x.dept_name).alias("dept_names"))
    )


def first_rank(member: DataFrame, dept: DataFrame) -> DataFrame:
    """(person_id, dept_rank): lowest stored position among a person's departments."""
    return (
        member.join(dept.select("dept_id", "ord"), "dept_id").groupBy("person_id")
        .agg(F.min("ord").alias("dept_rank"))
    )


