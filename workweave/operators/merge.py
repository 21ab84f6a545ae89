"""Three-way merge of keyed tables, settings and whole years; change sets and imports.

``base`` is the last common state, ``mine`` and ``theirs`` were edited on their own. A
change of mine wins over a change of theirs, per whole row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from workweave.session import broadcast_if_small, settle


def canonical(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Key-sorted JSON text of a row; maps are written as sorted entries."""
    names = sorted(columns or df.columns)

    def plain(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.MapType):
            return F.array_sort(F.map_entries(c)).alias(c)
        return F.col(c)

    return F.to_json(F.struct(*[plain(c) for c in names]), {"ignoreNullFields": "false"})


def _comparable(df: DataFrame, columns: list[str]) -> list[Column]:
    """Columns as they can be compared: maps as sorted entries."""
    return [
        F.array_sort(F.map_entries(c)).alias(c)
        if isinstance(df.schema[c].dataType, T.MapType) else F.col(c)
        for c in columns
    ]


def aligned(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str],
            order: str | None = None) -> DataFrame:
    """One row per key with the structs ``b``, ``m`` and ``t`` (null where absent).

    The three versions are stacked and grouped once: a single shuffle on the key instead
    of two outer joins. ``m_ord`` and ``t_ord`` keep the stored order.
    """
    payload = [c for c in mine.columns if c not in keys and c != order]
    position = F.col(order) if order else F.lit(None).cast("long")

    def tagged(df: DataFrame, side: str) -> DataFrame:
        return df.select(*keys, F.lit(side).alias("_side"), position.alias("_ord"),
                         F.struct(*_comparable(df, payload)).alias("_row"))

    stacked = tagged(base, "b").unionByName(tagged(mine, "m")).unionByName(tagged(theirs, "t"))

    def pick(side: str, column: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    return stacked.groupBy(*keys).agg(
        pick("b", "_row").alias("b"), pick("m", "_row").alias("m"), pick("t", "_row").alias("t"),
        pick("m", "_ord").alias("m_ord"), pick("t", "_ord").alias("t_ord"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def row_verdict() -> Column:
    """``mine``, ``theirs`` or null (the row goes) for a row of ``aligned``."""
    b, m, t = (F.col(c).isNotNull() for c in "bmt")
    mine, theirs, gone = F.lit("mine"), F.lit("theirs"), F.lit(None).cast("string")
    return (
        F.when(~m, F.when(~b & t, theirs).otherwise(gone))
        .when(~t, F.when(b & _same("m", "b"), gone).otherwise(mine))
        .when(b & _same("m", "b"), theirs)
        .otherwise(mine)
    )


def _taken(rows: DataFrame, keys: list[str], verdict: Column) -> DataFrame:
    """Rows that stay, in order: mine as stored, then those only theirs."""
    decided = rows.withColumn("taken_from", verdict).filter("taken_from is not null")
    row = F.when(F.col("taken_from") == "mine", F.col("m")).otherwise(F.col("t"))
    return decided.withColumn("_row", row).select(
        *keys, "_row.*", "taken_from",
        F.when(F.col("m").isNotNull(), 0).otherwise(1).alias("part"),
        F.coalesce("m_ord", "t_ord").alias("ord"))


def merge_rows(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str],
               order: str | None = None) -> DataFrame:
    """Merge by key. ``part`` and ``ord`` give the display order."""
    return _taken(aligned(base, mine, theirs, keys, order), keys, row_verdict())


def merge_settings(base: DataFrame, mine: DataFrame, theirs: DataFrame, key: str) -> DataFrame:
    """Key/value merge: theirs, except where mine differs from base."""
    rows = aligned(base, mine, theirs, [key])
    changed = ~_same("m", "b")
    kept = F.when(changed, F.col("m")).otherwise(F.col("t"))
    return rows.withColumn("_row", kept).filter("_row is not null").select(
        key, "_row.*", F.when(changed, "mine").otherwise("theirs").alias("taken_from"))


def _held(rows: DataFrame, years: DataFrame, year: str) -> DataFrame:
    """The years of one side with their flags; a year with rows is held even if not listed."""
    listed = years.withColumn("_held", F.lit(True))
    return listed.unionByName(
        rows.select(year).distinct().join(years.select(year), year, "left_anti")
        .withColumn("_held", F.lit(True)), allowMissingColumns=True)


def year_verdicts(base: DataFrame, mine: DataFrame, theirs: DataFrame, year: str,
                  keys: list[str], years: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """(year, verdict, flags...): what becomes of every year that a side holds.

    A year deleted here goes; one deleted there goes if nothing of it changed here; one known to
    a single side is taken whole; else its rows are merged (``drop``, ``mine``, ``theirs`` or
    ``rows``). ``years`` lists the years of base, mine and theirs, since a year may be held without
    a row, and may carry flags such as ``locked``: where rows are merged, a flag changed here wins.
    """
    rows = aligned(base, mine, theirs, [year, *keys])
    untouched = rows.groupBy(year).agg(F.bool_and(_same("m", "b")).alias("_untouched"))
    held = aligned(*[_held(r, y, year) for r, y in zip((base, mine, theirs), years, strict=True)],
                   [year]).join(untouched, year, "left")
    in_b, in_m, in_t = (F.col(c).isNotNull() for c in "bmt")
    unchanged = F.coalesce("_untouched", F.lit(True)) & _same("m", "b")
    verdict = (
        F.when(in_b & ~in_m, "drop").when(in_b & ~in_t & unchanged, "drop")
        .when(~in_m, "theirs").when(~in_t, "mine").otherwise("rows")
    )
    flags = [c for c in years[1].columns if c != year]

    def flag(c: str) -> Column:
        here, there = F.col(f"m.{c}"), F.col(f"t.{c}")
        changed = ~here.eqNullSafe(F.col(f"b.{c}"))
        return F.when(F.col("verdict") == "mine", here).when(
            (F.col("verdict") == "rows") & changed, here).otherwise(there).alias(c)

    return held.withColumn("verdict", verdict).select(year, "verdict", *[flag(c) for c in flags])


def merge_years(base: DataFrame, mine: DataFrame, theirs: DataFrame, year: str,
                keys: list[str], years: tuple[DataFrame, DataFrame, DataFrame],
                order: str | None = None) -> DataFrame:
    """Merge with the rules for years (``year_verdicts``) before those for rows."""
    verdicts = year_verdicts(base, mine, theirs, year, keys, years).select(year, "verdict")
    small = broadcast_if_small(settle(verdicts))
    rows = aligned(base, mine, theirs, [year, *keys], order)
    whole = F.col("verdict")
    row = (
        F.when(whole == "rows", row_verdict())
        .when((whole == "mine") & F.col("m").isNotNull(), "mine")
        .when((whole == "theirs") & F.col("t").isNotNull(), "theirs")
    )
    return _taken(rows.join(small, year), [year, *keys], row)


def true_conflicts(base: DataFrame, mine: DataFrame, theirs: DataFrame, keys: list[str]
                   ) -> DataFrame:
    """Rows that both sides changed to different outcomes; deletions count as changes."""
    rows = aligned(base, mine, theirs, keys)
    kind = (
        F.when(F.col("m").isNull(), "deleted here").when(F.col("t").isNull(), "deleted there")
        .when(F.col("b").isNull(), "added twice").otherwise("changed twice")
    )
    return rows.filter(~_same("m", "b") & ~_same("t", "b") & ~_same("m", "t")).select(
        *keys, kind.alias("kind"))


def first_meeting(base: DataFrame | None, mine: DataFrame, theirs: DataFrame, keys: list[str],
                  order: str) -> DataFrame:
    """First exchange after loading: an empty store takes mine; an empty copy, or one that
    was never exchanged, takes theirs; otherwise both are merged over the common state.
    """
    def whole(df: DataFrame, side: str, part: int) -> DataFrame:
        payload = [c for c in df.columns if c not in (*keys, order)]
        return df.select(*keys, *payload, F.lit(side).alias("taken_from"),
                         F.lit(part).alias("part"), F.col(order).alias("ord"))

    nothing_here = mine.isEmpty()
    if not nothing_here and theirs.isEmpty():
        return whole(mine, "mine", 0)
    if nothing_here or base is None:
        return whole(theirs, "theirs", 1)
    return merge_rows(base, mine, theirs, keys, order)


def import_years(current: DataFrame, incoming: DataFrame, year: str, merge: bool = True
                 ) -> DataFrame:
    """Replace everything, or only the years that the import brings."""
    if not merge:
        return incoming
    brought = F.broadcast(incoming.select(year).distinct())  # one row per calendar year
    return current.join(brought, year, "left_anti").unionByName(incoming)


# -- change sets -----------------------------------------------------------------
def apply_changes(table: DataFrame, changes: DataFrame, key: str, seq: str = "seq",
                  op: str = "op") -> DataFrame:
    """Apply an ordered batch of ``add``, ``update`` and ``delete`` changes.

    ``add`` sets a whole row, ``update`` patches the columns it carries (nulls leave a
    column as it is) and is void on a missing row, ``delete`` removes the row. Only the
    last add or delete and the last patch per column can matter, so the batch folds into
    one row per key before it meets the table.
    """
    columns = [c for c in table.columns if c != key]
    reset = F.col(op).isin("add", "delete")
    patch = F.col(op) == "update"
    folded = changes.groupBy(key).agg(
        F.max(F.when(reset, F.struct(seq, op, *columns))).alias("reset"),
        *[F.max(F.when(patch & F.col(c).isNotNull(), F.struct(F.col(seq).alias("s"),
                                                               F.col(c).alias("v"))))
          .alias(f"_p_{c}") for c in columns],
    )
    existing = table.withColumn("_there", F.lit(True))
    both = existing.join(folded, key, "full")
    was_reset = F.col("reset").isNotNull()
    lives = F.when(was_reset, F.col(f"reset.{op}") == "add").otherwise(
        F.coalesce("_there", F.lit(False)))

    def value(c: str) -> Column:
        start = F.when(was_reset, F.col(f"reset.{c}")).otherwise(F.col(c))
        later = F.col(f"_p_{c}.s") > F.coalesce(F.col(f"reset.{seq}"), F.lit(-(2**62)))
        return F.when(later, F.col(f"_p_{c}.v")).otherwise(start).alias(c)

    return both.filter(lives).select(key, *[value(c) for c in columns])


def accepted_parents(moves: DataFrame, clo: DataFrame) -> DataFrame:
    """Parent changes that keep the tree free of cycles: (dept_id, new_parent)."""
    below = clo.select(F.col("anc_id").alias("dept_id"), F.col("dept_id").alias("new_parent"))
    return moves.join(broadcast_if_small(below), ["dept_id", "new_parent"], "left_anti")
