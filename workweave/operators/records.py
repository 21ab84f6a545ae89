"""Extracted records ``(page_id, url, kind, pos, fields)`` with free columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workweave.functions import text as X
from workweave.session import settle, written

SOURCE = "quelle"


def canonical_fields(fields: Column) -> Column:
    """Key-sorted JSON text of a record's fields without the source."""
    own = F.map_filter(fields, lambda k, _: k != SOURCE)
    return F.to_json(F.array_sort(F.map_entries(own)))


def column_union(records: DataFrame) -> DataFrame:
    """(column, first): all columns, to be listed in first-seen order."""
    seen = records.select("page_id", "preset", "pos", F.posexplode(F.map_keys("fields"))
                          .alias("at", "column"))
    return seen.groupBy("column").agg(
        F.min(F.struct("page_id", "preset", "pos", "at")).alias("first"))


def ordered_columns(records: DataFrame) -> DataFrame:
    """(columns): one row with all columns in first-seen order, the kind and the source ahead."""
    listed = column_union(records).agg(F.array_sort(F.collect_list(
        F.struct("first", "column"))).alias("l"))
    return listed.select(F.concat(F.array(F.lit("typ"), F.lit(SOURCE)),
                                  F.transform("l", lambda x: x["column"])).alias("columns"))


def column_names(records: DataFrame) -> list[str]:
    """Column names in first-seen order (one row per distinct column reaches the driver)."""
    return [r["column"] for r in column_union(records).orderBy("first").collect()]


def sorted_columns(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.map_keys("fields")).alias("column")).distinct().orderBy("column")


def as_table(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One text column per field of any record; missing values are empty.

    A table's columns are known to the driver; ``csv_lines`` of the writers needs no list. Records
    that are asked for their columns first are written out, so that pages are read once.
    """
    if columns is None:
        records = written(records, "records")
    names = columns or column_names(records)
    values = [F.coalesce(F.element_at("fields", F.lit(n)), F.lit("")).alias(n) for n in names]
    return records.select(F.col("kind").alias("typ"), F.col("url").alias(SOURCE), *values)


def distinct_records(records: DataFrame) -> DataFrame:
    """Drop records equal in everything but their source; the first one stays.

    Grouping by a digest combines copies before the shuffle, however many there are.
    """
    digest = F.sha2(F.concat_ws("\u0001", "kind", canonical_fields(F.col("fields"))), 256)
    place = F.struct("page_id", "preset", "pos")
    row = F.struct("page_id", "url", "kind", "preset", "pos", "fields")
    return records.groupBy(digest.alias("_digest")).agg(
        F.min_by(row, place).alias("r")).select("r.*")


def filter_any(records: DataFrame, term: str) -> DataFrame:
    """Any column contains the term, whatever the case."""
    hit = F.exists(F.map_values("fields"), lambda v: F.contains(F.lower(v), F.lit(term.lower())))
    return records.filter(hit | F.contains(F.lower("kind"), F.lit(term.lower()))
                          | F.contains(F.lower("url"), F.lit(term.lower())))


def non_empty(records: DataFrame) -> DataFrame:
    return records.filter(F.exists(F.map_values("fields"), lambda v: v != ""))


def sort_keys(value: Column) -> tuple[Column, Column, Column]:
    """Class, number and text: numbers first, then text, empty last."""
    text = X.strip_space(F.coalesce(value, F.lit("")))
    cleaned = F.regexp_replace(
        F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
        r"[^\p{Nd}.-]", "")
    number = cleaned.try_cast("double")
    kind = F.when(text == "", 2).when(number.isNotNull(), 0).otherwise(1)
    return (kind, F.when(kind == 0, number).otherwise(0.0),
            F.when(kind == 1, F.lower(text)).otherwise(""))


def sort_by(records: DataFrame, value: Column, ascending: bool = True) -> DataFrame:
    kind, number, text = sort_keys(value)
    keyed = records.withColumns({"sort_class": kind, "sort_number": number, "sort_text": text})
    return keyed.orderBy("sort_class", "sort_number", "sort_text", ascending=ascending)


def stringify(value: Column, data_type: str) -> Column:
    """Text of any value: nothing for null, JSON for nested values."""
    if data_type.startswith(("array", "map", "struct")):
        return F.coalesce(F.to_json(value), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def head_sample(records: DataFrame, order: list[str], n: int = 60) -> DataFrame:
    """The first ``n`` records and how many are left out; the records are computed once."""
    kept = settle(records)
    total = kept.agg(F.count("*")).scalar()
    return kept.withColumn("_total", total).orderBy(*order).limit(n).withColumn(
        "left_out", F.greatest(F.lit(0), F.col("_total") - n)).drop("_total")


def without_chosen(records: DataFrame, chosen: Column) -> DataFrame:
    """Records without the chosen ones, by page and place: what a list of ticked rows removes."""
    kept = settle(records)
    ticked = kept.filter(chosen).select("page_id", "preset", "pos")
    return kept.join(ticked, ["page_id", "preset", "pos"], "left_anti")


def attach_to_pages(pages: DataFrame, records: DataFrame) -> DataFrame:
    """(page_id, record...): records by their source; those of unknown source go to the
    page with the lowest id."""
    known = pages.select("url", F.col("page_id").alias("_page"))
    first = pages.agg(F.min("page_id")).scalar()
    return (
        records.drop("page_id").join(known, "url", "left")
        .withColumn("page_id", F.coalesce("_page", first)).drop("_page")
    )
