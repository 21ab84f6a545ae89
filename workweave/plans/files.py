"""Writers, queried by reading back what they wrote."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.operators import accounts as A
from workweave.operators import hierarchy as H
from workweave.operators import pages as P
from workweave.plans.registry import query
from workweave.session import scratch_path
from workweave.sinks import reports
from workweave.sinks import tables as T
from workweave.sources.fixtures import Plan

def _records(p: Plan) -> DataFrame:
    return P.extract(p.web_page, ["headings", "links", "meta", "images"])


@query("b4_csv_files")
def _(p: Plan) -> DataFrame:
    path = scratch_path(p.spark, "csv")
    T.write_csv(_records(p), path)
    return T.read_csv(p.spark, path)


@query("b5_json_lines")
def _(p: Plan) -> DataFrame:
    path = scratch_path(p.spark, "jsonl")
    T.write_json_lines(P.extract(p.web_page, ["links"]), path)
    row = F.from_json("value", "typ string, quelle string, text string, url string").alias("r")
    return p.spark.read.text(path).select(row).select("r.*")


@query("b6_json_with_header")
def _(p: Plan) -> DataFrame:
    path = scratch_path(p.spark, "json")
    T.write_json(_records(p), path, {"auftrag": "alle Seiten"}, datetime(2024, 1, 1))
    head = p.spark.read.schema("erzeugt string, anzahl long, meta map<string,string>").json(
        f"{path}/kopf")
    return head.select("erzeugt", "anzahl", F.element_at("meta", F.lit("auftrag")).alias("auftrag"))


@query("b7_saved_tables")
def _(p: Plan) -> DataFrame:
    path = scratch_path(p.spark, "tables")
    rows, _info = T.save_tables(_records(p), path, {"auftrag": "alle Seiten"}, "web_")
    return p.spark.table(rows).groupBy("typ", "feld").agg(
        F.count("*").alias("rows"), F.sum(F.length("text")).alias("characters"),
        F.sum(F.length("alt")).alias("described"))


@query("b8_calendar_files")
def _(p: Plan) -> DataFrame:
    names = H.departments_by_person_order(p.member, p.tree)
    path = scratch_path(p.spark, "calendars")
    reports.write_calendars(reports.calendar_events(
        A.entry_workdays(p.absence, p.calendar), p.person, names), path)
    return reports.calendar_figures(p.spark, path).select(
        "year", "head", "end", "name", F.col("events").cast("int").alias("events"),
        F.col("too_long").cast("int").alias("too_long"), "characters")


@query("b9_daily_backups")
def _(p: Plan) -> DataFrame:
    path = scratch_path(p.spark, "backup")
    T.write_backups(p.revision.select("rev", "created_at", "data"), path, keep=20)
    back = p.spark.read.schema("rev long, data string, day date").json(path)
    return back.select("day", "rev", "data")


@query("b10_job_upsert")
def _(p: Plan) -> DataFrame:
    job = p.table("events").select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("finished"),
        F.col("event_type").alias("summary"), F.length("props").alias("row_count"))
    early = F.col("summary").isin("view", "click")
    path = scratch_path(p.spark, "jobs")
    T.upsert(job.filter(early), job.filter(~early), ["job_id"], "finished").write.parquet(path)
    return p.spark.read.parquet(path)
