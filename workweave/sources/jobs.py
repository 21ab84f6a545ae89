"""Stored jobs: rows kept as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stored_rows(jobs: DataFrame) -> DataFrame:
    """(job_id, pos, fields): the rows of every job; nested values stay JSON text."""
    rows = F.from_json("rows_json", "array<map<string,string>>")
    return jobs.select("job_id", F.posexplode(rows).alias("pos", "fields"))


def job_options(jobs: DataFrame, schema: str) -> DataFrame:
    """Options with known fields only; other keys are ignored."""
    return jobs.select("job_id", F.from_json("options", schema).alias("o")).select("job_id", "o.*")
