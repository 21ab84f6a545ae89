"""Written tables that cut a lineage, and the document columns an operator reads."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.session import scratch_path


#: For each block of ``passing`` that is open, the tables saved in it.
_PASSING: list[list[tuple[str, str]]] = []


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it from there.

    A lost executor then costs the reading of a file, and each table is computed once. The files
    stay until the folder is cleaned, or the block of ``passing`` around ends.
    """
    path = scratch_path(df.sparkSession, f"llm-{label}")
    df.write.parquet(path)
    for made in _PASSING:
        made.append((label, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, *kept: str) -> Iterator[None]:
    """Tables saved inside are steps on the way to those with the labels ``kept``: they are removed
    at the end, when all that is read later has been written."""
    made: list[tuple[str, str]] = []
    _PASSING.append(made)
    try:
        yield
    finally:
        _PASSING.pop()
        spark = df.sparkSession
        for label, path in made:
            if label not in kept:
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that other columns can bear any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))


@contextmanager
def settings(df: DataFrame, values: dict[str, str]) -> Iterator[None]:
    """The session's settings for what is written inside."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name) for name in values}
    for name, value in values.items():
        conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            conf.set(name, value)


def batches_of(df: DataFrame, rows: int) -> AbstractContextManager[None]:
    """Arrow batches of at most ``rows`` rows in what is written inside, to bound a task's memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(df.sparkSession.conf.get(name))
    return settings(df, {name: str(min(rows, before) if before > 0 else rows)})


def removing_shuffles(df: DataFrame) -> AbstractContextManager[None]:
    """Let Spark remove the shuffle files of each table written inside once it is written; else they
    stay until the driver's memory is collected."""
    return settings(df, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def early_semi_joins(df: DataFrame) -> AbstractContextManager[None]:
    """Let Spark build a run-time Bloom filter (4 MB) of a written side of up to 256 MB, so that
    texts without a partner are dropped before the shuffle of a join. A larger side or a full
    filter costs that saving and no result."""
    bloom = "spark.sql.optimizer.runtime.bloomFilter"
    return settings(df, {f"{bloom}.enabled": "true",
                         f"{bloom}.applicationSideScanSizeThreshold": "0",
                         f"{bloom}.creationSideThreshold": "256MB",
                         f"{bloom}.expectedNumItems": "2500000",
                         f"{bloom}.numBits": str(1 << 25)})
