"""Session helpers: checkpoint folder, scratch paths, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 200_000
# Rows of a part that uneven input is dealt out in.
SPREAD_ROWS = 4_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        active = sc._jsc.sc().getCheckpointDir()
        named = active.get() if active.isDefined() else tempfile.mkdtemp(prefix="workweave-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/workweave/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so a lost executor costs no replay."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as compressed files below the checkpoint folder: what is read more than once and
    costs more to make than to read."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for costly row work on input that comes in fewer pieces than cores.

    A file of few row groups has more splits than pieces: the rows of a group all come in one of
    them. So the rows of each split are counted, which reads no column. Large input that comes in
    even splits is left alone, so nothing is shuffled there; other input is dealt out in parts of
    up to ``SPREAD_ROWS``, so that a task's share does not grow with it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        largest = total = None
    else:
        largest, total = (df.groupBy(F.spark_partition_id()).count()
                          .agg(F.max("count"), F.sum("count")).first())
        if not total or largest * cores <= 2 * total:
            return df
    total = df.count() if total is None else total
    return df.repartition(max(cores, -(-total // SPREAD_ROWS)), key)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when ``df`` (already settled, so cheap to count) fits the bound.

    Beyond the bound the frame is returned as it is and the join shuffles.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def session(app: str = "workweave", cores: str = "8") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
