"""Running streams to the end of what is available, and reading their results back."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from workweave.session import scratch_path

_RUN = "__run"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The rows of one table as a file stream; ``ts`` as a zoned timestamp."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option(
        "pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Arbitrary state needs the RocksDB store; the former setting is put back."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def to_table(stream: DataFrame, label: str) -> DataFrame:
    """Append a stream to Parquet files until nothing is left, and read them."""
    spark = stream.sparkSession
    root = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True)
        .start(f"{root}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def each_batch(stream: DataFrame, label: str, handle: Callable[[DataFrame, int, str], None],
               mode: str = "append") -> str:
    """Run ``handle(batch, id, root)`` for every micro-batch; returns the root folder."""
    root = scratch_path(stream.sparkSession, label)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, n: handle(df, n, root))
        .option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return root


def _runs(batches: int) -> list[tuple[int, int]]:
    """First and last batch of the runs that hold ``batches`` batches: one run for every binary
    digit of that number, the longest first."""
    runs, start = [], 0
    for bit in reversed(range(batches.bit_length())):
        if batches >> bit & 1:
            runs.append((start, start + (1 << bit) - 1))
            start += 1 << bit
    return runs


def _path(root: str, run: tuple[int, int]) -> str:
    return f"{root}/rows/{run[0]}-{run[1]}"


def _newest(spark: SparkSession, root: str, runs: list[tuple[int, int]], schema: StructType,
            keys: list[str]) -> DataFrame:
    """The newest row per key of several runs."""
    values = [c for c in schema.names if c not in keys]
    parts = [spark.read.schema(schema).parquet(_path(root, run)).withColumn(_RUN, F.lit(run[1]))
             for run in runs]
    if len(parts) == 1:
        return parts[0].drop(_RUN)
    row = F.struct(*values) if values else F.lit(True)
    picked = reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(F.max_by(row, _RUN).alias(_RUN))
    return picked.select(*keys, f"{_RUN}.*") if values else picked.select(*keys)


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def latest_updates(stream: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """Update mode into files: the newest row per key is the current view.

    A batch writes the rows it changed as a run. Runs are joined as a binary counter carries: two
    of equal length become one with the newest row per key. So after n batches the view reads as
    many runs as n has binary ones, and a row is rewritten log2(n) times. Which runs there are
    follows from the batch number, so a repeated batch rewrites its own; what it read stays until
    the batch after it.
    """
    spark, schema, count = stream.sparkSession, stream.schema, [0]

    def store(batch: DataFrame, number: int, root: str) -> None:
        new = (number, number)
        batch.write.mode("overwrite").parquet(_path(root, new))
        before, after = _runs(number), _runs(number + 1)
        joined = [run for run in before if run not in after]
        if joined:
            _newest(spark, root, [*joined, new], schema, keys).write.mode("overwrite").parquet(
                _path(root, after[-1]))
        if number:
            for run in {*_runs(number - 1), (number - 1, number - 1)} - {*before, *after}:
                _remove(spark, _path(root, run))
        count[0] = number + 1

    root = each_batch(stream, label, store, "update")
    if not count[0]:
        return spark.createDataFrame([], schema)
    return _newest(spark, root, _runs(count[0]), schema, keys)
