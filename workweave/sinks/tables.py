"""Writers for records, backups and keyed tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from workweave.operators import records as R
from workweave.operators import revlog as V
from workweave.session import written


def ragged_json(records: DataFrame) -> DataFrame:
    """(value): one JSON object per record with only its own keys."""
    head = F.create_map(F.lit("typ"), F.col("kind"), F.lit(R.SOURCE), F.col("url"))
    return records.select(F.to_json(F.map_concat(head, F.col("fields"))).alias("value"))


def _csv_line(cells: Column) -> Column:
    """A line of comma-separated cells, quoted where they hold a comma, a quote or a line break."""
    return F.array_join(F.transform(cells, lambda c: F.when(
        c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    ).otherwise(c)), ",")


def csv_lines(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(value): the header line, and a line per record with a cell for every column of any record.

    The columns are a first pass over the records, and meet each record as one value of the query:
    there is no list of them in the program, and the records are not shuffled.
    """
    header = R.ordered_columns(records)
    every = F.map_concat(F.create_map(F.lit("typ"), "kind", F.lit(R.SOURCE), "url"),
                         F.map_filter("fields", lambda k, _: ~k.isin("typ", R.SOURCE)))
    cells = F.transform("columns", lambda c: F.coalesce(F.element_at("cells", c), F.lit("")))
    lines = records.select(every.alias("cells")).withColumn("columns", header.scalar())
    return header.select(_csv_line(F.col("columns")).alias("value")), lines.select(
        _csv_line(cells).alias("value"))


def write_csv(records: DataFrame, path: str) -> None:
    """Comma-separated files with the union of all columns in first-seen order. The first file
    holds the header alone, so the files in the order of their names are one table. Records are
    written out ahead, as header and lines read them three times."""
    header, lines = csv_lines(written(records, "records"))
    header.coalesce(1).unionByName(lines).write.mode("overwrite").text(path)


def read_csv(spark, path: str) -> DataFrame:
    """What ``write_csv`` wrote; all columns are text."""
    names = spark.read.option("multiLine", True).option("escape", '"').csv(
        f"{path}/part-00000-*").first()
    schema = StructType([StructField(n, StringType()) for n in names])
    table = spark.read.schema(schema).option("multiLine", True).option("escape", '"').csv(path)
    return table.fillna("").filter(F.col(names[0]) != names[0])


def write_json_lines(records: DataFrame, path: str) -> None:
    ragged_json(records).write.mode("overwrite").text(path)


def write_json(records: DataFrame, path: str, meta: dict[str, str], made: datetime) -> None:
    """Rows as JSON lines below ``daten`` and a one-row header beside them.

    The header counts what was written, so the records are computed once.
    """
    write_json_lines(records, f"{path}/daten")
    spark = records.sparkSession
    pairs = [F.lit(x) for kv in meta.items() for x in kv]
    spark.read.text(f"{path}/daten").agg(F.count("*").alias("anzahl")).select(
        F.lit(made.strftime("%Y-%m-%d %H:%M:%S")).alias("erzeugt"), "anzahl",
        (F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).alias("meta"),
    ).write.mode("overwrite").json(f"{path}/kopf")


def save_tables(records: DataFrame, path: str, meta: dict[str, str], prefix: str = ""
                ) -> tuple[str, str]:
    """Replace the tables ``ergebnisse`` and ``info``; all columns are text."""
    spark = records.sparkSession
    names = (f"{prefix}ergebnisse", f"{prefix}info")
    info = spark.createDataFrame(list(meta.items()), "feld string, wert string")
    for name, rows in zip(names, (R.as_table(records), info), strict=True):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        rows.write.mode("overwrite").option("path", f"{path}/{name}").saveAsTable(name)
    return names


def write_backups(log: DataFrame, path: str, keep: int = V.KEPT_BACKUPS) -> None:
    """The first state of each day, one folder per day, newest ``keep`` days."""
    V.daily_backups(log, keep).write.mode("overwrite").partitionBy("day").json(path)


def upsert(current: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Insert or replace: the newest version of every key stays."""
    values = [c for c in current.columns if c not in (*keys, order)]
    both = current.unionByName(rows)
    return V.latest(both, keys, order, values).select(*current.columns)
