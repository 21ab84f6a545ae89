"""Documents to packed training sequences, in five stages of the training-data operators.

Each stage is a function of the session, all that the stage before it kept, and the folder of the
other tables; its result is written as Parquet and read again as the next one's documents. All but
the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.llm import decontaminate, line_dedup, ngram_join, packing, quality_rules
from workweave.llm.queries import tokenizer
from workweave.llm.tables import save, table


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that a base rule or a risk-controlled rule rejects go."""
    return quality_rules.kept_rows(docs, table(spark, folder, "labels"))


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Lines that another line stands for go; so do documents left without a word by that."""
    cut = line_dedup.rewritten(docs)
    left = cut.where("__n_removed = 0 or __n_removed < __n_lines")
    chars = F.when(F.col("__n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", chars.cast(docs.schema["n_chars"].dataType)).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component of similar documents the one with the least id stays."""
    return ngram_join.one_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return docs.where(~decontaminate.holds_any(F.col("text").cast("string"),
                                               table(spark, folder, "benchmark")))


def packed(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", decontaminated),
    ("best-fit packing", packed),
]

#: MinHash, union-find, byte-pair encoding and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, folder), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, folder)
