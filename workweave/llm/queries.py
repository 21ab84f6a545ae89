"""One query per operator, over the whole table it is meant for, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from workweave.llm import (bbit_minhash, decontaminate, html_text, license_scan, line_dedup,
                           ngram_join, packing, passage_dedup, periodic_runs, quality_model,
                           quality_rules, url_filter, whitening)
from workweave.llm.sql import STATEMENTS
from workweave.llm.tables import table

__all__ = ["QUERIES", "STATEMENTS"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the lines that stay."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


@query
def op2_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its set size and its component of similar documents."""
    return ngram_join.components(table(spark, folder, "documents")).select(
        "doc_id", "n_shingles", "component_id")


@query
def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its license phrases and templates."""
    return license_scan.scan(table(spark, folder, "documents")).drop("blocks")


@query
def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its counts and the verdict of the rules."""
    return quality_rules.judge(table(spark, folder, "documents"),
                               table(spark, folder, "labels")).drop("failed")


@query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item that a document holds."""
    return decontaminate.contamination(table(spark, folder, "documents"),
                                       table(spark, folder, "benchmark"))


@query
def op6_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every passage that repeats across documents, in each of them."""
    return passage_dedup.passages(table(spark, folder, "documents"))


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op7_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, folder, "documents"), tokenizer())


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its host, path and verdict."""
    return url_filter.judge(table(spark, folder, "pages"))


@query
def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its main text."""
    return html_text.extract(table(spark, folder, "pages"))


def held_out() -> Column:
    """Documents that no classifier learns from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


@query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its quality score."""
    return quality_model.classify(table(spark, folder, "documents"),
                                  table(spark, folder, "labels"), held_out())


@query
def op11_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of near copies, and whether it stands for it."""
    return bbit_minhash.near_copies(table(spark, folder, "documents"))


@query
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, a tenth of them with a loop at the end, with digests of its periodic runs."""
    found = periodic_runs.scan(periodic_runs.looped(table(spark, folder, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector on the first components, with the share that each of them explains."""
    vectors = table(spark, folder, "embeddings")
    fitted = whitening.fit(vectors)
    share = F.array(*[F.lit(x) for x in fitted.explained]).cast("array<double>")
    return (fitted.transform(vectors)
            .select("vec_id", "n", "deviation", F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"),
                    F.lit(fitted.identity_error(vectors)).cast("double").alias("identity_error")))
