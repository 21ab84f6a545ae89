"""Line dedup: near-equal lines by character shingles, one line of each component stays.

A line is compared after lower-casing, with runs of white space as one space and none at its ends.
Its set holds its distinct 9-character shingles (a shorter line is one shingle). MinHash bands
propose pairs, the exact Jaccard similarity of the sets decides (0.8 or more), and union-find
joins what links. Equal lines are one node from the start. The line that stays is that of the
least ``doc_id``, then the least line number; blank lines are left alone.

Lines are parted by ``\\n``. A null text has no lines and stays null, an empty one stays empty; a
null ``doc_id`` counts as the least. Rows that repeat with the same id and text are one document
and keep the same lines. ``rewritten`` passes other columns through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm.components import resolve
from workweave.llm.minhash import bands, colliding, tune_bands
from workweave.llm.tables import batches_of, documents, passing, save
from workweave.llm.words import pieces, run_hash, signed, window_hash

SHINGLE = 9
#: Lines link from a Jaccard similarity of PART / WHOLE on.
PART, WHOLE = 80, 100
RECALL, ROWS = 0.995, 4


def normal(line: str) -> str:
    """A line as it is compared."""
    return " ".join(line.lower().split())


class Lines:
    """The lines of a batch that hold text: row, line number, normal form and its hash."""

    def __init__(self, texts: pa.Array):
        self.row: list[int] = []
        self.number: list[int] = []
        self.text: list[str] = []
        for row, text in enumerate(texts.to_pylist()):
            for number, line in enumerate((text or "").split("\n")):
                form = normal(line)
                if form:
                    self.row.append(row)
                    self.number.append(number)
                    self.text.append(form)
        self.hash = hashes(self.text)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and where each begins (and the last ends)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def hashes(texts: list[str]) -> np.ndarray:
    codes, at = _codes(texts)
    return run_hash(codes.astype(np.uint64) + np.uint64(1), at[:-1], at[1:])


def shingles(texts: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts (none empty) end to end, repeats included, and where each begins.

    A shorter text is filled up with zeros, which no line holds, and so is one shingle.
    """
    codes, at = _codes([t if len(t) >= width else t.ljust(width, "\0") for t in texts])
    size = np.diff(at)
    every = window_hash(codes, width)
    inside = np.repeat(at[1:], size)[: every.size] - np.arange(every.size) >= width
    return every[inside], np.cumsum(size - width + 1) - (size - width + 1)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "text"):
            lines = Lines(piece.column("text"))
            at = pa.array(lines.row, pa.int32())
            yield pa.RecordBatch.from_arrays([
                piece.column("doc_id").take(at), piece.column("text_hash").take(at),
                pa.array(lines.number, pa.int32()), pa.array(signed(lines.hash))],
                names=["doc_id", "text_hash", "line", "node"])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Nodes and normal lines, each once per batch."""
    for batch in batches:
        seen = np.zeros(0, dtype=np.uint64)
        for piece in pieces(batch, "text"):
            lines = Lines(piece.column("text"))
            nodes, first = np.unique(lines.hash, return_index=True)
            new = ~np.isin(nodes, seen, assume_unique=True)
            seen = np.concatenate([seen, nodes[new]])
            if new.any():
                yield nodes[new], [lines.text[i] for i in first[new]]


def _banded(count: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, texts in _distinct(batches):
            keys = bands(*shingles(texts), count, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(keys.ravel())), pa.array(signed(np.repeat(nodes, count)))],
                names=["bucket", "node"])

    return run


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for nodes, texts in _distinct(batches):
        yield pa.RecordBatch.from_arrays([pa.array(signed(nodes)), pa.array(texts, pa.string())],
                                         names=["node", "item"])


def _sets(lines: pa.Array) -> list[np.ndarray]:
    texts = lines.to_pylist()
    values, starts = shingles(texts)
    return [np.unique(x) for x in np.split(values, starts[1:])] if texts else []


def components(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, text_hash, line, node, root, kept`` for every line that holds text."""
    keyed = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    with batches_of(keyed, 2000):
        lines = save(keyed.mapInArrow(
            _occurrences, "doc_id long, text_hash long, line int, node long"), "lines")
        count = tune_bands(PART / WHOLE, recall, ROWS)
        buckets = save(colliding(keyed.mapInArrow(_banded(count, ROWS), "bucket long, node long")
                                 .withColumn("origin", F.col("node"))), "bands")
        forms = save(keyed.mapInArrow(_forms, "node long, item string")
                     .join(save(buckets.select("node").distinct(), "needed"), "node", "left_semi")
                     .dropDuplicates(["node"]), "forms")

    labels = resolve(buckets, forms, _sets, PART, WHOLE)
    rooted = save(lines.join(labels, "node", "left")
                  .withColumn("root", F.coalesce("root", "node")), "rooted")
    first = save(rooted.groupBy("root").agg(F.min(F.struct("doc_id", "line")).alias("first")),
                 "first")
    return rooted.join(first, "root").select(
        "doc_id", "text_hash", "line", "node", "root",
        F.struct("doc_id", "line").eqNullSafe(F.col("first")).alias("kept"))


def rewritten(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``docs`` with ``text`` less the lines that another one stands for, ``__n_lines`` (that hold
    text) and ``__n_removed``."""
    with passing(docs, "removed"):
        removed = save(components(docs, recall).groupBy("doc_id", "text_hash").agg(
            F.collect_set(F.when(~F.col("kept"), F.col("line"))).alias("__lines"),
            F.countDistinct("line").alias("__n_lines")), "removed").withColumnsRenamed(
            {"doc_id": "__doc", "text_hash": "__hash"})
    text = F.col("text").cast("string")
    joined = docs.join(removed, F.col("doc_id").cast("long").eqNullSafe(F.col("__doc"))
                       & (F.xxhash64(text) == F.col("__hash")), "left")
    parts = F.split(text, "\n")
    rest = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__lines")),
                       lambda i: F.get(parts, i))
    return (joined.withColumn("__n_lines", F.coalesce("__n_lines", F.lit(0)).cast("long"))
            .withColumn("__n_removed", F.greatest(
                F.coalesce(F.size("__lines"), F.lit(0)), F.lit(0)).cast("long"))
            .withColumn("text", F.when(F.col("__n_removed") > 0, F.array_join(rest, "\n"))
                        .otherwise(text))
            .drop("__lines", "__doc", "__hash"))


def dedup(docs: DataFrame, recall: float = RECALL) -> DataFrame:
    """``doc_id, n_lines, n_removed, text``: every document with the lines that stay."""
    return rewritten(documents(docs), recall).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"),
        "text")
