"""Best-fit packing: documents as token sequences of bounded length with little left free.

A document is its byte-level BPE tokens and an end token. One longer than a sequence is cut into
whole sequences, with the odd piece first. Pieces go, longest first, each into the open sequence
with the least room that holds it, or else into a new one.

Pieces of one length are alike, so best-fit decreasing runs over the lengths and not the pieces:
open sequences are kept by their free room, and a segment tree over the rooms finds the tightest
one that fits in logarithmic time. Its input is one count per length, which no corpus outgrows;
its output, ranges of piece ranks that go to ranges of sequences, is joined back to the pieces.
Ranks are counted per task and added up, so no length is gathered in one task.

Null texts count as empty and become their end token alone; ``doc_id`` may be null or repeat. Other
columns are ignored. Special tokens' names in a text are ordinary text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm.tables import batches_of, documents, save
from workweave.llm.tokens import Tokens
from workweave.llm.words import pieces

LENGTH = 2048
END = 0


class RoomTree:
    """Segment tree over the rooms 0 .. size: which hold an open sequence, and the least from one on."""

    def __init__(self, size: int):
        self.leaves = 1 << (size + 1).bit_length()
        self.any = [False] * (2 * self.leaves)

    def put(self, room: int, is_open: bool) -> None:
        node = room + self.leaves
        self.any[node] = is_open
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def least(self, room: int) -> int | None:
        """The least room of an open sequence that is not below ``room``."""
        node = room + self.leaves
        if self.any[node]:
            return room
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan(counts: dict[int, int], length: int = LENGTH
         ) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing for ``counts[size]`` pieces of each size.

    Returns rows ``size, first_rank, last_rank, sequence, each, offset``: the pieces of a size with
    ranks from first to last (exclusive) go to consecutive sequences from ``sequence`` on, ``each``
    of them one after another into a sequence from ``offset`` on.
    """
    tree, rooms = RoomTree(length), {}  # room -> ranges (first sequence, number) of open sequences
    rows, new = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room > 0 and n > 0:
            rooms.setdefault(room, []).append((first, n))
            tree.put(room, True)

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            room = tree.least(size)
            if room is None:
                each = length // size
                n = -(-left // each)
                first, new, room = new, new + n, length
            else:
                first, n = rooms[room].pop()
                each = room // size
                if not rooms[room]:
                    tree.put(room, False)
            # a piece in a sequence makes it the tightest, so it takes pieces until it is full
            full = min(n, left // each)
            offset = length - room
            if full:
                rows.append((size, rank, rank + full * each, first, each, offset))
                rank, left = rank + full * each, left - full * each
                leave(room - each * size, first, full)
            if full < n and left:  # fewer pieces than the next sequence would take
                rows.append((size, rank, rank + left, first + full, left, offset))
                leave(room - left * size, first + full, 1)
                full, left = full + 1, 0
            if room < length:
                leave(room, first + full, n - full)
    return rows


def _cut(path: str, length: int) -> Callable:
    """Pieces of documents, with their rank among the pieces of the task that are as long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path)
        met = np.zeros(length + 1, dtype=np.int64)  # pieces of each length so far
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids, first = tokens.encode(part.column("text"), END)
                size = np.diff(first)
                n = -(-size // length)
                row = np.repeat(np.arange(size.size), n)
                number = np.arange(row.size) - np.repeat(np.cumsum(n) - n, n)
                odd = size - (n - 1) * length
                start = np.where(number == 0, 0, odd[row] + (number - 1) * length)
                long = np.where(number == 0, odd[row], length)
                data, at = ids.astype("<u4").tobytes(), first[row] + start
                crc = [zlib.crc32(data[4 * a: 4 * (a + m)]) for a, m in zip(at, long, strict=True)]
                by = np.argsort(long, kind="stable")
                same = np.searchsorted(long[by], long[by])
                rank = np.empty(long.size, dtype=np.int64)
                rank[by] = np.arange(long.size) - same
                rank += met[long]
                met += np.bincount(long, minlength=length + 1)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), pa.array(number.astype(np.int32)),
                    pa.array(start.astype(np.int64)), pa.array(long.astype(np.int64)),
                    pa.array(crc, pa.int64()), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "rank"])

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    ``path`` is a ``tokenizers`` file that every task can open.
    """
    docs = documents(docs)
    with batches_of(docs, 2000):
        cut = save(docs.mapInArrow(_cut(path, length), "doc_id long, piece int, start long, "
                                   "length long, ids_crc32 long, rank long")
                   .withColumn("part", F.spark_partition_id()), "pieces")
    sizes = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")
                             .rowsBetween(Window.unboundedPreceding, -1))
    base = save(sizes.withColumn("base", F.coalesce(before, F.lit(0))), "ranks")
    counts = base.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row per length
    spark = docs.sparkSession
    steps = spark.createDataFrame(
        plan({r.length: r.n for r in counts}, length) or [],
        "length long, first long, last long, sequence long, each long, offset long")
    ranked = cut.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    # steps of a length lie end to end: the step of a rank is found by their number alone
    found = ranked.join(F.broadcast(_lists(steps)), "length", "left")
    step = F.get("steps", F.size("steps") - 1 - F.size(F.filter(
        "steps", lambda s: s["first"] > F.col("rank"))))
    within = F.col("rank") - F.col("step.first")
    turn = F.pmod(within, F.col("step.each"))
    return found.withColumn("step", step).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("step.sequence") + (within - turn) / F.col("step.each")).cast("long")
        .alias("sequence_id"),
        (F.col("step.offset") + turn * F.col("length")).alias("offset"))


def _lists(steps: DataFrame) -> DataFrame:
    """One row per length with its steps in order; a few steps a length, whatever the corpus."""
    return steps.groupBy("length").agg(F.sort_array(F.collect_list(
        F.struct("first", "last", "sequence", "each", "offset"))).alias("steps"))
