"""Lane packing: overlapping entries of a person get their own lanes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from workweave.session import settle

# Entries of one chain that one task packs
PART_ENTRIES = 200_000
# Rounds after which their results become one table
PARTS_TOGETHER = 32


def _chains(absence: DataFrame) -> DataFrame:
    """(person_id, start, chain, entries): which entries hang together by overlap.

    Works on one row per person and start day, so the window stays below one row per day.
    """
    per_start = absence.groupBy("person_id", "start").agg(
        F.max("end").alias("end"), F.count("*").alias("n"))
    w = W.partitionBy("person_id").orderBy("start")
    opens = F.coalesce(
        F.col("start") > F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(True))
    marked = per_start.withColumn("head", F.when(opens, F.col("start"))).withColumn(
        "chain", F.max("head").over(w.rowsBetween(W.unboundedPreceding, 0)))
    whole = W.partitionBy("person_id", "chain")
    return marked.withColumn("entries", F.sum("n").over(whole)).select(
        "person_id", "start", "chain", "entries")


def _first_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Assign lanes to rows sorted by (person, chain, start, ord).

    The state is the set of lanes of the current chain; rows pass through in batches. A row without
    an entry comes first and brings the state that an earlier part of the chain left (the ``lanes``
    in use and their ``ends``, and how many there are). After the last row of a chain its state
    goes out in such a row.
    """
    current, busy, free, used, kinds = None, [], [], 0, None

    def leave(out: list[tuple]) -> None:
        out.append((None, *current, None, [lane for _, lane in busy], [end for end, _ in busy], used))

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out, strict=True) if out else [()] * len(kinds)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    for batch in batches:
        if kinds is None:
            lists = pa.list_(pa.int32())
            kinds = {"absence_id": batch.schema.field("absence_id").type,
                     "person_id": batch.schema.field("person_id").type, "chain": pa.int32(),
                     "lane": pa.int32(), "lanes": lists, "ends": lists, "used": pa.int32()}
        out: list[tuple] = []
        for entry, person, chain, start, end, lanes, ends, had in zip(
                *(batch.column(c).to_pylist() for c in (
                    "absence_id", "person_id", "chain", "start", "end", "lanes", "ends", "used")),
                strict=True):
            if (person, chain) != current:
                if current is not None:
                    leave(out)
                current, busy, free, used = (person, chain), [], [], 0
            if lanes is not None:
                busy, used = list(zip(ends, lanes, strict=True)), had
                heapq.heapify(busy)
                free = sorted(set(range(used)) - set(lanes))
                continue
            while busy and busy[0][0] < start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                lane = heapq.heappop(free)
            else:
                lane, used = used, used + 1
            heapq.heappush(busy, (end, lane))
            out.append((entry, person, chain, lane, None, None, None))
        yield table(out)
    if current is not None:
        out = []
        leave(out)
        yield table(out)


def _packed(rows: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Lanes of ``rows`` and, in rows without an entry, the state after each chain."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in ("absence_id", "person_id")}
    blank = {"lanes": "array<int>", "ends": "array<int>", "used": "int"}
    entries = rows.select(
        "absence_id", "person_id", F.unix_date("chain").alias("chain"),
        F.unix_date("start").alias("start"), F.unix_date("end").alias("end"), "ord",
        *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    if state is not None:
        entries = entries.unionByName(state, allowMissingColumns=True)
    return (
        entries.repartition("person_id", "chain")
        .sortWithinPartitions("person_id", "chain", F.asc_nulls_first("start"), "ord")
        .mapInArrow(_first_fit, f"absence_id {kind['absence_id']}, person_id {kind['person_id']}, "
                     "chain int, lane int, lanes array<int>, ends array<int>, used int")
    )


def _in_parts(rows: DataFrame, size: int) -> DataFrame:
    """Adds ``part``: chains cut into parts of ``size`` entries at most, numbered in order.

    A global sort deals out the rows of a chain by their order, and parts are counted off within
    its partitions, so no chain is gathered for it.
    """
    cut = F.shiftright("id", 33) * F.lit(1 << 33) + F.floor(
        F.col("id").bitwiseAND(F.lit((1 << 33) - 1)) / size)
    ordered = settle(rows.orderBy("person_id", "chain", "start", "ord").withColumn(
        "id", F.monotonically_increasing_id())).withColumn("cut", cut).drop("id")
    # one row per part
    w = W.partitionBy("person_id", "chain").orderBy("cut")
    parts = ordered.select("person_id", "chain", "cut").distinct().withColumn(
        "part", F.row_number().over(w))
    return settle(ordered.join(parts, ["person_id", "chain", "cut"]).drop("cut"))


def assign_lanes(absence: DataFrame, part_size: int = PART_ENTRIES) -> DataFrame:
    """(absence_id, person_id, lane): first lane whose last end lies before the start.

    When nothing of a person is open all lanes are free again, so every chain of
    overlapping entries is packed on its own. An entry that overlaps nothing takes lane 0
    without leaving the JVM.

    A chain of more than ``part_size`` entries is cut into parts wherever that falls. All chains
    give their next part to a round, which hands the ends of the open lanes over to the next one:
    no task takes more than a part, and rounds are as many as the longest chain has parts.
    """
    rows = absence.select("absence_id", "person_id", "ord", "start", "end").join(
        _chains(absence), ["person_id", "start"])
    alone = rows.filter("entries = 1").select("absence_id", "person_id", F.lit(0).alias("lane"))
    short = _packed(rows.filter(F.col("entries").between(2, part_size)))
    found = alone.unionByName(short.filter("lane is not null").select(alone.columns))
    long = rows.filter(F.col("entries") > part_size)
    if long.isEmpty():
        return found
    parts = _in_parts(long.drop("entries"), part_size)
    rounds, state = parts.agg(F.max("part").alias("n")).first().n, None
    for n in range(1, rounds + 1):
        done = settle(_packed(parts.filter(F.col("part") == n).drop("part"), state))
        state = done.filter("lane is null").select("person_id", "chain", "lanes", "ends", "used").join(
            parts.filter(F.col("part") == n + 1).select("person_id", F.unix_date("chain").alias(
                "chain")).distinct(), ["person_id", "chain"], "left_semi")
        found = found.unionByName(done.filter("lane is not null").select(alone.columns))
        if n % PARTS_TOGETHER == 0:
            found = settle(found)
    return found


def lane_counts(lanes: DataFrame) -> DataFrame:
    """(person_id, lanes): how many lanes a person's entries take."""
    return lanes.groupBy("person_id").agg((F.max("lane") + 1).alias("lanes"))
