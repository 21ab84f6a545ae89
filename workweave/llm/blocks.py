"""Rows of numbers that are dealt by a key as blocks of bytes.

Many short rows cost a shuffle more than what they hold. So a task packs its rows: for each part of
the keys one row, with the values of a column end to end. All rows of a key reach one task, which
takes them part by part as arrays. A part holds some ``PART_BYTES`` of text's rows, however large the
input is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from workweave.llm.words import unsigned

#: Rows that a task packs at a time.
PACKED = 1 << 17
#: Parts at least, and bytes of text to a part of more.
PARTS, PART_BYTES = 256, 1 << 25
#: Blocks in an Arrow batch; texts come in batches of as many rows.
BATCH = 128


def parts(docs: DataFrame) -> int:
    """How many parts the keys of these texts are dealt in."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(PARTS, -(-total // PART_BYTES))


def packed(run: Callable, count: int, key: str) -> Callable:
    """The rows that ``run`` makes, packed by ``key`` in blocks of ``count`` parts."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in run(batches):
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACKED:
                yield _blocks(held, count, key)
                held, rows = [], 0
        if rows:
            yield _blocks(held, count, key)

    return pack


def blocks(rows: DataFrame, run: Callable, count: int, key: str, columns: list[str]) -> DataFrame:
    """The rows that ``run`` makes of ``rows``, in blocks."""
    schema = ", ".join(["part int", *[f"{c} binary" for c in columns]])
    return rows.mapInArrow(packed(run, count, key), schema)


def dealt(made: DataFrame) -> DataFrame:
    """The blocks of each part together in a task."""
    return made.repartition("part").sortWithinPartitions("part")


def gathered(batches: Iterator[pa.RecordBatch], **kinds: type) -> Iterator[list[np.ndarray]]:
    """The columns of each part, as numbers of these kinds."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        part = batch.column("part").to_numpy()
        cuts = np.flatnonzero(part[1:] != part[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, part.size], strict=True):
            if a == b:
                continue
            if held and part[a] != now:
                yield _whole(held, kinds)
                held = []
            now = part[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield _whole(held, kinds)


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in the bytes of all rows end to end, and how many each row has."""
    _, offsets, data = column.buffers()
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(offsets, dtype=width)[column.offset: column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0]: at[-1]].view(kind), np.diff(at).astype(np.int64) // np.dtype(kind).itemsize


def in_rows(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the numbers from each start to the next one."""
    at = np.append(starts, values.size) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), starts.size, [
        None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def opens(*keys: np.ndarray) -> np.ndarray:
    """Whether a row of sorted ``keys`` differs from the one before."""
    new = np.zeros(keys[0].size, dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def met(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Of keys that two rows or more have, the rows side by side."""
    order = np.argsort(key)
    new = opens(key[order])
    order = order[~(new & np.append(new[1:], True)[: new.size])]
    return [x[order] for x in (key, *columns)]


def _whole(held: list[pa.RecordBatch], kinds: dict[str, type]) -> list[np.ndarray]:
    return [np.concatenate([numbers(b.column(name), kind)[0] for b in held])
            for name, kind in kinds.items()]


def _blocks(held: list[pa.RecordBatch], count: int, key: str) -> pa.RecordBatch:
    values = {name: np.concatenate([b.column(name).to_numpy() for b in held])
              for name in held[0].schema.names}
    part = (unsigned(values[key]) % np.uint64(count)).astype(np.uint16 if count < 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(opens(part))
    return pa.RecordBatch.from_arrays(
        [pa.array(part[at].astype(np.int32)), *[in_rows(x[order], at) for x in values.values()]],
        names=["part", *values])
