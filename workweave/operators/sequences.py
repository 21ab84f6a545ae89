"""Running totals and predecessors over long ordered sequences.

A window partitioned by a key puts all rows of that key into one task. Here every key is
also cut into blocks of its order column: rows are scanned within (key, block), block totals
are scanned per key, and the two are combined. Block totals are themselves cut into blocks
of blocks where a key may have very many, so no task sees more than one block of anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 65_536
BLOCKS_OF_BLOCKS = 4_096


def block_of(order: str, size: int = BLOCK) -> Column:
    """Block number of a dense integer order column."""
    return F.floor(F.col(order) / size)


def _scan(df: DataFrame, keys: list[str], order: list[str], block: Column,
          values: dict[str, Column], fold: Callable, combine: Callable, current: bool,
          levels: int) -> DataFrame:
    number = f"_block{levels}"
    rows = df.withColumn(number, block)
    cut = [*keys, number]
    totals = rows.groupBy(*cut).agg(*[fold(v).alias(f"_t_{n}") for n, v in values.items()])
    sums = {f"_c_{n}": F.col(f"_t_{n}") for n in values}
    if levels > 1:
        carried = _scan(totals, keys, [number], F.floor(F.col(number) / BLOCKS_OF_BLOCKS), sums,
                        fold, combine, False, levels - 1).select(*cut, *sums)
    else:
        earlier = W.partitionBy(*keys).orderBy(number).rowsBetween(W.unboundedPreceding, -1)
        carried = totals.select(*cut, *[fold(v).over(earlier).alias(n) for n, v in sums.items()])
    inside = W.partitionBy(*cut).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if current else -1)
    return (
        rows.join(carried, cut)
        .select(*df.columns, *[
            combine(F.col(f"_c_{n}"), fold(v).over(inside)).alias(n) for n, v in values.items()])
    )


def running_sums(df: DataFrame, keys: list[str], order: list[str], block: Column,
                 values: dict[str, Column], current: bool = True, levels: int = 1) -> DataFrame:
    """Adds a running sum per entry of ``values``; ``current=False`` leaves the row out."""
    zero = F.lit(0)
    return _scan(df, keys, order, block, values, F.sum,
                 lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), current, levels)


def running_max(df: DataFrame, keys: list[str], order: list[str], block: Column,
                values: dict[str, Column], current: bool = True, levels: int = 1) -> DataFrame:
    """Adds a running maximum per entry of ``values`` (nulls are passed over)."""
    return _scan(df, keys, order, block, values, F.max,
                 lambda a, b: F.greatest(a, b), current, levels)


def previous(df: DataFrame, keys: list[str], order: str, block: Column, columns: list[str]
             ) -> DataFrame:
    """Adds ``prev``: the struct (order, columns) of the row before, or null."""
    row = F.struct(order, *columns)
    return running_max(df, keys, [order], block, {"prev": row}, current=False, levels=2)
