"""MinHash signatures in bands, and how many bands a recall takes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from workweave.llm.words import mix


def tune_bands(threshold: float, recall: float, rows: int) -> int:
    """The fewest bands of ``rows`` values that catch a pair of similarity ``threshold`` with at
    least the probability ``recall``; more similar pairs are caught more often."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))


def bands(values: np.ndarray, starts: np.ndarray, count: int, rows: int) -> np.ndarray:
    """Band keys, one row of ``count`` for each run of hashes that begins at ``starts``.

    Each of ``count * rows`` functions permutes 32-bit hashes; a run's value is its least image.
    """
    rng = np.random.default_rng(20_11)
    low = (values >> np.uint64(32)).astype(np.uint32)
    keys = np.empty((starts.size, count), dtype=np.uint64)
    for band in range(count):
        key = np.full(starts.size, band + 1, dtype=np.uint64)
        for _ in range(rows):
            factor, shift = rng.integers(1, 1 << 32, 2, dtype=np.uint32)
            image = low ^ np.uint32(shift)
            image *= np.uint32(factor | 1)
            least = np.minimum.reduceat(image, starts) if starts.size else image[:0]
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + least)
        keys[:, band] = key
    return keys


def colliding(rows: DataFrame) -> DataFrame:
    """Of ``bucket, node, origin`` the buckets with nodes of two origins or more, each node once.

    Rows come with a node at most once per batch, so a text copied everywhere adds few rows.
    """
    one = Window.partitionBy("bucket")
    spread = [F.min(c).over(one) < F.max(c).over(one) for c in ("node", "origin")]
    return (rows.withColumn("spread", spread[0] & spread[1])
            .where("spread").dropDuplicates(["bucket", "node"])
            .select("bucket", "node", F.lit(None).cast("long").alias("size")))
