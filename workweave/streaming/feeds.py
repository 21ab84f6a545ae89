"""Event feeds: latest state, bursts, running totals, revision feed and offline queue."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from workweave.streaming.runner import latest_updates, rocksdb_state, to_table


def latest_state(events: DataFrame, keys: list[str], order: str, value: str, label: str) -> DataFrame:
    """Newest value per key, kept up to date (update mode)."""
    newest = events.groupBy(*keys).agg(
        F.max(order).alias(order), F.max_by(value, order).alias(value))
    return latest_updates(newest, label, keys)


def bursts(events: DataFrame, key: str, value: str, gap: str) -> DataFrame:
    """One row per burst: the last value of a series without a pause of ``gap``.

    The same expression serves batch and stream; a stream needs a watermark on ``ts``.
    """
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(
        F.count("*").alias("edits"), F.max_by(value, F.struct("ts", "seq")).alias(value)
    ).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "edits", value)


def closed_bursts(events: DataFrame, key: str, value: str, gap: str, delay: str, label: str
                  ) -> DataFrame:
    """Streaming bursts: only those the watermark has passed are written."""
    return to_table(bursts(events.withWatermark("ts", delay), key, value, gap), label)


def running_totals(events: DataFrame, key: str, values: dict[str, Column], label: str,
                   alert: Column | None = None) -> DataFrame:
    """Running aggregates per key (update mode); ``alert`` keeps the rows to act on."""
    totals = latest_updates(events.groupBy(key).agg(*[v.alias(n) for n, v in values.items()]),
                            label, [key])
    return totals if alert is None else totals.filter(alert)


def first_asked(events: DataFrame, keys: list[str], delay: str, label: str) -> DataFrame:
    """Misses of a cache whose entries expire with the watermark rather than by their age."""
    fresh = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)
    return to_table(fresh, label)


class _Rebase(StatefulProcessor):
    """One row of a copy: what the store last said of it, and what stands here.

    Rows are JSON texts; null where a side has no such row. ``at`` is the order of the last
    revision, so that one which comes late changes nothing.
    """

    def init(self, handle) -> None:
        self.row = handle.getValueState("row", "at long, there string, here string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        first = initialState.iloc[0]
        self.row.update((-(1 << 62), _text(first["there"]), _text(first["here"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the revisions of one key in a micro-batch, whose size the source's rate limit bounds
        pdf = pd.concat(list(rows)).sort_values("at")
        at, there, here = self.row.get() if self.row.exists() else (-(1 << 62), None, None)
        for when, new in zip(pdf["at"], pdf["there"], strict=True):
            if when > at:
                if here is None:
                    here = new if there is None else None
                elif here == there:
                    here = new
                at, there = int(when), new
        self.row.update((at, there, here))
        yield pd.DataFrame([(*key, here)])

    def close(self) -> None:
        pass


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


def follow_revisions(stream: DataFrame, base: DataFrame, mine: DataFrame, keys: list[str],
                     order: str, label: str) -> DataFrame:
    """Apply a feed of row revisions to a local copy with unsent edits.

    Every revision becomes the common state of its row, over which the unsent edit is kept: a row
    edited here stays as it is, one deleted here stays deleted, all others follow the store. The
    common and the local version of each row are keyed state, begun with ``base`` and ``mine``, so
    a batch costs what its own rows cost, and the result is the same however the feed is cut into
    batches. A revision older than one that was applied changes nothing.
    """
    columns = [c for c in mine.columns if c not in keys]
    row = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    feed = stream.select(*keys, F.col(order).cast("long").alias("at"), row.alias("there"))
    start = base.select(*keys, row.alias("there")).join(
        mine.select(*keys, row.alias("here")), keys, "full")
    types = [f"{k} {mine.schema[k].dataType.simpleString()}" for k in keys]
    with rocksdb_state(stream.sparkSession):
        changed = latest_updates(feed.groupBy(*keys).transformWithStateInPandas(
            statefulProcessor=_Rebase(), outputStructType=", ".join([*types, "here string"]),
            outputMode="update", timeMode="none", initialState=start.groupBy(*keys)), label, keys)
    payload = StructType([mine.schema[c] for c in columns])
    touched = changed.filter("here is not null").select(
        *keys, F.from_json("here", payload).alias("v")).select(*keys, "v.*")
    return mine.select(*keys, *columns).join(changed.select(*keys), keys, "left_anti").unionByName(
        touched)


def offline_queue(stream: DataFrame, keys: list[str], order: str, label: str) -> DataFrame:
    """Edits that arrive late and out of order are merged, never dropped.

    No watermark: the newest edit per key by ``order`` is keyed state that no time ends.
    """
    columns = [c for c in stream.columns if c not in keys]
    newest = stream.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("v")).select(
        *keys, "v.*")
    return latest_updates(newest, label, keys)
