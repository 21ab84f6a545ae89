"""Rules that need the state of a key: attempt throttling and the expiring cache.

Each rule is a small step function. The streaming form keeps the state in a state store;
the batch form cuts every key's history into independent chains and walks each chain in
time order with constant memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from workweave.operators import sequences as S
from workweave.sources.reference import CACHE_HOURS

# A step maps (state or None, time in seconds, success flag) to (state or None, outcome).
Step = Callable[[tuple | None, float, bool], tuple[tuple | None, str]]


@dataclass(frozen=True)
class Throttle:
    """Block after ``limit`` failures within ``window`` seconds, for ``block`` seconds.

    A success clears the record; attempts while blocked are turned away and not counted.
    """

    limit: int = 8
    window: float = 600
    block: float = 600

    # times of the failures that count, oldest first
    state_schema = "failures array<double>"

    @property
    def memory(self) -> float:
        """Seconds without an event after which nothing is remembered."""
        return max(self.window, self.block)

    def __call__(self, state, now, success):
        failures = list(state[0]) if state else []
        if len(failures) >= self.limit and now < failures[-1] + self.block:
            return (failures,), "blocked"
        if success:
            return None, "ok"
        recent = failures if failures and failures[0] >= now - self.window else []
        return ([*recent, now],), "failed"


@dataclass(frozen=True)
class ExpiringCache:
    """A key misses, is stored, then hits for ``hours`` after it was written."""

    hours: float = CACHE_HOURS

    state_schema = "written double"

    @property
    def memory(self) -> float:
        return self.hours * 3600

    def __call__(self, state, now, _success):
        if state and state[0] > now - self.memory:
            return state, "hit"
        return (now,), "miss"


OUTPUT = "seq long, outcome string"


def _walk(step: Step, keys: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches):
        current, state = None, None
        for pdf in batches:
            outcomes = []
            for *place, at, success in zip(*(pdf[k] for k in keys), pdf["chain"], pdf["at"],
                                           pdf["success"]):
                if place != current:
                    current, state = place, None
                state, outcome = step(state, at, success)
                outcomes.append(outcome)
            yield pdf[keys].assign(seq=pdf["seq"], outcome=outcomes)

    return run


def replay(events: DataFrame, keys: list[str], rule, block_seconds: int = 6 * 3600) -> DataFrame:
    """Batch form: (keys, seq, outcome) for events ``keys, seq, at, success``.

    ``at`` is in seconds. A pause longer than the rule's memory leaves no state, so it
    starts a new chain; chains are found by block scans and spread over the cluster, a busy
    key included. Rows stream through a task in time order.
    """
    block = F.floor(F.col("at") / block_seconds)
    order = F.struct("at", "seq")
    timed = events.withColumn("place", order)
    before = S.running_max(timed, keys, ["place"], block, {"prev": order}, current=False)
    pause = F.coalesce(F.col("at") - F.col("prev.at") > rule.memory, F.lit(True))
    headed = before.withColumn("head", F.when(pause, F.col("place")))
    chained = S.running_max(headed, keys, ["place"], block, {"chain": F.col("head")})
    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return (
        chained.select(*keys, F.col("chain.seq").alias("chain"), "seq", "at", "success")
        .repartition(*keys, "chain").sortWithinPartitions(*keys, "chain", "at", "seq")
        .mapInPandas(_walk(rule, keys), f"{types}, {OUTPUT}")
    )


class _Processor(StatefulProcessor):
    """Walks a micro-batch of one key in time order; the state outlives the batch."""

    def __init__(self, rule, keys: list[str]):
        self.rule, self.keys = rule, keys

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", self.rule.state_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # the rows of one micro-batch, whose size the source's rate limit bounds; most keys have
        # few, so a key is handled as plain arrays and asks for its state once
        parts = list(rows)
        at, seq, success = (np.concatenate([p[c].to_numpy() for p in parts])
                            for c in ("at", "seq", "success"))
        order = np.lexsort((seq, at))
        before = self.state.get()
        state = before
        outcomes = []
        for now, well in zip(at[order].tolist(), success[order].tolist()):
            state, outcome = self.rule(state, float(now), bool(well))
            outcomes.append(outcome)
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        yield pd.DataFrame({**dict(zip(self.keys, key)), "seq": seq[order], "outcome": outcomes})

    def close(self) -> None:
        pass


def follow(events: DataFrame, keys: list[str], rule) -> DataFrame:
    """Streaming form of ``replay``; run it with the RocksDB state store."""
    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return events.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Processor(rule, keys), outputStructType=f"{types}, {OUTPUT}",
        outputMode="append", timeMode="none")
