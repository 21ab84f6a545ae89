import random

import pytest
from pyspark.sql import functions as F

from workweave.streaming import feeds, runner
from workweave.streaming import stateful as X

SCHEMA = "user string, seq long, at double, success boolean"


def _events(n=400):
    rnd = random.Random(1)
    at, rows = 0.0, []
    for i in range(n):
        at += rnd.choice([1, 20, 300, 2000])
        rows.append((rnd.choice("aaab"), i, at, rnd.random() < 0.2))
    return rows


def _sequential(rows, rule):
    state, out = {}, {}
    for user, seq, at, ok in rows:
        state[user], out[seq] = rule(state.get(user), at, ok)
    return out


RULES = [X.Throttle(limit=3, window=600, block=600), X.ExpiringCache(hours=0.5)]


@pytest.mark.parametrize("rule", RULES)
def test_replay_matches_sequential(spark, rule):
    rows = _events()
    got = X.replay(spark.createDataFrame(rows, SCHEMA), ["user"], rule, block_seconds=500).collect()
    want = _sequential(rows, rule)
    assert {r.seq: r.outcome for r in got} == want
    assert len(set(want.values())) >= 2


def test_throttle_rule_by_hand():
    rule = X.Throttle(limit=2, window=100, block=50)
    steps = [(0, False), (10, False), (20, True), (59, False), (61, False), (200, True), (201, False)]
    state, seen = None, []
    for at, ok in steps:
        state, outcome = rule(state, at, ok)
        seen.append(outcome)
    assert seen == ["failed", "failed", "blocked", "blocked", "failed", "ok", "failed"]


def test_stream_in_many_batches_equals_replay(spark, tmp_path):
    rows = _events(120)
    for k in range(4):
        spark.createDataFrame(rows[k * 30:(k + 1) * 30], SCHEMA).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    rule = RULES[0]
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with runner.rocksdb_state(spark):
        got = runner.to_table(X.follow(stream, ["user"], rule), "t")
    assert {r.seq: r.outcome for r in got.collect()} == _sequential(rows, rule)


def test_late_edits_are_kept(spark, tmp_path):
    rows = [(k, i, f"v{i}") for i, k in enumerate([1, 2, 1, 3, 2, 1])]
    random.Random(2).shuffle(rows)
    for r in rows:
        spark.createDataFrame([r], "k int, seq int, v string").coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k int, seq int, v string").option(
        "maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = feeds.offline_queue(stream, ["k"], "seq", "q")
    assert {r.k: r.v for r in got.collect()} == {1: "v5", 2: "v4", 3: "v3"}


def test_latest_state_over_batches(spark, tmp_path):
    for i, state in enumerate(["PENDING", "DISPATCHED", "PASS"]):
        spark.createDataFrame([("t", i, state), (f"u{i}", i, state)], "task string, seq int, state string"
                              ).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("task string, seq int, state string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = feeds.latest_state(stream, ["task"], "seq", "state", "s")
    assert {r.task: r.state for r in got.collect()} == {
        "t": "PASS", "u0": "PENDING", "u1": "DISPATCHED", "u2": "PASS"}


def _written(spark, path, rows, schema):
    """One file per row, in this order."""
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("files", [1, 3, 100])
def test_revision_feed_over_batches(spark, tmp_path, files):
    base = spark.createDataFrame([(1, "x", 1), (2, "x", None), (3, "x", 3), (5, "x", 5), (6, "x", 6)], "k int, v string, n int")
    mine = spark.createDataFrame([(1, "mine", 1), (2, "x", None), (5, "x", 5), (6, "own", 6), (7, "new", 7)],
                                 "k int, v string, n int")
    feed = [(1, "t1", 1, 1), (2, "t2", 2, 2), (3, "t3", 3, 3), (4, "t4", 4, 4), (2, "t5", None, 6), (3, "t6", 3, 7),
            (2, "late", 9, 5), (1, "t8", 8, 8), (4, "t9", 9, 9)]
    schema = "k int, v string, n int, rev int"
    _written(spark, str(tmp_path / "in"), feed, schema)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "in"))
    got = feeds.follow_revisions(stream, base, mine, ["k"], "rev", "f")
    assert got.columns == ["k", "v", "n"]
    assert {r.k: (r.v, r.n) for r in got.collect()} == {
        1: ("mine", 1), 2: ("t5", None), 4: ("t9", 9), 5: ("x", 5), 6: ("own", 6), 7: ("new", 7)}


def test_views_read_few_runs(spark, tmp_path):
    rows = [(f"k{i % 3}", i) for i in range(11)]
    _written(spark, str(tmp_path / "in"), rows, "k string, n int")
    stream = spark.readStream.schema("k string, n int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = feeds.running_totals(stream, "k", {"n": F.sum("n"), "c": F.count("*")}, "totals")
    want = {}
    for k, n in rows:
        want[k] = (want.get(k, (0, 0))[0] + n, want.get(k, (0, 0))[1] + 1)
    assert {r.k: (r.n, r.c) for r in got.collect()} == want
    # eleven batches are a run of eight, of two and of one; older runs are gone but for one batch's
    runs = {f.split("/rows/")[1].split("/")[0] for f in got.inputFiles()}
    assert runs == {"0-7", "8-9", "10-10"}
    root = next(iter(got.inputFiles())).removeprefix("file://").split("/rows/")[0]
    import os
    assert set(os.listdir(f"{root}/rows")) == {"0-7", "8-9", "10-10"}


def test_runs_of_a_binary_counter():
    assert runner._runs(0) == [] and runner._runs(1) == [(0, 0)]
    assert runner._runs(6) == [(0, 3), (4, 5)]
    for n in range(1, 200):
        runs = runner._runs(n)
        assert runs[0][0] == 0 and runs[-1][1] == n - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(runs, runs[1:]))


def test_a_repeated_batch_changes_nothing(spark, tmp_path, monkeypatch):
    """A batch that is run again, as after a lost driver, finds all it needs."""
    seen = []

    def twice(stream, label, handle, mode="append"):
        root = str(tmp_path / "twice")
        for number in range(7):
            df = spark.createDataFrame([("a", number), (f"b{number % 2}", number)], "k string, n int")
            handle(df, number, root)
            handle(df, number, root)
            seen.append(number)
        return root

    monkeypatch.setattr(runner, "each_batch", twice)
    view = runner.latest_updates(spark.createDataFrame([], "k string, n int"), "x", ["k"])
    assert seen and {r.k: r.n for r in view.collect()} == {"a": 6, "b0": 6, "b1": 5}


def test_bursts_in_batch(spark):
    rows = [("c", i, f"2024-01-01 00:{m:02d}:00", f"p{i}") for i, m in enumerate([0, 4, 8, 20, 21])]
    df = spark.createDataFrame(rows, "client string, seq int, ts string, data string").withColumn(
        "ts", F.col("ts").cast("timestamp"))
    got = feeds.bursts(df, "client", "data", "5 minutes").orderBy("start").collect()
    assert [(r.edits, r.data) for r in got] == [(3, "p2"), (2, "p4")]


def test_a_key_asks_for_its_state_once(spark):
    import pandas as pd

    from workweave.streaming import stateful

    class Value:
        held, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.held

        def exists(self):
            self.calls.append("exists")
            return self.held is not None

        def update(self, new):
            self.calls.append("update")
            self.held = new

        def clear(self):
            self.calls.append("clear")
            self.held = None

    step = stateful._Processor(stateful.ExpiringCache(hours=1), ["user"])
    step.state = state = Value()

    def ask(*rows):
        parts = [pd.DataFrame([("u", *r, True)], columns=["user", "at", "seq", "success"]) for r in rows]
        return [tuple(r) for out in step.handleInputRows(("u",), iter(parts), None) for r in out.itertuples(index=False)]

    assert ask((50.0, 2), (0.0, 1)) == [("u", 1, "miss"), ("u", 2, "hit")]
    assert ask((60.0, 3)) == [("u", 3, "hit")]
    assert state.calls == ["get", "update", "get"]
