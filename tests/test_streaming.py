"""Streams that come late and out of order, and batches that are killed and repeated."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from docsieve.operators import state
from docsieve.streaming import ledger, ordered

SCHEMA = "k string, ts timestamp, no long, target string"


def events(seed=1, n=400):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(rng.choice("aaaabcdef"), start + timedelta(minutes=i // 2), i, rng.choice(["parsing", "reviewing", "blocked", "done", "reviewing", "blocked", None])) for i in range(n)]


def test_late_events_take_their_place(spark, tmp_path):
    """Batches in which events are an hour late give what the batch form gives; the state is bounded by the delay."""
    rows, rng = events(), random.Random(2)
    arrived = sorted(rows, key=lambda r: r[2] // 2 + rng.randint(0, 60))
    for i in range(0, len(arrived), 80):
        spark.createDataFrame(arrived[i : i + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with ledger.stream_settings(spark):
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = ordered.replay_ordered(source, "k", "ts", "no", "target", "2 hours")
        ledger.write_stream(told, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    table = spark.read.parquet(str(tmp_path / "out"))
    assert len(ledger.committed(spark, str(tmp_path / "out"))) >= 5
    want = state.replay(spark.createDataFrame(rows, SCHEMA), "k", ["ts", "no"], "target")
    columns = ["k", "state", "accepted", "rejected", "retries"]
    assert sorted(map(tuple, ledger.last_told(table, "k").select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_state_is_settled_and_expires():
    """A timer moves what the watermark has passed; what is told does not change by it."""

    class Value:
        held = None
        exists = lambda self: self.held is not None
        get = lambda self: self.held
        update = put = lambda self, x: setattr(self, "held", x)
        clear = lambda self: setattr(self, "held", None)
        appendList = lambda self, x: setattr(self, "held", [*(self.held or []), *x])  # noqa: E731, N815

    class Handle:
        ttl, timers = [], []

        def getValueState(self, name, schema, ttlDurationMs):  # noqa: N802, N803
            self.ttl.append(ttlDurationMs)
            return Value()

        getListState = getValueState  # noqa: N815
        registerTimer = lambda self, at: self.timers.append(at)  # noqa: E731, N815

    class Timers:
        def __init__(self, at):
            self.getCurrentWatermarkInMs = lambda: at

    import pandas as pd

    replay = ordered.OrderedReplay("k", "pending", state.transition_moves(), 1000)
    replay.init(handle := Handle())
    assert handle.ttl == [1000, 1000]
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["event_micros", "event_place", "event_name"])])
    tell = lambda *rows: next(replay.handleInputRows(("a",), frame(*rows), None)).to_numpy().tolist()[0][1:]
    assert tell((3_000_000, 1, "reviewing")) == ["pending", 0, 1, 0]
    assert tell((1_000_000, 0, "parsing")) == ["reviewing", 2, 0, 0]  # it comes late and takes its place
    list(replay.handleExpiredTimer(("a",), Timers(2_000), None))
    assert replay.settled.held == ("parsing", 1, 0, 0) and [e[2] for e in replay.waiting.held] == ["reviewing"] and set(handle.timers) == {1001, 3001}
    assert tell((4_000_000, 2, "done")) == ["done", 3, 0, 0]
    list(replay.handleExpiredTimer(("a",), Timers(9_000), None))
    assert replay.settled.held == ("done", 3, 0, 0) and replay.waiting.held is None


def test_batches_are_added_once(spark, tmp_path):
    table = str(tmp_path / "table")
    rows = lambda a, b: spark.range(a, b)
    assert ledger.committed(spark, table) == []
    assert ledger.commit(rows(0, 10), 0, table) and not ledger.commit(rows(0, 10), 0, table)
    rows(50, 60).write.parquet(f"{table}/_aside/killed")  # a batch that was killed before its rename
    assert ledger.commit(rows(10, 15), 7, table)
    assert ledger.committed(spark, table) == [0, 7]
    assert sorted(r["id"] for r in spark.read.parquet(table).collect()) == list(range(15))


def test_a_killed_stream_is_run_again(spark, tmp_path):
    """A batch fails after it has been added: run again, it is not added twice."""
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / x) for x in ("table", "checkpoint")]
    source = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def killed(batch, n):
        ledger.commit(batch, n, paths[0])
        if n == 1:
            raise RuntimeError("killed")

    query = source().writeStream.option("checkpointLocation", paths[1]).trigger(availableNow=True).foreachBatch(killed).start()
    try:
        query.awaitTermination()
    except Exception as e:
        assert "killed" in str(e)
    assert ledger.committed(spark, paths[0]) == [0, 1]
    ledger.write_stream(source(), *paths, mode="append")
    assert sorted(r["id"] for r in spark.read.parquet(paths[0]).collect()) == list(range(30))


def test_records_after_failures(spark):
    rows = [(1, "a", 1, "n1", "s1", None), (1, "a", 2, "n2", None, "E: x"), (2, "b", 1, "n", None, "E: y"), (3, "c", 1, "n", None, "E"), (3, "c", 2, "m", "s", None)]
    df = spark.createDataFrame(rows, "task long, att string, no int, file_name string, sha256 string, error string")
    got = {r["task"]: tuple(r)[2:] for r in ledger.attachment_records(df, ["task", "att"], "no").collect()}
    assert got == {1: ("n2", "s1", "failed", "E: x", 2), 2: ("n", None, "failed", "E: y", 1), 3: ("m", "s", "success", None, 2)}
    attempts = spark.range(1, 5).select(F.col("id").alias("log_id"))
    marks = spark.createDataFrame([(1, 1, "c1", None, "ok"), (1, 2, None, "F", "bad"), (2, 1, None, "F", "bad"), (2, 2, "c2", None, "ok"), (3, 1, None, "F", None), (9, 1, "c", None, "ok")], "log_id long, no int, external_comment_id string, error_code string, response_text string")
    logs = {r["log_id"]: tuple(r)[1:] for r in ledger.comment_logs(attempts, marks, "no").collect()}
    assert logs == {1: ("failed", "c1", "F", "bad"), 2: ("success", "c2", None, "ok"), 3: ("failed", None, "F", None), 4: ("writing", None, None, None), 9: ("unknown_log", "c", None, "ok")}


def test_keys_of_a_group_share_one_state():
    """Many keys in one call, and one timer; a group that is timed out settles what the watermark has passed."""
    import pandas as pd

    class State:
        exists, hasTimedOut, passed, at = False, False, -2_000, None  # noqa: N815
        getCurrentWatermarkMs = lambda self: self.passed  # noqa: E731, N815
        setTimeoutTimestamp = lambda self, at: setattr(self, "at", at)  # noqa: E731, N815

        def update(self, value):
            self.get, self.exists = value, True

    step, held = ordered.group_step("pending", state.transition_moves()), State()

    def run(*rows):
        out = list(step((0,), iter([pd.DataFrame(rows, columns=["event_key", "event_micros", "event_place", "event_name"])]), held))
        return sorted(tuple(r) for r in out[0].to_numpy().tolist())

    assert run(("=a", 3_000_000, 1, "reviewing"), ("", -1_000_000, 0, "parsing")) == [("", "parsing", 1, 0, 0), ("=a", "pending", 0, 1, 0)] and held.at == 1
    assert run(("=a", 1_000_000, 0, "parsing")) == [("=a", "reviewing", 2, 0, 0)]  # it comes late and takes its place; keys without events are not told
    held.hasTimedOut, held.passed = True, 2_000
    assert list(step((0,), iter([]), held)) == [] and held.at == 3001
    held.hasTimedOut = False
    assert run(("=a", 4_000_000, 2, "done"), ("", 5_000_000, 2, "blocked")) == [("", "blocked", 2, 0, 0), ("=a", "done", 3, 0, 0)]


def test_keys_are_streamed_in_groups(spark, tmp_path):
    """States of single keys cost a call for each part of each. A key that is null keeps its place."""
    rows = [(None if i % 7 == 0 else i % 300, datetime(2024, 1, 1) + timedelta(minutes=i), i, "parsing" if i % 3 else "reviewing") for i in range(900)]
    table = spark.createDataFrame(rows, "k long, ts timestamp, no long, target string")
    for i in range(3):
        table.filter(F.floor(F.col("no") / 300) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with ledger.stream_settings(spark):
        source = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        told = ordered.replay_ordered(source, "k", "ts", "no", "target", "1 hour", groups=4)
        assert "event_group" in told._jdf.queryExecution().analyzed().toString()
        ledger.write_stream(told, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    columns = ["state", "accepted", "rejected", "retries"]
    last = {r["k"]: tuple(r[c] for c in columns) for r in ledger.last_told(spark.read.parquet(str(tmp_path / "out")), "k").collect()}
    want = {}
    for k, _, _, target in rows:
        want[k] = ordered._step(state.transition_moves(), want.get(k, ("pending", 0, 0, 0)), target)
    assert last == want
