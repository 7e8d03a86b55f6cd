"""Folds and logs of guarded events against a plain loop, with keys that lie on many chunks."""

from __future__ import annotations

import random

import pytest

from docsieve.operators import state
from docsieve.schemas import WORKFLOW_EVENTS

SCHEMA = "k long, ts int, no int, action string"


def plain(rows, start, moves):
    at, log = {}, []
    for k, ts, no, e in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[0] is not None, r)):
        s, a, r, n = at.get(k, (start, 0, 0, 0))
        move = moves.get((s, e))
        at[k] = (move[0] if move else s, a + bool(move), r + (not move), n + bool(move and move[1]))
        log.append((k, ts, no, e if e in WORKFLOW_EVENTS else None, s, at[k][0], bool(move)))
    return at, log


@pytest.mark.parametrize("bits", [14, 3])
def test_fold_and_log(spark, monkeypatch, bits):
    monkeypatch.setattr(state, "CHUNK_BITS", bits)
    monkeypatch.setattr(state, "LEVELS", (2, 3))
    rng = random.Random(bits)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4, 5, 6, 7]), rng.randint(0, 300), i, rng.choice([*WORKFLOW_EVENTS, "no such event", None])) for i in range(3000)]
    start, moves = state.workflow_moves()
    at, log = plain(rows, start, moves)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = state.fold(df, "k", ["ts", "no"], "action", start, moves).collect()
    assert {r["k"]: tuple(r)[1:] for r in got} == at and len(got) == len(at)
    told = state.transition_log(df, "k", ["ts", "no"], "action", start, moves)
    assert sorted(map(str, map(tuple, told.collect()))) == sorted(map(str, log))
    rows_ = state.workflow_logs(told).collect()
    changed = [x for x in log if x[6] and x[4] != x[5]]
    assert len(rows_) == sum(len(state.WORKFLOW_LOGS[x[3].split("@")[0]]) for x in changed) > 100
    blocked = [r for r in rows_ if r["log_type"] == "task_blocked"]
    assert blocked and all(r["to_status"] == "blocked" and r["level"] == "error" and r["stage"] for r in blocked)


def test_no_events(spark):
    start, moves = state.workflow_moves()
    none = spark.createDataFrame([(1, 1, 1, None)], SCHEMA)
    assert state.fold(none, "k", ["ts", "no"], "action", start, moves).count() == 0
    assert state.transition_log(none, "k", ["ts", "no"], "action", start, moves).count() == 0


def test_too_many_states(spark):
    moves = {(str(i), "go"): (str(i + 1), False) for i in range(300)}
    with pytest.raises(ValueError, match="256 states"):
        state.fold(spark.createDataFrame([(1, 1, 1, "go")], SCHEMA), "k", ["ts", "no"], "action", "0", moves)
