"""Guarded state machines as a fold over each key's ordered events, and the outcome ladders of the workflow."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.schemas import TRANSITIONS, WORKFLOW_EVENTS
from docsieve.sources.shared import saved

#: log2 of the events in a chunk at most, and of the chunks that a level puts together at most. Behind these levels
#: a key has a chunk or two in each task that has events of it.
CHUNK_BITS, LEVELS = 14, (17,)


#: What an event makes of a state, and whether that counts as a retry. Events that a state has no move for are refused.
Moves = dict[tuple[str, str], tuple[str, bool]]


def transition_moves(transitions: dict[str, list[str]] = TRANSITIONS) -> Moves:
    """Moves whose events are the states that they ask for; leaving ``blocked`` is a retry."""
    return {(s, t): (t, s == "blocked") for s, targets in transitions.items() for t in targets}


def workflow_moves() -> tuple[str, Moves]:
    """The start and the moves of a task with its guards, in states ``status/write status/blocked stage``.

    Events are those of ``WORKFLOW_EVENTS``; blocking names the stage. A retry needs a task that is to go back to
    parsing, so one blocked in the write-back goes on by ``resume_writeback`` alone; OCR resumes only what document
    reading blocked, and changes nothing for a task that is parsing.
    """
    start = "pending/not_written/"
    moves: Moves = {}
    open_, seen = [start], {start}
    while open_:
        state = open_.pop()
        for event in WORKFLOW_EVENTS:
            done = _after(*state.split("/"), event)
            if done:
                moves[state, event] = done
                if done[0] not in seen:
                    seen.add(done[0])
                    open_.append(done[0])
    return start, moves


def _after(status: str, write: str, stage: str, event: str) -> tuple[str, bool] | None:
    """A task's state after one event, and whether it was retried; None if its guards refuse."""
    to = lambda new: new in TRANSITIONS[status]
    kind, _, at = event.partition("@")
    resumable = status == "blocked" and stage == "comment_writeback" and write == "failed"
    if kind in ("start_parsing", "start_reviewing"):
        new = kind.removeprefix("start_")
        return (f"{new}/{write}/", False) if to(new) else None
    if kind == "block":
        return (f"blocked/{write}/{at}", False) if to("blocked") else None
    if kind == "retry":
        return (f"parsing/{write}/", True) if status == "blocked" and stage != "comment_writeback" else None
    if kind == "resume_for_ocr":
        if status == "parsing":
            return f"{status}/{write}/{stage}", False
        return (f"parsing/{write}/", True) if status == "blocked" and stage == "document_reading" else None
    if kind == "start_write":
        return (f"{status}/writing/{stage}", False) if status == "reviewing" and write in ("not_written", "failed") else None
    if kind == "complete_write":
        return ("done/success/", False) if status == "reviewing" and write == "writing" else None
    if kind == "fail_write":
        return ("blocked/failed/comment_writeback", False) if status == "reviewing" and write == "writing" else None
    if kind == "block_write":
        return ("blocked/failed/comment_writeback", False) if status == "reviewing" else None
    return (f"reviewing/{write}/", True) if resumable else None  # resume_writeback


def chunks(events: DataFrame, key: str, order: list[str], target: str) -> DataFrame:
    """(key, at, _e): each key's events with a target, in order, cut into chunks of 2 ** CHUNK_BITS at most.

    Events are dealt out by ranges of key and order, so a key with many of them lies on many tasks; ``at`` rises
    with the order.
    """
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order, "_to"]
    dealt = events.filter(F.col(target).isNotNull()).select(key, *order, F.col(target).alias("_to")).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    placed = dealt.withColumn("at", F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS))
    return placed.groupBy(key, "at").agg(F.array_sort(F.collect_list(F.struct(*order, "_to"))).alias("_e"))


def replay(events: DataFrame, key: str, order: list[str], target: str, start: str = "pending", transitions: dict[str, list[str]] = TRANSITIONS) -> DataFrame:
    """``fold`` of events that name the state they ask for: per key the final state, accepted and rejected events,
    and retries (entries from blocked)."""
    return fold(events, key, order, target, start, transition_moves(transitions))


#: Bits of the state, and of each count of a chunk, in the one number that a fold carries.
STATE_BITS, COUNT_BITS = 8, 16
_COUNTS = ("accepted", "rejected", "retries")


def _codes(start: str, moves: Moves) -> tuple[list[str], list[str], list[int]]:
    """States, events, and what an event adds to the number: for each state, then each event, the last one unknown."""
    states = sorted({start, *(s for s, _ in moves), *(t for t, _ in moves.values())})
    events = sorted({e for _, e in moves})
    if len(states) > 1 << STATE_BITS:
        raise ValueError(f"more than {1 << STATE_BITS} states")
    one = [1 << STATE_BITS + i * COUNT_BITS for i in range(3)]
    table = []
    for i, s in enumerate(states):
        for e in (*events, None):
            move = moves.get((s, e))
            table.append(states.index(move[0]) - i + one[0] + one[2] * bool(move[1]) if move else one[1])
    return states, events, table


def _coded(events: DataFrame, event: str, names: list[str]) -> DataFrame:
    """``events`` that have one, by its number; what no state has a move for is the last."""
    code = F.coalesce(*[F.when(F.col(event) == e, F.lit(i)) for i, e in enumerate(names)], F.lit(len(names))).cast("short")
    return events.filter(F.col(event).isNotNull()).withColumn("_code", code)


def fold(events: DataFrame, key: str, order: list[str], event: str, start: str, moves: Moves) -> DataFrame:
    """Per key: final state, accepted and rejected events, and retries.

    Rows without an event are left out. Chunks of a key's events are folded side by side from every state they
    could begin in, state and counts in one whole number; what a chunk makes of each state is then put together, in
    order and in levels, so that no row grows with a key.
    """
    states, names, table = _codes(start, moves)
    added = F.expr(f"array({', '.join(f'{x}L' for x in table)})")
    every = F.expr(f"sequence(0, {len(states) - 1})")
    low = lambda x: x.bitwiseAND(F.lit((1 << STATE_BITS) - 1))
    step = lambda acc, e: acc + F.get(added, (low(acc) * (len(names) + 1) + e["_to"]).cast("int"))
    count = lambda x, i: F.shiftright(x, STATE_BITS + i * COUNT_BITS).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))
    wide = lambda x: F.struct(low(x).cast("int").alias("state"), *[count(x, i).alias(c) for i, c in enumerate(_COUNTS)])
    zero = lambda i: F.struct(i.alias("state"), *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])

    def join(acc: Column, e: Column) -> Column:
        then = F.get(e["_m"], acc["state"])
        return F.struct(then["state"].alias("state"), *[(acc[c] + then[c]).alias(c) for c in _COUNTS])

    folded = F.transform(every, lambda i: F.aggregate("_e", i.cast("bigint"), step))
    done = chunks(_coded(events, event, names), key, order, "_code").select(key, "at", F.transform(folded, wide).alias("_m"))
    for bits in LEVELS:
        listed = _listed(done.withColumn("up", F.shiftright("at", bits)), key, "up")
        done = listed.select(key, F.col("up").alias("at"), F.transform(every, lambda i: F.aggregate("_e", zero(i), join)).alias("_m"))
    last = _listed(done, key).select(key, F.aggregate("_e", zero(F.lit(states.index(start))), join).alias("_s"))
    return last.select(key, F.get(F.array(*[F.lit(s) for s in states]), F.col("_s.state")).alias("state"), *[f"_s.{c}" for c in _COUNTS])


def _listed(done: DataFrame, *by: str) -> DataFrame:
    """The chunks of each group in order."""
    return done.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "_m"))).alias("_e"))


def transition_log(events: DataFrame, key: str, order: list[str], event: str, start: str, moves: Moves) -> DataFrame:
    """(key, order..., event, before, after, accepted) of every event: the states around it.

    A chunk's first state comes from a walk over what the chunks of its key make of each state, one short row a chunk,
    whatever the number of events; chunks are then walked side by side. Rows without an event are left out.
    """
    states, names, _ = _codes(start, moves)
    after = np.array([[states.index(moves[s, e][0]) if (s, e) in moves else i for e in (*names, None)] for i, s in enumerate(states)], np.int32)
    good = np.array([[(s, e) in moves for e in (*names, None)] for s in states])
    dealt = saved(chunks(_coded(events, event, names), key, order, "_code"))
    table = F.expr(f"array({', '.join(map(str, after.ravel()))})")
    ends = F.transform(F.expr(f"sequence(0, {len(states) - 1})"), lambda i: F.aggregate("_e", i, lambda s, e: F.get(table, s * (len(names) + 1) + e["_to"])))
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begin = states.index(start)

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, began = None, begin, False
        for batch in batches:
            firsts = []
            for k, m in zip(batch.column(key).to_pylist(), batch.column("_m").to_pylist(), strict=True):
                if k != now or not began:
                    now, at, began = k, begin, True
                firsts.append(at)
                at = m[at]
            yield batch.drop_columns("_m").append_column("_first", pa.array(firsts, pa.int32()))

    def expand(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, state = batch.column("_e").slice(i, 1).flatten(), batch.column("_first")[i].as_py()
                codes = rows.field(rows.type.get_field_index("_to")).to_numpy()
                before = np.empty(len(codes) + 1, np.int32)
                for j, c in enumerate(codes.tolist()):
                    before[j] = state
                    state = after[state, c]
                before[-1] = state
                own = [pa.array([batch.column(key)[i].as_py()] * len(codes), batch.column(key).type), *(rows.field(rows.type.get_field_index(o)) for o in order)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(codes), pa.array(before[:-1]), pa.array(before[1:]), pa.array(good[before[:-1], codes])], [key, *order, "_to", "before", "after", "accepted"])

    kind = lambda c: f"`{c}` {events.schema[c].dataType.simpleString()}"
    made = dealt.select(key, "at", ends.alias("_m")).repartition(parts, key).sortWithinPartitions(key, "at")
    firsts = made.mapInArrow(walk, f"{kind(key)}, at long, _first int")
    placed = dealt.alias("d").join(firsts.alias("f"), F.col(f"d.{key}").eqNullSafe(F.col(f"f.{key}")) & (F.col("d.at") == F.col("f.at"))).select(f"d.{key}", "_e", "_first")
    found = placed.mapInArrow(expand, f"{kind(key)}, {', '.join(map(kind, order))}, _to short, before int, after int, accepted boolean")
    name = lambda c, of: F.get(F.array(*[F.lit(x) for x in of]), F.col(c).cast("int"))
    return found.select(key, *order, name("_to", names).alias("event"), name("before", states).alias("before"), name("after", states).alias("after"), "accepted")


# fixed values: level and type of the log rows that a change writes, by the kind of its event
WORKFLOW_LOGS = {
    "start_parsing": (("info", "status_change"),), "start_reviewing": (("info", "status_change"),), "block": (("info", "status_change"), ("error", "task_blocked")),
    "retry": (("info", "status_change"), ("info", "manual_retry")), "resume_for_ocr": (("info", "status_change"), ("info", "DOCUMENT_OCR_RESUMED")), "start_write": (("info", "COMMENT_WRITE_STARTED"),),
    "complete_write": (("info", "COMMENT_WRITE_SUCCEEDED"), ("info", "status_change"), ("info", "TASK_COMPLETED")), "fail_write": (("error", "COMMENT_WRITE_FAILED"), ("info", "status_change"), ("error", "task_blocked")),
    "block_write": (("error", "COMMENT_WRITE_FAILED"), ("info", "status_change"), ("error", "task_blocked")), "resume_writeback": (("info", "status_change"), ("info", "COMMENT_WRITE_RETRY_RESUMED")),
}


def workflow_logs(log: DataFrame) -> DataFrame:
    """The log rows that accepted events of ``workflow_moves`` write: the columns of ``transition_log`` and place, level,
    log_type, from_status, to_status, stage. What changes nothing, and what is refused, writes none."""
    kind = F.substring_index("event", "@", 1)
    rows = F.coalesce(*[F.when(kind == k, F.array(*[F.struct(F.lit(level).alias("level"), F.lit(t).alias("log_type")) for level, t in x])) for k, x in WORKFLOW_LOGS.items()])
    part = lambda c, i: F.get(F.split(c, "/"), F.lit(i))
    changed = log.filter(F.col("accepted") & (F.col("before") != F.col("after")))
    return changed.select("*", F.posexplode(rows).alias("place", "_l")).select(*log.columns, "place", "_l.*", part("before", 0).alias("from_status"), part("after", 0).alias("to_status"), part("after", 2).alias("stage"))


def retry_action(stage: Column) -> Column:
    """What a retry does for a task blocked at a stage; null is refused."""
    return F.when(stage == "comment_writeback", "write_comment").when(stage.isin("attachment_preparation", "parsing"), "prepare_attachments")


def read_outcome(has_attachment: Column, reused: Column, sha: Column, has_file: Column, readable: Column, size: Column, reader: Column) -> Column:
    """Outcome of reading a document: the first rung that applies."""
    return (
        F.when(~has_attachment, "DOCUMENT_FILE_NOT_FOUND").when(reused, "DOCUMENT_READ_REUSED").when(sha.isNull(), "DOCUMENT_READ_FAILED").when(~has_file, "DOCUMENT_FILE_NOT_FOUND")
        .when(~readable, "DOCUMENT_READ_FAILED").when(size == 0, "DOCUMENT_FILE_EMPTY").otherwise(F.coalesce(reader, F.lit("DOCUMENT_READ_SUCCESS")))
    )


def attachment_outcome(attachments: Column, main_type: Column, supported: tuple[str, ...], failed: Column, event: Column) -> Column:
    """Outcome of preparing attachments; ``event`` is that of ``content_events``."""
    return (
        F.when(attachments == 0, "ATTACHMENT_NOT_FOUND").when(main_type.isNull(), "MAIN_CONTRACT_NOT_FOUND").when(~main_type.isin(*supported), "UNSUPPORTED_ATTACHMENT_TYPE")
        .when(failed, "ATTACHMENT_DOWNLOAD_FAILED").otherwise(F.concat(F.lit("ATTACHMENT_"), event))
    )


def comment_outcome(has_result: Column, written: Column, text: Column, sent: Column, response_id: Column) -> Column:
    """Outcome of writing a review back."""
    return (
        F.when(~has_result, "REVIEW_RESULT_NOT_FOUND").when(written, "COMMENT_WRITE_REUSED").when(F.coalesce(F.trim(text), F.lit("")) == "", "COMMENT_TEXT_EMPTY")
        .when(~sent, "COMMENT_WRITE_FAILED").when(F.coalesce(F.trim(response_id), F.lit("")) == "", "COMMENT_RESPONSE_INVALID").otherwise("COMMENT_WRITE_SUCCEEDED")
    )


def ocr_outcome(status: Column, stage: Column, has_main: Column, sha: Column, reused: Column, source: Column, read: Column) -> Column:
    """Outcome of asking for OCR, the first rung that applies. ``source`` is the status of the latest read of the
    file by another method, ``read`` the recognizer's own outcome (null: it succeeded)."""
    return (
        F.when(~status.isin("parsing", "blocked") | ((status == "blocked") & ~F.coalesce(stage == "document_reading", F.lit(False))), "DOCUMENT_OCR_NOT_ALLOWED").when(~has_main | sha.isNull(), "OCR_INPUT_FILE_NOT_FOUND").when(reused, "DOCUMENT_OCR_REUSED")
        .when(source.isNull(), "OCR_REQUIRED_SNAPSHOT_NOT_FOUND").when(source == "success", "OCR_NOT_REQUIRED").when(source != "ocr_required", "OCR_REQUIRED_SNAPSHOT_NOT_FOUND").otherwise(F.coalesce(read, F.lit("DOCUMENT_OCR_SUCCEEDED")))
    )
