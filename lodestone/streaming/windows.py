"""Context windows over streams of turns: what operators.sequences.context_windows() gives for whole tables.

A key's state is what a window may still need: turns whose right context isn't known yet, and up to
size // 2 turns before them. A window leaves when its right context is there, when a turn shows that
its session is over, or when the watermark passes the time up to which a turn could still continue it.
Keys are dealt into buckets by hash, and a bucket's keys are one call and one state a micro-batch: a
call costs milliseconds, a key in it microseconds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestone.functions.text import TURN_SEP, collapse
from lodestone.operators.sequences import check_window_parameters

#: Event time of second 0: Spark's first watermark is 0, and what isn't after it counts as late.
ORIGIN = 1
WINDOW = "participant_id string, context_window_id string, center_turn_id string, center_turn_index int, turn_ids array<string>, start_time double, end_time double, n_turns int, window_text string"


class Held:
    """A session's turns that windows may still need; the first `done` of them have had their window."""

    def __init__(self, reach: int, gap: float, turns: list | None = None, done: int = 0, n: int = 0) -> None:
        self.reach, self.gap, self.turns, self.done, self.n = reach, gap, turns or [], done, n

    def _window(self, at: int) -> list[tuple]:
        return self.turns[max(0, at - self.reach) : at + self.reach + 1]

    def flush(self) -> list[tuple[int, list[tuple]]]:
        """The windows of all turns that wait for their right context."""
        out = [(self.turns[i][0], self._window(i)) for i in range(self.done, len(self.turns))]
        self.turns, self.done = [], 0
        return out

    def add(self, start: float, end: float, text: str) -> list[tuple[int, list[tuple]]]:
        """(index of the middle turn, turns) of the windows that are known now."""
        out = []
        if self.turns:
            _, last_start, last_end, _ = self.turns[-1]
            if start < last_start or start - last_end > self.gap:
                out = self.flush()
        self.turns.append((self.n, start, end, text))
        self.n += 1
        while self.done + self.reach < len(self.turns):
            out.append((self.turns[self.done][0], self._window(self.done)))
            self.done += 1
        over = max(0, self.done - self.reach)
        self.turns, self.done = self.turns[over:], self.done - over
        return out


#: Buckets that keys are dealt into; fixed for a stream's checkpoint. A bucket's state is written whole when one of its keys changes.
BUCKETS = 256


def stream_windows(stream: DataFrame, late: str, size: int = 5, max_gap: float = 60.0, buckets: int = BUCKETS) -> DataFrame:
    """One window around each turn of a stream (participant_id, pos, start_time, end_time, text), in seconds from 0 on.

    Turns of a key must arrive in the order of pos from one micro-batch to the next; within one they are
    sorted, so a bucket's turns of a micro-batch are in memory together. Times are event times: a turn may be
    `late` behind the latest one, and a turn that comes after its windows left starts a session of its own. Null ids are one
    key, null texts are empty; a null time is an error. A key that is silent until its session must be over leaves no turns
    behind but a number: how many it has had.
    """
    check_window_parameters(size, max_gap)

    def rows(found: list[tuple[str | None, int, list[tuple]]]) -> Iterator[pd.DataFrame]:
        if found:
            yield pd.DataFrame({
                "participant_id": [name for name, _, _ in found],
                "context_window_id": [f"{name}_w{i:04d}" for name, i, _ in found],
                "center_turn_id": [f"{name}_t{i:04d}" for name, i, _ in found],
                "center_turn_index": [i for _, i, _ in found],
                "turn_ids": [[f"{name}_t{t[0]:04d}" for t in ts] for name, _, ts in found],
                "start_time": [ts[0][1] for _, _, ts in found],
                "end_time": [ts[-1][2] for _, _, ts in found],
                "n_turns": [len(ts) for _, _, ts in found],
                "window_text": [TURN_SEP.join(t[3] for t in ts) for _, _, ts in found],
            })

    def over(held: Held) -> int | None:
        """The watermark beyond which no turn can continue a key's session."""
        return int(1000 * (max(held.turns[-1][1:3]) + max_gap + ORIGIN)) + 1 if held.turns else None

    def step(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = json.loads(state.get[0]) if state.exists else []
        keys = {name: Held(size // 2, max_gap, [tuple(t) for t in turns], done, n) for name, turns, done, n in known}
        found, met, now = [], set(), state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            got = pd.concat(list(parts)).sort_values("pos", kind="stable")
            names = got["participant_id"].astype(object).where(got["participant_id"].notna(), None)
            for name, start, end, text in zip(names, got["start_time"], got["end_time"], got["text"]):
                met.add(name)
                held = keys.setdefault(name, Held(size // 2, max_gap))
                found += ((name, *w) for w in held.add(float(start), float(end), text))
        for name, held in keys.items():  # keys without a turn here, whose time is up
            if held.turns and name not in met and over(held) < now:
                found += ((name, *w) for w in held.flush())
        state.update((json.dumps([(name, h.turns, h.done, h.n) for name, h in keys.items()]),))
        waits = [over(h) for h in keys.values() if h.turns]
        if waits:
            state.setTimeoutTimestamp(max(min(waits), now + 1))
        yield from rows(found)

    named = stream.select(F.col("participant_id").cast("string").alias("participant_id"), F.col("pos").cast("long").alias("pos"), F.col("start_time").cast("double").alias("start_time"), F.col("end_time").cast("double").alias("end_time"), F.coalesce(collapse("text"), F.lit("")).alias("text"))
    timed = named.withColumn("at", F.timestamp_seconds(F.col("start_time") + ORIGIN)).withWatermark("at", late)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("participant_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(step, WINDOW, "held string", "append", GroupStateTimeout.EventTimeTimeout)
