"""Keyed state for live logs. Each processor keeps a few numbers per key, never rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from inkweave.functions.fetching import (
    DELAY_STEP, INITIAL_DELAY, MAX_DELAY, MIN_DELAY, SUCCESSES_PER_STEP, TERMINAL_STATES)

CHANGE_SCHEMA = T.StructType([
    T.StructField("job_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("state", T.StringType()),
    T.StructField("meta", T.StringType()),
])
DELAY_SCHEMA = T.StructType([
    T.StructField("host", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("event_id", T.LongType()), T.StructField("outcome", T.StringType()),
    T.StructField("delay", T.DoubleType()),
])


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """One key's rows of one micro-batch, by time; the source's trigger limit bounds them."""
    parts = list(rows)
    frame = parts[0] if len(parts) == 1 else pd.concat(parts)
    return frame if len(frame) == 1 else frame.sort_values(["ts", "event_id"])


class ProgressChanges(StatefulProcessor):
    """Rows that differ from the last one sent, up to the first end state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState("sent", T.StructType([
            T.StructField("state", T.StringType()), T.StructField("meta", T.StringType()),
            T.StructField("ended", T.BooleanType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one call to the state for each key and way: a key has few rows, the calls are what it costs
        before = self.sent.get()
        state, meta, ended = before or (None, None, False)
        if ended:
            return  # nothing of this job is shown any more
        frame = _in_order(rows)
        kept = []
        for new_state, new_meta in zip(frame["state"], frame["meta"]):
            show = not ended and (new_state, new_meta) != (state, meta)
            kept.append(show)
            if not ended:
                state, meta, ended = new_state, new_meta, new_state in TERMINAL_STATES
        if (state, meta, bool(ended)) != before:
            self.sent.update((state, meta, bool(ended)))
        if any(kept):
            yield frame[kept].assign(job_id=key[0])[[f.name for f in CHANGE_SCHEMA]]

    def close(self) -> None:
        pass


class AdaptiveDelay(StatefulProcessor):
    """Delay each request leaves behind on its host, job profile."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pace = handle.getValueState("pace", T.StructType([
            T.StructField("delay", T.DoubleType()), T.StructField("streak", T.IntegerType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        delay, streak = self.pace.get() or (INITIAL_DELAY, 0)
        frame = _in_order(rows)
        delays = []
        for outcome in frame["outcome"]:
            if outcome == "ok":
                streak = (streak + 1) % SUCCESSES_PER_STEP
                if streak == 0:
                    delay = max(MIN_DELAY, delay - DELAY_STEP)
            elif outcome == "limited":
                delay = min(MAX_DELAY, delay + 2 * DELAY_STEP)
            else:
                streak = 0
                if outcome != "not_html":
                    delay = min(MAX_DELAY, delay + DELAY_STEP)
            delays.append(delay)
        self.pace.update((float(delay), int(streak)))
        yield frame.assign(host=key[0], delay=delays)[[f.name for f in DELAY_SCHEMA]]

    def close(self) -> None:
        pass
