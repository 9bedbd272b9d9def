"""Live session memory: the batch fold of operators.sessions.since_reset, as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.sessions import MOST_EVENTS

OUTPUT = "session_id long, seq long, event_type string, item_id long, ts timestamp"


class SessionMemory(StatefulProcessor):
    """Keeps a session's last MOST_EVENTS events since its last reset; a reset clears them.

    Each batch gives the events that are kept now. Events of a session are taken in the order of seq; a late one, of a seq
    before the last reset, is dropped.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", OUTPUT.replace("session_id long, ", ""))
        self.reset = handle.getValueState("reset", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.events.get()]
        last = self.reset.get()[0] if self.reset.exists() else -1
        for frame in rows:
            for r in frame.itertuples(index=False):
                if r.event_type == "reset":
                    last = max(last, int(r.seq))
                else:
                    held.append((int(r.seq), r.event_type, None if pd.isna(r.item_id) else int(r.item_id), r.ts.to_pydatetime()))
        held = sorted((h for h in held if h[0] > last), key=lambda h: (h[3], h[0]))[-MOST_EVENTS:]
        self.reset.update((last,))
        self.events.clear()
        if held:
            self.events.put(held)
        yield pd.DataFrame([(key[0], *h) for h in held], columns=["session_id", "seq", "event_type", "item_id", "ts"])

    def close(self) -> None:
        pass


def live_sessions(events: DataFrame) -> DataFrame:
    """A stream of events(session_id, seq, event_type, item_id, ts) -> the kept events of each session that a batch touches."""
    rows = events.select("session_id", "seq", "event_type", "item_id", "ts")
    return rows.groupBy("session_id").transformWithStateInPandas(statefulProcessor=SessionMemory(), outputStructType=OUTPUT, outputMode="Update", timeMode="None")


def windowed_counts(events: DataFrame, delay: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows of event time; late ones beyond the delay are dropped."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"))


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events of each session in windows that a pause of `gap` ends."""
    return events.withWatermark("ts", delay).groupBy("session_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
