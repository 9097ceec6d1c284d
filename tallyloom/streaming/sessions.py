"""Sketches of sessions: runs of a key's events with no gap longer than a given one.

A session's extent isn't known before it ends, and an event between two sessions makes them one.  So registers can't be
grouped by session beforehand; a state for each key holds its open sessions, each as one bounded sketch, and
joining sessions merges their sketches.  When the watermark passes a session's end its sketch is put out and its
state is gone, so the state holds open sessions only.  A key has one entry of state and one timer, for its session that
ends first, however many are open: each costs a call from the state's store.  Rows behind the watermark come too late for any session: Spark
drops them before the state sees them and counts them, see ``late_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tallyloom.operators.frames import named
from tallyloom.operators.parts import HeavyPart, Part, new_part
from tallyloom.profiles import Spec
from tallyloom.sources import wire


class SessionProcessor(StatefulProcessor):
    """``sessions``: starts, ends and packed sketches of the key's open sessions, and its timer."""

    def __init__(self, spec: Spec, keys: list[str], gap_us: int) -> None:
        self.spec, self.keys, self.gap = spec, keys, gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sessions = handle.getValueState("sessions", "starts array<long>, ends array<long>, sketches array<binary>, timer long")

    def _open(self) -> tuple[list[list], int | None]:
        found = self.sessions.get()
        if found is None:
            return [], None
        starts, ends, sketches, timer = found
        return [[s, e, bytes(b)] for s, e, b in zip(starts, ends, sketches, strict=True)], timer

    def _keep(self, open_ones: list[list], timer: int | None) -> None:
        """``timer`` is the one that is set by now."""
        if not open_ones:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.sessions.clear()
            return
        first = min(s[1] for s in open_ones) // 1000 + 1
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
        starts, ends, sketches = zip(*open_ones, strict=True)
        self.sessions.update((list(starts), list(ends), list(sketches), first))

    def _added(self, part: Part, rows: pd.DataFrame) -> None:
        hashes = rows["hash_"].to_numpy(np.int64).view(np.uint64)
        part.add(*((hashes, rows["weight_"].to_numpy(object)) if isinstance(part, HeavyPart) else (hashes,)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        open_ones, timer = self._open()
        for pdf in rows:
            if not len(pdf):  # a batch of timers alone comes as a frame without columns
                continue
            pdf = pdf.sort_values("us_", kind="stable")
            at, earlier, done = pdf["us_"].to_numpy(np.int64), sorted(open_ones, key=lambda s: -s[0]), []
            cuts = np.flatnonzero(np.diff(at) > self.gap) + 1
            for own in np.split(np.arange(len(at)), cuts):
                start, end = int(at[own[0]]), int(at[own[-1]]) + self.gap
                part = new_part(self.spec)
                self._added(part, pdf.iloc[own])
                waiting = []
                while done and done[-1][1] >= start:  # a run before this one may have reached it by an earlier session
                    waiting.append(done.pop())
                while earlier and earlier[-1][0] <= end:
                    session = earlier.pop()
                    if session[1] < start:
                        done.append(session)
                    else:
                        waiting.append(session)
                        end = max(end, session[1])
                for session in waiting:
                    start, end = min(start, session[0]), max(end, session[1])
                    part.absorb(wire.decode(session[2], type(self.spec))[1])
                done.append([start, end, wire.encode(self.spec, part.state())])
            open_ones = [*done, *earlier]
        self._keep(open_ones, timer)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        open_ones, _ = self._open()
        ended = [tuple(s) for s in open_ones if s[1] <= passed]
        self._keep([s for s in open_ones if s[1] > passed], None)  # the timer that called is gone
        if ended:
            out = pd.DataFrame(ended, columns=["start_us", "end_us", "sketch"])
            for name, value in zip(self.keys, key, strict=True):
                out[name] = value
            yield out[[*self.keys, "start_us", "end_us", "sketch"]]

    def close(self) -> None:
        pass


def session_sketches(events: DataFrame, keys: list[str], time: str, gap: str, late: str, hashed: Column | str, spec: Spec, weight: Column | str | None = None) -> DataFrame:
    """``keys, start, end, sketch`` of every session that the watermark has passed; ``end`` is the last event plus the gap.

    ``gap`` and ``late`` are intervals such as ``30 minutes``.  Null keys are a key; null times, hashes and weights
    add nothing, and no session.  Write it in append mode, with the RocksDB state store.
    """
    gap_us = events.sparkSession.sql(f"SELECT unix_micros(timestamp'1970-01-02 00:00:00 UTC' + interval {gap}) - 86400000000 AS us").first()["us"]
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    # Spark hands rows on as named tuples, which take no name that starts with an underscore.
    w = F.lit(1).cast("long") if weight is None else named(weight).cast("long")
    rows = stamped.select(*keys, time, F.unix_micros(time).alias("us_"), named(hashed).alias("hash_"), w.alias("weight_"))
    rows = rows.where("us_ is not null and hash_ is not null and weight_ is not null")
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]
    schema = ", ".join([*types, "start_us long", "end_us long", "sketch binary"])
    found = rows.groupBy(*keys).transformWithStateInPandas(SessionProcessor(spec, keys, gap_us), schema, "Append", "EventTime")
    return found.select(*keys, F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("end_us").alias("end"), "sketch")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stream dropped since they came behind the watermark, in the batches that Spark still tells of."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
