"""Sketches over windows of event time.

Registers, bitmaps and minima are plain mergeable aggregations, so a stream builds them as a batch does.
Heavy hitters need a bounded map for each group: a state of entries, which ends with its window or by age.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyloom.errors import NegativeWeightError, raised
from tallyloom.operators import bloom, heavy, hll, minhash
from tallyloom.operators.frames import named
from tallyloom.profiles import BloomSpec, HeavySpec, HllSpec, MinHashSpec


def windowed(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Events with their ``window``, after a watermark; times without a zone are read in the session's."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return stamped.withColumn("window", F.window(time, width))


def hll_registers(events: DataFrame, keys: list[str], hashed: Column | str, spec: HllSpec) -> DataFrame:
    """``window, keys, _dense, _idx, _rank`` as a streaming aggregation."""
    return hll.sparse_rows(events, ["window", *keys], hashed, spec)


def bloom_buckets(events: DataFrame, keys: list[str], hashed: Column | str, spec: BloomSpec) -> DataFrame:
    return bloom.bucket_rows(events, ["window", *keys], hashed, spec)


def minhash_minima(events: DataFrame, keys: list[str], hashed: Column | str, spec: MinHashSpec) -> DataFrame:
    return minhash.minima_rows(events, ["window", *keys], hashed, spec)


def hll_from_registers(rows: DataFrame, keys: list[str], spec: HllSpec, keep_sparse: bool = False) -> hll.HllFrame:
    """The sketches in rows that a stream wrote; rows that an update superseded are merged away."""
    return hll._settled(rows, keys, spec, keep_sparse=keep_sparse)


class HeavyProcessor(StatefulProcessor):
    """Keeps a bounded map for each group in state, an entry for each item: a batch writes the items that it changed.

    Within windows a timer at the window's end puts the items out and clears the state.  Without, they are put out after
    every batch that touched the group, and ``ttl_ms`` after its last change a state is forgotten.
    """

    def __init__(self, spec: HeavySpec, keys: list[str], windowed: bool, ttl_ms: int | None = None) -> None:
        self.spec, self.keys, self.windowed, self.ttl = spec, keys, windowed, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "total long, error long", self.ttl)
        self.held = handle.getMapState("items", "hash long", "estimate long", self.ttl)

    def _counters(self) -> heavy.Counters:
        counters = heavy.Counters(self.spec.map_size)
        if self.sums.exists():
            total, error = self.sums.get()
            counters.absorb([(h, e) for (h,), (e,) in self.held.iterator()], total, error)
        return counters

    def _items(self, key, counters: heavy.Counters) -> pd.DataFrame:
        out = pd.DataFrame(sorted(counters.items()), columns=["hash", "estimate"], dtype="int64")
        for name, value in zip(self.keys, key, strict=True):
            out[name] = value
        return out.assign(max_error=counters.error, total_weight=counters.total)[[*self.keys, "hash", "estimate", "max_error", "total_weight"]]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counters = self._counters()
        before = dict(counters.items())
        is_new = not self.sums.exists()
        end_ms = None
        for pdf in rows:
            if not len(pdf):  # a batch of timers alone comes as a frame without columns
                continue
            for h, w in heavy.summed(pdf, ["hash_"], "weight_").items():
                counters.add(int(h), int(w))
            end_ms = int(pdf["end_ms_"].iloc[0]) if self.windowed else None
        if not counters.total and not before:
            return
        after = dict(counters.items())
        self.sums.update((counters.total, counters.error))
        for h in before.keys() - after.keys():
            self.held.removeKey((h,))
        for h, estimate in after.items():
            if before.get(h) != estimate:
                self.held.updateValue((h,), (estimate,))
        if not self.windowed:
            yield self._items(key, counters)
        elif is_new:
            self.handle.registerTimer(end_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        counters = self._counters()
        self.sums.clear()
        self.held.clear()
        yield self._items(key, counters)

    def close(self) -> None:
        pass


#: Spark hands rows on as named tuples, which take no name that starts with an underscore: so inner names end with one.
ITEMS = "hash long, estimate long, max_error long, total_weight long"


def _typed(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields)


def heavy_items(events: DataFrame, keys: list[str], hashed: Column | str, weight: Column | str, spec: HeavySpec, ttl_ms: int | None = None) -> DataFrame:
    """``keys, hash, estimate, max_error, total_weight`` of every group that a batch touched.

    Needs the RocksDB state store; write it in update mode.  Groups are kept for ever, or with ``ttl_ms`` until they
    have not changed for so long.
    """
    rows = heavy._weighed(events, keys, hashed, weight).withColumnsRenamed({"_hash": "hash_", "_weight": "weight_"})
    mode = "None" if ttl_ms is None else "ProcessingTime"
    return rows.groupBy(*keys).transformWithStateInPandas(HeavyProcessor(spec, keys, False, ttl_ms), f"{_typed(rows, keys)}, {ITEMS}", "Update", mode)


def heavy_items_by_window(events: DataFrame, keys: list[str], hashed: Column | str, weight: Column | str, spec: HeavySpec) -> DataFrame:
    """``window_start, keys, hash, estimate, max_error, total_weight`` of every window that the watermark has passed.

    ``events`` come from ``windowed``.  A window's items are put out once, and its state is gone by then: what is
    kept is bounded by the windows that are open, not by those there ever were.  Write it in append mode, with
    the RocksDB state store.
    """
    time = next(f.name for f in events.schema.fields if "spark.watermarkDelayMs" in (f.metadata or {}) and f.name != "window")
    placed = events.select("*", F.unix_micros("window.start").alias("_start_us"), F.unix_millis("window.end").alias("end_ms_"))
    own = ["_start_us", *keys]
    w = named(weight).cast("long")
    safe = F.when(w < 0, raised(NegativeWeightError, "a weight is negative").cast("long")).otherwise(w)
    rows = placed.select(*own, time, "end_ms_", named(hashed).alias("hash_"), safe.alias("weight_")).where("hash_ is not null and weight_ is not null")
    found = rows.groupBy(*own).transformWithStateInPandas(HeavyProcessor(spec, own, True), f"{_typed(rows, own)}, {ITEMS}", "Append", "EventTime")
    return found.select(F.timestamp_micros("_start_us").alias("window_start"), *keys, "hash", "estimate", "max_error", "total_weight")
