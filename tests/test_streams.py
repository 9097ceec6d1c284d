"""Streams with state: sessions and windows against plain Python; restarts, late rows, and what the state keeps."""

import datetime as dt
import time

import pytest

from tallyloom.functions import u64
from tallyloom.operators.parts import new_part
from tallyloom.profiles import BloomSpec, HeavySpec, HllSpec
from tallyloom.sources import wire
from tallyloom.streaming import sessions, windows

BASE = dt.datetime(2024, 1, 1)
SCHEMA = "g string, t timestamp, h long, w long"


def write(spark, path, name, rows):
    """One file of a stream; rows are ``g, minutes, h, w``."""
    made = [(g, None if m is None else BASE + dt.timedelta(minutes=m), h, w) for g, m, h, w in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/{name}")


def run(spark, make, path, tmp, out):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    writer = make(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp}/{out}").option("checkpointLocation", f"{tmp}/state-{out}")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


FIRST = [("a", 0, 1, 1), ("a", 8, 2, 1), ("a", 30, 3, 1), ("b", 5, 1, 1), (None, 3, 7, 1), ("a", None, 9, 1), ("a", 31, None, 1)]
#: The gap of 22 minutes closes; a session far on; rows behind the watermark by then are only in the last file.
SECOND = [("a", 18, 4, 1), ("a", 20, 2, 1), ("b", 200, 5, 1)]
THIRD = [("b", 205, 6, 1), ("a", 40, 8, 1), ("a", 41, 8, 1), ("c", 400, 1, 1)]


@pytest.mark.parametrize("spec", [HllSpec("micro"), BloomSpec("micro")])
def test_sessions(spark, tmp_path, spec):
    path, make = str(tmp_path / "in"), lambda s: sessions.session_sketches(s, ["g"], "t", "10 minutes", "30 minutes", "h", spec)
    write(spark, path, "1", FIRST)
    run(spark, make, path, tmp_path, "out")
    write(spark, path, "2", SECOND)  # a restart from the checkpoint
    run(spark, make, path, tmp_path, "out")
    write(spark, path, "3", THIRD)
    last = run(spark, make, path, tmp_path, "out")
    found = {(r["g"], r["start"], r["end"]): bytes(r["sketch"]) for r in spark.read.schema("g string, start timestamp, end timestamp, sketch binary").parquet(f"{tmp_path}/out").collect()}

    def expected(g, start, end, hashes):
        part = new_part(spec)
        part.add(__import__("numpy").array(hashes, "uint64"))
        return (g, BASE + dt.timedelta(minutes=start), BASE + dt.timedelta(minutes=end)), wire.encode(spec, part.state())

    assert found == dict([expected("a", 0, 40, [1, 2, 4, 2, 3]), expected("b", 5, 15, [1]), expected(None, 3, 13, [7]), expected("b", 200, 215, [5, 6])])
    assert sessions.late_rows(last) == 2
    left = last.recentProgress[-1]["stateOperators"][0]
    assert left["numRowsTotal"] <= 2  # the one session that is open, and its timer


def test_open_sessions_of_a_key_share_one_entry_and_one_timer(spark, tmp_path):
    path, spec = str(tmp_path / "in"), HllSpec("micro")
    make = lambda s: sessions.session_sketches(s, ["g"], "t", "10 minutes", "1000 minutes", "h", spec)
    write(spark, path, "1", [("a", 20 * k, k, 1) for k in range(40)])  # all are open
    last = run(spark, make, path, tmp_path, "out")
    assert last.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
    write(spark, path, "2", [("a", 20 * k + 10, k, 1) for k in range(0, 39, 2)] + [("b", 5000, 1, 1)])  # joins them in twos, then ends them
    run(spark, make, path, tmp_path, "out")
    out = spark.read.schema("g string, start timestamp, end timestamp, sketch binary").parquet(f"{tmp_path}/out").collect()
    assert sorted((r["start"], r["end"]) for r in out) == [(BASE + dt.timedelta(minutes=40 * k), BASE + dt.timedelta(minutes=40 * k + 30)) for k in range(20)]


def test_heavy_windows(spark, tmp_path):
    path, spec = str(tmp_path / "in"), HeavySpec("micro")
    make = lambda s: windows.heavy_items_by_window(windows.windowed(s, "t", "1 hour", "10 minutes"), ["g"], "h", "w", spec)
    day = [[("a" if k % 3 else None, 60 * hour + k % 60, u64.signed(u64.mix64_int(k % 400)), k % 7) for k in range(900)] for hour in range(6)]
    kept = []
    for hour, rows in enumerate(day):
        write(spark, path, str(hour), rows)
        query = run(spark, make, path, tmp_path, "out")  # a restart for each hour
        kept.append(query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(kept) <= 2 * 2 * (spec.map_size + 3)  # two groups in two windows at most, whatever came before
    out = spark.read.schema("window_start timestamp, g string, hash long, estimate long, max_error long, total_weight long").parquet(f"{tmp_path}/out")
    found = {}
    for r in out.collect():
        found.setdefault((r["window_start"], r["g"]), []).append(r)
    assert len(found) == 10  # the last hour is open
    for hour, rows in enumerate(day[:5]):
        for g in ("a", None):
            own, exact = found[BASE + dt.timedelta(hours=hour), g], {}
            for key, _, h, w in rows:
                if key == g:
                    exact[h] = exact.get(h, 0) + w
            held, error = {r["hash"]: r["estimate"] for r in own}, own[0]["max_error"]
            assert own[0]["total_weight"] == sum(exact.values()) and len(held) <= spec.map_size and error <= sum(exact.values()) / (spec.map_size + 1)
            assert all(held[h] - error <= w <= held[h] if h in held else w <= error for h, w in exact.items())


def test_heavy_items_are_forgotten(spark, tmp_path):
    path, totals = str(tmp_path / "in"), []
    write(spark, path, "0", [("a", 0, 1, 5), ("a", 0, 2, 3)])

    def keep(batch, number):
        totals.extend(r["total_weight"] for r in batch.select("total_weight").distinct().collect())

    for k in range(2):
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(path)
        items = windows.heavy_items(stream, ["g"], "h", "w", HeavySpec("micro"), ttl_ms=1)
        query = items.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).start()
        until = time.time() + 60
        while len(totals) <= k and time.time() < until:  # by processing time there is always a next batch
            time.sleep(0.2)
        query.stop()
        write(spark, path, str(k + 1), [("a", 0, 1, 5), ("a", 0, 2, 3)])
    assert totals == [8, 8]


def test_counters_on_a_heap():
    import random

    from tallyloom.operators.counters import Counters

    rng = random.Random(3)
    for size in (1, 2, 5, 17):
        heap, plain, error, total = Counters(size), {}, 0, 0
        for _ in range(3000):
            key, weight = rng.choice([rng.randrange(4), rng.randrange(60)]), rng.randrange(6)
            heap.add(key, weight)
            total += weight
            if key in plain:
                plain[key] += weight
            elif weight:
                while weight and len(plain) >= size:
                    gone = min(min(plain.values()) - error, weight)
                    error, weight = error + gone, weight - gone
                    plain = {k: v for k, v in plain.items() if v > error}
                if weight:
                    plain[key] = error + weight
        assert (heap.estimates, heap.error, heap.total) == (plain, error, total) and len(heap._heap) == len(plain)


