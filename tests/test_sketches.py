import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallyloom import errors
from tallyloom.functions import u64
from tallyloom.operators import bloom, heavy, hll, minhash
from tallyloom.profiles import BloomSpec, HeavySpec, HllSpec, MinHashSpec
from tallyloom.sources import packed, wire
from tallyloom.streaming import windows

MICRO = HllSpec("micro")


def hashes(spark, values, more=()):
    return spark.createDataFrame([(u64.signed(v), *more) for v in values], "h long")


def splitmix(seed, n):
    return [u64.mix64_int(((seed << 32) + i + 1) * 0x9E3779B97F4A7C15) for i in range(n)]


def cell(frame):
    return bytes(packed.pack(frame).first()["sketch"]).hex()


def test_hll_vector(spark):
    # A published vector.
    frame = hll.build(hashes(spark, [0x0018 << 48, 0x0022 << 48, 0x0024 << 48]), [], "h", MICRO)
    assert [tuple(r) for r in frame.sparse_registers().orderBy("idx").collect()] == [(24, 49), (34, 49), (36, 49)]
    assert cell(frame) == "0a20080110011a056d6963726f220970726f6d70743a763128013001a0010ca8011052120a04081810310a04082210310a0408241031"


def test_hll_promotion_and_order(spark):
    values = [(i << 48) | 1 for i in range(257)]
    at, over = (hll.build(hashes(spark, values[:n]), [], "h", MICRO) for n in (256, 257))
    assert at.summary().first()["representation_mode"] == hll.SPARSE
    assert over.summary().first()["representation_mode"] == hll.DENSE
    keys = splitmix(1, 900)
    whole = cell(hll.build(hashes(spark, keys), [], "h", MICRO))
    parts = [hll.build(hashes(spark, keys[k::3]), [], "h", MICRO) for k in range(3)]
    for order in itertools.permutations(parts):
        assert cell(order[0].merge(*order[1:])) == whole
    assert cell(parts[0].merge(parts[1]).merge(parts[2])) == whole == cell(parts[0].force_dense().merge(parts[1], parts[2]))


@pytest.mark.parametrize("n", [0, 1, 200, 1000, 15_000, 60_000])
def test_hll_accuracy(spark, n):
    estimate = hll.build(hashes(spark, splitmix(3, n)), [], "h", MICRO).estimate().collect()
    found = estimate[0]["estimate"] if estimate else 0
    assert abs(found - n) <= 3 * hll.standard_error(MICRO) * max(n, 1)


def test_hll_bias_curve_is_rising():
    for p in (12, 14, 15):
        raw, bias = hll.bias_points(p)
        assert all(a < b for a, b in zip(raw, raw[1:], strict=False)) and bias[0] == pytest.approx(raw[0]) and abs(bias[-1]) < 0.02 * raw[-1]


def test_merge_refused(spark):
    a = hll.build(hashes(spark, [1]), [], "h", MICRO)
    with pytest.raises(errors.PrecisionMismatchError):
        a.merge(hll.build(hashes(spark, [1]), [], "h", HllSpec("small")))
    with pytest.raises(errors.IncompatibleMergeError):
        a.merge(hll.build(hashes(spark, [1]), [], "h", HllSpec("micro", "user:v1")))
    with pytest.raises(errors.IncompatibleMergeError):
        bloom.build(hashes(spark, [1]), [], "h", BloomSpec("micro")).merge(bloom.build(hashes(spark, [1]).withColumn("k", F.lit(1)), ["k"], "h", BloomSpec("micro")))


def weights(n=20_000, keys=2000):
    return [(u64.mix64_int(i * 77 + 5) % keys, u64.mix64_int(0xABC000 + i) % 7 + 1) for i in range(n)]


@pytest.mark.parametrize("bounded", [False, True])
def test_heavy_bounds(spark, bounded):
    rows = weights()
    exact = {}
    for k, w in rows:
        exact[k] = exact.get(k, 0) + w
    df = spark.createDataFrame(rows, "h long, w long").repartition(4)
    spec = HeavySpec("micro")
    make = heavy.build_bounded if bounded else heavy.build
    parts = [make(df.where(F.col("w") % 3 == k), [], "h", "w", spec) for k in range(3)]
    for frame in (make(df, [], "h", "w", spec), parts[0].merge(*parts[1:])):
        items, totals = frame.items().collect(), frame.totals.first()
        total = sum(exact.values())
        assert totals["total_weight"] == total and totals["max_error"] <= total / (spec.map_size + 1) * (1 if not bounded else 3)
        assert len(items) <= spec.map_size and all(r["lower_bound"] <= exact[r["hash"]] <= r["upper_bound"] and r["estimate"] > totals["max_error"] for r in items)
        held = {r["hash"] for r in items}
        assert all(w <= totals["max_error"] for k, w in exact.items() if k not in held)
        assert {r["hash"] for r in frame.frequent_items(heavy.NO_FALSE_NEGATIVES).collect()} == held


def test_heavy_vector_and_refusals(spark):
    spec = HeavySpec("micro")
    df = spark.createDataFrame([(0x10, 5), (0x10, 7), (0x20, 3), (0x30, 0), (None, 4), (5, None)], "h long, w long")
    frame = heavy.build(df, [], "h", "w", spec)
    # A published vector.
    assert cell(frame) == "0a1e080210011a056d6963726f220970726f6d70743a763128013003b00180025a1c0a0b091000000000000000100c0a0b0920000000000000001003100f"
    assert [tuple(r) for r in frame.lookup(spark.createDataFrame([(0x10,), (0x99,)], "hash long")).orderBy("hash").collect()] == [(0x10, 12, 12, 12), (0x99, 0, 0, 0)]
    with pytest.raises(errors.InvalidQueryModeError):
        frame.frequent_items("SOME")
    with pytest.raises(Exception, match="negative"):
        heavy.build(spark.createDataFrame([(1, -1)], "h long, w long"), [], "h", "w", spec).items().collect()


def test_bloom_vector(spark):
    keys = [0x0102030405060708, 0x1112131415161718, 0xF0E0D0C0B0A09080]
    frame = bloom.build(hashes(spark, [*keys, keys[0]]), [], "h", BloomSpec("micro"))
    positions = [r["position"] for r in frame.set_bits().orderBy("position").collect()]
    # A published vector.
    assert len(positions) == 30 and positions[:6] == [3916, 6759, 14110, 23470, 29129, 34297] and positions[-1] == 127305
    row = frame.summary().first()
    assert row["inserted_count"] == 4 and row["false_positive_estimate"] == pytest.approx(1.5627715308604377e-37)
    probes = spark.createDataFrame([(u64.signed(k),) for k in [*keys, 0xDEADBEEFCAFEBABE]] + [(None,)], "hash long")
    assert sorted(r["may_contain"] for r in frame.may_contain(probes).collect()) == [False, False, True, True, True]


def test_bloom_rate(spark):
    held = bloom.build(hashes(spark, splitmix(7, 10_000)), [], "h", BloomSpec("micro"))
    probes = hashes(spark, splitmix(8, 20_000)).withColumnRenamed("h", "hash")
    wrong = held.may_contain(probes).where("may_contain").count()
    assert wrong <= 1.5 * 0.001 * 20_000
    assert held.may_contain(hashes(spark, splitmix(7, 500)).withColumnRenamed("h", "hash")).where("not may_contain").count() == 0


def test_minhash_vector(spark):
    spec = MinHashSpec("micro")
    rows = [("left", v) for v in (1, 2, 3)] + [("right", v) for v in (2, 3, 4)]
    frame = minhash.build(spark.createDataFrame(rows, "side string, h long"), ["side"], "h", spec)
    pairs = spark.createDataFrame([("left", "right"), ("left", "left")], "left_side string, right_side string")
    assert [r["jaccard"] for r in frame.jaccard(pairs).orderBy("right_side").collect()] == [1.0, 0.546875]
    merged = frame.rollup([]).signatures().select("populated_count", F.expr("transform(signature, x -> lpad(lower(hex(x)), 16, '0'))").alias("s")).first()
    # A published vector.
    assert merged["populated_count"] == 6 and merged["s"][:4] == ["6fe5961b4d08d811", "19922780094092c6", "10c7bb3de20f95b0", "59470229f9388347"]


def test_wire_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(f"g{i % 3}", u64.signed(v), i % 5) for i, v in enumerate(splitmix(9, 3000))], "g string, h long, w long")
    frames = [
        hll.build(df, ["g"], "h", MICRO), heavy.build(df, ["g"], "h", "w", HeavySpec("micro")), bloom.build(df, ["g"], "h", BloomSpec("micro")), minhash.build(df, ["g"], "h", MinHashSpec("micro")),
    ]
    for k, frame in enumerate(frames):
        before = {r["g"]: bytes(r["sketch"]) for r in packed.pack(frame).collect()}
        packed.write_sketches(frame, str(tmp_path / str(k)))
        after = {r["g"]: bytes(r["sketch"]) for r in packed.pack(packed.read_sketches(spark, str(tmp_path / str(k)))).collect()}
        assert before == after and len(before) == 3
    for g, raw in before.items():
        (tmp_path / f"{g}.pb").write_bytes(raw)
    found = packed.read_files(spark, f"file://{tmp_path}/*.pb", MinHashSpec("micro"), r"(g\d)\.pb")
    assert found.counts.count() == 3


@pytest.mark.parametrize("cut", range(1, 60, 7))
def test_wire_refuses_cut_bytes(cut):
    good = wire.encode(HeavySpec("micro"), wire.HeavyState([(16, 12), (32, 3)], 15, 0))
    assert wire.decode(good, HeavySpec)[1].total_weight == 15
    with pytest.raises(errors.SketchError):
        wire.decode(good[:-cut], HeavySpec)
    with pytest.raises(errors.SketchError):
        wire.decode(good, BloomSpec)


def test_wire_refuses_bad_states():
    bad = [
        (HeavySpec("micro"), wire.HeavyState([(1, 3)], 2, 3)), (HeavySpec("micro"), wire.HeavyState([(1, 3), (1, 3)], 9, 0)), (BloomSpec("micro"), wire.BloomState(b"\1" * 10, 1)),
        (BloomSpec("small"), wire.BloomState(b"\0" * 179_719 + b"\x80", 1)), (MinHashSpec("micro"), wire.MinHashState([1] * 64, 0)), (MinHashSpec("micro"), wire.MinHashState([1] * 63, 5)),
        (HllSpec("micro"), wire.HllState(True, [(1, 60)])),
    ]
    for spec, state in bad:
        with pytest.raises(errors.SketchError):
            wire.decode(wire.encode(spec, state), type(spec))


def test_streaming_heavy_items(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = weights(4000, 50)
    spark.createDataFrame([("a" if i % 2 else "b", k, w) for i, (k, w) in enumerate(rows)], "g string, h long, w long").repartition(3).write.parquet(src)
    stream = spark.readStream.schema("g string, h long, w long").option("maxFilesPerTrigger", 1).parquet(src)
    items = windows.heavy_items(stream, ["g"], "h", "w", HeavySpec("micro"))
    last = {}

    def keep(batch, number):
        for r in batch.collect():
            last[r["g"], r["hash"]] = r["estimate"]

    items.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    exact = {}
    for i, (k, w) in enumerate(rows):
        key = ("a" if i % 2 else "b", k)
        exact[key] = exact.get(key, 0) + w
    assert last == exact


def test_empty_sketches(spark):
    none = hashes(spark, []).withColumn("w", F.lit(1)).withColumn("k", F.lit("a"))
    empty = hll.build(none, [], "h", MICRO)
    assert tuple(empty.summary().select("representation_mode", "sparse_count", "estimate").first()) == (hll.SPARSE, 0, 0.0)
    back = packed.parse(packed.pack(empty).withColumn("k", F.lit("a")), ["k"], MICRO)
    assert [tuple(r) for r in back.estimate().collect()] == [("a", 0.0)]
    full = hll.build(hashes(spark, [5]).withColumn("k", F.lit("b")), ["k"], "h", MICRO)
    assert sorted(r["k"] for r in back.merge(full).estimate().collect()) == ["a", "b"]
    heavy_none = heavy.build(none, [], "h", "w", HeavySpec("micro"))
    assert tuple(heavy_none.totals.first()) == (0, 0)
    assert packed.parse(packed.pack(heavy_none), [], HeavySpec("micro")).items().count() == 0


def test_heavy_default_needs_no_single_task(spark):
    rows = spark.createDataFrame([(i % 3000, i % 7 + 1) for i in range(9000)], "h long, w long")
    for keys in ([], ["k"]):
        frame = heavy.build(rows.withColumn("k", F.lit(1)), keys, "h", "w", HeavySpec("default"))
        sums = {}
        for i in range(9000):
            sums[i % 3000] = sums.get(i % 3000, 0) + i % 7 + 1
        cut = sorted(sums.values(), reverse=True)[1024]
        assert frame.totals.first()["max_error"] == cut
        assert {r["_hash"]: r["_estimate"] for r in frame.entries.collect()} == {h: w for h, w in sums.items() if w > cut}


def test_verdicts_tell_rows_apart(spark):
    good = packed.pack(hll.build(hashes(spark, [1, 2]), [], "h", MICRO))
    cells = good.union(good.select(F.substring("sketch", 1, 9))).union(good.select(F.lit(None).cast("binary")))
    found = [r[0] for r in cells.select(packed.verdict("sketch", MICRO)).collect()]
    assert found[0] is None and found[1].startswith("WireError") and found[2] is None


def test_negative_weights_are_refused():
    with pytest.raises(errors.NegativeWeightError):
        heavy.Counters(4).add(1, -1)


def test_errors_inside_queries(spark):
    largest = (1 << 63) - 1
    spec = HeavySpec("micro")
    cases = [
        (errors.NegativeWeightError, lambda: heavy.build(spark.createDataFrame([(1, -1)], "h long, w long"), [], "h", "w", spec).totals),
        (errors.SketchOverflowError, lambda: heavy.build(spark.createDataFrame([(1, largest), (2, 1)], "h long, w long"), [], "h", "w", spec).totals),
        (errors.SketchOverflowError, lambda: heavy.build(spark.createDataFrame([(1, largest), (1, 1)], "h long, w long"), [], "h", "w", spec).items()),
        (errors.SketchOverflowError, lambda: heavy.build_bounded(spark.createDataFrame([(1, largest), (1, 1)], "h long, w long").coalesce(1), [], "h", "w", spec).totals),
    ]
    for kind, state in ((BloomSpec("micro"), wire.BloomState(b"\0" * 17_972, largest)), (MinHashSpec("micro"), wire.MinHashState([1] * 64, largest))):
        cells = spark.createDataFrame([(bytearray(wire.encode(kind, state)),)] * 2, "sketch binary")
        cases.append((errors.SketchOverflowError, lambda cells=cells, kind=kind: packed.parse(cells, [], kind).counts))
    cells = spark.createDataFrame([(bytearray(b"no sketch"),)], "sketch binary")
    cases.append((errors.WireError, lambda: packed.parse(cells, [], MICRO).registers))
    for kind, make in cases:
        with pytest.raises(kind), errors.typed_errors():
            make().collect()
    with pytest.raises(ZeroDivisionError), errors.typed_errors():
        raise ZeroDivisionError


def test_cells_of_several_kinds(spark):
    some = hashes(spark, splitmix(1, 300)).withColumn("g", F.when(F.col("h") % 2 == 0, "a"))
    frames = [hll.build(some, ["g"], "h", MICRO), minhash.build(some, ["g"], "h", MinHashSpec("micro")), bloom.build(some, ["g"], "h", BloomSpec("micro"))]
    cells = packed.pack(frames[0]).unionByName(packed.pack(frames[1])).unionByName(packed.pack(frames[2]))
    twice = cells.unionByName(cells).unionByName(cells.select("g", F.lit(None).cast("binary").alias("sketch")))
    key = lambda rows: {(r["g"], r["sketch"][:8].hex(), len(r["sketch"])) for r in rows}
    merged = packed.merge_cells(twice, ["g"]).collect()
    assert len(merged) == 6 and {(r["g"], r["kind"], r["profile"], r["domain"]) for r in merged} == {(g, k, "micro", "prompt:v1") for g in ("a", None) for k in ("hll", "minhash", "bloom")}
    assert {bytes(r["sketch"]) for r in merged if r["kind"] == "hll"} == {bytes(r["sketch"]) for r in packed.pack(frames[0]).collect()} and key(merged)
    other = packed.pack(hll.build(some, ["g"], "h", HllSpec("small")))
    mixed = cells.unionByName(other.where("g = 'a'"))
    assert [tuple(r) for r in packed.mixed_groups(mixed, ["g"]).collect()] == [("a", "hll", ["micro prompt:v1", "small prompt:v1"])]
    with pytest.raises(errors.IncompatibleMergeError):
        packed.merge_cells(mixed, ["g"])
    assert packed.merge_cells(mixed, ["g"], apart=True).count() == 7
    assert packed.merge_cells(cells.where("false"), ["g"]).count() == 0


def test_sketch_source(spark, tmp_path):
    import json
    import os

    from tallyloom.sources.datasource import register_source

    register_source(spark)
    path = str(tmp_path / "cells")
    some = hashes(spark, splitmix(2, 400)).withColumn("g", (F.col("h") % 7).cast("string"))
    cells = packed.pack(hll.build(some, ["g"], "h", MICRO)).repartition(3)
    more = packed.pack(minhash.build(some, ["g"], "h", MinHashSpec("micro")))
    cells.write.format("sketch").mode("append").save(path)
    more.write.format("sketch").mode("append").save(path)
    rows = lambda df: sorted((r["g"], bytes(r["sketch"])) for r in df.collect())
    read = spark.read.format("sketch")
    assert rows(read.load(path)) == sorted(rows(cells) + rows(more))
    assert rows(spark.read.format("sketch").option("kind", "minhash").load(path)) == rows(more)
    assert spark.read.format("sketch").option("profile", "default").load(path).count() == 0
    manifest = json.loads((tmp_path / "cells" / "manifest.json").read_text())
    assert sum(s["rows"] for s in manifest["shards"]) == cells.count() + more.count()
    bad = cells.unionByName(spark.createDataFrame([("x", bytearray(b"no sketch"))], "g string, sketch binary"))
    with pytest.raises(errors.WireError), errors.typed_errors():
        bad.write.format("sketch").mode("append").save(path)
    assert json.loads((tmp_path / "cells" / "manifest.json").read_text()) == manifest and read.load(path).count() == cells.count() + more.count()
    with pytest.raises(Exception, match="other columns"):
        cells.withColumn("more", F.lit(1)).write.format("sketch").mode("append").save(path)
    cells.limit(2).write.format("sketch").mode("overwrite").save(path)
    assert read.load(path).count() == 2
    listed = {s["file"] for s in json.loads((tmp_path / "cells" / "manifest.json").read_text())["shards"]}
    assert listed <= set(os.listdir(path))
