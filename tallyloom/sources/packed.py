"""Sketch frames as one binary cell a group, and back; files of such cells.

A cell holds one bounded sketch (at most 4 MiB), so packing gathers one group's registers into one row and
no more.  Files are Parquet with a ``sketch`` column, or single ``.pb`` files read as binary files.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.errors import IncompatibleMergeError, SketchError
from tallyloom.functions import u64
from tallyloom.operators import bloom, heavy, hll, minhash
from tallyloom.operators.frames import join_keys, union
from tallyloom.profiles import KIND_NAMES, KINDS, BloomSpec, HeavySpec, HllSpec, MinHashSpec, Spec
from tallyloom.sources import wire


def pack_hll(frame: hll.HllFrame) -> DataFrame:
    """``keys, sketch``; a large group that keeps sparse registers has several cells, none with more than the format allows."""
    spec = frame.spec

    @F.pandas_udf("binary")
    def encode(dense: pd.Series, idx: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series([wire.encode(spec, wire.HllState(bool(d), list(zip(map(int, i), map(int, r), strict=True)))) for d, i, r in zip(dense, idx, rank, strict=True)])

    each = frame.grouped(F.array_sort(F.collect_list(F.struct(F.col("_idx").alias("idx"), F.col("_rank").alias("rank")))).alias("_r"))
    each = each.withColumn("_r", F.coalesce("_r", F.array().cast("array<struct<idx:int,rank:int>>")))
    if frame.keep_sparse:
        starts = F.sequence(F.lit(1), F.greatest(F.size("_r"), F.lit(1)), F.lit(spec.promotion))
        cut = F.when(F.col("_dense"), F.array("_r")).otherwise(F.transform(starts, lambda at: F.slice("_r", at, spec.promotion)))
        each = each.select(*frame.keys, "_dense", F.explode(cut).alias("_r"))
    return each.select(*frame.keys, encode("_dense", F.col("_r.idx"), F.col("_r.rank")).alias("sketch"))


def pack_heavy(frame: heavy.HeavyFrame) -> DataFrame:
    spec = frame.spec

    @F.pandas_udf("binary")
    def encode(hashes: pd.Series, estimates: pd.Series, total: pd.Series, error: pd.Series) -> pd.Series:
        return pd.Series([wire.encode(spec, wire.HeavyState(list(zip(map(int, h), map(int, e), strict=True)), int(t), int(x))) for h, e, t, x in zip(hashes, estimates, total, error, strict=True)])

    held = F.collect_list(F.struct(F.col("_hash").alias("hash"), F.col("_estimate").alias("estimate")))
    each = frame.entries.groupBy(*frame.keys).agg(held.alias("_r"))
    joined = join_keys(frame.totals, each, frame.keys, "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<struct<hash:bigint,estimate:bigint>>")))
    return joined.select(*frame.keys, encode(F.col("_r.hash"), F.col("_r.estimate"), "total_weight", "max_error").alias("sketch"))


def pack_bloom(frame: bloom.BloomFrame) -> DataFrame:
    spec = frame.spec
    size = (spec.bits + 7) // 8

    @F.pandas_udf("binary")
    def encode(buckets: pd.Series, bitmaps: pd.Series, count: pd.Series) -> pd.Series:
        out = []
        for b, maps, n in zip(buckets, bitmaps, count, strict=True):
            bits = bytearray(-(-size // (bloom.BUCKET_BITS // 8)) * (bloom.BUCKET_BITS // 8))
            for k, own in zip(b, maps, strict=True):
                bits[int(k) * 4096 : (int(k) + 1) * 4096] = own
            out.append(wire.encode(spec, wire.BloomState(bytes(bits[:size]), int(n))))
        return pd.Series(out)

    each = frame.buckets.groupBy(*frame.keys).agg(F.collect_list(F.struct(F.col("_bucket").alias("bucket"), F.col("_bitmap").alias("bitmap"))).alias("_r"))
    joined = join_keys(frame.counts, each, frame.keys, "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<struct<bucket:bigint,bitmap:binary>>")))
    return joined.select(*frame.keys, encode(F.col("_r.bucket"), F.col("_r.bitmap"), "inserted_count").alias("sketch"))


def pack_minhash(frame: minhash.MinHashFrame) -> DataFrame:
    spec = frame.spec

    @F.pandas_udf("binary")
    def encode(signature: pd.Series, count: pd.Series) -> pd.Series:
        return pd.Series([wire.encode(spec, wire.MinHashState([int(v) for v in s], int(n))) for s, n in zip(signature, count, strict=True)])

    return frame.signatures().select(*frame.keys, encode("signature", "populated_count").alias("sketch"))


def pack(frame) -> DataFrame:
    """``keys, sketch``: the canonical bytes of every group."""
    kinds = {hll.HllFrame: pack_hll, heavy.HeavyFrame: pack_heavy, bloom.BloomFrame: pack_bloom, minhash.MinHashFrame: pack_minhash}
    return kinds[type(frame)](frame)


def verdict(cells: Column | str, spec: Spec) -> Column:
    """Why packed sketches can't be read as ``spec``, or merged with such: null where they can, or are null."""
    kind = type(spec)

    @F.pandas_udf("string")
    def judge(raw: pd.Series) -> pd.Series:
        def one(value: bytes | None) -> str | None:
            try:
                if value is not None and wire.decode(bytes(value), kind)[0] != spec:
                    return f"{IncompatibleMergeError.__name__}: another profile or domain"
            except SketchError as e:
                return f"{type(e).__name__}: {e}"
            return None

        return pd.Series([one(v) for v in raw], dtype=object)

    return judge(cells)


_PARSED = "profile string, domain string, dense boolean, idx array<int>, rank array<int>, hash array<bigint>, estimate array<bigint>, total bigint, error bigint, bitset binary"


def parse(cells: DataFrame, keys: list[str], spec: Spec, column: str = "sketch", keep_sparse: bool = False):
    """The frame of packed sketches; cells of equal keys are merged, and those of distinct counts become dense only if a
    cell is, where ``keep_sparse`` says so.

    Bytes that are no canonical sketch of this kind fail the query, and so do sketches whose profile or
    domain isn't that of ``spec``: they couldn't be merged.  ``verdict`` tells such rows apart beforehand.
    Null cells add nothing; empty sketches keep their group.
    """
    kind = type(spec)

    @F.pandas_udf(_PARSED)
    def decode(raw: pd.Series) -> pd.DataFrame:
        rows = []
        for one in raw:
            if one is None:
                rows.append((None,) * 10)
                continue
            own, state = wire.decode(bytes(one), kind)
            if own != spec:
                raise IncompatibleMergeError(f"{own} where {spec} is expected")
            head = (own.profile, own.domain)
            if isinstance(state, wire.HllState):
                rows.append((*head, state.dense, [i for i, _ in state.registers], [r for _, r in state.registers], None, None, None, None, None))
            elif isinstance(state, wire.HeavyState):
                rows.append((*head, None, None, None, [u64.signed(h) for h, _ in state.entries], [e for _, e in state.entries], state.total_weight, state.max_error, None))
            elif isinstance(state, wire.BloomState):
                rows.append((*head, None, None, None, None, None, state.inserted_count, None, state.bitset))
            else:
                rows.append((*head, None, None, None, [u64.signed(v) for v in state.signature], None, state.populated_count, None, None))
        out = pd.DataFrame(rows, columns=["profile", "domain", "dense", "idx", "rank", "hash", "estimate", "total", "error", "bitset"])
        return out.astype({"dense": "boolean", "total": "Int64", "error": "Int64"})

    parsed = cells.where(F.col(column).isNotNull()).select(*keys, decode(column).alias("_p"))
    if kind is HllSpec:
        each = parsed.select(*keys, F.col("_p.dense").alias("_dense"), F.explode(F.arrays_zip("_p.idx", "_p.rank")).alias("_r"))
        rows = each.select(*keys, "_dense", F.col("_r.idx").alias("_idx"), F.col("_r.rank").alias("_rank"))
        return hll._settled(rows, keys, spec, parsed.select(*keys) if keys else None, keep_sparse)
    if kind is HeavySpec:
        totals = parsed.select(*keys, F.col("_p.total").alias("total_weight"), F.col("_p.error").alias("max_error"))
        entries = parsed.select(*keys, F.col("_p.error").alias("_error"), F.explode(F.arrays_zip("_p.hash", "_p.estimate")).alias("_r"))
        return heavy._cut(entries.select(*keys, F.col("_r.hash").alias("_hash"), (F.col("_r.estimate") - F.col("_error")).alias("_weight")), totals, keys, spec)
    if kind is BloomSpec:
        n = -(-((spec.bits + 7) // 8) // 4096)
        each = parsed.select(*keys, F.col("_p.bitset").alias("_bits"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_bucket"))
        whole = F.rpad(F.substring(F.col("_bits"), F.col("_bucket") * 4096 + 1, F.lit(4096)), 4096, F.unhex(F.lit("00")))
        buckets = each.select(*keys, F.col("_bucket").cast("long").alias("_bucket"), whole.alias("_bitmap")).where(F.bitmap_count("_bitmap") > 0)
        return bloom._combined(buckets, parsed.select(*keys, F.col("_p.total").alias("inserted_count")), keys, spec)
    minima = parsed.select(*keys, F.posexplode("_p.hash").alias("_i", "_low"))
    return minhash._combined(minima, parsed.select(*keys, F.col("_p.total").alias("populated_count")), keys, spec)


#: Bytes from the start of a sketch that hold its metadata whole.
HEAD_BYTES = 256


def described(cells: Column | str) -> Column:
    """``kind, profile, domain`` of packed sketches, from their own bytes; only their first bytes leave the JVM.

    Null for null; bytes whose metadata is none fail the query.
    """

    def read(heads: pa.Array) -> pa.Array:
        found = [None if h is None else wire.specification(h) for h in heads.to_pylist()]
        rows = [None if s is None else {"kind": KIND_NAMES[type(s)], "profile": s.profile, "domain": s.domain} for s in found]
        return pa.array(rows, pa.struct([(c, pa.string()) for c in ("kind", "profile", "domain")]))

    return F.arrow_udf(read, "kind string, profile string, domain string")(F.substring(cells, 1, HEAD_BYTES))


def mixed_groups(cells: DataFrame, keys: list[str], column: str = "sketch") -> DataFrame:
    """``keys, kind, specifications``: groups whose sketches of one kind can't be merged, as profile or domain differ."""
    heads = cells.where(F.col(column).isNotNull()).select(*keys, described(column).alias("_is")).select(*keys, "_is.*")
    each = heads.groupBy(*keys, "kind").agg(F.array_sort(F.collect_set(F.concat_ws(" ", "profile", "domain"))).alias("specifications"))
    return each.where(F.size("specifications") > 1)  # at most one for each profile and domain


def parse_any(cells: DataFrame, keys: list[str], column: str = "sketch", apart: bool = False, keep_sparse: bool = False) -> dict[Spec, object]:
    """Frames of packed sketches by their specifications, which the bytes tell; cells of equal keys are merged.

    A column may hold several kinds, which never meet.  Sketches of one kind but of another profile or domain can't be
    merged: a group with both raises ``IncompatibleMergeError``, unless they are to stay ``apart``.  The
    specifications come to the driver (4 kinds, at most 4 profiles and 8 domains each), then each of
    them reads the cells that are its own.
    """
    known = cells.where(F.col(column).isNotNull()).withColumn("_is", described(column))
    found = known.select("_is.*").distinct().collect()
    specs = [KINDS[r["kind"]](r["profile"], r["domain"]) for r in found]
    if not apart and len({type(s) for s in specs}) < len(specs):
        for group in mixed_groups(cells, keys, column).limit(1).collect():
            where = ", ".join(f"{k}={group[k]!r}" for k in keys) or "the table"
            raise IncompatibleMergeError(f"{where} has sketches of {' and '.join(group['specifications'])}")

    def of(s: Spec) -> DataFrame:
        own = (F.col("_is.kind") == KIND_NAMES[type(s)]) & (F.col("_is.profile") == s.profile) & (F.col("_is.domain") == s.domain)
        return known.withColumn(column, F.when(own, F.col(column)))  # others are null to the decoder, wherever Spark puts the filter

    return {s: parse(of(s), keys, s, column, keep_sparse) for s in specs}


def merge_cells(cells: DataFrame, keys: list[str], column: str = "sketch", apart: bool = False) -> DataFrame:
    """``keys, kind, profile, domain, sketch``: the packed sketches of each group merged, without being told what they are."""
    merged = [
        pack(frame).select(*keys, F.lit(KIND_NAMES[type(spec)]).alias("kind"), F.lit(spec.profile).alias("profile"), F.lit(spec.domain).alias("domain"), "sketch")
        for spec, frame in parse_any(cells, keys, column, apart).items()
    ]
    return union(merged) if merged else cells.where("false").select(*keys, *[F.lit("").alias(c) for c in ("kind", "profile", "domain")], column)


def write_sketches(frame, path: str) -> None:
    """Parquet with the keys and a ``sketch`` column, and a JSON manifest of what they are beside it."""
    spec = frame.spec
    pack(frame).write.parquet(path)
    rows = [(type(spec).__name__, spec.profile, spec.domain, spec.algorithm, frame.keys)]
    frame_of = frame.counts if hasattr(frame, "counts") else frame.totals if hasattr(frame, "totals") else frame.registers
    frame_of.sparkSession.createDataFrame(rows, "kind string, profile string, domain string, algorithm string, keys array<string>").coalesce(1).write.json(f"{path}.manifest")


def read_sketches(spark: SparkSession, path: str):
    """The frame that ``write_sketches`` wrote."""
    row = spark.read.schema("kind string, profile string, domain string, algorithm string, keys array<string>").json(f"{path}.manifest").first()
    kinds = {k.__name__: k for k in (HllSpec, HeavySpec, BloomSpec, MinHashSpec)}
    return parse(spark.read.parquet(path), list(row["keys"]), kinds[row["kind"]](row["profile"], row["domain"], row["algorithm"]))


def read_files(spark: SparkSession, path: str, spec: Spec, key_pattern: str, key: str = "shard"):
    """Single-sketch files, as other programs write them, grouped by what ``key_pattern`` finds in their path."""
    files = spark.read.format("binaryFile").load(path)
    return parse(files.select(F.regexp_extract("path", key_pattern, 1).alias(key), F.col("content").alias("sketch")), [key], spec)
