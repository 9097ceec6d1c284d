"""Membership: Bloom bitsets as rows of 4096-byte buckets.

Positions are aggregated by ``bitmap_construct_agg``, which Spark combines before the shuffle; merging is
``bitmap_or_agg``.  No bitset is ever whole in one row until it is packed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import checked_sum
from tallyloom.functions import u64
from tallyloom.operators.frames import grouped_sets, join_keys, named, require_mergeable, union
from tallyloom.profiles import BloomSpec

BUCKET_BITS = 32768
REPRESENTATION = "BLOOM_BITSET"


def with_positions(df: DataFrame, hashed: str, spec: BloomSpec) -> DataFrame:
    """A row of ``df`` for every bit ``_position`` of its hash."""
    family = F.array(*[F.lit(s).cast("long") for s in u64.seeds(u64.BLOOM_SEED, spec.hashes)])
    each = df.withColumn("_seed", F.explode(family)).withColumn("_position", F.col(hashed).bitwiseXOR(F.col("_seed"))).drop("_seed")
    return u64.mixed(each, "_position").withColumn("_position", u64.modulo(F.col("_position"), spec.bits))


@dataclass(frozen=True)
class BloomFrame:
    """``buckets``: ``keys, _bucket, _bitmap``; ``counts``: ``keys, inserted_count`` (calls, repeats included)."""

    buckets: DataFrame
    counts: DataFrame
    keys: list[str]
    spec: BloomSpec

    def merge(self, *others: BloomFrame) -> BloomFrame:
        require_mergeable(self, list(others))
        parts = [self, *others]
        return _combined(union([p.buckets for p in parts]), union([p.counts for p in parts]), self.keys, self.spec)

    def rollup(self, keys: list[str]) -> BloomFrame:
        """Merge over the keys that are left out."""
        return _combined(self.buckets.select(*keys, "_bucket", "_bitmap"), self.counts.select(*keys, "inserted_count"), keys, self.spec)

    def grouping_sets(self, sets: list[list[str]]) -> BloomFrame:
        """Merged over several sets of the keys at once, see ``grouped_sets``."""
        parts = [grouped_sets(t, self.keys, sets) for t in (self.buckets, self.counts)]
        return _combined(*parts, ["grouping_id", *self.keys], self.spec)

    def summary(self) -> DataFrame:
        """``keys, inserted_count, set_bit_count, false_positive_estimate``."""
        bits = self.buckets.groupBy(*self.keys).agg(F.sum(F.bitmap_count("_bitmap")).alias("set_bit_count"))
        joined = join_keys(self.counts, bits, self.keys, "left").withColumn("set_bit_count", F.coalesce("set_bit_count", F.lit(0)))
        rate = F.pow(F.col("set_bit_count") / F.lit(float(self.spec.bits)), F.lit(float(self.spec.hashes)))
        return joined.select(*self.keys, "inserted_count", "set_bit_count", rate.alias("false_positive_estimate"))

    def set_bits(self) -> DataFrame:
        """``keys, position`` of all bits that are set."""
        byte = lambda b, i: F.conv(F.hex(F.substring(b, i + 1, F.lit(1))), 16, 10).cast("int")
        every = self.buckets.select(*self.keys, "_bucket", "_bitmap", F.explode(F.sequence(F.lit(0), F.lit(BUCKET_BITS // 8 - 1))).alias("_i"))
        every = every.withColumn("_byte", byte(F.col("_bitmap"), F.col("_i"))).where("_byte <> 0")
        every = every.select(*self.keys, "_bucket", "_i", "_byte", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("_bit"))
        return every.where(F.expr("shiftright(_byte, _bit) & 1 = 1")).select(*self.keys, (F.col("_bucket") * BUCKET_BITS + F.col("_i") * 8 + F.col("_bit")).alias("position"))

    def may_contain(self, probes: DataFrame, hashed: str = "hash") -> DataFrame:
        """``probes`` with ``may_contain``: false is certain; true may be wrong, if seldom.

        Every probe's positions meet the buckets by a join, so neither side has to fit anywhere; probes that
        repeat are looked up once.  A null hash, or keys without a sketch, give false.
        """
        distinct = probes.select(*self.keys, hashed).where(F.col(hashed).isNotNull()).distinct()
        each = with_positions(distinct, hashed, self.spec)
        each = each.withColumn("_bucket", F.floor(F.col("_position") / BUCKET_BITS).cast("long")).withColumn("_offset", (F.col("_position") % BUCKET_BITS).cast("int"))
        met = join_keys(each, self.buckets, [*self.keys, "_bucket"], "left")
        byte = F.conv(F.hex(F.substring(F.col("_bitmap"), F.shiftright("_offset", 3) + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.coalesce(F.getbit(byte.cast("long"), F.col("_offset") % 8), F.lit(0).cast("byte"))
        judged = met.select(*self.keys, hashed, is_set.alias("_bit")).groupBy(*self.keys, hashed).agg((F.min("_bit") == 1).alias("may_contain"))
        return join_keys(probes, judged, [*self.keys, hashed], "left").withColumn("may_contain", F.coalesce("may_contain", F.lit(False)))


def _combined(buckets: DataFrame, counts: DataFrame, keys: list[str], spec: BloomSpec) -> BloomFrame:
    merged = buckets.groupBy(*keys, "_bucket").agg(F.bitmap_or_agg("_bitmap").alias("_bitmap"))
    return BloomFrame(merged, counts.groupBy(*keys).agg(checked_sum("inserted_count").alias("inserted_count")), keys, spec)


def bucket_rows(df: DataFrame, keys: list[str], hashed: Column | str, spec: BloomSpec) -> DataFrame:
    """``keys, _bucket, _bitmap``; also what a streaming aggregation keeps."""
    each = with_positions(df.where(named(hashed).isNotNull()).select(*keys, named(hashed).alias("_h")), "_h", spec)
    bucket = F.floor(F.col("_position") / BUCKET_BITS).cast("long")
    return each.groupBy(*keys, bucket.alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_position") % BUCKET_BITS).alias("_bitmap"))


def build(df: DataFrame, keys: list[str], hashed: Column | str, spec: BloomSpec) -> BloomFrame:
    """Sketches of the hashes in ``hashed``; null hashes add nothing."""
    rows = df.where(named(hashed).isNotNull())
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("inserted_count"))
    return BloomFrame(bucket_rows(rows, keys, hashed, spec), counts, keys, spec)
