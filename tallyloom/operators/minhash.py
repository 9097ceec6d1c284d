"""Set similarity: MinHash signatures as rows, one for each function of the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tallyloom.errors import checked_sum
from tallyloom.functions import u64
from tallyloom.operators.frames import grouped_sets, join_keys, named, require_mergeable, union
from tallyloom.operators.parts import MinHashPart
from tallyloom.profiles import MinHashSpec

REPRESENTATION = "MINHASH_SIGNATURE"


@dataclass(frozen=True)
class MinHashFrame:
    """``minima``: ``keys, _i, _low`` (the unsigned minimum as a long); ``counts``: ``keys, populated_count``."""

    minima: DataFrame
    counts: DataFrame
    keys: list[str]
    spec: MinHashSpec

    def merge(self, *others: MinHashFrame) -> MinHashFrame:
        require_mergeable(self, list(others))
        parts = [self, *others]
        return _combined(union([p.minima for p in parts]), union([p.counts for p in parts]), self.keys, self.spec)

    def rollup(self, keys: list[str]) -> MinHashFrame:
        """Merge over the keys that are left out."""
        return _combined(self.minima.select(*keys, "_i", "_low"), self.counts.select(*keys, "populated_count"), keys, self.spec)

    def grouping_sets(self, sets: list[list[str]]) -> MinHashFrame:
        """Merged over several sets of the keys at once, see ``grouped_sets``."""
        parts = [grouped_sets(t, self.keys, sets) for t in (self.minima, self.counts)]
        return _combined(*parts, ["grouping_id", *self.keys], self.spec)

    def signatures(self) -> DataFrame:
        """``keys, populated_count, signature``: the minima in order, all ones where nothing was added."""
        ordered = F.array_sort(F.collect_list(F.struct("_i", "_low")))
        lows = F.transform(ordered, lambda s: s["_low"])
        arrays = self.minima.groupBy(*self.keys).agg(F.when(F.size(lows) > 0, lows).alias("signature"))  # without keys a row even of none
        empty = F.array_repeat(F.lit(-1).cast("long"), self.spec.k)
        return join_keys(self.counts, arrays, self.keys, "left").withColumn("signature", F.coalesce("signature", empty))

    def jaccard(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``jaccard``, the share of equal minima; ``left_`` and ``right_`` columns name the groups.

        Two empty sketches are equal, an empty one and another share nothing.
        """
        left = self.signatures().select(*[F.col(k).alias(f"left_{k}") for k in self.keys], F.col("populated_count").alias("_n1"), F.col("signature").alias("_s1"))
        right = self.signatures().select(*[F.col(k).alias(f"right_{k}") for k in self.keys], F.col("populated_count").alias("_n2"), F.col("signature").alias("_s2"))
        joined = join_keys(join_keys(pairs, left, [f"left_{k}" for k in self.keys]), right, [f"right_{k}" for k in self.keys])
        return joined.withColumn("jaccard", similarity(F.col("_s1"), F.col("_s2"), F.col("_n1"), F.col("_n2"), self.spec)).drop("_s1", "_s2", "_n1", "_n2")


def similarity(a: Column, b: Column, n_a: Column, n_b: Column, spec: MinHashSpec) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, v: s + v)
    return F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0), 0.0).otherwise(same / F.lit(float(spec.k)))


def _combined(minima: DataFrame, counts: DataFrame, keys: list[str], spec: MinHashSpec) -> MinHashFrame:
    low = u64.ordered(F.min(u64.ordered(F.col("_low"))))
    merged = minima.groupBy(*keys, "_i").agg(low.alias("_low"))
    return MinHashFrame(merged, counts.groupBy(*keys).agg(checked_sum("populated_count").alias("populated_count")), keys, spec)


def minima_rows(df: DataFrame, keys: list[str], hashed: Column | str, spec: MinHashSpec) -> DataFrame:
    """``keys, _i, _low``; also what a streaming aggregation keeps."""
    family = F.array(*[F.lit(s).cast("long") for s in u64.seeds(u64.MINHASH_SEED, spec.k)])
    each = df.where(named(hashed).isNotNull()).select(*keys, named(hashed).alias("_h"), F.posexplode(family).alias("_i", "_seed"))
    each = u64.mixed(each.withColumn("_low", F.col("_h").bitwiseXOR(F.col("_seed"))), "_low")
    return each.groupBy(*keys, "_i").agg(u64.ordered(F.min(u64.ordered(F.col("_low")))).alias("_low"))


#: Groups whose minima a task holds at once.
HELD = 256


def _partial(rows: DataFrame, keys: list[str], spec: MinHashSpec) -> DataFrame:
    """``keys, populated_count, lows``: the minima of each task's rows, an array for each group that it has."""
    schema = rows.select(*keys).schema.add("populated_count", LongType()).add("lows", ArrayType(LongType()))

    def handed_on(held: dict[tuple, MinHashPart], types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        lows = pa.array([p.low.view(np.int64).tolist() for p in held.values()], pa.list_(pa.int64()))
        return pa.record_batch([*columns, pa.array([p.count for p in held.values()], pa.int64()), lows], names=[*keys, "populated_count", "lows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, MinHashPart] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            if keys:
                grouped = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([("_h", "list")])
                owners = zip(*(grouped.column(k).to_pylist() for k in keys), strict=True)
                each = [(key, values.values) for key, values in zip(owners, grouped.column("_h_list"), strict=True)]
            else:
                each = [((), batch.column("_h"))]
            for key, values in each:
                held.setdefault(key, MinHashPart(spec)).add(values.to_numpy().view(np.uint64))
            if len(held) > HELD:
                yield handed_on(held, types)
                held = {}
        if held:
            yield handed_on(held, types)

    return rows.select(*keys, "_h").mapInArrow(run, schema)


def build(df: DataFrame, keys: list[str], hashed: Column | str, spec: MinHashSpec) -> MinHashFrame:
    """Sketches of the hashes in ``hashed``, counted with repeats.

    Tasks reduce their rows to minima first, by arrays of hashes, so an array of ``k`` numbers is shuffled for each
    task and group, however many rows and distinct hashes there are.  Null hashes add nothing.
    """
    rows = df.where(named(hashed).isNotNull()).select(*keys, named(hashed).cast("long").alias("_h"))
    partial = _partial(rows, keys, spec)
    return _combined(partial.select(*keys, F.posexplode("lows").alias("_i", "_low")), partial.select(*keys, "populated_count"), keys, spec)
