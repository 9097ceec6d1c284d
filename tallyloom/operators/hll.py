"""Approximate distinct counts: HLL++ registers as rows.

A sketch is the set of rows ``(keys, _dense, _idx, _rank)`` of its group.  Building is one hash aggregation by
``max``, which Spark combines before the shuffle, so a hot group never meets in one task; merging is the
same aggregation over a union.  The rows of a group number ``2**p`` at most once it is dense.  With ``keep_sparse`` large
groups aren't made dense: they keep the precision of sparse registers, in ``2**sp`` rows at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import u64
from tallyloom.operators.frames import grouped_sets, join_keys, named, require_mergeable, union
from tallyloom.profiles import LINEAR_LIMITS, HllSpec

SPARSE, DENSE = "HLLPP_SPARSE", "HLLPP_DENSE"
#: Nearest points of the bias curve whose mean corrects a raw estimate, and points of the curve.
NEIGHBOURS, POINTS = 6, 201


def register(h: Column, precision: int) -> tuple[Column, Column]:
    """Index and rank of a hash: its top bits, and the leading zeros of the others plus one."""
    width = 64 - precision
    low = h.bitwiseAND(F.lit((1 << width) - 1))
    return F.shiftrightunsigned(h, width).cast("int"), (F.lit(width + 1) - u64.bit_length(low)).cast("int")


def to_dense(idx: Column, rank: Column, spec: HllSpec) -> tuple[Column, Column]:
    """The dense register that a sparse one becomes: the same as if hashed at the lower precision."""
    extra = spec.sp - spec.p
    low = idx.bitwiseAND(F.lit((1 << extra) - 1))
    return F.shiftright(idx, extra), F.when(low != 0, F.lit(extra + 1) - u64.bit_length(low)).otherwise(rank + F.lit(extra)).cast("int")


def alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


@cache
def bias_points(p: int) -> tuple[list[float], list[float]]:
    """Raw estimates up to ``5 * m``, and by how much each is too large.

    The curve follows from the estimator: with ``n`` keys in ``m`` registers a register's rank is at most
    ``r`` with probability ``exp(-n / (m * 2**r))``, which gives the mean of ``2**-rank`` and its variance,
    and from those the mean of the raw estimate.
    """
    m, r = 1 << p, np.arange(0, 60)
    n = np.linspace(0, 5.5 * m, POINTS)[:, None]
    below = np.exp(-n / m / np.exp2(r))  # rank <= r
    mass = np.diff(np.concatenate([np.zeros((POINTS, 1)), below], axis=1), axis=1)
    mean = (mass * np.exp2(-r)).sum(1)
    spread = (mass * np.exp2(-2.0 * r)).sum(1) - mean**2
    raw = alpha(m) * m / mean * (1 + spread / (m * mean**2))
    return [float(x) for x in raw], [float(x) for x in raw - n[:, 0]]


def bias(raw: Column, p: int) -> Column:
    """Mean bias of the nearest points of the curve."""
    points, biases = bias_points(p)
    table = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in zip(points, biases, strict=True)])
    near = F.slice(F.array_sort(F.transform(table, lambda s: F.struct(((s["x"] - raw) * (s["x"] - raw)).alias("d"), s["y"].alias("y")))), 1, NEIGHBOURS)
    return F.aggregate(near, F.lit(0.0), lambda acc, s: acc + s["y"]) / NEIGHBOURS


def linear_count(m: int, occupied: Column) -> Column:
    m_lit = F.lit(float(m))
    return F.when(occupied == 0, F.lit(0.0)).when(occupied >= m, m_lit).otherwise(m_lit * F.log(m_lit / (m_lit - occupied)))


def dense_estimate(occupied: Column, power_sum: Column, p: int) -> Column:
    """``power_sum`` is the sum of ``2**-rank`` over the registers that are not zero."""
    m = 1 << p
    zeros = F.lit(m) - occupied
    raw = F.lit(alpha(m) * m * m) / (power_sum + zeros)
    corrected = F.when(raw <= 5.0 * m, raw - bias(raw, p)).otherwise(raw)
    linear = linear_count(m, occupied)
    return F.when((zeros > 0) & (linear <= LINEAR_LIMITS[p]), linear).otherwise(corrected)


def estimate_of(spec: HllSpec, dense: bool, occupied: int, power_sum: float) -> float:
    """The same for one sketch, outside Spark's expressions."""
    m = 1 << (spec.p if dense else spec.sp)
    linear = 0.0 if not occupied else float(m) if occupied >= m else m * math.log(m / (m - occupied))
    if not dense or (occupied < m and linear <= LINEAR_LIMITS[spec.p]):
        return linear
    raw = alpha(m) * m * m / (power_sum + m - occupied)
    if raw > 5.0 * m:
        return raw
    near = sorted(((x - raw) * (x - raw), y) for x, y in zip(*bias_points(spec.p), strict=True))[:NEIGHBOURS]
    return raw - sum(y for _, y in near) / NEIGHBOURS


@dataclass(frozen=True)
class HllFrame:
    """Distinct-count sketches, one for each value of ``keys``.

    ``registers`` has ``keys, _dense, _idx, _rank``; the names of all inner columns start with ``_``, so that keys may be
    called anything else.  ``groups`` names groups that may have no register; without keys there is one sketch, empty or not.
    With ``keep_sparse`` a group is dense only if a part of it was.
    """

    registers: DataFrame
    keys: list[str]
    spec: HllSpec
    groups: DataFrame | None = None
    keep_sparse: bool = False

    def merge(self, *others: HllFrame) -> HllFrame:
        """Groups of equal keys become one; a group is dense if any part is, or the union is large and not all keep sparse ones."""
        require_mergeable(self, list(others))
        parts = [self, *others]
        groups = [p.groups for p in parts if p.groups is not None]
        groups += [p.registers.select(*self.keys) for p in parts if groups and p.groups is None]
        return _settled(union([p.registers for p in parts]), self.keys, self.spec, union(groups) if groups else None, all(p.keep_sparse for p in parts))

    def rollup(self, keys: list[str]) -> HllFrame:
        """Merge over the keys that are left out."""
        return _settled(self.registers.select(*keys, "_dense", "_idx", "_rank"), keys, self.spec, None if self.groups is None else self.groups.select(*keys), self.keep_sparse)

    def grouping_sets(self, sets: list[list[str]]) -> HllFrame:
        """Merged over several sets of the keys at once, see ``grouped_sets``."""
        groups = None if self.groups is None else grouped_sets(self.groups.select(*self.keys), self.keys, sets)
        return _settled(grouped_sets(self.registers, self.keys, sets), ["grouping_id", *self.keys], self.spec, groups, self.keep_sparse)

    def grouped(self, *aggregates: Column) -> DataFrame:
        """``keys, _dense`` and the aggregates of every sketch's registers; those of an empty one are null."""
        if not self.keys:
            return self.registers.agg(F.coalesce(F.max("_dense"), F.lit(False)).alias("_dense"), *aggregates)
        found = self.registers.groupBy(*self.keys, "_dense").agg(*aggregates)
        if self.groups is None:
            return found
        every = join_keys(self.groups.select(*self.keys).distinct(), found, self.keys, "left")
        return every.withColumn("_dense", F.coalesce("_dense", F.lit(False)))

    def force_dense(self) -> HllFrame:
        idx, rank = to_dense(F.col("_idx"), F.col("_rank"), self.spec)
        dense = self.registers.select(*self.keys, F.lit(True).alias("_dense"), F.when(F.col("_dense"), F.col("_idx")).otherwise(idx).alias("_idx"), F.when(F.col("_dense"), F.col("_rank")).otherwise(rank).alias("_rank"))
        return HllFrame(dense.groupBy(*self.keys, "_dense", "_idx").agg(F.max("_rank").alias("_rank")), self.keys, self.spec, self.groups)

    def summary(self) -> DataFrame:
        """``keys, representation_mode, sparse_count, dense_nonzero_count, storage_bytes, estimate``."""
        n, powers = F.count(F.lit(1)), F.sum(F.pow(F.lit(2.0), -F.col("_rank")))
        grouped = self.grouped(n.alias("_n"), powers.alias("_powers")).withColumns({"_n": F.coalesce("_n", F.lit(0)), "_powers": F.coalesce("_powers", F.lit(0.0))})
        estimate = F.when(F.col("_dense"), dense_estimate(F.col("_n"), F.col("_powers"), self.spec.p)).otherwise(linear_count(1 << self.spec.sp, F.col("_n")))
        return grouped.select(
            *self.keys,
            F.when(F.col("_dense"), DENSE).otherwise(SPARSE).alias("representation_mode"),
            F.when(F.col("_dense"), 0).otherwise(F.col("_n")).cast("long").alias("sparse_count"),
            F.when(F.col("_dense"), F.col("_n")).otherwise(0).cast("long").alias("dense_nonzero_count"),
            F.when(F.col("_dense"), F.lit(self.spec.dense_bytes)).otherwise(F.col("_n") * 5).cast("long").alias("storage_bytes"),
            estimate.alias("estimate"),
        )

    def estimate(self) -> DataFrame:
        """``keys, estimate``; 0 for an empty sketch."""
        return self.summary().select(*self.keys, "estimate")

    def linear_estimate(self) -> DataFrame:
        """``keys, representation_mode, dense_nonzero_count, estimate`` by linear counting whatever the load: infinite once no register is empty."""
        occupied, m = F.greatest("sparse_count", "dense_nonzero_count"), F.when(F.col("representation_mode") == DENSE, 1 << self.spec.p).otherwise(1 << self.spec.sp)
        estimate = F.when(occupied >= m, F.lit(math.inf)).otherwise(m * -F.log1p(-occupied / m))
        return self.summary().select(*self.keys, "representation_mode", "dense_nonzero_count", estimate.alias("estimate"))

    def sparse_registers(self) -> DataFrame:
        return self.registers.where("not _dense").select(*self.keys, F.col("_idx").alias("idx"), F.col("_rank").alias("rank"))

    def dense_registers(self) -> DataFrame:
        return self.registers.where("_dense").select(*self.keys, F.col("_idx").alias("idx"), F.col("_rank").alias("rank"))


def _settled(rows: DataFrame, keys: list[str], spec: HllSpec, groups: DataFrame | None = None, keep_sparse: bool = False) -> HllFrame:
    merged = rows.groupBy(*keys, "_dense", "_idx").agg(F.max("_rank").alias("_rank"))
    large = F.lit(False) if keep_sparse else F.count(F.lit(1)) > spec.promotion
    sizes = merged.groupBy(*keys).agg((F.max("_dense") | large).alias("_to_dense"))
    placed = join_keys(merged, sizes, keys)
    idx, rank = to_dense(F.col("_idx"), F.col("_rank"), spec)
    promote = F.col("_to_dense") & ~F.col("_dense")
    placed = placed.select(*keys, F.col("_to_dense").alias("_dense"), F.when(promote, idx).otherwise(F.col("_idx")).alias("_idx"), F.when(promote, rank).otherwise(F.col("_rank")).alias("_rank"))
    return HllFrame(placed.groupBy(*keys, "_dense", "_idx").agg(F.max("_rank").alias("_rank")), keys, spec, groups, keep_sparse)


def sparse_rows(df: DataFrame, keys: list[str], hashed: Column | str, spec: HllSpec) -> DataFrame:
    """Sparse registers before promotion; also what a streaming aggregation keeps."""
    idx, rank = register(named(hashed), spec.sp)
    rows = df.where(named(hashed).isNotNull()).select(*keys, F.lit(False).alias("_dense"), idx.alias("_idx"), rank.alias("_rank"))
    return rows.groupBy(*keys, "_dense", "_idx").agg(F.max("_rank").alias("_rank"))


def build(df: DataFrame, keys: list[str], hashed: Column | str, spec: HllSpec, keep_sparse: bool = False) -> HllFrame:
    """Sketches of the 64-bit hashes in ``hashed``; null hashes add nothing, and no group by themselves."""
    rows = sparse_rows(df, keys, hashed, spec)
    return HllFrame(rows, keys, spec, keep_sparse=True) if keep_sparse else _settled(rows, keys, spec)


def standard_error(spec: HllSpec) -> float:
    return 1.04 / math.sqrt(1 << spec.p)
