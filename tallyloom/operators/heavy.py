"""Weighted heavy hitters with bounds that hold for certain.

A sketch holds at most ``map_size`` items of its group, each with an estimate that is too large by at most
``max_error``; keys it lacks weigh no more than that.  Built from exact sums by key, ``max_error`` is the
weight ranked just after the last place; merging adds what the parts hold beyond their errors and cuts
again.  The result depends on no order of rows or parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.errors import InvalidQueryModeError, NegativeWeightError, checked_sum, raised
from tallyloom.functions import u64
from tallyloom.operators.counters import LARGEST, Counters
from tallyloom.operators.frames import join_keys, named, require_mergeable, union
from tallyloom.profiles import HeavySpec

NO_FALSE_POSITIVES, NO_FALSE_NEGATIVES = "NO_FALSE_POSITIVES", "NO_FALSE_NEGATIVES"
REPRESENTATION = "FREQUENT_ITEMS_BOUNDED_MAP"
#: Parts of a group that are cut before they meet.
PARTS = 32


@dataclass(frozen=True)
class HeavyFrame:
    """``entries``: ``keys, _hash, _estimate``; ``totals``: ``keys, total_weight, max_error``."""

    entries: DataFrame
    totals: DataFrame
    keys: list[str]
    spec: HeavySpec

    def merge(self, *others: HeavyFrame) -> HeavyFrame:
        require_mergeable(self, list(others))
        parts = [self, *others]
        return _cut(union([p._residuals(self.keys) for p in parts]), union([p.totals for p in parts]), self.keys, self.spec)

    def rollup(self, keys: list[str]) -> HeavyFrame:
        """Merge over the keys that are left out."""
        return _cut(self._residuals(keys), self.totals.select(*keys, "total_weight", "max_error"), keys, self.spec)

    def _residuals(self, keys: list[str]) -> DataFrame:
        return join_keys(self.entries, self.totals, self.keys).select(*keys, "_hash", (F.col("_estimate") - F.col("max_error")).alias("_weight"))

    def _bounded(self) -> DataFrame:
        """``keys, _hash, _upper, _lower, _error``."""
        lower = F.greatest(F.lit(0), F.col("_estimate") - F.col("max_error"))
        return join_keys(self.entries, self.totals, self.keys).select(*self.keys, "_hash", F.col("_estimate").alias("_upper"), lower.alias("_lower"), F.col("max_error").alias("_error"))

    def _frequent(self, mode: str, threshold: int | None = None) -> DataFrame:
        if mode not in (NO_FALSE_POSITIVES, NO_FALSE_NEGATIVES):
            raise InvalidQueryModeError(f"no mode {mode!r}")
        bound = F.col("_lower" if mode == NO_FALSE_POSITIVES else "_upper")
        return self._bounded().where(bound > (F.col("_error") if threshold is None else F.lit(threshold)))

    def _shown(self, found: DataFrame, *more: Column) -> DataFrame:
        names = {"_hash": "hash", "_upper": "estimate", "_lower": "lower_bound"}
        shown = [F.col(c).alias(n) for c, n in names.items()]
        return found.select(*self.keys, *shown, F.col("_upper").alias("upper_bound"), F.col("_error").alias("error"), *more)

    def items(self) -> DataFrame:
        """``keys, hash, estimate, lower_bound, upper_bound, error`` of all items that are held."""
        return self._shown(self._bounded())

    def frequent_items(self, mode: str, threshold: int | None = None) -> DataFrame:
        """Items whose upper bound (no false negatives) or lower bound (no false positives) is above.

        Above ``threshold``, or above the group's ``max_error`` if there is none.
        """
        return self._shown(self._frequent(mode, threshold))

    def _top(self, n: int, mode: str) -> DataFrame:
        order = Window.partitionBy(*self.keys).orderBy(F.desc("_upper"), u64.ordered(F.col("_hash")))
        return self._frequent(mode).withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)

    def top(self, n: int, mode: str = NO_FALSE_NEGATIVES) -> DataFrame:
        """The ``n`` first items of each group with their ``rank``, by estimate, then unsigned hash."""
        return self._shown(self._top(n, mode), F.col("_rank").alias("rank"))

    def top_share(self, n: int) -> DataFrame:
        """``keys, low, high``: bounds of the share that the ``n`` first items have in the total."""
        sums = self._top(n, NO_FALSE_NEGATIVES).groupBy(*self.keys).agg(F.sum("_lower").alias("_lower"), F.sum("_upper").alias("_upper"))
        joined = join_keys(self.totals, sums, self.keys, "left")
        share = lambda c: F.when(F.col("total_weight") > 0, F.coalesce(F.col(c), F.lit(0)) / F.col("total_weight")).otherwise(0.0)
        return joined.select(*self.keys, share("_lower").alias("low"), F.least(share("_upper"), F.lit(1.0)).alias("high"))

    def lookup(self, wanted: DataFrame, hashed: str = "hash") -> DataFrame:
        """``wanted`` with ``estimate, lower_bound, upper_bound``; what is not held is 0, 0, ``max_error``."""
        known = join_keys(wanted, self.totals.select(*self.keys, "max_error"), self.keys)
        held = self.entries.select(*self.keys, F.col("_hash").alias(hashed), "_estimate")
        found = join_keys(known, held, [*self.keys, hashed], "left")
        lower = F.greatest(F.lit(0), F.coalesce(F.col("_estimate") - F.col("max_error"), F.lit(0)))
        return found.select(*wanted.columns, F.coalesce("_estimate", F.lit(0)).alias("estimate"), lower.alias("lower_bound"), F.coalesce("_estimate", "max_error").alias("upper_bound"))


def _first(summed: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The ``size + 1`` heaviest rows of each group, with their ``_rank``.

    Tasks first cut the parts of a group that they hold, so that no task ranks all keys of a large one.
    """
    order = [F.desc("_weight"), u64.ordered(F.col("_hash"))]
    if not keys:
        few = summed.orderBy(*order).limit(size + 1)
        return few.withColumn("_rank", F.row_number().over(Window.orderBy(*order)))  # of size + 1 rows
    part = F.pmod(F.xxhash64("_hash", F.lit(3)), F.lit(PARTS))
    parts = summed.withColumn("_part", part).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)))
    few = parts.where(F.col("_rank") <= size + 1).drop("_part", "_rank")
    return few.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= size + 1)


def _cut(residuals: DataFrame, totals: DataFrame, keys: list[str], spec: HeavySpec) -> HeavyFrame:
    """Sum by key, keep what lies above the weight ranked one past the last place."""
    summed = residuals.groupBy(*keys, "_hash").agg(checked_sum("_weight").alias("_weight")).where("_weight > 0")
    first = _first(summed, keys, spec.map_size)
    errors = first.where(F.col("_rank") == spec.map_size + 1).select(*keys, F.col("_weight").alias("_cut"))
    sums = totals.groupBy(*keys).agg(checked_sum("total_weight").alias("total_weight"), checked_sum("max_error").alias("_error"))
    sums = join_keys(sums, errors, keys, "left").withColumn("_cut", F.coalesce("_cut", F.lit(0)))
    kept = join_keys(first, sums, keys).where("_weight > _cut")
    return HeavyFrame(
        kept.select(*keys, "_hash", (F.col("_weight") + F.col("_error")).alias("_estimate")),
        sums.select(*keys, "total_weight", (F.col("_error") + F.col("_cut")).alias("max_error")),
        keys,
        spec,
    )


def _weighed(df: DataFrame, keys: list[str], hashed: Column | str, weight: Column | str) -> DataFrame:
    """Rows with a weight; null hashes and weights add nothing, a negative weight fails the query."""
    w = named(weight).cast("long")
    safe = F.when(w < 0, raised(NegativeWeightError, "a weight is negative").cast("long")).otherwise(w)
    return df.select(*keys, named(hashed).alias("_hash"), safe.alias("_weight")).where("_hash is not null and _weight is not null")


def build(df: DataFrame, keys: list[str], hashed: Column | str, weight: Column | str, spec: HeavySpec) -> HeavyFrame:
    """Sketches from exact sums: one row for each key is shuffled, combined before."""
    rows = _weighed(df, keys, hashed, weight)
    summed = rows.groupBy(*keys, "_hash").agg(checked_sum("_weight").alias("_weight"))
    totals = summed.groupBy(*keys).agg(checked_sum("_weight").alias("total_weight"), F.lit(0).cast("long").alias("max_error"))
    return _cut(summed, totals, keys, spec)


def summed(pdf: pd.DataFrame, by: list[str], weight: str) -> pd.Series:
    """Weights by key; where 64 bits might not do, as Python's integers, so that an overflow is told and not wrapped."""
    own = pdf[weight].astype(object) if len(pdf) * int(pdf[weight].max()) > LARGEST else pdf[weight]
    return own.groupby([pdf[c] for c in by], dropna=False, sort=True).sum()


def build_bounded(df: DataFrame, keys: list[str], hashed: Column | str, weight: Column | str, spec: HeavySpec, batch: int = 4096) -> HeavyFrame:
    """Sketches in one pass with bounded memory: each task keeps a map for each group, then they merge.

    Nothing is shuffled but the maps.  The bounds hold as with ``build``; which keys are held, and the
    error, depend on how rows are spread over tasks.
    """
    rows = _weighed(df, keys, hashed, weight)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        groups: dict[tuple, Counters] = {}
        for pdf in batches:
            sums = summed(pdf, [*keys, "_hash"], "_weight")
            for index, w in sums.items():
                index = index if isinstance(index, tuple) else (index,)
                own = tuple(None if pd.isna(k) else k for k in index[:-1])
                groups.setdefault(own, Counters(spec.map_size)).add(int(index[-1]), int(w))
        out = []
        for own, c in groups.items():
            out.append((*own, None, None, c.total, c.error))
            out += [(*own, k, v - c.error, None, None) for k, v in c.estimates.items()]
        frame = pd.DataFrame(out, columns=[*keys, "_hash", "_weight", "total_weight", "max_error"], dtype=object)  # floats would round hashes
        yield frame.astype({c: "Int64" for c in ("_hash", "_weight", "total_weight", "max_error")})

    schema = ", ".join([*fields, "_hash long", "_weight long", "total_weight long", "max_error long"])
    found = rows.mapInPandas(run, schema)
    return _cut(found.where("_hash is not null").select(*keys, "_hash", "_weight"), found.where("_hash is null").select(*keys, "total_weight", "max_error"), keys, spec)
