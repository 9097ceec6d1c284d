"""What all sketch frames share: grouping keys, and the checks before a merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.errors import IncompatibleMergeError


def named(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def require_mergeable(first, others: list) -> None:
    for other in others:
        first.spec.require_same(other.spec)
        if first.keys != other.keys:
            raise IncompatibleMergeError(f"grouped by {first.keys} and {other.keys}")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def grouped_sets(rows: DataFrame, keys: list[str], sets: list[list[str]]) -> DataFrame:
    """``rows`` once for each set of keys, with the other keys null and ``grouping_id`` as SQL's ``GROUPING_ID(keys)``.

    Rows are registers, at most so many a group as a sketch has, so what is spread and shuffled doesn't grow with what
    was sketched, and every level of a cube or rollup is made from the finest in one pass.  A null that was a key's
    value differs from one that stands for all values by ``grouping_id``.
    """
    if any(k not in keys for own in sets for k in own):
        raise IncompatibleMergeError(f"grouping sets of {keys} only")
    bits = {k: 1 << (len(keys) - 1 - i) for i, k in enumerate(keys)}
    types = {f.name: f.dataType for f in rows.schema.fields}
    levels = []
    for own in sets:
        shown = [(F.col(k) if k in own else F.lit(None).cast(types[k])).alias(k) for k in keys]
        levels.append(F.struct(F.lit(sum(b for k, b in bits.items() if k not in own)).cast("long").alias("grouping_id"), *shown))
    others = [c for c in rows.columns if c not in keys]
    return rows.select(F.explode(F.array(*levels)).alias("_level"), *others).select("_level.*", *others)


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where null equals null; one row of ``right`` a key is expected."""
    if not keys:  # one group: ``right`` has one row at most
        return left.withColumn("_all", F.lit(1)).join(F.broadcast(right.withColumn("_all", F.lit(1))), "_all", how).drop("_all")
    renamed = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return left.join(renamed, same, how).drop(*[f"_k{i}" for i in range(len(keys))])

