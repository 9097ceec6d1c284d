"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import discard, stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, component``, stored, for every node that an edge touches; ``component`` is its smallest node.

    The number of rounds grows with the logarithm of the longest path.  A node with very many
    neighbours is only ever the streamed side of a join whose other side has one row a node, so Spark
    can split it, and all minima are taken with partial aggregation.  Self-loops and rows with a null
    end are left out; an empty table gives an empty result.
    """
    now = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v"))
    now = stored(now.where("u is not null and v is not null and u <> v").distinct(), "edges")
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        last, now = now, stored(_small_star(_large_star(now)), "stars")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    found = stored(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct(), "components")
    discard(now)
    return found
