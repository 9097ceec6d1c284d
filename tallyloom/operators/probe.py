"""Membership by bitsets that every task holds, for few groups and many probes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tallyloom.operators.bloom import BloomFrame
from tallyloom.operators.frames import join_keys
from tallyloom.operators.parts import may_contain
from tallyloom.sources import packed, wire

#: Bytes of bitsets that may be sent to every executor.
MOST_BYTES = 64 << 20


def probe(frame: BloomFrame, probes: DataFrame, hashed: str = "hash", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``frame.may_contain(probes)``, without a shuffle of probes where the bitsets of all groups are small together.

    Their size is known before anything is packed: a bitset's, times the number of groups, which is counted.  Within
    ``most_bytes`` they are broadcast and tested by arrays of probes; beyond it the probes' positions are joined.
    """
    spec = frame.spec
    size = (spec.bits + 7) // 8
    groups = frame.counts.limit(most_bytes // size + 1).count()
    if groups * size > most_bytes:
        return frame.may_contain(probes, hashed)
    rows = packed.pack(frame).collect()  # ``most_bytes`` at most, as was checked
    spark = probes.sparkSession
    bits = spark.sparkContext.broadcast([np.frombuffer(wire.decode(bytes(r["sketch"]), type(spec))[1].bitset, np.uint8) for r in rows])
    schema = frame.counts.select(*frame.keys).schema.add("_cell", IntegerType())
    numbered = spark.createDataFrame([(*(r[k] for k in frame.keys), i) for i, r in enumerate(rows)], schema)

    def test(cells: pa.Array, hashes: pa.Array) -> pa.Array:
        known = cells.is_valid().to_numpy(zero_copy_only=False) & hashes.is_valid().to_numpy(zero_copy_only=False)
        own = cells.fill_null(0).to_numpy(zero_copy_only=False)
        values = hashes.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)
        found = np.zeros(len(own), bool)
        for cell in np.unique(own[known]).tolist():
            at = np.flatnonzero(known & (own == cell))
            found[at] = may_contain(bits.value[cell], values[at], spec)
        return pa.array(found)

    met = join_keys(probes, F.broadcast(numbered), frame.keys, "left")
    return met.withColumn("may_contain", F.arrow_udf(test, "boolean")("_cell", F.col(hashed).cast("long"))).drop("_cell")
