"""Embedding near-duplicates by sorted projection passes.

Each pass hashes every vector with random hyperplanes, sorts all by the concatenated bits, and compares each
with a bounded window of neighbours in that order: first by how many bits differ in a longer sketch of hyperplanes
that all passes share, then, for the few pairs left, by the exact cosine.  Verified pairs are joined over the passes into components.  Inside a component every link
is then counted exactly, so that a crowd larger than the window loses none: links never leave a component.
Loose crowds, whose vectors are near each other but seldom linked, are compared whole.

Only hashes and node numbers travel and are sorted; vectors are fetched for candidates alone.  The number of
passes grows with the logarithm of the number of vectors, so that a lone pair at the threshold is missed no more
often in a large table than in a small one.  A few passes at a time are on disk, and what they shuffled is given
back before the next.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, overlapping_blocks, stored, with_rank
from tallyloom.llm.components import components

THRESHOLD = 0.95
WINDOW, BITS = 16, 64
#: Bits of a sketch, and by how many standard errors more a pair at the threshold may differ: one in millions does.
SKETCH, ERRORS = 256, 5
#: Rows of passes that are on disk at once, or of one pass if that is more.
PASS_ROWS = 2_000_000
#: Vectors that are fetched at once for pairs; more go in slices by both ends.
FETCHED = 500_000
#: Passes at least, and how often a lone pair at the threshold may be missed by all.
PASSES, MISSED = 16, 1e-3
#: Passes whose next neighbours are joined first: later ones skip what is in one component by then.
FIRST_PASSES = 4
#: Neighbours that are compared in one task, beside the window around them.
BLOCK = 8192
#: Ranks of a pass that are compared with each other at once where vectors crowd; a part of ``BLOCK``.
CHUNK = 1024
#: Components of more distinct vectors than this are counted by blocks of at most this many.
CROWD = 512
SEED = 11


def _packed(v: np.ndarray) -> bytes:
    """A vector's bytes: in single precision, marked by one byte more, if that loses nothing, else in double."""
    wide = np.asarray(v, np.float64) + 0.0
    with np.errstate(over="ignore"):
        narrow = wide.astype(np.float32)
    return narrow.tobytes() + b"\0" if (narrow == wide).all() else wide.tobytes()


def _unpacked(raw: pd.Series) -> np.ndarray:
    sizes = set(map(len, raw))
    if len(sizes) == 1 and (size := sizes.pop()) % 2:
        return np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), size)[:, :-1].copy().view(np.float32).astype(np.float64)
    return np.stack([np.frombuffer(b, np.float32, len(b) // 4).astype(np.float64) if len(b) % 2 else np.frombuffer(b, np.float64) for b in raw])


def _unit(raw: pd.Series) -> np.ndarray:
    x = _unpacked(raw)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _given_back(spark: SparkSession) -> None:
    """Let Spark delete what finished queries have shuffled: it does so when the driver has no more use of them, which only a collection of garbage tells."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def passes_for(rows: int, threshold: float, window: int) -> int:
    """Passes that leave a lone pair at the threshold apart with probability ``MISSED`` at most.

    In one pass the two are in a window if they agree in about ``log2(rows / window)`` bits, each of which
    they do with probability ``1 - angle / pi``.
    """
    met = (1 - math.acos(threshold) / math.pi) ** math.log2(max(2.0, rows / window))
    return max(PASSES, math.ceil(math.log(MISSED) / math.log(1 - met)))


def _bits(unit: np.ndarray, key: list[int], bits: int) -> np.ndarray:
    """Bytes that tell for each of ``bits`` random planes on which side a vector is."""
    planes = np.random.default_rng([SEED, *key, unit.shape[1]]).standard_normal((unit.shape[1], bits))
    return np.packbits(unit @ planes > 0, axis=1)


def _keyed(classes: DataFrame, passes: range) -> DataFrame:
    """``dim, pass, bits, node, sketch``: the bits of each vector in each pass, as a number that sorts like them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("dim"):
                unit = _unit(own["vector"])
                for p in passes:
                    bits = _bits(unit, [p], BITS).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)
                    yield pd.DataFrame({"dim": own["dim"], "pass": p, "bits": bits.view(np.int64), "node": own["node"], "sketch": own["sketch"]})

    return classes.select("dim", "node", "sketch", "vector").mapInPandas(run, "dim int, pass int, bits long, node long, sketch binary")


def _differing(sketch: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketch), np.uint64).reshape(len(sketch), SKETCH // 64)


def _window_pairs(ranked: DataFrame, threshold: float, window: int) -> DataFrame:
    """``u, v``, once each, of neighbours in a window whose sketches differ little; rows of one ``component`` are no pairs."""
    far = _farthest(threshold, SKETCH, ERRORS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        order = pdf["dim"].to_numpy(np.int64) << 32 | pdf["pass"].to_numpy(np.int64)
        bits, node, own = _differing(pdf["sketch"]), pdf["node"].to_numpy(np.int64), pdf["own"].to_numpy(bool)
        part, ends = pdf["component"].to_numpy(np.int64), []
        for w in range(1, min(window, len(pdf) - 1) + 1):
            near = (np.bitwise_count(bits[:-w] ^ bits[w:]).sum(1) <= far) & own[w:] & (order[:-w] == order[w:]) & (part[:-w] != part[w:])
            ends.append(np.stack([node[:-w][near], node[w:][near]]))
        both = np.sort(np.concatenate([np.zeros((2, 0), np.int64), *ends], axis=1), axis=0)
        return pd.DataFrame({"u": both[0], "v": both[1]}).drop_duplicates()

    return overlapping_blocks(ranked, BLOCK, window).groupBy("block").applyInPandas(run, "u long, v long").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, rows: int, threshold: float) -> list[DataFrame]:
    """Those of the stored pairs whose cosine reaches the threshold, stored, in slices by both ends where there are many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                close = (_unit(pdf["a"]) * _unit(pdf["b"])).sum(1) >= threshold
                yield pdf.loc[close, ["u", "v"]]

    n, out = pairs.count(), []
    slices = 1 if n + rows <= FETCHED else 1 + math.ceil(math.sqrt(max(1, n / rows)))
    here = lambda c, k: F.pmod(F.hash(c), F.lit(slices)) == k
    for i in range(slices if n else 0):
        for j in range(slices):
            both = pairs.where(here("u", i) & here("v", j))
            both = both.join(classes.where(here("node", i)).select(F.col("node").alias("u"), F.col("vector").alias("a")), "u")
            both = both.join(classes.where(here("node", j)).select(F.col("node").alias("v"), F.col("vector").alias("b")), "v")
            out.append(stored(both.select("u", "v", "a", "b").mapInPandas(run, "u long, v long"), "vector-links"))
            del both
            _given_back(pairs.sparkSession)
    return out


def _farthest(threshold: float, bits: int = BITS, errors: int = 4) -> int:
    """Bits by which the hashes of a pair at the threshold differ, but for one in many thousands."""
    share = math.acos(threshold) / math.pi
    return math.ceil(bits * share + errors * math.sqrt(bits * share * (1 - share)))


def _crowded_chunks(placed: DataFrame, threshold: float, window: int) -> DataFrame:
    """``pass, dim, chunk, last``, stored: stretches of a pass where windows are full of near hashes and still not enough.

    A window is full if even its last neighbour may be near, and belongs to another component.  Neighbouring
    chunks of ``CHUNK`` ranks with such windows are one stretch, which ends with the chunk ``last``.  Sketches tell, as the
    64 bits that sort agree by chance in a large table: unlike vectors would be full windows everywhere.
    """
    far = _farthest(threshold) * SKETCH // BITS

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        bits, part = _differing(pdf["sketch"]), pdf["component"].to_numpy(np.int64)
        order = pdf["dim"].to_numpy(np.int64) << 32 | pdf["pass"].to_numpy(np.int64)
        full = np.zeros(len(pdf), bool)
        if len(pdf) > window:
            full[window:] = (np.bitwise_count(bits[:-window] ^ bits[window:]).sum(1) <= far) & (order[:-window] == order[window:]) & (part[:-window] != part[window:])
        own = pdf.assign(full=full)[full & pdf["own"].to_numpy(bool)]
        counted = own.assign(chunk=own["rank"] // CHUNK).groupby(["pass", "dim", "chunk"], as_index=False)["full"].sum()
        return counted.astype({"full": "int64"})

    counted = overlapping_blocks(placed, BLOCK, window).groupBy("block").applyInPandas(run, "pass int, dim int, chunk long, full long")
    chunks = counted.groupBy("pass", "dim", "chunk").agg(F.sum("full").alias("full")).where(F.col("full") >= window)
    within = Window.partitionBy("pass", "dim")  # a row for each chunk
    stretch = F.col("chunk") - F.row_number().over(within.orderBy("chunk"))
    stretches = chunks.withColumn("stretch", stretch).withColumn("last", F.max("chunk").over(Window.partitionBy("pass", "dim", "stretch")))
    return stored(stretches.select("pass", "dim", "chunk", "last"), "crowded-chunks")


def _crowd_links(placed: DataFrame, crowded: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """``u, v``, stored: components joined by a link between vectors of one stretch of one pass, all pairs of it compared."""
    rows = placed.withColumn("chunk", F.floor(F.col("rank") / CHUNK).cast("long")).join(crowded, ["pass", "dim", "chunk"])
    rows = rows.join(classes.select("node", "vector"), "node").select("pass", "dim", "chunk", "last", "component", "vector")
    left = rows.withColumn("other", F.explode(F.sequence("chunk", "last"))).drop("last")
    reach = crowded.select("pass", "dim", F.col("chunk").alias("first"), F.explode(F.sequence("chunk", "last")).alias("chunk"))
    right = rows.drop("last").join(reach, ["pass", "dim", "chunk"])
    right = right.select(*[F.col(c).alias(f"m_{c}") for c in right.columns])

    def run(queries: pd.DataFrame, all_of: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(all_of):
            return pd.DataFrame({"u": [], "v": []}).astype("int64")
        linked = _unit(queries["vector"]) @ _unit(all_of["m_vector"]).T >= threshold
        a, b = queries["component"].to_numpy(np.int64), all_of["m_component"].to_numpy(np.int64)
        linked &= a[:, None] != b[None, :]
        i, j = np.nonzero(linked)
        return pd.DataFrame({"u": np.minimum(a[i], b[j]), "v": np.maximum(a[i], b[j])}).drop_duplicates()

    pairs = left.groupBy("pass", "dim", "chunk", "other").cogroup(right.groupBy("m_pass", "m_dim", "m_first", "m_chunk"))
    return stored(pairs.applyInPandas(run, "u long, v long").distinct(), "crowd-links")


def _joined_crowds(found: DataFrame, classes: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """``node, component``, stored, with the components of crowds joined that bounded windows left apart.

    Where vectors crowd without linking, a window sees too few of the many that are near, so there whole stretches are
    compared, a pass after the other until one joins nothing new.  That costs the square of a crowd, and is spent on
    crowds of many components only: near copies are one component by then.
    """
    for p in range(passes):
        ranked = with_rank(_keyed(classes, range(p, p + 1)), ["dim", "pass", "bits", "node"])
        placed = stored(_placed(ranked, found), "crowd-pass")
        discard(ranked)
        crowded = _crowded_chunks(placed, threshold, window)
        links = _crowd_links(placed, crowded, classes, threshold) if not crowded.isEmpty() else None
        done = links is None or links.isEmpty()
        if not done:
            own = found.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")
            last, found = found, components(own.unionByName(links), "u", "v")
            discard(last)
        discard(placed, crowded, *([links] if links is not None else []))
        del ranked, placed, crowded, links
        _given_back(classes.sparkSession)
        if done:
            break
    return found


def _placed(ranked: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return ranked.withColumn("component", F.col("node"))
    return ranked.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _components(classes: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """``node, component``, stored, over the links that the passes find.

    The first passes go twice, with next neighbours only at first.  Pairs wait until there are as many as vectors, so
    that vectors are fetched seldom, and those that have come into one component meanwhile are not looked at again.
    """
    spark, rows = classes.sparkSession, classes.count()
    each = max(1, PASS_ROWS // max(1, rows))
    first = min(FIRST_PASSES, passes)
    steps = [(range(k, min(k + each, first)), 1) for k in range(0, first, each)]
    steps += [(range(k, min(k + each, passes)), window) for k in range(0, passes, each)]
    found, waiting, many = None, [], 0
    for k, (some, width) in enumerate(steps):
        ranked = with_rank(_keyed(classes, some), ["dim", "pass", "bits", "node"])
        waiting.append(stored(_window_pairs(_placed(ranked, found), threshold, width), "vector-pairs"))
        discard(ranked)
        del ranked
        _given_back(spark)
        many += waiting[-1].count()
        if width > 1 and many < rows and k + 1 < len(steps):
            continue
        pairs = reduce(DataFrame.unionByName, waiting).distinct()
        if found is not None:
            for end in ("u", "v"):
                pairs = pairs.join(found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
            pairs = pairs.where("coalesce(of_u, u) <> coalesce(of_v, v)").select("u", "v")
        pairs = stored(pairs, "vector-pairs")
        discard(*waiting)
        waiting, many = [], 0
        links = _verified(pairs, classes, rows, threshold)
        discard(pairs)
        if links:
            own = [found.select(F.col("node").alias("u"), F.col("component").alias("v")).where("u <> v")] if found is not None else []
            last, found = found, components(reduce(DataFrame.unionByName, [*own, *links]), "u", "v")
            discard(*links, *([last] if last is not None else []))
            del own, last
        del pairs, links
        _given_back(spark)
    if found is None:
        found = components(spark.createDataFrame([], "u long, v long"), "u", "v")
    return _joined_crowds(found, classes, threshold, passes, window)


def _small_counts(members: DataFrame, threshold: float) -> DataFrame:
    """Exact links within components that fit in memory, many components to a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for _, own in pdf.groupby("component"):
            unit, weight = _unit(own["vector"]), own["weight"].to_numpy(np.int64)
            linked = ((unit @ unit.T) >= threshold).astype(np.int64)
            np.fill_diagonal(linked, 1)
            parts.append(pd.DataFrame({"node": own["node"], "linked": linked @ weight}))
        return pd.concat(parts)

    n = members.count()
    bucket = F.pmod(F.xxhash64("component"), F.lit(max(1, n // 512))).cast("long")
    return members.withColumn("bucket", bucket).groupBy("bucket").applyInPandas(run, "node long, linked long")


def _crowd_counts(members: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """Exact links within larger components, without comparing their dense cores.

    Vectors within half the threshold's angle of the component's mean direction all link with each
    other.  Only the vectors outside that core are compared, block by block, with all members.
    """
    half = math.cos(math.acos(threshold) / 2 - 1e-9)

    @F.pandas_udf("array<double>")
    def as_array(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: _unpacked(pd.Series([b]))[0])

    members = members.withColumn("x", as_array("vector"))
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    unit = members.withColumn("l", size).withColumn("x", F.transform("x", lambda v: v / F.col("l"))).drop("l")
    mean = unit.select("component", F.posexplode("x").alias("k", "v")).groupBy("component", "k").agg(F.avg("v").alias("v"))
    mean = mean.groupBy("component").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("mean"))
    dot = F.aggregate(F.zip_with("x", "mean", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    length = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, v: s + v * v))
    placed = unit.join(mean, "component").withColumn("core", F.coalesce(dot / length >= half, F.lit(False)))
    placed = stored(placed.select("component", "node", "weight", "vector", "core"), "crowds")
    totals = placed.groupBy("component").agg(
        F.sum(F.when(F.col("core"), F.col("weight")).otherwise(0)).alias("core_weight"),
        F.ceil(F.count(F.lit(1)) / crowd).cast("int").alias("blocks"),
        F.ceil(F.count(F.when(~F.col("core"), 1)) / crowd).cast("int").alias("outer_blocks"),
    )
    placed = placed.join(totals, "component")
    inside = placed.where("core").select("node", F.col("core_weight").alias("linked"))
    block, outer = F.pmod(F.hash("node"), F.col("blocks")), F.pmod(F.hash("node"), F.col("outer_blocks"))
    every = placed.where("outer_blocks > 0").select("component", "node", "weight", "vector", "core", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("o"))
    query = placed.where("not core").select("component", "node", "weight", "vector", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), outer.alias("o"))

    def run(queries: pd.DataFrame, all_of: pd.DataFrame) -> pd.DataFrame:
        all_of = all_of.rename(columns=lambda c: c.removeprefix("m_"))
        if not len(queries) or not len(all_of):
            return pd.DataFrame({"node": [], "linked": []}).astype("int64")
        linked = _unit(queries["vector"]) @ _unit(all_of["vector"]).T >= threshold
        linked |= queries["node"].to_numpy()[:, None] == all_of["node"].to_numpy()[None, :]
        own = pd.DataFrame({"node": queries["node"], "linked": linked @ all_of["weight"].to_numpy(np.int64)})
        core = all_of["core"].to_numpy(bool)
        back = pd.DataFrame({"node": all_of["node"][core], "linked": (linked[:, core].T @ queries["weight"].to_numpy(np.int64))})
        return pd.concat([own, back])

    keys = ["component", "o", "b"]
    every = every.select(*[F.col(c).alias(f"m_{c}") for c in every.columns])
    outside = query.groupBy(*keys).cogroup(every.groupBy(*[f"m_{k}" for k in keys])).applyInPandas(run, "node long, linked long")
    return inside.unionByName(outside).groupBy("node").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, passes: int | None = None, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors``.

    Cosines are in double precision.  ``n_links`` counts the other rows linked directly, ``component_id``
    is the smallest id reachable by links, the row's own included, ``kept`` says that it is the row's own.

    ``passes`` follows from the number of vectors by default.  Links of sparse vectors are found with the
    probability stated above, more often the closer they are; inside a component none is lost, and where windows are
    full of vectors that are near but not linked, whole stretches of the order are compared.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and
    vectors of different lengths don't link.  Equal vectors count as so many rows but are compared once.
    An empty table gives an empty result, and further columns are ignored whatever their names.
    """
    bounded_batches(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    good = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False))) & F.exists("x", lambda v: v != 0)
    good = F.coalesce(good, F.lit(False))

    @F.pandas_udf("binary")
    def as_bytes(x: pd.Series) -> pd.Series:
        return x.map(_packed)

    def sketched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, own in pdf.groupby("dim"):
                yield own.assign(sketch=[row.tobytes() for row in _bits(_unit(own["vector"]), [-1 % 2**32], SKETCH)])

    spark, node = vectors.sparkSession, F.xxhash64("x")
    classes = rows.where(good).select(node.alias("node"), F.size("x").alias("dim"), as_bytes("x").alias("vector"), "vec_id")
    classes = classes.groupBy("node", "dim", "vector").agg(F.min("vec_id").cast("string").alias("least"), F.count(F.lit(1)).alias("weight"))
    classes = classes.mapInPandas(sketched, "node long, dim int, vector binary, least string, weight long, sketch binary")
    classes = stored(classes.withColumn("least", F.col("least").cast("long")), "vectors")
    _given_back(spark)
    whole = _components(classes, threshold, passes or passes_for(classes.count(), threshold, window), window)
    named = stored(classes.select("node", "least").join(whole, "node").select("node", "component", "least"), "vector-components")
    discard(whole)
    sizes = stored(named.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("least").alias("component_id")), "component-sizes")
    sized = stored(named.drop("least").join(sizes, "component"), "vector-sizes")
    discard(named)
    _given_back(spark)
    parts = []
    for bounds in (f"n <= {crowd}", f"n > {crowd}"):
        if not sizes.where(bounds).isEmpty():
            members = classes.select("node", "weight", "vector").join(sized.where(bounds).select("node", "component"), "node")
            own = _small_counts(members, threshold) if bounds.startswith("n <=") else _crowd_counts(members.select("component", "node", "weight", "vector"), threshold, crowd)
            parts.append(stored(own, "vector-counts"))
            del members, own
            _given_back(spark)
    counts = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "node long, linked long")
    found = classes.select("node", "least", "weight").join(counts, "node", "left").join(sized.select("node", "component_id"), "node", "left")
    found = stored(found.select("node", (F.coalesce("linked", "weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")), "vector-classes")
    discard(classes, sized, sizes, *parts)
    return (
        rows.select("vec_id", F.when(good, node).alias("node"))
        .join(found, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
