"""Near-duplicate texts by the similarity of their shingle sets: minwise bands find pairs, an exact check decides."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, small_keys, stored
from tallyloom.llm.components import components
from tallyloom.llm.simhash import SEED, first_rows, marked_rows, shingles

SHINGLE_WORDS = 5
#: Sets link from this similarity on (shared over all shingles), as a fraction of whole numbers.
SIMILAR = (4, 5)
#: A pair of similarity s misses all bands with probability ``(1 - s**BAND_MINIMA) ** BANDS``: 3e-6 at 0.8.
BANDS, BAND_MINIMA = 24, 4
#: A band of more distinct sets than this is a crowd: each set meets its pivot, and then those that this leaves apart
#: meet all others, so many of either side in a task.
BUCKET, APART, OTHERS = 8, 512, 4096
#: Pairs whose minima agree less often than this are not compared exactly: three standard errors under 0.8, which a
#: pair at 0.8 falls short of with probability 1.5e-3.
LEAST_AGREEING = round(BANDS * BAND_MINIMA * 0.8 - 3 * (BANDS * BAND_MINIMA * 0.8 * 0.2) ** 0.5)

_rng = np.random.default_rng(SEED)
_FACTORS = _rng.integers(0, 2**63, BANDS * BAND_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _rng.integers(0, 2**63, BANDS * BAND_MINIMA, np.uint64)


def signature(hashes: np.ndarray) -> bytes | None:
    """The last 16 bits of each minimum over a set of hashes; none for the empty set."""
    if not len(hashes):
        return None
    least = np.full(len(_FACTORS), 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * _FACTORS + _TERMS).min(0))
    return least.astype("<u2").tobytes()


def _signed(rows: DataFrame, shingle_words: int) -> DataFrame:
    """``row, set_id, size, minima``: the key, size and signature of a row's set of shingles."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, text in zip(pdf["row"], pdf["text"], strict=True):
                own = np.unique(shingles(text, shingle_words))
                key = xxhash.xxh64_intdigest(own.tobytes())
                out.append((row, key - (key >> 63 << 64), len(own), signature(own)))
            yield pd.DataFrame(out, columns=["row", "set_id", "size", "minima"])

    return rows.mapInPandas(run, "row long, set_id long, size long, minima binary")


def _band_key() -> Column:
    width = 2 * BAND_MINIMA
    return F.xxhash64("band", F.substring("minima", F.col("band") * width + 1, F.lit(width)))


def _near_size(a: str, b: str) -> str:
    return f"least({a}, {b}) * {SIMILAR[1]} >= greatest({a}, {b}) * {SIMILAR[0]}"


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle_words: int) -> DataFrame:
    """Those of the stored pairs ``u, v`` of sets that are similar enough, by their shared hashes; stored.

    Signatures rule most pairs out.  Sets are made anew, for those in the other pairs only: all of them would
    take more disk than the texts.
    """

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (np.frombuffer(b"".join(pdf[c]), np.uint16).reshape(len(pdf), -1) for c in ("a", "b"))
            yield pdf.loc[(x == y).sum(1) >= LEAST_AGREEING, ["u", "v"]]

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"set_id": pdf["set_id"], "hashes": [np.unique(shingles(t, shingle_words)).tobytes() for t in pdf["text"]]})

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            near = []
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                near.append(shared * SIMILAR[1] >= (len(x) + len(y) - shared) * SIMILAR[0])
            yield pdf.loc[np.array(near, bool), ["u", "v"]]

    def with_ends(of: DataFrame, table: DataFrame, what: str) -> DataFrame:
        both = of.join(table.select(F.col("set_id").alias("u"), F.col(what).alias("a")), "u")
        return both.join(table.select(F.col("set_id").alias("v"), F.col(what).alias("b")), "v").select("u", "v", "a", "b")

    close = stored(with_ends(pairs, nodes, "minima").mapInPandas(likely, "u long, v long"), "similar-close")
    ends = close.select(F.col("u").alias("set_id")).union(close.select("v")).distinct()
    held = stored(nodes.select("set_id", "row").join(ends, "set_id"), "similar-held")
    made = rows.join(small_keys(held), "row").select("set_id", "text").mapInPandas(again, "set_id long, hashes binary")
    sets = stored(made.groupBy("set_id").agg(F.first("hashes").alias("hashes")), "similar-sets")
    found = stored(with_ends(close, sets, "hashes").mapInPandas(check, "u long, v long"), "similar-links")
    discard(close, held, sets)
    return found


def _bucket_pairs(keyed: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Stored pairs ``u, v`` of the buckets of ``keyed`` (``key, set_id, size, band``), and the rows of crowded ones.

    All pairs of a bucket of ``bucket`` sets at most; in a larger one those of each set and the pivot, which
    is the set that most crowds share.
    """
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(keyed.join(sizes.hint("merge"), "key"), "similar-bands")  # alike at every size
    groups = met.where(f"n <= {bucket}").groupBy("key").agg(F.collect_list(F.struct("set_id", "size")).alias("all"))
    near = F.flatten(
        F.transform(
            "all",
            lambda x: F.transform(
                F.filter("all", lambda y: (y.set_id > x.set_id) & (F.least(x.size, y.size) * SIMILAR[1] >= F.greatest(x.size, y.size) * SIMILAR[0])),
                lambda y: F.struct(x.set_id.alias("u"), y.set_id.alias("v")),
            ),
        )
    )
    pairs = groups.select(F.explode(near).alias("e")).select("e.u", "e.v")
    crowd = stored(met.where(f"n > {bucket}").drop("n"), "similar-crowds")
    ranks = crowd.groupBy("set_id").agg(F.count(F.lit(1)).alias("rank"))
    pivots = crowd.join(ranks, "set_id").groupBy("key").agg(F.max_by(F.struct("set_id", "size"), F.struct("rank", "set_id")).alias("p"))
    stars = crowd.join(pivots, "key").where(f"set_id <> p.set_id and {_near_size('size', 'p.size')}")
    pairs = pairs.unionByName(stars.select(F.least("set_id", "p.set_id").alias("u"), F.greatest("set_id", "p.set_id").alias("v")))
    pairs = stored(pairs.distinct(), "similar-pairs")
    discard(met)
    return pairs, crowd


def _crowd_pairs(crowd: DataFrame, found: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """Stored pairs ``u, v`` of sets that share a crowd, agree by size and signature and are in different components yet.

    Each set outside its crowd's largest component is compared with the whole crowd, block by block.  ``nearest``
    leaves only the best of each block, as a first step: most sets that are to be joined are so by then.  A pair belongs
    to the first band that it shares; if few sets share that one, the pair has been compared there.
    """
    placed = crowd.select("key", "band", "set_id").join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    placed = stored(placed.withColumn("component", F.coalesce("component", "set_id")), "similar-placed")
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    keys = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).where("n > most")
    blocks = lambda n, size: F.ceil(n / size).cast("int")
    keys = stored(keys.select("key", "main", blocks(F.col("n") - F.col("most"), APART).alias("here"), blocks(F.col("n"), OTHERS).alias("there")), "similar-mixed")
    members = placed.join(keys, "key").join(nodes.select("set_id", "size", "minima"), "set_id")
    members = members.withColumn("main", F.col("component") == F.col("main"))
    spread = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    own = lambda count: F.pmod(F.hash("set_id"), F.col(count))
    columns = ["key", "band", "set_id", "component", "main", "size", "minima"]
    left = members.where("not main").select(*columns, own("here").alias("a"), spread("there").alias("b"))
    right = members.select(*[F.col(c).alias(f"m_{c}") for c in columns], spread("here").alias("m_a"), own("there").alias("m_b"))

    def run(apart: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        ends = [np.zeros((2, 0), np.int64)]
        if len(apart) and len(others):
            minima, band = np.frombuffer(b"".join(others["m_minima"]), np.uint16).reshape(len(others), -1), others["m_band"].iat[0]
            ids, part, size = (others[f"m_{c}"].to_numpy(np.int64) for c in ("set_id", "component", "size"))
            main = others["m_main"].to_numpy(bool)
            for i, p, n, m in zip(apart["set_id"], apart["component"], apart["size"], apart["minima"], strict=True):
                at = np.flatnonzero((part != p) & (main | (ids > i)) & (np.minimum(size, n) * SIMILAR[1] >= np.maximum(size, n) * SIMILAR[0]))
                same = minima[at] == np.frombuffer(m, np.uint16)
                alike = same.sum(1)
                likely = (alike >= LEAST_AGREEING) & (same.reshape(-1, BANDS, BAND_MINIMA).all(2).argmax(1) == band)
                near = ids[at[likely]]
                if nearest and len(near):
                    near = near[[alike[likely].argmax()]]
                ends.append(np.stack([np.minimum(near, i), np.maximum(near, i)]))
        u, v = np.concatenate(ends, axis=1)
        return pd.DataFrame({"u": u, "v": v})

    pairs = left.groupBy("key", "a", "b").cogroup(right.groupBy("m_key", "m_a", "m_b"))
    out = stored(pairs.applyInPandas(run, "u long, v long").distinct(), "similar-apart")
    discard(placed, keys)
    return out


def similar_rows(rows: DataFrame, *, shingle_words: int = SHINGLE_WORDS, bucket: int = BUCKET) -> DataFrame:
    """``row, component``, stored, for each row of ``rows`` (``row, text``): components of links between similar sets.

    Equal sets, the empty one too, are one node.  Pairs that share a band are compared, and linked only if the
    exact similarity reaches the threshold.  Where more than ``bucket`` sets share a band, each is compared with a
    pivot first; after that all pairs of the crowd that are not in one component yet.  So no link is passed over that
    would join anything, and near copies cost little, as most are joined by the pivots; a crowd whose sets are
    alike but seldom linked costs its square.
    """
    signed = stored(_signed(rows, shingle_words), "similar-signed")
    nodes = stored(signed.groupBy("set_id").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("minima").alias("minima")), "similar-nodes")
    banded = nodes.where("minima is not null").select("set_id", "size", "minima", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    pairs, crowd = _bucket_pairs(banded.select("set_id", "size", "band", _band_key().alias("key")), bucket)
    links = [_verified(pairs, nodes, rows, shingle_words)]
    discard(pairs)
    found = components(links[0], "u", "v")
    for nearest in (True, False):
        apart = _crowd_pairs(crowd, found, nodes, nearest)
        done = apart.isEmpty()
        if not done:
            links.append(_verified(apart, nodes, rows, shingle_words))
            last, found = found, components(reduce(DataFrame.unionByName, links), "u", "v")
            discard(last)
        discard(apart)
        if done:
            break
    named = signed.select("row", "set_id").join(found.withColumnRenamed("node", "set_id"), "set_id", "left")
    out = stored(named.select("row", F.coalesce("component", "set_id").alias("component")), "similar-classes")
    discard(signed, nodes, crowd, found, *links)
    return out


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that come first, by id, in their group of similar texts.

    Rows with a null id are judged too and come last in their group; rows that share an id but not a group
    all stay.  Null and empty texts are alike, texts of fewer words than a shingle are one shingle, an empty
    table stays empty, and columns may have any names.
    """
    marked = marked_rows(docs, doc_id, text)
    found = similar_rows(marked.select(F.col("_row").alias("row"), F.col("_text").alias("text")), **options)
    kept = first_rows(marked, found)
    discard(found)
    return kept
