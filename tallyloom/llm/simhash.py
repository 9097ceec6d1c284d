"""SimHash near-duplicates: pigeonhole blocks, joined on blocks, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, id_text, small_keys, stored, with_ids
from tallyloom.llm.components import components

SHINGLE_WORDS = 3
MAX_DISTANCE = 2
SEED = 42
BITS = 64
#: A bucket of more distinct fingerprints than this takes the exact route over shared midpoints.
BUCKET = 64


def shingles(text: str | None, shingle_words: int) -> np.ndarray:
    """A hash for each shingle of the lower-cased words, in order; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(shingle_words, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as an unsigned integer: a bit is set if over half the shingles set it."""
    hashes = shingles(text, shingle_words).astype(">u8")
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, bits`` for every row; ``bits`` is the fingerprint in a signed BIGINT."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = np.fromiter((fingerprint(t, shingle_words) for t in pdf["text"]), np.uint64, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "bits": bits.view(np.int64)})

    narrow = docs.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_ids(narrow.mapInPandas(run, "doc_id string, bits long"))


def _block_keys(bits: Column, distance: int) -> Column:
    """Pigeonhole keys: the word is cut into ``distance + 2`` blocks, and every choice of two blocks is
    a key.  ``distance`` differing bits spoil at most that many blocks, so two whole blocks agree."""
    n = distance + 2
    cuts = [round(k * BITS / n) for k in range(n + 1)]
    blocks = [F.shiftrightunsigned(F.shiftleft(bits, BITS - cuts[k + 1]), BITS - (cuts[k + 1] - cuts[k])) for k in range(n)]
    return F.array(*[F.struct(F.lit(c).cast("tinyint").alias("choice"), blocks[i].alias("a"), blocks[j].alias("b")) for c, (i, j) in enumerate(combinations(range(n), 2))])


def _light_links(keyed: DataFrame, sizes: DataFrame, distance: int, bucket: int) -> DataFrame:
    """Verified pairs of the buckets that hold at most ``bucket`` fingerprints."""
    light = keyed.join(sizes.where(f"n between 2 and {bucket}").drop("n"), "key").groupBy("key").agg(F.array_sort(F.collect_list("bits")).alias("all"))
    close = F.flatten(
        F.transform(
            "all",
            lambda x: F.transform(
                F.filter("all", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= distance)),
                lambda y: F.struct(x.alias("u"), y.alias("v")),
            ),
        )
    )
    return light.select(F.explode(close).alias("e")).select("e.u", "e.v")


def _midpoint_links(crowded: DataFrame) -> DataFrame:
    """Links at distance two or less among fingerprints of crowded buckets, without comparing pairs.

    Two words differ in at most two bits exactly if some word is within one bit of both.  A word has
    64 neighbours, so a group by that middle word never holds more than 65 fingerprints, however many
    copies there are.  A star around the smallest keeps the components.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(BITS)])
    near = crowded.select("bits", F.explode(F.transform(flips, lambda m: F.col("bits").bitwiseXOR(m))).alias("middle"))
    groups = near.groupBy("middle").agg(F.collect_list("bits").alias("all")).where(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).where("u <> v")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest ``doc_id`` that links
    at ``distance`` (at most 2) or fewer differing bits reach, the row's own included.

    Null and empty texts have fingerprint zero and link like any other.  Equal texts meet as one
    fingerprint before any comparison, so a group of copies costs one row.  Rows with a null id keep
    their row; an id that repeats keeps all its rows.  An empty table gives an empty result, and further
    columns of ``docs`` are ignored whatever their names.
    """
    if not 0 <= distance <= 2:
        raise ValueError("the exact route over midpoints needs a distance of 0, 1 or 2")
    prints = stored(fingerprints(docs, doc_id=doc_id, text=text, shingle_words=shingle_words), "simhash")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    keyed = distinct.select("bits", F.explode(_block_keys(F.col("bits"), distance)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes.where("n > 1"), "simhash-buckets")
    crowded = keyed.join(sizes.where(f"n > {bucket}").drop("n"), "key").select("bits").distinct()
    edges = _light_links(keyed, sizes, distance, bucket).unionByName(_midpoint_links(crowded))
    edges = edges.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)
    found = components(edges, "u", "v")
    discard(sizes)
    classed = distinct.join(found.withColumnRenamed("node", "bits"), "bits", "left")
    classed = classed.select("bits", "least", F.coalesce("component", "bits").alias("component"))
    least = classed.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = stored(classed.join(least, "component").select("bits", "component_id"), "simhash-classes")
    discard(distinct, found)
    return prints.join(classes, "bits").select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def row_key(doc_id: str, text: str) -> Column:
    """A hash of id and text, never null, that tells rows apart where ids are null or repeat."""
    return F.xxhash64(F.col(doc_id).isNull(), F.col(doc_id), F.col(text).isNull(), F.col(text))


def marked_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``_doc, _row, _id, _text``: whole rows, whatever their columns are called, with their key, id and text."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(whole.alias("_doc"), row_key(doc_id, text).alias("_row"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))


def first_rows(marked: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``marked_rows`` that come first in their group, by id (null last) and then by key.

    ``groups`` has ``row, component``.  Repeated rows of one id and text share their key and their group, and
    one of them stays.
    """
    ids = marked.select("_row", F.col("_id").isNull().alias("_null"), "_id").groupBy("_row", "_null", "_id").agg(F.count(F.lit(1)).alias("n"))
    rows = stored(ids.join(groups.select(F.col("row").alias("_row"), "component").distinct(), "_row"), "row-groups")
    first = rows.groupBy("component").agg(F.min(F.struct("_null", "_id", "_row")).alias("least")).select(F.col("least._row").alias("_row"))
    repeats = stored(rows.where("n > 1").join(first, "_row", "left_semi").select("_row"), "repeated-rows")
    gone = stored(rows.join(first, "_row", "left_anti").select("_row").union(repeats), "gone-rows")
    discard(rows)
    kept = marked.join(small_keys(gone), "_row", "left_anti").select("_doc")
    if not repeats.isEmpty():  # of rows that agree in id and text
        once = marked.join(small_keys(repeats), "_row", "left_semi").dropDuplicates(["_row"])
        kept = kept.unionByName(once.select("_doc"))
    return kept.select("_doc.*")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that come first, by id, in their group of near-duplicates.

    Rows with a null id are judged too and come last in their group; rows that share an id but are no
    near-duplicates all stay.  Null and empty texts are alike, an empty table stays empty, and columns may
    have any names.
    """
    marked = marked_rows(docs, doc_id, text)
    found = near_duplicates(marked, doc_id="_row", text="_text", **options)
    return first_rows(marked, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
