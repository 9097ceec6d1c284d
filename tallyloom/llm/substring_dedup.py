"""Substring deduplication: Rabin-Karp hashes of every fixed-length window of words.

Documents are dealt by ranges of their id into chunks.  Each chunk packs the hashes of its windows, by
ranges of the hash, into sorted blobs; the owner of a hash range merges the blobs of all chunks, counts,
and tells every chunk which of its windows already start in an earlier chunk.  Because chunks are ordered
by id, no ids travel with the hashes; within a chunk the order is settled locally.  An id whose rows are
too long for a chunk has chunks of its own, of which none is earlier than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, id_text, parts_for, with_ids
from tallyloom.llm.wordpack import WordHashes, in_ranges, pack, split_words, unpack

WINDOW = 13
#: Bytes of text in a chunk, and windows in a hash range, on average: what one task holds.
CHUNK_BYTES = 8_000_000
RANGE_WINDOWS = 2_000_000
#: Multiplier of the polynomial hash, modulo 2**64, and the two multipliers of its final mix.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
FIRST_ID, LAST_ID = -(1 << 63), (1 << 63) - 1


def window_hashes(words: list[bytes], lengths: np.ndarray, width: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every window of ``width`` words that lies within one document.

    ``words`` holds the documents one after the other, ``lengths`` their numbers of words.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    each = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled *= MULTIPLIER
        rolled += each[k : k + n]
    ends = np.repeat(np.cumsum(lengths), lengths)[:n]
    starts = np.flatnonzero(np.arange(width, n + width) <= ends)
    rolled = rolled[starts]
    for shift, factor in ((30, MIX_A), (27, MIX_B)):
        rolled ^= rolled >> np.uint64(shift)
        rolled *= factor
    return starts, rolled ^ (rolled >> np.uint64(31))


@dataclass
class Chunks:
    """Chunks in the order of ids: the last id of every place in that order, and the first chunk of each place."""

    last: np.ndarray
    first: np.ndarray

    def of(self, ids: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        place = np.searchsorted(self.last, ids, side="left")
        parts = np.diff(self.first)[place].astype(np.uint64)
        return (self.first[place] + (hashes.view(np.uint64) % parts).astype(np.int64)).astype(np.int32)

    def place(self, chunks: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, chunks, side="right") - 1

    def __len__(self) -> int:
        return int(self.first[-1])


def _chunks(sized: DataFrame, chunks: int, chunk_bytes: int) -> Chunks:
    """About ``chunks`` places in the order of ids, and more for ids of over ``chunk_bytes`` bytes of text.

    ``sized`` has ``id, bytes``.  A number or two for each chunk come to the driver, and no ids but those.
    """
    each = sized.repartitionByRange(chunks, "id").groupBy("id").agg(F.sum("bytes").alias("bytes"))
    own = F.when(F.col("bytes") > chunk_bytes, F.struct("id", "bytes"))
    found = each.groupBy(F.spark_partition_id().alias("part")).agg(F.max("id").alias("last"), F.collect_list(own).alias("long")).collect()
    parts = {r["id"]: parts_for(r["bytes"], chunk_bytes) for row in found for r in row["long"]}
    lasts = {row["last"] for row in found} | set(parts) | {i - 1 for i in parts if i > FIRST_ID}
    last = sorted(lasts - {LAST_ID})  # whatever follows the last of these has a place too
    return Chunks(np.array(last, np.int64), np.cumsum([0, *(parts.get(i, 1) for i in [*last, LAST_ID])]))


def _packed_windows(chunked: DataFrame, width: int, ranges: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, found = WordHashes(), {}
        for pdf in batches:
            for chunk, own in pdf.groupby("chunk"):
                _, hashes = window_hashes(*split_words(own["text"]), width, known)
                found.setdefault(int(chunk), []).append(np.unique(hashes))
        for chunk in list(found):
            hashes = np.unique(np.concatenate(found.pop(chunk)))
            if not len(hashes):
                continue
            numbers, cuts = in_ranges(hashes, ranges)
            rows = [(r, chunk, pack(own)) for r, own in zip(numbers, np.split(hashes, cuts), strict=True)]
            yield pd.DataFrame(rows, columns=["range", "chunk", "blob"])

    return chunked.mapInPandas(run, "range int, chunk int, blob binary")


def _seen_earlier(packed: DataFrame, chunks: Chunks) -> DataFrame:
    """For every chunk, those of its hashes that a chunk of smaller ids holds too."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        parts = [unpack(b, np.uint64) for b in pdf["blob"]]
        hashes = np.concatenate(parts)
        owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        place = chunks.place(pdf["chunk"].to_numpy())[owner]
        order = np.argsort(hashes, kind="stable")  # equal hashes stay in the order of the chunks
        first = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
        least = place[order[np.flatnonzero(first)]][np.cumsum(first) - 1]
        again = np.sort(order[least < place[order]])
        cuts = np.searchsorted(owner[again], np.arange(1, len(parts)))
        rows = [(c, pack(own)) for c, own in zip(pdf["chunk"], np.split(hashes[again], cuts), strict=True) if len(own)]
        return pd.DataFrame(rows, columns=["chunk", "blob"])

    return packed.groupBy("range").applyInPandas(run, "chunk int, blob binary")


def _without_repeats(width: int):
    def run(docs: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        words, lengths = split_words(docs["text"])
        starts, hashes = window_hashes(words, lengths, width, WordHashes())
        gone = np.zeros(len(words) + 1, np.int64)
        if len(starts):
            ids = np.array([LAST_ID if i is None else int(i) for i in docs["doc_id"]], np.int64)
            owner = np.repeat(ids, lengths)[starts]
            order = np.argsort(hashes, kind="stable")
            first = np.r_[True, hashes[order[1:]] != hashes[order[:-1]]]
            least = np.empty(len(order), np.int64)
            least[order] = np.minimum.reduceat(owner[order], np.flatnonzero(first))[np.cumsum(first) - 1]
            hit = least < owner
            if len(earlier):
                seen = np.sort(np.concatenate([unpack(b, np.uint64) for b in earlier["blob"]]))
                hit |= seen[np.minimum(np.searchsorted(seen, hashes), len(seen) - 1)] == hashes
            np.add.at(gone, starts[hit], 1)
            np.add.at(gone, starts[hit] + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        ends = np.cumsum(lengths)
        rows = []
        for doc_id, b, n in zip(docs["doc_id"], ends.tolist(), lengths.tolist(), strict=True):
            own, off = words[b - n : b], gone[b - n : b]
            removed = int(off.sum())
            edges = np.flatnonzero(np.diff(np.r_[False, off, False])).reshape(-1, 2).tolist() if removed else []
            kept = compress(own, (~off).tolist()) if removed else own
            rows.append((doc_id, n, removed, [{"start": s, "end": e} for s, e in edges], b" ".join(kept).decode("utf-8")))
        return pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, range_windows: int = RANGE_WINDOWS) -> DataFrame:
    """``doc_id, n_words, n_removed, spans, kept_text`` for every row of ``docs``.

    A word goes if a window of ``width`` words covers it whose sequence of words also starts in a
    document with a smaller id.  ``spans`` are the maximal runs of removed words as half-open word
    positions; ``kept_text`` joins the other words by one space.

    Null and empty texts, and texts of fewer than ``width`` words, lose nothing.  Rows that share an id
    don't remove each other's words; a null id counts as larger than all others.  However many rows share an
    id, they are dealt over several tasks by their texts.  An empty table gives an empty result, and
    further columns of ``docs`` are ignored whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    narrow = docs.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    sized = narrow.select(place.alias("id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    size = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    chunks, ranges = _chunks(sized, parts_for(size, chunk_bytes), chunk_bytes), parts_for(size // 6, range_windows)
    known = spark.sparkContext.broadcast(chunks)

    @F.pandas_udf("int")
    def chunk_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(known.value.of(ids.to_numpy(np.int64), hashes.to_numpy(np.int64)))

    chunk = chunk_of(place, F.xxhash64("text"))
    chunked = narrow.withColumn("chunk", chunk).repartition(len(chunks), "chunk")
    earlier = _seen_earlier(_packed_windows(chunked, width, ranges), chunks)
    both = chunked.groupBy("chunk").cogroup(earlier.groupBy("chunk"))
    return with_ids(both.applyInPandas(_without_repeats(width), "doc_id string, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"))
