"""Packing documents into sequences of bounded length by large-item matching and best fit.

Packing needs the lengths alone, and there are at most ``capacity`` of them: Spark counts the pieces of each length,
and the counts are packed as a whole, many equal sequences at once.  Pieces above one third of the capacity go two
to a sequence at most, so they are matched greedily, the longest with the longest that still fits it; shorter
pieces follow by falling length, each into the smallest gap that takes it.  Then every piece looks up its place by
its rank among the pieces of its length.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, small_keys, stored
from tallyloom.llm.token_output import END_ID, encoder, slices

CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, place long"


@dataclass
class Alike:
    """``count`` sequences that hold pieces of the same lengths: ``runs`` of (length, copies), in order."""

    count: int
    gap: int
    runs: tuple[tuple[int, int], ...]


def match_large(counts: dict[int, int], capacity: int) -> list[Alike]:
    """Sequences for pieces above a third of ``capacity``: the longest with the longest that fits beside it."""
    left = {n: c for n, c in counts.items() if c and 3 * n > capacity}
    lengths = sorted(left)
    out = []
    while lengths:
        n = lengths[-1]
        k = bisect.bisect_right(lengths, capacity - n) - 1
        if k < 0:
            out.append(Alike(left[n], capacity - n, ((n, 1),)))
            left[n] = 0
        elif (other := lengths[k]) == n:
            pairs, left[n] = divmod(left[n], 2)
            if pairs:
                out.append(Alike(pairs, capacity - 2 * n, ((n, 2),)))
            elif k > 0:  # the last of its length takes the next shorter one
                other = lengths[k - 1]
                out.append(Alike(1, capacity - n - other, ((n, 1), (other, 1))))
                left[n], left[other] = 0, left[other] - 1
                if not left[other]:
                    lengths.remove(other)
            else:
                out.append(Alike(1, capacity - n, ((n, 1),)))
                left[n] = 0
        else:
            pairs = min(left[n], left[other])
            out.append(Alike(pairs, capacity - n - other, ((n, 1), (other, 1))))
            left[n], left[other] = left[n] - pairs, left[other] - pairs
            if not left[other]:
                lengths.remove(other)
        if not left[n]:
            lengths.remove(n)
    return out


def fit_small(sequences: list[Alike], counts: dict[int, int], capacity: int) -> list[Alike]:
    """``sequences`` and new ones with the pieces up to a third of ``capacity`` in them, by falling length.

    Putting a piece into the smallest gap that takes it makes that gap the smallest, so each sequence takes as
    many of a length as it can before the next one is looked at, and equal sequences can be filled together.
    """
    by_gap: dict[int, list[Alike]] = defaultdict(list)
    for own in sequences:
        by_gap[own.gap].append(own)
    gaps = sorted(by_gap)

    def put(own: Alike) -> None:
        if own.gap not in by_gap:
            bisect.insort(gaps, own.gap)
        by_gap[own.gap].append(own)

    for n in sorted((n for n, c in counts.items() if c and 3 * n <= capacity), reverse=True):
        left = counts[n]
        while left:
            k = bisect.bisect_left(gaps, n)
            if k == len(gaps):
                each = capacity // n
                put(Alike(-(-left // each), capacity, ()))
                continue
            gap = gaps[k]
            own = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(k)
            each = gap // n
            full = min(own.count, left // each)
            rest = min(left - full * each, each) if full < own.count else 0
            if full:
                put(Alike(full, gap - each * n, (*own.runs, (n, each))))
            if rest:
                put(Alike(1, gap - rest * n, (*own.runs, (n, rest))))
            if untouched := own.count - full - bool(rest):
                put(Alike(untouched, gap, own.runs))
            left -= full * each + rest
    return [own for gap in sorted(by_gap) for own in by_gap[gap]]


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Alike]:
    """Sequences for so many pieces of each length; every length is between 1 and ``capacity``."""
    return fit_small(match_large(counts, capacity), counts, capacity)


class Places:
    """Where the piece of a rank among those of its length goes."""

    def __init__(self, sequences: list[Alike]) -> None:
        runs: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        taken: dict[int, int] = defaultdict(int)
        first = 0
        for own in sequences:
            offset = 0
            for n, copies in own.runs:
                runs[n].append((taken[n], copies, first, offset))
                taken[n] += own.count * copies
                offset += n * copies
            first += own.count
        self.runs = {n: np.array(rows, np.int64) for n, rows in runs.items()}

    def __call__(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros((2, len(lengths)), np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            own = self.runs[int(n)]
            start, copies, first, place = own[np.searchsorted(own[:, 0], ranks[at], side="right") - 1].T
            within = ranks[at] - start
            sequence[at], offset[at] = first + within // copies, place + within % copies * n
        return sequence, offset


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of a document: whole capacities, and what is over before them."""
    over = length % capacity
    bounds = [0] * bool(over) + list(range(over, length + 1, capacity))
    return [(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids`` of every text, encoded and ended by ``end_id``, stored.

    ``ids`` are little-endian unsigned 32-bit integers.  ``part`` and ``place`` number the pieces of each length
    within a task's rows; a lost task is run anew as a whole, and what it stored counts.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, seen = np.array([end_id], encode.dtype), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts, at = batch.column("text").to_pylist(), 0
            for own in slices([t or "" for t in texts]):
                ids = encode(own)
                bounds = [cut(len(x) + 1, capacity) for x in ids]
                numbers = np.repeat(np.arange(at, at + len(own)), [len(b) for b in bounds])
                start, length = np.array([p for b in bounds for p in b], np.int64).T
                first = np.concatenate([np.arange(len(b)) for b in bounds])
                # The pieces follow each other in the ids of all texts, which so are the data of the binary column.
                whole = np.concatenate([x for own_ids in ids for x in (own_ids, end)]).astype("<u4")
                offsets = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
                cells = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(whole)])
                columns = [batch.column("doc_id").take(pa.array(numbers)), pa.array(first.astype(np.int32)), pa.array(start), pa.array(length), cells]
                columns += [pa.array(np.full(len(length), part, np.int32)), pa.array(_places(length, seen))]
                yield pa.record_batch(columns, names=["doc_id", "piece", "start", "length", "ids", "part", "place"])
                at += len(own)

    return stored(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES), "pieces")


def _places(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many pieces of its length came before each one; ``seen`` counts those before, and goes on."""
    order = np.argsort(lengths, kind="stable")
    ranked = lengths[order]
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[starts, len(ranked)])
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(ranked)) - np.repeat(starts, sizes) + seen[ranked]
    seen[ranked[starts]] += sizes
    return out


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids, sequence_id, offset``: every text as pieces in sequences of ``capacity`` ids.

    A text is encoded by the file ``tokenizer`` and ended by ``end_id``; only one of more than ``capacity`` ids is
    cut, into whole capacities with the rest before them.  ``start`` counts the document's ids before the piece,
    ``offset`` the sequence's, without gaps.  Null and empty texts are one piece of the end id alone.  Rows with null
    or equal ids are documents of their own, an empty table gives an empty result, and further columns are ignored
    whatever their names.

    The driver holds a count for each length and the sequences made of them, whose number depends on ``capacity``
    and not on the documents.
    """
    pieces = token_pieces(docs, tokenizer, capacity=capacity, doc_id=doc_id, text=text, end_id=end_id)
    by_part = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    places = Places(pack_counts(counts, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = stored(by_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("base")), "piece-ranks")
    discard(by_part)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = pieces.join(small_keys(bases), ["part", "length"]).withColumn("at", place("length", F.col("place") + F.col("base")))
    return placed.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids, lengths``: the ids of every sequence, and of how many each of its pieces has, in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))  # at most ``capacity`` pieces
    own = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(b""), lambda s, p: F.concat(s, p["ids"]))
    return own.select("sequence_id", whole.alias("ids"), F.transform("parts", lambda p: p["length"]).alias("lengths"))
