"""Benchmark decontamination by the q-gram lemma.

A text holds a benchmark item if some stretch of it differs from the whole item in at most ``budget`` edits
for each character.  Such a stretch shares at least ``m - q + 1 - q * e`` q-grams with an item of ``m``
characters and ``e`` edits, all within ``e + 1`` neighbouring diagonals.  Shared q-grams are counted in
overlapping bands of diagonals, bands that reach the bound are kept, and banded alignment verifies them.
Items of fewer than ``q`` characters allow no edit and are searched as they are, by Aho-Corasick.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, id_text, parts_for, small_keys, stored, with_ids
from tallyloom.llm.simhash import marked_rows

Q, BUDGET = 10, 0.06
#: Characters of benchmark that are compared at once; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
#: Characters of text that are counted together, and slots of the first, hashed count.
PIECE_CHARS, SLOTS = 400_000, 1 << 20
#: Pairs of equal q-grams that are held at once.
HITS = 1_000_000
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id string, item_id string, start long, end long, edits int"


def normalised(text: str | None) -> str:
    """Lower case, with one blank for each run of white space."""
    return " ".join((text or "").lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(symbols: np.ndarray, q: int) -> np.ndarray:
    n = len(symbols) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    rolled, wide = np.zeros(n, np.uint64), symbols.astype(np.uint64)
    for k in range(q):
        rolled *= MULTIPLIER
        rolled += wide[k : k + n]
    rolled ^= rolled >> np.uint64(29)
    return rolled * MULTIPLIER


@dataclass
class Index:
    """Items, their q-grams sorted by hash, and a bitmap that most other q-grams miss."""

    item_ids: list[str | None]
    items: list[np.ndarray]
    q: int
    edits: np.ndarray
    least: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    bitmap: np.ndarray
    #: Ids of the items that are too short for a q-gram, by text.
    short: dict[str, list[str | None]] = field(default_factory=dict)

    def literal(self) -> ahocorasick.Automaton | None:
        if not self.short:
            return None
        found = ahocorasick.Automaton()
        for text in self.short:
            found.add_word(text, text)
        found.make_automaton()
        return found

    @staticmethod
    def of(item_ids: list[str | None], texts: list[str], q: int, budget: float) -> Index:
        every = list(zip(item_ids, map(normalised, texts), strict=True))
        kept, short = [(i, t) for i, t in every if len(t) >= q], {}
        for i, t in every:
            if 0 < len(t) < q:
                short.setdefault(t, []).append(i)
        items = [codes(t) for _, t in kept]
        m = np.array([len(x) for x in items], np.int64)
        edits = np.minimum((m * budget + 1e-9).astype(np.int64), (m - q) // q)  # so that the bound is 1 at least
        grams = [gram_hashes(x, q) for x in items]
        hashes = np.concatenate([*grams, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        at = np.concatenate([*(np.arange(len(g)) for g in grams), np.zeros(0, np.int64)])
        order = np.argsort(hashes, kind="stable")
        distinct, first = np.unique(hashes[order], return_index=True)
        bitmap = np.zeros(1 << 22, bool)
        bitmap[(distinct >> np.uint64(42)).astype(np.int64)] = True
        return Index([i for i, _ in kept], items, q, edits, m - q + 1 - q * edits, distinct, np.r_[first, len(order)], owner[order], at[order], bitmap, short)


def _hits(where: np.ndarray, place: np.ndarray, index: Index, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Item, band and slot of every pair of equal q-grams of text and items, ``HITS`` pairs at a time or little more.

    A q-gram that repeats in the text and in an item makes pairs as the product of both, so they are never held
    all at once.
    """
    each = index.first[place + 1] - index.first[place]
    ends = np.cumsum(each)
    start = 0
    while start < len(where):
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + HITS, "right")))
        own, some = slice(start, stop), each[start:stop]
        entry = np.repeat(index.first[place[own]] - np.r_[0, np.cumsum(some)[:-1]], some) + np.arange(some.sum())
        item = index.owner[entry]
        band = (np.repeat(where[own], some) - index.at[entry] + longest) // (index.edits[item] + 1)
        yield item, band, (item * 1_000_003 + band) & (SLOTS - 1)
        start = stop


def candidate_bands(symbols: np.ndarray, index: Index) -> list[tuple[int, int, int]]:
    """Item, first and last diagonal of every band whose shared q-grams reach the bound."""
    grams = gram_hashes(symbols, index.q)
    where = np.flatnonzero(index.bitmap[(grams >> np.uint64(42)).astype(np.int64)])
    place = np.searchsorted(index.hashes, grams[where])
    place = np.minimum(place, len(index.hashes) - 1)
    same = index.hashes[place] == grams[where]
    where, place = where[same], place[same]
    if not len(where):
        return []
    longest = max(map(len, index.items))
    count = np.zeros(SLOTS, np.int64)
    for _, _, slot in _hits(where, place, index, longest):
        count += np.bincount(slot, minlength=SLOTS)
    found: dict[int, int] = {}
    for item, band, slot in _hits(where, place, index, longest):
        likely = count[slot] + np.maximum(count[slot - 1], count[(slot + 1) & (SLOTS - 1)]) >= index.least[item]
        for key, n in zip(*map(np.ndarray.tolist, np.unique((item[likely] << 40) + band[likely], return_counts=True)), strict=True):
            found[key] = found.get(key, 0) + n
    out = []
    for key, own in found.items():
        item_no, b = key >> 40, key & ((1 << 40) - 1)
        width = int(index.edits[item_no]) + 1
        for low in (b - 1, b):  # the bands of two such strips that this one is part of
            total = found.get((item_no << 40) + low, 0) + found.get((item_no << 40) + low + 1, 0)
            if total >= index.least[item_no] and (low == b or key - 1 not in found):
                out.append((item_no, low * width - longest, (low + 2) * width - 1 - longest))
    return out


def aligned(item: np.ndarray, symbols: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Fewest edits between the whole item and a stretch of the text within the band, and its place.

    Diagonals ``low`` to ``high``, widened by ``most`` for the path's drift; None if it takes more edits.
    """
    low, width = low - most, high - low + 1 + 2 * most
    exact = symbols[max(0, low) : low + width + len(item)].tobytes().find(item.tobytes())
    if exact >= 0 and exact % 4 == 0:
        start = max(0, low) + exact // 4
        return 0, start, start + len(item)
    far = len(item) + 1
    inside = lambda j: (j >= 0) & (j < len(symbols))
    step = np.arange(width)
    ends = step + low  # of the empty prefix: the stretch may begin anywhere
    cost, begin = np.where((ends >= 0) & (ends <= len(symbols)), 0, far), ends.copy()
    for i, symbol in enumerate(item.tolist()):
        j = ends + i
        other = np.where(inside(j), symbols[np.clip(j, 0, len(symbols) - 1)], 0xFFFFFFFF)
        best, origin = cost + (other != symbol) + np.where(inside(j), 0, far), begin
        skipped = np.r_[cost[1:] + 1, far]
        take = skipped < best
        best, origin = np.where(take, skipped, best), np.where(take, np.r_[begin[1:], 0], origin)
        slack = best - step  # characters of the text that the item lacks: a running minimum
        lowest = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == lowest, step, 0))
        cost, begin = lowest + step, origin[source]
    best = int(cost.argmin())
    if cost[best] > most:
        return None
    return int(cost[best]), int(begin[best]), int(ends[best] + len(item))


def found_in(text: str, index: Index) -> dict[int, tuple[int, int, int]]:
    """Edits, start and end of the best stretch for every item that the normalised text holds."""
    if not index.items:
        return {}
    symbols = codes(text)
    overlap = max(len(x) + 2 * int(e) + 2 for x, e in zip(index.items, index.edits, strict=True))
    step = max(PIECE_CHARS, 4 * overlap)
    best: dict[int, tuple[int, int, int]] = {}
    for k in range(0, max(1, len(symbols) - overlap), step):
        piece = symbols[k : k + step + overlap]
        for item, low, high in candidate_bands(piece, index):
            if (hit := aligned(index.items[item], piece, low, high, int(index.edits[item]))) is not None:
                hit = (hit[0], hit[1] + k, hit[2] + k)
                best[item] = min(best.get(item, hit), hit)
    return best


def short_in(text: str, index: Index, literal: ahocorasick.Automaton | None) -> list[tuple[int, int, int, int]]:
    """Item, start, end and edits (none) of the first place of every short item that the normalised text holds."""
    first: dict[str, int] = {}
    for end, item in literal.iter(text) if literal is not None else ():
        first.setdefault(item, end + 1)
    return [(i, end - len(item), end, 0) for item, end in first.items() for i in index.short[item]]


def _scan(docs: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        literal = index.literal()
        for pdf in batches:
            rows = []
            # Short texts are counted together, set apart by a character that no item holds.
            texts, group, size = [normalised(t) for t in pdf["text"]], [], 0
            for k, text in enumerate(texts):
                group.append(k)
                size += len(text)
                if size < PIECE_CHARS and k + 1 < len(texts):
                    continue
                if len(group) > 1:
                    together = codes("￿".join(texts[g] for g in group))
                    starts = np.cumsum([0, *(len(texts[g]) + 1 for g in group)])
                    bands = candidate_bands(together, index) if index.items else []
                    owners = {group[int(np.searchsorted(starts, max(0, x), "right")) - 1] for item, low, high in bands for x in range(low, high + len(index.items[item]), max(1, len(index.items[item]) // 2)) if x < starts[-1]}
                    owners |= {group[int(np.searchsorted(starts, min(max(0, high + len(index.items[item])), int(starts[-1]) - 1), "right")) - 1] for item, low, high in bands}
                else:
                    owners = set(group)
                for g in sorted(owners):
                    rows += [(pdf["doc_id"].iloc[g], index.item_ids[item], start, end, edits) for item, (edits, start, end) in sorted(found_in(texts[g], index).items())]
                group, size = [], 0
            if literal is not None:
                rows += [(d, *hit) for d, t in zip(pdf["doc_id"], texts, strict=True) for hit in sorted(short_in(t, index, literal))]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "edits"])

    return with_ids(with_ids(docs.mapInPandas(run, SCHEMA)), "item_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", q: int = Q, budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: a row for every item that a text holds.

    Texts and items are lower-cased and runs of white space made one blank; ``start`` and ``end`` count
    characters of that, and of several places the one with fewest edits, then the first, is given.  An
    item allows ``budget`` edits for each of its characters, and never so many that the bound on shared
    q-grams falls under one.  Items of fewer than ``q`` characters are held where they stand without an edit,
    inside words too; null and blank ones are held by no text.

    The benchmark goes to the executors in blocks of ``block_chars`` characters, a pass over the texts for
    each.  Null and empty texts hold nothing; repeated rows each give their rows; an empty table gives an
    empty result; further columns are ignored whatever their names.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(id_text(item_id).alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    blocks = parts_for(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0], block_chars)
    block = F.pmod(F.xxhash64(F.col("item_id").cast("long"), "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        own = items.where(block == k).orderBy(F.col("item_id").cast("long"), "text").toPandas()
        found = _scan(narrow, Index.of(own["item_id"].tolist(), own["text"].tolist(), q, budget))
        out = found if out is None else out.unionByName(found)
    return out


def without_benchmark(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item.

    Rows with null or repeated ids are judged by their own text, null and empty texts stay, repeated rows stay
    or go together, an empty table stays empty, and columns may have any names.
    """
    marked = marked_rows(docs, doc_id, text)
    found = contaminated(marked, benchmark, doc_id="_row", text="_text", **options)
    bad = stored(found.select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return marked.join(small_keys(bad), "_row", "left_anti").select("_doc.*")
