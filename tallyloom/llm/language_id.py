"""Language identification by partial matching: byte context trees with escapes, one for each language.

The words of a text, lower-cased, are coded byte by byte.  A byte's contexts are the bytes before it in its
word, the blank ahead of the word included, up to ``ORDER`` of them; the longest context known to the
language is tried first, and where it has not seen the byte an escape is coded and the next shorter one
tried, down to an even choice among all bytes.  Statistics stay frozen while scoring, so the code length of
a word is exact and depends on the word alone, and frequent words are remembered.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, id_text, text_or_empty, thinned, with_ids
from tallyloom.llm.folding import letters_only

ORDER = 4
#: Rows of each language that the trees are counted on, at most, and the nodes of each, the most frequent.
SAMPLE_ROWS = 1500
MOST_NODES = 100_000
CACHE_WORDS = 300_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return letters_only(text).split() if text else []


class Trees:
    """Frozen statistics of all languages: what a byte after a context takes in bits, and an escape.

    A string of up to ``ORDER + 1`` bytes is both a coded byte after its context and a context of its
    own, so every string has one number, and two tables hold its bits by language.
    """

    def __init__(self, counts: list[tuple[str, bytes, int, int]], languages: list[str]) -> None:
        self.languages = languages
        column = {x: k for k, x in enumerate(languages)}
        kept: dict[tuple[str, bytes], dict[int, int]] = defaultdict(dict)
        for language, context, symbol, n in counts:
            kept[language, context][symbol] = n
        strings = sorted({x for _, c in kept for x in [c] if c} | {c + bytes((b,)) for (_, c), seen in kept.items() for b in seen})
        self.keys, self.coded, self.escape = [], [], [np.zeros((1, len(languages)), np.float32)]
        place: dict[bytes, int] = {}
        for size in range(1, ORDER + 2):
            own = [x for x in strings if len(x) == size]  # sorted as bytes, so sorted as numbers
            place |= {x: k for k, x in enumerate(own)}
            self.keys.append(np.array([int.from_bytes(x, "big") for x in own], np.int64))
            self.coded.append(np.full((len(own) + 1, len(languages)), np.nan, np.float32))
            self.escape.append(np.zeros((len(own) + 1, len(languages)), np.float32))
        for (language, context), seen in kept.items():
            total, own, size = sum(seen.values()) + len(seen), column[language], len(context)
            self.escape[size][place[context] if size else 0, own] = -math.log2(len(seen) / total)
            for symbol, n in seen.items():
                self.coded[size][place[context + bytes((symbol,))], own] = -math.log2(n / total)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits that each language takes for each word and the blank that ends it."""
        raw = [b" %b " % w.encode("utf-8", "surrogatepass") for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        within = np.arange(len(symbols)) - np.repeat(starts, lengths)
        bits = np.full((len(symbols), len(self.languages)), 8, np.float32)
        key, before = np.zeros(len(symbols), np.int64), np.zeros(len(symbols), np.int64)
        for size, (keys, coded) in enumerate(zip(self.keys, self.coded, strict=True), 1):
            # The string of ``size`` bytes that ends here; its context is what ended one byte before.
            key = symbols if size == 1 else np.r_[0, key[:-1]] * 256 + symbols
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            at = np.where((keys[at] == key) & (within >= size - 1), at, len(keys)) if len(keys) else np.zeros_like(key)
            own = coded[at]
            bits = np.where(np.isnan(own), bits + self.escape[size - 1][before], own)
            before = np.r_[len(keys), at[:-1]]
        bits[starts] = 0  # the blank ahead of a word is not coded
        return np.add.reduceat(bits, starts, axis=0, dtype=np.float64)


class Scorer:
    """Code lengths of texts, with those of recent words remembered."""

    def __init__(self, trees: Trees) -> None:
        self.trees, self.known, self.bits = trees, {}, np.zeros((CACHE_WORDS, len(trees.languages)))

    def __call__(self, texts: list[list[str]]) -> np.ndarray:
        """Bits by text and language."""
        owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
        words, total = list(chain.from_iterable(texts)), np.zeros((len(texts), len(self.trees.languages)))
        for k in range(0, len(words), CACHE_WORDS // 2):
            part = words[k : k + CACHE_WORDS // 2]
            fresh = [w for w in dict.fromkeys(part) if w not in self.known]
            if len(self.known) + len(fresh) > CACHE_WORDS:
                self.known, fresh = {}, list(dict.fromkeys(part))
            if fresh:
                n = len(self.known)
                self.bits[n : n + len(fresh)] = self.trees.code_lengths(fresh)
                self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            bits = self.bits[np.fromiter(map(self.known.__getitem__, part), np.int64, len(part))]
            for own in range(total.shape[1]):
                total[:, own] += np.bincount(owner[k : k + len(part)], bits[:, own], len(texts))
        return total


def _counted(sample: DataFrame) -> DataFrame:
    """``lang, context, symbol, n`` over the rows of the sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = defaultdict(Counter)
        for pdf in batches:
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                words[lang].update(words_of(text))
        for lang, own in words.items():
            nodes: Counter = Counter()
            for word, n in own.items():
                raw = b" " + word.encode("utf-8") + b" "
                for k in range(1, len(raw)):
                    for start in range(max(0, k - ORDER), k + 1):
                        nodes[raw[start : k + 1]] += n
            yield pd.DataFrame({"lang": lang, "context": [x[:-1] for x in nodes], "symbol": [x[-1] for x in nodes], "n": list(nodes.values())})

    partial = sample.mapInPandas(run, "lang string, context binary, symbol int, n long")
    return partial.groupBy("lang", "context", "symbol").agg(F.sum("n").alias("n"))


def learn_trees(docs: DataFrame, *, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS, most_nodes: int = MOST_NODES) -> Trees:
    """Context trees of every non-null value of ``lang``.

    Counting takes about ``sample_rows`` rows of each language at most, chosen by a hash of id and text, with
    their whole texts; repeated rows count once there; of a language's nodes the ``most_nodes`` most frequent are kept, which bounds the
    model.  What a rarer node would have coded takes an escape and a shorter context instead.  No language
    loses nodes to another, and one without any letter in its sample has none and is never predicted.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null")
    counts = _counted(thinned(rows, ["lang"], ["doc_id", "text"], sample_rows).select("text", "lang"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "context", "symbol")  # of a bounded sample
    frequent = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_nodes).collect()
    found = [(r["lang"], bytes(r["context"]), r["symbol"], r["n"]) for r in frequent]
    return Trees(found, sorted({r[0] for r in found}))


def predict(docs: DataFrame, trees: Trees, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, bits`` for every row.

    ``lang_pred`` is the language with the shortest code, the first by name among equals; ``score`` its
    posterior under even priors, with the evidence spread over at most 50 bits; ``bits`` its code length.

    A text that is null or has no letter, or a model without languages, gives ``und`` and score 0.
    Repeated rows each get their row; an empty table gives an empty result; further columns of ``docs``
    are ignored whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(trees)
        for pdf in batches:
            words, rows = [words_of(t) for t in pdf["text"]], []
            for own, bits in zip(words, scorer(words), strict=True):
                if not trees.languages or not own:
                    rows.append((UNKNOWN, 0.0, 0.0))
                    continue
                best = int(bits.argmin())
                gap = (bits - bits[best]) * min(1.0, 50 / max(bits[best], 1.0))
                rows.append((trees.languages[best], float(1 / np.exp2(-gap).sum()), float(bits[best])))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "bits"]).assign(doc_id=pdf["doc_id"].to_numpy())[["doc_id", "lang_pred", "score", "bits"]]

    narrow = docs.select(id_text(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return with_ids(narrow.mapInPandas(run, "doc_id string, lang_pred string, score double, bits double"))
