"""Hidden Markov language model over word classes, trained by Baum-Welch counts summed across partitions.

Every word belongs to a class: the most frequent training words have one each, the others share classes by
their training count, and unknown words share the class of count zero.  A state emits a class, and the
class emits the word in proportion to the smoothed unigram base::

    P(word | state) = P(class | state) * base(word) / base(class)

so the score of a text is its unigram base plus what the forward recursion over classes gains on it.
Word counts cover all training documents, and grow with them; what is broadcast does not: the model and
the table of frequent words have fixed sizes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, id_text, stored, text_or_empty, with_ids
from tallyloom.llm.wordpack import WordHashes, in_ranges, pack, split_words, unpack

STATES = 8
#: Words that have a class of their own.
FREQUENT = 2000
#: Counts up to this have a class each; larger ones share a class for each doubling.
EXACT_COUNTS = 8
COUNT_CLASSES = EXACT_COUNTS + 64
#: Characters of text that are numbered with one local vocabulary.
BLOCK_CHARS = 12_000_000
#: The E-step cuts longer documents here; scores never cut.
SEGMENT = 256
#: Baum-Welch rounds, each over all training documents.
FULL_ROUNDS = 10
SMOOTHING = 0.1
END = xxhash.xxh64_intdigest(b"")  # no word is empty


@dataclass
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # class by state


def count_class(counts: np.ndarray) -> np.ndarray:
    """Class of a word that has none of its own, by its training count."""
    doubling = EXACT_COUNTS + 1 + np.floor(np.log2(np.maximum(counts, 1) / (EXACT_COUNTS + 1))).astype(np.int64)
    return np.where(counts <= EXACT_COUNTS, counts, np.minimum(doubling, COUNT_CLASSES - 1)).astype(np.uint16)


def falls(counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether one occurrence less puts a word into the class below; words with a class of their own stay."""
    return (classes < COUNT_CLASSES) & (counts > 0) & (count_class(np.maximum(counts, 1) - 1) < classes)


def falling_classes(tokens: np.ndarray, stay: np.ndarray) -> np.ndarray:
    """Classes that tokens may fall from, given each class's tokens and those that stay if left out: all
    but those that nothing would be left in or fall into, as is the highest if its words are all at its edge."""
    may, above = np.zeros(len(tokens), bool), 0
    for k in range(len(tokens) - 1, 0, -1):
        may[k] = above + stay[k] > 0
        above = tokens[k] - stay[k] if may[k] else 0
    return may


def left_out(classes: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Classes of training tokens as they would be had their own occurrence not been counted."""
    return (classes - edge).astype(np.uint16)


# --- counting words -------------------------------------------------------------------------------------


def _numbered(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows of two kinds for blocks of documents: the block's words (by ranges of their hash, with training
    counts), and each document as numbers into the block's sorted words."""

    def block_rows(block: int, frames: list[pd.DataFrame], known: WordHashes) -> pd.DataFrame:
        pdf = pd.concat(frames, ignore_index=True)
        words, lengths = split_words(pdf["text"], lower=True)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        del words
        ends = np.cumsum(lengths)
        tokens = np.insert(hashes, ends, np.uint64(END))
        lengths = lengths + 1
        distinct, numbers = np.unique(tokens, return_inverse=True)
        train = np.repeat(pdf["train"].to_numpy(bool), lengths)
        counts = np.bincount(numbers[train], minlength=len(distinct)).astype(np.uint32)
        own, cuts = in_ranges(distinct, ranges)
        rows = [(block, r, pack(h), pack(c), None, None, None) for r, h, c in zip(own, np.split(distinct, cuts), np.split(counts, cuts), strict=True)]
        each = np.split(numbers.astype(np.uint32), np.cumsum(lengths)[:-1])
        rows += [(block, None, None, None, i, t, pack(n)) for i, t, n in zip(pdf["doc_id"], pdf["train"], each, strict=True)]
        out = pd.DataFrame(rows, columns=["block", "range", "hashes", "counts", "doc_id", "train", "numbers"])
        return out.astype({"range": "Int32", "train": "boolean"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, block, held, size = WordHashes(), TaskContext.get().partitionId() << 32, [], 0
        for pdf in batches:
            held.append(pdf)
            size += int(pdf["text"].str.len().sum())
            if size >= BLOCK_CHARS:
                yield block_rows(block, held, known)
                block, held, size = block + 1, [], 0
        if held:
            yield block_rows(block, held, known)

    return docs.mapInPandas(run, "block long, range int, hashes binary, counts binary, doc_id string, train boolean, numbers binary")


def _totals(pdf: pd.DataFrame) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of each block, all distinct hashes, and their training counts over all blocks."""
    each = [unpack(b, np.uint64) for b in pdf["hashes"]]
    distinct, numbers = np.unique(np.concatenate(each), return_inverse=True)
    counts = np.concatenate([unpack(b, np.uint32) for b in pdf["counts"]])
    return each, distinct, np.bincount(numbers, weights=counts, minlength=len(distinct)).astype(np.int64)


def _range_statistics(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one hash range: its most frequent words, and the number of words for each class of counts."""
    _, distinct, counts = _totals(pdf)
    seen = counts > 0
    distinct, counts = distinct[seen], counts[seen]
    top = np.lexsort((distinct, -counts))[:FREQUENT]
    rows = [(-1, int(h), int(c), 1, 0) for h, c in zip(distinct[top].view(np.int64), counts[top], strict=True)]
    kinds = count_class(counts)
    stays = ~falls(counts, kinds)
    for k in np.unique(kinds).tolist():
        rows.append((k, None, int(counts[kinds == k].sum()), int((kinds == k).sum()), int(counts[(kinds == k) & stays].sum())))
    kind, word, tokens, words, stay = zip(*rows, strict=True) if rows else ((), (), (), (), ())
    return pd.DataFrame({"kind": kind, "word": pd.array(word, "Int64"), "tokens": tokens, "words": words, "stay": stay})


def _looked_up(frequent: np.ndarray):
    """For every block and hash range: class and count of each of its words, in the order of the hashes."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        each, distinct, counts = _totals(pdf)
        classes = count_class(counts)
        if len(frequent):
            words = np.sort(frequent)
            rank = np.argsort(frequent, kind="stable")
            at = np.minimum(np.searchsorted(words, distinct), len(words) - 1)
            own = words[at] == distinct
            classes[own] = COUNT_CLASSES + rank[at[own]]
        rows = []
        for block, r, hashes in zip(pdf["block"], pdf["range"], each, strict=True):
            at = np.searchsorted(distinct, hashes)
            rows.append((block, r, pack(classes[at]), pack(counts[at].astype(np.uint64))))
        return pd.DataFrame(rows, columns=["block", "range", "classes", "totals"])

    return run


def _scored_base(tokens: int, words: int, log_mass: np.ndarray, may_fall: np.ndarray):
    """Per document: token counts, base score, what classes take off it, the sequence of classes, and a bit
    for each token of a training document whose class is one lower if it is left out."""
    log_total = math.log10(tokens + SMOOTHING * (words + 1))

    def run(docs: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values("range")
        classes = np.concatenate([unpack(b, np.uint16) for b in found["classes"]])
        counts = np.concatenate([unpack(b, np.uint64) for b in found["totals"]])
        base = np.log10(counts + SMOOTHING) - log_total
        gained = base - log_mass[classes]
        edge = falls(counts.astype(np.int64), classes) & may_fall[np.minimum(classes, COUNT_CLASSES - 1)]
        rows = []
        for doc_id, train, blob in zip(docs["doc_id"], docs["train"], docs["numbers"], strict=True):
            n = unpack(blob, np.uint32)
            rows.append((doc_id, not train, len(n), int((counts[n] > 0).sum()), float(base[n].sum()), float(gained[n].sum()), classes[n].tobytes(), np.packbits(edge[n]).tobytes() if train else b""))
        return pd.DataFrame(rows, columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "classes", "edge"])

    return run


# --- the model ------------------------------------------------------------------------------------------


def _by_length(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by falling length, observations by step, and how many sequences each step still has."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-lengths, kind="stable")
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    flat = np.concatenate([sequences[k] for k in order]) if len(order) else np.zeros(0, np.uint16)
    starts = np.cumsum(lengths[order]) - lengths[order]
    return order, flat[np.concatenate([starts[:n] + t for t, n in enumerate(active.tolist())])] if len(flat) else flat, active


def log10_likelihoods(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Exact log10 likelihood of every sequence, by the scaled forward recursion over all of it."""
    order, observed, active = _by_length(sequences)
    total, at = np.zeros(len(sequences)), 0
    state = np.zeros((0, len(model.start)))
    for t, n in enumerate(active.tolist()):
        state = (state[:n] @ model.moves if t else model.start) * model.emits[observed[at : at + n]]
        scale = state.sum(1)
        state /= scale[:, None]
        total[:n] += np.log10(scale)
        at += n
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected_counts(model: Model, sequences: list[np.ndarray], firsts: np.ndarray) -> np.ndarray:
    """Baum-Welch counts of starts, moves and emissions, one after the other."""
    k = len(model.start)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros_like(model.emits, dtype=np.float64)
    order, observed, active = _by_length(sequences)
    if len(active):
        first = firsts[order]
        offsets = np.r_[0, np.cumsum(active)]
        emits = model.emits.astype(np.float32)[observed]
        ahead, scales = np.empty_like(emits), np.empty(len(emits), np.float32)
        towards = model.moves.astype(np.float32)
        begin = np.where(first[:, None], model.start, 1 / k).astype(np.float32)
        for t, n in enumerate(active.tolist()):
            a, b = offsets[t], offsets[t + 1]
            now = (ahead[offsets[t - 1] : offsets[t - 1] + n] @ towards if t else begin) * emits[a:b]
            scales[a:b] = now.sum(1)
            ahead[a:b] = now / scales[a:b, None]
        back = np.ones((active[0], k), np.float32)
        for t in range(len(active) - 1, -1, -1):
            a, b, n = offsets[t], offsets[t + 1], active[t]
            weighted = emits[a:b] * back[:n] / scales[a:b, None]
            ahead_before = ahead[offsets[t - 1] : offsets[t - 1] + n] if t else None
            ahead[a:b] *= back[:n]
            if t:
                moves += ahead_before.T @ weighted
                back[:n] = weighted @ towards.T
        starts = ahead[: active[0]][first].sum(0, dtype=np.float64)
        for s in range(k):
            emissions[:, s] = np.bincount(observed, weights=ahead[:, s], minlength=len(emissions))
    return np.concatenate([starts, (moves * model.moves).ravel(), emissions.ravel()])


def _round(model: Model, sequences: DataFrame, tasks: int, prior: np.ndarray) -> Model:
    """One Baum-Welch round: counts by task, summed in two levels, then the maximisation."""
    k, groups = len(model.start), max(1, math.isqrt(tasks))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            cut, firsts = [], []
            for blob, edge in zip(pdf["classes"], pdf["edge"], strict=True):
                own = np.frombuffer(blob, np.uint16)
                own = left_out(own, np.unpackbits(np.frombuffer(edge, np.uint8), count=len(own)))
                for a in range(0, len(own), SEGMENT):
                    cut.append(own[a : a + SEGMENT])
                    firsts.append(a == 0)
            found = expected_counts(model, cut, np.array(firsts, bool))
            total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % groups], "counts": [total.tobytes()]})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("counts")  # the same order, so the same rounding, in every run
        total = sum((np.frombuffer(b) for b in pdf["counts"]), np.zeros(1))
        return pd.DataFrame({"counts": [np.asarray(total).tobytes()]})

    each = sequences.select("classes", "edge").mapInPandas(count, "part int, counts binary").groupBy("part").applyInPandas(add, "counts binary")
    parts = sorted(bytes(r[0]) for r in each.collect())  # as many as the root of the number of tasks
    total = sum((np.frombuffer(b) for b in parts), np.zeros(k + k * k + model.emits.size))
    starts, moves, emissions = total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(-1, k)
    emissions = emissions + 20 * prior[:, None]
    return Model((starts + 1) / (starts + 1).sum(), (moves + 0.1) / (moves + 0.1).sum(1, keepdims=True), emissions / emissions.sum(0))


def _first_model(prior: np.ndarray, states: int) -> Model:
    rng = np.random.default_rng(7)
    emits = prior[:, None] * rng.uniform(0.4, 1.6, (len(prior), states))
    moves = np.full((states, states), 0.08 / max(1, states - 1))
    np.fill_diagonal(moves, 0.92 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), moves, emits / emits.sum(0))


def score_texts(docs: DataFrame, *, train: str, doc_id: str = "doc_id", text: str = "text", states: int = STATES, full_rounds: int = FULL_ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are the words of the text with A-Z lower-cased, then one end.  Rows where the SQL expression
    ``train`` is true are learned from, all of them.  ``base_score`` is the smoothed unigram log10
    probability, ``score`` the model's; a text's likelihood is exact, however long it is.

    Null and empty texts are the end token alone.  Repeated rows each count.  Without any training row all
    words are unknown: the base gives each token probability one and the model stays at its start.  An
    empty table gives an empty result, and further columns of ``docs`` are ignored whatever their names.
    """
    bounded_batches(docs.sparkSession)
    narrow = docs.select(id_text(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    ranges = max(1, narrow.rdd.getNumPartitions())
    numbered = stored(_numbered(narrow, ranges), "lm-numbered")
    words = numbered.where("range is not null").select("block", "range", "hashes", "counts")

    statistics = stored(words.groupBy("range").applyInPandas(_range_statistics, "kind int, word long, tokens long, words long, stay long"), "lm-statistics")
    by_kind = {r["kind"]: (r["t"], r["w"], r["s"]) for r in statistics.where("kind >= 0").groupBy("kind").agg(F.sum("tokens").alias("t"), F.sum("words").alias("w"), F.sum("stay").alias("s")).collect()}
    n_tokens, n_words = sum(t for t, _, _ in by_kind.values()), sum(w for _, w, _ in by_kind.values())
    top = statistics.where("kind = -1").orderBy(F.desc("tokens"), "word").limit(FREQUENT).select("word", "tokens").collect()
    frequent = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    own = np.array([r["tokens"] for r in top], np.int64)

    tokens, kinds, stay = np.zeros(COUNT_CLASSES), np.zeros(COUNT_CLASSES), np.zeros(COUNT_CLASSES)
    for kind, (t, w, s) in by_kind.items():
        tokens[kind], kinds[kind], stay[kind] = t, w, s
    np.subtract.at(tokens, count_class(own), own)  # frequent words have left the classes by count
    np.subtract.at(kinds, count_class(own), 1)
    np.subtract.at(stay, count_class(own), np.where(falls(own, count_class(own)), 0, own))
    kinds[0] = 1  # the unknown word
    mass = np.concatenate([tokens + SMOOTHING * kinds, own + SMOOTHING])
    log_mass = np.log10(np.maximum(mass, 1e-300)) - math.log10(n_tokens + SMOOTHING * (n_words + 1))

    classes = words.groupBy("range").applyInPandas(_looked_up(frequent), "block long, range int, classes binary, totals binary")
    texts = numbered.where("range is null").select("block", "doc_id", "train", "numbers")
    scored = texts.groupBy("block").cogroup(classes.groupBy("block")).applyInPandas(
        _scored_base(n_tokens, n_words, log_mass, falling_classes(tokens, stay)),
        "doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, within double, classes binary, edge binary",
    )
    scored = stored(scored, "lm-classes")

    learn = scored.where("not held_out")
    prior = (mass + 1e-6) / (mass + 1e-6).sum()
    prior[0] = max(prior[0], 1e-4)
    model = _first_model(prior / prior.sum(), states)
    if not learn.isEmpty():
        tasks = learn.rdd.getNumPartitions()
        for _ in range(full_rounds):
            model = _round(model, learn, tasks, prior)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            gain = log10_likelihoods(model, [np.frombuffer(b, np.uint16) for b in pdf.pop("classes")])
            pdf["train_tokens"] = n_tokens
            pdf["score"] = gain + pdf.pop("within")
            yield pdf[["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]]

    return with_ids(scored.mapInPandas(finish, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"))
