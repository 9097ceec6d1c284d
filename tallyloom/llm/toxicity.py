"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length.

The lexicon is learned: word beginnings and whole words that labelled toxic texts use far more than clean ones,
weighted by their log odds, where a text that uses one often counts for more.  Phrases around a term that clean texts repeat and toxic texts lack
become exceptions, which cancel the matches inside them.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import bounded_batches, discard, id_text, stored, text_or_empty, thinned, with_ids
from tallyloom.llm.folding import folded

#: Labelled rows of each label that the lexicon is learned from, at most.
SAMPLE_ROWS = 6000
SHORTEST, LONGEST = 3, 8
LEAST_TEXTS, LEAST_LOG_ODDS = 4, 2.5
#: Share of the toxic texts, and log odds, that make a term common.
COMMON, COMMON_LOG_ODDS = 0.01, 5.0
#: Texts that must hold a phrase before it becomes an exception.
EXCEPTION_TEXTS = 3
THRESHOLD = 0.3
#: Terms that a task counts before it hands them on.
HELD_TERMS = 100_000
LOGS = [math.log1p(n) for n in range(64)]


@dataclass
class Lexicon:
    """Terms with their weights; a term starts with a blank, and ends with one if it is a whole word."""

    weights: dict[str, float]
    exceptions: set[str] = field(default_factory=set)
    #: Intercept and factors of the logistic over ``features``.
    calibration: tuple[float, ...] = (-4.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term, (len(term), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if not len(found):
            return None
        found.make_automaton()
        return found


def matches(text: str, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float]]:
    """Start, end and weight of every term in folded text that no exception phrase covers."""
    if automaton is None:
        return []
    found = [(end + 1 - size, end + 1, weight) for end, (size, weight) in automaton.iter(text)]
    excused = [(a, b) for a, b, weight in found if weight is None]
    terms = [x for x in found if x[2] is not None]
    return [x for x in terms if not any(a <= x[0] and x[1] <= b for a, b in excused)] if excused else terms


def features(text: str, automaton: ahocorasick.Automaton | None) -> tuple[float, float]:
    """The weight of all matches on a log scale, and the same for each hundred words."""
    weight, words = sum(x[2] for x in matches(text, automaton)), max(1, text.count(" ") - 1)
    return math.log1p(weight), math.log1p(100 * weight / words)


def score(values: np.ndarray, calibration: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(calibration[0] + values @ np.array(calibration[1:]), -40, 40)))


def _terms(text: str) -> Counter:
    """How often the words of folded text, and their beginnings, occur."""
    found: Counter = Counter()
    for w, n in Counter(text.split()).items():
        found[f" {w} "] += n
        for size in range(SHORTEST, min(LONGEST, len(w)) + 1):
            found[f" {w[:size]}"] += n
    return found


def _phrases(text: str, automaton: ahocorasick.Automaton | None) -> Counter:
    """Two words each: the one that a match begins and a neighbour."""
    found: Counter = Counter()
    for start, _, _ in matches(text, automaton):
        end = text.index(" ", start + 1)
        after, before = text.find(" ", end + 1), text.rfind(" ", 0, start)
        if after > 0:
            found[text[start : after + 1]] += 1
        if before >= 0:
            found[text[before : end + 1]] += 1
    return found


def _counted(sample: DataFrame, terms_of) -> DataFrame:
    """``term, toxic, clean, toxic_use, clean_use``: texts of either label that hold the term, and the sum over
    them of the logarithm of one more than how often."""

    def frame(texts: list[Counter], use: list[defaultdict]) -> pd.DataFrame:
        terms = list(texts[0] | texts[1])
        columns = [[f[t] if t in f else 0 for t in terms] for f in (texts[1], texts[0], use[1], use[0])]
        names = ("toxic", "clean", "toxic_use", "clean_use")
        return pd.DataFrame({"term": terms} | dict(zip(names, columns, strict=True))).astype({"term": str, "toxic": np.int64, "clean": np.int64, "toxic_use": float, "clean_use": float})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, use = [Counter(), Counter()], [defaultdict(float), defaultdict(float)]
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                for term, n in terms_of(folded(text)).items():
                    texts[label][term] += 1
                    use[label][term] += LOGS[n] if n < len(LOGS) else math.log1p(n)
                if len(texts[0]) + len(texts[1]) > HELD_TERMS:
                    yield frame(texts, use)
                    texts, use = [Counter(), Counter()], [defaultdict(float), defaultdict(float)]
        yield frame(texts, use)

    partial = sample.mapInPandas(run, "term string, toxic long, clean long, toxic_use double, clean_use double")
    # Rounded, so that no order of adding shows.
    return partial.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.round(F.sum("toxic_use"), 6).alias("toxic_use"), F.round(F.sum("clean_use"), 6).alias("clean_use"))


def _covering(candidates: dict[str, float], texts: list[list[str]]) -> dict[str, float]:
    """Terms that explain the toxic texts, by greedy cover, and then all others that are common in them.

    ``texts`` has the candidates that each toxic text holds.  A term is taken while it explains
    ``LEAST_TEXTS`` texts that no earlier one does, or if ``COMMON`` of all texts hold it, so words that
    merely come along in copies of one text are not taken.  Among equals the longest beginning wins.
    """
    holders: dict[str, set[int]] = {t: set() for t in candidates}
    for k, terms in enumerate(texts):
        for t in terms:
            holders[t].add(k)
    support = {t: len(h) for t, h in holders.items()}
    rank = {t: (t.endswith(" "), -len(t), t) for t in candidates}
    kept: dict[str, float] = {}
    left = [(-n * candidates[t], rank[t]) for t, n in support.items()]
    heapq.heapify(left)
    gone: set[int] = set()
    while left:
        gain, (_, _, term) = heapq.heappop(left)
        holders[term] -= gone
        now = -len(holders[term]) * candidates[term]
        if len(holders[term]) < LEAST_TEXTS:
            continue
        if now > gain:
            heapq.heappush(left, (now, rank[term]))  # others may explain more now
            continue
        kept[term] = candidates[term]
        gone |= holders[term]
    for term in sorted(candidates, key=lambda t: (-support[t], rank[t])):
        if support[term] < max(LEAST_TEXTS, COMMON * len(texts)):
            break
        if candidates[term] >= COMMON_LOG_ODDS and not any(term.startswith(k) or k.startswith(term.rstrip()) for k in kept):
            kept[term] = candidates[term]
    return kept


def _fitted(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression with a small ridge, by Newton's method."""
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (p - y) + 0.1 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(w.tolist())


def learn_lexicon(docs: DataFrame, labels: DataFrame, *, label: str, doc_id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Lexicon:
    """The lexicon of the texts whose row of ``labels`` says 0 or 1; other labels, and none, are left out.

    Learning takes about ``sample_rows`` rows of each label at most, chosen by a hash of the id before any
    text is read, with their whole texts, so all that is broadcast or collected is bounded by it.  Without
    toxic rows, or without clean ones, the lexicon is empty.
    """
    bounded_batches(docs.sparkSession)
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)")
    chosen = F.broadcast(stored(thinned(rows, ["label"], ["doc_id"], sample_rows), "toxic-labels"))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sample = stored(texts.join(chosen, "doc_id").select("text", "label"), "toxic-sample")
    sizes = lambda: {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sizes()
    if max(n.values(), default=0) > sample_rows:  # many texts share an id
        whole, sample = sample, stored(thinned(sample, ["label"], ["text"], sample_rows), "toxic-sample")
        discard(whole)
        n = sizes()
    if len(n) < 2:
        return Lexicon({})
    weight = F.log((F.col("toxic_use") + 0.5) / (n[1] + 1.0)) - F.log((F.col("clean_use") + 0.5) / (n[0] + 1.0))
    often = _counted(sample, _terms).where(f"toxic >= {LEAST_TEXTS}").withColumn("weight", weight).where(f"weight >= {LEAST_LOG_ODDS}")
    candidates = {r["term"]: r["weight"] for r in often.select("term", "weight").collect()}  # of the bounded sample

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"terms": [sorted(_terms(folded(t)).keys() & candidates.keys()) for t in pdf["text"]]})

    texts = sample.where("label = 1").dropDuplicates(["text"]).mapInPandas(held, "terms array<string>")
    found = Lexicon(_covering(candidates, [r["terms"] for r in texts.collect()]))

    def phrases_of(text: str, made: list = []) -> Counter:  # noqa: B006  one automaton a task
        if not made:
            made.append(found.automaton())
        return _phrases(text, made[0])

    excused = _counted(sample, phrases_of).where(f"toxic = 0 and clean >= {EXCEPTION_TEXTS}").select("term")
    found.exceptions = {r["term"] for r in excused.collect()}

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = found.automaton()
        for pdf in batches:
            x = np.array([features(folded(t), automaton) for t in pdf["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": pdf["label"]})

    points = sample.mapInPandas(measured, "a double, b double, label int").groupBy("a", "b", "label").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values(["a", "b", "label"])
    points = points.loc[points.index.repeat(points["n"])]
    discard(sample)
    found.calibration = _fitted(points[["a", "b"]].to_numpy(), points["label"].to_numpy())
    return found


def score_texts(docs: DataFrame, lexicon: Lexicon, *, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, score, predicted, n_matches`` for every row.

    ``score`` rises with the weight of the terms matched, in all and for each hundred words.  Null and
    empty texts match nothing and get the score of that.  Repeated rows each get their row; an empty
    table gives an empty result; further columns of ``docs`` are ignored whatever their names.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for pdf in batches:
            texts = [folded(t) for t in pdf["text"]]
            p = score(np.array([features(t, automaton) for t in texts]).reshape(-1, 2), lexicon.calibration)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": p, "predicted": (p >= threshold).astype(np.int32), "n_matches": [len(matches(t, automaton)) if x >= threshold else 0 for t, x in zip(texts, p, strict=True)]})

    narrow = docs.select(id_text(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    return with_ids(narrow.mapInPandas(run, "doc_id string, score double, predicted int, n_matches long"))


def without_toxic(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose score stays under ``threshold``."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            x = np.array([features(folded(t), automaton) for t in texts]).reshape(-1, 2)
            yield pd.Series(score(x, lexicon.calibration))

    bounded_batches(docs.sparkSession)
    return docs.where(toxicity(text_or_empty(text)) < threshold)
