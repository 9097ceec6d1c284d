"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, its expected copies, as near to its base rate as the sources' token targets let
them be: the sum of ``rate * log(rate / base) - rate + base`` over all documents is least, subject to
``sum(size * rate) = target`` for each source and ``rate <= cap``.  The dual of that is convex and has one
multiplier for each source; its solution tilts the base rates exponentially,

    rate = min(cap, base * exp(multiplier * size)),

so that a source that is to shrink gives up long documents before short ones.  Newton's iterations on the dual
are Spark aggregations over the documents, which ``(source, base, size)`` groups compress without loss.  Rates
become whole copies by a draw that is fixed for each document, and a source's total is then brought to its
target by moving the documents that came nearest to another copy.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import BROADCAST_ROWS, WORD_PATTERN, discard, stored, with_rank

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Newton's iterations at most, the gap that ends them, and the largest multiplier either way, a word.
MOST_ROUNDS, TOLERANCE, REACH = 80, 1e-9, 40.0
#: Steps of the order in which a source's documents move by a copy, and single documents moved after that.
BINS, REPAIRS = 1 << 16, 8


def words_in(text: str = "text") -> Column:
    """Words of a text; 0 if it is null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def _ranked_sources(sources: DataFrame) -> DataFrame:
    """With ``rank`` from 0 by ascending source, null last; sources are distinct."""
    return with_rank(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"]).drop("_null")


def targets_by_weight(sources: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source, source_size, target`` of a table ``source, source_size`` with one row for each source.

    Weights repeat over the sources in ascending order.  A target stops at ``cap`` times the source's
    size, and what it leaves is shared again among the others by weight until none is above.  ``share``
    is held to ``cap``, beyond which no mix exists.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighed = stored(_ranked_sources(sources).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(cap)).alias("most")), "weighed")
    total = float(weighed.agg(F.sum("source_size")).first()[0] or 0) * min(share, cap)
    level, full = 0.0, -1
    while True:  # every round fills more sources, up to the level that all others share
        at_cap = F.col("most") <= F.lit(level) * F.col("weight")
        row = weighed.agg(F.count(F.when(at_cap, 1)), F.coalesce(F.sum(F.when(at_cap, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~at_cap, F.col("weight"))), F.lit(0.0))).first()
        if row[0] == full:
            break
        full = row[0]
        if row[2] <= 0:
            break
        level = (total - row[1]) / row[2]
    return weighed.select("source", "source_size", F.least("most", F.lit(level) * F.col("weight")).alias("target"))


def _join(left: DataFrame, right: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """Join on ``source``, where null equals null; ``right`` has a row for each source."""
    right = right.withColumnRenamed("source", "_source")
    return left.join(F.broadcast(right) if small else right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _exact(value: Column) -> Column:
    """A sum of decimals, which no order of rows changes, as a double."""
    return F.coalesce(F.sum(value.cast("decimal(38,9)")).cast("double"), F.lit(0.0))


def _tilted(size: Column, base: Column, multiplier: Column) -> Column:
    """``base * exp(multiplier * size)``, the exponent held to what a double can say."""
    return base * F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), multiplier * size)))


def _multipliers(groups: DataFrame, targets: DataFrame, cap: float, small: bool) -> DataFrame:
    """``source, multiplier``, stored, by Newton's iterations on the dual, all sources at once.

    For each source the dual's gradient is ``sum(size * rate) - target`` and its second derivative the sum of
    ``size**2 * rate`` over the rates under the cap.  A step that leaves the interval known to hold the
    solution is replaced by its middle; a target of 0, or of all there is, lies at the edge of the interval.
    """
    start = F.when(F.col("target") <= 0, -REACH).when(F.col("target") >= F.col("source_size") * cap * (1 - 1e-12), REACH).otherwise(0.0)
    now = stored(targets.select("source", "target", start.alias("multiplier"), F.lit(-REACH).alias("low"), F.lit(REACH).alias("high")), "newton")
    here, tokens = F.col("multiplier"), F.col("size") * F.col("n")
    rate = _tilted(F.col("size"), F.col("base"), here)
    for _ in range(MOST_ROUNDS):
        sums = _join(groups, now, small).groupBy("source", "target", "multiplier", "low", "high").agg(
            _exact(tokens * F.least(rate, F.lit(float(cap)))).alias("taken"),
            _exact(F.when(rate < cap, F.col("size") * tokens * rate).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("target") - F.col("taken")
        sums = sums.withColumn("low", F.when(gap > 0, here).otherwise(F.col("low"))).withColumn("high", F.when(gap < 0, here).otherwise(F.col("high")))
        newton = F.when(F.col("slope") > 0, here + gap / F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        done = (F.abs(gap) <= F.lit(TOLERANCE) * F.col("target") + 1e-6) | (F.abs(here) >= REACH) | (F.col("high") - F.col("low") <= 1e-15)
        following = F.when(done, here).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        last, now = now, stored(sums.select("source", "target", following.alias("multiplier"), "low", "high", done.alias("done")), "newton")
        discard(last)
        if now.where("not done").isEmpty():
            break
    return now


def _placed(docs: DataFrame, solved: DataFrame, cap: float, small: bool) -> DataFrame:
    """``docs`` (``doc_id, source, size, base, key``) with what is solved for their source, and before any move
    their ``rate``, ``whole`` copies, and ``turn``: how soon they move by a copy if their source is off its target."""
    joined = _join(docs, solved, small)
    rate = F.least(F.lit(float(cap)), _tilted(F.col("size"), F.col("base"), F.col("multiplier")))
    row = F.xxhash64("source", F.col("doc_id").isNull(), "doc_id", "size", "key")
    joined = joined.withColumns({"rate": rate, "row": row})
    spot = F.col("rate") + F.shiftrightunsigned(F.xxhash64("row", F.lit(29)), 12).cast("double") / F.lit(float(1 << 52))
    joined = joined.withColumn("spot", spot).withColumn("whole", F.least(F.lit(math.floor(cap)), F.floor("spot")).cast("long"))
    step = F.least(F.lit(BINS - 1), F.floor((F.col("spot") - F.floor("spot")) * BINS)).cast("int")
    able = (F.col("size") > 0) & F.when(F.col("short"), F.col("whole") < math.floor(cap)).otherwise(F.col("whole") > 0)
    return joined.withColumn("turn", F.when(able, F.when(F.col("short"), F.lit(BINS - 1) - step).otherwise(step))).drop("spot")


def _copies() -> Column:
    moves = (F.col("turn") < F.col("turns")) | F.array_contains("extra", F.col("row"))
    return F.col("whole") + F.when(F.coalesce(moves & F.col("turn").isNotNull(), F.lit(False)), F.when(F.col("short"), 1).otherwise(-1)).otherwise(0)


def solve(docs: DataFrame, targets: DataFrame, *, cap: float = CAP) -> DataFrame:
    """What settles the copies of every document, a row for each source, stored:
    ``source, source_size, target, multiplier, short, turns, extra, owed``.

    ``docs`` has the columns of ``narrow_columns``, ``targets`` as ``targets_by_weight`` does.  Rounding misses a target
    by chance: ``short`` says which way.  The first ``turns`` of ``BINS`` steps move by one copy, as many as do
    not overshoot; then ``extra`` documents do, by their hashes, each the largest that still fits; ``owed`` words are missing, or too many, in the end.
    """
    small = targets.count() <= BROADCAST_ROWS
    groups = stored(docs.groupBy("source", "base", "size").agg(F.count(F.lit(1)).alias("n")), "mix-groups")
    multipliers = _multipliers(groups, targets, cap, small)
    nothing = [F.lit(True).alias("short"), F.lit(0).alias("turns"), F.array().cast("array<bigint>").alias("extra")]
    known = _join(targets, multipliers.select("source", "multiplier"), small).select("source", "source_size", "target", "multiplier", *nothing)
    totals = _placed(docs, known, cap, small).groupBy("source").agg(F.sum(F.col("whole") * F.col("size")).alias("whole"))
    gap = F.round(F.col("target") - F.col("whole")).cast("long")
    known = _join(known, totals, small).withColumns({"short": gap > 0, "owed": F.abs(gap)}).drop("whole")
    known = stored(known, "mix-gaps")
    discard(groups, multipliers)

    bins = _placed(docs, known, cap, small).where("turn is not null and owed > 0").groupBy("source", "turn", "owed").agg(F.sum("size").alias("size"))
    run = F.sum("size").over(Window.partitionBy("source").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0))  # BINS rows at most
    turned = bins.withColumn("run", run).where("run <= owed").groupBy("source").agg((F.max("turn") + 1).alias("_turns"), F.max("run").alias("_paid"))
    found = _join(known, turned, small, "left")
    found = found.withColumns({"turns": F.coalesce("_turns", "turns"), "owed": F.col("owed") - F.coalesce("_paid", F.lit(0))}).drop("_turns", "_paid")
    found = stored(found, "mix-turns")
    discard(known)

    for _ in range(REPAIRS):
        free = _placed(docs, found, cap, small).where("turn >= turns and size <= owed and not array_contains(extra, row)")
        # Rows that share a hash move together, so they have to fit together.
        best = free.groupBy("source", "row", "owed").agg(F.sum("size").alias("size")).where("size <= owed")
        best = stored(best.groupBy("source").agg(F.max(F.struct("size", "row")).alias("_best")), "mix-best")
        if best.isEmpty():
            discard(best)
            break
        more = _join(found, best, small, "left")
        more = more.withColumns({"owed": F.col("owed") - F.coalesce("_best.size", F.lit(0)), "extra": F.array_compact(F.array_append("extra", F.col("_best.row")))}).drop("_best")
        last, found = found, stored(more, "mix-repairs")
        discard(last, best)
    return found


def narrow_columns(*, doc_id: str = "doc_id", source: str = "source", size: str | Column | None = None, base: str | Column | None = None, key: str | Column | None = None) -> list[Column]:
    """``doc_id, source, size, base, key`` of a table: all that decides a document's copies.

    ``size`` defaults to the words of ``text``, ``base`` (a rate before balancing) to 1; ``key`` tells apart
    rows that agree in id, source and size.
    """
    named = lambda c, default: default if c is None else F.col(c) if isinstance(c, str) else c
    return [
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        named(size, words_in()).cast("long").alias("size"),
        named(base, F.lit(1.0)).cast("double").alias("base"),
        named(key, F.lit(0)).cast("long").alias("key"),
    ]


def mix(docs: DataFrame, targets: DataFrame, *, cap: float = CAP, **columns) -> DataFrame:
    """``doc_id, size, source_size, target, rate, copies, taken`` for every row of ``docs``.

    ``targets`` is as ``targets_by_weight`` gives it, ``columns`` as ``narrow_columns`` takes them.  ``copies`` is at
    most ``cap``; ``taken`` is copies times size.

    Documents without words take part with size 0, which no target limits: they keep their base rate.  Rows
    that agree in id, source, size and key get the same copies.  A null source is a source of its own, the
    last.  Null ids are ids like others.  An empty table gives an empty result; further columns of ``docs``
    are ignored whatever their names.  Reruns agree: sums that decide are exact, draws are hashes.
    """
    rows = stored(docs.select(*narrow_columns(**columns)), "mix-rows")
    solved = solve(rows, targets, cap=cap)
    found = _placed(rows, solved, cap, solved.count() <= BROADCAST_ROWS).withColumn("copies", _copies())
    return found.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def source_sizes(docs: DataFrame, *, source: str = "source", size: Column | None = None) -> DataFrame:
    """``source, source_size`` over all documents."""
    sized = docs.select(F.col(source).cast("string").alias("source"), (words_in() if size is None else size).alias("size"))
    return stored(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")


def repeated(docs: DataFrame, solved: DataFrame, *, cap: float = CAP, **columns) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as ``solved`` gives it copies; see ``mix``.

    The copies follow from the row and its source's part of ``solved``, so whole texts are not shuffled as
    long as that is small enough to be broadcast.  Columns of ``docs`` may have any names.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *narrow_columns(**columns))
    found = _placed(rows, solved, cap, solved.count() <= BROADCAST_ROWS).select("_doc", _copies().alias("copies")).where("copies > 0")
    return found.select("_doc", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("_doc.*")
