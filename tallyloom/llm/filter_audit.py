"""What each filter of a chain removes, in whatever order the chain applies them.

A document's part in an audit is the set of filters that it fails.  Documents are counted by source and that set
first, so everything after reads at most ``2 ** k`` rows a source.  Those rows are summed into the edges of the
lattice of applied filters, (already applied subset, next filter), 80 for five filters; an order of all filters is
a path of edges from the empty set up, so its steps are looked up by a join.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import WORD_PATTERN, discard, small_keys, stored, text_or_empty

#: The filters of a document: by its words, its repeats, its capitals, its symbols, and its earlier copies.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SYMBOLS = 50, 65, 5, "[#$%&*|]"
#: Join keys of rows without an id, so that they don't meet in one task.
SALTS = 1024


def failed_by_text(text: str) -> Column:
    """Bits of the filters A to D that a text fails; null counts as empty."""
    whole = text_or_empty(text)
    blanks = WORD_PATTERN.replace("^", "")
    words = F.array_remove(F.split(whole, blanks), "")
    n = F.size(words)
    capitals = F.length(whole) - F.length(F.regexp_replace(whole, "[A-Z]+", ""))
    failed = (
        n < LEAST_WORDS,
        100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT_PERCENT * n,
        100 * capitals.cast("long") > MOST_CAPITAL_PERCENT * F.length(whole).cast("long"),
        whole.rlike(SYMBOLS),
    )
    bits = [F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)]
    return bits[0] + bits[1] + bits[2] + bits[3]


def failure_counts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part, failed, n, good, toxic``: documents by source and by the bits of the filters they fail.

    Null sources count as the empty string, null texts as empty.  E fails where a row of smaller id has the same
    text: null ids are larger than all others, and rows of equal id are no copies of each other.  ``labels`` has
    ``doc_id, quality, toxic``; an id with several labels is good or toxic if any says so, rows without an id or a
    label are neither.  Further columns are ignored whatever their names.
    """
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(source), F.lit("")).alias("part"),
        F.unhex(F.sha2(text_or_empty(text).cast("binary"), 256)).alias("digest"),
        failed_by_text(text).alias("failed"),
    )
    rows = stored(narrow.groupBy("digest", "part", "failed", "doc_id").agg(F.count(F.lit(1)).alias("n")), "audited")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = stored(marks.agg(*[F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c) for c in ("quality", "toxic")]).where("quality or toxic"), "marks")
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(SALTS))).otherwise(F.lit(0)).cast("long")
    marked = rows.withColumn("salt", salt).join(small_keys(marks).withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    is_marked = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("quality", "toxic")]

    # Copies are counted by text before they meet: a text of many copies is a row for each source and label by then.
    # The smallest id comes with the number of its rows, which are no copies of an earlier one.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("n").alias("rows"))).alias("least")
    texts = marked.select("digest", "part", "failed", "doc_id", "n", *is_marked).groupBy("digest", "part", "failed", "quality", "toxic").agg(F.sum("n").alias("n"), least)
    texts = stored(texts, "texts")
    first = texts.groupBy("digest").agg(F.min(F.struct("least.none", "least.doc_id")).alias("first"), F.sum("n").alias("copies")).where("copies > 1")
    joined = texts.join(first, "digest", "left")
    is_first = F.col("first").isNull() | F.col("least.doc_id").eqNullSafe(F.col("first.doc_id"))
    fresh = F.when(F.col("first").isNull(), F.col("n")).when(is_first, F.col("least.rows")).otherwise(F.lit(0))
    split = F.explode(F.array(F.struct(F.col("failed").alias("failed"), fresh.alias("n")), F.struct((F.col("failed") + 16).alias("failed"), (F.col("n") - fresh).alias("n"))))
    counted = joined.select("part", "quality", "toxic", split.alias("s")).where("s.n > 0").groupBy("part", F.col("s.failed").alias("failed"))
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("s.n"))), F.lit(0))
    found = stored(counted.agg(F.sum("s.n").alias("n"), of("quality").alias("good"), of("toxic").alias("toxic")), "failures")
    discard(rows, marks, texts)
    return found


def edges(failures: DataFrame, filters: int) -> DataFrame:
    """``part, applied, bit`` and the counts of every edge of the lattice: filter ``bit`` after the set ``applied``.

    ``failures`` has a row of counts for each part and set of failed filters.  Zeros are kept.  ``shapley`` is the
    sum of what the filter removes over all orders: an edge lies on as many as its two sides have orders.
    """
    every = [(s, 1 << f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(b).alias("bit")) for s, b in every]))
    spread = failures.withColumn("edge", edge).select("part", "failed", "n", "good", "toxic", "edge.*")
    fails, before = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed").bitwiseAND(F.col("applied")) != 0
    total = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(F.lit(0)))
    summed = spread.groupBy("part", "applied", "bit").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(F.col("failed") == F.col("bit")).alias("unique_fails"),
        total(fails & ~before, "good").alias("good_lost"),
        total(fails & ~before, "toxic").alias("toxic_lost"),
    )
    on_paths = F.array(*[F.lit(factorial(k) * factorial(filters - 1 - k)).cast("long") for k in range(filters)])
    paths = F.get(on_paths, F.bit_count("applied"))
    return summed.withColumn("shapley", F.sum(F.col("removed") * paths).over(Window.partitionBy("part", "bit")))


def audit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``part, filter_order, step`` and the counts of that step, for each part and every order of the five filters.

    Counts are of documents within the part: ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its
    filter but went before), ``unique_fails`` (fail its filter alone), ``good_lost`` and ``toxic_lost`` (removed
    ones so labelled), and ``shapley``, what its filter removes summed over all orders.  See ``failure_counts`` for
    nulls and repeats; an empty table gives an empty result.
    """
    failures = failure_counts(docs, labels, doc_id=doc_id, text=text, source=source)
    steps = []
    for order in permutations(range(len(FILTERS))):
        name, applied = "".join(FILTERS[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((name, step, applied, 1 << f))
            applied |= 1 << f
    paths = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, bit int")
    found = edges(failures, len(FILTERS)).join(F.broadcast(paths), ["applied", "bit"])  # 600 rows, whatever the input
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found.select("part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in counts])
