"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
import weakref
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What counts as a word everywhere: runs of anything but the six ASCII blanks.  ``bytes.split()``
#: separates on exactly these, and ``bytes.lower()`` touches A-Z only.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: Rows and bytes of one Arrow batch.  Whole texts travel in these batches, and a worker holds several copies.
ARROW_ROWS, ARROW_BYTES = 1000, "8m"
#: Rows that a task reads of a file at once.  A column of texts is one array then, which is doubled until it holds them.
READ_ROWS = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of this session, and what it reads of files at once, small enough for very long texts."""
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the one the cluster names in ``spark.checkpoint.dir``.

    Only where none is set and the session runs on this machine alone, as in tests, is a folder of this
    machine used, and the session is told about it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: Folders of the tables that ``stored`` wrote, for ``discard``.
_folders: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: whatever is read later survives the loss of any executor, and nothing
    upstream runs twice.  Tables that no result reads any more are to be given to ``discard``.
    """
    path = new_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[found] = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete the folders of stored tables; whatever was made of them has to be stored by now."""
    for table in tables:
        if (path := _folders.pop(table, None)) is not None:
            context = table.sparkSession.sparkContext
            folder = context._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def id_remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def id_text(doc_id: str) -> Column:
    """An integer id as text, for the way through pandas, where a null beside them turns integers into
    doubles; ``with_ids`` makes it an integer again."""
    return F.col(doc_id).cast("long").cast("string")


def with_ids(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return found.withColumn(doc_id, F.col(doc_id).cast("long"))


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def parts_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, -(-rows // max(each, 1)))


#: Rows of a table that may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 20_000


def small_table(table: DataFrame) -> DataFrame:
    """A stored table, marked for broadcast if it has few rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


#: Keys of rows that may be broadcast: two numbers each, 16 MB in all.
BROADCAST_KEYS = 1_000_000


def small_keys(keys: DataFrame) -> DataFrame:
    """A stored table of one or two numbers a row, marked for broadcast if it is small enough to be."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def thinned(rows: DataFrame, by: list[str], key: str | list[str], each: int) -> DataFrame:
    """A sample of ``each`` rows for every value of ``by``, all of them if there are no more: those of the
    smallest hashes of the columns ``key``, and so the same in every run.  Rows that agree in ``key`` count as one.

    It is for fitting models on labelled rows only.  A first cut by hash leaves about twice as many rows as
    are wanted, so what is ranked is bounded however frequent a value is.  Null equals null in ``by``.
    """
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    hashed = rows.withColumn("_hash", F.xxhash64(*([key] if isinstance(key, str) else key), F.lit(23)))
    distinct = hashed.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_hash").distinct()
    sizes = small_table(stored(distinct.groupBy(*[f"_by_{c}" for c in by]).agg(F.count(F.lit(1)).alias("_n")), "label-sizes"))
    top = F.lit(2.0**63) * (F.least(F.lit(1.0), F.lit(2.0 * each + 50) / F.col("_n")) * 2 - 1)
    some = hashed.join(sizes, reduce(Column.__and__, map(same, by))).where((F.col("_n") <= each) | (F.col("_hash") <= top))
    once = some.dropDuplicates([*by, "_hash"])
    ranked = once.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy("_hash")))
    return ranked.where(F.col("_rank") <= each).select(*rows.columns)


def with_rank(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, stored, with ``rank`` from 0 over all of them in the order of ``order``, nulls first.

    Ranks are given within ranges of values and offset by the sizes of the ranges before, so no task sees
    all rows, and they do not depend on how many ranges there are; only rows that agree in all of
    ``order`` may swap theirs.
    """
    spread = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    offsets = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_offset", F.coalesce(before, F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = spread.withColumn("_within", within).join(offsets, "_part")
    out = stored(placed.withColumn("rank", F.col("_offset") + F.col("_within") - 1).drop("_part", "_within", "_offset"), "ranked")
    discard(spread)
    return out


def overlapping_blocks(ranked: DataFrame, size: int, overlap: int) -> DataFrame:
    """``ranked`` rows in blocks of ``size`` consecutive ranks, each with the ``overlap`` rows before and after it.

    ``block`` is the block's number and ``own`` tells its rows from those that only accompany it.
    """
    if overlap > size:
        raise ValueError("an overlap reaches one block at most")
    here, at = F.floor(F.col("rank") / size).cast("long"), F.pmod(F.col("rank"), F.lit(size))
    numbers = F.array_compact(F.array(here, F.when((at < overlap) & (here > 0), here - 1), F.when(at >= size - overlap, here + 1)))
    return ranked.withColumn("block", F.explode(numbers)).withColumn("own", F.col("block") == here)
