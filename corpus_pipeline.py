"""From raw documents to token files: five stages, each over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, mixing, shingle_dedup, simhash, token_output, toxicity
from tallyloom.llm.common import discard, read_table, stored
from tallyloom.llm.entry import tokenizer_path, toxic_lexicon

#: Columns of ``documents`` that the stages read; others pass through the filters untouched.
ID, TEXT, SOURCE = "doc_id", "text", "source"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned lexicon doesn't reject."""
    return toxicity.without_toxic(docs, toxic_lexicon(spark, sf_dir), text=TEXT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of texts whose SimHash fingerprints link, as in ``op6``."""
    return simhash.keep_one(docs, doc_id=ID, text=TEXT)


def drop_shared_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of what SimHash left: the first document, by id, of each group of texts that share four fifths of their five-word shingles."""
    return shingle_dedup.keep_one(docs, doc_id=ID, text=TEXT)


def drop_both_kinds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What SimHash and then shared shingles leave.  Only keys are stored between the two, not the texts again."""
    return drop_shared_shingles(spark, drop_near_duplicates(spark, docs, sf_dir), sf_dir)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_benchmark(docs, read_table(spark, sf_dir, "benchmark"), doc_id=ID, text=TEXT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, once or twice."""
    sized = docs.select(ID, SOURCE, mixing.words_in(TEXT).alias("size"), F.xxhash64(TEXT).alias("key"))
    rows = stored(sized.select(*mixing.narrow_columns(doc_id=ID, source=SOURCE, size="size", key="key")), "sizes")
    targets = stored(mixing.targets_by_weight(mixing.source_sizes(rows, size=F.col("size"))), "targets")
    solved = mixing.solve(rows, targets)
    discard(rows, targets)
    return mixing.repeated(docs, solved, doc_id=ID, source=SOURCE, size=mixing.words_in(TEXT), key=F.xxhash64(TEXT))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the corpus, and what reading them back gives for every document."""
    manifest = token_output.write_tokens(docs, tokenizer_path(), doc_id=ID, text=TEXT)
    found = token_output.read_tokens(manifest)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


#: Toxicity, near-duplicates, decontamination, mixing, token files: the driver knows what a stage has to do by its place.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash_shingle_near_dedup", drop_both_kinds),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_token_files),
]

#: Learned lexicons, approximate alignment and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name)
        discard(last)
    return docs
