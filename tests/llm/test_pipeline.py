"""Stages of the pipeline that are more than one operator's call."""

from collections import Counter

import corpus_pipeline


def test_near_duplicates_go_by_simhash_and_then_by_shingles(spark):
    repeated = "word " * 60
    own = [f"own{k}" for k in range(40)]
    texts = [
        repeated + "one two three four five six",  # one fingerprint, though few of the distinct shingles are shared
        repeated + "seven eight nine ten eleven twelve",
        " ".join(own),  # four fifths of the shingles are shared, though the fingerprints are apart
        " ".join([*own[:-1], "other"]),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = lambda df: sorted(r["doc_id"] for r in df.collect())
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert ids(left) == [0, 2, 3]
    assert ids(corpus_pipeline.drop_shared_shingles(spark, left, "")) == [0, 2]


def test_texts_are_read_few_at_once(spark):
    spark.conf.unset("spark.sql.parquet.columnarReaderBatchSize")  # 4,096 by default
    docs = spark.createDataFrame([(0, "some text")], "doc_id long, text string")
    assert corpus_pipeline.drop_shared_shingles(spark, docs, "").count() == 1
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 512


def test_encoders_are_forgotten(monkeypatch):
    from corpus_pipeline import token_output, tokenizer_path

    monkeypatch.setattr(token_output, "_encoders", {})
    ids = token_output.encoder(tokenizer_path())(["some text"])[0].tolist()
    token_output.forget_encoders()
    assert not token_output._encoders
    assert token_output.encoder(tokenizer_path())(["some text"])[0].tolist() == ids


def test_third_stage_drops_benchmark_passages(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(0, f"something before {item} and after"), (1, "a text of its own"), (None, item), (2, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[2][1](spark, docs, sf_dir).collect()} == {1, 2}


def test_second_stage_drops_both_kinds_of_near_duplicates(spark, sf_dir):
    repeated, own = "word " * 60, [f"own{k}" for k in range(40)]
    rows = [
        (0, repeated + "one two three four five six"),
        (1, repeated + "seven eight nine ten eleven twelve"),  # goes by SimHash
        (2, " ".join(own)),
        (3, " ".join([*own[:-1], "other"])),  # goes by shingles
        (3, "other words under an id that repeats"),
        (4, "a row that is there twice"),
        (4, "a row that is there twice"),
        (5, None),
        (6, ""),
        (None, " ".join(own)),
        (None, "without an id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
    assert Counter(map(tuple, left.collect())) == Counter(rows[k] for k in (0, 2, 4, 5, 7, 10))
