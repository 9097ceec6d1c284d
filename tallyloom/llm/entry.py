"""The queries of this subpackage, one for each operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontamination, embedding_dedup, filter_audit, hmm_lm, html_extraction, language_id, mixing, packing, simhash, substring_dedup, token_output, toxicity, whitening
from tallyloom.llm.common import id_remainder, read_table, stored


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read_table(spark, sf_dir, "pages"))


def op2_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    sized = stored(docs.select("doc_id", "source", mixing.words_in("text").alias("size")), "sizes")
    targets = stored(mixing.targets_by_weight(mixing.source_sizes(sized, size=F.col("size"))), "targets")
    return mixing.mix(sized, targets, size="size").select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 3) == 1
    trees = language_id.learn_trees(docs.where(~held_out))
    return language_id.predict(docs, trees).select("doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return token_output.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", (id_remainder("doc_id", 10) != 0).alias("train"))
    return hmm_lm.score_texts(docs, train="train")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def toxic_lexicon(spark: SparkSession, sf_dir: str) -> toxicity.Lexicon:
    labels = read_table(spark, sf_dir, "labels").where(id_remainder("doc_id", 4) != 2).select("doc_id", "toxic")
    return toxicity.learn_lexicon(read_table(spark, sf_dir, "documents"), labels, label="toxic")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_texts(read_table(spark, sf_dir, "documents"), toxic_lexicon(spark, sf_dir))
    return found.select("doc_id", (id_remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    spread = found.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return spread.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened", F.get("explained", "at").alias("explained"), "identity_error")


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_entropy_mixing": op2_entropy_mixing,
        "op3_language_id": op3_language_id,
        "op4_token_output": op4_token_output,
        "op5_decontamination": op5_decontamination,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_hmm_scoring": op7_hmm_scoring,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_toxicity": op10_toxicity,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_best_fit_packing": op12_best_fit_packing,
        "op13_filter_audit": op13_filter_audit,
    }


_REPEATS = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT r, k, s, array_to_string(w[s:s + 12], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
firsts AS (SELECT g, min(k) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT r, unnest(range(s, s + 13)) AS p FROM windows JOIN firsts USING (g) WHERE first < k),
words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)"""

_LINKS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
good AS (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= {embedding_dedup.THRESHOLD}),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT links.u, reach.c FROM reach JOIN links ON links.v = reach.vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id)::BIGINT AS n_links, min(c) AS component_id, vec_id = min(c) AS kept FROM reach GROUP BY vec_id"""


_AUDIT = r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, coalesce(doc_id, 9223372036854775807) AS k FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(k) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN k > first THEN 'E' ELSE '' END AS failed
  FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, failed),
o AS (SELECT '' AS s UNION ALL SELECT s || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(x) WHERE strpos(s, x) = 0),
steps AS (SELECT s AS filter_order, unnest(range(1, 6)) AS step FROM o WHERE len(s) = 5),
p AS (SELECT part, filter_order, step, s AS letter, n, good, toxic, failed, strpos(failed, s) > 0 AS fails,
  list_min(list_transform(range(1, len(failed) + 1), lambda i: strpos(filter_order, failed[i]))) AS goes FROM c, (SELECT *, filter_order[step] AS s FROM steps)),
a AS (SELECT part, filter_order, step, any_value(letter) AS letter, sum(CASE WHEN goes IS NULL OR goes > step THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails AND goes < step THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN goes = step THEN toxic ELSE 0 END) AS toxic_lost FROM p GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a"""


def oracle_sql() -> dict[str, str]:
    """Plain SQL for the operators whose whole result it can say."""
    return {"op8_substring_dedup": _REPEATS, "op9_embedding_near_dedup": _LINKS, "op13_filter_audit": _AUDIT}
