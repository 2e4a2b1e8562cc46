"""The queries of the corpus operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm import bpe, exact_dedup, fingerprint, langid, lm, packing, quality, simhash, substring_dedup, toxicity
from provenor.llm.common import documents, fold, labels


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings from the labels: 0 poor, 1 good but toxic, 2 good; rows with crc32 mod 3 = 1 are held out."""
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)
    ratings = marks.select("doc_id", grade.alias("grade"))
    model = quality.fit(docs, ratings, fold(ratings["doc_id"], 3) != 1, grades=3)
    scored = quality.score(docs, model, select_from=1, least=0.5)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "expected_grade", "tail_prob", "selected")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), window=20)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = documents(spark, sf_dir), labels(spark, sf_dir)
    model = toxicity.fit(docs, marks, fold(marks["doc_id"], 3) != 1)
    scored = toxicity.score(docs, model, threshold=0.7)
    return scored.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.fit(docs, fold(docs["doc_id"], 4) != 2)
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = fingerprint.edited_pairs(documents(spark, sf_dir))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint.as_text(F.col("vector")).alias("fingerprint"),
        fingerprint.as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"),
        fingerprint.likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.exact_dedup(documents(spark, sf_dir), keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.substring("digest", 1, 64).alias("text_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(documents(spark, sf_dir), words=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = lm.score(docs, fold(docs["doc_id"], 7) != 2)
    return scored.select("doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality": op2_quality,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_fingerprint": op6_fingerprint,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_simhash": op9_simhash,
    "op10_lm_score": op10_lm_score,
}

_WORDS = "unnest(w) AS word, unnest(range(len(w))) AS i"
_WINDOW = " || ' ' || ".join(["word"] + [f"lead(word, {n}) OVER d" for n in range(1, 20)])

ORACLE_SQL = {
    "op3_substring_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        u AS (SELECT doc_id, {_WORDS} FROM t),
        s AS (SELECT doc_id, i, {_WINDOW} AS win FROM u WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
        again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM s WHERE win IS NOT NULL) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(20) r(k)),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM u ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT t.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN kept USING (doc_id)""",
    "op8_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
}
