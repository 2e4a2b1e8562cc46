"""The corpus pipeline: from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All stages but the last return the columns of
documents.

1. language: documents without letters, or far from every language, go.
2. exact_dedup: of equal texts the one with the largest doc_id stays.
3. near_dedup: of texts linked by a Jaccard similarity of 0.8 or more of their five-word
   shingles the one with the smallest doc_id stays. Texts with a rare shingle in common are compared by SimHash,
   and what passes on the whole sets.
4. substring_dedup: words in a window of 20 that also starts earlier are taken out; no
   document goes, some lose all their words.
5. packing: token pieces with the sequence and offset at which each is placed.

Edge cases are those of the operators; empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenor.llm import exact_dedup, langid, near_dedup, packing, substring_dedup
from provenor.llm.common import documents, materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, F.lit(True))
    names = [max(docs.columns, key=len) + x for x in ("_lang", "_score", "_rejected")]
    found = langid.identify(docs, model, carry=[F.col(f"`{c}`") for c in docs.columns], names=tuple(names))
    return found.where(~F.col(f"`{names[2]}`")).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs, words=5, least=0.8)


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.rewritten(docs, window=20).withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("bigint"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("substring_dedup", substring), ("packing", pack)]

#: Language centroids, XXH64 and tokenisation are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
