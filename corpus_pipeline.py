"""The corpus pipeline: language ID, near-duplicates, decontamination, mixing and shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, langid, mixing, ngram_join, sharding
from millrace.llm.queries import PIECES, vocabulary
from millrace.llm.store import cut, discard

#: Near-duplicates: words of a shingle and least Jaccard similarity in percent.
SHINGLE_WORDS, SIMILAR = 5, 80
#: Documents whose best language has a smaller share are rejected.
LEAST_SCORE = 0.5
N_SHARDS = 16
#: Words whose scores a worker keeps; other stages' memory comes on top.
WORD_CACHE = 150_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: ``und`` and those of ambiguous language go."""
    others = [c for c in docs.columns if c != "text"]
    told = langid.identify_language(docs, vocabulary(PIECES), carry=tuple(others), keep_text=True, cache=WORD_CACHE)
    kept = told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by 5-word shingles of Jaccard 0.8 or more: that of the smallest doc_id.

    Rows are told apart by doc_id and text; of several of the survivor's doc_id and text the least by all columns stays.
    """
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that leak no benchmark item, each judged by its own text."""
    return decontaminate.remove_leaking(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix_sources(docs, carry=tuple(docs.columns)).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row."""
    return sharding.shard_documents(docs, N_SHARDS)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mix", mix), ("shards", shards)]

#: The stages go beyond SQL; tests/llm/test_pipeline.py holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
