"""A training corpus from raw documents, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs.  All but the last
return the columns of documents.  Null texts and ids, empty texts, repeated rows,
empty tables and extra columns pass through as the stages' operators define it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import bpe, decontaminate, exact, langid, minhash
from vectide.llm.common import table
from vectide.session import ship

#: A document whose best language has less than this posterior probability is rejected.
CERTAIN = 0.5
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in an identifiable language; those without letters (null and empty ones too) or with an uncertain language go."""
    model = langid.learn(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identified(docs, model, CERTAIN)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, with the smallest doc_id."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates (five-word shingles, similarity 0.8)."""
    return minhash.near_dedup(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item's window of ten words occurs."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens and exact (the decoded ids are the text's bytes)."""
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, exact="exact", keep=["doc_id", "lang", "source"])
    return coded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("benchmark", drop_contaminated),
    ("tokens", tokenise),
]

#: SQL has neither the language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, on the documents of sf_dir."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
