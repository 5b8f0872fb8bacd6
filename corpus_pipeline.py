"""A training-data pipeline: every stage is one of the operators of legnet.llm.

STAGES are applied in order, each written as Parquet and read again. All but the last
return the columns of documents; the last returns the token ids of what is left.

Rows without an id pass the filtering stages, as no verdict can be joined to them; a
missing text fails the quality rules; an empty table goes through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legnet.llm import bpe, mixing, ngram_join, pii, quality
from legnet.llm.batches import read_table, tune
from legnet.llm.streams import without_ids
from legnet.plans.store import cut

#: Near duplicates share eight tenths of their five-word shingles.
SHINGLE, SIMILARITY = 5, (4, 5)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and stand near their language's histograms."""
    tune(spark)
    return quality.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    tune(spark)
    like = ngram_join.Similarity(*SIMILARITY)
    groups = ngram_join.join(docs, size=SHINGLE, like=like)
    return without_ids(docs, "doc_id", groups.where("component_id <> doc_id").select("doc_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows."""
    tune(spark)
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target weights."""
    tune(spark)
    return mixing.sample(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, token ids, their number, and the digest of the decoded text."""
    tune(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    # Written between the two, as a task with both would hold two Python workers.
    ids = cut(bpe.encode(docs, path, keep=["doc_id", "source", "lang"]))
    text = bpe.decode(ids, path)
    return text.select(
        "doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Byte-pair merges and near-duplicate groups have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
