"""A training-data pipeline over `documents`: language, near copies, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows the stage before kept. All but the last return the columns of
`documents`. run() writes each stage's rows as Parquet below the shared folder and reads them again as the next one's docs.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from loomgraph.llm import langid, mixing, packing, shared, simhash, suffixdedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this share of agreement with the best profile a text is taken for no language at all.
LEAST_SCORE = 0.1
#: Near-duplicate stage: texts whose shingles of so many words are this similar are near copies.
WORDS, SIMILARITY = 5, 0.8


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without letters or unlike every profile go.

    Profiles are learned from the rows with a language that aren't in the held-out fold. Rows with a null text go.
    """
    profiles = langid.learn_profiles(docs.where(~langid.held_out(F.col("doc_id"))))
    found = docs.withColumn("_found", langid.predicted(profiles, F.col("text")))
    return found.where((F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies: that of the group's smallest id. Different texts under one id are told apart; of rows alike in
    id and text the one whose language, source and size are smallest stays. Rows with a null id are kept."""
    return simhash.one_of_each(docs.select(*COLUMNS), WORDS, SIMILARITY)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones hold; documents of which nothing but white space is left go."""
    cut = suffixdedup.remove_repeats(docs, carry=("lang", "source"), with_text=True)
    left = cut.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("kept_text").cast("long"))
    return left.where(F.regexp_like("text", F.lit(shared.WORD_PATTERN))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: none, one or two rows each. Rows of one id go as often as the most taken of them."""
    copies = mixing.mix_sources(docs).groupBy("doc_id").agg(F.max("copies").alias("copies")).where("copies > 0")
    keyed = docs.join(copies, docs.doc_id.eqNullSafe(copies.doc_id)).drop(copies.doc_id)
    return keyed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix, placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def _bounded(stage):
    """The stage with batches of texts that its Python workers hold bounded in bytes."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language", _bounded(language)),
    ("near_duplicates", _bounded(near_duplicates)),
    ("repeated_passages", _bounded(repeated_passages)),
    ("mixture", _bounded(mixture)),
    ("sequences", _bounded(sequences)),
]

#: SQL can't express the stages on fingerprints, suffix order and tokens; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
