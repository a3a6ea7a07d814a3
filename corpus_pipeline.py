"""A pipeline from documents to token ids, built of the corpus operators.

Each stage works on all that its predecessor kept and, but for the last, returns the
columns of documents. ``run`` chains the stages through Parquet tables in the session's
checkpoint folder, which all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from deltarule.llm import bpe, language_id, mixing, simhash, substring_dedup
from deltarule.llm.common import with_checkpoints


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets lang to the predicted language; documents without any letter (und) go."""
    model = language_id.train(docs)
    return language_id.relabel(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return simhash.representatives(docs, width=5)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages of 50 words that an earlier document has; documents left without a word go."""
    return substring_dedup.cut(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and cuts documents so that sources have their target shares of words."""
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of tokens, ids, the byte at which each token begins, and whether the ids decode to the text again."""
    return bpe.encode(docs, bpe.default_ranks())


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("byte_bpe", tokenize),
]

#: Language models, fingerprints and tokens are beyond SQL; a brute-force version is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; what each returns is written and read again."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}_{name}")
        docs = spark.read.parquet(f"{folder}/{k}_{name}")
    return docs
