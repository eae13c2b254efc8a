"""A training corpus from documents: language, quality, near duplicates, source mix, tokens.

Nulls: a document with a null text, or one without a letter, goes with the language stage; a null lang, source or doc_id is kept
and treated as a value of its own. Repeated rows are near copies of each other, and one of them stays. Ties between rows of a class go to the
least doc_id, then to a hash of the row. Very long texts are read whole in every stage. An empty table stays empty. Other columns, clashing names
among them, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import base, chosen_path, langid, mixture, pair_index_bpe, quality
from keystrata.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with confidence; all go where there is no labelled row to learn from."""
    found = langid.predict(docs, langid.learn(docs), keep=True)
    return found.filter(~F.col("rejected")).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the risk-controlled rules keep; without labels the base rule alone decides."""
    cutoffs = quality.learn(docs, base.read(spark, sf_dir, "labels"))
    return quality.judge(docs, cutoffs, keep=True).filter("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without words cannot arrive here."""
    return chosen_path.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them: up to three copies, the last one cut after a word."""
    return mixture.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, by digest, and the digest of what they decode to."""
    return pair_index_bpe.encode_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("quality_rules", rules),
    ("near_duplicates", near_copies),
    ("source_mix", source_mix),
    ("bpe", tokens),
]

#: Hashing, learned models and exact set joins have no DuckDB form here; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all that its predecessor kept, written as Parquet to the shared folder in between."""
    docs = base.read(spark, sf_dir, "documents")
    base.cut(spark.range(1))  # sets the shared folder where the session has none
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    name = uuid.uuid4().hex
    for k, (step, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{name}-{k}-{step}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if k:  # the next output stands, so that nothing reads the one before any more
            old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}-{k - 1}-{STAGES[k - 1][0]}")
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    return STAGES[-1][1](spark, docs, sf_dir)
