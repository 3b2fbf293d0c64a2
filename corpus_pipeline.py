"""The corpus pipeline: quality rules, toxicity, near-duplicates, mixing to target weights, tokens.

STAGES lists its stages; each takes (spark, docs, sf_dir) and returns a DataFrame, all but the last one with the
columns of documents. A stage works on all its predecessor kept. run() writes each stage's rows to the shared
folder and reads them again, so no stage is computed twice and lost executors cost a stage at most; what the stage
before has written is deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlight.llm import bpe, common, mixing, quality, simhash, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass; lines that a rule names are gone from their texts."""
    return quality.clean(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the field learns from the labels of two documents in three."""
    model = toxicity.fit(docs, toxicity.train_split(common.table(spark, sf_dir, "labels")))
    return toxicity.reject_toxic(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; links are similarities of 0.8 or more over five words, none is lost."""
    return simhash.deduplicate(docs)


def target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages at their target weights: rates are one or more, so no document is lost and some repeat."""
    return mixing.mix(docs, mixing.by_language(docs), mixing.TARGETS, lossless=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document, and their number."""
    coded = bpe.encode(docs, keep=("doc_id", "lang", "source"))
    return coded.withColumn("n_tokens", F.size("token_ids").cast("bigint"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("near-duplicates", near_duplicates),
    ("target weights", target_weights),
    ("tokens", tokens),
]

#: No SQL can express the trained stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = common.table(spark, sf_dir, "documents"), common.scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            common.discard(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
