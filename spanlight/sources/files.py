"""Scans and sinks: JSON lines, gated and strict, CSV, keyed caches and resumable logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

HEARING = (
    "id bigint, materia string, metadados struct<assunto: string, envolvidos: array<struct<nome: string, cargo: string, opinioes: array<string>>>>, transcricao string"
)
EVIDENCE = (
    "id string, hearing_id bigint, actor struct<name: string, role: string>, proposition string, "
    "evidence struct<text: string, support_type: string, score: double, quote_prefix: string, start_char: bigint, end_char: bigint, speaker_turn: bigint>, "
    "tier string, provenance string, method struct<encoder: string, revision: string, embedding_threshold: double>"
)
ACTOR = (
    "actor string, has_party_header boolean, party_uf array<string>, "
    "hearings array<struct<hearing_id: bigint, full_speech: string, turns: array<struct<turn_index: bigint, role: string, start_char: bigint, end_char: bigint, text: string>>>>"
)
LINK = "udv_id string, hearing_id bigint, actor_key string, actor string, matched_turns bigint, linked_turns bigint"


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Strict scan: a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def sha256_of(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of every file of a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_gated_jsonl(spark: SparkSession, path: str, schema: str | StructType, expected: str) -> DataFrame:
    """A strict scan that is refused unless the path's only file has this sha256."""
    found = [r.sha256 for r in sha256_of(spark, path).limit(2).collect()]
    if found != [expected]:
        raise ValueError(f"{path}: sha256 is {found}, expected {expected}")
    return read_jsonl(spark, path, schema)


def read_permissive(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows): bad ones with their line and what is wrong with it."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = parsed.filter("r._bad is null").select("r.*").drop("_bad")
    bad = parsed.filter("r._bad is not null").select(F.col("value").alias("line"), F.get_json_object("value", "$.id").alias("id"), F.lit("not a record of this schema").alias("reason"))
    return good, bad


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, keys in column order, nulls kept; refuses to overwrite."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def write_review_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("header", True).option("sep", ";").option("quoteAll", True).option("escape", '"').csv(path)


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV whose separator is the most frequent of ; , and tab in its first line; a byte order mark is dropped."""
    first = spark.read.text(path).first()
    line = first.value if first else ""
    sep = max(";,\t", key=line.count)
    rows = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).csv(path)
    return rows.toDF(*(c.lstrip("﻿").strip('"') for c in rows.columns))


def json_value(column: str, path: str):
    """A nested value by $.path as text, null if absent."""
    return F.get_json_object(F.col(column), path)


def required(column: str, what: str):
    return F.coalesce(F.col(column), F.raise_error(F.lit(f"{what}: {column} is missing")))


class KeyedStore:
    """A parquet table of values by key: misses are found by an anti join, new keys appended, the first value of a key stays."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path, schema, key

    def read(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def misses(self, keys: DataFrame) -> DataFrame:
        return keys.select(self.key).distinct().join(self.read(), self.key, "left_anti")

    def add(self, rows: DataFrame) -> None:
        new = rows.dropDuplicates([self.key]).join(self.read().select(self.key), self.key, "left_anti")
        new.write.mode("append").parquet(self.path)


def pending_jobs(jobs: DataFrame, log: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """Jobs whose key and fingerprint the log doesn't hold."""
    return jobs.join(log.select(key, fingerprint), [key, fingerprint], "left_anti")


def export_documents(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, json): the rows of each key as one JSON document, in order."""
    return rows.groupBy(key).agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *(c for c in rows.columns if c not in (key, order)))))).alias("json"))
