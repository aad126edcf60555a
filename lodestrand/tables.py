"""The canonical tables of artifacts and audit trails, as views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str = "ts"):
    """A time as microseconds since 1970."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text blocks: an artifact is a source, its blocks are in order of document."""
    docs = load(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("artifact_id"), F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("block_id"), F.lit("TEXT").alias("block_type"), F.col("text").alias("data"), F.col("lang"), F.col("n_chars"))


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of blocks: an event is an operation of an agent on the block that its props name."""
    rows = load(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("agent_id"), F.col("event_type").alias("operation"), "value", F.get_json_object("props", "$.k").alias("block_id"))
    return rows.withColumn("version", F.row_number().over(Window.partitionBy("block_id").orderBy("ts", "event_id")).cast("bigint"))


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events")
    return rows.select("event_id", "ts", "event_type", F.col("user_id"), F.get_json_object("props", "$.k").alias("resource_id"), (F.col("event_type") != "error").alias("success"), F.col("value"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The same views for the SQL beside each query.
SQL_V = "v AS (SELECT event_id, ts, user_id AS agent_id, event_type AS operation, value, json_extract_string(props, '$.k') AS block_id, row_number() OVER (PARTITION BY json_extract_string(props, '$.k') ORDER BY ts, event_id) AS version FROM events)"
SQL_A = "a AS (SELECT event_id, ts, event_type, user_id, json_extract_string(props, '$.k') AS resource_id, event_type <> 'error' AS success, value FROM events)"
SQL_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS vector, label FROM embeddings)"
