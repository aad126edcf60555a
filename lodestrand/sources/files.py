"""Files in and out: ingest by extension, JSON-lines logs, mapped JSON, exports, SQLite tables."""

from __future__ import annotations

import sqlite3
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.storage import shared_folder

# Which extensions hold what.
KINDS = {"TEXT": ("txt", "md", "csv", "json", "xml", "html"), "IMAGE": ("png", "jpg", "jpeg", "gif", "bmp"), "AUDIO": ("mp3", "wav", "flac"), "VIDEO": ("mp4", "avi", "mov", "mkv")}


def kind_of(path: Column) -> Column:
    ending = F.lower(F.substring_index(path, ".", -1))
    out = F.lit("BINARY")
    for kind, endings in KINDS.items():
        out = F.when(ending.isin(*endings), kind).otherwise(out)
    return out


def ingest(spark: SparkSession, path: str) -> DataFrame:
    """One block for each file below a path: kind by extension, bytes, size, time of change."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", kind_of(F.col("path")).alias("block_type"), F.col("content").alias("data"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines log; lines that aren't of the schema are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def import_json(df: DataFrame, text: str = "text", vector: str = "embedding", ident: str = "id") -> DataFrame:
    """Records of a vector store as blocks: text and embedding, and an error for records without an id or text."""
    error = F.when(F.col(ident).isNull(), "no id").when(F.col(text).isNull(), "no text")
    return df.select(F.col(ident).cast("string").alias("block_id"), F.col(text).alias("data"), F.col(vector).alias("vector"), error.alias("error"))


def export(df: DataFrame, path: str, kind: str) -> None:
    """Rows as json, csv, xml, parquet or text (of one string column)."""
    writer = df.write.mode("errorifexists")
    if kind == "xml":
        writer.format("xml").option("rowTag", "block").save(path)
    else:
        getattr(writer, kind)(path)


def sqlite_table(spark: SparkSession, file: str, table: str, schema: str, batch_rows: int = 50_000) -> DataFrame:
    """A table of a SQLite file on the driver, copied to the shared folder a batch at a time."""
    empty = spark.createDataFrame([], schema)
    folder = f"{shared_folder(spark)}/sqlite-{uuid.uuid4().hex}"
    empty.write.parquet(folder)
    with sqlite3.connect(file) as db:
        quoted = ", ".join(f'"{n}"' for n in empty.columns)
        rows = db.execute(f'SELECT {quoted} FROM "{table}"')
        while batch := rows.fetchmany(batch_rows):
            spark.createDataFrame(batch, schema).write.mode("append").parquet(folder)
    return spark.read.schema(empty.schema).parquet(folder)
