"""A corpus from raw documents to training shards, stage by stage.

Every stage takes a table with the columns of documents, and any others, whose names don't matter: but for the
last, each returns the columns it got. An empty table stays empty. Null and empty texts, repeated rows, null
ids and sources, and texts of any length have a defined place in each stage, stated there.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.storage import shared_folder
from lodestrand.llm import decontaminate, mixing, sharding, simhash, toxicity
from lodestrand.llm.common import table
from lodestrand.llm.queries import fold


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from labels outside the held-out fold, doesn't reject.

    Null and empty texts are never rejected, repeated rows are judged alike and null ids have no label.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=fold() != 0))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least id, ties by hash of the text.

    Null and empty texts are copies of one another; rows with null ids stay only where no row of their group has an id.
    """
    return simhash.survivors(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate. Null and empty texts, having no words, stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the curriculum draws, in training order. Texts without words are never drawn; null sources are one source."""
    return mixing.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, its depth, and ``place``, which orders rows as the stage before wrote them.

    Files are written in the order of their partitions, so file and row number are the training order; each
    shard is sorted by it. place is null where docs aren't read from files.
    """
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("bigint")
    place = F.shiftleft(part, 40) + F.col("_metadata.row_index")
    try:
        docs.select(place)
    except AnalysisException:
        place = F.lit(None).cast("bigint")
    return sharding.sharded(docs, place=place)


STAGES = [("toxicity", without_toxic), ("near duplicates", without_copies), ("decontamination", without_benchmark), ("mixing", mixed), ("sharding", sharded)]

#: SQL can't express the toxicity model or the fingerprints; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages, each written as Parquet in the shared folder and read again for the next."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
