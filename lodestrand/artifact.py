"""A thin facade: an artifact is a table of blocks."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.hashing import GENESIS, content_hash
from lodestrand.operators.sequence import previous

SCHEMA = "artifact_id string, seq bigint, block_type string, data string, vector array<double>, metadata string, content_hash string, previous_hash string"


def _hash() -> Column:
    """The content hash of a block's data, or of its vector."""
    return content_hash(F.coalesce("data", F.to_json("vector")))


@dataclass(frozen=True)
class Artifact:
    """Adding gives a new artifact; nothing is read or written before save() or an action on ``blocks``."""

    blocks: DataFrame
    artifact_id: str
    size: int = 0

    @staticmethod
    def create(spark: SparkSession, artifact_id: str) -> Artifact:
        return Artifact(spark.createDataFrame([], SCHEMA), artifact_id)

    def _add(self, block_type: str, rows: list[tuple]) -> Artifact:
        made = [(self.artifact_id, self.size + k, block_type, data, vector, metadata, None, None) for k, (data, vector, metadata) in enumerate(rows)]
        more = self.blocks.sparkSession.createDataFrame(made, SCHEMA)
        return replace(self, blocks=self.blocks.unionByName(more), size=self.size + len(made))

    def add_text(self, *texts: str, metadata: str | None = None) -> Artifact:
        return self._add("TEXT", [(t, None, metadata) for t in texts])

    def add_embeddings(self, vectors: list[list[float]], metadata: str | None = None) -> Artifact:
        return self._add("EMBEDDINGS", [(None, [float(x) for x in v], metadata) for v in vectors])

    def add_multimodal(self, parts: dict[str, str]) -> Artifact:
        return self._add("MULTIMODAL", [(content, None, f'{{"modality":"{kind}"}}') for kind, content in parts.items()])

    def texts(self) -> DataFrame:
        return self.blocks.where("block_type = 'TEXT'").select("seq", "data")

    def verify(self) -> DataFrame:
        """(artifact_id, seq, problem): blocks whose data aren't what their stored hash says, and links that aren't the hash before.

        Hashes are stored by save(); blocks added since have none, and nothing to contradict.
        """
        changed = self.blocks.where(F.col("content_hash") != _hash()).select("artifact_id", "seq", F.lit("data").alias("problem"))
        stored = self.blocks.where("content_hash IS NOT NULL").select("artifact_id", "seq", "content_hash", "previous_hash")
        cut_off = previous(stored, ["artifact_id"], ["seq"], "content_hash", "before")
        cut_off = cut_off.where(~F.col("previous_hash").eqNullSafe(F.coalesce("before", F.lit(GENESIS))))
        return changed.unionByName(cut_off.select("artifact_id", "seq", F.lit("link").alias("problem")))

    def save(self, path: str) -> None:
        """Write the blocks with their chain; hashes that blocks already have are kept, so what was changed since stays known."""
        hashed = self.blocks.withColumn("content_hash", F.coalesce("content_hash", _hash()))
        links = previous(hashed.select("artifact_id", "seq", "content_hash"), ["artifact_id"], ["seq"], "content_hash", "before")
        links = links.select("artifact_id", "seq", F.coalesce("before", F.lit(GENESIS)).alias("before"))
        rows = hashed.join(links, ["artifact_id", "seq"]).withColumn("previous_hash", F.coalesce("previous_hash", "before"))
        rows.select(*self.blocks.columns).write.mode("errorifexists").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Artifact:
        blocks = spark.read.schema(SCHEMA).parquet(path)
        first = blocks.agg(F.max("artifact_id"), F.max("seq")).first()
        return Artifact(blocks, first[0] or "", 0 if first[1] is None else first[1] + 1)


def quick_create(spark: SparkSession, path: str, artifact_id: str, *texts: str) -> Artifact:
    """An artifact of texts, written at once."""
    Artifact.create(spark, artifact_id).add_text(*texts).save(path)
    return Artifact.load(spark, path)


def quick_verify(spark: SparkSession, path: str) -> bool:
    """Whether an artifact's blocks and links are as they were written."""
    return Artifact.load(spark, path).verify().isEmpty()


def quick_read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, block_type, data, vector) of an artifact."""
    return Artifact.load(spark, path).blocks.select("seq", "block_type", "data", "vector")
