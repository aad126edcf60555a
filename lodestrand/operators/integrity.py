"""Content integrity: chains, manifests, Merkle trees, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.hashing import GENESIS, content_hash
from lodestrand.functions.storage import cut
from lodestrand.operators.sequence import numbered_within, previous


def hash_chain(blocks: DataFrame) -> DataFrame:
    """(artifact_id, seq, content_hash, previous_hash): the hash of the block before in its artifact, 32 zero bytes for the first.

    Data is hashed where it is read; an artifact of any size is linked in ranges.
    """
    rows = blocks.select("artifact_id", "seq", content_hash(F.col("data")).alias("content_hash"))
    return previous(rows, ["artifact_id"], ["seq"], "content_hash", "previous_hash").fillna({"previous_hash": GENESIS})


def against_manifest(rows: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """rows (key, hash) with ``valid``: equal to what the manifest (key, expected) says; keys it doesn't have are valid."""
    return rows.join(manifest, key, "left").withColumn("valid", F.col("expected").isNull() | (F.col("expected") == F.col("hash")))


def summary(verified: DataFrame) -> DataFrame:
    """Counts, and the percentage that is valid: 100 of nothing."""
    return verified.agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("tampered"), F.round(F.coalesce(F.avg(F.col("valid").cast("int")) * 100, F.lit(100.0)), 6).alias("percent"))


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """(artifact_id, root, n_leaves) from leaves (artifact_id, seq, hash: hex).

    Level by level, pairs of neighbours become one digest, a last one alone is paired with itself; one
    leaf is its own root. Each level halves the rows, so there are log2 n shuffles of ever fewer rows.
    """
    numbers = cut(numbered_within(leaves.select("artifact_id", "seq", "hash"), ["artifact_id"], ["seq"], "i"))
    sizes = numbers.groupBy(F.col("artifact_id").alias("k")).agg(F.count("*").alias("n_leaves"))
    # Every node carries how many its level has, so that no window over an artifact has to count them.
    level = numbers.join(sizes, F.col("artifact_id").eqNullSafe(F.col("k"))).select("artifact_id", "i", F.unhex("hash").alias("h"), "n_leaves", F.col("n_leaves").alias("left"))
    most, rounds = sizes.agg(F.max("n_leaves")).first()[0] or 0, 0
    while most > 1:
        pairs = level.groupBy("artifact_id", F.floor(F.col("i") / 2).alias("i"), "n_leaves", "left").agg(F.min_by("h", "i").alias("a"), F.max_by("h", "i").alias("b"))
        level = pairs.select("artifact_id", "i", F.when(F.col("left") == 1, F.col("a")).otherwise(F.unhex(F.sha2(F.concat("a", "b"), 256))).alias("h"), "n_leaves", F.ceil(F.col("left") / 2).alias("left"))
        most, rounds = -(-most // 2), rounds + 1
        if rounds % 6 == 0:
            level = cut(level)
    return level.select("artifact_id", F.lower(F.hex("h")).alias("root"), "n_leaves")


def findings(blocks: DataFrame, most: int = 10_000) -> DataFrame:
    """(rule, severity, seq) for every broken rule, one pass for the rules of a row and one aggregate for copies."""
    broken = [F.when(F.trim("data") == "", F.struct(F.lit("empty").alias("rule"), F.lit("warning").alias("severity"))), F.when(F.col("n_chars") != F.length("data"), F.struct(F.lit("length").alias("rule"), F.lit("error").alias("severity"))), F.when(F.col("n_chars") > most, F.struct(F.lit("oversize").alias("rule"), F.lit("warning").alias("severity")))]
    own = blocks.select("seq", F.explode(F.filter(F.array(*broken), lambda x: x.isNotNull())).alias("f")).select("f.rule", "f.severity", "seq")
    hashed = blocks.select("seq", content_hash(F.col("data")).alias("h"))
    first = hashed.groupBy("h").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = hashed.join(first, "h").where("seq <> first").select(F.lit("duplicate").alias("rule"), F.lit("warning").alias("severity"), "seq")
    return own.unionByName(copies)
