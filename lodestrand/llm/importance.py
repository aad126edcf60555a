"""Importance resampling by hashed n-gram models (target against raw) and Gumbel top-k."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import cut, unit_hash

#: Tokens: runs of letters, digits and non-ASCII bytes, and runs of marks. Case and marks tell much of a text's kind.
TOKEN = rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\x00-\x20]+"

#: Buckets that unigrams and bigrams are hashed into.
BUCKETS = 1 << 14
#: Target examples at most, on average: a sample by hash, small enough to broadcast.
TARGET_ROWS = 50_000


class _Hashes(dict):
    """CRCs of words; forgets all when full, so that memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 18:
            self.clear()
        self[word] = out = zlib.crc32(word)
        return out


def ngrams(text: str | None, hashes: _Hashes, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket numbers of a text's tokens and pairs of tokens, repeats included."""
    words = re.findall(TOKEN, (text or "").encode("utf-8", "surrogatepass"))
    one = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    two = (one[:-1] * np.uint64(0x9E3779B1) + one[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)
    return (np.concatenate([one, two]) % np.uint64(buckets)).astype(np.int64)


def models(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log-ratio of each bucket's probability in the target's n-gram model to that in the raw one.

    target: ids of documents that are like what is wanted. The raw model counts every document. Both
    have add-one smoothing. Each task sends one count a bucket and model, whatever it reads.
    """
    ids = target.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct()
    share = min(1.0, target_rows / max(1, ids.count()))
    picked = ids.where(F.pmod(F.xxhash64("__id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))  # about target_rows ids
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), rows["id"] == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("wanted"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, tally = _Hashes(), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = np.bincount(ngrams(text.as_py(), hashes, buckets), minlength=buckets)
                tally[0] += found
                if wanted:
                    tally[1] += found
        used = np.flatnonzero(tally[0])
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(tally[0][used]), pa.array(tally[1][used])], ["bucket", "raw", "target"])

    counted = np.ones((2, buckets))
    for r in rows.mapInArrow(count, "bucket bigint, raw bigint, target bigint").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # one row a bucket
        counted[:, r[0]] += r[1:]
    return np.log(counted[1] / counted[1].sum()) - np.log(counted[0] / counted[0].sum())


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str = "doc_id", text_col: str = "text", seed: int = 17, temperature: float = 0.03) -> DataFrame:
    """(id, n_grams, log_weight, key) for each row of docs.

    log_weight is the mean log-ratio of the text's n-grams over the temperature, so that long texts
    don't win by length alone; 0 for texts without tokens. key adds Gumbel noise from a hash of
    seed, id and text: the k largest keys are a sample without replacement by weight.
    """
    shared, buckets = docs.sparkSession.sparkContext.broadcast(ratio), len(ratio)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (-F.log(-F.log(unit_hash(F.lit(seed), F.col(id_col), F.col(text_col))))).alias("noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ratio = _Hashes(), shared.value
        for batch in batches:
            n, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column(1)):
                found = ngrams(text.as_py(), hashes, buckets)
                n[k] = len(found)
                weight[k] = math.fsum(ratio[found]) / len(found) / temperature if len(found) else 0.0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(weight), pa.array(weight + batch.column(2).to_numpy())], ["id", "n_grams", "log_weight", "key"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_grams bigint, log_weight double, key double")


def top_k(rows: DataFrame, k: int, key: str = "key", bits: int = 12) -> DataFrame:
    """The k rows with the largest keys, exactly; ties at the threshold are filled up by any of them.

    Keys map to integers in the same order; histograms of 12 bits at a time narrow down the
    threshold in at most six rounds, each a partial aggregate, so nothing is sorted or collected.
    """
    mask = (1 << bits) - 1
    total = rows.count()
    if k >= total:
        return rows
    if k <= 0:
        return rows.limit(0)
    # The bits of a double, with the sign turned about, are in the order of the numbers: 0 to 2^60 - 1 here.
    raw = F.col(key).cast("double")
    lo, hi = rows.agg(F.min(raw), F.max(raw)).first()
    scaled = F.when(raw == F.lit(hi), F.lit((1 << 60) - 1)).otherwise(F.least(F.lit((1 << 60) - 1), F.floor((raw - F.lit(lo)) / F.lit(max(hi - lo, 5e-324)) * F.lit(float(1 << 60))).cast("bigint")))
    rows = rows.withColumn("__rank", scaled)
    prefix, need = 0, k
    for shift in range(60 - bits, -1, -bits):
        inside = rows.where(F.shiftright("__rank", shift + bits) == F.lit(prefix))
        hist = inside.groupBy(F.shiftright("__rank", shift).bitwiseAND(F.lit(mask)).alias("b")).count().orderBy(F.desc("b")).collect()  # 4096 rows at most
        for b, n in hist:
            if need <= n:
                prefix = (prefix << bits) | b
                break
            need -= n
    above = rows.where(F.col("__rank") > F.lit(prefix))
    ties = rows.where(F.col("__rank") == F.lit(prefix)).orderBy(F.desc(key), "id").limit(need)
    return above.unionByName(ties).drop("__rank")


def resample(docs: DataFrame, target: DataFrame, share: float, id_col: str = "doc_id", text_col: str = "text", seed: int = 17) -> DataFrame:
    """(id, n_grams, log_weight, key) of the sampled rows: ``share`` of all, by importance.

    Null texts have no tokens; rows with null ids take part; repeated rows are rows of their own. An
    empty table gives no rows; without any target all weights say how common a text's n-grams are.
    """
    rows = cut(weigh(docs, models(docs, target, id_col, text_col), id_col, text_col, seed))
    return top_k(rows, round(share * rows.count()))
