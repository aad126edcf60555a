"""Importance resampling: exact top-k, and a sample that leans to the target."""

import random

import numpy as np
from lodestrand.llm import importance
from pyspark.sql import functions as F


def test_top_k_is_exact(spark):
    rng = random.Random(1)
    keys = [rng.gauss(0, 5) for _ in range(3000)] + [1.25] * 400 + [-1e9, 1e9, 0.0, -0.0]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id bigint, key double")
    for k in (0, 1, 7, 1500, 1700, 3404, 9999):
        got = sorted(r["key"] for r in importance.top_k(df, k).collect())
        assert got == sorted(sorted(keys)[::-1][:k]), k
    assert importance.top_k(df.limit(0), 5).count() == 0
    same = spark.createDataFrame([(i, 3.0) for i in range(50)], "id bigint, key double")
    assert importance.top_k(same, 20).count() == 20


def test_the_sample_leans_to_the_target(spark, sf_more):
    docs, labels = (spark.read.parquet(f"{sf_more}/{n}.parquet") for n in ("documents", "labels"))
    good = labels.where("quality = 1").select("doc_id")
    kept = importance.resample(docs, good, 0.8)
    assert kept.count() == 800 and kept.select("id").distinct().count() == 800
    share = {r["quality"]: r["kept"] for r in labels.join(kept.select(F.col("id").alias("doc_id"), F.lit(1).alias("one")), "doc_id", "left").groupBy("quality").agg((F.count("one") / F.count("*")).alias("kept")).collect()}
    assert share[1] > 0.85 and share[1] > share[0] + 0.15
    again = importance.resample(docs, good, 0.8)
    assert again.exceptAll(kept).count() == 0


def test_ratio_is_that_of_smoothed_counts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c c"), (3, None), (4, "")], "doc_id bigint, text string")
    ratio = importance.models(docs, spark.createDataFrame([(1,), (None,), (1,)], "doc_id bigint"), buckets=32)
    raw, target = np.ones(32), np.ones(32)
    hashes = importance._Hashes()
    for ident, text in ((1, "a b"), (2, "a c c")):
        for b in importance.ngrams(text, hashes, 32):
            raw[b] += 1
            target[b] += ident == 1
    assert np.allclose(ratio, np.log(target / target.sum()) - np.log(raw / raw.sum()))


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (None, "a b", "c"), (3, "x " * 40000, "c"), (4, "a b", "c"), (4, "a b", "c")], "doc_id bigint, text string, key string")
    none = spark.createDataFrame([], "doc_id bigint")
    kept = importance.resample(docs, none, 1.0)
    assert kept.count() == 6
    assert {r["id"]: r["log_weight"] for r in kept.collect()}[1] == 0.0
    assert importance.resample(docs.limit(0), none, 0.5).count() == 0
