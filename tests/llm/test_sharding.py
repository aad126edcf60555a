"""Extendible hashing against a recursive version."""

import hashlib
import random

from lodestrand.llm import sharding
from pyspark.sql import functions as F


def h60(i, t):
    name = ("" if i is None else str(i)) + ":" + hashlib.md5((t or "").encode()).hexdigest()
    return int(hashlib.md5(name.encode()).hexdigest()[:15], 16)


def plain(rows, limit):
    out = {}

    def split(own, depth):
        total = sum(len((t or "").encode()) for _, (_, t) in own)
        if total <= limit or len(own) <= 1 or depth == 60:
            for k, (i, t) in own:
                out[k] = format(h60(i, t), "060b")[:depth]
            return
        for bit in (0, 1):
            split([x for x in own if h60(*x[1]) >> (59 - depth) & 1 == bit], depth + 1)

    split(list(enumerate(rows)), 0)
    return sorted(((i, out[k]) for k, (i, _) in enumerate(rows)), key=str)


def check(spark, rows, limit):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id bigint, text string, shard_bytes string")
    got = sharding.assign(docs, limit).collect()
    assert sorted(((r["id"], r["shard"]) for r in got), key=str) == plain(rows, limit)
    sizes, n = {}, {}
    for r in got:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
        n[r["shard"]] = n.get(r["shard"], 0) + 1
    assert all(sizes[s] <= limit or n[s] == 1 for s in sizes)
    return docs, got


def test_against_recursion(spark):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 300)) for i in range(700)] + [(None, "x" * 50), (None, None), (5000, "big" * 4000), (5001, "")]
    check(spark, rows, 2000)
    check(spark, rows, 10**9)


def test_two_levels_of_directory(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    monkeypatch.setattr(sharding, "MORE_BITS", 2)
    rng = random.Random(8)
    rows = [(i, "a" * rng.randint(1, 100)) for i in range(600)] + [(9999, "z" * 5000)]
    docs, got = check(spark, rows, 300)
    assert max(r["depth"] for r in got) > 6
    names = ["shard", "depth", "__bytes", "__depth", "__h", "__entry", "doc", "a.b"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    carried = sharding.sharded(docs, limit=300, place=-F.col("doc_id"))
    rows = carried.withColumn("part", F.spark_partition_id()).collect()
    assert carried.columns == [*docs.columns, "shard_", "depth_", "place"] and all(r[c] == c for r in rows for c in names)
    assert all(a["shard_"] != b["shard_"] or a["place"] <= b["place"] for a, b in zip(rows, rows[1:], strict=False) if a["part"] == b["part"])
    carried = carried.withColumn("shard", F.col("shard_"))
    assert sorted((r["doc_id"], r["shard"]) for r in carried.collect()) == sorted((r["id"], r["shard"]) for r in got)


def test_equal_rows_go_to_pages(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HASH_BITS", 12)
    monkeypatch.setattr(sharding, "FIRST_BITS", 12)
    docs = spark.createDataFrame([(1, "a" * 40)] * 25 + [(2, "b")], "doc_id bigint, text string")
    sizes = {}
    for r in sharding.assign(docs, 100).collect():
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
    assert sum(sizes.values()) == 1001 and all(s <= 100 for s in sizes.values())


def test_empty_table(spark):
    assert sharding.assign(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
