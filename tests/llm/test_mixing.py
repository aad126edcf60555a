"""Targets, curriculum and sequence against brute force."""

import hashlib
import random
import re

import pytest
from lodestrand.llm import mixing
from pyspark.sql import functions as F


def plain_targets(sizes):
    """sizes: source -> words. Shares by weight, excess over three times the size dealt anew until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        w = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def plain_taken(rows):
    """rows: (id, text, source) -> {row: (size, source size, target, taken)}."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    target, out = plain_targets(sizes), []
    for source, total in sizes.items():
        own = sorted((hashlib.md5((("" if i is None else str(i)) + ":" + hashlib.md5((t or "").encode()).hexdigest()).encode()).hexdigest(), size(t), i) for i, t, s in rows if s == source)
        full = int(target[source] // total) if total else 0
        rest, at = target[source] - full * total, 0
        for _, n, i in own:
            copies = full + (at + n / 2 < rest) if n else 0
            out.append((i, n, total, round(target[source], 6), n * copies))
            at += n
    return sorted(out, key=str)


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, s, "clash") for i, t, s in rows], "doc_id bigint, text string, source string, size string")
    names = ["__mix", "__size", "__order", "__at", "before", "target", "source_size", "class", "key", "bucket", "order", "start", "copies", "doc", "a.b"]
    for c in names:
        docs = docs.withColumn(c, F.lit(c))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and all(r[c] == c for r in mixed.collect() for c in names)
    assert sorted(map(repr, mixing.plan(docs, drop_text=True).collect())) == sorted(map(repr, mixing.plan(docs).drop("text").collect()))
    got = mixing.plan(docs).select("doc_id", "__mix_.*", "source").collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["copies"] * r["size"]) for r in got), key=str) == plain_taken(rows)
    return docs, got


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 40), rng.choice(["a", "a", "a", "b", "B", "é", None])) for i in range(400)]
    rows += [(900, None, "a"), (901, "", "b"), (902, "one\x0btwo\tthree\r\n", "z"), (None, "x y", "z"), (903, "w " * 30000, "huge"), (904, None, "empty")]
    _, got = check(spark, rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        taken = sum(r["copies"] * r["size"] for r in own)
        assert all(r["copies"] <= 3 for r in own)
        assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1e-6


def test_null_and_repeated_ids_are_spread(spark):
    docs = spark.createDataFrame([(None, f"words of {i}", "a") for i in range(400)], "doc_id bigint, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert mixing.plan(docs).select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    check(spark, [(None, f"words of {i}", "a") for i in range(40)] + [(3, "x", "a")] * 5)


def test_one_source_and_empty_tables(spark):
    check(spark, [(i, "a b c", "only") for i in range(10)])
    check(spark, [(1, None, None), (2, "", "x")])
    docs = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.plan(docs).count() == 0 and mixing.mix(docs).count() == 0


def test_sequence_follows_the_schedule(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = mixing.plan(docs).cache()
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.groupBy("doc_id").count().exceptAll(plan.where("__mix.copies > 0").select("doc_id", F.col("__mix.copies").cast("bigint").alias("count"))).count() == 0
    at = sorted((p, r["source"], r["__mix"]["size"]) for r in plan.collect() for p in r["__mix"]["positions"])
    assert all(0 <= p <= 1 for p, _, _ in at)
    order = sorted({r[1] for r in at})
    for k, shape in enumerate(("early", "even", "late")):
        own = [(p, n) for p, s, n in at if order.index(s) % 3 == k]
        first = sum(n for p, n in own if p < 0.5) / sum(n for _, n in own)
        want = {"early": 0.625, "even": 0.5, "late": 0.375}[shape]
        assert abs(first - want) < 0.12, shape


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, [(0.0, 1.0), (0.3, 5.0), (0.6, 5.0), (1.0, 0.1)]])
def test_inverse_of_the_integral(spark, schedule):
    def area(t):
        out = 0.0
        for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
            if t > t0:
                e = min(t, t1)
                out += (e - t0) * (w0 + w0 + (w1 - w0) * (e - t0) / (t1 - t0)) / 2
        return out

    for r in spark.range(101).select((F.col("id") / 100).alias("u")).withColumn("t", mixing.invert(F.col("u"), schedule)).collect():
        assert abs(area(r["t"]) / area(1.0) - r["u"]) < 1e-9


def test_bad_schedules():
    for bad in ([(0.0, 1.0), (0.9, 1.0)], [(0.0, 0.0), (1.0, 1.0)], [(0.0, 1.0), (0.5, 1.0), (0.5, 2.0), (1.0, 1.0)]):
        with pytest.raises(ValueError):
            mixing.invert(F.lit(0.5), bad)
