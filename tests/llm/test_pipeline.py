"""The pipeline against brute force, stage by stage on what the stage before left."""

import corpus_pipeline
from lodestrand.llm import mixing, sharding, toxicity
from lodestrand.llm.queries import fold
from pyspark.sql import functions as F
from test_decontaminate import plain as plain_contaminated
from test_mixing import plain_taken
from test_sharding import plain as plain_shards
from test_simhash import plain_components


def test_run_against_brute_force(spark, sf):
    docs, labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels, usable=fold() != 0)
    weights = toxicity._Weights(model.known, model.rest)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows = [r for r in rows if model.score(model.evidence(model.tokens(r[1], weights))[0]) < 0.5]
    least, _ = plain_components([r[:2] for r in rows])
    rows = [r for r, c in zip(rows, least, strict=True) if r[0] == c]
    dirty = {r[0] for r in plain_contaminated([r[:2] for r in rows], [(r["item_id"], r["text"]) for r in items.collect()], 13) if r[5]}
    rows = [r for r in rows if r[0] not in dirty]
    copies = {r[0]: r[4] // r[1] if r[1] else 0 for r in plain_taken(rows)}
    rows = [r for r in rows for _ in range(copies[r[0]])]
    want = plain_shards([r[:2] for r in rows], sharding.SHARD_BYTES)
    got = corpus_pipeline.run(spark, sf)
    rows = got.withColumn("part", F.spark_partition_id()).collect()
    assert sorted(((r["doc_id"], r["shard"]) for r in rows), key=str) == want
    # place is the training order: within a source that is drawn early, no copy comes before one of an earlier position.
    assert len({r["place"] for r in rows}) == len(rows)
    assert all(a["shard"] != b["shard"] or a["place"] < b["place"] for a, b in zip(rows, rows[1:], strict=False) if a["part"] == b["part"])


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name


def test_place_is_the_order_of_positions(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").dropDuplicates(["doc_id"])
    at = {}
    for r in mixing.plan(docs).select("doc_id", "__mix.positions").collect():
        at[r[0]] = sorted(r[1])
    mixing.mix(docs).write.parquet(f"{tmp_path}/mixed")
    rows = corpus_pipeline.sharded(spark, spark.read.parquet(f"{tmp_path}/mixed"), sf).orderBy("place").collect()
    seen, last = {}, 0.0
    for r in rows:
        k = seen[r["doc_id"]] = seen.get(r["doc_id"], -1) + 1
        assert at[r["doc_id"]][k] >= last - 1e-12
        last = at[r["doc_id"]][k]


def test_odd_rows_and_clashing_names(spark, sf):
    names = ["__tox", "__found", "__hit", "__hash", "__mix", "__at", "shard", "depth", "place", "target", "before", "class", "key", "doc", "id"]
    rows = [(1, None, None), (2, "", "a"), (None, "a text without an id", "a"), (3, "some words of their own here", "a"), (3, "some words of their own here", "a"), (4, "many " * 30_000, "b")]
    docs = spark.createDataFrame([(i, t, "en", s, 1, *names) for i, t, s in rows], ", ".join(["doc_id bigint", "text string", "lang string", "source string", "n_chars bigint", *[f"{c} string" for c in names]]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == kept and all(r[c] == c for r in docs.collect() for c in names)
    assert {r["doc_id"] for r in docs.collect()} >= {3, 4, None}
    last = corpus_pipeline.sharded(spark, docs, sf)
    assert last.columns == [*docs.columns, "shard_", "depth_", "place_"] and all(r[c] == c for r in last.collect() for c in names)


def test_empty_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
