"""Operators on small tables with results worked out by hand."""

import hashlib
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from lodestrand import catalogue
from lodestrand.artifact import Artifact, quick_create, quick_read, quick_verify
from lodestrand.functions import hashing, rules, text, times, vectors
from lodestrand.operators import access, aggregates, blocked, events, graph, integrity, pythonic, schemas, search, sequence
from lodestrand.plans import pythonic as plans
from lodestrand.sources import container, files
from pyspark.sql import functions as F


def sha(data):
    return hashlib.sha256(data).hexdigest()


def leaves(spark, texts):
    return spark.createDataFrame([("a", k, sha(t.encode())) for k, t in enumerate(texts)], "artifact_id string, seq bigint, hash string")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 13])
def test_merkle_root(spark, n):
    texts = [f"Block {k}" for k in range(n)]
    want = container.merkle([hashlib.sha256(t.encode()).digest() for t in texts]).hex()
    got = integrity.merkle_roots(leaves(spark, texts)).collect()
    assert [(r["root"], r["n_leaves"]) for r in got] == [(want, n)]


def test_merkle_by_hand():
    a, b, c = (hashlib.sha256(x).digest() for x in (b"1", b"2", b"3"))
    pair = lambda x, y: hashlib.sha256(x + y).digest()
    assert container.merkle([a]) == a and container.merkle([a, b]) == pair(a, b)
    assert container.merkle([a, b, c]) == pair(pair(a, b), pair(c, c)) and container.merkle([]) == bytes(32)


def test_merkle_roots_of_several_artifacts_and_any_change(spark):
    rows = [("a", k, sha(b"%d" % k)) for k in range(5)] + [("b", 0, sha(b"x"))]
    df = spark.createDataFrame(rows, "artifact_id string, seq bigint, hash string")
    roots = {r["artifact_id"]: r["root"] for r in integrity.merkle_roots(df).collect()}
    assert roots["b"] == sha(b"x")
    rows[3] = ("a", 3, sha(b"other"))
    assert {r["artifact_id"]: r["root"] for r in integrity.merkle_roots(spark.createDataFrame(rows, df.schema)).collect()}["a"] != roots["a"]


def test_integrity_of_nothing_is_whole(spark):
    none = spark.createDataFrame([], "k string, valid boolean")
    assert integrity.summary(none).first()["percent"] == 100.0


def test_container_round_trip_and_errors():
    blocks = [{"block_type": "TEXT", "data": b"Block %d" % k, "metadata": f'{{"id": {k}}}' if k else None, "block_id": bytes([k]) * 16} for k in range(3)]
    data = container.encode(blocks)
    rows = list(container.decode(data))
    assert [r["data"] for r in rows] == [b"Block 0", b"Block 1", b"Block 2"] and not any(r["error"] for r in rows)
    assert rows[0]["previous_hash"] == "00" * 32 and rows[1]["previous_hash"] == rows[0]["content_hash"]
    assert len(data) == container.FOOTER.read(data, len(data) - container.FOOTER.size)["total_size"]
    assert (container.FILE.size, container.BLOCK.size, container.FOOTER.size) == (444, 372, 48)
    for at in (container.FILE.size + container.BLOCK.size, container.FILE.size + 2 * container.BLOCK.size + 12):
        spoilt = data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]
        assert any(r.get("error") for r in container.decode(spoilt))
    assert "file header" in next(container.decode(b"short"))["error"]
    assert "file header" in next(container.decode(b"NOPE" + data[4:]))["error"]
    assert list(container.decode(container.encode([]))) == []
    cut_off = list(container.decode(data[: container.FILE.size + 100]))
    assert cut_off[-1]["error"] == "the header is cut off"


def test_container_scan_in_spark(spark):
    rows = [("a", k, "TEXT", f"t{k}".encode(), None) for k in (2, 0, 1)]
    packed = container.pack(spark.createDataFrame(rows, "artifact_id string, seq bigint, block_type string, data binary, metadata string"))
    assert [bytes(r["data"]) for r in container.scan(packed).orderBy("seq").collect()] == [b"t0", b"t1", b"t2"]


def test_chain_breaks_let_the_first_pass(spark):
    rows = [("c", 1, None, "h1"), ("c", 2, "h1", "h2"), ("c", 3, "bad", "h3"), ("c", 4, None, "h4"), ("d", 1, "any", "x")]
    df = spark.createDataFrame(rows, "k string, n int, previous string, current string")
    assert sorted(r["n"] for r in events.chain_breaks(df, "k", "previous", "current", "n").collect()) == [3, 4]


def test_state_from_events(spark):
    rows = [("a", 1, "create", 1, "x"), ("a", 2, "update", None, "y"), ("b", 1, "create", 5, "z"), ("b", 2, "delete", None, None), ("c", 1, "create", 1, "p"), ("c", 2, "update", 9, None), ("c", 3, "create", None, "q"), ("d", 1, "update", 7, None)]
    df = spark.createDataFrame(rows, "k string, n int, op string, v int, w string")
    state = events.latest_state(df, "k", ["v", "w"], F.col("op") == "create", F.col("op") == "delete", ["n"])
    assert {r["k"]: (r["v"], r["w"]) for r in state.collect()} == {"a": (1, "y"), "c": (None, "q"), "d": (7, None)}
    past = events.latest_state(df, "k", ["v"], F.col("op") == "create", F.col("op") == "delete", ["n"], until=F.col("n") <= 1)
    assert {r["k"]: r["v"] for r in past.collect()} == {"a": 1, "b": 5, "c": 1, "d": 7}


def test_last_write_wins_is_a_merge(spark):
    rows = [("r", "a", 1, "n1"), ("r", "b", 3, "n1"), ("r", "c", 3, "n2"), ("r", "d", 2, "n9")]
    df = spark.createDataFrame(rows, "k string, v string, ts int, writer string")
    whole = events.last_write(df, "k", ["v", "ts", "writer"], ["ts", "writer"]).first()
    parts = [events.last_write(df.where(c), "k", ["v", "ts", "writer"], ["ts", "writer"]) for c in ("ts < 3", "ts >= 3")]
    for x, y in (parts, parts[::-1], [df, df]):
        assert events.last_write(x.unionByName(y.select(x.columns)), "k", ["v", "ts", "writer"], ["ts", "writer"]).first() == whole
    assert whole["v"] == "c"


def test_range_count_with_peers_and_halo(spark):
    at = [0, 0, 1, 4, 5, 6, 86_399, 86_400, 86_401, 200_000]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(at)], "event_id int, s bigint").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = {r["event_id"]: r["n_near"] for r in sequence.range_count(df, 5_000_000, 0).collect()}
    assert got == {k: sum(1 for y in at if x - 5 <= y <= x) for k, x in enumerate(at)}
    both = {r["event_id"]: r["n_near"] for r in sequence.range_count(df, 1_999_999, 1_999_999, stretch_us=1).collect()}
    assert both == {k: sum(1 for y in at if abs(x - y) < 2) for k, x in enumerate(at)}


def test_bins_reset_at_the_limit(spark):
    df = spark.createDataFrame([("a", k, float(s)) for k, s in enumerate([5, 5, 1, 20, 3, 3, 3])], "g string, seq int, size double")
    rows = sequence.fill_bins(df, ["g"], "size", ["seq"], 10).orderBy("seq").collect()
    assert [r["bin"] for r in rows] == [0, 0, 1, 2, 3, 3, 3]


def test_cosine_and_search(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 1.0]), (5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id int, vector array<double>")
    best = search.top_k(search.scored(df, [1, 0, 0]), 2, "vec_id").collect()
    assert [r["vec_id"] for r in best] == [1, 2] and best[0]["score"] == 1.0
    scores = {r["vec_id"]: r["score"] for r in search.scored(df, [1, 0, 0]).collect()}
    assert scores[3] == 0.0 and scores[5] == 0.0
    after = search.top_k(search.scored(df, [0.5, 0.5, 0]), 3, "vec_id", at_least=0.75, before=False)
    assert after.count() == 1
    assert df.select(vectors.l2(F.col("vector"), F.lit([0.0, 0.0, 0.0]))).first()[0] == 1.0


def test_mean_pairwise_cosine_equals_the_pairs(spark):
    rng = random.Random(1)
    rows = [(k, k % 3, [rng.gauss(0, 1) for _ in range(5)]) for k in range(20)] + [(99, 7, [1.0] * 5), (100, 1, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id int, label int, vector array<double>")
    got = {r["label"]: r["coherence"] for r in search.mean_pairwise_cosine(df, "label").collect()}
    pairs = search.pairs_within(df, "label").groupBy("label").agg(F.avg(vectors.cosine(F.col("va"), F.col("vb"))).alias("c"))
    for r in pairs.collect():
        assert got[r["label"]] == pytest.approx(r["c"])
    assert got[7] == 1.0


def test_quantised_error_is_half_a_step(spark):
    df = spark.createDataFrame([(1, [0.0, 0.1, 1.0]), (2, [0.5, 0.25, 0.75])], "vec_id int, vector array<double>")
    for r in search.quantised(df, 4).collect():
        assert all(abs(a - b) <= 0.5 / 15 + 1e-12 for a, b in zip(r["vector"], r["restored"], strict=True))


def test_personal_data_and_sentiment(spark):
    rows = [(1, "John Smith of ACME Corp, 555-123-4567, john@example.com, 123-45-6789, 4532-1234-5678-9012"), (2, ""), (3, "123"), (4, "!@#$%^&*()")]
    df = spark.createDataFrame(rows, "id int, t string").withColumn("m", text.mask(F.col("t")))
    masked = {r["id"]: r["m"] for r in df.collect()}
    for found in ("John Smith", "ACME Corp", "555-123-4567", "john@example.com", "123-45-6789", "4532-1234-5678-9012"):
        assert found not in masked[1]
    assert (masked[2], masked[3], masked[4]) == ("", "123", "!@#$%^&*()")
    words = spark.createDataFrame([("a good day",), ("a terrible day, truly bad, though I like it",), ("plain",)], "t string")
    assert [r[0] for r in words.select(text.sentiment(F.col("t"))).collect()] == ["positive", "negative", "neutral"]
    found = spark.createDataFrame([("John Smith works at Microsoft Corporation in Seattle.",)], "t string").select(text.entities(F.col("t"))).first()[0]
    assert found == ["John Smith", "Microsoft Corporation", "Seattle"]


def test_text_measures(spark):
    df = spark.createDataFrame([("Machine  learning and\n deep learning", "ml and dl"), ("", ""), ("ab", "abc"), ("hello world", "hello there")], "a string, b string")
    rows = df.select(text.normalise(F.col("a")).alias("n"), text.fidelity(F.col("a"), F.col("b")).alias("f"), text.trigram_jaccard(F.col("a"), F.col("b")).alias("j"), text.truncated(F.col("a"), 5).alias("t"), text.word_count(F.col("a")).alias("w")).collect()
    assert rows[0]["n"] == "ML and DL" and rows[0]["w"] == 5 and rows[1]["w"] == 0
    assert rows[1]["f"] == 1.0 and rows[3]["f"] == 0.5 and rows[2]["j"] == 0.0
    assert rows[3]["t"] == "hello... [truncated, 11 total]"
    redacted = spark.range(1).select(text.redact(F.create_map(F.lit("API_KEY"), F.lit("a"), F.lit("k"), F.lit("b"))).alias("m")).first()["m"]
    assert redacted == {"API_KEY": "***REDACTED***", "k": "b"}
    sensitive = spark.createDataFrame([("a@b.co",), ("John",), ("ACME",), ("river",), ("1234567890",)], "w string")
    assert [r[0] for r in sensitive.select(text.sensitive(F.col("w"))).collect()] == [True, True, False, False, True]


def test_hashes(spark):
    row = spark.range(1).select(hashing.content_hash(F.lit("x")).alias("a"), hashing.content_hash(F.lit("x"), F.lit("")).alias("b"), hashing.content_hash(F.lit("x"), F.lit("{}m")).alias("c")).first()
    assert row["a"] == row["b"] == sha(b"x") and row["c"] == sha(hashlib.sha256(b"x").digest() + b"{}m")
    with pytest.raises(ValueError):
        hashing.shard_of(F.lit("a"), 10)


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, "abc"), (2, None, "xbc"), (3, 50.0, None)], "id int, v double, s string")
    met = lambda c: [r["id"] for r in df.where(c.column()).collect()]
    assert met(rules.Condition("v", "gt", 4)) == [1, 3] and met(rules.Condition("s", "matches", "a|x")) == [1, 2]
    assert met(rules.Condition("s", "matches", "bc")) == [] and met(rules.Condition("s", "not_contains", "x")) == [1]
    assert met(rules.Neither((rules.Condition("v", "gt", 10), rules.Condition("s", "eq", "abc")))) == [2]
    fired = rules.triggered(df, (rules.Rule("low", rules.Condition("v", "ge", 0), "log", 1), rules.Rule("high", rules.Condition("v", "gt", 10), "alert", 9), rules.Rule("off", rules.Condition("v", "ge", 0), "none", 99, active=False)))
    assert sorted((r["id"], r["place"], r["rule_id"]) for r in fired.collect()) == [(1, 0, "low"), (3, 0, "high"), (3, 1, "low")]
    with pytest.raises(ValueError):
        times.cron(F.col("v"), "* *")


def test_access(spark):
    granted = spark.createDataFrame([("ann", "docs/*", ["read"], None), ("*", "open", ["*"], None), ("bob", "*", ["write"], 5.0)], "rule_subject string, rule_resource string, permissions array<string>, expiry double")
    asked = [("ann", "docs/1", "read", True), ("ann", "docs/1", "write", False), ("eve", "open", "write", True), ("bob", "x", "write", False), ("eve", "docs/1", "read", False)]
    df = spark.createDataFrame(asked, "subject string, resource string, permission string, want boolean")
    rows = access.allowed(df, granted, F.lit(10.0)).collect()
    assert len(rows) == 5 and all(r["allowed"] == r["want"] for r in rows)


def test_graphs(spark):
    edges = spark.createDataFrame([("John", "ACME"), ("Jane", "ACME"), ("ACME", "New York"), ("x", "y")], "u string, v string")
    assert {r["node"]: r["hops"] for r in graph.neighbourhood(edges, ["John"], 2).collect()} == {"John": 0, "ACME": 1, "Jane": 2, "New York": 2}
    loops = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "u int, v int")
    assert sorted(r["u"] for r in graph.on_cycles(loops).withColumnRenamed("node", "u").collect()) == [1, 2, 3]
    dag = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (5, 4)], "u int, v int")
    nodes = spark.createDataFrame([(k,) for k in range(1, 7)], "node int")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, dag).collect()} == {1: 0, 2: 1, 3: 1, 4: 2, 5: 0, 6: 0}
    parts = graph.min_label_components(nodes, spark.createDataFrame([(2, 1), (3, 2), (6, 5)], "u int, v int"))
    assert {r["node"]: r["component"] for r in parts.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def _vectors(spark, n=300):
    rng = random.Random(6)
    rows = [(i, [0.0] * 5 if i == 7 else [1.0, 2.0, 0.0, 0.0, 1.0] if i % 30 == 1 else [rng.gauss(0, 1) for _ in range(5)], i % 10) for i in range(n)]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / ((math.hypot(*a) * math.hypot(*b)) or 1)
    return spark.createDataFrame(rows, "vec_id bigint, vector array<double>, label int").repartition(3), {(a, b): cos(v, w) for a, v, _ in rows for b, w, _ in rows}


def test_top_k_among_all_labels(spark, sf):
    df, cos = _vectors(spark)
    queries = df.where("vec_id % 50 <= 1").select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"))
    for block_rows in (4, 1000):
        got = {(r["q_id"], r["rank"]): (r["vec_id"], r["score"]) for r in blocked.top_k(queries, df, 5, block_rows).collect()}
        asked = [q for q in range(300) if q % 50 <= 1]
        assert len(got) == 5 * len(asked)
        for q in asked:
            want = sorted((-round(cos[q, i], 6), i) for i in range(300) if i != q)[:5]
            assert [(got[q, k + 1][0], -got[q, k + 1][1]) for k in range(5)] == [(i, s) for s, i in want]
    mmr = catalogue.QUERIES["mmr"](spark, sf)
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    assert any(label[r["q_id"]] != label[r["vec_id"]] for r in mmr.collect())


def test_density_clusters_across_labels(spark):
    df, cos = _vectors(spark)
    n, within = 300, 0.1
    near = {i: [j for j in range(n) if j == i != 7 or round(1 - cos[i, j], 9) <= within] for i in range(n)}
    for least in (2, 8):
        cores = {i for i in near if len(near[i]) >= least}
        part = {}
        for i in sorted(cores):
            todo = [] if i in part else [i]
            while todo:
                k = todo.pop()
                if k not in part:
                    part[k] = i
                    todo += [j for j in near[k] if j in cores]
        want = {i: (part[i] if i in cores else min((part[j] for j in near[i] if j in cores), default=None), i in cores) for i in near}
        assert len(set(part.values())) > 1 and (least > 2 or any(a % 10 != b % 10 for a, b in part.items()))
        for block_rows in (70, 1000):
            assert {r["vec_id"]: (r["component"], r["core"]) for r in blocked.density_clusters(df, within, least, block_rows).collect()} == want
    assert {(r["a"], r["b"]): round(r["score"], 9) for r in blocked.all_pairs(df, 70).collect()} == {(a, b): round(s, 9) for (a, b), s in cos.items() if a < b}


def test_all_pairs_store_nothing_and_take_null_vectors(spark, monkeypatch):
    monkeypatch.setattr(blocked, "cut", lambda df: pytest.fail("pairs are stored"))
    df, cos = _vectors(spark)
    more = df.unionByName(spark.createDataFrame([(1000, None, 3)], "vec_id bigint, vector array<double>, label int"), allowMissingColumns=True)
    got = {(r["a"], r["b"]): r["score"] for r in blocked.all_pairs(more, 70, digits=4).collect()}
    assert got.keys() == {(a, b) for a, b in cos if a < b} | {(a, 1000) for a in range(300)}
    assert all(s == 0 if b == 1000 else abs(s - cos[a, b]) < 5.1e-5 for (a, b), s in got.items())


def test_all_pairs_are_written_in_an_order_that_compresses(spark, tmp_path):
    n, rng = 2000, np.random.default_rng(5)
    v, ids = rng.normal(size=(n, 8)), rng.permutation(n)
    df = spark.createDataFrame([(int(i), v[i].tolist(), int(i % 2)) for i in ids], "vec_id bigint, vector array<double>, label int").coalesce(2)
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    for by, share in ((None, 1), ("label", 2)):
        blocked.all_pairs(df, by=by, digits=4).write.parquet(out := str(tmp_path / f"{by}"))
        pairs = pq.read_table(out)
        a, b, score = (pairs[c].to_numpy() for c in ("a", "b", "score"))
        assert len(np.unique(a * n + b)) == len(a) == share * (n // share) * (n // share - 1) // 2
        assert (a < b).all() and ((a - b) % share == 0).all() and np.abs(score - (v[a] * v[b]).sum(axis=1)).max() < 5.1e-5
        groups = [m.row_group(k) for f in (tmp_path / f"{by}").glob("*.parquet") for m in [pq.ParquetFile(f).metadata] for k in range(m.num_row_groups)]
        assert sum(g.column(k).total_compressed_size for g in groups for k in (0, 1)) < 0.6 * len(a)


def test_pairs_of_a_group_in_blocks(spark, sf):
    df, cos = _vectors(spark)
    odd = spark.createDataFrame([(1000, [1.0] * 5, None), (1001, None, 3), (None, [1.0] * 5, 3)], "vec_id bigint, vector array<double>, label int")
    want = {(a, b) for a, b in cos if a < b and a % 10 == b % 10} | {(a, 1001) for a in range(3, 300, 10)}
    for block_rows in (70, 1000):
        got = {(r["a"], r["b"]): r["score"] for r in blocked.all_pairs(df.unionByName(odd), block_rows, by="label").collect()}
        assert got.keys() == want and all(abs(s - cos.get(k, 0)) < 1e-12 for k, s in got.items())
    plan = catalogue.QUERIES["similarity_pairs"](spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Join" not in plan


def test_near_components_of_a_group_come_from_forests(spark, sf):
    df, cos = _vectors(spark)
    part = {i: i for i in range(300)}
    for a, b in sorted(cos):
        if a < b and a % 10 == b % 10 and round(1 - cos[a, b], 9) <= 0.1 and part[a] != part[b]:
            least, most = sorted((part[a], part[b]))
            part = {i: least if p == most else p for i, p in part.items()}
    assert 10 < len(set(part.values())) < 290
    for block_rows in (70, 1000):
        edges = blocked.near_forest(df, 0.1, block_rows, by="label")
        assert all(r["u"] % 10 == r["v"] % 10 for r in edges.collect())
        assert {r["node"]: r["component"] for r in graph.min_label_components(df.select(F.col("vec_id").alias("node")), edges).collect()} == part
    dense = df.select("vec_id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"), F.lit("g").alias("label")).coalesce(1)
    assert blocked.near_forest(dense, 0.1, by="label").count() < 2 * 300  # of 44,850 near pairs


def test_bounds_of_graphs_are_not_silent(spark):
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u int, v int")
    nodes = spark.createDataFrame([(k,) for k in range(1, 5)], "node int")
    assert {r["node"]: r["level"] for r in graph.levels(nodes, chain, most=4).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    with pytest.raises(RuntimeError):
        graph.levels(nodes, chain, most=3)
    with pytest.raises(RuntimeError):
        graph.min_label_components(nodes, chain, most=1)


def test_names_align_across_first_letters(spark):
    left, right = [f"vehicle speed {i}" for i in range(40)], [f"the vehicle speed {i}" for i in range(40)] + ["vehicle speed 3"]
    a, b = spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "best string")
    scored = a.crossJoin(b).select("name", "best", pythonic.digest_cosine("name", "best").alias("c"), text.trigram_jaccard(F.col("name"), F.col("best")).alias("j"))
    best = {}
    for r in scored.collect():
        if left[3] not in (r["name"], r["best"]) and 0.7 * r["c"] + 0.3 * r["j"] > 0.5:
            best[r["name"]] = max(best.get(r["name"], (0, "")), (0.7 * r["c"] + 0.3 * r["j"], r["best"]))
    want = {name: b for name, (_, b) in best.items()} | {left[3]: left[3]}
    assert len(want) > 1 and {r["name"]: r["best"] for r in plans._aligned(a, b).collect()} == want


def test_schemas(spark):
    registry = schemas.Registry()
    registry.register("1", "2", schemas.rename("a", "b"))
    registry.register("2", "3", schemas.change_type("b", "int"), schemas.add("c", 1))
    registry.register("1", "4", schemas.remove("a"))
    assert registry.path("1", "3") == ["1", "2", "3"]
    assert [tuple(r) for r in registry.upgrade(spark.createDataFrame([("7",), ("x",)], "a string"), "1", "3").collect()] == [(7, 1), (None, 1)]
    with pytest.raises(ValueError):
        registry.path("3", "1")
    df = spark.createDataFrame([('{"n": 1, "s": "x", "l": []}',), ('{"n": "1"}',), ("nope",)], "j string")
    found = [r[0] for r in df.select(schemas.errors(F.col("j"), {"n": "number", "s": "string", "l": "array"})).collect()]
    assert found[0] == [] and found[1] == ["n is not number", "s is missing", "l is missing"] and found[2] == ["not json"]


def test_risk_and_zeros(spark):
    none = spark.createDataFrame([], "severity string, confidence double")
    assert tuple(aggregates.risk_assessment(none).first()) == (0, 0.0, "low", 1.0)
    some = spark.createDataFrame([("critical", 1.0), ("high", 0.5)], "severity string, confidence double")
    assert tuple(aggregates.risk_assessment(some).first()) == (2, 0.675, "high", 0.75)


def test_secrets(spark):
    df = spark.createDataFrame([(1, 12345), (2, 0), (3, 2**62)], "id bigint, s bigint")
    points = pythonic.shares(df, "id", "s", n=5, threshold=3, salt="x")
    for chosen in ("x <= 3", "x >= 3", "x IN (1, 3, 5)"):
        assert {r["id"]: int(r["secret"]) for r in pythonic.reconstruct(points.where(chosen)).collect()} == {1: 12345, 2: 0, 3: 2**62}
    assert {r["id"]: int(r["secret"]) for r in pythonic.reconstruct(points.where("x <= 2")).collect()} != {1: 12345, 2: 0, 3: 2**62}


def test_diversity_bucket_and_codes(spark):
    rows = [(0, 1, 0.9, [1.0, 0.0]), (0, 2, 0.89, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "q_id bigint, vec_id bigint, score double, vector array<double>")
    assert [r["vec_id"] for r in pythonic.diverse(df, 2).orderBy("place").collect()] == [1, 3]
    calls = spark.createDataFrame([(1, k, float(t)) for k, t in enumerate([0, 0, 0, 10, 10])], "user_id bigint, event_id bigint, seconds double")
    allowed = [r["allowed"] for r in pythonic.token_bucket(calls, "user_id", 0.1, 2.0).orderBy("event_id").collect()]
    assert allowed == [True, True, False, True, False]
    bits = pythonic.huffman_bits({"a": 5, "b": 2, "c": 1, "d": 1})
    assert bits == {"a": 1, "b": 2, "c": 3, "d": 3} and pythonic.huffman_bits({"a": 3}) == {"a": 1}
    assert math.isclose(sum(2.0**-n for n in bits.values()), 1.0)


def test_mp4_boxes():
    box = lambda name, body=b"": (8 + len(body)).to_bytes(4, "big") + name + body
    data = box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", b"xx") + box(b"trak", box(b"tkhd")))
    assert pythonic.mp4_boxes(data) == [("ftyp", 12), ("moov", 34), ("mvhd", 10), ("trak", 16), ("tkhd", 8)]
    assert pythonic.mp4_boxes(b"\x00\x00\x00\x01junk") == []


def test_ward_joins_what_is_near(spark):
    rows = [("g", k, [float(x)]) for k, x in enumerate([0, 0.1, 5, 5.1, 20])]
    df = spark.createDataFrame(rows, "label string, vec_id bigint, vector array<double>")
    assert [r["cluster"] for r in pythonic.ward(df, "label", 3).orderBy("vec_id").collect()] == [0, 0, 1, 1, 2]


def _greedy(v, clusters):
    parts = [[k] for k in range(len(v))]
    growth = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((v[a].mean(axis=0) - v[b].mean(axis=0)) ** 2).sum()
    while len(parts) > clusters:
        _, i, j = min((growth(parts[i], parts[j]), i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)))
        parts[i] += parts.pop(j)
    return {k: n for n, p in enumerate(sorted(parts, key=min)) for k in p}


def test_ward_of_a_group_without_all_gaps(spark):
    rng = np.random.default_rng(4)
    for clusters in (1, 3, 9):
        v = rng.normal(size=(50, 3))
        v[10:20] = v[3]
        v[30:33] = v[4]
        df = spark.createDataFrame([("g", k, x.tolist()) for k, x in enumerate(v)], "label string, vec_id bigint, vector array<double>")
        assert {r["vec_id"]: r["cluster"] for r in pythonic.ward(df, "label", clusters).collect()} == _greedy(v, clusters)
    same = spark.createDataFrame([("g", k, [1.0]) for k in range(5)], "label string, vec_id bigint, vector array<double>")
    assert [r["cluster"] for r in pythonic.ward(same, "label", 3).orderBy("vec_id").collect()] == [0, 0, 0, 1, 2]
    some = F.col("id") % 300
    many = spark.range(40_000).select(F.lit("g").alias("label"), F.col("id").alias("vec_id"), F.array(*[F.sin(some * k) for k in range(1, 9)]).alias("vector"))
    found = pythonic.ward(many, "label", 3).groupBy((F.col("vec_id") % 300).alias("k")).agg(F.count_distinct("cluster").alias("n"), F.count("*").alias("rows"))
    assert found.where("n > 1").count() == 0 and found.agg(F.sum("rows")).first()[0] == 40_000


def test_attention_of_a_large_group_holds_few_scores_at_once(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.lit("g").alias("label")).where("vec_id < 90")
    got = {r["vec_id"]: r["attended"] for r in pythonic.multi_head(rows, "label", scores=700).collect()}
    x = np.array([r["vector"] for r in rows.orderBy("vec_id").collect()])
    rng = np.random.default_rng(42)
    q, k, v, o = (x @ m if at < 3 else m for at, m in enumerate(rng.uniform(-1, 1, (64, 64)) * np.sqrt(6 / 128) for _ in range(4)))
    want = []
    for h in range(0, 64, 16):
        weight = np.exp(q[:, h : h + 16] @ k[:, h : h + 16].T / 4)
        want.append(weight / weight.sum(1, keepdims=True) @ v[:, h : h + 16])
    assert np.allclose([got[i] for i in range(90)], np.hstack(want) @ o, atol=1e-12)


def test_artifact_and_files(spark, tmp_path):
    made = Artifact.create(spark, "a").add_text("one").add_embeddings([[1, 2]])
    assert made.size == 2 and [r["data"] for r in made.texts().collect()] == ["one"] and made.verify().count() == 0
    made.save(str(tmp_path / "x"))
    again = Artifact.load(spark, str(tmp_path / "x"))
    assert again.size == 2 and again.verify().isEmpty() and again.add_text("three").verify().isEmpty()
    spoilt = Artifact(again.blocks.withColumn("data", F.when(F.col("seq") == 0, "other").otherwise(F.col("data"))), "a", 2)
    assert [(r["seq"], r["problem"]) for r in spoilt.verify().collect()] == [(0, "data")]
    lost = quick_create(spark, str(tmp_path / "y"), "b", "one", "two", "three")
    assert quick_verify(spark, str(tmp_path / "y")) and [r["data"] for r in quick_read(spark, str(tmp_path / "y")).orderBy("seq").collect()] == ["one", "two", "three"]
    assert [(r["seq"], r["problem"]) for r in Artifact(lost.blocks.where("seq <> 1"), "b", 3).verify().collect()] == [(2, "link")]
    (tmp_path / "in").mkdir()
    for name in ("a.txt", "b.MP4", "c.bin", "d.png"):
        (tmp_path / "in" / name).write_bytes(b"data")
    kinds = {r["path"].rsplit("/", 1)[1]: r["block_type"] for r in files.ingest(spark, str(tmp_path / "in")).collect()}
    assert kinds == {"a.txt": "TEXT", "b.MP4": "VIDEO", "c.bin": "BINARY", "d.png": "IMAGE"}
    import sqlite3

    with sqlite3.connect(tmp_path / "t.db") as db:
        db.execute("CREATE TABLE checkpoints (thread_id TEXT, n INTEGER)")
        db.executemany("INSERT INTO checkpoints VALUES (?, ?)", [("a", 1), ("b", 2)])
    assert files.sqlite_table(spark, str(tmp_path / "t.db"), "checkpoints", "thread_id string, n bigint").count() == 2


def test_cycles_in_larger_graphs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (102, 200), (200, 201), (201, 200), (201, 300), (300, 301), (400, 400), (500, 501), (501, 400)]
    found = graph.on_cycles(spark.createDataFrame(edges, "u int, v int")).collect()
    assert sorted(r["node"] for r in found) == [100, 101, 102, 200, 201, 400]
    assert graph.on_cycles(spark.createDataFrame([], "u int, v int")).count() == 0


def test_walks_end_at_roots_and_skip_cycles(spark):
    rows = [(0, None), *[(i, i - 1) for i in range(1, 30)], (50, 99), (51, 50), (60, 61), (61, 62), (62, 60), (63, 60)]
    got = {r["node"]: (r["root"], r["depth"]) for r in graph.walk(spark.createDataFrame(rows, "node int, parent int")).collect()}
    assert all(got[i] == (0, i) for i in range(30)) and got[50] == (50, 0) and got[51] == (50, 1)
    assert all(got[i] == (None, None) for i in (60, 61, 62, 63))


def test_numbers_without_one_task(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    assert all(r["x"] == r["number"] for r in sequence.numbered(rows, ["x"]).collect())
    assert sequence.numbered(rows.limit(0), ["x"]).count() == 0


def test_groups_are_numbered_and_linked_across_ranges(spark):
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("g"), (F.col("id") * 7919 % 4000).alias("x"))
    rows = rows.withColumn("v", F.when(F.col("x") % 5 > 0, F.col("x")))
    groups, got = {}, {}
    for g, x, v in sorted(rows.collect(), key=lambda r: r[1]):
        groups.setdefault(g, []).append((x, v))
    want = {(g, x): (k, at[k - 1][1] if k else None) for g, at in groups.items() for k, (x, _) in enumerate(at)}
    linked = sequence.previous(sequence.numbered_within(rows, ["g"], ["x"], "n"), ["g"], ["x"], "v", "before")
    got = {(r["g"], r["x"]): (r["n"], r["before"]) for r in linked.collect()}
    assert got == want and linked.columns == ["g", "x", "v", "n", "before"]
    assert sequence.numbered_within(rows.limit(0), ["g"], ["x"]).count() == sequence.previous(rows.limit(0), ["g"], ["x"], "v", "b").count() == 0


def test_a_store_refuses_rivals(spark, tmp_path):
    from lodestrand.sources.versions import Conflict, Store

    store = Store(spark, str(tmp_path / "t"), "k int, v string", "k")
    assert store.latest() == 0 and store.read().count() == 0
    a, b = store.begin(), store.begin()
    a.write(spark.createDataFrame([(1, "a"), (2, "a")], store.schema))
    assert a.read().count() == 2 and store.read().count() == 0
    assert a.commit() == 1
    b.write(spark.createDataFrame([(1, "b")], store.schema))
    with pytest.raises(Conflict):
        b.commit()
    c = store.begin()
    c.delete(spark.createDataFrame([(2,)], "k int"))
    c.write(spark.createDataFrame([(2, "again"), (3, "c")], store.schema))
    assert {r["k"]: r["v"] for r in c.read().collect()} == {1: "a", 2: "again", 3: "c"} and c.commit() == 2
    assert {r["k"]: r["v"] for r in store.read().collect()} == {1: "a", 2: "again", 3: "c"} and store.read(1).count() == 2


def test_personal_data_in_any_script(spark):
    rows = spark.createDataFrame([("José Smith wrote to Anna Schmidt, ÉAnna Schmidtö.",), ("Tel. 555-123-4567 é555-123-4567 über@uni.de",)], "t string")
    masked = [r[0] for r in rows.select(text.mask(F.col("t"))).collect()]
    assert masked == ["José Smith wrote to ANON_NAME, ÉAnna Schmidtö.", "Tel. ANON_PHONE é555-123-4567 ANON_EMAIL"]


def test_only_a_local_master_gets_a_temporary_folder():
    from types import SimpleNamespace

    from lodestrand.functions.storage import shared_folder

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://a:7077", getCheckpointDir=lambda: None, getConf=lambda: {}))
    with pytest.raises(RuntimeError):
        shared_folder(far)


def test_limited_and_metered_functions():
    from lodestrand.operators import control

    now = [0.0]
    f = control.limited(0.5, 2, lambda: now[0])(lambda: 1)
    assert f() + f() == 2
    with pytest.raises(control.TooMany):
        f()
    now[0] = 2.0
    assert f() == 1
    ledger = control.Ledger({("s", "o"): 2.0})
    assert ledger.metered("s", "o", len)(lambda x: x[0])("abc") == "a" and ledger.entries == [("s", "o", 3.0, 6.0)]
    hooks = control.Hooks()
    hooks.register("a", lambda x: x + 1)
    hooks.register("a", lambda x: x * 2)
    assert hooks.call("a", 3) == [4, 6] and hooks.call("b", 3) == []


def test_attended_in_blocks_is_attended_at_once(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").where("vec_id < 120").withColumn("trust", 1.0 - (F.col("vec_id") % 5) / 10.0)
    want = {(r["a"], r["i"]): r["x"] for r in search.attended(search.attention(rows, "label"), rows, "label").collect()}
    got = {(r["a"], r["i"]): r["x"] for r in blocked.attended(rows, "label", block_rows=25).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert blocked.attended(rows.limit(0), "label").count() == 0


def _split_events(spark, sf, folder):
    """The events, of few users, in files whose times overlap: later ones come first."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.col("user_id") % 3)
    for k in (2, 1, 0):
        rows.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet/*.parquet'")
    return lambda name: sorted(map(str, con.execute(catalogue.ORACLES[name]).fetchall()))


def test_replays_in_files_that_overlap_and_in_batches(spark, sf, tmp_path):
    from lodestrand.streaming import views

    want = _split_events(spark, sf, tmp_path)("replay_guard")
    got = catalogue.QUERIES["replay_guard"](spark, str(tmp_path))
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert "Pandas" not in got._jdf.queryExecution().toString()
    start = "timestamp '2024-01-01 00:00:00'"
    for k, (nonce, off) in enumerate([("a", 0), ("b", 999), ("b", 0), ("a", 0), ("b", 0), (None, 0), (None, -999), (None, 0)]):
        spark.sql(f"SELECT {k}L AS event_id, {start} AS got, {start} + INTERVAL {off} SECONDS AS said, cast({'null' if nonce is None else repr(nonce)} AS string) AS nonce").coalesce(1).write.mode("append").parquet(f"{tmp_path}/m.parquet")
    verdicts = {r["event_id"]: r["verdict"] for r in views.guarded(views.source(spark, f"{tmp_path}/m.parquet", 1), 300.0).collect()}
    whole = {r["event_id"]: r["verdict"] for r in views.guarded(spark.read.parquet(f"{tmp_path}/m.parquet"), 300.0).collect()}
    assert [whole[k] for k in range(8)] == ["accepted", "early", "accepted", "replay", "replay", "accepted", "late", "replay"]
    assert sorted(verdicts.values()) == sorted(whole.values()) and verdicts[1] == "early" and verdicts[6] == "late"


def test_rate_limits_over_files_that_overlap_and_in_pieces(spark, sf, tmp_path):
    want = _split_events(spark, sf, tmp_path)("streaming_rate_limit")
    assert {x.rsplit(", ", 1)[1] for x in want} == {"True)", "False)"}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = catalogue.QUERIES["streaming_rate_limit"](spark, str(tmp_path)).select("user_id", "event_id", "allowed").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(str(tuple(r)) for r in got) == want


def test_attention_in_blocks_is_attention_at_once(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label").where("vec_id < 120").withColumn("trust", 1.0 - (F.col("vec_id") % 5) / 10.0)
    want = {(r["label"], r["a"], r["b"]): r["weight"] for r in search.attention(rows, "label").collect()}
    for block_rows in (25, 1000):
        got = {(r["label"], r["a"], r["b"]): r["weight"] for r in blocked.attention(rows, "label", block_rows=block_rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    plan = catalogue.QUERIES["coherence_attention"](spark, sf)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Window" not in plan


def test_a_view_is_the_last_of_each_key(spark, tmp_path):
    from lodestrand.streaming import views

    rows = [(n % 7, n, f"v{n}") for n in range(60)]
    for n in range(12):
        spark.createDataFrame(rows[5 * n : 5 * n + 5], "k int, at int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
    for compact in (1, 3, 100):
        got = views.to_view(views.source(spark, str(tmp_path / "s")), ["k"], "at", compact)
        assert sorted(map(tuple, got.collect())) == rows[-7:][-(60 % 7) :] + rows[-7 : -(60 % 7)]


def test_bins_are_those_of_a_fold(spark):
    rows = [(g, k, float((k * 7919 + 13 * len(g or "")) % 23 if k % 5 else 0)) for g in ("a", "hot", None) for k in range(80 if g == "hot" else 9)]
    rows += [("z", 0, 0.0), ("z", 1, 50.0), ("z", 2, 1.0), ("z", 3, 0.0), ("y", 0, None)]
    want, state = {}, {}
    for g, k, size in rows:
        at, held = state.get(g, (0, 0.0))
        size = size or 0.0
        at, held = (at + 1, size) if held + size > 30 and held > 0 else (at, held + size)
        state[g], want[g, k] = (at, held), at
    df = spark.createDataFrame(rows, "g string, k int, size double")
    assert {(r["g"], r["k"]): r["bin"] for r in sequence.fill_bins(df, ["g"], "size", ["k"], 30).collect()} == want
    assert sequence.fill_bins(df.limit(0), ["g"], "size", ["k"], 30).count() == 0


@pytest.mark.parametrize("name", ["lsh_search", "ivf_search"])
def test_recall_of_approximate_search(spark, sf_more, name):
    rows = spark.read.parquet(f"{sf_more}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"))
    want = {(r["q_id"], r["vec_id"]) for r in blocked.top_k(queries, rows, 10).collect()}
    got = {(r["q_id"], r["vec_id"]) for r in catalogue.QUERIES[name](spark, sf_more).collect()}
    assert len(want & got) / len(want) >= 0.9
