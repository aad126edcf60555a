"""Nearest neighbours against brute force."""

import numpy as np
from lodestrand.llm import neighbours
from pyspark.sql import functions as F


def brute(rows, asks, k):
    out = {}
    for q, v in rows:
        if q % asks == 0:
            scored = sorted(((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v)))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def exact_scores(rows, got):
    at = dict(rows)
    return all(abs(float(np.dot(at[q], at[i])) - s) < 1e-9 for q, found_ in got.items() for i, s in found_)


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").repartition(2)
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    got, want = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0)), brute(rows, 20, 20)
    assert recall(got, want) >= 0.9 and exact_scores(rows, got)
    several = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, query_rows=30))
    assert several == got


def test_the_result_does_not_depend_on_partitions_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(32)) for i in range(12_000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>")
    got = found(neighbours.nearest(df.coalesce(1), F.col("vec_id") % 300 == 0))
    assert recall(got, brute(rows, 300, 20)) >= 0.9 and {len(x) for x in got.values()} == {20}
    assert found(neighbours.nearest(df.repartition(7), F.col("vec_id") % 300 == 0)) == got


def test_recall_at_the_size_of_a_block():
    rng = np.random.default_rng(9)
    vectors = rng.standard_normal((3 * neighbours.INDEX_ROWS, 64))
    vectors /= np.sqrt((vectors**2).sum(axis=1))[:, None]
    ids, queries = np.arange(len(vectors)), vectors[:64]
    sample = neighbours.Index(vectors[100 : 100 + neighbours.SAMPLE_ROWS], ids[100 : 100 + neighbours.SAMPLE_ROWS], 0, 20)
    bound = np.array([s[-1] for _, s in neighbours.expand([sample], queries, ids[:64], 20)])
    block = neighbours.Index(vectors[: neighbours.INDEX_ROWS], ids[: neighbours.INDEX_ROWS], 0, 20)
    norms, at = neighbours._unit(queries)
    lo, hi = block.windows(at, block.radius(bound / norms))
    scores = queries @ vectors.T
    scores[np.arange(64), np.arange(64)] = -1
    least = np.sort(scores, axis=1)[:, -20]
    hits = verified = whole = 0
    for q in range(64):
        found_ = set(block.ids[block.starts[block.colliding(lo[q], hi[q])]].tolist())
        want = set(np.flatnonzero(scores[q, : neighbours.INDEX_ROWS] >= least[q]).tolist())
        hits, whole, verified = hits + len(found_ & want), whole + len(want), verified + len(found_)
    assert hits >= 0.9 * whole and verified < 0.25 * 64 * neighbours.INDEX_ROWS


def test_norms_matter(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(16) * rng.uniform(0.1, 4)) for i in range(9000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(2)
    got = found(neighbours.nearest(df, F.col("vec_id") % 180 == 0))
    assert recall(got, brute(rows, 180, 20)) >= 0.9 and exact_scores(rows, got)


def test_recall_on_mixed_norms(spark):
    rng = np.random.default_rng(3)
    unit = rng.standard_normal((8000, 64))
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    for norms in (rng.lognormal(0, 0.2, 8000), rng.uniform(0.1, 1, 8000), np.where(rng.random(8000) < 0.05, 1.0, 0.3)):
        rows = list(enumerate(unit * norms[:, None]))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").coalesce(1)
        got = found(neighbours.nearest(df, F.col("vec_id") % 400 == 0))
        scores = np.array([v for _, v in rows])
        want = {q: sorted((-float(s), i) for i, s in enumerate(scores @ scores[q]) if i != q)[:20] for q in range(0, 8000, 400)}
        assert recall(got, {q: [(i, -s) for s, i in x] for q, x in want.items()}) >= 0.9


def test_many_copies_and_near_copies(spark):
    rng = np.random.default_rng(4)
    seeds = rng.standard_normal((40, 24))
    rows = [(i, seeds[0]) for i in range(4000)]  # copies hold half of the rows; the rest are near copies of the seeds
    rows += [(4000 + i, seeds[i % 40] + 1e-3 * rng.standard_normal(24)) for i in range(4000)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(3)
    got, want = found(neighbours.nearest(df, F.col("vec_id") % 400 == 0)), brute(rows, 400, 20)
    assert recall(got, want) >= 0.9
    assert [i for i, _ in got[0]] == [i for i, _ in want[0]]  # ties go to smaller ids, however many copies there are


def test_long_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(3000)) for i in range(300)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id bigint, embedding array<double>").repartition(2)
    got = found(neighbours.nearest(df, F.col("vec_id") % 50 == 0, k=5))
    assert recall(got, brute(rows, 50, 5)) >= 0.9 and exact_scores(rows, got)


def test_repeated_candidates_leave_room_for_others(spark):
    rows = [(0, [1.0, 0.0]), *[(1, [2.0, 0.0])] * 30, (2, [1.5, 0.0]), (3, [1.5, 0.0]), (4, [0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").coalesce(1)
    assert found(neighbours.nearest(df, F.col("vec_id") == 0, k=3)) == {0: [(1, 2.0), (2, 1.5), (3, 1.5)]}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 2.0, 3.0]), (40, [0.5, 0.5]), (40, [0.5, 0.5]), (3, [0.0, 1.0]), (60, [])]
    df = spark.createDataFrame([(i, v, *["clash"] * 6) for i, v in rows], "vec_id bigint, embedding array<double>, score string, id string, v string, asks string, bound string, rank string")
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=3))
    assert [i for i, _ in got[0]] == [1, 2, 40]
    assert [i for i, _ in got[20]] == [9] and set(got) == {0, 20, 40}
    assert got[40] == [(0, 0.5), (1, 0.5), (2, 0.5)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert neighbours.nearest(df, F.col("vec_id") < 0).count() == 0
