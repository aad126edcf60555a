"""Segments against brute force; the classifier on held-out rows."""

import math
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm import toxicity as tox
from lodestrand.llm.queries import fold
from pyspark.sql import functions as F


def plain_segments(scores, shift=0):
    """Maximal scoring segments as they are defined: the best one, then what is left of it and right of it."""
    best = None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > 0 and (best is None or s > best[2] or s == best[2] and j - i < best[1] - best[0]):
                best = (i, j, s)
    if best is None:
        return []
    i, j, s = best
    return plain_segments(scores[:i], shift) + [(i + shift, j + shift, s)] + plain_segments(scores[j:], shift + j)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-7, -5, -3, -2, 1, 4, 6, 11, 17]), max_size=14))
def test_segments_are_the_maximal_ones(scores):
    got = [s for s in tox.segments(np.array(scores, float), 1e-9)]
    assert sorted(x[2] for x in got) == sorted(float(x[2]) for x in plain_segments(scores))
    assert all(abs(sum(scores[a:b]) - s) < 1e-9 for a, b, s in got)


def test_held_out_accuracy_and_clean_texts(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = tox.fit(docs, labels, usable=fold() != 0)
    rows = tox.score(docs, model, drop_text=True).join(labels.where(fold() == 0), "doc_id").select("toxic", "__tox.score").collect()
    positive, negative = ([r["score"] for r in rows if r["toxic"] == t] for t in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in positive for n in negative])
    assert auc > 0.9
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.97
    assert np.mean([n >= 0.5 for n in negative]) < 0.01


def toy(spark):
    clean, bad = "the quiet river runs past green hills and small houses", "you vile rotten creature you vile thing"
    rows = [(i, f"{clean} {i}") for i in range(300)] + [(1000 + i, f"{clean} {bad} {i}") for i in range(150)]
    labels = [(i, 0) for i in range(300)] + [(1000 + i, 1) for i in range(150)] + [(None, 1), (5, None), (1003, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_edges(spark):
    docs, labels = toy(spark)
    model = tox.fit(docs, labels)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a quiet river"), (4, "you vile rotten creature, a vile thing"), (4, "you vile rotten creature, a vile thing"), (None, "river " * 30000)], "doc_id bigint, text string")
    names = ["__tox", "__id", "__label", "id", "label", "a.b", "score", "doc"]
    for c in names:
        odd, docs, labels = (x.withColumn(c, F.lit(c)) for x in (odd, docs, labels))
    assert tox.fit(docs, labels) == model
    out = tox.score(odd, model).select("doc_id", "__tox_.score", "__tox_.passages", "text").collect()
    assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[4]["score"] >= 0.5 > max(by[k]["score"] for k in (1, 2, 3, None))
    assert by[4]["passages"] and not by[3]["passages"]
    assert by[1]["score"] == by[2]["score"]
    kept = tox.clean(odd, model)
    assert all(r[c] == c for r in kept.collect() for c in names)
    assert kept.columns == odd.columns and 4 not in {r["doc_id"] for r in kept.collect()} and kept.count() == 4


def test_without_examples(spark):
    docs, labels = toy(spark)
    model = tox.fit(docs, labels.where(F.col("toxic") == 0))
    assert all(r[0] < 0.5 for r in tox.score(docs, model).select("__tox.score").collect())
    assert tox.score(docs.limit(0), model).count() == 0
    assert tox.fit(docs.limit(0), labels.limit(0)).least == float("inf")


def plain_score(model, text):
    """A text's score as the definitions say, without the library's scan."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    seen, scores = {}, []
    for w in (w.encode() for w in words):
        chain = [w] + [w[:k] + b"*" for k in (8, 7, 6, 5, 4) if len(w) > k]
        s = next((model.known[f] for f in chain if f in model.known), model.rest)
        if s > 0:
            seen[w] = seen.get(w, 0) + 1
            s = s if seen[w] == 1 else s / seen[w] ** 2 - tox.DRIFT
        scores.append(s)
    found = [s for _, _, s in plain_segments(scores)]
    evidence = max(0.0, model.scale * max(found, default=0.0)) * 0.1
    if max(found, default=0.0) >= model.least:
        evidence += math.sqrt(sum(max(0.0, model.scale * s - model.log_k - math.log(len(words))) for s in found if s >= model.least))
    return 1 / (1 + math.exp(-(model.slope * evidence + model.offset)))


def test_whole_scores_against_brute_force(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = tox.fit(docs, labels, usable=fold() != 0)
    rows = tox.score(docs.where("length(text) < 1500"), model).select("text", "__tox.score").collect()
    assert len(rows) > 50 and all(abs(r["score"] - plain_score(model, r["text"])) < 1e-9 for r in rows)


def test_repeated_examples_and_the_weights_kept(spark):
    docs, labels = toy(spark)
    model, more = tox.fit(docs, labels), tox.fit(docs.unionByName(docs), labels)
    assert model.known and more.known and more.scale > 0
    full = dict(model.known)
    assert all(x != tox._less(full, f) for f, x in full.items())
