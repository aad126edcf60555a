"""FM-index and decontamination against brute force."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm import decontaminate as dc
from lodestrand.llm.fmindex import FMIndex, WaveletMatrix, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def plain(docs, items, window):
    """doc id -> (n_words, hit positions, item ids)."""
    windows = {}
    for ident, text in items:
        w = WORD.findall((text or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n and ident is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(ident))
    out = []
    for ident, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOW)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if s := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= s
        names = ",".join(sorted(found))
        out.append((ident, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


segments = st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=12), min_size=0, max_size=12)


@settings(max_examples=150, deadline=None)
@given(segments, st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=5), min_size=1, max_size=6), st.integers(1, 5))
def test_fm_index_finds_every_occurrence(parts, phrases, sample):
    seq = np.array([x for p in parts for x in [*p, 0]], np.int64)
    index = FMIndex(seq, 4, sample)
    lengths = np.array([len(p) for p in phrases])
    lo, hi = index.search(np.concatenate(phrases), np.cumsum(lengths) - lengths, lengths)
    for k, p in enumerate(phrases):
        want = [i for i in range(len(seq)) if seq[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[k], hi[k])).tolist()) == want


@settings(max_examples=100, deadline=None)
@given(segments)
def test_suffix_order_is_that_of_segments(parts):
    seq = np.array([x for p in parts for x in [*p, 0]], np.int64)
    ends = np.flatnonzero(seq == 0)

    def key(i):
        end = ends[np.searchsorted(ends, i)]
        return [*(seq[i:end] + len(seq)).tolist(), int(end)]

    assert suffix_order(seq).tolist() == sorted(range(len(seq)), key=key)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=40), st.integers(0, 12))
def test_wavelet_ranks(values, symbol):
    seq = np.array(values, np.int64)
    at = np.arange(len(seq) + 1)
    got = WaveletMatrix(seq, 4).rank(np.full(len(at), symbol), at)
    assert got.tolist() == [values[:i].count(symbol) for i in at]


DOCS = [(1, "the a b c d e end"), (2, "A, B! c. D e"), (3, None), (4, ""), (5, "none of it"), (6, "x a b c d y a b c d z"), (7, "short one"), (None, "a b c d"), (8, "a b c a b c d e f g " * 30), (8, "a b c d"), (9, "é été ß"), (10, "w " * 5000 + "a b c d")]
ITEMS = [(1, "a b c d e f"), (2, "short one"), (3, None), (4, " ?! "), (5, "b c d e"), (None, "none of it"), (1, "x a b c"), (6, "É ÉTÉ"), (7, "é été")]


def digests(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, *["clash"] * 6) for i, t in docs], "doc_id bigint, text string, __found string, found string, __hit string, key string, doc string, `n.words` string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    rows = dc.digest(dc.find(d, b, **options)).collect()
    return sorted((tuple(r[:6]) for r in rows), key=str), rows


def test_against_brute_force(spark, monkeypatch):
    want = plain(DOCS, ITEMS, 4)
    got, rows = digests(spark, DOCS, ITEMS, window=4)
    assert got == want
    assert all(sum(s["end"] - s["start"] for s in r["spans"]) == r["n_hit"] for r in rows)
    assert digests(spark, DOCS, ITEMS, window=4, drop_text=True)[0] == want
    assert digests(spark, DOCS, ITEMS, window=4, block_chars=12)[0] == want, "in several passes"
    monkeypatch.setattr(dc, "SHARD_SYMBOLS", 5)
    assert digests(spark, DOCS, ITEMS, window=4)[0] == want, "in many shards"


def test_test_tables(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = sorted((tuple(r[:6]) for r in dc.digest(dc.find(docs, items)).collect()), key=str)
    assert got == plain([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], 13)
    dirty = {r[0] for r in got if r[5]}
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r[0] for r in got} - dirty


def test_empty_tables(spark):
    assert digests(spark, [], ITEMS)[0] == []
    assert [r[2:4] for r in digests(spark, DOCS, [])[0]] == [(0, 0)] * len(DOCS)


def test_columns_survive(spark):
    names = ["__found", "__hit", "n_words", "key", "a.b", "item"]
    d = spark.createDataFrame([(1, "a b c d", *names), (2, "none", *names)], "doc_id bigint, text string, __found string, __hit string, n_words string, key string, `a.b` string, item string")
    b = spark.createDataFrame([(1, "a b c d"), (2, "x y z")], "item_id bigint, text string")
    for options in ({}, {"block_chars": 5}):
        assert [tuple(r) for r in dc.clean(d, b, **options).collect()] == [(2, "none", *names)]
        found = dc.find(d, b, **options)
        assert found.columns == [*d.columns, "__found_"] and {r["__found"] for r in found.collect()} == {"__found"}


def test_a_large_benchmark_takes_little_memory():
    import tracemalloc

    words = [f"w{k}" for k in range(600_000)]  # four million characters of invented words
    tracemalloc.start()
    packed = dc.Phrases.packed([("1", " ".join(words))], 13)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    phrases = dc.Phrases(*packed)
    assert len(phrases.start) == len(words) - 12 and sum(x.nbytes for x in packed[1:6]) < 30e6
