"""Fingerprints and near duplicates against brute force."""

import random

import numpy as np
import xxhash
from lodestrand.llm import simhash
from lodestrand.llm.graph import components

WHITE = " \t\n\r\x0b\x0c"


def plain_fingerprint(text):
    words, now = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in WHITE:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, fp=plain_fingerprint):
    """rows: (id, text); the least id that each row reaches over links of at most two bits."""
    fps = [fp(t) for _, t in rows]
    distinct = sorted(set(fps))
    up = {f: f for f in distinct}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                up[root(b)] = root(a)
    least = {}
    for (ident, _), f in zip(rows, fps, strict=True):
        if ident is not None:
            least[root(f)] = min(least.get(root(f), ident), ident)
    return [least.get(root(f)) for f in fps], fps


def test_fingerprint_is_the_plain_one():
    for text in (None, "", "  \t", "One", "a b", "a b c", "A a A a a a", "é É ünï\x0bcode x", "x " * 5000, "\x00 \x1c y z", "the quick brown fox " * 3):
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 10] + " tail" * (i % 4)) for i in range(60)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "A B"), (304, "a b"), (None, base[0]), (None, "only here, without an id"), (7, base[7]), (7, base[7]), (305, "long " * 20000)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, fp int, component string")
    found = simhash.near_duplicates(docs).collect()
    want, fps = plain_components(rows)
    assert sorted((r["id"] is None, r["id"] or 0, r["fp"] % 2**64, -1 if r["component"] is None else r["component"]) for r in found) == sorted((i is None, i or 0, f, c if c is not None else -1) for (i, _), f, c in zip(rows, fps, want, strict=True))


def test_links_are_exact_in_small_and_large_cells(spark, monkeypatch):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = set(seeds)
    for s in seeds[:3]:
        for _ in range(150):
            f = s
            for b in rng.sample(range(12), rng.randint(0, 4)):
                f ^= 1 << b
            fps.add(f)
    fps |= {0, 1, 3, 2**64 - 1}
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want, _ = plain_components([(s, f) for s, f in zip(signed, fps, strict=True)], fp=lambda f: f)
    for small in (64, 2):
        monkeypatch.setattr(simhash, "SMALL_CELL", small)
        linked = components(simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp bigint")))
        roots = {r["node"]: r["root"] for r in linked.collect()}
        groups, wanted = {}, {}
        for s, w in zip(signed, want, strict=True):
            groups.setdefault(roots.get(s, s), set()).add(s)
            wanted.setdefault(w, set()).add(s)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values())), small


def test_cells_bound_the_distance():
    rng = random.Random(9)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 2):
            b ^= 1 << bit
        cells = [set(simhash.cells_of(np.array([x], np.uint64))[0].tolist()) for x in (a, b)]
        assert cells[0] & cells[1]


def test_survivors(spark):
    rows = [(5, "a b c d e", "x"), (2, "a b c d e", "y"), (9, "quite another text of words", "x"), (None, "a b c d e", None), (None, "nameless text one two", None), (None, "nameless text one two", None), (2, "a b c d e", "y"), (11, None, "n"), (10, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keep string")
    kept = simhash.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 2), (False, 9), (False, 10), (True, 0)]


def test_columns_survive(spark):
    names = ["__hash", "doc", "own", "hash", "fp", "component", "a.b"]
    docs = spark.createDataFrame([(1, "a b c d", *names), (2, "a b c d", *names)], "doc_id bigint, text string, __hash string, doc string, own string, hash string, fp string, component string, `a.b` string")
    assert [tuple(r) for r in simhash.survivors(docs).collect()] == [(1, "a b c d", *names)]


def test_links_are_found_once(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    links = simhash._links

    def counted(batches):
        calls.add(1)
        yield from links(batches)

    monkeypatch.setattr(simhash, "_links", counted)
    docs = spark.createDataFrame([(i, f"the same words {i % 3}") for i in range(50)], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 50
    assert calls.value <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.survivors(docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(200, x) for x in range(201, 260)] + [(500, 500), (600, 601), (601, 600)]
    random.Random(1).shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 0 for i in range(61)) and all(found[x] == 200 for x in range(200, 260))
    assert (found[500], found[600], found[601]) == (500, 600, 600)
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
