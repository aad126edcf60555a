"""Reply trees and the template: exact round trips."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrand.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\", "\\\\n", "[\\INST]", "<<SYS>> x <</SYS>>", "", None, "<", "[", "<s>", "a\\<|b|>\\", "é\n\n🙂", "<\\|im_end|>", "\n", "[[INST]]", "<</s>"]


def test_round_trip_and_loss_mask(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for conv in range(40):
        turns = [(rng.choice(["user", "assistant", "system", "a\\nb", "x\ny", None]), rng.choice(NASTY)) for _ in range(rng.randint(1, 9))]
        rows += [(conv, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
        want[conv] = [(r or "", t or "") for r, t in turns]
    rng.shuffle(rows)
    made = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node string")).collect()
    assert {r["tree"]: chat.parse(r["formatted"]) for r in made} == want
    for r in made:
        under = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss"]]
        assert under == [t for role, t in want[r["tree"]] if role == "assistant"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "<", "[", "|", "/", "s>", "INST]", "n", "SYS>>", "a", "\n", "<|im_end|>\n"]), max_size=10).map("".join))
def test_unescape_undoes_escape(text):
    import re

    doubled = text.replace("\\", "\\\\")
    escaped = re.sub(chat.CONTROL, lambda m: m[0] + "\\", doubled)
    assert chat.unescape(escaped) == text
    assert not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", escaped)


def plain_paths(nodes, top):
    """nodes: (tree, node, parent, score)."""
    out = []
    for tree in {n[0] for n in nodes}:
        own = {n: (p, s) for t, n, p, s in nodes if t == tree}
        parents = {p for p, _ in own.values() if p in own}
        found = []
        for leaf in own:
            if leaf in parents:
                continue
            path, at = [], leaf
            while at in own:
                path.append(at)
                at = own[at][0]
            found.append((-sum(own[x][1] for x in path) / len(path), leaf, path[::-1]))
        for rank, (_, leaf, path) in enumerate(sorted(found)[:top], 1):
            out += [(tree, leaf, rank, d, x) for d, x in enumerate(path)]
    return sorted(out)


def test_paths_against_brute_force(spark):
    rng = random.Random(6)
    nodes = []
    for tree in range(12):
        for k in range(rng.randint(1, 25)):
            nodes.append((tree, k, rng.choice([None, 999, *range(k)]) if k else None, float(rng.randint(0, 4))))
    nodes += [(50, k, k - 1 if k else None, 1.0) for k in range(33)]
    df = spark.createDataFrame(nodes, "tree bigint, node bigint, parent bigint, score double")
    for top in (1, 3, 1000):
        got = [tuple(r) for r in chat.paths(df, top=top).select("tree", "leaf", "rank", "depth", "node").collect()]
        assert sorted(got) == plain_paths(nodes, top)


def test_branches_as_conversations(spark):
    rows = [(1, 0, None, "user", "q", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9), (1, 3, 2, "user", "thanks", 0.5)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, up bigint, role string, text string, score double")
    from pyspark.sql import functions as F

    made = chat.conversations(df, parent=F.col("up"), score=F.col("score"), top=2).orderBy("rank").collect()
    assert [[t for _, t in chat.parse(r["formatted"])] for r in made] == [["q", "good", "thanks"], ["q", "bad"]]


def test_ties_nulls_and_empty_tables(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    made = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert {r["tree"]: [t for _, t in chat.parse(r["formatted"])] for r in made} == {1: ["", "a", "a", "b"], None: ["x", "y"]}
    assert chat.conversations(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def test_a_long_conversation(spark):
    rows = [(1, k, "user" if k % 2 else "assistant", f"t{k} " + "long " * 50) for k in range(700)]
    made = chat.conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()
    assert chat.parse(made[0]["formatted"]) == [(r, t) for _, _, r, t in rows]


def test_cycles_are_left_out(spark):
    rows = [("two", 1, 2), ("two", 2, 1), ("two", 3, 2), ("two", 10, None), ("two", 11, 10)]
    rows += [("three", 1, 2), ("three", 2, 3), ("three", 3, 1), ("three", 4, 3), ("three", 5, 4), ("three", 6, 4)]
    rows += [("self", 1, 1), ("self", 2, 1), ("self", 3, None)]
    rows += [("deep", i, i - 1 if i else None) for i in range(150)] + [("deep", 1000 + i, 1000 + (i + 1) % 90) for i in range(90)] + [("deep", 5000, 1000)]
    nodes = spark.createDataFrame([(*r, 1.0) for r in rows], "tree string, node bigint, parent bigint, score double")
    got = {}
    for r in chat.paths(nodes, top=None).collect():
        got.setdefault((r["tree"], r["leaf"]), {})[r["depth"]] = r["node"]
    assert {k: [v[d] for d in sorted(v)] for k, v in got.items()} == {("two", 11): [10, 11], ("self", 3): [3], ("deep", 149): list(range(150))}
