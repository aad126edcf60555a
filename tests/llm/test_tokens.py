"""Token attribution against a tokenizer's own offsets."""

import random

import pytest
from lodestrand.llm import tokens
from tokenizers import Tokenizer


def plain(text, edges, rule, tokenizer):
    """edges in characters; counts per section from the offsets that another library gives."""
    out = [0.0] * (len(edges) - 1)
    for start, end in tokenizer.encode(text, add_special_tokens=False).offsets:
        share = [max(0, min(end, edges[s + 1]) - max(start, edges[s])) for s in range(len(out))]
        first = next(s for s in range(len(out)) if edges[s] <= start < edges[s + 1])
        if rule == "start":
            out[first] += 1
        elif rule == "largest":
            out[share.index(max(share))] += 1
        else:
            out = [o + x / sum(share) for o, x in zip(out, share, strict=True)]
    return out


def line_edges(text):
    edges = [0]
    for k, c in enumerate(text):
        if c == "\n":
            edges.append(k + 1)
    return edges if edges[-1] == len(text) else [*edges, len(text)]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_lines_against_offsets(spark, rule):
    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    rng = random.Random(3)
    texts = ["".join(rng.choice([" ", "\n", "\n\n", "word", "the ", "x1", " 'll", "  ", "!"]) for _ in range(40)) for _ in range(60)] + ["plain", "\n", "a\n\n\n\nb", "long " * 20000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, sections string")
    for r in tokens.count(docs, rule=rule).collect():
        text = texts[r["id"]]
        edges = line_edges(text)
        assert [s["start"] for s in r["sections"]] == edges[:-1] and [s["end"] for s in r["sections"]] == edges[1:]
        want = plain(text, edges, rule, tokenizer)
        assert [s["n_tokens"] for s in r["sections"]] == pytest.approx(want), text[:80]
        assert sum(s["n_tokens"] for s in r["sections"]) == pytest.approx(len(tokenizer.encode(text, add_special_tokens=False).ids))


def test_fields(spark):
    tokenizer = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    docs = spark.createDataFrame([(1, "A title", "the body text", None), (2, None, "b", "c"), (3, "", "", "")], "doc_id bigint, title string, text string, tail string")
    got = {r["id"]: r["sections"] for r in tokens.count(docs, fields=["title", "text", "tail"]).collect()}
    assert [s["name"] for s in got[1]] == ["title", "text"]
    assert sum(s["n_tokens"] for s in got[1]) == len(tokenizer.encode("A title\nthe body text\n").ids)
    assert [(s["name"], s["start"], s["end"]) for s in got[2]] == [("title", 0, 1), ("text", 1, 3), ("tail", 3, 4)]


def test_non_ascii_null_repeated_and_empty(spark):
    docs = spark.createDataFrame([(1, "été\nüber 🙂🙂\nñ"), (2, None), (3, ""), (None, "x"), (1, "été\nüber 🙂🙂\nñ")], "doc_id bigint, text string")
    rows = tokens.count(docs).collect()
    by = {r["id"]: r["sections"] for r in rows}
    assert len(rows) == 5 and by[2] == [] and by[3] == [] and len(by[None]) == 1
    assert [(s["start"], s["end"]) for s in by[1]] == [(0, 4), (4, 12), (12, 13)]
    encoder = tokens.Encoder("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert sum(s["n_tokens"] for s in by[1]) == len(encoder.spans("été\nüber 🙂🙂\nñ")[0])
    assert tokens.count(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.count(docs, rule="other")
