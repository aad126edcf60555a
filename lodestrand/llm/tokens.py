"""Token counts attributed to sections by character offsets."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the tokenizers' files lie on every machine.
TOKENIZERS = "/opt/tokenizers"
#: How byte-level BPE vocabularies split a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

RULES = ("start", "largest", "split")


class Encoder:
    """A byte-level BPE tokenizer from a file of ranks, with each token's length in bytes."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in bytes; together they are the whole text."""
        ids = np.array(self.core.encode_ordinary(text), np.int64)
        end = np.cumsum(self.length[ids])
        return end - self.length[ids], end


def attribute(start: np.ndarray, end: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of them cross a boundary.

    start, end: token spans, in order; edges: the sections' boundaries, first and last included.
    A crossing token goes by the rule: to the section of its first byte (start), to the one it shares most
    with, the earlier of equals (largest), or to all in proportion (split).
    """
    n = len(edges) - 1
    first = np.searchsorted(edges, start, "right") - 1
    last = np.maximum(first, np.searchsorted(edges, end, "left") - 1)
    first, last = np.minimum(first, n - 1), np.minimum(last, n - 1)
    cross = np.flatnonzero(last > first)
    crossing = np.bincount(first[cross], minlength=n)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(float), crossing
    inside = np.delete(first, cross)
    out = np.bincount(inside, minlength=n).astype(float)
    for t in cross:
        share = np.array([min(end[t], edges[s + 1]) - max(start[t], edges[s]) for s in range(first[t], last[t] + 1)])
        if rule == "split":
            out[first[t] : last[t] + 1] += share / share.sum()
        else:
            out[first[t] + int(share.argmax())] += 1
    return out, crossing


def line_edges(data: bytes) -> np.ndarray:
    """Boundaries of a text's lines in bytes; a line keeps its line end."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return np.unique(np.concatenate([[0], ends, [len(data)]]))


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields: list[str] | None = None, rule: str = "start", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = TOKENIZERS) -> DataFrame:
    """(id, sections) for each row of docs; a section has name, start, end (characters), n_tokens, n_crossing.

    Without ``fields``, the sections are the lines of the text, named by number from 0. With fields
    (string columns), a document is their values joined by line ends, a section a field. Each whole
    document is encoded once; token spans then meet section spans in one pass over both in order.
    Token counts of a document's sections always add up to the tokens of the whole. Null texts and
    fields are empty; an empty text has no sections and an empty field none of its own, only its
    line end. Repeated rows stay repeated.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (fields or [text_col])]
    rows = docs.select(F.col(id_col).alias("id"), *[c.alias(f"f{k}") for k, c in enumerate(columns)])
    path, whole, width = f"{folder}/{vocabulary}", fields is None, len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, size, name, places, tokens, crossings = batch.slice(at, 500), [0], [], [], [], []
                for k in range(part.num_rows):
                    values = [part.column(c + 1)[k].as_py() for c in range(width)]
                    text = "\n".join(values)
                    data = text.encode("utf-8", "surrogatepass")
                    if whole:
                        edges = line_edges(data)
                        names = list(map(str, range(len(edges) - 1)))
                    else:
                        sizes = [len(v.encode("utf-8", "surrogatepass")) + (c < len(values) - 1) for c, v in enumerate(values)]
                        names = [f for f, s in zip(fields, sizes, strict=True) if s]
                        edges = np.concatenate([[0], np.cumsum([s for s in sizes if s])]).astype(np.int64)
                    n, crossing = attribute(*encoder.spans(text), edges, rule) if len(edges) > 1 else (np.zeros(0), np.zeros(0, np.int64))
                    character = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])[edges]
                    name += names
                    places.append(np.stack([character[:-1], character[1:]]))
                    tokens.append(n)
                    crossings.append(crossing)
                    size.append(size[-1] + len(names))
                places = np.concatenate(places, axis=1)
                struct = pa.StructArray.from_arrays([pa.array(name, pa.string()), pa.array(places[0].astype(np.int64)), pa.array(places[1].astype(np.int64)), pa.array(np.concatenate(tokens)), pa.array(np.concatenate(crossings).astype(np.int64))], ["name", "start", "end", "n_tokens", "n_crossing"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(size, pa.int32()), struct)], ["id", "sections"])

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, sections array<struct<name:string,start:bigint,end:bigint,n_tokens:double,n_crossing:bigint>>")
