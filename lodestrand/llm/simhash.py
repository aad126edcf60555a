"""Near-duplicate documents by SimHash fingerprints and a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import LOWER, cut, every, named
from lodestrand.llm.graph import components

#: Segments of two bits. Their bit counts, 0 to 2 in two bits each, fill one 64-bit cell number.
SEGMENTS = 32
#: A cell of up to this many fingerprints is compared pair by pair; a larger one through midpoints.
SMALL_CELL = 64

_LOW = np.uint64(0x5555555555555555)
_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
_STEP = np.uint64(1) << np.arange(0, 64, 2, dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats counted; 0 without words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not tokens:
        return 0
    if len(tokens) <= words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.uint64, max(1, len(tokens) - words + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(_BIT[2 * counts > len(hashes)].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash: long, fp: long) for each row of docs, repeated rows included. Null texts have no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    kind, text = docs.schema[id_col].dataType.simpleString(), named(text_col).cast("string")
    return docs.select(named(id_col).alias("id"), text.alias("t"), F.xxhash64(text).alias("h")).mapInArrow(run, f"id {kind}, text_hash bigint, fp bigint")


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of fp): the popcount cell of each fingerprint and all cells one step away.

    Segment bit counts embed fingerprints so that the Manhattan distance of two embeddings never
    exceeds their Hamming distance. Points at Manhattan distance 2 share a cell at most one step
    from both, so joining on these cells misses no link.
    """
    own = (fps & _LOW) + ((fps >> np.uint64(1)) & _LOW)
    level = (own[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    up, down = np.nonzero(level < 2), np.nonzero(level > 0)
    return (np.concatenate([own, own[up[0]] + _STEP[up[1]], own[down[0]] - _STEP[down[1]]]), np.concatenate([np.arange(len(fps)), up[0], down[0]]))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(every), 4096):
            fps = every[at : at + 4096]
            cell, who = cells_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(fps[who].view(np.int64))], ["cell", "fp"])


def _pairs(cell: np.uint64, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among a small cell's fingerprints that differ in at most two bits."""
    i, j = np.triu_indices(len(fps), 1)
    keep = np.bitwise_count(fps[i] ^ fps[j]) <= 2
    return fps[i[keep]], fps[j[keep]]


def _midpoints(cell: np.uint64, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from fingerprints to the values of this cell that differ in at most one bit.

    Two fingerprints link exactly if they have such a midpoint in common, so with midpoints as
    nodes the components are exact and a cell costs 65 edges a fingerprint, however large it is.
    """
    mid = np.concatenate([fps[:, None], fps[:, None] ^ _BIT[None, :]], axis=1)
    row, col = np.nonzero((mid & _LOW) + ((mid >> np.uint64(1)) & _LOW) == cell)
    return mid[row, col], fps[row]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified edges from rows (cell, fp) that come sorted by cell; a run of equal cells may span batches."""
    none = np.zeros(0, np.uint64)
    cell, held, large = np.uint64(0), none, False

    def edges(make, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(fps), 4096):
            u, v = make(cell, fps[at : at + 4096])
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    for batch in batches:
        cells = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        start = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])) if len(cells) else none
        end = np.append(start[1:], len(cells))
        own = np.flatnonzero(end - start > 1) if len(start) else none  # a run of one links to nothing here
        for k in np.unique(np.concatenate([own, [0, len(start) - 1]])).astype(int) if len(start) else ():
            if cells[start[k]] != cell:
                yield from edges(_pairs, none if large else held)
                cell, held, large = cells[start[k]], none, False
            held = np.concatenate([held, fps[start[k] : end[k]]])
            if large or len(held) > SMALL_CELL:  # what has come is let go at once: a large cell takes no memory
                large = True
                yield from edges(_midpoints, held)
                held = none
    yield from edges(_pairs, none if large else held)


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (u, v) that connect exactly the distinct fingerprints (fp: long) at Hamming distance 2 or less.

    Grid range-join: every fingerprint goes to its own popcount cell and those one step away (49
    rows on average), cells meet in a sort by cell, and what meets is verified on all 64 bits.
    """
    rows = fps.select("fp").mapInArrow(_cells, "cell bigint, fp bigint")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, text_hash, fp: long, component): each row's fingerprint and the least id reachable over links.

    Fingerprints link at two or fewer differing bits; documents without words have fingerprint 0
    and link like any other. Exact copies collapse to one fingerprint by a partial aggregate
    before anything is joined. Null texts count as empty. Rows with a null id get a component, but
    a null id is never the least one unless all are null. Repeated rows stay repeated. An empty
    table gives an empty result; other columns of docs do not matter.
    """
    rows = cut(fingerprints(docs, id_col, text_col, words))
    fps = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    linked = components(cut(link_fingerprints(fps)))  # the rounds read the links several times
    roots = fps.join(linked.withColumnRenamed("node", "fp"), "fp").groupBy("root").agg(F.min("least").alias("component"))
    named = linked.join(roots, "root").select(F.col("node").alias("fp"), "component")
    # Cut off, so that the last join has nothing but shuffled sides and Spark can split a fingerprint of very many copies.
    named = cut(fps.join(named, "fp", "left").select("fp", F.coalesce("component", "least").alias("component")))
    return rows.join(named, "fp").select("id", "text_hash", "fp", "component")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """docs with one row of each near-duplicate component left: the one with the least id.

    Of several rows with that id, one with the least hash of its text stays. Where every id of a
    component is null, one of its rows stays. Texts may be null, empty or of any length; an empty table stays empty. The columns are those of docs, whatever
    their names; of rows equal in id and text the other columns are those of one row.
    """
    near = near_duplicates(docs, id_col, text_col, words)
    keep = near.where("id = component").groupBy("id").agg(F.min("text_hash").alias("text_hash"))
    rows = docs.select(every(docs).alias("doc"), named(id_col).alias("own"), F.xxhash64(named(text_col).cast("string")).alias("hash"))
    held = rows.join(keep, (F.col("own") == F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi").dropDuplicates(["own", "hash"])
    alone = near.where("component IS NULL").groupBy("fp").agg(F.min("text_hash").alias("text_hash")).select("text_hash").distinct()
    nameless = rows.where("own IS NULL").join(alone, F.col("hash") == F.col("text_hash"), "left_semi").dropDuplicates(["hash"])
    return held.unionByName(nameless).select(*[F.col("doc")[c].alias(c) for c in docs.columns])
