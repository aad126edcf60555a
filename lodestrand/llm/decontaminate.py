"""Benchmark decontamination with an FM-index of each training shard."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import WORDS, cut, every, fresh, mapped, named, small_side
from lodestrand.llm.fmindex import FMIndex

#: Characters of benchmark texts that one pass sends to the workers, one item at least; a larger benchmark takes several passes.
BLOCK_CHARS = 4_000_000
#: A shard is indexed when it has so many symbols or bytes of documents.
SHARD_SYMBOLS, SHARD_BYTES = 1 << 20, 32 << 20

FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"
#: words_of() as a pattern for texts as they are.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


class Phrases:
    """The distinct windows of benchmark items, as places in one sequence of symbols, with the items that hold each."""

    def __init__(self, words: bytes, symbols: np.ndarray, start: np.ndarray, lengths: np.ndarray, holder_at: np.ndarray, holders: np.ndarray, names: list[str]):
        self.symbol = {w: k + 1 for k, w in enumerate(words.split())}
        self.symbols, self.start, self.lengths = symbols, start, lengths
        self.holder_at, self.holders, self.names = holder_at, holders, names

    @staticmethod
    def packed(items: list[tuple[str, str | None]], window: int) -> tuple:
        """What a Phrases is made from: bytes, arrays and strings, which workers can read without this package."""
        names = sorted({x for x, _ in items})
        number = {x: k for k, x in enumerate(names)}
        symbol: dict[bytes, int] = {}
        parts, start, length, holder, size = [np.zeros(0, np.int32)], [], [], [], 0
        for item, text in items:
            seq = [symbol.setdefault(w, len(symbol) + 1) for w in words_of(text)]
            if seq:
                parts.append(np.array(seq, np.int32))
                n = min(window, len(seq))
                start.append(np.arange(size, size + len(seq) - n + 1))
                length.append(np.full(len(start[-1]), n))
                holder.append(np.full(len(start[-1]), number[item]))
                size += len(seq)
        symbols = np.concatenate(parts)
        start, length, holder = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (start, length, holder))
        code, most = np.zeros(len(start), np.uint64), int(length.max(initial=0))
        for j in range(most):
            code = code * np.uint64(0x9E3779B97F4A7C15) + np.where(j < length, symbols[np.minimum(start + j, max(0, size - 1))], 0).astype(np.uint64)
        order = np.lexsort((holder, code, length))
        start, length, holder, code = start[order], length[order], holder[order], code[order]
        # Windows of one code are one only if they are the same, symbol by symbol.
        same = (length[1:] == length[:-1]) & (code[1:] == code[:-1])
        for j in range(most):
            same &= (j >= length[1:]) | (symbols[np.minimum(start[1:] + j, max(0, size - 1))] == symbols[np.minimum(start[:-1] + j, max(0, size - 1))])
        first = np.concatenate([[True], ~same]) if len(start) else np.zeros(0, bool)
        group = np.cumsum(first) - 1
        once = first | np.concatenate([[True], holder[1:] != holder[:-1]]) if len(start) else first
        holder_at = np.concatenate([[0], np.cumsum(np.bincount(group[once], minlength=int(first.sum())))]).astype(np.int64)
        return b" ".join(symbol), symbols, start[first], length[first], holder_at, holder[once], names


def _expand(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k, count[k] numbers from start[k] on; and the k of each."""
    who = np.repeat(np.arange(len(count)), count)
    return np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + start[who], who


class Shard:
    """Documents collected until they are indexed and searched together.

    Only runs of benchmark words as long as the shortest window are indexed: a window lies within
    such a run, so nothing is lost.
    """

    def __init__(self, phrases: Phrases):
        self.phrases, self.least = phrases, int(phrases.lengths.min(initial=1 << 30))
        self.words: list[int] = []
        self.parts: list[np.ndarray] = []
        self.part_doc: list[int] = []
        self.part_at: list[int] = []
        self.symbols = 0

    def add(self, text: str | None) -> None:
        words = words_of(text)
        doc = len(self.words)
        self.words.append(len(words))
        if len(words) < self.least:
            return
        get = self.phrases.symbol.get
        seq = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[0], seq != 0, [0]])))
        start, end = edge[::2], edge[1::2]
        for s, e in zip(start[end - start >= self.least], end[end - start >= self.least], strict=True):
            self.parts += [seq[s:e], np.zeros(1, np.int64)]
            self.part_doc.append(doc)
            self.part_at.append(s)
            self.symbols += e - s + 1

    def spans(self) -> tuple[list[list[dict]], list[list[str]]]:
        """For each document the merged spans of word positions that windows occupy, and the items found."""
        spans: list[list[dict]] = [[] for _ in self.words]
        items: list[list[str]] = [[] for _ in self.words]
        if not self.parts:
            return spans, items
        phrases, seq = self.phrases, np.concatenate(self.parts)
        index = FMIndex(seq, len(phrases.symbol))
        lo, hi = index.search(phrases.symbols, phrases.start, phrases.lengths)
        rows, phrase = _expand(lo, hi - lo)
        at = index.locate(rows)
        size = np.array([len(p) for p in self.parts[::2]])
        begin = np.concatenate([[0], np.cumsum(size + 1)])
        part_doc, part_at = np.array(self.part_doc), np.array(self.part_at)
        cover = np.zeros(len(seq) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.lengths[phrase], -1)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]])))
        for s, e in zip(edge[::2], edge[1::2], strict=True):  # a span never leaves its run, as a 0 follows it
            part = np.searchsorted(begin, s, "right") - 1
            shift = part_at[part] - begin[part]
            spans[part_doc[part]].append({"start": int(s + shift), "end": int(e + shift)})
        found = np.unique(part_doc[np.searchsorted(begin, at, "right") - 1] * len(phrases.lengths) + phrase)
        doc, phrase = found // len(phrases.lengths), found % len(phrases.lengths)
        holder, who = _expand(phrases.holder_at[phrase], phrases.holder_at[phrase + 1] - phrases.holder_at[phrase])
        for pair in np.unique(doc[who] * len(phrases.names) + phrases.holders[holder]):
            items[pair // len(phrases.names)].append(phrases.names[pair % len(phrases.names)])
        return spans, items


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_chars: int = BLOCK_CHARS, drop_text: bool = False) -> DataFrame:
    """docs with a struct as last column, ``__found``: n_words, spans (removal spans of word positions, end
    exclusive, disjoint and in order) and items (ids as strings, in order) whose windows occur.

    Texts are lower-cased (A-Z) and split into words of digits, letters and non-ASCII characters. A
    window is ``window`` consecutive words of an item, or the whole item if it has fewer. Each task
    gathers documents to a shard, builds an FM-index of it, searches all windows backward through
    the wavelet tree, locates the occurrences from sampled suffixes and merges their spans. There is
    no shuffle. The benchmark's size is measured first: a block of it goes to the workers at a time. With
    several blocks, each pass keeps digests and spans of the texts that it hits, which are
    joined with docs at the end.

    Null texts have no words; items with a null id, and items without words, are passed over;
    items that share an id count once. An empty benchmark finds nothing, empty docs give no rows.
    Repeated rows stay, and all columns of docs do whatever their names: if one is called
    ``__found``, ours gets an underscore more. Texts may be of any length.
    """
    items = benchmark.where(named(item_col).isNotNull()).select(named(item_col).cast("string").alias("item"), named(item_text_col).cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    text = named(text_col).cast("string")
    out = docs.withColumn(fresh(docs, "__found"), F.lit(None).cast(FOUND))
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]

    def shared(block: int):
        held = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()]
        return docs.sparkSession.sparkContext.broadcast(Phrases.packed(held, window))

    if blocks == 1:
        return mapped(out, _finder(shared(0), docs.columns.index(text_col), drop_text), [*kept, out.columns[-1]])
    texts, parts = docs.select(F.md5(text).alias("key"), text.alias("text"), F.lit(None).cast(FOUND).alias("found")).where("text IS NOT NULL"), []
    for block in range(blocks):
        hit = mapped(texts, _finder(shared(block), 1, True), ["key", "found"]).where("size(found.items) > 0")
        parts.append(cut(hit.dropDuplicates(["key"])))
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = cut(hits.groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("found.spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items")))
    rows = docs.select(every(docs).alias("doc"), F.md5(text).alias("key"), F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_words"))
    rows = rows.join(small_side(hits, hits.count(), HIT_ROWS), "key", "left")
    whole = F.struct("n_words", F.coalesce(_merged("spans"), F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return rows.select("doc", whole.alias("found")).select(*[F.col("doc")[c].alias(c) for c in kept], F.col("found").alias(out.columns[-1]))


#: Texts with hits that go to all workers at most; more are joined by a shuffle.
HIT_ROWS = 10_000


def _merged(spans: str):
    """A sorted array of spans as disjoint ones in order."""
    last = lambda held: F.element_at(held, -1)

    def step(held, s):
        longer = F.struct(last(held)["start"].alias("start"), F.greatest(last(held)["end"], s["end"]).alias("end"))
        return F.when((F.size(held) > 0) & (F.try_element_at(held, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(spans, F.array().cast("array<struct<start:int,end:int>>"), step)


def _finder(shared, text_at: int, drop_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(*shared.value)
        shard, held = Shard(phrases), []
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            spans, items = shard.spans()
            at = 0
            for batch in held:
                found = [{"n_words": shard.words[k], "spans": spans[k], "items": sorted(items[k])} for k in range(at, at + batch.num_rows)]
                at += batch.num_rows
                columns = [*batch.columns[:-1], pa.array(found, batch.schema.field(batch.num_columns - 1).type)]
                keep = [k for k in range(len(columns)) if not (drop_text and k == text_at)]
                yield pa.RecordBatch.from_arrays([columns[k] for k in keep], [batch.schema.names[k] for k in keep])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for text in part.column(text_at):
                    text = text.as_py()
                    shard.add(text)
                    size += len(text or "")
                held.append(part)
                if shard.symbols >= SHARD_SYMBOLS or size >= SHARD_BYTES:
                    yield from done()
                    shard, held, size = Shard(phrases), [], 0
        yield from done()

    return run


def _hit(found):
    return F.aggregate(found["spans"], F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of find()'s result: counts, digest of the items and the verdict.

    A document is contaminated if at least a twentieth of its words, and at least one, are hit.
    """
    f = named(found.columns[-1])
    out = found.select(
        named(id_col), f["n_words"].alias("n_words"), _hit(f).alias("n_hit"),
        F.size(f["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(f["items"])), 256).alias("items_sha256"),
        f["spans"].alias("spans"),
    )
    return out.select(named(id_col), "n_words", "n_hit", "n_items", "items_sha256", F.expr("n_hit > 0 AND 20 * n_hit >= n_words").alias("contaminated"), "spans")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, with the same columns, whatever their names."""
    found = find(docs, benchmark, **options)
    f = named(found.columns[-1])
    return found.where(~((_hit(f) > 0) & (20 * _hit(f) >= f["n_words"]))).select(*map(named, docs.columns))
