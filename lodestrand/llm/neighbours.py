"""Nearest neighbours by inner product: collision counting over sorted projections, with windows that widen by virtual rehashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import cut

#: Vectors and bytes that one block's index holds at most, and bytes of vectors that wait for theirs.
INDEX_ROWS, INDEX_BYTES, HELD_BYTES = 16_384, 64 << 20, 64 << 20
#: Vectors of the sample that fixes each query's radius, on average, queries that one pass sends to the workers, and bytes of either at most.
SAMPLE_ROWS, QUERY_ROWS, SENT_BYTES = 4096, 20_000, 32 << 20
#: Projections: one rotation's worth where a vector's length lies in this range, else so many.
PROJECTIONS = (64, 128)
#: A window reaches so many times as far as a vector at the radius is off, on average; the share of vectors just at the radius that may have too few collisions.
REACH, MISSED = 1.75, 0.05
#: Norms from one class to the next, the first radius (of a longest norm of 1), and each radius to the one before.
NORM_STEP, FIRST_RADIUS, RADIUS_STEP = 1.15, 1 / 8, 1.25
#: For rounding, in units of the longest norm.
SLACK = 1e-7


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, and all components finite numbers."""
    value = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(value(x)) & (F.abs(value(x)) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: value(x) != 0), F.lit(False))


_KNOWN: dict[int, tuple[np.ndarray, int]] = {}


def _basis(size: int) -> tuple[np.ndarray, int]:
    """projections() and threshold(), kept for the next block. (A function with a cache of Python's own can't be sent by value.)"""
    if size not in _KNOWN:
        rng, least, most = np.random.default_rng([7, size]), *PROJECTIONS
        rows: list[np.ndarray] = []
        while sum(map(len, rows)) < min(max(size, least), most):
            q, r = np.linalg.qr(rng.standard_normal((size, min(size, most))))
            rows.append((q * np.sign(np.diag(r))).T)
        basis = np.concatenate(rows)
        u = np.random.default_rng([11, size]).standard_normal((4096, size))
        u /= np.sqrt((u**2).sum(axis=1))[:, None]
        hits = (np.abs(u @ basis.T) <= REACH / math.sqrt(size)).sum(axis=1)
        _KNOWN[size] = basis, int(np.quantile(hits, MISSED, method="lower"))
    return _KNOWN[size]


def projections(size: int) -> np.ndarray:
    """Unit vectors to project on, a row each: of random rotations, so that one vector's errors cancel out within a rotation."""
    return _basis(size)[0]


def threshold(size: int) -> int:
    """Collisions that all but MISSED of random unit vectors have with the origin in windows of REACH."""
    return _basis(size)[1]


def norm_class(norms: np.ndarray) -> np.ndarray:
    """A number for each range of norms; longest_norm() of it is never exceeded, and norms of one reach theirs."""
    return np.ceil(np.log(norms * (1 - 1e-5)) / math.log(NORM_STEP)).astype(np.int64)


def longest_norm(kind: int) -> float:
    return NORM_STEP**kind * (1 + 2e-5)


class Index:
    """Sorted projections of vectors of one length and one class of norms.

    With the longest norm M of the class, x goes to (x, sqrt(M^2 - |x|^2)) / M and a query q to (q, 0) / |q|: all
    of length 1, and the nearer, the larger the inner product. Vectors whose product with q is at
    least b |q| lie within sqrt(2 (1 - b / M)) of the query.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, kind: int, k: int):
        # Copies are searched as one vector. Ties go to smaller ids, so only the k + 1 least can be asked for.
        bits = np.ascontiguousarray(vectors).view(np.uint64)
        order = np.lexsort((ids, (bits * np.random.default_rng(3).integers(1, 1 << 63, bits.shape[1], np.uint64)).sum(axis=1)))
        vectors, ids = vectors[order], ids[order]
        fresh = np.concatenate([[True], (vectors[1:] != vectors[:-1]).any(axis=1)])
        once = fresh | np.concatenate([[True], ids[1:] != ids[:-1]])
        vectors, ids, fresh = vectors[once], ids[once], fresh[once]
        start = np.flatnonzero(fresh)
        place = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
        self.vectors, self.ids = vectors[start], ids[place <= k]
        self.counts = np.bincount(np.cumsum(fresh)[place <= k] - 1)
        self.starts = np.cumsum(self.counts) - self.counts
        self.longest, size = longest_norm(kind), vectors.shape[1] + 1
        rest = np.sqrt(np.maximum(0.0, 1 - (self.vectors**2).sum(axis=1) / self.longest**2))
        at = np.concatenate([self.vectors / self.longest, rest[:, None]], axis=1) @ projections(size).T
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.values = np.take_along_axis(at.T, self.order, axis=1)
        self.needed = threshold(size)

    def radius(self, bound: np.ndarray) -> np.ndarray:
        """How far from the query vectors may lie whose product is at least ``bound`` times the query's norm; negative: nowhere."""
        return np.where(bound > self.longest, -1.0, np.sqrt(np.maximum(0.0, 2 * (1 - bound / self.longest))))

    def windows(self, at: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in each sorted array each query's window begins and ends; at: a row of projections a query."""
        width = REACH * radius / math.sqrt(self.vectors.shape[1] + 1) + SLACK
        lo = np.stack([np.searchsorted(v, a - width, "left") for v, a in zip(self.values, at.T, strict=True)], axis=1)
        hi = np.stack([np.searchsorted(v, a + width, "right") for v, a in zip(self.values, at.T, strict=True)], axis=1)
        return lo, hi

    def colliding(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Vectors with enough collisions in one query's windows. What lies outside the windows is less, so that is counted."""
        outside = [part for order, a, b in zip(self.order, lo.tolist(), hi.tolist(), strict=True) for part in (order[:a], order[b:])]
        return np.flatnonzero(np.bincount(np.concatenate(outside), minlength=len(self.vectors)) <= len(self.order) - self.needed)

    def verify(self, query: np.ndarray, own: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, but the query's own, and exact inner products of the found vectors; an id of several vectors stands several times."""
        score, n = (self.vectors[found] * query).sum(axis=1), self.counts[found]
        if (n > 1).any():
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ids, score = self.ids[np.repeat(self.starts[found], n) + within], np.repeat(score, n)
        else:
            ids = self.ids[self.starts[found]]
        other = ids != own
        return ids[other], score[other]


def best(ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k ids of the largest scores, each once, ties to smaller ids."""
    order = np.lexsort((ids, -score))
    ids, score = ids[order], score[order]
    by_id = np.sort(ids)
    if (by_id[1:] == by_id[:-1]).any():
        first = np.sort(np.unique(ids, return_index=True)[1])
        ids, score = ids[first], score[first]
    return ids[:k], score[:k]


def _unit(queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of queries and the projections of their directions."""
    norms = np.sqrt((queries**2).sum(axis=1))
    size = queries.shape[1] + 1
    return norms, (queries / norms[:, None]) @ projections(size)[:, :-1].T


def expand(indexes: list[Index], queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The k best of the indexed vectors for each query, by virtual rehashing.

    The radius starts small and grows step by step; with it all windows widen about the query, and
    only what they newly cover is counted. Vectors that reach the threshold of collisions are verified. A query's
    search ends when its k-th best verified product is as large as any beyond the radius could be.
    """
    norms, at = _unit(queries)
    longest, radius = max(x.longest for x in indexes), FIRST_RADIUS
    counts = [np.zeros((len(queries), len(x.vectors)), np.int32) for x in indexes]
    verified = [np.zeros((len(queries), len(x.vectors)), bool) for x in indexes]
    covered: list = [None] * len(indexes)
    held = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
    live = np.arange(len(queries))
    while len(live):
        bound = np.array([longest * (1 - radius**2 / 2)])
        for i, x in enumerate(indexes):
            reach = x.radius(bound)
            if reach[0] < 0:
                continue
            lo, hi = x.windows(at, reach)
            if covered[i] is None:
                covered[i] = [(a, a) for a in lo.tolist()]
            for q in live[(hi - lo)[live].sum(axis=1) >= x.needed].tolist():  # with fewer, none can have enough collisions
                now, before = (lo[q].tolist(), hi[q].tolist()), covered[i][q]
                covered[i][q] = now
                ends = zip(x.order, *now, *before, strict=True)
                new = [part for order, a, b, c, d in ends for part in (order[a:c], order[d:b])]
                counts[i][q] += np.bincount(np.concatenate(new), minlength=len(x.vectors))
                found = np.flatnonzero((counts[i][q] >= x.needed if radius < 2 else True) & ~verified[i][q])
                if len(found):
                    verified[i][q, found] = True
                    ids, score = x.verify(queries[q], own[q], found)
                    held[q] = best(np.concatenate([held[q][0], ids]), np.concatenate([held[q][1], score]), k)
        if radius >= 2:
            break
        done = [len(held[q][0]) >= k and held[q][1][-1] >= bound[0] * norms[q] for q in live.tolist()]
        live = live[~np.array(done)]
        radius *= RADIUS_STEP
    return held


class _Held:
    """Vectors that wait until a block of their length and class of norms is full."""

    def __init__(self, k: int):
        self.k, self.rows, self.bytes = k, {}, 0

    def add(self, batch: pa.RecordBatch, sizes) -> Iterator[Index]:
        """Takes the rows (id, v) whose vectors have one of ``sizes``; gives the indexes that this fills."""
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        offsets = batch.column(1).offsets.to_numpy()
        flat = batch.column(1).values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        for size in np.unique(lengths).tolist():
            if size not in sizes:
                continue
            rows = np.flatnonzero(lengths == size)
            vectors = flat[offsets[rows][:, None] + np.arange(size)]
            kinds = norm_class(np.sqrt((vectors**2).sum(axis=1)))
            for kind in np.unique(kinds).tolist():
                own = kinds == kind
                self.rows.setdefault((size, kind), []).append((vectors[own], ids[rows[own]]))
                self.bytes += vectors[own].nbytes
                most = max(256, min(INDEX_ROWS, INDEX_BYTES // (8 * (size + 3 * len(projections(size + 1))))))
                if sum(len(i) for _, i in self.rows[size, kind]) >= most:
                    yield self.pop((size, kind))
        while self.bytes > HELD_BYTES:
            yield self.pop(max(self.rows, key=lambda x: sum(v.nbytes for v, _ in self.rows[x])))

    def pop(self, key: tuple[int, int]) -> Index:
        vectors, ids = (np.concatenate(x) for x in zip(*self.rows.pop(key), strict=True))
        self.bytes -= vectors.nbytes
        return Index(vectors, ids, key[1], self.k)

    def rest(self) -> Iterator[Index]:
        for key in sorted(self.rows):
            yield self.pop(key)


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(query_id, rank from 1, id, score) of the k largest inner products found for each query; scores are exact.

    queries: a condition on rows; every other row is a candidate, a row with the query's id never.
    First each query is searched in an index of a sample of about ``sample_rows`` rows by hash of the id: its
    windows widen until the k best are found, and the k-th product bounds from below what the
    whole table's k-th can be. Then every row is indexed, in blocks of whatever a task holds, and vectors with enough
    collisions in windows of that radius are verified. Radius and windows are the same in all blocks, so what is
    found doesn't depend on how the table is dealt. Blocks whose longest norm rules them out are passed over.
    If the sample has fewer than k candidates of a query's length, all of them are verified.

    Queries and the sample are broadcast, within ``query_rows``, ``sample_rows`` and SENT_BYTES; more queries take more
    passes. Only products above a query's bound are shuffled, k for each query and block at most.

    Vectors null, zero or not finite, and null ids, take no part; vectors meet only those of their own length. An id's
    repeated query rows count once (the least vector), its repeated candidate rows too (the best
    score); copies under other ids all count, ties going to smaller ids. An empty table and a condition without rows
    give no rows. Other columns of rows don't matter, whatever their names; long vectors make blocks of fewer rows.
    """
    vectors = rows.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    vectors = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n, n_asked, width = vectors.agg(F.count("*"), F.count_if("asks"), F.max(F.size("v"))).first()
    fit = max(k + 1, SENT_BYTES // (8 * (width or 1)))
    picked = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(min(1.0, min(sample_rows, fit) / max(1, n)) * (1 << 30))
    context = rows.sparkSession.sparkContext
    sample = context.broadcast(_packed(vectors.where(picked).select("id", "v")))
    asked = vectors.where("asks").groupBy("id").agg(F.min("v").alias("v")).repartition(max(1, min(4096, n_asked // 256)), "id")
    asked = cut(asked.mapInArrow(_bounder(sample, k), "id bigint, v array<double>, bound double, ids array<bigint>, scores array<double>"))
    parts = [asked.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))]
    blocks = max(1, -(-n_asked // min(query_rows, fit)))
    for block in range(blocks):
        held = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "v", "bound")
        shared = context.broadcast(_packed(held))
        found = vectors.select("id", "v").mapInArrow(_searcher(shared, k), "query_id bigint, id bigint, score double")
        parts.append(cut(found) if blocks > 1 else found)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _packed(rows: DataFrame) -> dict[int, tuple[np.ndarray, ...]]:
    """Rows (id, v, ...) of a bounded number as arrays, by the vectors' length."""
    table = rows.toArrow().combine_chunks()
    out = {}
    for batch in table.to_batches():
        offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy(zero_copy_only=False)
        lengths = np.diff(offsets)
        for size in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == size)
            rest = [batch.column(c).to_numpy(zero_copy_only=False)[own] for c in (0, *range(2, batch.num_columns))]
            out.setdefault(size, []).append((rest[0], flat[offsets[own][:, None] + np.arange(size)], *rest[1:]))
    return {size: tuple(map(np.concatenate, zip(*parts, strict=True))) for size, parts in out.items()}


def _bounder(sample, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes: dict[int, list[Index]] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 128):
                batch = whole.slice(first, 128)
                own, found = batch.column(0).to_numpy(zero_copy_only=False), [(np.zeros(0, np.int64), np.zeros(0))] * batch.num_rows
                queries = [v.values.to_numpy(zero_copy_only=False) for v in batch.column(1)]
                lengths = np.array([len(v) for v in queries])
                for size in np.unique(lengths).tolist():
                    if size not in sample.value:
                        continue
                    if size not in indexes:
                        ids, vectors = sample.value[size]
                        kinds = norm_class(np.sqrt((vectors**2).sum(axis=1)))
                        indexes[size] = [Index(vectors[kinds == x], ids[kinds == x], x, k) for x in np.unique(kinds).tolist()]
                    rows = np.flatnonzero(lengths == size)
                    for row, one in zip(rows.tolist(), expand(indexes[size], np.array([queries[r] for r in rows]), own[rows], k), strict=True):
                        found[row] = one
                bound = [float(score[-1]) if len(ids) == k else -math.inf for ids, score in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bound, pa.float64()), pa.array([x[0] for x in found], pa.list_(pa.int64())), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["id", "v", "bound", "ids", "scores"])

    return run


def _searcher(shared, k: int):
    def search(index: Index, asked: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        own, queries, bound = asked
        for first in range(0, len(own), 512):
            part = slice(first, first + 512)
            norms, at = _unit(queries[part])
            radius = np.minimum(index.radius(bound[part] / norms), 4.0)  # beyond 2, where all are
            lo, hi = index.windows(at, radius)
            out: list[list[np.ndarray]] = [[], [], []]
            for q in np.flatnonzero(radius >= 0):
                found = index.colliding(lo[q], hi[q]) if bound[first + q] > -math.inf else np.arange(len(index.vectors))
                ids, score = index.verify(queries[first + q], own[first + q], found)
                above = score >= bound[first + q]
                ids, score = best(ids[above], score[above], k)
                for column, x in zip(out, (np.full(len(ids), own[first + q]), ids, score), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held = shared.value, _Held(k)
        for batch in batches:
            for index in held.add(batch, queries):
                yield from search(index, queries[index.vectors.shape[1]])
        for index in held.rest():
            yield from search(index, queries[index.vectors.shape[1]])

    return run
