"""Operators that built-in expressions can't state: codecs, secret sharing, greedy selection, hierarchies, attention.

Python runs on Arrow batches or on one bounded group at a time.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import lzma
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StringType

CODECS = {"zlib": (zlib.compress, zlib.decompress), "gzip": (gzip.compress, gzip.decompress), "bz2": (bz2.compress, bz2.decompress), "lzma": (lzma.compress, lzma.decompress)}

#: A prime above 2**127, the field of shared secrets.
PRIME = 2**127 - 1

#: Scores of attention that a task holds at once: 32 MB.
SCORES = 1 << 22


def codec_sizes(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, codec, original, compressed, intact) for each row and codec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ident, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = (text or "").encode()
                for name, (pack, unpack) in CODECS.items():
                    small = pack(data)
                    out.append((ident, name, len(data), len(small), unpack(small) == data))
            yield pa.RecordBatch.from_pydict(dict(zip(("id", "codec", "original", "compressed", "intact"), map(list, zip(*out, strict=True)) if out else [[]] * 5, strict=True)), pa.schema([("id", batch.schema.field(0).type), ("codec", pa.string()), ("original", pa.int64()), ("compressed", pa.int64()), ("intact", pa.bool_())]))

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"id {kind}, codec string, original bigint, compressed bigint, intact boolean")


def dictionary_sizes(rows: DataFrame, id_col: str, text_col: str, samples: int = 200) -> DataFrame:
    """(id, plain, primed): compressed sizes without and with a dictionary fitted on a sample.

    The dictionary is made of pieces of ``samples`` texts, those with the least hashes of id and text: 400 characters from
    where the hash says, 32 KB in all, which is all that the codec can look back on. Every row is compressed, whole.
    """
    picked = rows.where(F.col(text_col).isNotNull()).select(text_col, F.xxhash64(id_col, text_col).alias("h")).orderBy("h", text_col).limit(samples).collect()
    primer = "".join(t[h % max(1, len(t) - 399) :][:400] for t, h in picked).encode()[-32768:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def primed(data: bytes) -> int:
            c = zlib.compressobj(zdict=primer)
            return len(c.compress(data) + c.flush())

        for pdf in batches:
            data = [(t or "").encode() for t in pdf[text_col]]
            yield pd.DataFrame({"id": pdf[id_col], "plain": [len(zlib.compress(x)) for x in data], "primed": [primed(x) for x in data]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(run, f"id {kind}, plain bigint, primed bigint")


def _coefficients(secret: int, threshold: int, salt: str) -> list[int]:
    return [secret] + [int.from_bytes(hashlib.sha256(f"{salt}|{secret}|{k}".encode()).digest()) % PRIME for k in range(1, threshold)]


def shares(rows: DataFrame, id_col: str, secret_col: str, n: int, threshold: int, salt: str) -> DataFrame:
    """(id, x, y): n points of a polynomial whose value at 0 is the secret; any ``threshold`` of them give it back.

    Coefficients are keyed by the salt, so that a run can be repeated; a salt that isn't kept gives random ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ident, secret in zip(pdf["id"], pdf["secret"], strict=True):
                poly = _coefficients(int(secret), threshold, salt)
                out += [(ident, x, str(sum(c * pow(x, k, PRIME) for k, c in enumerate(poly)) % PRIME)) for x in range(1, n + 1)]
            yield pd.DataFrame(out, columns=["id", "x", "y"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(F.col(id_col).alias("id"), F.col(secret_col).alias("secret")).mapInPandas(run, f"id {kind}, x bigint, y string")


def reconstruct(points: DataFrame) -> DataFrame:
    """(id, secret) from each id's points, of which there are few, by interpolation at 0."""

    def secret(points: list) -> str:
        total = 0
        for i, (x, y) in enumerate(points):
            above = below = 1
            for j, (other, _) in enumerate(points):
                if i != j:
                    above, below = above * -other % PRIME, below * (x - other) % PRIME
            total += y * above * pow(below, -1, PRIME)
        return str(total % PRIME)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = [[(int(x), int(y)) for x, y in zip(xs, ys, strict=True)] for xs, ys in zip(pdf["xs"], pdf["ys"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "secret": [secret(p) for p in held]})

    kind = points.schema["id"].dataType.simpleString()
    rows = points.groupBy("id").agg(F.collect_list(F.struct("x", "y")).alias("p")).select("id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))
    return rows.mapInPandas(run, f"id {kind}, secret string")


def diverse(candidates: DataFrame, k: int, balance: float = 0.5) -> DataFrame:
    """(q_id, place, vec_id): for each query's bounded candidates (q_id, vec_id, score, vector) a greedy choice of k
    by balance * relevance - (1 - balance) * greatest similarity to what is chosen, ties to smaller ids."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        v = np.stack([np.asarray(x, float) for x in pdf["vector"]])
        length = np.linalg.norm(v, axis=1)
        unit = v / np.where(length > 0, length, 1)[:, None]
        chosen: list[int] = []
        near = np.zeros(len(pdf))
        while len(chosen) < min(k, len(pdf)):
            value = balance * pdf["score"].to_numpy() - (1 - balance) * near
            value[chosen] = -np.inf
            at = int(value.argmax())
            if value[at] <= -1:
                break
            chosen.append(at)
            near = np.maximum(near, unit @ unit[at]) if len(chosen) > 1 else unit @ unit[at]
        return pd.DataFrame({"q_id": pdf["q_id"].iloc[chosen], "place": range(1, len(chosen) + 1), "vec_id": pdf["vec_id"].iloc[chosen]})

    return candidates.select("q_id", "vec_id", "score", "vector").groupBy("q_id").applyInPandas(run, "q_id bigint, place bigint, vec_id bigint")


def ward(rows: DataFrame, by: str, clusters: int) -> DataFrame:
    """(by, vec_id, cluster) for each group: agglomeration by least growth of the squared error; clusters are numbered by their least id.

    Copies are joined first; then chains of nearest neighbours give the hierarchy from centroids alone, which is cut. Memory
    grows with a group's rows, time with their square; equal growths may be taken in another order than one by one.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        v = np.stack([np.asarray(x, float) for x in pdf["vector"]]) + 0.0
        _, first, of, counts = np.unique(v, axis=0, return_index=True, return_inverse=True, return_counts=True)
        first_copy = first[of.reshape(-1)]
        if len(first) <= clusters:
            label = np.arange(len(v))
            copies = np.flatnonzero(first_copy != label)
            copies = copies[np.argsort(first_copy[copies], kind="stable")][: max(0, len(v) - clusters)]
            label[copies] = first_copy[copies]
        else:
            parent = np.arange(len(v))
            merges = sorted(_ward_chain(v[first], counts.astype(float)), key=lambda m: m[0])
            for _, a, b in merges[: len(first) - clusters]:
                roots = []
                for x in (first[a], first[b]):
                    while parent[x] != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    roots.append(x)
                parent[max(roots)] = min(roots)
            label = parent[first_copy]
            while not np.array_equal(label, parent[label]):
                label = parent[label]
        names = {x: k for k, x in enumerate(dict.fromkeys(label))}
        return pd.DataFrame({by: pdf[by], "vec_id": pdf["vec_id"], "cluster": [names[x] for x in label]})

    return rows.select(by, "vec_id", "vector").groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, vec_id bigint, cluster bigint")


def _ward_chain(points: np.ndarray, weight: np.ndarray) -> list[tuple[float, int, int]]:
    """(growth, a, b) of each merge of weighted points, by chains of nearest neighbours; a and b are any points of the two clusters."""
    c, w = points - points.mean(axis=0), weight.copy()
    square, point, height, alive = (c**2).sum(axis=1), np.arange(len(c)), np.zeros(len(c)), np.ones(len(c), bool)
    left, chain, merges = len(c), [], []

    def growth(i: int, others: np.ndarray) -> np.ndarray:
        return ((c[others] - c[i]) ** 2).sum(axis=1) * (w[others] * w[i] / (w[others] + w[i]))

    while left > 1:
        if 2 * left < len(c):
            place = np.cumsum(alive) - 1
            chain = [place[x] for x in chain]
            c, w, square, point, height, alive = (x[alive] for x in (c, w, square, point, height, alive))
        if not chain:
            chain = [int(alive.argmax())]
        i = chain[-1]
        rough = np.maximum(square + square[i] - 2 * (c @ c[i]), 0) * (w * w[i] / (w + w[i]))
        rough[~alive] = np.inf
        rough[i] = np.inf
        close = np.flatnonzero(rough <= rough.min() * (1 + 1e-9) + 1e-13 * square.max() * w[i])
        exact = growth(i, close)
        j, least = close[exact.argmin()], exact.min()
        before = growth(i, np.array(chain[-2:-1]))[0] if len(chain) > 1 else np.inf
        if least < before and j not in chain:
            chain.append(j)
            continue
        j = chain[-2]
        del chain[-2:]
        height[j] = max(before, height[i], height[j])
        merges.append((height[j], point[i], point[j]))
        c[j] = (w[i] * c[i] + w[j] * c[j]) / (w[i] + w[j])
        w[j] += w[i]
        square[j] = c[j] @ c[j]
        alive[i] = False
        left -= 1
    return merges


def multi_head(rows: DataFrame, by: str, heads: int = 4, seed: int = 42, scores: int = SCORES) -> DataFrame:
    """(by, vec_id, attended) within groups: multi-head attention with seeded projections, the same in every group.

    A group's vectors are held by one task, but of its scores only some rows of one head at a time, ``scores`` or a row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", ignore_index=True)
        x = np.stack([np.asarray(v, float) for v in pdf["vector"]])
        n, d = x.shape
        wide, step = d // heads, max(1, scores // n)
        rng = np.random.default_rng(seed)
        q, k, v, o = (rng.uniform(-1, 1, (d, d)) * np.sqrt(6 / (2 * d)) for _ in range(4))
        q, k, v = x @ q, x @ k, x @ v
        out = np.empty_like(x)
        for head in (slice(h * wide, (h + 1) * wide) for h in range(heads)):
            for first in range(0, n, step):
                part = slice(first, first + step)
                weight = q[part, head] @ k[:, head].T / np.sqrt(wide)
                weight -= weight.max(-1, keepdims=True)
                np.exp(weight, out=weight)
                out[part, head] = weight @ v[:, head] / weight.sum(-1, keepdims=True)
        return pd.DataFrame({by: pdf[by], "vec_id": pdf["vec_id"], "attended": list(out @ o)})

    return rows.select(by, "vec_id", "vector").groupBy(by).applyInPandas(run, f"{by} {rows.schema[by].dataType.simpleString()}, vec_id bigint, attended array<double>")


def token_bucket(rows: DataFrame, key: str, rate: float, burst: float, seconds: str = "seconds", order: str = "event_id") -> DataFrame:
    """(key, order, allowed): each key's requests in order of time spend tokens that come back at a rate, up to a burst."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([seconds, order])
        tokens, last, allowed = burst, None, []
        for t in pdf[seconds]:
            tokens = min(burst, tokens + (0 if last is None else (t - last) * rate))
            last = t
            allowed.append(tokens >= 1)
            tokens -= allowed[-1]
        return pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": allowed})

    return rows.select(key, order, seconds).groupBy(key).applyInPandas(run, f"{key} bigint, {order} bigint, allowed boolean")


@pandas_udf(StringType())
def commitment(vector: pd.Series, text: pd.Series, nonce: pd.Series) -> pd.Series:
    """SHA-256 over a vector's float32 bytes, the text and a nonce."""
    return pd.Series([hashlib.sha256(np.asarray(v, np.float32).tobytes() + t.encode() + n.encode()).hexdigest() for v, t, n in zip(vector, text, nonce, strict=True)])


@pandas_udf(DoubleType())
def digest_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """Cosine of two names' SHA-256 digests read as bytes around zero: a number from names alone, never NaN."""

    def vector(name: str) -> np.ndarray:
        return np.frombuffer(hashlib.sha256(name.encode()).digest(), np.uint8) - 127.5

    return pd.Series([float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y))) for x, y in zip(map(vector, a), map(vector, b), strict=True)])


def map_blocks(rows: DataFrame, id_col: str, text_col: str, f) -> DataFrame:
    """(id, result, error): a function over every block; what it raises becomes that block's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for ident, text in zip(pdf[id_col], pdf[text_col], strict=True):
                try:
                    out.append((ident, str(f(text)), None))
                except Exception as e:  # noqa: BLE001
                    out.append((ident, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["id", "result", "error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInPandas(run, f"id {kind}, result string, error string")


def huffman_bits(counts: dict[int, int]) -> dict[int, int]:
    """Code length of each symbol; a single symbol takes one bit."""
    import heapq

    heap = [(n, k, [s]) for k, (s, n) in enumerate(sorted(counts.items()))]
    heapq.heapify(heap)
    bits = dict.fromkeys(counts, 0 if len(counts) > 1 else 1)
    while len(heap) > 1:
        (a, k, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            bits[s] += 1
        heapq.heappush(heap, (a + b, k, x + y))
    return bits


def mp4_boxes(data: bytes) -> list[tuple[str, int]]:
    """(name, size) of the boxes of an MP4 file, those within containers included; what is cut off ends the list."""
    out, stack = [], [(0, len(data))]
    while stack:
        at, end = stack.pop()
        while at + 8 <= end:
            size, name = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8].decode("latin-1")
            head = 8
            if size == 1 and at + 16 <= end:
                size, head = int.from_bytes(data[at + 8 : at + 16]), 16
            size = end - at if size == 0 else size
            if size < head or at + size > end:
                break
            out.append((name, size))
            if name in ("moov", "trak", "mdia", "minf", "stbl", "udta"):
                stack.append((at + size, end))
                at, end = at + head, at + size
            else:
                at += size
    return out
