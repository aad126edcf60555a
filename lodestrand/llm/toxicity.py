"""Toxic passages by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import WORDS, cut, fresh, mapped, named, small_side

#: Bytes of a word's beginnings that words back off to, shortest first; then comes the whole word.
PREFIXES = (4, 5, 6, 7, 8)
#: Labelled rows to learn from at most, on average: a sample by hash.
TRAIN_ROWS = 12_000
#: A word or a beginning speaks for itself if so many toxic documents have it or so many clean ones; with less, its longest beginning that does speaks.
SUPPORT, SUPPORT_BEGINNING = (3, 60), (6, 60)
#: Steps of evidence, and the most, in the histogram that the logistic curve is fitted to.
STEP, MOST_EVIDENCE = 1 / 64, 64.0
#: What every token costs, and the most that one token scores.
DRIFT, MOST = 0.3, 6.0


def chain(word: bytes) -> list[bytes]:
    """A word's features from the most general: its beginnings, each closed by '*', then the word itself."""
    return [word[:k] + b"*" for k in PREFIXES if len(word) > k] + [word]


class _Weights(dict):
    """Scores by word; a word without one takes that of its longest known beginning."""

    def __init__(self, known: dict[bytes, float], rest: float, most: int = 1 << 18):
        super().__init__()
        self.known, self.rest, self.most = known, rest, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        for f in reversed(chain(word)):
            if (score := self.known.get(f)) is not None:
                break
        else:
            score = self.rest
        self[word] = score
        return score


def segments(scores: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) that score ``least`` or more, in order of place.

    The linear-time scan of Ruzzo and Tompa. Runs of negative scores are summed up first, so that
    the scan walks over positive tokens only.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    before, after = total[up].tolist(), total[up + 1].tolist()
    held: list[list] = []  # [start token, end token, total before, total after, link to the left]
    for k, at in enumerate(up.tolist()):
        start, left, right = at, before[k], after[k]
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][2] >= left:
                j = held[j][4]
            if j < 0 or held[j][3] >= right:
                held.append([start, at + 1, left, right, j])
                break
            start, left = held[j][0], held[j][2]
            del held[j:]
    return [(s, e, r - b) for s, e, b, r, _ in held if r - b >= least]


@dataclass
class Model:
    known: dict[bytes, float] = field(default_factory=dict)
    rest: float = -DRIFT
    scale: float = 1.0  # lambda of the extreme-value distribution
    log_k: float = 0.0
    slope: float = 1.0
    offset: float = -2.0
    least: float = 2.0  # a passage of lower score isn't significant in a text of any length

    def packed(self) -> tuple:
        """The fields, for workers that lack this package."""
        return tuple(getattr(self, f) for f in self.__dataclass_fields__)

    def tokens(self, text: str | None, weights: _Weights) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()
        scores = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
        seen: Counter = Counter()
        for k in np.flatnonzero(scores > 0).tolist():  # repeats tell less and less: weights come from documents
            seen[words[k]] += 1
            if seen[words[k]] > 1:
                scores[k] = scores[k] / seen[words[k]] ** 2 - DRIFT
        return scores

    def evidence(self, scores: np.ndarray) -> tuple[float, list[tuple[int, int, float]]]:
        """What speaks for toxicity, and the passages: each is significant on its own length's scale.

        The best segment of n background tokens exceeds s with probability 1 - exp(-K n exp(-lambda s)).
        The evidence of a document sums the normalised scores of its significant segments, above
        what the best one must reach by chance in a text of its length.
        """
        if not len(scores):
            return 0.0, []
        best = float((np.cumsum(scores) - np.minimum.accumulate(np.concatenate([[0.0], np.cumsum(scores)]))[:-1]).max())
        if best < self.least:
            return max(0.0, self.scale * best) * 0.1, []
        chance = self.log_k + math.log(len(scores))
        found = segments(scores, self.least)
        normal = [self.scale * s - chance for _, _, s in found]
        held = [x for x, z in zip(found, normal, strict=True) if z > 0]
        return max(0.0, self.scale * best) * 0.1 + math.sqrt(sum(z for z in normal if z > 0)), held

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.slope * evidence + self.offset))))


def _weights_from(counts: list[tuple[bytes, int, int]], toxic: int, clean: int, prior: float = 10.0, width: float = 3.0) -> dict[bytes, float]:
    """Lower bounds of the features' log-odds. counts: (feature, toxic documents, clean documents).

    A feature's rate has a Dirichlet prior of ``prior`` documents divided as the counts of its next
    shorter beginning are, down to the share of all documents; ``width`` standard deviations and the drift
    come off, so that background text scores below zero and chance can't add up.
    """
    base = (toxic + 0.5) / (toxic + clean + 1)
    by_name = {f: (t, c) for f, t, c in counts}
    rates: dict[bytes, float] = {}

    def rate(f: bytes) -> float:
        if f not in rates:
            t, c = by_name[f]
            whole = f[:-1] if f.endswith(b"*") else f
            up = [x for x in chain(whole)[:-1] if x != f and x in by_name and len(x) <= len(whole)]
            mean = rate(up[-1]) if up else base
            rates[f] = (t + prior * mean) / (t + c + prior)
        return rates[f]

    out = {}
    for f, (t, c) in by_name.items():
        r = rate(f)
        n = t + c + prior
        odds = math.log(r / (1 - r)) - math.log(base / (1 - base))
        spread = math.sqrt(1 / (r * n + 0.5) + 1 / ((1 - r) * n + 0.5))
        out[f] = min(MOST, odds - width * spread - DRIFT)
    out = {f: max(x, -DRIFT) for f, x in out.items()}
    return {f: x for f, x in out.items() if x != _less(out, f)}  # a feature that scores as what it backs off to says nothing


def _less(scores: dict[bytes, float], f: bytes) -> float:
    """What a feature would score if it weren't known."""
    whole = f[:-1] if f.endswith(b"*") else f
    return next((scores[x] for x in reversed(chain(whole)[:-1]) if x != f and len(x) <= len(whole) and x in scores), -DRIFT)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn token weights and calibration from labelled rows.

    labels holds ids and labels 0 or 1; ``usable`` says which may be learnt from (a condition on
    labels). A sample by hash of ``train_rows`` rows on average is joined with docs: the bound keeps
    what one fit gathers constant. Null ids and labels are left out, an id labelled twice counts as
    toxic if either label is, and repeated documents count as often as they stand. Two thirds of the
    sample give the weights, the rest the calibration, for which the weights are unseen. Without any
    toxic or any clean example, as with empty tables, the model scores everything below 0.5. Null texts
    have no words; columns of other names don't matter.
    """
    rows = labels.where(named(id_col).isNotNull() & named(label_col).isin(0, 1))
    rows = (rows.where(usable) if usable is not None else rows).groupBy(named(id_col).alias("id")).agg(F.max(named(label_col)).alias("label"))
    count = rows.count()
    share = min(1.0, train_rows / max(1, count))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.select(named(id_col).alias("doc"), named(text_col).cast("string").alias("text"))
    joined = texts.join(small_side(picked, min(count, 2 * train_rows)), F.col("doc") == F.col("id"))
    sample = cut(joined.select(F.col("label").cast("int").alias("label"), "text", (F.pmod(F.xxhash64("id", F.lit(11)), F.lit(3)) == 0).alias("later")))

    def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = [*{**tally[0], **tally[1]}, b""]
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([tally[1][f] for f in names], pa.int64()), pa.array([tally[0][f] for f in names], pa.int64())], ["f", "t", "c"])
            tally[0].clear(), tally[1].clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = set((text.as_py() or "").encode("utf-8", "surrogatepass").translate(WORDS).split())
                tally[label].update(words)
                tally[label][b""] += 1  # the documents themselves
                if len(tally[0]) + len(tally[1]) > 300_000:
                    yield flush()
        yield flush()

    words = cut(sample.where("NOT later").select("label", "text").mapInArrow(count_features, "f binary, t bigint, c bigint").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    # A beginning counts words, not documents, each at most twice: one frequent word says nothing of its neighbours.
    heads = F.explode(F.expr(f"transform(filter(array{PREFIXES}, k -> length(f) > k), k -> concat(substring(f, 1, k), X'2A'))"))
    begun = words.select(heads.alias("f"), F.least("t", F.lit(2)).alias("t"), F.least("c", F.lit(2)).alias("c")).groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    enough = lambda least: (F.col("t") >= least[0]) | (F.col("c") >= least[1])
    # The vocabulary of the sample that has support, no more.
    counts = [(bytes(r[0]), r[1], r[2]) for r in words.where((F.length("f") == 0) | enough(SUPPORT)).union(begun.where(enough(SUPPORT_BEGINNING))).collect()]
    toxic, clean = next(((t, c) for f, t, c in counts if not f), (0, 0))
    if not toxic or not clean:
        return Model(offset=-3.0, least=math.inf)
    model = Model(known=_weights_from([x for x in counts if x[0]], toxic, clean))

    _calibrate(model, sample.where("later").select("label", "text"))
    return model


def _calibrate(model: Model, later: DataFrame) -> None:
    """Fit the extreme-value parameters on clean documents, then the logistic curve on all.

    later: rows (label, text). Tasks send sums and a histogram, however many texts and segments there are.
    """
    context = later.sparkSession.sparkContext
    shared = context.broadcast(model.packed())

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        weights, n, total, words = _Weights(model.known, model.rest), 0, 0.0, 0
        for batch in batches:
            for text in batch.column(1):
                scores = model.tokens(text.as_py(), weights)
                found = segments(scores, 0.5)
                n, total, words = n + len(found), total + math.fsum(s - 0.5 for _, _, s in found), words + len(scores)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total]), pa.array([words], pa.int64())], ["n", "total", "words"])

    # Scores of background segments fall off as exp(-lambda s); K n is how many segments n tokens begin.
    sums = later.where("label = 0").mapInArrow(background, "n bigint, total double, words bigint").agg(F.sum("n"), F.sum(F.round("total", 6).cast("decimal(30,6)")), F.sum("words")).first()
    n, total, words = (sums[0], float(sums[1]), sums[2]) if sums[0] else (1, 0.5, (sums[2] or 1))
    model.scale = 1 / max(0.2, total / n)
    model.log_k = math.log(n / words) + model.scale * 0.5
    model.least = 0.5 + max(0.0, model.log_k / model.scale)

    fitted = context.broadcast(model.packed())

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*fitted.value)
        weights, tally = _Weights(model.known, model.rest), Counter()
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                evidence = model.evidence(model.tokens(text.as_py(), weights))[0]
                tally[label, round(min(evidence, MOST_EVIDENCE) / STEP)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in tally], pa.int32()), pa.array([k[1] for k in tally], pa.int32()), pa.array(list(tally.values()), pa.int64())], ["label", "step", "n"])

    seen = later.mapInArrow(histogram, "label int, step int, n bigint").groupBy("label", "step").agg(F.sum("n").alias("n")).orderBy("label", "step").collect()  # two rows a step at most
    x, y, n = (np.array(v, float) for v in zip(*[(r["step"] * STEP, r["label"], r["n"]) for r in seen], strict=True)) if seen else (np.zeros(0),) * 3
    a, b = 1.0, -2.0
    for _ in range(50):  # Newton steps for the logistic fit, with a light ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9) * n
        g = np.array([((y - p) * x * n).sum() - 0.01 * a, ((y - p) * n).sum()])
        h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -2, 2), b + np.clip(step[1], -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.slope, model.offset = max(1e-3, float(a)), float(b)


def score(docs: DataFrame, model: Model, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with a struct as last column, ``__tox``: score (0 to 1), and passages: start and end (words, end
    exclusive) and score of every significant toxic segment. Whole texts are scanned, once, without a shuffle.

    Empty and null texts score the model's value for no evidence, repeated rows stay, an empty table gives no
    rows and texts may be of any length. All columns of docs stay whatever their names: if one is
    called ``__tox``, ours gets an underscore more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.packed())
    text_at = docs.columns.index(text_col)
    out = docs.withColumn(fresh(docs, "__tox"), F.lit(None).cast("struct<score:double,passages:array<struct<start:int,end:int,score:double>>>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        weights = _Weights(model.known, model.rest)
        for batch in batches:
            rows = []
            for text in batch.column(text_at):
                evidence, found = model.evidence(model.tokens(text.as_py(), weights))
                rows.append({"score": model.score(evidence), "passages": [{"start": s, "end": e, "score": x} for s, e, x in found]})
            columns = [*batch.columns[:-1], pa.array(rows, batch.schema.field(batch.num_columns - 1).type)]
            keep = [k for k in range(len(columns)) if not (drop_text and k == text_at)]
            yield pa.RecordBatch.from_arrays([columns[k] for k in keep], [batch.schema.names[k] for k in keep])

    return mapped(out, run, [c for c in out.columns if not (drop_text and c == text_col)])


def clean(docs: DataFrame, model: Model, most: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs that score below ``most``, with the same columns, whatever their names."""
    rated = score(docs, model, text_col)
    return rated.where(named(rated.columns[-1])["score"] < most).select(*map(named, docs.columns))
