"""Similarity search, TF-IDF, clustering statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut
from lodestrand.functions.vectors import cosine, dot, norm, unit


def scored(rows: DataFrame, query: list[float], vector: str = "vector") -> DataFrame:
    """rows with their cosine similarity to one vector."""
    return rows.withColumn("score", cosine(F.col(vector), F.lit([float(x) for x in query])))


def top_k(rows: DataFrame, k: int, tie: str, at_least: float | None = None, before: bool = True) -> DataFrame:
    """The k best scores, ties to the smaller id; a threshold applies before the limit or, if asked, only after it."""
    if at_least is not None and before:
        rows = rows.where(F.col("score") >= at_least)
    best = rows.orderBy(F.desc("score"), tie).limit(k)
    return best.where(F.col("score") >= at_least) if at_least is not None and not before else best


def batched_top_k(queries: DataFrame, rows: DataFrame, k: int, by: list[str]) -> DataFrame:
    """For each query (q_id, q_vector) its k best rows of the same values in ``by``: pairs never leave their block."""
    pairs = queries.join(rows, by).where("q_id <> vec_id").withColumn("score", F.round(cosine(F.col("q_vector"), F.col("vector")), 6))
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k).select("q_id", "vec_id", "rank", "score")


def pairs_within(rows: DataFrame, by: str, id_col: str = "vec_id") -> DataFrame:
    """(by, a, b, va, vb) for pairs a < b of rows that share a label."""
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, (F.col(f"x.{by}") == F.col(f"y.{by}")) & (F.col(f"x.{id_col}") < F.col(f"y.{id_col}"))).select(F.col(f"x.{by}").alias(by), F.col(f"x.{id_col}").alias("a"), F.col(f"y.{id_col}").alias("b"), F.col("x.vector").alias("va"), F.col("y.vector").alias("vb"))


def mean_pairwise_cosine(rows: DataFrame, by: str) -> DataFrame:
    """Mean cosine over all pairs of each group without making the pairs: the sum of unit vectors squares to it.

    For n unit vectors with sum S, the mean over pairs is (|S|^2 - n') / (n (n - 1)), n' being how many are not
    zero. Groups of one have coherence 1.
    """
    flat = rows.select(by, "vec_id", F.posexplode(unit(F.col("vector"))).alias("i", "x"))
    sums = flat.groupBy(by, "i").agg(F.sum("x").alias("s")).groupBy(by).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    counts = rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(norm(F.col("vector")) > 0).alias("m"))
    pairs = F.col("n") * (F.col("n") - 1)
    return sums.join(counts, by).select(by, "n", F.when(F.col("n") < 2, 1.0).otherwise((F.col("square") - F.col("m")) / pairs).alias("coherence"))


def centroids(rows: DataFrame, by: str) -> DataFrame:
    """(by, i, mean): each group's mean vector, component by component."""
    return rows.select(by, F.posexplode("vector").alias("i", "x")).groupBy(by, F.col("i").cast("bigint").alias("i")).agg(F.avg("x").alias("mean"))


def centroid_vectors(rows: DataFrame, by: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("i", "mean")))
    return centroids(rows, by).groupBy(by).agg(F.transform(parts, lambda p: p["mean"]).alias("centroid"), F.count("*").alias("dimensions"))


def reconstruction(rows: DataFrame, by: str) -> DataFrame:
    """One row: error of the rows against their group's centroid (per row and per component), mean cosine, and how much smaller the centroids are."""
    means = centroid_vectors(rows, by)
    gap = F.aggregate(F.zip_with("vector", "centroid", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    joined = rows.join(means, by).select(gap.alias("gap"), cosine(F.col("vector"), F.col("centroid")).alias("c"), F.size("vector").alias("d"), F.col(by).alias("g"))
    return joined.agg(F.sqrt(F.sum("gap") / F.count("*")).alias("row_error"), F.sqrt(F.sum("gap") / F.sum("d")).alias("component_error"), F.avg("c").alias("fidelity"), (F.count("*") / F.count_distinct("g")).alias("ratio"))


def terms(docs: DataFrame, text: Column) -> DataFrame:
    """(doc_id, term, tf): words of two letters or digits of any script, or more, counted."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return docs.select("doc_id", F.explode(found).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tf_idf(tf: DataFrame, n_docs: int, sublinear: bool = True) -> DataFrame:
    """(doc_id, term, weight): (1 + ln tf) times smoothed idf, each document of length 1.

    One shuffle by term for document frequencies, one by document for lengths.
    """
    raw = _weighed(tf, n_docs, sublinear)
    lengths = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return raw.join(lengths, "doc_id").select("doc_id", "term", (F.col("w") / F.col("length")).alias("weight"))


def _weighed(tf: DataFrame, n_docs: int, sublinear: bool = True) -> DataFrame:
    """(doc_id, term, w): term frequencies times smoothed idf, of no particular length."""
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((1.0 + n_docs) / (1.0 + F.col("df"))) + 1.0
    return tf.join(df, "term").select("doc_id", "term", ((1.0 + F.log("tf") if sublinear else F.col("tf")) * idf).alias("w"))


def tf_idf_nearest(tf: DataFrame, n_docs: int, asked: int) -> DataFrame:
    """(doc_id, score): the cosine of TF-IDF weights with one document's, of every other document that shares a term with it.

    Length and product come from one aggregate, so the weights themselves are never written or shuffled twice.
    """
    own = tf.where(F.col("doc_id") == asked).select("term").distinct()
    query = _weighed(tf.join(own, "term", "left_semi"), n_docs).where(F.col("doc_id") == asked).select("term", F.col("w").alias("q"))
    query = cut(query)  # one document's terms
    w, q = F.col("w"), F.col("q")
    sums = _weighed(tf, n_docs).where(F.col("doc_id") != asked).join(query, "term", "left").groupBy("doc_id").agg(F.sum(w * w).alias("square"), F.sum(w * q).alias("product"))
    length = query.agg(F.sqrt(F.sum(q * q))).first()[0]
    return sums.where("product IS NOT NULL").select("doc_id", (F.col("product") / F.sqrt("square") / F.lit(length).cast("double")).alias("score"))


def attention(rows: DataFrame, by: str, id_col: str = "vec_id") -> DataFrame:
    """(by, a, b, weight) within groups: softmax over b of scaled dot product times coherence, identity projections.

    Coherence is the cosine times the lesser trust, clipped to 0 and 1; a vector coheres with itself fully.
    """
    x, y = rows.alias("x"), rows.alias("y")
    both = x.join(y, F.col(f"x.{by}") == F.col(f"y.{by}")).select(F.col(f"x.{by}").alias(by), F.col(f"x.{id_col}").alias("a"), F.col(f"y.{id_col}").alias("b"), F.col("x.vector").alias("va"), F.col("y.vector").alias("vb"), F.least("x.trust", "y.trust").alias("trust"))
    coherence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("va"), F.col("vb")) * F.col("trust")))
    score = dot(F.col("va"), F.col("vb")) / F.sqrt(F.size("va")) * F.when(F.col("a") == F.col("b"), 1.0).otherwise(coherence)
    w = Window.partitionBy(by, "a")
    e = both.withColumn("score", score).withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return e.select(by, "a", "b", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def attended(weights: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """(a, i, x): each row's weighted sum of the vectors it attends to."""
    joined = weights.join(rows.select(F.col("vec_id").alias("b"), "vector"), "b")
    return joined.select("a", "weight", F.posexplode("vector").alias("i", "v")).groupBy("a", F.col("i").cast("bigint").alias("i")).agg(F.sum(F.col("weight") * F.col("v")).alias("x"))


def quantised(rows: DataFrame, bits: int = 8) -> DataFrame:
    """Vectors on a uniform grid of 2**bits steps between the table's least and greatest component, rounded half to even."""
    lo, hi = rows.agg(F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    step = (hi - lo) / (2**bits - 1) or 1.0
    codes = F.transform("vector", lambda x: F.rint((x - F.lit(lo)) / F.lit(step)).cast("bigint"))
    return rows.withColumn("codes", codes).withColumn("restored", F.transform("codes", lambda q: q * F.lit(step) + F.lit(lo)))
