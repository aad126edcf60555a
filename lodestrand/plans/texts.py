"""Text, vectors, TF-IDF and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.functions.storage import cut
from lodestrand.functions.vectors import cosine, l2
from lodestrand.operators import blocked, graph, search
from lodestrand.operators.sequence import numbered_within, previous
from lodestrand.registry import query
from lodestrand.tables import SQL_E, load, vectors

# DuckDB's words are ASCII ones: other letters and digits stand as underscores there, which are letters of words but match nothing else.
_FOLD = r"regexp_replace(text, '[^\x00-\x7F\pS\pP\pZ\pC\pM]', '_', 'g')"
_WS = r"[ \t\n\r\f\x0b]+"
_WORDS = rf"list_filter(string_split_regex(lower({{0}}), '{_WS}'), lambda w: w <> '')"
_ENTITY = r"regexp_extract_all({0}, '\b[A-Z][a-z]+(?:[ \t\n\r\f\x0b]+[A-Z][a-z]+)*\b')"


def _docs(spark, d):
    return load(spark, d, "documents")


@query(f"SELECT doc_id, len(e)::BIGINT AS n_entities, e[1] AS first_entity FROM (SELECT doc_id, {_ENTITY.format(_FOLD)} AS e FROM documents)")
def entity_extract(spark, d):
    return _docs(spark, d).select("doc_id", tx.entities(F.col("text")).alias("e")).select("doc_id", F.size("e").cast("bigint").alias("n_entities"), F.get("e", F.lit(0)).alias("first_entity"))


def _triples(spark, d):
    found = _docs(spark, d).select("doc_id", tx.entities(F.col("text")).alias("e")).where("size(e) > 1")
    pair = F.explode(F.arrays_zip(F.slice("e", F.lit(1), F.size("e") - 1).alias("subject"), F.slice("e", F.lit(2), F.size("e") - 1).alias("object")))
    return found.select(pair.alias("p")).select("p.subject", F.lit("mentions_with").alias("predicate"), "p.object", F.lit(1.0).alias("confidence"))


_TRIPLES = f"ents AS (SELECT doc_id, {_ENTITY.format(_FOLD)} AS l FROM documents), tr AS (SELECT l[i] AS subject, 'mentions_with' AS predicate, l[i + 1] AS object, 1.0::DOUBLE AS confidence FROM (SELECT l, unnest(generate_series(1, len(l) - 1)) AS i FROM ents WHERE len(l) > 1))"


@query(f"WITH {_TRIPLES} SELECT subject, predicate, object, count(*) AS n FROM tr GROUP BY ALL")
def entity_triples(spark, d):
    return _triples(spark, d).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n"))


@query(f"WITH {_TRIPLES}, m AS (SELECT subject AS entity FROM tr UNION ALL SELECT object FROM tr) SELECT (SELECT count(*) FROM tr) AS triples, (SELECT count(DISTINCT predicate) FROM tr) AS relations, (SELECT round(avg(confidence), 6) FROM tr) AS mean_confidence, count(DISTINCT entity) AS entities FROM m")
def kg_statistics(spark, d):
    stats = graph.statistics(_triples(spark, d))
    return stats["totals"].crossJoin(stats["entities"].agg(F.count("*").alias("entities")))  # one row each


@query(f"WITH {_TRIPLES}, m AS (SELECT subject AS entity FROM tr UNION ALL SELECT object FROM tr) SELECT entity, count(*) AS mentions FROM m GROUP BY 1 ORDER BY mentions DESC, entity LIMIT 10")
def kg_top_entities(spark, d):
    return graph.statistics(_triples(spark, d))["top_entities"]


@query(f"WITH {_TRIPLES} SELECT to_json({{'subject': subject, 'object': object, 'n': count(*)}})::VARCHAR AS json FROM tr GROUP BY subject, object HAVING count(*) > 1")
def kg_json(spark, d):
    rows = _triples(spark, d).groupBy("subject", "object").agg(F.count("*").alias("n")).where("n > 1")
    return rows.select(F.to_json(F.struct("subject", "object", "n")).alias("json"))


_HITS = lambda ws, t="text": " + ".join(f"contains(lower({t}), '{w}')::INT" for w in ws)


@query(f"SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM (SELECT doc_id, {_HITS(tx.POSITIVE)} AS p, {_HITS(tx.NEGATIVE)} AS n FROM documents)")
def sentiment(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.sentiment(F.col("text")).alias("sentiment"))


@query(f"SELECT doc_id, length(text)::BIGINT AS length, len({_WORDS.format('text')})::BIGINT AS words, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def text_features(spark, d):
    return load(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("length"), tx.word_count(F.col("text")).alias("words"), F.octet_length("text").cast("bigint").alias("bytes"))


def _masked(t: str) -> str:
    for pattern, kind in tx.MASKS:
        t = f"regexp_replace({t}, '{pattern}', 'ANON_{kind}', 'g')"
    return t


@query(f"SELECT doc_id, sha256({_masked(_FOLD)}) AS masked FROM documents")
def pii_mask(spark, d):
    """The text itself is masked; only the digest, which DuckDB has to give too, is of its folded form."""
    return _docs(spark, d).select("doc_id", F.sha2(tx.folded(tx.mask(F.col("text"))).cast("binary"), 256).alias("masked"))


@query(r"WITH m AS (SELECT source AS context, unnest(regexp_extract_all(" + _FOLD + r", '\b[A-Z][a-z]+ [A-Z][a-z]+\b')) AS value, doc_id FROM documents), f AS (SELECT context, value, min(doc_id) AS first_doc FROM m GROUP BY 1, 2) SELECT context, value, 'ANON_NAME_' || lpad((row_number() OVER (PARTITION BY context ORDER BY first_doc, value) - 1)::VARCHAR, 4, '0') AS pseudonym FROM f")
def pii_pseudonyms(spark, d):
    """Names numbered by first occurrence in their context: the same value has the same pseudonym throughout."""
    found = _docs(spark, d).select(F.col("source").alias("context"), "doc_id", F.explode(F.regexp_extract_all("text", F.lit(tx.on_any_text(r"\b[A-Z][a-z]+ [A-Z][a-z]+\b")), F.lit(0))).alias("value"))
    first = found.groupBy("context", "value").agg(F.min("doc_id").alias("first_doc"))
    numbers = numbered_within(first, ["context"], ["first_doc", "value"])
    return numbers.select("context", "value", F.concat(F.lit("ANON_NAME_"), F.lpad(F.col("number").cast("string"), 4, "0")).alias("pseudonym"))


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(" + _FOLD + ", ' ')) AS w FROM documents) WHERE " + " OR ".join(f"regexp_matches(w, '{p}')" for p in tx.SENSITIVE) + " OR w IN ('John', 'Jane', 'Smith', 'Doe') GROUP BY 1")
def sensitive_flag(spark, d):
    rows = _docs(spark, d).select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return rows.where(tx.sensitive(F.col("w"))).groupBy("doc_id").agg(F.count("*").alias("n"))


_NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(text, '{_WS}', ' ', 'g')), 'artificial intelligence', 'AI', 'gi'), 'machine learning', 'ML', 'gi'), 'natural language processing', 'NLP', 'gi'), 'deep learning', 'DL', 'gi')"


@query(f"SELECT doc_id, length(n)::BIGINT AS length, sha256(n) AS hash FROM (SELECT doc_id, {_NORMAL} AS n FROM documents)")
def text_normalise(spark, d):
    return load(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("n")).select("doc_id", F.length("n").cast("bigint").alias("length"), F.sha2(F.col("n").cast("binary"), 256).alias("hash"))


def _with_previous(spark, d):
    """Documents with the one before in their source: pairs to compare, as many as there are documents.

    Ids find each other first, in ranges, so that no task sorts a source's texts.
    """
    docs = load(spark, d, "documents")
    pairs = previous(docs.select("source", "doc_id"), ["source"], ["doc_id"], "doc_id", "other_id").where("other_id IS NOT NULL").select("doc_id", "other_id")
    return pairs.join(docs.select("doc_id", "text"), "doc_id").join(docs.select(F.col("doc_id").alias("other_id"), F.col("text").alias("other")), "other_id")


_PREVIOUS = "p AS (SELECT doc_id, lag(doc_id) OVER w AS other_id, text, lag(text) OVER w AS other FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"


@query(f"WITH {_PREVIOUS}, w AS (SELECT doc_id, list_distinct({_WORDS.format('text')}) AS a, {_WORDS.format('other')} AS b FROM p WHERE other_id IS NOT NULL) SELECT doc_id, CASE WHEN len(a) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(a), 6) END::DOUBLE AS fidelity FROM w")
def text_fidelity(spark, d):
    return _with_previous(spark, d).select("doc_id", F.round(tx.fidelity(F.col("text"), F.col("other")), 6).alias("fidelity"))


@query("SELECT round(sum(length(text))::DOUBLE / sum(length(n)), 6) AS ratio, sum(length(n))::BIGINT AS compressed, sum(length(text))::BIGINT AS original, round(avg(length(n) / length(text)), 6) AS mean_ratio FROM (SELECT text, " + _NORMAL + " AS n FROM documents WHERE length(text) > 0)")
def compression_stats(spark, d):
    rows = load(spark, d, "documents").where("length(text) > 0").select(F.length("text").alias("a"), F.length(tx.normalise(F.col("text"))).alias("b"))
    return rows.agg(F.round(F.sum("a") / F.sum("b"), 6).alias("ratio"), F.sum("b").alias("compressed"), F.sum("a").alias("original"), F.round(F.avg(F.col("b") / F.col("a")), 6).alias("mean_ratio"))


_GRAMS = "CASE WHEN length({0}) < 3 THEN [] ELSE list_distinct(list_transform(generate_series(1, length({0}) - 2), lambda i: substr({0}, i, 3))) END"


@query(f"WITH {_PREVIOUS}, l AS (SELECT doc_id, other_id, lower(text) AS a, lower(other) AS b FROM p WHERE other_id IS NOT NULL), g AS (SELECT doc_id, other_id, {_GRAMS.format('a')} AS x, {_GRAMS.format('b')} AS y FROM l) SELECT doc_id AS a, other_id AS b, round(coalesce(len(list_intersect(x, y)) / nullif(len(x) + len(y) - len(list_intersect(x, y)), 0), 0), 6)::DOUBLE AS jaccard FROM g")
def trigram_jaccard(spark, d):
    """Lexical similarity of each document and the one before in its source, over whole texts."""
    rows = _with_previous(spark, d)
    return rows.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"), F.round(tx.trigram_jaccard(F.col("text"), F.col("other")), 6).alias("jaccard"))


_ENTROPY = "c AS (SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(left(hex(encode(text)), 2048), '..')) AS b FROM documents) GROUP BY 1, 2), h AS (SELECT doc_id, round(-sum(n / t * log2(n / t)) / 8, 9) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t FROM c) GROUP BY 1)"


@query(f"WITH {_ENTROPY} SELECT doc_id, round(coalesce(entropy, 0), 5) AS entropy, CASE WHEN coalesce(octet_length(encode(text)), 0) < 1024 OR entropy > 0.9 THEN 'none' WHEN entropy < 0.5 THEN 'zstd' ELSE 'snappy' END AS choice FROM documents LEFT JOIN h USING (doc_id)")
def entropy_choice(spark, d):
    """Entropy of a document's first 1024 bytes and the codec that goes with it; null and empty texts have none.

    It is rounded before it is compared, so that the order of summation doesn't decide at the bounds.
    """
    docs = load(spark, d, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.hex(F.substring(F.encode("text", "UTF-8"), 1, 1024)).alias("head"))
    pairs = F.regexp_extract_all(F.coalesce("head", F.lit("")), F.lit(".."), F.lit(0))
    # A byte's count comes from the row itself: 256 values at most, so nothing is shuffled.
    counts = F.transform(F.array_distinct(pairs), lambda b: F.size(F.filter(pairs, lambda x: x == b)) / F.greatest(F.size(pairs), F.lit(1)))
    entropy = F.round(F.aggregate(counts, F.lit(0.0), lambda h, p: h - p * F.log2(p)) / 8, 9)
    rows = docs.withColumn("h", entropy)
    return rows.select("doc_id", F.round("h", 5).alias("entropy"), F.when((F.col("size") < 1024) | (F.col("h") > 0.9), "none").when(F.col("h") < 0.5, "zstd").otherwise("snappy").alias("choice"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'semantic_aware' WHEN lang = 'de' THEN 'brotli' WHEN lang = 'fr' THEN 'lz4' ELSE 'zlib' END AS algorithm FROM documents")
def algorithm_choice(spark, d):
    """Codec by kind of data; languages stand for text, structured, binary and other blocks."""
    kind = F.when(F.col("lang") == "en", "text").when(F.col("lang") == "de", "json").when(F.col("lang") == "fr", "binary").otherwise("other")
    choice = F.when(F.col("kind") == "embeddings", "hsc").when(F.col("kind") == "text", "semantic_aware").when(F.col("kind").isin("json", "xml"), "brotli").when(F.col("kind").isin("binary", "image", "video"), "lz4").otherwise("zlib")
    return load(spark, d, "documents").select("doc_id", kind.alias("kind")).select("doc_id", choice.alias("algorithm"))


@query(f"WITH w AS (SELECT conv_id, turn, list_distinct({_WORDS.format('text')}) AS l, lower(text) AS t FROM conversations) SELECT conv_id, turn, s AS score FROM (SELECT conv_id, turn, CASE WHEN len(list_intersect(l, ['the', 'and', 'zzz'])) > 0 THEN len(list_intersect(l, ['the', 'and', 'zzz'])) / 3.0 WHEN contains(t, 'the and zzz') THEN 0.5 ELSE 0.0 END::DOUBLE AS s FROM w) WHERE s > 0 ORDER BY s DESC, conv_id, turn LIMIT 10")
def keyword_search(spark, d):
    rows = load(spark, d, "conversations").withColumn("score", tx.keyword_score(F.col("text"), "the and zzz")).where("score > 0")
    return rows.orderBy(F.desc("score"), "conv_id", "turn").limit(10).select("conv_id", "turn", "score")


@query(f"WITH w AS (SELECT conv_id, turn, len(list_intersect(list_distinct({_WORDS.format('text')}), ['of', 'the', 'erth'])) AS n FROM conversations) SELECT conv_id, count(*) AS matches, least(1.0, arg_max(n, turn) / 3.0)::DOUBLE AS confidence FROM w WHERE n > 0 GROUP BY 1")
def keyword_reasoning(spark, d):
    """Confidence is what the last matching text gives, not the best one."""
    asked = F.array(*map(F.lit, ("of", "the", "erth")))
    rows = load(spark, d, "conversations").withColumn("n", F.size(F.array_intersect(F.array_distinct(tx.words(F.col("text"))), asked))).where("n > 0")
    return rows.groupBy("conv_id").agg(F.count("*").alias("matches"), F.least(F.lit(1.0), F.max_by("n", "turn") / 3.0).alias("confidence"))


@query("SELECT doc_id, length(text) // 4 AS tokens, CASE WHEN length(text) > 50 THEN left(text, 50) || '... [truncated, ' || length(text) || ' total]' ELSE text END AS shown FROM documents")
def token_estimate(spark, d):
    return load(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"), tx.truncated(F.col("text"), 50).alias("shown"))


@query("SELECT conv_id, round((least(count(DISTINCT role) / 3.0, 1.0) * 0.3 + 0.8 * 0.4 + least(count(*) / 10.0, 1.0) * 0.3)::DOUBLE / 3, 6) AS score FROM conversations GROUP BY 1")
def understanding_score(spark, d):
    roles, turns = F.count_distinct("role"), F.count("*")
    score = F.least(roles / 3.0, F.lit(1.0)) * 0.3 + F.lit(0.8) * 0.4 + F.least(turns / 10.0, F.lit(1.0)) * 0.3
    return load(spark, d, "conversations").groupBy("conv_id").agg(F.round(score / 3, 6).alias("score"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion')")
def substring_search(spark, d):
    return load(spark, d, "conversations").where(F.contains(F.lower("text"), F.lit("tion"))).select("conv_id", "turn")


# Vectors

_Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def _first(spark, d):
    return vectors(spark, d).where("vec_id = 0").first()["vector"]


@query(f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, d):
    rows = search.scored(vectors(spark, d), _first(spark, d)).withColumn("score", F.round("score", 6))
    return search.top_k(rows, 10, "vec_id").select("vec_id", "score")


@query(f"SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20) WHERE score >= 0.3")
def threshold_after_limit(spark, d):
    rows = search.scored(vectors(spark, d), _first(spark, d)).withColumn("score", F.round("score", 6))
    return search.top_k(rows, 20, "vec_id", at_least=0.3, before=False).select("vec_id", "score")


@query(f"SELECT * FROM (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_Q0}), 6) AS score FROM embeddings) WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 5")
def threshold_before_limit(spark, d):
    rows = search.scored(vectors(spark, d), _first(spark, d)).withColumn("score", F.round("score", 6))
    return search.top_k(rows, 5, "vec_id", at_least=0.2).select("vec_id", "score")


@query(f"WITH {SQL_E}, p AS (SELECT q.vec_id AS q_id, e.vec_id, round(list_cosine_similarity(q.vector, e.vector), 6) AS score FROM e q JOIN e USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id) SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank, score FROM p QUALIFY rank <= 5")
def batched_topk(spark, d):
    rows = vectors(spark, d)
    queries = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector"), "label")
    return search.batched_top_k(queries, rows, 5, ["label"])


@query(f"WITH {SQL_E}, p AS (SELECT q.vec_id AS q_id, e.vec_id, round(list_cosine_similarity(q.vector, e.vector), 6) AS score FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 50 = 0) SELECT q_id, vec_id, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, vec_id) AS rank, score FROM p QUALIFY rank <= 5")
def batched_topk_all(spark, d):
    """As batched_topk, but among all rows, whatever their label."""
    rows = vectors(spark, d)
    return blocked.top_k(rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("vector").alias("q_vector")), rows, 5)


@query(f"SELECT vec_id, round(greatest(0, 1 - list_distance(embedding::DOUBLE[], {_Q0}) / 2), 6) AS score FROM embeddings WHERE label IN (1, 2, 3) ORDER BY score DESC, vec_id LIMIT 10")
def l2_search(spark, d):
    rows = vectors(spark, d).where("label IN (1, 2, 3)")
    score = F.greatest(F.lit(0.0), 1 - l2(F.col("vector"), F.lit(_first(spark, d))) / 2)
    return rows.withColumn("score", F.round(score, 6)).orderBy(F.desc("score"), "vec_id").limit(10).select("vec_id", "score")


@query(f"WITH {SQL_E} SELECT a.vec_id AS a, b.vec_id AS b, coalesce(nullif(round(list_cosine_similarity(a.vector, b.vector), 4), 0), 0)::DOUBLE AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id")
def similarity_pairs(spark, d):
    return blocked.all_pairs(vectors(spark, d), by="label", digits=4)


@query(f"WITH {SQL_E} SELECT a.vec_id AS a, b.vec_id AS b, coalesce(nullif(round(list_cosine_similarity(a.vector, b.vector), 4), 0), 0)::DOUBLE AS score FROM e a JOIN e b ON a.vec_id < b.vec_id")
def similarity_pairs_all(spark, d):
    """As similarity_pairs, but all pairs, whatever their label: as many rows as half the square of the vectors."""
    return blocked.all_pairs(vectors(spark, d), digits=4)


@query(f"WITH {SQL_E} SELECT a.label, round(avg(list_cosine_similarity(a.vector, b.vector)), 6) AS coherence FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1")
def coherence_by_group(spark, d):
    return search.mean_pairwise_cosine(vectors(spark, d), "label").select("label", F.round("coherence", 6).alias("coherence"))


@query(f"WITH {SQL_E} SELECT label, i - 1 AS i, round(avg(x), 6) AS mean FROM (SELECT label, unnest(vector) AS x, unnest(generate_series(1, len(vector))) AS i FROM e) GROUP BY 1, 2")
def centroids(spark, d):
    return search.centroids(vectors(spark, d), "label").select("label", "i", F.round("mean", 6).alias("mean"))


_CENTROID = f"{SQL_E}, m AS (SELECT label, i, avg(x) AS c FROM (SELECT label, unnest(vector) AS x, unnest(generate_series(1, len(vector))) AS i FROM e) GROUP BY 1, 2), cv AS (SELECT label, list(c ORDER BY i) AS centroid FROM m GROUP BY 1)"


@query(f"WITH {_CENTROID} SELECT round(sqrt(avg(list_distance(vector, centroid) ** 2)), 5) AS row_error, round(sqrt(avg(list_distance(vector, centroid) ** 2) / 64), 5) AS component_error FROM e JOIN cv USING (label)")
def reconstruction_rmse(spark, d):
    return search.reconstruction(vectors(spark, d), "label").select(F.round("row_error", 5).alias("row_error"), F.round("component_error", 5).alias("component_error"))


@query(f"WITH {_CENTROID} SELECT round(avg(list_cosine_similarity(vector, centroid)), 6) AS fidelity, round(count(*) / count(DISTINCT label), 6) AS ratio FROM e JOIN cv USING (label)")
def cosine_fidelity(spark, d):
    return search.reconstruction(vectors(spark, d), "label").select(F.round("fidelity", 6).alias("fidelity"), F.round("ratio", 6).alias("ratio"))


@query(f"WITH {SQL_E}, r AS (SELECT min(list_min(vector)) AS lo, max(list_max(vector)) AS hi FROM e) SELECT vec_id, list_transform(vector, lambda x: round_even((x - lo) / ((hi - lo) / 255), 0)::BIGINT) AS codes FROM e, r")
def quantise(spark, d):
    return search.quantised(vectors(spark, d)).select("vec_id", "codes")


def _trusted(spark, d):
    return vectors(spark, d).withColumn("trust", 1.0 - (F.col("vec_id") % 5) / 10.0)


_ATTEND = f"{SQL_E}, t AS (SELECT *, 1.0::DOUBLE - (vec_id % 5) / 10.0 AS trust FROM e), s AS (SELECT x.label, x.vec_id AS a, y.vec_id AS b, list_dot_product(x.vector, y.vector) / 8 * CASE WHEN x.vec_id = y.vec_id THEN 1.0::DOUBLE ELSE greatest(0, least(1, list_cosine_similarity(x.vector, y.vector) * least(x.trust, y.trust))) END AS z FROM t x JOIN t y USING (label)), x AS (SELECT *, exp(z - max(z) OVER (PARTITION BY a)) AS p FROM s), w AS (SELECT label, a, b, p / sum(p) OVER (PARTITION BY a) AS weight FROM x)"


@query(f"WITH {_ATTEND} SELECT label, a, b, round(weight, 6) AS weight FROM w")
def coherence_attention(spark, d):
    return blocked.attention(_trusted(spark, d), "label", digits=6)


@query(f"WITH {_ATTEND} SELECT a, i - 1 AS i, coalesce(nullif(round(sum(weight * v), 5), 0), 0)::DOUBLE AS x FROM (SELECT a, weight, unnest(vector) AS v, unnest(generate_series(1, 64)) AS i FROM w JOIN e ON w.b = e.vec_id) GROUP BY 1, 2")
def attended_vector(spark, d):
    return blocked.attended(_trusted(spark, d), "label").select("a", "i", F.coalesce(F.nullif(F.round("x", 5), F.lit(0.0)), F.lit(0.0)).alias("x"))


# TF-IDF over all documents

_TFIDF = f"d AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\pL\\pN_]{{2,}}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), r AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1.0 + n) / (1.0 + df)) + 1) AS w FROM tf JOIN df USING (term), n), l AS (SELECT doc_id, sqrt(sum(w * w)) AS len FROM r GROUP BY 1), wt AS (SELECT doc_id, term, w / len AS weight FROM r JOIN l USING (doc_id))"


def _weights(spark, d):
    docs = _docs(spark, d)
    return search.tf_idf(cut(search.terms(docs, F.col("text"))), docs.count())


@query(f"WITH {_TFIDF} SELECT doc_id, term, round(weight, 5) AS weight FROM wt")
def tfidf_weights(spark, d):
    return _weights(spark, d).select("doc_id", "term", F.round("weight", 5).alias("weight"))


@query(f"WITH {_TFIDF} SELECT o.doc_id, round(sum(o.weight * q.weight), 5) AS score FROM wt o JOIN wt q USING (term) WHERE q.doc_id = 0 AND o.doc_id <> 0 GROUP BY 1 ORDER BY score DESC, o.doc_id LIMIT 10")
def tfidf_search(spark, d):
    """The documents nearest to document 0, each term looked up among its own."""
    docs = _docs(spark, d)
    found = search.tf_idf_nearest(cut(search.terms(docs, F.col("text"))), docs.count(), 0)
    return found.select("doc_id", F.round("score", 5).alias("score")).orderBy(F.desc("score"), "doc_id").limit(10)


# Graphs

_EDGES = "ed AS (SELECT 's' || s_suppkey AS u, 'n' || s_nationkey AS v FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def _edges(spark, d):
    a = load(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("u"), F.concat(F.lit("n"), "s_nationkey").alias("v"))
    return a.unionByName(load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("u"), F.concat(F.lit("r"), "n_regionkey").alias("v")))


@query(f"WITH RECURSIVE {_EDGES}, b AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed), w AS (SELECT 's1' AS node, 0 AS hops UNION SELECT b.v, hops + 1 FROM w JOIN b ON w.node = b.u WHERE hops < 3) SELECT node, min(hops)::INT AS hops FROM w GROUP BY 1")
def kg_neighbourhood(spark, d):
    return graph.neighbourhood(_edges(spark, d), ["s1"], 3)


@query("SELECT doc_id, doc_id * 2 AS missing FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def dependency_dangling(spark, d):
    docs = load(spark, d, "documents").select("doc_id", (F.col("doc_id") * 2).alias("missing"))
    return docs.join(docs.select(F.col("doc_id").alias("k")), F.col("missing") == F.col("k"), "left_anti")


@query("SELECT b AS block, count(*) AS dependents FROM (SELECT DISTINCT doc_id, unnest([doc_id // 2, doc_id // 3]) AS b FROM documents WHERE doc_id > 0) GROUP BY 1")
def dependency_dependents(spark, d):
    """How many blocks depend on each; a block depends on two others, which may be the same one."""
    deps = F.explode(F.array_distinct(F.array(F.floor(F.col("doc_id") / 2), F.floor(F.col("doc_id") / 3))))
    return load(spark, d, "documents").where("doc_id > 0").select("doc_id", deps.alias("block")).groupBy("block").agg(F.count("*").alias("dependents"))


@query(f"WITH {_EDGES} SELECT node, CASE left(node, 1) WHEN 's' THEN 0 WHEN 'n' THEN CASE WHEN node IN (SELECT v FROM ed) THEN 1 ELSE 0 END ELSE 2 END::BIGINT AS level FROM (SELECT u AS node FROM ed UNION SELECT v FROM ed)")
def topological_levels(spark, d):
    edges = _edges(spark, d)
    return graph.levels(edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node"))), edges)


@query("WITH RECURSIVE ed AS (SELECT n_nationkey AS u, (n_nationkey * 7 + 3) % 25 AS v FROM nation), w AS (SELECT u, v FROM ed UNION SELECT w.u, ed.v FROM w JOIN ed ON w.v = ed.u) SELECT u AS node FROM w WHERE u = v")
def cycle_check(spark, d):
    edges = load(spark, d, "nation").select(F.col("n_nationkey").alias("u"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("v"))
    return graph.on_cycles(edges)


@query("WITH t AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS dep FROM orders) SELECT o_orderkey FROM t WHERE o_orderstatus = 'O' AND (dep IS NULL OR dep = 'F')")
def ready_tasks(spark, d):
    """Open orders whose customer's order before is finished: tasks whose dependency is completed."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").withColumn("dep", F.lag("o_orderstatus").over(w)).where("o_orderstatus = 'O' AND (dep IS NULL OR dep = 'F')").select("o_orderkey")


@query(f"WITH RECURSIVE {SQL_E}, s AS (SELECT * FROM e), ed AS (SELECT a.vec_id AS u, b.vec_id AS v FROM s a JOIN s b ON a.label = b.label AND a.vec_id < b.vec_id WHERE round(1 - list_cosine_similarity(a.vector, b.vector), 9) <= 0.75), bo AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed), w AS (SELECT vec_id AS node, vec_id AS c FROM s UNION SELECT bo.v, w.c FROM w JOIN bo ON bo.u = w.node) SELECT node, min(c) AS component FROM w GROUP BY 1")
def dbscan_components(spark, d):
    """With two points a cluster's core, density clusters are the components of the graph of near pairs (here: within a label)."""
    rows = vectors(spark, d)
    return graph.min_label_components(rows.select(F.col("vec_id").alias("node")), blocked.near_forest(rows, 0.75, by="label"))


@query(f"WITH RECURSIVE {SQL_E}, ed AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id < b.vec_id WHERE round(1 - list_cosine_similarity(a.vector, b.vector), 9) <= 0.75), bo AS (SELECT u, v FROM ed UNION ALL SELECT v, u FROM ed), w AS (SELECT vec_id AS node, vec_id AS c FROM e UNION SELECT bo.v, w.c FROM w JOIN bo ON bo.u = w.node) SELECT node, min(c) AS component FROM w GROUP BY 1")
def dbscan_components_all(spark, d):
    """As dbscan_components, but over all vectors, whatever their label."""
    rows = vectors(spark, d)
    return graph.min_label_components(rows.select(F.col("vec_id").alias("node")), blocked.near_forest(rows, 0.75))
