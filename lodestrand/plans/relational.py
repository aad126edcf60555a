"""Joins, set operations, windows, memories, agents and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions.hashing import short_id
from lodestrand.functions.vectors import cosine
from lodestrand.operators import sequence as seq
from lodestrand.registry import query
from lodestrand.tables import SQL_A, SQL_E, audit, load, vectors


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, grouping_id(l_returnflag, l_linestatus)::BIGINT AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets_stats(spark, d):
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.grouping_id().cast("bigint").alias("gid"))


@query("SELECT year(o_orderdate)::BIGINT AS y, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (y, o_orderpriority)")
def rollup_costs(spark, d):
    return load(spark, d, "orders").rollup(F.year("o_orderdate").cast("bigint").alias("y"), "o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, ntile(4) OVER u AS quartile, lead(o_orderkey) OVER u AS next_key, round(cume_dist() OVER w, 6) AS cd, round(percent_rank() OVER w, 6) AS pr FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority), u AS (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey)")
def rank_functions(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    u = Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")
    return load(spark, d, "orders").select("o_orderkey", F.rank().over(w).cast("bigint").alias("r"), F.dense_rank().over(w).cast("bigint").alias("dr"), F.ntile(4).over(u).cast("bigint").alias("quartile"), F.lead("o_orderkey").over(u).alias("next_key"), F.round(F.cume_dist().over(w), 6).alias("cd"), F.round(F.percent_rank().over(w), 6).alias("pr"))


@query("SELECT p.event_id, s.event_id AS signup_id, s.ts AS signup_ts FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts")
def asof_signup(spark, d):
    """The last signup at or before each purchase: both in one order, the last one carried on; no pairs are made."""
    rows = load(spark, d, "events").where("event_type IN ('purchase', 'signup')")
    w = Window.partitionBy("user_id").orderBy("ts", F.col("event_type") == "purchase", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "signup", F.struct("event_id", "ts")), ignorenulls=True).over(w)
    return rows.withColumn("s", last).where("event_type = 'purchase'").select("event_id", F.col("s.event_id").alias("signup_id"), F.col("s.ts").alias("signup_ts"))


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS has_pending FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, d):
    who, orders = load(spark, d, "customer").select("c_custkey"), load(spark, d, "orders")
    key = orders.select(F.col("o_custkey").alias("c_custkey"))
    pending = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    have = who.join(key, "c_custkey", "left_semi")
    parts = [have.join(pending, "c_custkey", "left_semi").withColumn("has_pending", F.lit(True)), have.join(pending, "c_custkey", "left_anti").withColumn("has_pending", F.lit(False)), who.join(key, "c_custkey", "left_anti").withColumn("has_pending", F.lit(None).cast("boolean"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("(SELECT user_id, 'both' AS part FROM (SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup')) UNION ALL (SELECT user_id, 'only_error' FROM (SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'signup'))")
def set_ops(spark, d):
    rows = load(spark, d, "events")
    a, b = (rows.where(F.col("event_type") == t).select("user_id") for t in ("error", "signup"))
    return a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.subtract(b).withColumn("part", F.lit("only_error")))


@query("WITH l AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 21600000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM l) SELECT user_id, session, min(ts) AS start, max(ts) AS \"end\", count(*) AS n_events FROM s GROUP BY 1, 2")
def sessionize(spark, d):
    return seq.sessions(load(spark, d, "events"), "user_id", 21_600_000_000)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_counts(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts)::TIMESTAMP, (date_trunc('hour', ts) - INTERVAL 1 HOUR)::TIMESTAMP]) AS s FROM events) GROUP BY 1")
def sliding_counts(spark, d):
    return load(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT r_name, n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def star_join(spark, d):
    """Five tables: the two small ones are broadcast by their size, the others meet by key after partial aggregation."""
    t = {n: load(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    per_order = t["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("k"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    rows = per_order.join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.sum("k").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


# Memories


@query("SELECT doc_id, quality::BIGINT AS importance FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id) WHERE list_has_any([lang, source], ['de', 'src3']) AND list_has_all([lang, source, 'x'], ['x']) ORDER BY importance DESC, doc_id DESC LIMIT 25")
def memory_filters(spark, d):
    rows = load(spark, d, "documents").join(load(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").cast("bigint").alias("importance")), "doc_id")
    tags = F.array("lang", "source", F.lit("x"))
    some, every = F.arrays_overlap(tags, F.array(F.lit("de"), F.lit("src3"))), F.size(F.array_except(F.array(F.lit("x")), tags)) == 0
    return rows.where(some & every).orderBy(F.desc("importance"), F.desc("doc_id")).limit(25).select("doc_id", "importance")


@query("SELECT conv_id, turn FROM conversations WHERE NOT (conv_id = 3 OR turn < 1 OR role = 'system' OR length(text) < 50)")
def memory_forget(spark, d):
    gone = (F.col("conv_id") == 3) | (F.col("turn") < 1) | (F.col("role") == "system") | (F.length("text") < 50)
    return load(spark, d, "conversations").where(~gone).select("conv_id", "turn")


@query(f"WITH {SQL_A}, k AS (SELECT event_type || '/' || user_id AS key, ts, value, INTERVAL 1 DAY * (user_id % 20) AS ttl FROM a), l AS (SELECT key, arg_max(value, ts) AS value, max(ts) AS ts, arg_max(ttl, ts) AS ttl FROM k GROUP BY 1) SELECT key, split_part(key, '/', 1) AS namespace, value FROM l WHERE ts + ttl > (SELECT max(ts) FROM events)")
def ttl_keys(spark, d):
    """Keys whose last value hasn't outlived its time; the namespace is what stands before the first slash."""
    rows = audit(spark, d).select(F.concat_ws("/", "event_type", "user_id").alias("key"), "ts", "value", F.make_dt_interval(F.col("user_id").cast("int") % 20).alias("ttl"))
    now = rows.agg(F.max("ts")).first()[0]
    last = rows.groupBy("key").agg(F.max_by(F.struct("value", "ts", "ttl"), "ts").alias("l"))
    return last.where(F.col("l.ts") + F.col("l.ttl") > F.lit(now).cast("timestamp_ntz")).select("key", F.substring_index("key", "/", 1).alias("namespace"), "l.value")


@query("SELECT doc_id, vec_id, label::BIGINT AS label FROM documents JOIN embeddings ON doc_id = vec_id WHERE lang = 'fr'")
def text_embedding_join(spark, d):
    return load(spark, d, "documents").where("lang = 'fr'").join(load(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id")).select("doc_id", "vec_id", F.col("label").cast("bigint").alias("label"))


@query(f"WITH {SQL_E}, k AS (SELECT vec_id, round(list_cosine_similarity(vector, (SELECT vector FROM e WHERE vec_id = 1)), 6) AS score FROM e ORDER BY score DESC, vec_id LIMIT 30) SELECT doc_id, score, source FROM k JOIN documents ON vec_id * 3 = doc_id")
def topk_join_documents(spark, d):
    """Search results with their documents; results without a document fall out."""
    rows = vectors(spark, d)
    asked = rows.where("vec_id = 1").first()["vector"]
    best = rows.withColumn("score", F.round(cosine(F.col("vector"), F.lit(asked)), 6)).orderBy(F.desc("score"), "vec_id").limit(30)
    return best.select((F.col("vec_id") * 3).alias("doc_id"), "score").join(load(spark, d, "documents").select("doc_id", "source"), "doc_id")


@query("WITH h AS (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS marker FROM conversations) SELECT conv_id, turn, role FROM h WHERE marker IS NULL OR turn > marker")
def chat_history_live(spark, d):
    """Messages after the last marker of their session; system rows stand for markers."""
    marker = F.max(F.when(F.col("role") == "system", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return load(spark, d, "conversations").withColumn("marker", marker).where("marker IS NULL OR turn > marker").select("conv_id", "turn", "role")


@query("SELECT a.event_id AS start_id, b.event_id AS end_id, round((epoch_us(b.ts) - epoch_us(a.ts)) / 1e6, 3) AS seconds FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase' AND json_extract_string(a.props, '$.k') = json_extract_string(b.props, '$.k')")
def run_pairs(spark, d):
    rows = audit(spark, d)
    a = rows.where("event_type = 'signup'").select("user_id", "resource_id", F.col("event_id").alias("start_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t0"))
    b = rows.where("event_type = 'purchase'").select("user_id", "resource_id", F.col("event_id").alias("end_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t1"))
    return a.join(b, ["user_id", "resource_id"]).select("start_id", "end_id", F.round((F.col("t1") - F.col("t0")) / 1e6, 3).alias("seconds"))


@query("SELECT doc_id, left(sha256(text), 16) AS id16 FROM documents")
def doc_id16(spark, d):
    return load(spark, d, "documents").select("doc_id", short_id(F.col("text")).alias("id16"))


# Agents


@query("WITH a AS (SELECT s_suppkey AS agent, s_nationkey, s_suppkey % 10 AS load FROM supplier WHERE s_suppkey % 10 < 8), t AS (SELECT c_custkey AS task, c_nationkey FROM customer) SELECT task, arg_min(agent, (load, agent)) AS agent FROM t JOIN a ON c_nationkey = s_nationkey GROUP BY 1")
def agent_task_match(spark, d):
    """The least loaded agent with what each task needs: the best agent of each capability first, then one join."""
    agents = load(spark, d, "supplier").select(F.col("s_suppkey").alias("agent"), "s_nationkey", (F.col("s_suppkey") % 10).alias("load")).where("load < 8")
    best = agents.groupBy("s_nationkey").agg(F.min_by("agent", F.struct("load", "agent")).alias("agent"))
    return load(spark, d, "customer").join(best, F.col("c_nationkey") == F.col("s_nationkey")).select(F.col("c_custkey").alias("task"), "agent")


@query("WITH c AS (SELECT n_nationkey AS k, [n_nationkey % 4, n_nationkey % 3] AS protocols, [n_regionkey] AS types FROM nation) SELECT a.k AS a, b.k AS b, list_has_any(a.protocols, b.protocols) AND list_has_any(a.types, b.types) AS compatible FROM c a JOIN c b ON a.k < b.k AND a.types[1] = b.types[1]")
def protocol_overlap(spark, d):
    rows = load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.array(F.col("n_nationkey") % 4, F.col("n_nationkey") % 3).alias("protocols"), F.array("n_regionkey").alias("types"), "n_regionkey")
    x, y = rows.alias("x"), rows.alias("y")
    both = F.arrays_overlap("x.protocols", "y.protocols") & F.arrays_overlap("x.types", "y.types")
    return x.join(y, (F.col("x.k") < F.col("y.k")) & (F.col("x.n_regionkey") == F.col("y.n_regionkey"))).select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), both.alias("compatible"))


@query("WITH c AS (SELECT user_id, count_if(event_type = 'click') AS a, count_if(event_type = 'view') AS b, count_if(event_type = 'purchase') AS c FROM events GROUP BY 1) SELECT x.user_id AS x, y.user_id AS y, CASE WHEN x.a <= y.a AND x.b <= y.b AND x.c <= y.c AND (x.a < y.a OR x.b < y.b OR x.c < y.c) THEN 'before' WHEN x.a >= y.a AND x.b >= y.b AND x.c >= y.c AND (x.a > y.a OR x.b > y.b OR x.c > y.c) THEN 'after' WHEN x.a = y.a AND x.b = y.b AND x.c = y.c THEN 'equal' ELSE 'concurrent' END AS relation FROM c x JOIN c y ON x.user_id + 1 = y.user_id")
def vector_clock_order(spark, d):
    """How the clocks of agents with neighbouring numbers are ordered."""
    counts = load(spark, d, "events").where("event_type IN ('click', 'view', 'purchase')").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    clocks = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("clock"))
    who = load(spark, d, "events").select("user_id").distinct()
    clocks = who.join(clocks, "user_id", "left").select("user_id", F.coalesce("clock", F.create_map().cast("map<string,bigint>")).alias("clock"))
    pairs = clocks.select(F.col("user_id").alias("x"), F.col("clock").alias("cx")).join(clocks.select((F.col("user_id") - 1).alias("x"), F.col("user_id").alias("y"), F.col("clock").alias("cy")), "x")
    signs = F.map_values(F.map_zip_with("cx", "cy", lambda k, a, b: F.signum(F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))))
    less, more = F.exists(signs, lambda s: s < 0), F.exists(signs, lambda s: s > 0)
    return pairs.select("x", "y", F.when(less & more, "concurrent").when(less, "before").when(more, "after").otherwise("equal").alias("relation"))


# Reports


@query("SELECT 'lang' AS dimension, lang AS value, count(*) AS n, sum(n_chars)::BIGINT AS size FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), sum(n_chars)::BIGINT FROM documents GROUP BY source UNION ALL SELECT 'all', NULL, count(*), sum(n_chars)::BIGINT FROM documents")
def metadata_statistics(spark, d):
    load(spark, d, "documents").createOrReplaceTempView("__documents")
    return spark.sql("SELECT CASE grouping_id() WHEN 1 THEN 'lang' WHEN 2 THEN 'source' ELSE 'all' END AS dimension, coalesce(lang, source) AS value, count(*) AS n, sum(n_chars) AS size FROM __documents GROUP BY GROUPING SETS ((lang), (source), ()) ")


@query("WITH p AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'high' WHEN '2-HIGH' THEN 'medium' ELSE 'low' END AS level, CASE WHEN o_orderkey % 3 = 0 THEN 'aes' ELSE 'none' END AS mode FROM orders) SELECT kind, name, n FROM (SELECT 'level' AS kind, l AS name, (SELECT count(*) FROM p WHERE level = l) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('secret')) t(l) UNION ALL SELECT 'mode', m, (SELECT count(*) FROM p WHERE mode = m) FROM (VALUES ('aes'), ('chacha20'), ('none')) t(m))")
def privacy_report(spark, d):
    rows = load(spark, d, "orders").select(F.when(F.col("o_orderpriority") == "1-URGENT", "high").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("low").alias("level"), F.when(F.col("o_orderkey") % 3 == 0, "aes").otherwise("none").alias("mode"))
    counts = rows.unpivot([], ["level", "mode"], "kind", "name").groupBy("kind", "name").agg(F.count("*").alias("n"))
    listed = spark.createDataFrame([("level", x) for x in ("high", "medium", "low", "secret")] + [("mode", x) for x in ("aes", "chacha20", "none")], "kind string, name string")
    return listed.join(counts, ["kind", "name"], "left").select("kind", "name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@query("SELECT count(*) AS total, count_if(event_type <> 'error')::BIGINT AS successful, count_if(event_type = 'error')::BIGINT AS failed, round(count(*) / ((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6), 6) AS per_second FROM events")
def batch_outcomes(spark, d):
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return load(spark, d, "events").agg(F.count("*").alias("total"), F.count_if(F.col("event_type") != "error").alias("successful"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.count("*") / ((F.max(us) - F.min(us)) / 1e6), 6).alias("per_second"))


@query("WITH x AS (SELECT 's' || l_suppkey AS agent FROM lineitem UNION ALL SELECT 'p' || l_partkey FROM lineitem) SELECT agent, count(*) AS n FROM x GROUP BY 1 ORDER BY n DESC, agent LIMIT 5")
def exchange_analytics(spark, d):
    rows = load(spark, d, "lineitem")
    both = rows.select(F.concat(F.lit("s"), "l_suppkey").alias("agent")).unionByName(rows.select(F.concat(F.lit("p"), "l_partkey").alias("agent")))
    return both.groupBy("agent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agent").limit(5)


@query("SELECT o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(avg((o_orderstatus = 'F')::INT), 4) AS success FROM orders GROUP BY 1")
def exchange_outcomes(spark, d):
    return load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.percentile("o_totalprice", 0.95), 4).alias("p95"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 4).alias("success"))


@query("SELECT conv_id AS session_id, count(*) AS blocks, sum(length(text))::BIGINT AS chars, max(turn) - min(turn) AS duration, count_if(length(text) < 20)::BIGINT AS violations FROM conversations GROUP BY 1")
def session_stats(spark, d):
    return load(spark, d, "conversations").groupBy(F.col("conv_id").alias("session_id")).agg(F.count("*").alias("blocks"), F.sum(F.length("text")).alias("chars"), (F.max("turn") - F.min("turn")).alias("duration"), F.count_if(F.length("text") < 20).alias("violations"))


@query("SELECT label::BIGINT AS cluster, count(*) AS size, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY 1")
def cluster_stats(spark, d):
    return load(spark, d, "embeddings").groupBy(F.col("label").cast("bigint").alias("cluster")).agg(F.count("*").alias("size"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS place FROM orders WHERE o_orderstatus <> 'F'")
def priority_queue(spark, d):
    """Messages of each receiver in the order they are taken; finished ones have gone."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority", "o_orderkey")).cast("bigint")
    return load(spark, d, "orders").where("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", place.alias("place"))
