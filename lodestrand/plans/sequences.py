"""Integrity, forensics, profiles, state and lifecycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions.hashing import GENESIS, content_hash, shard_of, short_id
from lodestrand.operators import aggregates as agg
from lodestrand.operators import events as ev
from lodestrand.operators import graph, integrity
from lodestrand.operators import sequence as seq
from lodestrand.registry import query
from lodestrand.tables import SQL_V, blocks, load, micros, versions


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(unhex(sha256(text)) || encode(lang)) AS block_hash FROM documents", name="content_hash")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select(F.col("seq").alias("doc_id"), content_hash(F.col("data")).alias("content_hash"), content_hash(F.col("data"), F.col("lang")).alias("block_hash"))


@query(f"SELECT source AS artifact_id, doc_id, coalesce(lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id), '{GENESIS}') AS previous_hash, sha256(text) AS content_hash FROM documents")
def hash_chain(spark, d):
    return integrity.hash_chain(blocks(spark, d)).select("artifact_id", F.col("seq").alias("doc_id"), "previous_hash", "content_hash")


@query("WITH c AS (SELECT source AS artifact_id, doc_id, sha256(text) AS h, CASE WHEN doc_id % 50 = 0 THEN 'broken' ELSE lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) END AS p, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS e FROM documents) SELECT artifact_id, doc_id, e AS expected FROM c WHERE e IS NOT NULL AND p IS DISTINCT FROM e")
def provenance_link_check(spark, d):
    rows = integrity.hash_chain(blocks(spark, d)).withColumn("previous_hash", F.when(F.col("seq") % 50 == 0, "broken").otherwise(F.col("previous_hash")))
    return ev.chain_breaks(rows, "artifact_id", "previous_hash", "content_hash", "seq").select("artifact_id", F.col("seq").alias("doc_id"), "expected")


_EXPECTED = "WITH m AS (SELECT doc_id, sha256(text) AS h, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 11 = 0 THEN 'x' ELSE sha256(text) END AS e FROM documents)"


def _verified(spark, d):
    rows = blocks(spark, d).withColumn("hash", content_hash(F.col("data")))
    manifest = rows.where("seq % 3 <> 0").select("seq", F.when(F.col("seq") % 11 == 0, "x").otherwise(F.col("hash")).alias("expected"))
    return integrity.against_manifest(rows.select("seq", "hash"), manifest, "seq")


@query(f"{_EXPECTED} SELECT doc_id, e IS NULL OR e = h AS valid FROM m")
def expected_hash_join(spark, d):
    return _verified(spark, d).select(F.col("seq").alias("doc_id"), "valid")


@query(f"{_EXPECTED} SELECT count(*) AS total, count_if(e IS NULL OR e = h)::BIGINT AS valid, count_if(e <> h)::BIGINT AS tampered, round(100.0::DOUBLE * avg((e IS NULL OR e = h)::INT), 6) AS percent FROM m")
def integrity_summary(spark, d):
    return integrity.summary(_verified(spark, d))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_blocks(spark, d):
    return blocks(spark, d).groupBy(content_hash(F.col("data")).alias("content_hash")).agg(F.count("*").alias("n"), F.min("seq").alias("first_doc"), F.max("seq").alias("last_doc")).where("n > 1")


@query(
    """WITH RECURSIVE l AS (SELECT source AS a, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n, sha256(text) AS h FROM documents),
t AS (SELECT a, list(h ORDER BY i) AS hs, any_value(n) AS n FROM l GROUP BY a
UNION ALL SELECT a, list_transform(generate_series(1, (len(hs) + 1) // 2), lambda k: sha256(unhex(hs[2 * k - 1] || coalesce(hs[2 * k], hs[2 * k - 1])))), n FROM t WHERE len(hs) > 1)
SELECT a AS artifact_id, hs[1] AS root, n AS n_leaves FROM t WHERE len(hs) = 1"""
)
def merkle_root(spark, d):
    return integrity.merkle_roots(blocks(spark, d).select("artifact_id", "seq", content_hash(F.col("data")).alias("hash")))


@query("SELECT rule, severity, doc_id FROM (SELECT 'empty' AS rule, 'warning' AS severity, doc_id FROM documents WHERE trim(text) = '' UNION ALL SELECT 'length', 'error', doc_id FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'duplicate', 'warning', doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1 UNION ALL SELECT 'oversize', 'warning', doc_id FROM documents WHERE n_chars > 10000)")
def validation_findings(spark, d):
    return integrity.findings(blocks(spark, d)).withColumnRenamed("seq", "doc_id")


@query("WITH f AS (SELECT 'duplicate' AS rule, doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r > 1 UNION ALL SELECT 'length', doc_id FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'oversize', doc_id FROM documents WHERE n_chars > 10000 UNION ALL SELECT 'empty', doc_id FROM documents WHERE trim(text) = '') SELECT CASE WHEN rule = 'length' THEN 'requires_resigning' ELSE 'repairable' END AS triage, count(*) AS n FROM f GROUP BY 1")
def repair_triage(spark, d):
    triage = F.when(F.col("rule") == "length", "requires_resigning").otherwise("repairable")
    return integrity.findings(blocks(spark, d)).groupBy(triage.alias("triage")).agg(F.count("*").alias("n"))


def _ranged(us_before: int, us_after: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"count(*) OVER ({part}ORDER BY epoch_us(ts) RANGE BETWEEN {us_before} PRECEDING AND {us_after} FOLLOWING)"


HOUR, MINUTE = 3_600_000_000, 60_000_000


@query(f"SELECT event_id, ts, n_near FROM (SELECT event_id, ts, {_ranged(5 * HOUR, 0)} AS n_near FROM events) WHERE n_near > 5")
def rapid_changes(spark, d):
    """More than five operations within five hours up to one (five seconds in a real log; the events here are sparse)."""
    return seq.range_count(load(spark, d, "events").select("event_id", "ts"), 5 * HOUR, 0).where("n_near > 5")


@query(f"SELECT event_id, n_near, n_near > 3 AS dense FROM (SELECT event_id, {_ranged(HOUR - 1, HOUR - 1)} AS n_near FROM events)")
def timeline_density(spark, d):
    return seq.range_count(load(spark, d, "events").select("event_id", "ts"), HOUR - 1, HOUR - 1).select("event_id", "n_near", (F.col("n_near") > 3).alias("dense"))


@query(f"WITH {SQL_V}, h AS (SELECT *, left(sha256(event_id::VARCHAR), 16) AS current_hash, CASE WHEN event_id % 40 = 0 THEN 'gap' ELSE lag(left(sha256(event_id::VARCHAR), 16)) OVER (PARTITION BY block_id ORDER BY version) END AS previous_hash, lag(left(sha256(event_id::VARCHAR), 16)) OVER (PARTITION BY block_id ORDER BY version) AS expected FROM v) SELECT block_id, version, expected FROM h WHERE expected IS NOT NULL AND previous_hash IS DISTINCT FROM expected")
def version_gaps(spark, d):
    rows = versions(spark, d).withColumn("current_hash", short_id(F.col("event_id").cast("string")))
    rows = rows.withColumn("previous_hash", F.when(F.col("event_id") % 40 == 0, "gap").otherwise(F.lag("current_hash").over(Window.partitionBy("block_id").orderBy("version"))))
    return ev.chain_breaks(rows, "block_id", "previous_hash", "current_hash", "version").select("block_id", "version", "expected")


@query("WITH l AS (SELECT user_id, event_id, CASE WHEN event_id % 20 = 7 THEN ts - INTERVAL 30 DAY ELSE ts END AS ts FROM events) SELECT user_id, event_id, ts FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM l) WHERE ts < p")
def timestamp_reversals(spark, d):
    """Entries of a log that are older than the one before; the clock of every twentieth entry is a month behind."""
    rows = load(spark, d, "events").withColumn("ts", F.when(F.col("event_id") % 20 == 7, F.expr("ts - INTERVAL 30 DAY")).otherwise(F.col("ts")))
    return rows.withColumn("p", F.lag("ts").over(Window.partitionBy("user_id").orderBy("event_id"))).where("ts < p").select("user_id", "event_id", "ts")


@query("SELECT user_id, event_id, round(gap / 1e6, 3) AS seconds FROM (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap, FROM events) WHERE gap < 600000000")
def fast_operations(spark, d):
    rows = seq.deltas(load(spark, d, "events"), ["user_id"], micros(), ["ts", "event_id"], "gap")
    return rows.where("gap < 600000000").select("user_id", "event_id", F.round(F.col("gap") / 1e6, 3).alias("seconds"))


@query("WITH g AS (SELECT user_id, ts, event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS gap FROM events), s AS (SELECT user_id, event_id, count(gap) OVER w AS n, stddev_samp(gap) OVER w AS sd FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 8 PRECEDING)) SELECT user_id, event_id, round(sd, 3) AS deviation FROM s WHERE n = 9")
def interval_regularity(spark, d):
    rows = seq.deltas(load(spark, d, "events"), ["user_id"], micros() / 1e6, ["ts", "event_id"], "gap")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-8, 0)
    return rows.withColumns({"n": F.count("gap").over(w), "sd": F.stddev_samp("gap").over(w)}).where("n = 9").select("user_id", "event_id", F.round("sd", 3).alias("deviation"))


@query("WITH b AS (SELECT event_type, event_id, value, count(value) OVER w AS n, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)) SELECT event_type, event_id, value FROM b WHERE n = 100 AND value > m + 1.5 * s")
def timing_baseline(spark, d):
    return seq.rolling_baseline(load(spark, d, "events"), ["event_type"], "value", ["ts", "event_id"], sigmas=1.5).select("event_type", "event_id", "value")


@query(f"SELECT user_id, event_id, n_near FROM (SELECT user_id, event_id, {_ranged(24 * HOUR - 1, 0, 'user_id')} AS n_near FROM events) WHERE n_near > 4")
def rate_limit(spark, d):
    rows = seq.range_count(load(spark, d, "events").select("user_id", "event_id", "ts"), 24 * HOUR - 1, 0, by=["user_id"])
    return rows.where("n_near > 4").select("user_id", "event_id", "n_near")


@query(f"SELECT event_id, n_near FROM (SELECT event_id, {_ranged(HOUR, 0)} AS n_near FROM events) WHERE n_near > 3")
def hourly_volume_anomaly_global(spark, d):
    return seq.range_count(load(spark, d, "events").select("event_id", "ts"), HOUR, 0).where("n_near > 3").select("event_id", "n_near")


@query(f"SELECT user_id, event_id, n_near FROM (SELECT user_id, event_id, {_ranged(12 * HOUR, 0, 'user_id')} AS n_near FROM events) WHERE n_near > 2")
def hourly_volume_anomaly(spark, d):
    rows = seq.range_count(load(spark, d, "events").select("user_id", "event_id", "ts"), 12 * HOUR, 0, by=["user_id"])
    return rows.where("n_near > 2").select("user_id", "event_id", "n_near")


_PROFILE = f"""{SQL_V}, p AS (SELECT agent_id, operation, count(*) AS n, min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi, count_if(hour(ts) >= 22 OR hour(ts) <= 6) AS night FROM v GROUP BY 1, 2),
t AS (SELECT agent_id, sum(n) AS total, min(lo) AS lo, max(hi) AS hi, sum(night) AS night, coalesce(sum(n) FILTER (operation = 'delete'), 0) AS deletes FROM p GROUP BY 1),
r AS (SELECT *, CASE WHEN total > 1 THEN CASE WHEN hi > lo THEN total / ((hi - lo) / 3.6e9) ELSE 0 END ELSE total * 3600.0 END AS rate FROM t),
o AS (SELECT *, list_filter([CASE WHEN deletes / total > 0.3 THEN 'high_deletion_ratio' END, CASE WHEN rate > 100 THEN 'excessive_activity_rate' END, CASE WHEN night / total > 0.5 THEN 'unusual_timing' END], lambda x: x IS NOT NULL) AS odd FROM r),
f AS (SELECT agent_id, total::BIGINT AS total_operations, round(rate, 6) AS operation_frequency, (SELECT coalesce(string_agg(operation, ',' ORDER BY operation), '') FROM p WHERE p.agent_id = o.agent_id AND p.n / o.total > 0.2) AS common_operations, array_to_string(odd, ',') AS unusual_patterns,
  round(least(1.0, least(0.3, deletes / total) + least(0.3, rate / 1000) + len(odd) * 0.2)::DOUBLE, 6) AS risk_score, round((night / total)::DOUBLE, 6) AS night_ratio FROM o)"""


@query(f"WITH {_PROFILE} SELECT * FROM f")
def agent_profile(spark, d):
    return agg.agent_profile(versions(spark, d))


def _evidence(spark, d):
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    return load(spark, d, "events").select("event_id", severity.alias("severity"), F.col("event_type").alias("anomaly_type"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))


_EVIDENCE = "v AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS severity, event_type AS anomaly_type, (event_id % 10) / 10.0::DOUBLE AS confidence FROM events), w AS (SELECT *, CASE severity WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.7 WHEN 'medium' THEN 0.4 ELSE 0.1 END::DOUBLE AS weight FROM v)"


@query(f"WITH {_EVIDENCE}, s AS (SELECT count(*) AS total_evidence, least(1.0, sum(weight * confidence) / count(*))::DOUBLE AS score, avg(confidence) AS m FROM w) SELECT total_evidence, round(score, 6) AS risk_score, CASE WHEN score >= 0.8 THEN 'critical' WHEN score >= 0.6 THEN 'high' WHEN score >= 0.3 THEN 'medium' ELSE 'low' END AS overall_risk, round(m, 6) AS confidence FROM s")
def risk_assessment(spark, d):
    return agg.risk_assessment(_evidence(spark, d))


@query(f"WITH {_EVIDENCE} SELECT anomaly_type, count(*) AS n, round(avg(weight), 6) AS average_severity FROM w GROUP BY 1")
def risk_factors(spark, d):
    return _evidence(spark, d).groupBy("anomaly_type").agg(F.count("*").alias("n"), F.round(F.avg(agg.severity_weight(F.col("severity"))), 6).alias("average_severity"))


@query(f"WITH {_EVIDENCE} SELECT s.severity, count(v.event_id) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) s(severity) LEFT JOIN v USING (severity) GROUP BY 1")
def evidence_summary(spark, d):
    return agg.with_zeros([*agg.SEVERITY, "info"], _evidence(spark, d).groupBy("severity").agg(F.count("*").alias("n")), "severity", "n")


_FREQ = "k AS (SELECT block_id, event_id, ts, row_number() OVER (PARTITION BY block_id ORDER BY version DESC) AS r FROM v), q AS (SELECT block_id, count(*) AS n, coalesce(count(*) * 3600.0 / nullif((max(epoch_us(ts)) - min(epoch_us(ts))) / 1e6, 0), 0)::DOUBLE AS freq FROM k WHERE r <= 100 GROUP BY 1)"


def _frequency(spark, d):
    recent = Window.partitionBy("block_id").orderBy(F.desc("version"))
    rows = versions(spark, d).withColumn("r", F.row_number().over(recent)).where("r <= 100")
    span = (F.max(micros()) - F.min(micros())) / 1e6
    return rows.groupBy("block_id").agg(F.count("*").alias("n"), F.coalesce(F.try_divide(F.count("*") * 3600.0, F.nullif(span, F.lit(0.0))), F.lit(0.0)).alias("freq"))


@query(f"WITH {SQL_V}, {_FREQ} SELECT block_id, n, round(freq, 6) AS frequency FROM q")
def access_frequency(spark, d):
    return _frequency(spark, d).select("block_id", "n", F.round("freq", 6).alias("frequency"))


@query(f"WITH {SQL_V}, {_FREQ}, o AS (SELECT block_id, row_number() OVER (ORDER BY round(freq, 9) DESC, block_id) AS r, count(*) OVER () AS c FROM q) SELECT block_id, CASE WHEN r <= c * 20 // 100 THEN 'hot' WHEN r > c * 80 // 100 THEN 'cold' ELSE 'warm' END AS tier FROM o")
def hot_cold_tiers(spark, d):
    rows = _frequency(spark, d).withColumn("least", -F.round("freq", 9))
    rows = seq.numbered(rows, ["least", "block_id"], "r").withColumn("r", F.col("r") + 1)
    rows = rows.withColumn("c", F.lit(rows.count()))
    tier = F.when(F.col("r") <= F.floor(F.col("c") * 20 / 100), "hot").when(F.col("r") > F.floor(F.col("c") * 80 / 100), "cold").otherwise("warm")
    return rows.select("block_id", tier.alias("tier"))


@query(f"WITH {SQL_V}, {_FREQ}, o AS (SELECT row_number() OVER (ORDER BY round(freq, 9) DESC, block_id) AS r, row_number() OVER (ORDER BY block_id) AS p, count(*) OVER () AS c FROM q) SELECT round((sum(abs(r - p)) / (max(c) * max(c) / 2.0))::DOUBLE, 6) AS fragmentation FROM o")
def fragmentation(spark, d):
    rows = seq.numbered(seq.numbered(_frequency(spark, d).withColumn("least", -F.round("freq", 9)), ["least", "block_id"], "r"), ["block_id"], "p")
    rows = rows.withColumn("c", F.lit(rows.count()))
    return rows.agg(F.round(F.sum(F.abs(F.col("r") - F.col("p"))) / (F.max("c") * F.max("c") / 2.0), 6).alias("fragmentation"))


_STATE = """c AS (SELECT *, max(CASE WHEN operation = 'signup' THEN version END) OVER (PARTITION BY block_id) AS born FROM v {w}),
s AS (SELECT block_id, arg_max(operation, version) AS op, count(*) AS n_events, arg_max(value, version) AS value, arg_max(agent_id, version) AS agent_id FROM c WHERE born IS NULL OR version >= born GROUP BY 1)"""


def _state(spark, d, until=None):
    rows = ev.latest_state(versions(spark, d), "block_id", ["value", "agent_id"], F.col("operation") == "signup", F.col("operation") == "error", ["version"], until)
    return rows.select("block_id", "n_events", "value", "agent_id")


@query(f"WITH {SQL_V}, {_STATE.format(w='')} SELECT block_id, n_events, value, agent_id FROM s WHERE op <> 'error'")
def latest_state(spark, d):
    return _state(spark, d)


@query(f"WITH {SQL_V}, {_STATE.format(w='WHERE version <= 20')} SELECT block_id, n_events, value, agent_id FROM s WHERE op <> 'error'")
def time_travel_state(spark, d):
    return _state(spark, d, F.col("version") <= 20)


@query(f"WITH {SQL_V} SELECT version, operation, agent_id, ts FROM v WHERE block_id = '42' AND operation IN ('signup', 'purchase', 'error')")
def block_history(spark, d):
    return versions(spark, d).where("block_id = '42' AND operation IN ('signup', 'purchase', 'error')").select("version", "operation", "agent_id", "ts")


@query(f"WITH {SQL_V}, l AS (SELECT *, lag(operation) OVER (PARTITION BY block_id ORDER BY version) AS p FROM v) SELECT block_id, version, operation FROM l WHERE version = 1 OR operation IS DISTINCT FROM p")
def cow_noop_filter(spark, d):
    rows = versions(spark, d)
    rows = rows.withColumn("same", ev.unchanged(rows, "block_id", F.col("operation"), ["version"]))
    return rows.where("NOT same").select("block_id", "version", "operation")


@query(f"WITH {SQL_V} SELECT block_id, max(version) AS version, arg_max(value, version) AS value FROM v WHERE version <= 15 AND operation <> 'error' GROUP BY 1")
def mvcc_snapshot_read(spark, d):
    """What a reader at snapshot 15 sees: the last committed version of each block up to it. Errors stand for aborted writes."""
    committed = versions(spark, d).where("version <= 15 AND operation <> 'error'")
    return ev.last_write(committed.withColumn("v", F.col("version")), "block_id", ["version", "value"], ["v"])


@query(f"WITH {SQL_V} SELECT block_id, max(version) AS version, arg_max(value, version) AS value, count_if(operation = 'error')::BIGINT AS uncommitted FROM v WHERE version <= 15 GROUP BY 1")
def mvcc_visible_read(spark, d):
    """The same without the commit check: versions count from when they are written."""
    return versions(spark, d).where("version <= 15").groupBy("block_id").agg(F.max("version").alias("version"), F.max_by("value", "version").alias("value"), F.count_if(F.col("operation") == "error").alias("uncommitted"))


@query("SELECT json_extract_string(props, '$.k') AS register, arg_max(value, (ts, user_id)) AS value, max(ts) AS ts FROM events GROUP BY 1")
def lww_register(spark, d):
    rows = load(spark, d, "events").select(F.get_json_object("props", "$.k").alias("register"), "value", "ts", "user_id")
    return ev.last_write(rows, "register", ["value", "ts"], ["ts", "user_id"])


@query("SELECT event_type AS counter, sum(m)::BIGINT AS value, count(*) AS nodes FROM (SELECT event_type, user_id, max(event_id) AS m FROM events GROUP BY 1, 2) GROUP BY 1")
def gcounter(spark, d):
    return load(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("event_id").alias("m")).groupBy(F.col("event_type").alias("counter")).agg(F.sum("m").alias("value"), F.count("*").alias("nodes"))


_ORSET = "WITH adds AS (SELECT json_extract_string(props, '$.k') AS element, event_id AS tag FROM events WHERE event_type <> 'error'), dead AS (SELECT json_extract_string(props, '$.k') AS element, event_id - 1 AS tag FROM events WHERE event_type = 'error')"


def _orset(spark, d):
    rows = load(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("element"))
    adds = rows.where("event_type <> 'error'").select("element", F.col("event_id").alias("tag"))
    dead = rows.where("event_type = 'error'").select("element", (F.col("event_id") - 1).alias("tag"))
    return adds, dead


@query(f"{_ORSET} SELECT element, count(*) AS tags FROM adds WHERE NOT EXISTS (SELECT 1 FROM dead WHERE dead.element = adds.element AND dead.tag = adds.tag) GROUP BY 1")
def orset(spark, d):
    adds, dead = _orset(spark, d)
    return adds.join(dead, ["element", "tag"], "left_anti").groupBy("element").agg(F.count("*").alias("tags"))


@query(f"{_ORSET} SELECT element, tag FROM adds EXCEPT SELECT element, tag FROM dead")
def orset_difference(spark, d):
    adds, dead = _orset(spark, d)
    return adds.subtract(dead)


@query("WITH o AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first FROM events) SELECT event_id, first AS root, (i - 1)::BIGINT AS depth FROM o")
def event_chain(spark, d):
    """Each event's chain of causes, walked back along the ids of previous events to where it began."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    links = load(spark, d, "events").select(F.col("event_id").alias("node"), F.lag("event_id").over(w).alias("parent"))
    return graph.walk(links).select(F.col("node").alias("event_id"), "root", "depth")


@query("WITH u AS (SELECT doc_id, text, 0 AS src FROM documents UNION ALL SELECT doc_id, text, 1 FROM documents WHERE doc_id % 2 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY src, doc_id) AS n FROM u) SELECT doc_id, src::BIGINT AS src, sha256(text) AS hash FROM r WHERE n = 1")
def merge_dedup(spark, d):
    docs = load(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    both = docs.withColumn("src", F.lit(0).cast("bigint")).unionByName(docs.where("doc_id % 2 = 0").withColumn("src", F.lit(1).cast("bigint")))
    # The least of a partial aggregate, not a window: a hash of many copies is met on the map side.
    return both.groupBy("hash").agg(F.min(F.struct("src", "doc_id")).alias("first")).select("first.doc_id", "first.src", "hash")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, user_id FROM events")
def merge_temporal(spark, d):
    return load(spark, d, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint").alias("place"), "user_id")


@query("SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html FROM pages")
def merge_append(spark, d):
    return load(spark, d, "documents").select("doc_id", "text").unionByName(load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")))


@query("SELECT source AS artifact_id, doc_id, ((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 10)::BIGINT AS part FROM documents")
def split_by_count(spark, d):
    numbers = seq.numbered_within(blocks(spark, d).select("artifact_id", "seq"), ["artifact_id"], ["seq"])
    return numbers.select("artifact_id", F.col("seq").alias("doc_id"), F.floor(F.col("number") / 10).alias("part"))


@query(
    """WITH RECURSIVE o AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
g AS (SELECT source, doc_id, i, 0::BIGINT AS bin, n_chars::DOUBLE AS held FROM o WHERE i = 1
UNION ALL SELECT o.source, o.doc_id, o.i, CASE WHEN g.held + o.n_chars > 8000 AND g.held > 0 THEN g.bin + 1 ELSE g.bin END, CASE WHEN g.held + o.n_chars > 8000 AND g.held > 0 THEN o.n_chars::DOUBLE ELSE g.held + o.n_chars END FROM g JOIN o ON o.source = g.source AND o.i = g.i + 1)
SELECT source AS artifact_id, doc_id AS seq, bin FROM g"""
)
def split_by_size_bins(spark, d):
    return seq.fill_bins(blocks(spark, d), ["artifact_id"], "n_chars", ["seq"], 8000)


@query("SELECT lang AS block_type, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def type_partition_counts(spark, d):
    return load(spark, d, "documents").groupBy(F.col("lang").alias("block_type")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("WITH have AS (SELECT DISTINCT lang FROM documents) SELECT e AS missing FROM (VALUES ('en'), ('de'), ('it'), ('pl')) t(e) WHERE e NOT IN (SELECT lang FROM have)")
def missing_types(spark, d):
    expected = spark.createDataFrame([("en",), ("de",), ("it",), ("pl",)], "missing string")
    return expected.subtract(load(spark, d, "documents").select("lang"))


@query("SELECT doc_id, CASE WHEN n_chars > 3000 THEN 0 WHEN n_chars > 1000 THEN 1 ELSE 2 END::BIGINT AS tier, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n_chars > 3000 THEN 0 WHEN n_chars > 1000 THEN 1 ELSE 2 END, doc_id) AS place FROM documents")
def layout_order(spark, d):
    tier = F.when(F.col("n_chars") > 3000, 0).when(F.col("n_chars") > 1000, 1).otherwise(2).cast("bigint")
    rows = blocks(spark, d).select("artifact_id", "seq", tier.alias("tier"))
    return seq.numbered_within(rows, ["artifact_id"], ["tier", "seq"]).select(F.col("seq").alias("doc_id"), "tier", (F.col("number") + 1).alias("place"))


@query("SELECT event_id, md5(user_id::VARCHAR) AS digest, ('0x' || right(md5(user_id::VARCHAR), 1))::BIGINT AS shard, ('0x' || right(md5(user_id::VARCHAR), 1))::BIGINT % 3 AS node, (('0x' || right(md5(user_id::VARCHAR), 1))::BIGINT + 1) % 3 AS replica FROM events")
def shard_assignment(spark, d):
    shard = shard_of(F.col("user_id").cast("string"))
    return load(spark, d, "events").select("event_id", F.md5(F.col("user_id").cast("string").cast("binary")).alias("digest"), shard.alias("shard"), F.pmod(shard, F.lit(3)).alias("node"), F.pmod(shard + 1, F.lit(3)).alias("replica"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER w AS n, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) SELECT user_id, event_id, n, total FROM r WHERE n % 20 = 0")
def checkpoint_markers(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, d, "events").withColumns({"n": F.row_number().over(w).cast("bigint"), "total": F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 4)})
    return rows.where("n % 20 = 0").select("user_id", "event_id", "n", "total")


@query(
    f"""WITH {_PROFILE}, t2 AS (SELECT agent_id, event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN {HOUR - 1} PRECEDING AND {HOUR - 1} FOLLOWING) AS n_near FROM v),
x AS (SELECT agent_id, count_if(n_near > 3)::BIGINT AS dense_events, max(n_near) AS peak FROM t2 GROUP BY 1)
SELECT f.agent_id, total_operations, operation_frequency, risk_score, dense_events, peak, CASE WHEN risk_score >= 0.8 THEN 'critical' WHEN risk_score >= 0.6 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS band FROM f JOIN x USING (agent_id)"""
)
def forensic_timeline(spark, d):
    """Each agent's profile and risk band with how often it acted in dense stretches of the whole timeline."""
    rows = versions(spark, d)
    dense = seq.range_count(rows.select("agent_id", "event_id", "ts"), HOUR - 1, HOUR - 1)
    dense = dense.groupBy("agent_id").agg(F.count_if(F.col("n_near") > 3).alias("dense_events"), F.max("n_near").alias("peak"))
    band = F.lit("low")
    for least, name in reversed(agg.BANDS):
        band = F.when(F.col("risk_score") >= least, name).otherwise(band)
    return agg.agent_profile(rows).join(dense, "agent_id").select("agent_id", "total_operations", "operation_frequency", "risk_score", "dense_events", "peak", band.alias("band"))
