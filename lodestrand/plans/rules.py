"""Rules, access, schemas and formats."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrand.functions import rules as ru
from lodestrand.functions import text as tx
from lodestrand.functions import times
from lodestrand.operators import access, schemas
from lodestrand.registry import query
from lodestrand.tables import SQL_A, audit, load

_TESTS = [("eq", "event_type", "click"), ("ne", "event_type", "view"), ("gt", "value", 50.0), ("ge", "user_id", 75), ("lt", "value", 20.0), ("le", "user_id", 10), ("contains", "event_type", "i"), ("not_contains", "props", "7"), ("starts_with", "event_type", "p"), ("ends_with", "event_type", "w"), ("matches", "event_type", "c.*k")]


@query("SELECT event_id, (event_type = 'click')::INT + (event_type <> 'view')::INT + coalesce(value > 50, false)::INT + (user_id >= 75)::INT + coalesce(value < 20, false)::INT + (user_id <= 10)::INT + contains(event_type, 'i')::INT + (NOT contains(props, '7'))::INT + starts_with(event_type, 'p')::INT + ends_with(event_type, 'w')::INT + regexp_matches(event_type, '^c.*k')::INT AS met FROM events")
def rule_operators(spark, d):
    met = sum((ru.Condition(m, o, v).column().cast("int") for o, m, v in _TESTS), F.lit(0))
    return load(spark, d, "events").select("event_id", met.alias("met"))


def _metrics(spark, d):
    rows = load(spark, d, "orders").groupBy("o_custkey")
    rows = rows.agg((F.sum("o_totalprice") * 2000).alias("size_bytes"), (F.count("*") / 10.0).alias("access_frequency"), (F.avg((F.col("o_orderstatus") == "O").cast("int"))).alias("fragmentation"), (F.max(F.col("o_orderkey")) % 60).alias("age_days"), (F.min("o_orderkey") % 100 / 100.0).alias("semantic_coherence"))
    return rows.withColumnRenamed("o_custkey", "artifact")


_METRICS = "m AS (SELECT o_custkey AS artifact, sum(o_totalprice) * 2000 AS size_bytes, count(*) / 10.0::DOUBLE AS access_frequency, avg((o_orderstatus = 'O')::INT) AS fragmentation, max(o_orderkey) % 60 AS age_days, min(o_orderkey) % 100 / 100.0::DOUBLE AS semantic_coherence FROM orders GROUP BY 1), g AS (SELECT artifact, unnest(list_filter([CASE WHEN size_bytes > 1073741824 THEN {'rule_id': 'size_limit', 'action': 'split', 'priority': 10::BIGINT} END, CASE WHEN access_frequency > 10.0 THEN {'rule_id': 'high_access', 'action': 'optimize_hot', 'priority': 9::BIGINT} END, CASE WHEN fragmentation > 0.5 THEN {'rule_id': 'fragmentation', 'action': 'reorganize', 'priority': 8::BIGINT} END, CASE WHEN semantic_coherence < 0.5 THEN {'rule_id': 'semantic_drift', 'action': 'semantic_reorganize', 'priority': 7::BIGINT} END, CASE WHEN access_frequency < 0.1 AND age_days > 30 THEN {'rule_id': 'low_access', 'action': 'archive', 'priority': 5::BIGINT} END], lambda x: x IS NOT NULL)) AS r FROM m)"


@query(f"WITH {_METRICS} SELECT artifact, r.rule_id, r.action, r.priority FROM g")
def governance_rules(spark, d):
    return ru.triggered(_metrics(spark, d), ru.GOVERNANCE).select("artifact", "rule_id", "action", "priority")


@query(f"WITH {_METRICS} SELECT r.rule_id, r.action, count(*) AS n, count(DISTINCT artifact) AS artifacts FROM g GROUP BY 1, 2")
def governance_report(spark, d):
    return ru.triggered(_metrics(spark, d), ru.GOVERNANCE).groupBy("rule_id", "action").agg(F.count("*").alias("n"), F.count_distinct("artifact").alias("artifacts"))


@query("WITH t AS (SELECT event_id, list_filter([CASE WHEN value > 90 THEN 'high' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN user_id < 5 AND event_type = 'click' THEN 'watched' END], lambda x: x IS NOT NULL) AS l FROM events) SELECT event_id, unnest(l) AS rule_id, unnest(generate_series(0, len(l) - 1)) AS place FROM t WHERE len(l) > 0")
def rules_triggered(spark, d):
    rules = (ru.Rule("error", ru.Condition("event_type", "eq", "error"), "alert", 50), ru.Rule("high", ru.Condition("value", "gt", 90.0), "notify", 100), ru.Rule("off", ru.Condition("value", "ge", 0.0), "log", 70, active=False), ru.Rule("watched", ru.Every((ru.Condition("user_id", "lt", 5), ru.Condition("event_type", "eq", "click"))), "log", 10))
    return ru.triggered(load(spark, d, "events"), rules).select("event_id", "rule_id", "place")


@query("SELECT event_id, event_type = 'purchase' AND json_extract_string(props, '$.k') = '7' AS met FROM events WHERE event_type = 'purchase'")
def event_conditions(spark, d):
    """An event of a type whose properties all have given values."""
    return load(spark, d, "events").where("event_type = 'purchase'").select("event_id", ((F.col("event_type") == "purchase") & (F.get_json_object("props", "$.k") == "7")).alias("met"))


@query("SELECT event_id, ts FROM events WHERE hour(ts) = 3 AND (isodow(ts) - 1) = 0")
def cron_match(spark, d):
    return load(spark, d, "events").where(times.cron(F.col("ts"), "* 3 * * 0")).select("event_id", "ts")


@query("SELECT event_id, coalesce(value > 50, false) AND (event_type = 'click' OR event_type = 'view') AS both_hold, NOT (coalesce(value > 50, false) OR event_type = 'error') AS neither FROM events")
def composite_conditions(spark, d):
    high = ru.Condition("value", "gt", 50.0)
    seen = ru.Any((ru.Condition("event_type", "eq", "click"), ru.Condition("event_type", "eq", "view")))
    return load(spark, d, "events").select("event_id", ru.Every((high, seen)).column().alias("both_hold"), ru.Neither((high, ru.Condition("event_type", "eq", "error"))).column().alias("neither"))


_RULES = "ru AS (SELECT * FROM (VALUES ('u1', 'r1*', ['read']), ('*', 'r42', ['read', 'write']), ('u7', '*', ['*']), ('u3', 'r5', ['write'])) t(rule_subject, rule_resource, permissions))"


@query(f"WITH {SQL_A}, q AS (SELECT event_id, 'u' || user_id AS subject, 'r' || resource_id AS resource, CASE WHEN event_type = 'view' THEN 'read' ELSE 'write' END AS permission FROM a), {_RULES} SELECT event_id, EXISTS (SELECT 1 FROM ru WHERE (rule_subject = '*' OR rule_subject = subject) AND (rule_resource IN ('*', resource) OR (ends_with(rule_resource, '*') AND starts_with(resource, rule_resource[:-2]))) AND (list_contains(permissions, permission) OR list_contains(permissions, '*'))) AS allowed FROM q")
def access_rules(spark, d):
    rules = spark.createDataFrame([("u1", "r1*", ["read"], None), ("*", "r42", ["read", "write"], None), ("u7", "*", ["*"], None), ("u3", "r5", ["write"], None), ("*", "*", ["*"], 0.0)], "rule_subject string, rule_resource string, permissions array<string>, expiry double")
    asked = audit(spark, d).select("event_id", F.concat(F.lit("u"), "user_id").alias("subject"), F.concat(F.lit("r"), "resource_id").alias("resource"), F.when(F.col("event_type") == "view", "read").otherwise("write").alias("permission"))
    return access.allowed(asked, rules, F.lit(1.0)).select("event_id", "allowed")


_LEVELS = "c AS (SELECT c_custkey, c_custkey % 5 AS level, list_filter(['A', 'B', 'C'], lambda x: (c_custkey % 7 <> 0 OR x <> 'C')) AS comp FROM customer), o AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS doc_level, CASE WHEN o_orderkey % 3 = 0 THEN ['A', 'C'] ELSE ['A'] END AS doc_comp FROM orders)"


def _classified(spark, d):
    held = F.filter(F.array(*map(F.lit, "ABC")), lambda x: (F.col("c_custkey") % 7 != 0) | (x != "C"))
    who = load(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 5).alias("level"), held.alias("comp"))
    what = load(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 5).alias("doc_level"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("A"), F.lit("C"))).otherwise(F.array(F.lit("A"))).alias("doc_comp"))
    return what.join(who, F.col("o_custkey") == F.col("c_custkey"))


@query(f"WITH {_LEVELS} SELECT o_orderkey, level >= doc_level AND list_has_all(comp, doc_comp) AS may_read FROM o JOIN c ON o_custkey = c_custkey")
def clearance_read(spark, d):
    return _classified(spark, d).select("o_orderkey", access.may_read(F.col("level"), F.col("comp"), F.col("doc_level"), F.col("doc_comp")).alias("may_read"))


@query(f"WITH {_LEVELS} SELECT o_orderkey, doc_level >= level AS may_write FROM o JOIN c ON o_custkey = c_custkey")
def clearance_write(spark, d):
    return _classified(spark, d).select("o_orderkey", access.may_write(F.col("level"), F.col("doc_level")).alias("may_write"))


@query(f"WITH {SQL_A} SELECT event_id, CASE WHEN user_id % 10 = 0 THEN 'DENY' WHEN event_type = 'purchase' THEN 'REQUIRE_MFA' ELSE 'ALLOW' END AS decision FROM a")
def stream_decision(spark, d):
    return audit(spark, d).select("event_id", access.decision(F.col("user_id") % 10 == 0, F.col("event_type") == "purchase").alias("decision"))


@query("WITH h AS (SELECT event_id, user_id, event_type, hour(ts) AS hr, list({'t': event_type, 'h': hour(ts)}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS l FROM events), s AS (SELECT event_id, coalesce(len(l), 0) AS n, len(list_filter(l, lambda x: x.t = event_type)) AS same, len(list_filter(l, lambda x: abs(x.h - hr) <= 1)) AS near FROM h) SELECT event_id, round(CASE WHEN n >= 10 THEN CASE WHEN same < 0.1 * n THEN 0.3 ELSE 0.0 END + CASE WHEN near < 0.1 * n THEN 0.4 ELSE 0.0 END + CASE WHEN same < 0.05 * n THEN 0.3 ELSE 0.0 END ELSE 0.0 END::DOUBLE, 2) AS score FROM s")
def behaviour_score(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-100, -1)
    rows = load(spark, d, "events").withColumn("hr", F.hour("ts")).withColumn("l", F.collect_list(F.struct("event_type", "hr")).over(w))
    n, same = F.size("l"), F.size(F.filter("l", lambda x: x["event_type"] == F.col("event_type")))
    near = F.size(F.filter("l", lambda x: F.abs(x["hr"] - F.col("hr")) <= 1))
    return rows.select("event_id", F.round(access.behaviour_score(same < 0.1 * n, near < 0.1 * n, same < 0.05 * n, n), 2).alias("score"))


# Schemas and formats


@query("SELECT event_id AS id, event_type AS kind, user_id::VARCHAR AS actor, TRY_CAST(value AS BIGINT) AS amount, 'v2' AS schema_version FROM (SELECT * REPLACE (trunc(value) AS value) FROM events)")
def schema_rename_cast(spark, d):
    steps = [schemas.rename("event_id", "id"), schemas.rename("event_type", "kind"), schemas.rename("user_id", "actor"), schemas.change_type("actor", "string"), schemas.rename("value", "amount"), schemas.change_type("amount", "bigint"), schemas.add("schema_version", "v2"), schemas.remove("ts"), schemas.remove("props")]
    df = load(spark, d, "events")
    for s in steps:
        df = df.transform(s)
    return df


@query("SELECT p_partkey, p_brand || '|' || p_type AS label, split_part(p_name, ' ', 1) AS first_name, nullif(split_part(p_name, ' ', 2), '') AS second_name FROM part")
def schema_merge_split(spark, d):
    df = load(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return df.transform(schemas.merge(["p_brand", "p_type"], "label", "|")).transform(schemas.split("p_name", ["first_name", "second_name"], " "))


@query(r"SELECT c_custkey, regexp_extract(c_name, '^(?:[A-Za-z]+#(\d+))', 1) AS number FROM customer")
def regex_extract_fields(spark, d):
    return load(spark, d, "customer").select("c_custkey", "c_name").transform(schemas.extract("c_name", r"[A-Za-z]+#(\d+)", "number")).drop("c_name")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def json_fields(spark, d):
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.none").alias("none"))


@query("SELECT event_id FROM events WHERE ts + INTERVAL 10 DAY < (SELECT max(ts) FROM events)")
def retention_expired(spark, d):
    rows = load(spark, d, "events")
    as_of = rows.agg(F.max("ts")).first()[0]
    return rows.where(times.expired(F.col("ts"), 10, F.lit(as_of).cast("timestamp_ntz"))).select("event_id")


@query(f"WITH {SQL_A} SELECT event_id, 'CEF:0|Lodestrand|Audit|1.0|' || event_type || '|' || event_type || '|' || (CASE WHEN success THEN 3 ELSE 6 END) || '|act=' || event_type || ' suser=' || user_id || ' cs1=' || resource_id || ' cs1Label=ResourceID outcome=' || (CASE WHEN success THEN 'success' ELSE 'failure' END) AS line FROM a")
def cef_lines(spark, d):
    line = F.concat(F.lit("CEF:0|Lodestrand|Audit|1.0|"), "event_type", F.lit("|"), "event_type", F.lit("|"), F.when(F.col("success"), "3").otherwise("6"), F.lit("|act="), "event_type", F.lit(" suser="), "user_id", F.lit(" cs1="), "resource_id", F.lit(" cs1Label=ResourceID outcome="), F.when(F.col("success"), "success").otherwise("failure"))
    return audit(spark, d).select("event_id", line.alias("line"))


@query("SELECT event_id, '<134>' || strftime(ts, '%b %d %H:%M:%S') || ' host lodestrand: ' || event_type AS line FROM events")
def syslog_lines(spark, d):
    return load(spark, d, "events").select("event_id", F.concat(F.lit(f"<{16 * 8 + 6}>"), F.date_format("ts", "MMM dd HH:mm:ss"), F.lit(" host lodestrand: "), "event_type").alias("line"))


@query("SELECT event_id, 'name is missing' AS problem FROM events UNION ALL SELECT event_id, 'k is not string' FROM events")
def validate_schema(spark, d):
    found = schemas.errors(F.col("props"), {"k": "string", "name": "string"})
    return load(spark, d, "events").select("event_id", F.explode(found).alias("problem"))


@query("SELECT event_id, map_from_entries([('api_key', '***REDACTED***'), ('k', json_extract_string(props, '$.k')), ('user_token', '***REDACTED***')])::VARCHAR AS entry FROM events")
def log_redaction(spark, d):
    entry = F.create_map(F.lit("api_key"), F.lit("abc"), F.lit("k"), F.get_json_object("props", "$.k"), F.lit("user_token"), F.lit("t"))
    pairs = F.transform(F.map_entries(tx.redact(entry)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return load(spark, d, "events").select("event_id", F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}")).alias("entry"))


@query("SELECT c_custkey, list_filter([CASE WHEN c_custkey % 200 < 128 THEN 'AES key length is too short' END, CASE WHEN c_custkey % 20 < 15 THEN 'Password minimum length must be at least 15' END, CASE WHEN c_custkey % 300 < 100 THEN 'Insufficient audit storage capacity' END], lambda x: x IS NOT NULL) AS issues, NOT (c_custkey % 200 < 128 OR c_custkey % 20 < 15 OR c_custkey % 300 < 100) AS compliant FROM customer")
def control_checks(spark, d):
    """Findings of three controls over configurations: key length, password length, audit storage."""
    key, password, storage = (F.col("c_custkey") % n for n in (200, 20, 300))
    issues = F.filter(F.array(F.when(key < 128, "AES key length is too short"), F.when(password < 15, "Password minimum length must be at least 15"), F.when(storage < 100, "Insufficient audit storage capacity")), lambda x: x.isNotNull())
    return load(spark, d, "customer").select("c_custkey", issues.alias("issues"), (F.size(issues) == 0).alias("compliant"))


# Which state an agent may go to from which.
LEGAL = {"IDLE": ("RUNNING", "FAILED"), "RUNNING": ("WAITING", "COMPLETED", "FAILED", "IDLE"), "WAITING": ("RUNNING", "FAILED", "IDLE"), "COMPLETED": ("IDLE",), "FAILED": ("IDLE",)}
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, bs in LEGAL.items() for b in bs)


@query(f"WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'IDLE' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'WAITING' WHEN 'purchase' THEN 'COMPLETED' ELSE 'FAILED' END AS state, ts FROM events), l AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM s) SELECT user_id, event_id, previous, state, (previous, state) IN (SELECT (a, b) FROM (VALUES {_LEGAL}) t(a, b)) AS legal FROM l WHERE previous IS NOT NULL")
def state_transitions(spark, d):
    state = F.when(F.col("event_type") == "signup", "IDLE").when(F.col("event_type") == "click", "RUNNING").when(F.col("event_type") == "view", "WAITING").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("FAILED")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = load(spark, d, "events").withColumn("state", state).withColumn("previous", F.lag("state").over(w)).where("previous IS NOT NULL")
    legal = F.concat_ws(">", "previous", "state").isin(*[f"{a}>{b}" for a, bs in LEGAL.items() for b in bs])
    return rows.select("user_id", "event_id", "previous", "state", legal.alias("legal"))
