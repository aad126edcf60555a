"""Rules' actions, hooks, checks, metered functions and pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestrand.functions import rules as ru
from lodestrand.functions.hashing import content_hash
from lodestrand.functions.storage import shared_folder
from lodestrand.operators import control
from lodestrand.plans.rules import _METRICS, _metrics
from lodestrand.registry import query
from lodestrand.sources.versions import Store
from lodestrand.tables import load


@query(f"WITH {_METRICS} SELECT artifact, r.rule_id, r.action, CASE r.action WHEN 'split' THEN ceil(size_bytes / 1073741824)::BIGINT || ' parts' WHEN 'archive' THEN 'cold' WHEN 'optimize_hot' THEN 'hot' WHEN 'reorganize' THEN 'sorted' END AS outcome, r.action <> 'semantic_reorganize' AS handled FROM g JOIN m USING (artifact)")
def rule_actions(spark, d):
    """The governance rules, with handlers for all actions but one."""
    parts = F.concat(F.ceil(F.col("size_bytes") / 1073741824).cast("string"), F.lit(" parts"))
    plain = {"archive": F.lit("cold"), "optimize_hot": F.lit("hot"), "reorganize": F.lit("sorted"), "split": parts}
    handlers = {a: (lambda rows, c=c: rows.withColumn("outcome", c)) for a, c in plain.items()}
    return control.perform(ru.triggered(_metrics(spark, d), ru.GOVERNANCE), "artifact", handlers)


@query("SELECT doc_id, coalesce(lang, 'und') AS lang, sha256(text) AS hash, octet_length(encode(text))::BIGINT AS n_bytes, (SELECT count(*) FROM documents) AS n_valid FROM documents")
def plugin_hooks(spark, d):
    """Hooks before and after a conversion, and one that is called for what it finds."""
    hooks = control.Hooks()
    hooks.register("pre_conversion", lambda df: df.fillna({"lang": "und"}))
    hooks.register("post_conversion", lambda df: df.withColumn("n_bytes", F.octet_length("text").cast("bigint")))
    hooks.register("post_conversion", lambda df: df.drop("text"))
    hooks.register("post_validation", lambda df: df.where(F.col("doc_id").isNotNull()).count())
    docs = load(spark, d, "documents").select("doc_id", "lang", "text")
    made = hooks.through("post_conversion", hooks.through("pre_conversion", docs).withColumn("hash", content_hash(F.col("text"))))
    return made.withColumn("n_valid", F.lit(hooks.call("post_validation", docs)[0]).cast("bigint"))


@query("WITH c AS (SELECT 'ids' AS name, CASE WHEN count(*) = count(DISTINCT doc_id) THEN 'healthy' ELSE 'unhealthy' END AS status, count(*) - count(DISTINCT doc_id) || ' repeated' AS message FROM documents UNION ALL SELECT 'copies', CASE WHEN count(*) = count(DISTINCT sha256(text)) THEN 'healthy' ELSE 'degraded' END, count(*) - count(DISTINCT sha256(text)) || ' copies' FROM documents UNION ALL SELECT 'missing', 'unhealthy', 'KeyError: ''nothing''') SELECT * FROM c UNION ALL SELECT 'overall', 'unhealthy', '3 checks'")
def health_checks(spark, d):
    docs = load(spark, d, "documents")

    def repeated(column, status, what):
        n, kinds = docs.agg(F.count("*"), F.count_distinct(column)).first()
        return ("healthy" if n == kinds else status), f"{n - kinds} {what}"

    return control.health(spark, {"ids": lambda: repeated(F.col("doc_id"), "unhealthy", "repeated"), "copies": lambda: repeated(content_hash(F.col("text")), "degraded", "copies"), "missing": lambda: {}["nothing"]})


@query("SELECT 'scan' AS service, 'orders' AS operation, 2::BIGINT AS calls, 2 * count(*)::DOUBLE AS units, round(2 * count(*) * 0.001, 6)::DOUBLE AS cost FROM orders UNION ALL SELECT 'call', 'nation', 1, 1, 0.5")
def metered_calls(spark, d):
    """Two functions whose calls are booked: one by the rows that it reads, one by the call."""
    ledger = control.Ledger({("scan", "orders"): 0.001, ("call", "nation"): 0.5})
    orders = load(spark, d, "orders")
    total = ledger.metered("scan", "orders", lambda df: df.count())(lambda df: df.agg(F.sum("o_totalprice")))
    total(orders)
    total(orders)
    ledger.metered("call", "nation")(lambda: load(spark, d, "nation"))()
    return ledger.table(spark).groupBy("service", "operation").agg(F.count("*").alias("calls"), F.sum("units").alias("units"), F.round(F.sum("cost"), 6).alias("cost"))


@query("SELECT doc_id AS page_id, CASE WHEN doc_id % 2 = 0 THEN 'page ' || doc_id ELSE sha256(text) END AS content FROM documents UNION ALL SELECT max(doc_id) + 1, 'new' FROM documents")
def memory_pages(spark, d):
    """Pages written, half of them written again, and a new one with the next number; reads see the last write."""
    store = Store(spark, f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}", "page_id bigint, content string", "page_id")
    docs = load(spark, d, "documents").select(F.col("doc_id").alias("page_id"), content_hash(F.col("text")).alias("content"))
    first = store.begin()
    first.write(docs)
    first.commit()
    second = store.begin()
    second.write(docs.where("page_id % 2 = 0").select("page_id", F.concat(F.lit("page "), "page_id").alias("content")))
    second.write(store.read().agg((F.max("page_id") + 1).alias("page_id"), F.lit("new").alias("content")))
    second.commit()
    return store.read()


_READS = "o AS (SELECT user_id, event_id, json_extract_string(props, '$.k') AS page, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), l AS (SELECT *, lag(i) OVER (PARTITION BY user_id, page ORDER BY i) AS j FROM o)"


@query(f"WITH {_READS} SELECT l.user_id, l.event_id, any_value(l.j) IS NOT NULL AND count(DISTINCT b.page) < 20 AS hit FROM l LEFT JOIN o b ON b.user_id = l.user_id AND b.i > l.j AND b.i < l.i GROUP BY 1, 2")
def page_cache(spark, d):
    """Each user's reads of pages through a cache of the 20 used last."""
    reads = load(spark, d, "events").select("user_id", "event_id", F.get_json_object("props", "$.k").alias("page"))
    return control.page_reads(reads, ["user_id"], ["event_id"], "page", 20)
