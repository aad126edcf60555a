"""What changes tables: transactions, blocks, logs, buffers; encodings; and streams that meet or come late."""

from __future__ import annotations

import sqlite3
import tempfile
import uuid

from pyspark.sql import functions as F

from lodestrand.functions.storage import shared_folder
from lodestrand.operators import sequence as seq
from lodestrand.registry import query
from lodestrand.sources import files
from lodestrand.sources.versions import Conflict, Store, log_append, log_recover
from lodestrand.streaming import views
from lodestrand.tables import load


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'changed' ELSE lang END AS lang, CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 1 END AS version FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT -1, 'new', 2")
def block_updates(spark, d):
    """Blocks appended in one commit; updated, added and deleted in the next."""
    store = Store(spark, _folder(spark, "blocks"), "doc_id bigint, lang string, version int", "doc_id")
    docs = load(spark, d, "documents").select("doc_id", "lang", F.lit(1).alias("version"))
    first = store.begin()
    first.write(docs)
    first.commit()
    second = store.begin()
    second.write(docs.where("doc_id % 4 = 1").select("doc_id", F.lit("changed").alias("lang"), F.lit(2).alias("version")))
    second.write(spark.createDataFrame([(-1, "new", 2)], store.schema))
    second.delete(docs.where("doc_id % 5 = 0"))
    second.commit()
    return store.read()


@query("SELECT 'reader, at its version' AS step, count(*) AS n FROM orders UNION ALL SELECT 'writer, before commit', count(*) FILTER (o_orderkey % 2 = 1) FROM orders UNION ALL SELECT 'aborted', count(*) FROM orders UNION ALL SELECT 'committed', count(*) FILTER (o_orderkey % 2 = 1) FROM orders UNION ALL SELECT 'rival refused', 1 UNION ALL SELECT 'first version', count(*) FROM orders")
def transactions(spark, d):
    """Snapshots, a commit, an abort, and a rival that comes too late and is refused."""
    store = Store(spark, _folder(spark, "orders"), "o_orderkey bigint, o_orderstatus string", "o_orderkey")
    orders, out = load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), []

    def note(step, rows):
        out.append(rows.agg(F.lit(step).alias("step"), F.count("*").alias("n")))

    load_all = store.begin()
    load_all.write(orders)
    load_all.commit()
    reader, writer, rival, dropped = (store.begin() for _ in range(4))
    dropped.delete(orders)
    dropped.abort()
    note("aborted", store.read())
    writer.delete(orders.where("o_orderkey % 2 = 0"))
    note("writer, before commit", writer.read())
    writer.commit()
    note("reader, at its version", reader.read())
    note("committed", store.read())
    rival.delete(orders)
    try:
        rival.commit()
    except Conflict:
        out.append(spark.createDataFrame([("rival refused", 1)], "step string, n bigint"))
    note("first version", store.read(1))
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


@query("SELECT event_id AS seq, event_type AS kind, props AS payload FROM events WHERE event_id % 6 <> 0")
def wal_append_recover(spark, d):
    """A write-ahead log in two appends; payloads that were spoilt afterwards, and broken lines, aren't recovered."""
    folder = _folder(spark, "wal")
    rows = load(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    log_append(rows.where("seq % 2 = 1"), folder)
    spoilt = F.when(F.col("seq") % 6 == 0, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))
    sealed = rows.where("seq % 2 = 0").select("seq", "kind", spoilt.alias("payload"), F.sha2(F.col("payload").cast("binary"), 256).alias("digest"))
    sealed.write.mode("append").json(folder)
    spark.createDataFrame([('{"seq": 1, "kind":',)], "value string").write.mode("append").text(folder)
    return log_recover(spark, folder)


@query(
    """WITH RECURSIVE o AS (SELECT user_id, event_id, length(props) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
b AS (SELECT user_id, event_id, i, 0::BIGINT AS flush, 1 AS n, s AS held FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.event_id, o.i, CASE WHEN n >= 7 OR held >= 60 THEN flush + 1 ELSE flush END, CASE WHEN n >= 7 OR held >= 60 THEN 1 ELSE n + 1 END, CASE WHEN n >= 7 OR held >= 60 THEN s ELSE held + s END FROM b JOIN o ON o.user_id = b.user_id AND o.i = b.i + 1)
SELECT user_id, event_id, flush FROM b"""
)
def buffer_flushes(spark, d):
    """A hot buffer for each user that is written at seven rows or 60 characters, whichever comes first."""
    rows = load(spark, d, "events").select("user_id", "event_id", F.length("props").alias("size"))
    return seq.flushes(rows, ["user_id"], "size", ["event_id"], 7, 60)


@query("WITH v AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) SELECT event_id, code, event_type AS decoded FROM events JOIN v USING (event_type)")
def dictionary_encode(spark, d):
    """A column as codes of its values in order, and back."""
    rows = load(spark, d, "events").select("event_id", "event_type")
    words = seq.numbered(rows.select("event_type").distinct(), ["event_type"], "code")
    coded = rows.join(words, "event_type").select("event_id", "code")
    return coded.join(words, "code").select("event_id", "code", F.col("event_type").alias("decoded"))


@query("SELECT conv_id, turn, (length(text) - coalesce(lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0))::BIGINT AS delta FROM conversations")
def delta_length_encode(spark, d):
    """Lengths of strings as differences to the one before."""
    rows = load(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    made = seq.deltas(rows, ["conv_id"], F.col("n"), ["turn"])
    return made.select("conv_id", "turn", F.coalesce("delta", "n").alias("delta"))


@query("SELECT lang, count(*) AS n, min(doc_id) AS first_doc, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def split_by_type(spark, d):
    """Blocks written to a folder for each type, and read again with the type from the folder's name."""
    folder = _folder(spark, "split")
    load(spark, d, "documents").select("doc_id", "source", "lang").write.partitionBy("lang").parquet(folder)
    rows = spark.read.schema("doc_id bigint, source string, lang string").parquet(folder)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.count_distinct("source").alias("sources"))


def _events(spark, d, kind: str, prefix: str):
    rows = views.source(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).where(F.col("event_type") == kind)
    return rows.select(F.col("user_id").alias(f"{prefix}_user"), F.col("event_id").alias(f"{prefix}_id"), F.col("ts").alias(f"{prefix}_ts")).withWatermark(f"{prefix}_ts", "400 days")


@query("SELECT v.event_id AS view_id, p.event_id AS purchase_id FROM events v JOIN events p ON v.user_id = p.user_id AND v.event_type = 'view' AND p.event_type = 'purchase' AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR")
def stream_join(spark, d):
    """Two streams: purchases within six hours of a view by the same user, whichever arrives first."""
    views_, bought = _events(spark, d, "view", "view"), _events(spark, d, "purchase", "purchase")
    near = (F.col("view_user") == F.col("purchase_user")) & (F.col("purchase_ts") >= F.col("view_ts")) & (F.col("purchase_ts") <= F.col("view_ts") + F.expr("INTERVAL 6 HOURS"))
    return views.to_files(views_.join(bought, near).select("view_id", "purchase_id"))


@query("WITH m AS (SELECT max(ts) AS last FROM events) SELECT user_id, count(*) AS n FROM events, m WHERE user_id % 2 = 0 OR ts >= last - INTERVAL 1 DAY GROUP BY 1")
def late_rows(spark, d):
    """Rows of odd users come after all others: those older than the watermark, a day behind the latest row, are dropped as late."""
    folder, rows = _folder(spark, "late"), load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "event_id", "ts")
    newest = rows.where(F.col("ts") == F.lit(rows.agg(F.max("ts")).first()[0])).limit(1)
    rows.where("user_id % 2 = 0").unionByName(newest.withColumn("event_id", F.lit(-1).cast("bigint"))).coalesce(1).write.mode("append").parquet(folder)
    # A micro-batch judges lateness by the watermark that the one before began with, so one more stands between.
    newest.withColumn("event_id", F.lit(-2).cast("bigint")).coalesce(1).write.mode("append").parquet(folder)
    rows.where("user_id % 2 = 1").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    kept = views.to_files(views.without_replays(stream, ["event_id"], "1 day"))
    return kept.where("event_id >= 0").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def sqlite_import(spark, d):
    """A table of a SQLite file, which is made of the customers first, a partition at a time."""
    with tempfile.TemporaryDirectory() as folder:
        file = f"{folder}/t.db"
        with sqlite3.connect(file) as db:
            db.execute("CREATE TABLE customer (c_custkey INTEGER, c_name TEXT, c_acctbal REAL)")
            db.executemany("INSERT INTO customer VALUES (?, ?, ?)", map(tuple, load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal").toLocalIterator()))
        return files.sqlite_table(spark, file, "customer", "c_custkey bigint, c_name string, c_acctbal double")
