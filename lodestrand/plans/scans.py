"""Sources, filters, statistics and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestrand.functions import hashing, times
from lodestrand.operators import aggregates as agg
from lodestrand.operators import events as ev
from lodestrand.operators import sequence as seq
from lodestrand.registry import query
from lodestrand.tables import SQL_A, SQL_V, audit, blocks, load, vectors, versions


@query("SELECT 'TEXT' AS block_type, count(*) AS n_blocks, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents UNION ALL SELECT 'BINARY', count(*), sum(octet_length(encode(html)))::BIGINT FROM pages UNION ALL SELECT 'EMBEDDINGS', count(*), sum(len(embedding) * 4)::BIGINT FROM embeddings")
def blocks_by_type(spark: SparkSession, d: str) -> DataFrame:
    kinds = [(load(spark, d, "documents"), "TEXT", F.octet_length("text")), (load(spark, d, "pages"), "BINARY", F.octet_length("html")), (load(spark, d, "embeddings"), "EMBEDDINGS", F.size("embedding") * 4)]
    parts = [df.select(F.lit(kind).alias("block_type"), size.cast("bigint").alias("size")) for df, kind, size in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("block_type").agg(F.count("*").alias("n_blocks"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE doc_id = 42")
def block_point_lookup(spark, d):
    return load(spark, d, "documents").where("doc_id = 42").select("doc_id", "source", "lang", "n_chars")


@query("SELECT row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS position, source AS artifact_id, doc_id, 'text' AS kind, text AS content FROM documents")
def content_listing(spark, d):
    position = F.row_number().over(Window.partitionBy("artifact_id").orderBy("seq")) - 1
    kind = F.when(F.col("block_type") == "TEXT", "text").when(F.col("block_type") == "EMBEDDINGS", "embeddings").otherwise("binary")
    return blocks(spark, d).select(position.cast("bigint").alias("position"), "artifact_id", F.col("seq").alias("doc_id"), kind.alias("kind"), F.col("data").alias("content"))


@query("SELECT doc_id, encode(text)::BLOB AS payload FROM documents WHERE source = 'src3'")
def text_blocks(spark, d):
    return blocks(spark, d).where("block_type = 'TEXT' AND artifact_id = 'src3'").select(F.col("seq").alias("doc_id"), F.encode("data", "UTF-8").alias("payload"))


@query("SELECT vec_id, len(embedding)::BIGINT AS dimensions, len(embedding) * 4::BIGINT AS bytes, round(list_sum(embedding::DOUBLE[]), 5) AS total FROM embeddings")
def embedding_blocks(spark, d):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, d).select("vec_id", F.size("vector").cast("bigint").alias("dimensions"), (F.size("vector") * 4).cast("bigint").alias("bytes"), F.round(total, 5).alias("total"))


@query("SELECT page_id, upper(left(sha256(html), 16)) AS hash_hex, (page_id & 1) <> 0 AS signed, (page_id & 2) <> 0 AS encrypted FROM pages")
def manifest_projection(spark, d):
    flag = lambda bit: F.col("page_id").bitwiseAND(bit) != 0
    return load(spark, d, "pages").select("page_id", F.upper(F.left(F.sha2(F.col("html").cast("binary"), 256), F.lit(16))).alias("hash_hex"), flag(1).alias("signed"), flag(2).alias("encrypted"))


@query("SELECT event_id, ts, event_type, user_id FROM events WHERE event_type IN ('click', 'purchase') AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND user_id = 7 ORDER BY ts, event_id LIMIT 50")
def event_filter(spark, d):
    events = load(spark, d, "events")
    start = events.agg(F.min("ts") + F.expr("INTERVAL 1 DAY")).first()[0]
    return ev.event_filter(events, start=start, types=["click", "purchase"], agent=("user_id", 7), limit=50).select("event_id", "ts", "event_type", "user_id")


@query("SELECT event_id, event_type, value FROM events WHERE event_id = 77")
def event_by_id(spark, d):
    return load(spark, d, "events").where("event_id = 77").select("event_id", "event_type", "value")


@query(f"WITH {SQL_A} SELECT event_id, user_id, resource_id, success FROM a WHERE event_type = 'error' AND user_id BETWEEN 3 AND 20")
def audit_query_enhanced(spark, d):
    return audit(spark, d).where("event_type = 'error' AND user_id BETWEEN 3 AND 20").select("event_id", "user_id", "resource_id", "success")


@query("SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def audit_query_recent(spark, d):
    return audit(spark, d).where("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts", "user_id")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id < 60 AND turn < 4 ORDER BY conv_id DESC, turn DESC LIMIT 20")
def checkpoint_list(spark, d):
    return load(spark, d, "conversations").where("conv_id < 60 AND turn < 4").orderBy(F.desc("conv_id"), F.desc("turn")).limit(20).select("conv_id", "turn", "role")


_STAT = "SELECT '{0}' AS column_name, count(*) AS row_count, count(*) - count({0}) AS null_count, min({0})::DOUBLE AS min_value, max({0})::DOUBLE AS max_value, round(sum({0}::DOUBLE), 2) AS sum_value, round(avg({0}), 6) AS mean_value, round(var_pop({0}), 4) AS variance, round(stddev_pop({0}), 6) AS std_dev FROM lineitem"


@query(_STAT.format("l_quantity"))
def column_statistics(spark, d):
    return agg.column_statistics(load(spark, d, "lineitem"), ["l_quantity"])


@query(" UNION ALL ".join(_STAT.format(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def column_statistics_all(spark, d):
    return agg.column_statistics(load(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_shipdate) AS dates, count(DISTINCT l_returnflag) AS flags FROM lineitem")
def distinct_counts(spark, d):
    return load(spark, d, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_shipdate").alias("dates"), F.count_distinct("l_returnflag").alias("flags"))


@query()
def approximate_distinct(spark, d):
    """Distinct users with a mergeable sketch for each event type, and over all types from the same sketches."""
    sketches = load(spark, d, "events").groupBy("event_type").agg(F.hll_sketch_agg("user_id").alias("sketch"))
    return sketches.select("event_type", F.hll_sketch_estimate("sketch").alias("users")).unionByName(sketches.agg(F.lit("all").alias("event_type"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("users")))


@query("WITH r AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, event_type, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS run_length FROM r GROUP BY user_id, event_type, g")
def rle_runs(spark, d):
    return seq.runs(load(spark, d, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT l_orderkey, l_linenumber, round(l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), 4) AS delta FROM lineitem")
def delta_encode(spark, d):
    rows = seq.deltas(load(spark, d, "lineitem"), ["l_orderkey"], F.col("l_quantity"), ["l_linenumber", "l_partkey", "l_suppkey"])
    return rows.select("l_orderkey", "l_linenumber", F.round("delta", 4).alias("delta"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def audit_statistics_category(spark, d):
    return audit(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
def audit_top_users(spark, d):
    return agg.top(audit(spark, d), "user_id", 10)


@query(f"WITH {SQL_A} SELECT event_type, count(*) AS total, count_if(success)::BIGINT AS successful, count_if(NOT success)::BIGINT AS failed FROM a GROUP BY event_type")
def compliance_report(spark, d):
    return agg.outcomes(audit(spark, d), ["event_type"], F.col("success"))


_FIVE = "SELECT event_type AS name, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1"


@query(_FIVE)
def metric_aggregate(spark, d):
    return agg.five_statistics(load(spark, d, "events").withColumnRenamed("event_type", "name"), ["name"], "value")


@query(f"WITH m AS ({_FIVE}) SELECT name, 'count' AS statistic, n::DOUBLE AS value FROM m UNION ALL SELECT name, 'sum', total FROM m UNION ALL SELECT name, 'min', least FROM m UNION ALL SELECT name, 'max', most FROM m UNION ALL SELECT name, 'avg', mean FROM m")
def metric_unpivot(spark, d):
    return agg.fan_out(agg.five_statistics(load(spark, d, "events").withColumnRenamed("event_type", "name"), ["name"], "value"), ["name"])


@query("SELECT json_extract_string(props, '$.k') AS dimension, event_type AS name, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def metric_by_dimensions(spark, d):
    dims = F.array_sort(F.map_entries(F.from_json("props", "map<string,string>")))
    key = F.to_json(F.map_from_entries(dims))
    rows = load(spark, d, "events").withColumn("key", key).groupBy("key", F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.get_json_object("key", "$.k").alias("dimension"), "name", "n", "total")


@query("SELECT user_id, count(*) AS n, round(avg((event_type = 'error')::INT), 6) AS ratio FROM events GROUP BY user_id HAVING count(*) > 1 AND avg((event_type = 'error')::INT) > 0.2")
def op_delete_ratio(spark, d):
    ratio = F.avg((F.col("event_type") == "error").cast("int"))
    return load(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(ratio, 6).alias("ratio"), ratio.alias("exact")).where("n > 1 AND exact > 0.2").drop("exact")


@query("SELECT event_type AS operation, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def timing_profile(spark, d):
    return agg.five_statistics(load(spark, d, "events").withColumnRenamed("event_type", "operation"), ["operation"], "value")


@query("SELECT conv_id AS thread_id, count(*) AS checkpoints, max(turn) AS last_turn, count_if(role = 'user')::BIGINT AS user_turns, left(arg_max(text, turn), 80) AS last_text FROM conversations GROUP BY conv_id")
def thread_summary(spark, d):
    return load(spark, d, "conversations").groupBy(F.col("conv_id").alias("thread_id")).agg(F.count("*").alias("checkpoints"), F.max("turn").alias("last_turn"), F.count_if(F.col("role") == "user").alias("user_turns"), F.left(F.max_by("text", "turn"), F.lit(80)).alias("last_text"))


@query("SELECT event_type, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY event_type")
def event_type_counts(spark, d):
    return load(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


_COST = "(greatest(l_quantity - 5, 0)::DECIMAL(20,4) * 0.0004::DECIMAL(18,10))::DECIMAL(38,10)"


def _costs(spark, d):
    return load(spark, d, "lineitem").select(F.col("l_returnflag").alias("service"), F.col("l_linestatus").alias("operation"), F.col("l_quantity").alias("units"), F.col("l_shipdate").alias("ts"), agg.cost(F.col("l_quantity"), 5, "0.0004").alias("amount"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"))


@query(f"SELECT l_returnflag AS service, count(*) AS calls, sum({_COST})::DECIMAL(38,10) AS amount FROM lineitem GROUP BY 1")
def cost_by_service(spark, d):
    return _costs(spark, d).groupBy("service").agg(F.count("*").alias("calls"), F.sum("amount").cast("decimal(38,10)").alias("amount"))


@query(f"SELECT l_returnflag || ':' || l_linestatus AS operation, sum({_COST})::DECIMAL(38,10) AS amount, count(*) AS calls, round(avg({_COST}::DOUBLE), 6) AS mean FROM lineitem GROUP BY 1 ORDER BY amount DESC LIMIT 10")
def cost_top_operations(spark, d):
    return _costs(spark, d).groupBy(F.concat_ws(":", "service", "operation").alias("operation")).agg(F.sum("amount").cast("decimal(38,10)").alias("amount"), F.count("*").alias("calls"), F.round(F.avg(F.col("amount").cast("double")), 6).alias("mean")).orderBy(F.desc("amount")).limit(10)


@query(f"SELECT date_trunc('day', l_shipdate)::TIMESTAMP AS day, sum({_COST})::DECIMAL(38,10) AS amount FROM lineitem GROUP BY 1 ORDER BY day DESC LIMIT 24")
def cost_hourly_trend(spark, d):
    return _costs(spark, d).groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("amount").cast("decimal(38,10)").alias("amount")).orderBy(F.desc("day")).limit(24)


@query(f"SELECT year(l_shipdate)::VARCHAR || '-W' || lpad(weekofyear(l_shipdate)::VARCHAR, 2, '0') AS period, sum({_COST})::DECIMAL(38,10) AS amount FROM lineitem GROUP BY 1")
def cost_period_week(spark, d):
    return _costs(spark, d).groupBy(times.period(F.col("ts"), "weekly").alias("period")).agg(F.sum("amount").cast("decimal(38,10)").alias("amount"))


@query(
    f"""WITH c AS (SELECT strftime(l_shipdate, '%Y-%m') AS period, l_shipdate AS ts, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || '-' || l_partkey::VARCHAR AS id, {_COST} AS amount FROM lineitem),
r AS (SELECT *, sum(amount) OVER (PARTITION BY period ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS running FROM c)
SELECT period, id, step, running::DECIMAL(38,10) AS running FROM r, (VALUES (0.5::DOUBLE), (0.8::DOUBLE), (0.95::DOUBLE)) s(step) WHERE (running - amount)::DOUBLE < step * 4 AND running::DOUBLE >= step * 4"""
)
def budget_crossings(spark, d):
    return agg.budget_crossings(_costs(spark, d), 4.0).select("period", "id", "step", F.col("running").cast("decimal(38,10)").alias("running"))


@query("SELECT event_id, left(sha256(event_type || '|' || coalesce(user_id::VARCHAR, '\\N')), 16) AS entry FROM events")
def canonical_hash(spark, d):
    return load(spark, d, "events").select("event_id", hashing.short_id(hashing.canonical(F.col("event_type"), F.col("user_id"))).alias("entry"))


@query("SELECT conv_id AS thread_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text FROM conversations GROUP BY 1")
def checkpoint_latest(spark, d):
    rows = load(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), "turn", "role", "text")
    return ev.last_write(rows, "thread_id", ["turn", "role", "text"], ["turn"])


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 30 AND p_retailprice >= 920 AND p_brand = 'Brand#12' AND p_retailprice < 990")
def metadata_filters(spark, d):
    return load(spark, d, "part").where("p_size BETWEEN 10 AND 30 AND p_retailprice >= 920 AND p_brand = 'Brand#12' AND p_retailprice < 990").select("p_partkey", "p_size", "p_retailprice")


@query("SELECT source AS artifact_id, count(*) AS n_blocks, count_if(lang = 'en')::BIGINT AS english, count_if(n_chars > 2000)::BIGINT AS large FROM documents GROUP BY 1")
def dashboard_counts(spark, d):
    return blocks(spark, d).groupBy("artifact_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.col("n_chars") > 2000).alias("large"))


@query(f"WITH {SQL_V}, l AS (SELECT *, lag(event_id) OVER (PARTITION BY block_id ORDER BY version) AS previous FROM v) SELECT block_id, event_id, version FROM l WHERE event_id NOT IN (SELECT previous FROM l WHERE previous IS NOT NULL)")
def block_version_heads(spark, d):
    rows = versions(spark, d)
    rows = rows.withColumn("previous", F.lag("event_id").over(Window.partitionBy("block_id").orderBy("version")))
    return rows.join(rows.select(F.col("previous").alias("event_id")).where("event_id IS NOT NULL"), "event_id", "left_anti").select("block_id", "event_id", "version")


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'match' END AS state FROM documents")
def backend_diff(spark, d):
    """Blocks of a source store against a target with some missing and some changed; what the target has beyond the source isn't reported."""
    source = blocks(spark, d).select("seq", hashing.content_hash(F.col("data")).alias("hash"))
    target = blocks(spark, d).where("seq % 10 <> 0").select("seq", hashing.content_hash(F.when(F.col("seq") % 7 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data"))).alias("copy"))
    state = F.when(F.col("copy").isNull(), "missing").when(F.col("copy") == F.col("hash"), "match").otherwise("mismatch")
    return source.join(target, "seq", "left").select(F.col("seq").alias("doc_id"), state.alias("state"))


@query("SELECT (SELECT count(*) FROM conversations) AS source_count, (SELECT count(*) FROM conversations WHERE turn < 3) AS target_count, (SELECT count(*) FROM conversations) = (SELECT count(*) FROM conversations WHERE turn < 3) AS equal, (SELECT count(*) FROM conversations WHERE turn >= 3) AS only_in_source")
def checkpoint_compare(spark, d):
    source = load(spark, d, "conversations")
    target = source.where("turn < 3")
    counts = source.agg(F.count("*").alias("source_count")).crossJoin(target.agg(F.count("*").alias("target_count")))  # one row each
    return counts.crossJoin(source.exceptAll(target).agg(F.count("*").alias("only_in_source"))).select("source_count", "target_count", (F.col("source_count") == F.col("target_count")).alias("equal"), "only_in_source")


@query("SELECT event_id, user_id, value FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase') AND value IS NOT NULL")
def wal_recover(spark, d):
    """Log entries that were written but not yet committed."""
    wal = load(spark, d, "events")
    return wal.where("value IS NOT NULL").join(wal.where("event_type = 'purchase'").select("event_id"), "event_id", "left_anti").select("event_id", "user_id", "value")


@query("SELECT user_id, event_id, ((row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 16)::BIGINT AS batch FROM events")
def microbatch_assignment(spark, d):
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return load(spark, d, "events").select("user_id", "event_id", F.floor(number / 16).alias("batch"))


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def columnar_projection(spark, d):
    """Two of eleven columns: the scan reads no others."""
    return load(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_type, octet_length(encode(props))::BIGINT AS data_size FROM events")
def blocks_to_columnar(spark, d):
    """Columns inferred from the JSON of all blocks, not of the first few."""
    rows = load(spark, d, "events")
    schema = rows.agg(F.expr("schema_of_variant_agg(parse_json(props))")).first()[0]
    fields = schema.removeprefix("OBJECT<").removesuffix(">")
    names = [p.split(":")[0].strip() for p in fields.split(",")]
    parsed = F.parse_json("props")
    return rows.select("event_id", *[F.try_variant_get(parsed, f"$.{n}", "bigint").alias(n) for n in names], "event_type", F.octet_length("props").cast("bigint").alias("data_size"))


@query("SELECT doc_id, 'documents/' || source AS origin, text AS page_content, n_chars FROM documents WHERE text <> '' AND strpos(left(text, 1000), chr(1)) = 0")
def document_loader(spark, d):
    rows = load(spark, d, "documents").where((F.col("text") != "") & ~F.contains(F.left("text", F.lit(1000)), F.lit("\x01")))
    return rows.select("doc_id", F.concat(F.lit("documents/"), F.col("source")).alias("origin"), F.col("text").alias("page_content"), "n_chars")
