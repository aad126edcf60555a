"""Structured Streaming: the same transformations on streams, with state where they need it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestrand.functions.storage import shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int | None = 1) -> DataFrame:
    """A table's files as a stream, a few at a time, or all that are there; the table may be one file or a folder of files."""
    schema = spark.read.parquet(path).schema
    # As a pattern a path may name a single file, which the stream source doesn't take otherwise.
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else stream
    return stream.parquet(f"{path[:-1]}[{path[-1]}]")


def to_files(stream: DataFrame) -> DataFrame:
    """Run an appending stream until its source is used up; its rows, from files in the shared folder."""
    folder = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def to_view(stream: DataFrame, key: list[str], order: str, compact: int = 16) -> DataFrame:
    """An incremental view: each micro-batch's last row of each key replaces the one before.

    A batch writes its own last rows only, and readers take the last of each key among what was written; every
    ``compact``-th batch folds in those before it, so there are never more to read. A batch that is run again writes the same.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/view-{uuid.uuid4().hex}"
    schema = stream.schema
    rest = [c for c in schema.names if c not in key]
    whole: dict[int, bool] = {}

    def last(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__v")).select(*key, "__v.*").select(*schema.names)

    def written(before: list[int]) -> DataFrame:
        since = max((n for n in before if whole[n]), default=-1)
        paths = [f"{folder}/v{n}" for n in before if n >= since]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)

    def upsert(batch: DataFrame, number: int) -> None:
        before = sorted(n for n in whole if n < number)
        folds = number % compact == compact - 1
        last(written(before).unionByName(batch) if folds else batch).write.mode("overwrite").parquet(f"{folder}/v{number}")
        whole[number] = folds

    stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return last(written(sorted(whole)))


def tumbling(events: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts of event-time windows; what is later than ``late`` is left out. On a bounded table it is the plain aggregate."""
    watched = events.withWatermark("ts", late) if events.isStreaming else events
    return watched.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def without_replays(events: DataFrame, nonce: list[str], within: str) -> DataFrame:
    """The first row of each nonce within the time that state is kept."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(nonce) if events.isStreaming else events.dropDuplicates(nonce)


def limited(events: DataFrame, key: str, rate: float, burst: float) -> DataFrame:
    """A token bucket for each key as keyed state: (key, event_id, allowed).

    A key's rows of a micro-batch come in several pieces; they are put together before they are taken in order of time.
    What comes in a later micro-batch is taken later.
    """

    def run(who, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"])
        allowed = []
        for t in pdf["ts"].astype("datetime64[us]").astype("int64") / 1e6:
            tokens = min(burst, tokens + (0.0 if last is None else max(0.0, t - last) * rate))
            last = t
            allowed.append(tokens >= 1)
            tokens -= float(allowed[-1])
        yield pd.DataFrame({key: pdf[key], "event_id": pdf["event_id"], "allowed": allowed})
        state.update((tokens, last))

    return events.groupBy(key).applyInPandasWithState(run, f"{key} bigint, event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def guarded(messages: DataFrame, window_s: float) -> DataFrame:
    """(event_id, verdict) for messages (event_id, got, said, nonce): late or early if what they say is more than the
    window off from when they came, replay if their nonce has passed before, else accepted.

    Messages of a nonce are taken in order of arrival within a micro-batch, and after those of earlier ones. A stream is run
    until its source is used up; each micro-batch is one join with the nonces that passed before and one window, so no
    nonce costs a call of its own. A batch that is run again writes the same.
    """
    off = F.unix_micros("said") - F.unix_micros("got")
    timely = messages.withColumn("__off", F.when(off < int(-window_s * 1e6), "late").when(off > int(window_s * 1e6), "early"))
    first = F.row_number().over(Window.partitionBy("nonce", "__off").orderBy("got", "event_id")) == 1

    def judged(rows: DataFrame) -> DataFrame:
        passes = first & F.col("__passed").isNull()
        return rows.select("event_id", "nonce", F.coalesce("__off", F.when(passes, "accepted").otherwise("replay")).alias("verdict"))

    if not messages.isStreaming:
        return judged(timely.withColumn("__passed", F.lit(None))).select("event_id", "verdict")
    spark = messages.sparkSession
    folder = f"{shared_folder(spark)}/guard-{uuid.uuid4().hex}"
    schema = f"event_id {messages.schema['event_id'].dataType.simpleString()}, nonce {messages.schema['nonce'].dataType.simpleString()}, verdict string"
    done: set[int] = set()

    def written(numbers: list[int]) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{folder}/b{n}" for n in numbers]) if numbers else spark.createDataFrame([], schema)

    def judge(batch: DataFrame, number: int) -> None:
        before = sorted(n for n in done if n < number)
        passed = written(before).where("verdict = 'accepted'").select(F.col("nonce").alias("__n"), F.lit(True).alias("__passed"))
        rows = batch.join(passed, F.col("nonce").eqNullSafe(F.col("__n")), "left") if before else batch.withColumn("__passed", F.lit(None))
        judged(rows).write.mode("overwrite").parquet(f"{folder}/b{number}")
        done.add(number)

    timely.writeStream.foreachBatch(judge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return written(sorted(done)).select("event_id", "verdict")
