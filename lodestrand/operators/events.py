"""Event logs and audit trails: filters, state from events, time travel, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.operators import sequence


def event_filter(df: DataFrame, start=None, end=None, types: list[str] | None = None, agent: tuple[str, object] | None = None, limit: int | None = None, order: list | None = None) -> DataFrame:
    """Events between two times, both included, of given types and agent; the first ``limit`` in order."""
    if start is not None:
        df = df.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    if types:
        df = df.where(F.col("event_type").isin(types))
    if agent:
        df = df.where(F.col(agent[0]) == F.lit(agent[1]))
    return df.orderBy(*(order or ["ts", "event_id"])).limit(limit) if limit is not None else df


def latest_state(events: DataFrame, key: str, fields: list[str], create: Column, delete: Column, order: list[str], until: Column | None = None) -> DataFrame:
    """The state of each key that is not deleted: the last value that isn't null of each field since the last creation.

    A creation replaces the state, any other event merges into it. Two aggregates by key, no sort: the
    last creation first, then the greatest event for each field after it. ``until`` replays to a point in time.
    """
    at = F.struct(*order)
    rows = events.where(until) if until is not None else events
    whole = Window.partitionBy(key)
    rows = rows.withColumn("__at", at).withColumn("__born", F.max(F.when(create, F.col("__at"))).over(whole))
    rows = rows.where(F.col("__born").isNull() | (F.col("__at") >= F.col("__born")))
    last = [F.max_by(F.when(F.col(f).isNotNull(), F.struct(f)), F.when(F.col(f).isNotNull(), F.col("__at")))[f].alias(f) for f in fields]
    state = rows.groupBy(key).agg(F.max_by(delete, "__at").alias("__gone"), F.count("*").alias("n_events"), *last)
    return state.where(~F.col("__gone")).drop("__gone")


def unchanged(df: DataFrame, key: str, value: Column, order: list[str]) -> Column:
    """Whether a row repeats the value of the row of its key before it."""
    return value.eqNullSafe(F.lag(value).over(Window.partitionBy(key).orderBy(*order))) & (F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def last_write(df: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """Each key's values by the greatest (time, writer)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("__v")).select(key, "__v.*")


def chain_breaks(df: DataFrame, key: str, previous: str, current: str, order: str) -> DataFrame:
    """Rows whose link isn't the hash of the row before; a chain's first row links to anything. Chains of any length are followed in ranges."""
    rows = sequence.previous(df, [key], [order], current, "__expected")
    return rows.where(F.col("__expected").isNotNull() & ~F.col(previous).eqNullSafe(F.col("__expected"))).withColumnRenamed("__expected", "expected")
