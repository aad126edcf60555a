"""Counts, profiles, metrics and costs. All are partial aggregates followed by a shuffle of one row a group and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.times import period
from lodestrand.tables import micros

# severities' weights, and the bands of the mean.
SEVERITY = {"critical": 1.0, "high": 0.7, "medium": 0.4, "low": 0.1}
BANDS = ((0.8, "critical"), (0.6, "high"), (0.3, "medium"))


def column_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a numeric column: rows, nulls, least, greatest, sum, mean, population variance and deviation, distinct values; one pass over the table."""
    aggs = []
    for c in columns:
        x = F.col(c).cast("double")
        aggs += [F.struct(F.lit(c).alias("column_name"), F.count("*").alias("row_count"), F.count_if(F.col(c).isNull()).alias("null_count"), F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.round(F.sum(x), 2).alias("sum_value"), F.round(F.avg(x), 6).alias("mean_value"), F.round(F.var_pop(x), 4).alias("variance"), F.round(F.stddev_pop(x), 6).alias("std_dev")).alias(f"s_{c}")]
    return df.agg(*aggs).select(F.explode(F.array(*[F.col(f"s_{c}") for c in columns])).alias("s")).select("s.*")


def top(df: DataFrame, by: str, n: int, name: str = "n") -> DataFrame:
    """The n most frequent values, ties to the smaller."""
    return df.groupBy(by).agg(F.count("*").alias(name)).orderBy(F.desc(name), by).limit(n)


def outcomes(df: DataFrame, by: list[str], success: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(success).alias("successful"), F.count_if(~success).alias("failed"))


def five_statistics(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"))


def fan_out(stats: DataFrame, ids: list[str]) -> DataFrame:
    """Each statistic of five_statistics as a row of its own."""
    wide = stats.select(*ids, F.col("n").cast("double").alias("count"), F.col("total").alias("sum"), F.col("least").alias("min"), F.col("most").alias("max"), F.col("mean").alias("avg"))
    return wide.unpivot(ids, ["count", "sum", "min", "max", "avg"], "statistic", "value")


def cost(units: Column, free: float, rate: str) -> Column:
    """Decimal cost of a call: units above the free ones, which every call has, times the rate."""
    return (F.greatest(units - F.lit(free), F.lit(0.0)).cast("decimal(20,4)") * F.lit(rate).cast("decimal(20,10)")).cast("decimal(38,10)")


def budget_crossings(df: DataFrame, limit: float, steps: tuple[float, ...] = (0.5, 0.8, 0.95), kind: str = "monthly", ts: str = "ts", amount: str = "amount", tie: str = "id") -> DataFrame:
    """The rows at which a period's running total first reaches a step of the limit."""
    order = Window.partitionBy("period").orderBy(ts, tie)
    rows = df.withColumn("period", period(F.col(ts), kind)).withColumn("running", F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("running") - F.col(amount))
    crossed = F.filter(F.array(*[F.when((F.col("before") < s * limit) & (F.col("running") >= s * limit), F.lit(s)) for s in steps]), lambda x: x.isNotNull())
    return rows.withColumn("step", F.explode(crossed)).select("period", tie, "step", "running")


def agent_profile(versions: DataFrame) -> DataFrame:
    """An agent's operations, rate an hour, common operations, night share, telling patterns and risk."""
    us = micros()
    per = versions.withColumn("us", us).groupBy("agent_id", "operation").agg(F.count("*").alias("n"), F.min("us").alias("a"), F.max("us").alias("b"), F.count_if((F.hour("ts") >= 22) | (F.hour("ts") <= 6)).alias("night"))
    whole = per.groupBy("agent_id").agg(F.sum("n").alias("total_operations"), F.min("a").alias("a"), F.max("b").alias("b"), F.sum("night").alias("night"), F.array_sort(F.collect_list(F.struct("operation", "n"))).alias("ops"), F.sum(F.when(F.col("operation") == "delete", F.col("n")).otherwise(0)).alias("deletes"))
    # One row holds as many operations as there are types, not as the agent has done.
    hours = F.when(F.col("total_operations") > 1, (F.col("b") - F.col("a")) / 3.6e9).otherwise(F.lit(1.0 / 3600))
    rows = whole.withColumn("rate", F.when(hours > 0, F.col("total_operations") / hours).otherwise(0.0))
    rows = rows.withColumn("delete_ratio", F.col("deletes") / F.col("total_operations")).withColumn("night_ratio", F.col("night") / F.col("total_operations"))
    odd = F.filter(F.array(F.when(F.col("delete_ratio") > 0.3, "high_deletion_ratio"), F.when(F.col("rate") > 100, "excessive_activity_rate"), F.when(F.col("night_ratio") > 0.5, "unusual_timing")), lambda x: x.isNotNull())
    common = F.transform(F.filter("ops", lambda o: o["n"] / F.col("total_operations") > 0.2), lambda o: o["operation"])
    risk = F.least(F.lit(1.0), F.least(F.lit(0.3), F.col("delete_ratio")) + F.least(F.lit(0.3), F.col("rate") / 1000) + F.size(odd) * 0.2)
    return rows.select("agent_id", "total_operations", F.round("rate", 6).alias("operation_frequency"), F.concat_ws(",", common).alias("common_operations"), F.concat_ws(",", odd).alias("unusual_patterns"), F.round(risk, 6).alias("risk_score"), F.round("night_ratio", 6).alias("night_ratio"))


def severity_weight(severity: Column) -> Column:
    out = None
    for name, weight in SEVERITY.items():
        out = F.when(severity == name, weight) if out is None else out.when(severity == name, weight)
    return out


def risk_assessment(evidence: DataFrame) -> DataFrame:
    """One row: mean of weight times confidence, its band, mean confidence; no evidence is a low risk of 0."""
    rows = evidence.agg(F.count("*").alias("total_evidence"), F.sum(severity_weight(F.col("severity")) * F.col("confidence")).alias("risk"), F.avg("confidence").alias("mean"))
    rows = rows.withColumn("score", F.least(F.lit(1.0), F.coalesce(F.try_divide("risk", "total_evidence"), F.lit(0.0))))
    band = F.lit("low")
    for least, name in reversed(BANDS):
        band = F.when(F.col("score") >= least, name).otherwise(band)
    return rows.select("total_evidence", F.round("score", 6).alias("risk_score"), band.alias("overall_risk"), F.round(F.coalesce("mean", F.lit(1.0)), 6).alias("confidence"))


def with_zeros(names: list[str], counted: DataFrame, key: str, value: str) -> DataFrame:
    """Counts for every listed name, 0 for those that don't occur."""
    spark = counted.sparkSession
    listed = spark.createDataFrame([(n,) for n in names], f"{key} string")
    return listed.join(counted, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("bigint").alias(value))
