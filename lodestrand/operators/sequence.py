"""Analysis of sequences in time.

Where the reference sequence is one for the whole table, it is cut into stretches of time with a halo
of what the frame reaches back or ahead for, so that no window runs in one task.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut
from lodestrand.tables import micros


def range_count(df: DataFrame, before_us: int, after_us: int, stretch_us: int = 86_400_000_000, by: list[str] | None = None, name: str = "n_near") -> DataFrame:
    """df with the number of rows from ``before_us`` microseconds before each row's ts to ``after_us`` after, itself included.

    Rows at equal times count each other. A row also goes as halo to the stretches of time that its
    neighbours' frames reach into; a stretch is never shorter than the frame, so there are three copies at most.
    """
    stretch = max(stretch_us, before_us + after_us + 1)
    us = micros()
    rows = df.withColumn("__us", us)
    reach = F.sequence(F.floor((F.col("__us") - after_us) / stretch), F.floor((F.col("__us") + before_us) / stretch))
    rows = rows.withColumn("__own", F.floor(F.col("__us") / stretch)).withColumn("__stretch", F.explode(reach))
    w = Window.partitionBy(*(by or []), "__stretch").orderBy("__us").rangeBetween(-before_us, after_us)
    return rows.withColumn(name, F.count("*").over(w)).where("__stretch = __own").drop("__us", "__own", "__stretch")


def sessions(df: DataFrame, key: str, gap_us: int) -> DataFrame:
    """Each key's runs of events less than the gap apart: start, end and number of events."""
    w = Window.partitionBy(key).orderBy("__us", "event_id")
    rows = df.withColumn("__us", micros())
    rows = rows.withColumn("__new", (F.col("__us") - F.lag("__us").over(w) >= gap_us).cast("int")).withColumn("session", F.coalesce(F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("bigint"))
    return rows.groupBy(key, "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n_events"))


def runs(df: DataFrame, by: list[str], value: str, order: list[str]) -> DataFrame:
    """Run lengths of equal values in order (run-length encoding)."""
    w = Window.partitionBy(*by).orderBy(*order)
    v = Window.partitionBy(*by, value).orderBy(*order)
    rows = df.withColumn("__run", F.row_number().over(w) - F.row_number().over(v))
    first = [F.min(F.struct(*order)).alias("__first")]
    return rows.groupBy(*by, value, "__run").agg(F.count("*").alias("run_length"), *first).select(*by, value, *[F.col(f"__first.{o}").alias(o) for o in order], "run_length")


def deltas(df: DataFrame, by: list[str], value: Column, order: list[str], name: str = "delta") -> DataFrame:
    return df.withColumn(name, value - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def rolling_baseline(df: DataFrame, by: list[str], value: str, order: list[str], rows: int = 100, sigmas: float = 3.0) -> DataFrame:
    """Rows above the mean and ``sigmas`` sample deviations of the last ``rows`` values, once there are so many."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({"n_seen": F.count(value).over(w), "mean": F.avg(value).over(w), "deviation": F.stddev_samp(value).over(w)}).where((F.col("n_seen") == rows) & (F.col(value) > F.col("mean") + sigmas * F.col("deviation")))


def in_order(df: DataFrame, by: list[str], order: list[str], size: str, step, name: str) -> DataFrame:
    """(by, order, name): what ``step(state, size) -> (state, number)`` says of each row, in order within its group.

    For rules that depend on all rows before. A group's rows pass through one task one after another, which holds its state and a batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(*by, *order, F.col(size).cast("double").alias("__size")).repartition(*by).sortWithinPartitions(*by, *order)

    def run(batches):
        group, state = None, None
        for pdf in batches:
            out, keys = [], [*zip(*[pdf[c].astype(object).where(pdf[c].notna(), None) for c in by], strict=True)]
            for key, x in zip(keys, pdf["__size"].tolist(), strict=True):
                if key != group:
                    group, state = key, None
                state, number = step(state, x)
                out.append(number)
            yield pdf.drop(columns="__size").assign(**{name: out})

    return rows.mapInPandas(run, ", ".join([*[f"{c} {kinds[c]}" for c in [*by, *order]], f"{name} bigint"]))


def fill_bins(df: DataFrame, by: list[str], size: str, order: list[str], limit: float, name: str = "bin") -> DataFrame:
    """(by, order, name): rows go in order to the same bin until one would pass the limit and begins the next.

    No task folds a group. Every row knows which one would begin the next bin if it began one itself: the first at which the
    running total is more than the limit ahead, found by counting totals in ranges. From a group's first row such steps are
    followed in jumps that double. Sizes are 0 or more (null: 0), and their totals exact, as those of whole numbers are.
    """
    rows = df.select(*by, *order, F.coalesce(F.col(size).cast("double"), F.lit(0.0)).alias("__size"))
    rows = cut(running(rows.withColumn("__one", F.lit(1.0)), by, order, {"__total": "__size", "__i": "__one"}))
    rows = rows.withColumn("__i", F.col("__i").cast("bigint") - 1)
    # How many totals of the group are no greater than a row's start, and than its start and the limit?
    start = F.col("__total") - F.col("__size")
    asked = F.explode(F.array(*[F.struct(F.lit(what).alias("what"), at.alias("at")) for what, at in enumerate([F.col("__total"), start, start + F.lit(float(limit))])]))
    totals = rows.select(*by, "__i", asked.alias("__a")).select(*by, "__i", "__a.what", "__a.at").withColumn("__is", (F.col("what") == 0).cast("double"))
    found = running(totals, by, ["at", "what", "__i"], {"__n": "__is"}).where("what > 0")
    # A bin takes rows while it holds nothing, so its next can't begin before the row after the first with a size.
    jump = found.groupBy(*by, "__i").agg(F.max(F.col("__n") + F.when(F.col("what") == 1, 1).otherwise(0)).cast("bigint").alias("__next"))
    jump = cut(jump)
    begun = cut(rows.where("__i = 0").select(*by, "__i"))
    last = rows.agg(F.max("__i")).first()[0]
    reach = 1
    while last is not None and reach <= last:
        ahead = begun.join(_keyed(jump, by), _same(by, "__i")).select(*by, F.col("__next").alias("__i"))
        begun = cut(begun.unionByName(ahead))
        jump = cut(jump.join(_keyed(jump, by, "__further"), _same(by, "__next")).select(*by, "__i", F.col("__further").alias("__next")))
        reach *= 2
        if jump.isEmpty():
            break
    first = begun.select(*by, F.col("__i")).distinct().withColumn("__next", F.lit(1.0))
    marked = rows.join(_keyed(first, by, "__begins"), _same(by, "__i"), "left").withColumn("__begins", F.coalesce("__begins", F.lit(0.0)))
    binned = running(marked.select(*by, *order, "__begins"), by, order, {name: "__begins"})
    return binned.select(*by, *order, (F.col(name) - 1).cast("bigint").alias(name))


def _keyed(rows: DataFrame, by: list[str], as_: str = "__next") -> DataFrame:
    return rows.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], F.col("__i").alias("__at"), F.col("__next").alias(as_))


def _same(by: list[str], i: str) -> Column:
    return reduce(and_, [F.col(c).eqNullSafe(F.col(f"__k{k}")) for k, c in enumerate(by)], F.col(i) == F.col("__at"))


def flushes(df: DataFrame, by: list[str], size: str, order: list[str], most_rows: int, most_size: float, name: str = "flush") -> DataFrame:
    """Which write of a buffer each row goes with: a buffer is written as soon as it holds so many rows, or so much."""

    def step(state, x):
        at, n, held = state or (0, 0, 0.0)
        n, held = n + 1, held + x
        return ((at + 1, 0, 0.0) if n >= most_rows or held >= most_size else (at, n, held)), at

    return in_order(df, by, order, size, step, name)


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their place (from 0) in the order of columns that tell all rows apart, counted in ranges side by side: no task sees all rows."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").count().orderBy("__range").collect()  # a row a partition
    before, offset = 0, []
    for r in counts:
        offset += [F.lit(r[0]), F.lit(before)]
        before += r[1]
    if not offset:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    return ranged.withColumn(name, (place + F.create_map(*offset)[F.col("__range")]).cast("bigint")).drop("__range")


def _in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in ranges of the order, materialised, with the range's number: a group of any size is spread over ranges."""
    return cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))


def _with_ends(rows: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """rows with what ends says of their range and group; ends has a row for each, so it is as small as ranges and groups are few."""
    named = ends.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(["__range", *by])], "__carry")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(["__range", *by])])
    return rows.join(named, same, "left").drop(*[f"__{i}" for i in range(len(by) + 1)])


def previous(rows: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with the value of the row before in their group, null for a group's first.

    Windows run within ranges; a range's last value of a group is carried to the next range that has the group.
    """
    parts = _in_ranges(rows, [*by, *order])
    ends = parts.groupBy("__range", *by).agg(F.max_by(value, F.struct(*order)).alias("__end"))
    ends = ends.withColumn("__carry", F.lag("__end").over(Window.partitionBy(*by).orderBy("__range")))
    w = Window.partitionBy("__range", *by).orderBy(*order)
    inside = parts.withColumns({"__first": F.row_number().over(w) == 1, name: F.lag(value).over(w)})
    return _with_ends(inside, ends, by).withColumn(name, F.when(F.col("__first"), F.col("__carry")).otherwise(F.col(name))).drop("__range", "__first", "__carry")


def running(rows: DataFrame, by: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """rows with running totals (name: column) in their group, the row itself included, summed in ranges and carried on."""
    parts = _in_ranges(rows, [*by, *order])
    ends = parts.groupBy("__range", *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__range", *by, F.struct(*[F.coalesce(F.sum(n).over(before), F.lit(0.0)).alias(n) for n in sums]).alias("__carry"))
    w = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = _with_ends(parts.withColumns({n: F.sum(c).over(w) for n, c in sums.items()}), ends, by)
    return inside.withColumns({n: F.col(n) + F.col(f"__carry.{n}") for n in sums}).drop("__range", "__carry")


def numbered_within(rows: DataFrame, by: list[str], order: list[str], name: str = "number") -> DataFrame:
    """rows with their place (from 0) in their group, counted within ranges and carried on from one range to the next."""
    parts = _in_ranges(rows, [*by, *order])
    counts = parts.groupBy("__range", *by).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    place = F.row_number().over(Window.partitionBy("__range", *by).orderBy(*order)) - 1
    inside = _with_ends(parts.withColumn(name, place), counts.withColumn("__carry", F.coalesce(before, F.lit(0))), by)
    return inside.withColumn(name, (F.col(name) + F.col("__carry")).cast("bigint")).drop("__range", "__carry")
