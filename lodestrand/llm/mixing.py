"""Mixing sources to target weights by a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import cut, every, fresh, named

#: A schedule is a list of (time, weight) knots from time 0 to 1, joined by straight lines.
Schedule = list[tuple[float, float]]

#: Sources in order weigh 1, 2, 3, repeating; a class's weight is its area, and its schedule says when it is drawn.
WEIGHTS = (1, 2, 3)
SCHEDULES: tuple[Schedule, ...] = ([(0.0, 1.5), (1.0, 0.5)], [(0.0, 1.0), (1.0, 1.0)], [(0.0, 0.5), (0.5, 1.0), (1.0, 1.5)])

#: A source is cut into 16**3 buckets by its documents' order keys, so that none is summed up in one task.
BUCKET_DIGITS = 3


def invert(share: Column, schedule: Schedule) -> Column:
    """The time by which a schedule has given out ``share`` (0 to 1) of its whole integral."""
    if not (schedule[0][0] == 0.0 and schedule[-1][0] == 1.0 and all(a[0] < b[0] for a, b in zip(schedule, schedule[1:], strict=False)) and all(w > 0 for _, w in schedule)):
        raise ValueError("a schedule runs from time 0 to 1 in rising order, with weights above 0")
    area = [0.0]
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        area.append(area[-1] + (t1 - t0) * (w0 + w1) / 2)
    due, out = share * F.lit(area[-1]), None
    for k in range(len(schedule) - 2, -1, -1):
        (t0, w0), (t1, w1) = schedule[k], schedule[k + 1]
        rise, rest = (w1 - w0) / (t1 - t0), due - F.lit(area[k])
        at = F.lit(t0) + (rest / F.lit(w0) if rise == 0 else (F.sqrt(F.lit(w0 * w0) + rest * F.lit(2 * rise)) - F.lit(w0)) / F.lit(rise))
        out = at if out is None else F.when(due < F.lit(area[k + 1]), at).otherwise(out)
    return out


def word_count(text: Column) -> Column:
    """Runs of anything but white space (space and U+0009 to U+000D); 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """sizes (key, source, source_size) with weight, schedule class and target.

    The targets share the sum of all sizes by weight; none passes ``most`` times its source's size,
    and what is above goes to the others by weight until none is above. In closed form: sources in
    order of cap over weight fill up one after another, and the first that the remaining level
    doesn't fill fixes the level. The windows run over one row a source, not over documents.
    """
    named = Window.orderBy(F.col("source").isNull(), "source")
    rows = sizes.withColumn("class", F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("class") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    filled = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(every) - (F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))) / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return rows.select("key", "source", "source_size", "class", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, schedules: tuple[Schedule, ...] = SCHEDULES, most: int = 3, drop_text: bool = False) -> DataFrame:
    """docs with a struct as last column, ``__mix``: size, source_size, target, copies, positions.

    Within its source a document has a place by the hash of its id and text. A source is read in that order,
    over and over, until its target is reached: the document in which that happens is taken if its
    middle comes before. A copy's share of the target drawn so far, put through the inverse of the
    integrated schedule, is its position in the training run (0 to 1).

    Prefix sums have two levels (buckets of the hash, then rows within a bucket), so a source that
    holds a third of all rows spreads over 4096 buckets, and so do null ids and much repeated ones, but for
    rows equal in id and text. Documents are shuffled once, by source and bucket. With ``drop_text`` the
    words are counted once and texts go no further; else once for the sums and once where the rows are placed.

    Null texts have size 0 and are never taken. Null sources form one source of their own,
    the last. Rows equal in id and text are interchangeable. An empty table gives no rows, and texts may be of any
    length. All columns of docs stay whatever their names: if one is called ``__mix``, ours gets an underscore more.
    """
    text = named(text_col).cast("string")
    order = F.md5(F.concat(F.coalesce(named(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))
    kept = docs.drop(text_col) if drop_text else docs
    source = named(source_col).cast("string")
    rows = docs.select(every(kept).alias("doc"), word_count(text).alias("size"), F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source)).alias("key"), order.alias("order"))
    rows = cut(rows) if drop_text else rows
    rows = rows.withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    sums = cut(rows.groupBy("key", "bucket").agg(F.sum("size").alias("bucket_size")))
    sizes = sums.groupBy("key").agg(F.sum("bucket_size").alias("source_size"))
    whole = targets(sizes.withColumn("source", F.when(F.col("key") != "", F.substr("key", F.lit(2)))), weights, most).drop("source")
    sums = sums.withColumn("before", F.sum("bucket_size").over(Window.partitionBy("key").orderBy("bucket")) - F.col("bucket_size"))
    # Joined by the keys that the window goes by, so that documents are dealt out once; the sums grow with the sources.
    rows = rows.join(sums.join(whole, "key").drop("bucket_size"), ["key", "bucket"])
    place = Window.partitionBy("key", "bucket").orderBy("order")
    rows = rows.withColumn("start", F.col("before") + F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    full = F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    extra = (F.col("start") + F.col("size") / 2) < F.col("target") - full * F.col("source_size")
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 0).otherwise(full + extra.cast("int")).cast("int"))
    share = lambda j: F.least(F.lit(1.0), (j * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.col("target"))

    def position(j: Column) -> Column:
        out = invert(share(j), schedules[-1])
        for k in range(len(schedules) - 1):
            out = F.when(F.pmod(F.col("class"), F.lit(len(schedules))) == k, invert(share(j), schedules[k])).otherwise(out)
        return out

    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    rows = rows.select("doc", F.struct("size", "source_size", "target", "copies", positions.alias("positions")).alias("mix"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in kept.columns], F.col("mix").alias(fresh(kept, "__mix")))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The training sequence: a row for each copy taken, with the columns of docs, range-sorted by position."""
    rows = plan(docs, **options)
    rows = rows.select(every(docs).alias("doc"), F.explode(named(rows.columns[-1])["positions"]).alias("at"))
    return rows.repartitionByRange("at").sortWithinPartitions("at").select(*[F.col("doc")[c].alias(c) for c in docs.columns])
