"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.common import BROADCAST_ROWS, cut, every, fresh, named, small_side

#: Bytes of text that a shard holds at most.
SHARD_BYTES = 16 << 20
#: Bits of a hash, of the first directory and of each directory below it.
HASH_BITS, FIRST_BITS, MORE_BITS = 60, 12, 8


def hash60(id_col: Column, text: Column) -> Column:
    """The first 60 bits of an MD5 over a row's id and text; rows that differ in either are spread."""
    name = F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _directory(hist: DataFrame, base: int, bits: int, limit: int) -> DataFrame:
    """(entry, depth) for each prefix of base + bits hash bits in hist (entry, bytes, n).

    depth is the least number of bits at which the entry's bucket fits the limit (or holds one
    document, which can't be split), null if none up to base + bits does. Never below base, as the
    bucket of base bits is known to be too large.
    """
    hist = cut(hist)
    size = hist.count()
    every = hist.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(base + bits))))
    every = every.withColumn("bucket", F.expr(f"shiftright(entry, {base + bits} - depth)"))
    fits = every.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).where((F.col("bytes") <= limit) | (F.col("n") == 1)).select("depth", "bucket")
    # Shallow buckets hold all entries: a join by bucket would gather them in one task unless the other side is sent about.
    found = every.select("entry", "depth", "bucket").join(small_side(fits, size * (bits + 1), BROADCAST_ROWS), ["depth", "bucket"]).groupBy("entry").agg(F.min("depth").alias("depth"))
    return hist.select("entry").join(found, "entry", "left")


def assign(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, place: Column | None = None) -> DataFrame:
    """(id, bytes, shard, depth) for each row, or all columns of docs with shard and depth (and ``place``) by ``carry``.

    A shard's name is its hash prefix in binary, depth bits long ('' is the only shard of a small
    table). Buckets over ``limit`` bytes of UTF-8 text split on the next bit, others don't; a
    shard goes over the limit only if it is one document that does. The directory grows level by
    level: a histogram of the first 12 bits for all rows, then of 8 more bits for rows of buckets
    still too large. Histograms are partial aggregates, and the directory has at most 256 entries
    for each oversized bucket; it is broadcast while it is small, by count.

    Null ids and texts count as empty, and texts may be of any length. Rows equal in id and text can't be told apart by
    hash: those that pass the limit together go to numbered pages, '<prefix>.<page>'. An empty table gives no rows. The
    columns of docs stay whatever their names: if one is called as a column of ours, ours gets an underscore more.
    """
    text = named(text_col).cast("string")
    size, code = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"), hash60(named(id_col), text)
    slim = cut(docs.select(named(id_col).alias("id"), size.alias("bytes"), code.alias("h")))
    rows = docs.select(every(docs).alias("doc"), size.alias("__bytes"), code.alias("__h"), (place if place is not None else F.lit(None).cast("bigint")).alias("__place")) if carry else slim.withColumnsRenamed({"bytes": "__bytes", "h": "__h"})
    rows = rows.withColumn("__depth", F.lit(None).cast("int"))
    base, bits, left = 0, FIRST_BITS, slim
    while bits:
        top = base + bits
        entry = F.shiftright("h", HASH_BITS - top)
        directory = cut(_directory(left.groupBy(entry.alias("entry")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n")), base, bits, limit))
        size, over = directory.agg(F.count("*"), F.count_if(F.col("depth").isNull())).first()
        known = small_side(directory.select(F.col("entry").alias("__entry"), F.col("depth").alias("__found")), size, BROADCAST_ROWS)
        rows = rows.withColumn("__entry", F.shiftright("__h", HASH_BITS - top)).join(known, "__entry", "left").withColumn("__depth", F.coalesce("__depth", "__found")).drop("__entry", "__found")
        if not over:
            break
        large = small_side(directory.where("depth IS NULL").select("entry"), over, BROADCAST_ROWS)
        left = left.withColumn("entry", entry).join(large, "entry", "left_semi").drop("entry")
        base, bits = top, min(MORE_BITS, HASH_BITS - top)
    else:  # equal rows, more of them than fit
        page = Window.partitionBy("__h").orderBy("__bytes")
        number = F.floor((F.row_number().over(page) - 1) / F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("__bytes", F.lit(1))))).cast("string")
        stuck = rows.where("__depth IS NULL").withColumn("__page", number)
        rows = rows.where("__depth IS NOT NULL").withColumn("__page", F.lit(None).cast("string")).unionByName(stuck)
    depth = F.coalesce("__depth", F.lit(HASH_BITS))
    bits_of = F.substring(F.lpad(F.bin("__h"), HASH_BITS, "0"), F.lit(1), depth)
    shard = F.concat(bits_of, F.coalesce(F.concat(F.lit("."), "__page"), F.lit(""))) if "__page" in rows.columns else bits_of
    if not carry:
        return rows.select("id", F.col("__bytes").alias("bytes"), shard.alias("shard"), depth.alias("depth"))
    rows = rows.select("doc", F.struct(shard.alias("shard"), depth.alias("depth"), F.col("__place").alias("place")).alias("ours"))
    return rows.select(*[F.col("doc")[c].alias(c) for c in docs.columns], *[F.col("ours")[c].alias(fresh(docs, c)) for c in ("shard", "depth", *(["place"] if place is not None else []))])


def sharded(docs: DataFrame, place: Column | None = None, **options) -> DataFrame:
    """docs with their shard, each shard's rows together in one partition: ready for write.partitionBy("shard").

    place: a number that says where a row stands in the order of training; each shard is then in that order.
    """
    rows = assign(docs, carry=True, place=place, **options)
    shard = fresh(docs, "shard")
    out = rows.repartition(named(shard))
    return out.sortWithinPartitions(named(shard), named(rows.columns[-1])) if place is not None else out
