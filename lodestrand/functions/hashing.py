"""Content hashes and hash chains as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The hash before the first block of a chain: 32 zero bytes.
GENESIS = "00" * 32


def content_hash(data: Column, metadata: Column | None = None) -> Column:
    """SHA-256 of the data; with metadata, SHA-256 of that digest's bytes followed by the metadata. Empty metadata count as none."""
    plain = F.sha2(data.cast("binary"), 256)
    if metadata is None:
        return plain
    both = F.sha2(F.concat(F.unhex(plain), F.encode(metadata, "UTF-8")), 256)
    return F.when(metadata.isNull() | (metadata == ""), plain).otherwise(both)


def canonical(*cols: Column) -> Column:
    """One string for several values, with nulls told from empty strings."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols])


def short_id(text: Column) -> Column:
    return F.left(F.sha2(text.cast("binary"), 256), F.lit(16))


def shard_of(key: Column, shards: int = 16) -> Column:
    """MD5 of the key modulo the number of shards, a power of 16 at most 16**14."""
    digits = len(f"{shards:x}") - 1
    if shards != 16**digits:
        raise ValueError("the number of shards is a power of 16")
    return F.conv(F.right(F.md5(key.cast("binary")), F.lit(digits)), 16, 10).cast("bigint")
