"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut

__all__ = ["BROADCAST_ROWS", "LOWER", "WORDS", "cut", "every", "fresh", "mapped", "named", "small_side", "table", "unit_hash"]

#: Lower-cases A-Z and leaves every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z and blanks what is neither a digit, a letter a-z nor a byte of a non-ASCII character.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Narrow rows that a join broadcasts at most; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of that very name, dots and quotes in it included."""
    return F.col("`" + name.replace("`", "``") + "`")


def every(docs: DataFrame) -> Column:
    """All columns of docs as one struct, so that no name in it can clash with one of ours."""
    return F.struct(*map(named, docs.columns))


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it if docs has a column of that name in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mapped(df: DataFrame, run, keep: list[str]) -> DataFrame:
    """df.mapInArrow(run), where run gives the columns ``keep`` of df; names may have dots, which mapInArrow can't take."""
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    return plain.mapInArrow(run, plain.select(*[f"c{df.columns.index(c)}" for c in keep]).schema).toDF(*keep)


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its measured row count allows one, else as it is."""
    return F.broadcast(df) if rows <= most else df


def unit_hash(*cols: Column) -> Column:
    """A deterministic number in (0, 1) from the columns' values."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") + 0.5) / float(1 << 53)
