"""Tables that change by versions in a shared folder: transactions, blocks that are appended and updated, and a write-ahead log."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.functions.storage import cut


class Conflict(RuntimeError):
    """Another transaction has committed the version that this one was to become."""


@dataclass(frozen=True)
class Store:
    """A table with a key, as a row of versions: version n is the upserts of the commits up to the n-th.

    A commit adds one folder of changes and rewrites nothing; readers take the last change of each key.
    """

    spark: SparkSession
    folder: str
    schema: str
    key: str

    def latest(self) -> int:
        """The number of the last commit; 0 for an empty store."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in files.listStatus(path)] if files.exists(path) else []
        return max((int(n.split("=")[1]) for n in names if n.startswith("commit=")), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows as of a version (the last one, if None is given): the last change of each key, without deleted ones."""
        version = self.latest() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        changes = self.spark.read.schema(f"{self.schema}, deleted boolean").option("basePath", self.folder).parquet(*[f"{self.folder}/commit={n}" for n in range(1, version + 1)])
        rest = [c for c in changes.columns if c not in (self.key, "commit")]
        last = changes.groupBy(self.key).agg(F.max_by(F.struct(*rest), "commit").alias("last"))
        return last.where("NOT last.deleted").select(*[F.col(c) if c == self.key else F.col(f"last.{c}") for c in self.spark.createDataFrame([], self.schema).columns])

    def begin(self) -> Transaction:
        return Transaction(self, self.latest())


@dataclass
class Transaction:
    """Changes that nobody else sees before commit(); reads see the version at which it began and its own changes."""

    store: Store
    at: int
    staged: list[DataFrame] = field(default_factory=list)
    state: str = "active"

    def _change(self, rows: DataFrame, deleted: bool) -> None:
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        self.staged.append(rows.withColumn("deleted", F.lit(deleted)).withColumn("step", F.lit(len(self.staged))))

    def write(self, rows: DataFrame) -> None:
        """Add rows, or put them in the place of those with their keys. Of rows with one key in one write, which counts is left open."""
        self._change(rows.select(*self.store.spark.createDataFrame([], self.store.schema).columns), False)

    def delete(self, keys: DataFrame) -> None:
        """Take away the rows with these keys."""
        empty = self.store.spark.createDataFrame([], self.store.schema)
        self._change(keys.select(self.store.key).select(*[F.col(c) if c == self.store.key else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns]), True)

    def _changes(self) -> DataFrame:
        both = self.staged[0]
        for x in self.staged[1:]:
            both = both.unionByName(x)
        rest = [c for c in both.columns if c not in (self.store.key, "step")]
        return both.groupBy(self.store.key).agg(F.max_by(F.struct(*rest), "step").alias("last")).select(self.store.key, "last.*")

    def read(self) -> DataFrame:
        before = self.store.read(self.at)
        if not self.staged:
            return before
        changes = self._changes()
        return before.join(changes.select(self.store.key), self.store.key, "left_anti").unionByName(changes.where("NOT deleted").select(*before.columns))

    def commit(self) -> int:
        """The number of the new version. Fails, and changes nothing, if another transaction was first.

        The folder of a commit is written aside and renamed, which only one of two rivals can do.
        """
        if self.state != "active":
            raise RuntimeError(f"the transaction is {self.state}")
        if not self.staged:
            self.state = "committed"
            return self.at
        spark, number = self.store.spark, self.at + 1
        aside, place = f"{self.store.folder}/_staged-{uuid.uuid4().hex}", f"{self.store.folder}/commit={number}"
        self._changes().write.parquet(aside)
        path = spark._jvm.org.apache.hadoop.fs.Path
        files = path(aside).getFileSystem(spark._jsc.hadoopConfiguration())
        if self.store.latest() != self.at or not files.rename(path(aside), path(place)) or self.store.latest() != number:
            files.delete(path(aside), True)
            self.state = "aborted"
            raise Conflict(f"version {number} has been committed by another transaction")
        self.state = "committed"
        return number

    def abort(self) -> None:
        self.staged, self.state = [], "aborted"


def log_append(entries: DataFrame, folder: str) -> None:
    """Append entries (seq, kind, payload: strings but for seq) to a write-ahead log: JSON lines, each with the digest of its payload."""
    entries.select("seq", "kind", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("digest")).write.mode("append").json(folder)


def log_recover(spark: SparkSession, folder: str) -> DataFrame:
    """The entries (seq, kind, payload) of a log that are whole: lines that don't parse, and payloads that aren't as they were written, are passed over."""
    try:
        lines = spark.read.schema("seq bigint, kind string, payload string, digest string, broken string").option("columnNameOfCorruptRecord", "broken").json(folder)
    except AnalysisException:
        return spark.createDataFrame([], "seq bigint, kind string, payload string")
    return cut(lines).where("broken IS NULL").where(F.sha2(F.col("payload").cast("binary"), 256) == F.col("digest")).select("seq", "kind", "payload")
