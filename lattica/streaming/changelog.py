"""A change log: numbered statements by shard, replay from a position, and how far replicas are behind."""

from __future__ import annotations

import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshot import _fs

ENTRY = "seq long, shard_id int, cypher string, ts timestamp"


class ChangeLog:
    """Appends go to files below a folder, one per append; the next number is one over the largest that was ever given.

    The log is the newest whole version in the folder: log-<n> holds what follows entry n. Truncation writes a version
    and only then deletes the older ones, so a crash between loses nothing.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.paused = False
        self.head = max(self.read().agg(F.max("seq")).first()[0] or 0, self._base())

    def _base(self) -> int:
        """The number that the newest whole version begins after."""
        fs, at = _fs(self.spark, self.folder)
        if not fs.exists(at):
            return 0
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return max((int(n[4:]) for n in names if n.startswith("log-") and n[4:].isdigit() and fs.exists(new(f"{self.folder}/{n}/_SUCCESS"))), default=0)

    @property
    def path(self) -> str:
        return f"{self.folder}/log-{self._base():020d}"

    @contextmanager
    def pause(self):
        """Appends within are left out: what a replay runs is in the log already."""
        before, self.paused = self.paused, True
        try:
            yield
        finally:
            self.paused = before

    def append(self, statements: list[tuple[int, str]]) -> int:
        """Log (shard, statement) in order; the last number."""
        if self.paused:
            return self.head
        now = time.time()
        rows = [(self.head + i + 1, s, c, now) for i, (s, c) in enumerate(statements)]
        if rows:
            df = self.spark.createDataFrame(rows, "seq long, shard_id int, cypher string, at double")
            df.select("seq", "shard_id", "cypher", F.col("at").cast("timestamp").alias("ts")).coalesce(1).write.mode("append").parquet(self.path)
            self.head += len(rows)
        return self.head

    def read(self, after: int = 0, shard_id: int | None = None, limit: int | None = None) -> DataFrame:
        """Entries with larger numbers, in order."""
        fs, at = _fs(self.spark, self.path)
        if not fs.exists(at):
            return self.spark.createDataFrame([], ENTRY)
        df = self.spark.read.schema(ENTRY).parquet(self.path).where(F.col("seq") > after)
        df = (df if shard_id is None else df.where(F.col("shard_id") == shard_id)).orderBy("seq")
        return df if limit is None else df.limit(limit)

    def truncate(self, upto: int) -> None:
        """Forget entries up to a number: the rest becomes a new version, and older versions are deleted."""
        base, upto = self._base(), min(upto, self.head)
        if upto <= base:
            return
        self.read(upto).write.mode("overwrite").parquet(f"{self.folder}/log-{upto:020d}")
        fs, at = _fs(self.spark, self.folder)
        for s in fs.listStatus(at):
            name = s.getPath().getName()
            if name.startswith("log-") and name[4:].isdigit() and int(name[4:]) < upto:
                fs.delete(s.getPath(), True)

    def status(self) -> DataFrame:
        """shard_id, entries, last_seq."""
        return self.read().groupBy("shard_id").agg(F.count("*").alias("entries"), F.max("seq").alias("last_seq"))

    def replay(self, engine, after: int = 0, shard_id: int | None = None, batch: int = 1000) -> tuple[int, int]:
        """Run what follows a position, batch by batch, each statement on the database that owns its shard; the last
        number and how many statements failed."""
        failed = 0
        with self.pause():
            while rows := self.read(after, shard_id, batch).collect():
                for r in rows:
                    try:
                        engine.cypher(r["cypher"], database=engine.databases.owner(r["shard_id"]) or "default")
                    except Exception:  # noqa: BLE001  a statement that fails is counted, and the next one runs
                        failed += 1
                    after = r["seq"]
        return after, failed


def positions(acks: DataFrame) -> DataFrame:
    """(shard_id, node, position): the largest number that each replica has acknowledged; acks: shard_id, node, seq."""
    return acks.groupBy("shard_id", "node").agg(F.max("seq").alias("position"))


def lag(acks: DataFrame, heads: DataFrame) -> DataFrame:
    """positions with head (of heads: shard_id, head) and lag, which is never under 0."""
    return positions(acks).join(heads, "shard_id").withColumn("lag", F.greatest(F.col("head") - F.col("position"), F.lit(0)))


def replay_positions(spark: SparkSession, folder: str, checkpoint: str) -> DataFrame:
    """A streaming table of the last number by shard, over the version of the log that grows now."""
    return spark.readStream.schema(ENTRY).parquet(ChangeLog(spark, folder).path).groupBy("shard_id").agg(F.max("seq").alias("last_seq"))
