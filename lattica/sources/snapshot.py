"""Snapshots of a graph in any folder that Spark can write: one Parquet table each, and a manifest."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..catalog import GraphCatalog
from ..errors import DatabaseError

VERSION = 1
_SAFE = re.compile(r"[A-Za-z0-9_.-]+")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(graph: GraphCatalog, folder: str, shard_count: int = 1, wal_sequence: int = 0) -> str:
    """Write a snapshot into a new folder below folder; its path. The manifest comes last, so a snapshot with one is whole."""
    path = f"{folder.rstrip('/')}/snapshot-{time.time_ns():020d}"
    tables = []
    for kind, ts in (("node", graph.nodes), ("rel", graph.rels)):
        for t in ts:
            t.df.write.parquet(f"{path}/{kind}-{t.name}")
            tables.append({"kind": kind, "name": t.name, "key": getattr(t, "key", None), "src": getattr(t, "src", None), "dst": getattr(t, "dst", None)})
    manifest = {"version": VERSION, "created_at": time.time(), "shard_count": shard_count, "wal_sequence": wal_sequence, "delivered": graph.delivered, "tables": tables}
    spark = graph.spark
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return path


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))


def restore(graph: GraphCatalog, path: str) -> dict:
    """Put a snapshot's tables into an empty graph; the manifest."""
    got = manifest(graph.spark, path)
    if got["version"] != VERSION:
        raise DatabaseError(f"snapshot of version {got['version']}")
    for t in sorted(got["tables"], key=lambda t: t["kind"]):
        if not _SAFE.fullmatch(t["name"]):
            raise DatabaseError(f"bad table name {t['name']!r}")
        df = graph.spark.read.parquet(f"{path}/{t['kind']}-{t['name']}")
        if t["kind"] == "node":
            graph.add_node(t["name"], df, t["key"])
        else:
            graph.add_rel(t["name"], df, t["src"], t["dst"])
    graph.delivered = dict(got.get("delivered", {}))
    return got


def snapshots(spark: SparkSession, folder: str) -> list[str]:
    """Whole snapshots, the newest first."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("snapshot-")]
    new = spark._jvm.org.apache.hadoop.fs.Path
    return sorted((str(x.toString()) for x in found if fs.exists(new(f"{x.toString()}/manifest/_SUCCESS"))), reverse=True)


def retain(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Delete all but the newest snapshots; what was deleted."""
    gone = snapshots(spark, folder)[max(0, keep) :]
    for path in gone:
        fs, p = _fs(spark, path)
        fs.delete(p, True)
    return gone


class Scheduler:
    """Saves a graph every so many seconds on a thread of its own, and keeps the newest snapshots.

    log_position gives the number of the last logged change, which the manifest carries. A snapshot that fails is noted
    in errors, and the next one is tried in its turn.
    """

    def __init__(self, graph: Callable[[], GraphCatalog] | GraphCatalog, folder: str, interval: float, keep: int, shard_count: int = 1, log_position: Callable[[], int] = lambda: 0):
        if interval <= 0 or keep < 1:
            raise DatabaseError("a scheduler needs a positive interval and at least one snapshot to keep")
        self.graph, self.folder, self.interval, self.keep = graph, folder, interval, keep
        self.shard_count, self.log_position = shard_count, log_position
        self.saved: list[str] = []
        self.errors: list[str] = []
        self._halt, self._thread = threading.Event(), None

    def run_once(self) -> str | None:
        """One snapshot and the deletion of old ones; its path, or None where it failed."""
        try:
            graph = self.graph() if callable(self.graph) else self.graph
            path = save(graph, self.folder, self.shard_count, self.log_position())
            self.saved.append(path)
            retain(graph.spark, self.folder, self.keep)
            return path
        except Exception as e:  # noqa: BLE001  the schedule goes on after a failure
            self.errors.append(f"{type(e).__name__}: {e}")
            return None

    def start(self) -> None:
        if self._thread is not None:
            raise DatabaseError("the scheduler runs already")
        self._halt.clear()
        self._thread = threading.Thread(target=self._loop, daemon=True)
        self._thread.start()

    def _loop(self) -> None:
        while not self._halt.wait(self.interval):
            self.run_once()

    def stop(self) -> None:
        """Wait for a snapshot that is being written, and end."""
        self._halt.set()
        if self._thread is not None:
            self._thread.join()
        self._thread = None
