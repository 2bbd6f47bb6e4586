"""A durable ingest queue: jobs are files in a spool, loaded by a Structured Streaming query with a checkpoint.

A job is a folder that is written whole, by as many tasks as its rows have, and then moved into the inbox of its table,
so the stream never sees half of one. Each micro batch is checked and stored under its batch number: a batch that runs
again writes the same folder again. deliver puts batches into a graph, which remembers the last one it holds.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..catalog import GraphCatalog
from ..errors import QueryError
from ..operators.mutate import upsert
from ..operators.paths import scratch_table
from ..sources.csv_io import put_edges
from ..sources.snapshot import _fs

_BAD = "_corrupt_record"
JOB = "id string, table string, kind string, submitted_at double, file string"


class IngestQueue:
    """Jobs of CSV rows for tables with known schemas, below one folder that all executors reach. A name of a table that
    holds both kinds of rows is the caller's error: kind says what a job was submitted as."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def submit(self, table: str, rows: DataFrame | str, kind: str = "nodes") -> str:
        """Queue rows (a DataFrame of text columns or the text of a CSV with a header); the job's id."""
        if kind not in ("nodes", "edges"):
            raise QueryError(f"unknown job type {kind}")
        job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        fs, inbox = _fs(self.spark, f"{self.folder}/inbox/{table}")
        fs.mkdirs(inbox)
        new = self.spark._jvm.org.apache.hadoop.fs.Path
        if isinstance(rows, str):
            out = fs.create(new(f"{self.folder}/spool/{job}/part-0.csv"))
            out.write(bytearray(rows.encode()))
            out.close()
        else:
            rows.write.option("header", True).csv(f"{self.folder}/spool/{job}")
        self.spark.createDataFrame([(job, table, kind, time.time(), job)], JOB).coalesce(1).write.mode("append").json(f"{self.folder}/jobs")
        fs.rename(new(f"{self.folder}/spool/{job}"), new(f"{self.folder}/inbox/{table}/{job}"))
        return job

    def run(self, table: str, schema: T.StructType, flush_files: int = 50) -> DataFrame:
        """Load all that waits for a table; its rows so far. Malformed rows are left out and counted by job."""
        whole = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
        stream = self.spark.readStream.schema(whole).option("header", True).option("columnNameOfCorruptRecord", _BAD).option("maxFilesPerTrigger", flush_files).option("recursiveFileLookup", True).csv(f"{self.folder}/inbox/{table}")
        named = stream.withColumn("_job", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))

        def load(batch: DataFrame, number: int) -> None:
            # every column is read and stored before any is counted
            at = f"{self.folder}/batches/{table}/batch={number}"
            batch.write.mode("overwrite").parquet(at)

        query = named.writeStream.foreachBatch(load).option("checkpointLocation", f"{self.folder}/checkpoints/{table}").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.rows(table, schema)

    def deliver(self, graph: GraphCatalog, table: str, flush_files: int = 50) -> int:
        """Load all that waits for a table of a graph, and put the batches that the graph lacks into it; how many rows.

        Nodes are merged by key: a column that is null leaves what the table has, rows without a key are left out. The
        columns of relationships are the keys of the ends and then the properties; ends without a node get one that has
        nothing but its key. Columns stand in the table's order. A snapshot of the graph carries the number of the last
        batch, so a graph that is restored takes up where it was.
        """
        is_node = any(n.name.upper() == table.upper() for n in graph.nodes)
        t = graph.node(table) if is_node else graph.rel(table)
        order = t.props if is_node else ["_src", "_dst", *t.props]
        schema = T.StructType([T.StructField(c, t.df.schema[c].dataType) for c in order])
        self.run(table, schema, flush_files)
        last = graph.delivered.get(t.name.upper(), -1)
        numbered = self._batches(table, schema)
        if "batch" not in numbered.columns:
            return 0
        fresh = numbered.where(F.col(_BAD).isNull() & (F.col("batch") > last))
        ends = fresh.agg(F.max("batch"), F.count("*")).first()
        if not ends[1]:
            return 0
        rows = fresh.select(*[F.col(f"`{c}`") for c in order])
        if is_node:
            graph.bind(t.name, scratch_table(upsert(t.df, rows, t.key), f"table-{t.name.lower()}"))
        else:
            put_edges(graph, t.name, rows.where("_src IS NOT NULL AND _dst IS NOT NULL"), "create")
        graph.delivered[t.name.upper()] = ends[0]
        return ends[1]

    def _batches(self, table: str, schema: T.StructType) -> DataFrame:
        fs, at = _fs(self.spark, f"{self.folder}/batches/{table}")
        kept = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType()), T.StructField("_job", T.StringType())])
        if not fs.exists(at):
            return self.spark.createDataFrame([], kept)
        kept.add("batch", T.LongType())
        return self.spark.read.schema(kept).parquet(f"{self.folder}/batches/{table}")

    def rows(self, table: str, schema: T.StructType) -> DataFrame:
        return self._batches(table, schema).where(F.col(_BAD).isNull()).drop(_BAD, "_job", "batch")

    def jobs(self, schemas: dict[str, T.StructType]) -> DataFrame:
        """id, table, kind, status (pending, completed, failed), loaded, errors."""
        fs, at = _fs(self.spark, f"{self.folder}/jobs")
        if not fs.exists(at):
            return self.spark.createDataFrame([], "id string, table string, kind string, status string, loaded long, errors long")
        jobs = self.spark.read.schema(JOB).json(f"{self.folder}/jobs")
        done = None
        for table, schema in schemas.items():
            part = self._batches(table, schema).groupBy(F.col("_job").alias("id")).agg(F.count(F.when(F.col(_BAD).isNull(), 1)).alias("loaded"), F.count(_BAD).alias("errors"))
            done = part if done is None else done.unionByName(part)
        got = jobs.join(done, "id", "left")
        status = F.when(F.col("loaded").isNull(), "pending").when((F.col("loaded") == 0) & (F.col("errors") > 0), "failed").otherwise("completed")
        return got.select("id", "table", "kind", status.alias("status"), F.coalesce("loaded", F.lit(0)).alias("loaded"), F.coalesce("errors", F.lit(0)).alias("errors"))

    def clean(self, older_than: float) -> int:
        """Delete the files of jobs that were loaded more than so many seconds ago; how many."""
        fs, inbox = _fs(self.spark, f"{self.folder}/inbox")
        if not fs.exists(inbox):
            return 0
        gone, before = 0, (time.time() - older_than) * 1000
        for t in fs.listStatus(inbox):
            name = t.getPath().getName()
            _, marks = _fs(self.spark, f"{self.folder}/batches/{name}")
            if not fs.exists(marks):
                continue
            done = {r[0] for r in self.spark.read.parquet(f"{self.folder}/batches/{name}/batch=*").select("_job").distinct().collect()}
            for s in fs.listStatus(t.getPath()):
                if s.getModificationTime() < before and s.getPath().getName() in done:
                    gone += bool(fs.delete(s.getPath(), True))
        return gone


def to_json(job: dict) -> str:
    return json.dumps(job, sort_keys=True)
