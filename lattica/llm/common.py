"""What the operators share: scratch tables, worker set-up, sized broadcasts, text keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: A table of at most so many rows (of a few dozen bytes each) may be broadcast; beyond it the plan joins by shuffle.
BROADCAST_ROWS = 200_000


#: Rows that go to a Python worker at once, where the session does not say: rows here are whole texts.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Let Python workers that share this file system import the package (a cluster gets it by --py-files), and keep
    their batches small: the setting of 10,000 rows that a session begins with becomes 1,000."""
    if spark.conf.get(BATCH, "10000") == "10000":
        spark.conf.set(BATCH, "1000")
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])


def scratch(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where it is unset.

    Only a local master may leave it unset: on a cluster a folder of one machine is none that executors share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        base = "file://" + tempfile.mkdtemp(prefix="lattica-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: With this setting Spark deletes an execution's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Names of the folders that this thread's tables are in.
WRITTEN = threading.local()


def _written() -> list[str]:
    if not hasattr(WRITTEN, "names"):
        WRITTEN.names = []
    return WRITTEN.names


def table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df once as a Parquet table in the shared folder and read it back: cuts lineage, and survives lost executors.

    The shuffle files that only led to the table are deleted with the write.
    """
    spark = df.sparkSession
    path = f"{scratch(spark).rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    _written().append(path.rpartition("/")[2])
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """table() in as many buckets by key as a shuffle has: joins and groups by key then move the other side only.

    The catalogue keeps no entry: the DataFrame knows its files and buckets.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    path, before = f"{scratch(spark).rstrip('/')}/lattica/{own}", spark.conf.get(CLEAN, "false")
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    spark.conf.set(CLEAN, "true")
    try:
        writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).sortBy(key).saveAsTable(own)
    finally:
        spark.conf.set(CLEAN, before)
    _written().append(own)
    out = spark.table(own)
    spark.sql(f"DROP TABLE {own}")
    return out


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _folders(df: DataFrame) -> dict[str, str]:
    """The folders that df reads, by their names."""
    return {f.rpartition("/")[2]: f for f in {f.rpartition("/")[0] for f in df.inputFiles()}}


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the tables that table() wrote and df reads, once nothing reads them any more."""
    for name, folder in _folders(df).items():
        if name in _written():
            _delete(df.sparkSession, folder)
            _written().remove(name)


def tidy(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() returns; the tables that this thread wrote meanwhile and that the result does not read are deleted."""
    begun = len(_written())
    out = make()
    names = _folders(out)
    for name in _written()[begun:]:
        if name not in names:
            _delete(out.sparkSession, f"{scratch(out.sparkSession).rstrip('/')}/lattica/{name}")
    WRITTEN.names = [x for i, x in enumerate(_written()) if i < begun or x in names]
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether df is counted to be of at most so many rows."""
    return df.limit(rows + 1).count() <= rows


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is: the planner shuffles it."""
    return F.broadcast(df) if small(df, rows) else df


def give_back() -> None:
    """Return to the system what this process has freed: the allocators of C and Arrow keep it otherwise."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


def split_words(text: Column, apart: str) -> Column:
    """The runs of characters that are not in apart (ASCII), A-Z lowered; null has none. A letter for a letter and one
    split take a quarter of the time of a regular expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), upper + apart, upper.lower() + " " * len(apart)), " "), "")


def key128(*cols: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n
