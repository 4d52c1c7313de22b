"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import hashlib
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a task holds as Python objects at a time.
GROUP_CHARS = 1_000_000
#: Rows of an Arrow batch between the JVM and Python; long texts make a batch of more rows large.
ROWS_PER_BATCH = 1_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session, of one machine
    alone, gets a temporary one; on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="quartzite-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows of an Arrow batch, as texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > ROWS_PER_BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder: its lineage ends there, and a lost executor costs nothing but a reread."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table that written() gave, when all that is made of it is a table of its own."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_kept: dict = {}


def _stage() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def begin_task() -> None:
    """To be called when a task begins. In the first of a stage in a Python worker, what earlier stages kept there is dropped."""
    stage = _stage()
    if _kept.get("stage", "") == stage:
        return
    _kept.clear()
    _kept["stage"] = stage
    give_back()


def give_back() -> None:
    """Returns free memory to the system: a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def stage_state(key: tuple, make: Callable):
    """What make() gives, made once for each Python worker and stage: a worker holds one such thing, not those of stages before."""
    begin_task()
    if _kept.get("key") != key:
        _kept.update(key=key, value=make())
    return _kept["value"]


def row_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of the batches of about GROUP_CHARS characters, with the column's values; longer single values stand alone."""
    begin_task()
    for batch in batches:
        col = batch.column(column)
        start, held, values = 0, 0, []
        for i in range(batch.num_rows):
            v = col[i].as_py()
            n = len(v) if v is not None else 0
            if values and held + n > GROUP_CHARS:
                yield batch.slice(start, len(values)), values
                start, held, values = i, 0, []
            values.append(v)
            held += n
        if values:
            yield batch.slice(start, len(values)), values
    give_back()


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (id, component), component being the smallest id that is reached.

    Large-star and small-star rounds: each replaces a node's links by links to the smallest neighbour, so a round
    moves at most the links there are, and long chains halve. A node with very many links costs one aggregated row
    for each map task, never a gathered group. Only ids that occur in a link are returned; each round is written to
    the shared folder, so a lost executor does not undo the rounds before.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        # large-star: for each node, its larger neighbours are linked to its smallest neighbour (itself included)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small-star: for each node, its smaller neighbours and itself are linked to the smallest
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
