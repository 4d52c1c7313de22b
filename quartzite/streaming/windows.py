"""Event-time panels on streams: tumbling windows that are written once, when the watermark has passed them, and late rows beside them.

Between batches only open windows are kept, as sums that a batch's sums are added to. A row is late if its window had
ended when the batch began: by the latest time of all batches before, less the delay. Late rows aren't lost: they are in
a table of their own, and counted. A batch is a version of the state; if it runs again it overwrites what it wrote.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quartzite.streaming.folders import Folder
from quartzite.streaming.keyed import KeyedTable


class Panel:
    """What is counted: rows by `keys` and window of `time`; sums beside the number of rows (`records`)."""

    def __init__(self, time: str, keys: dict[str, Column], sums: dict[str, Column] | None = None, width: str = "1 hour", delay: str = "10 minutes"):
        self.time, self.keys, self.sums, self.width, self.delay = time, keys, sums or {}, width, delay

    def windowed(self, rows: DataFrame) -> DataFrame:
        w = F.window(self.time, self.width)
        return rows.where(F.col(self.time).isNotNull()).withColumns({"window_start": w["start"], "window_end": w["end"]})

    def summed(self, windowed: DataFrame) -> DataFrame:
        return windowed.groupBy("window_start", "window_end", *(c.cast("string").alias(k) for k, c in self.keys.items())).agg(F.count(F.lit(1)).alias("records"), *(F.sum(c.cast("double")).alias(k) for k, c in self.sums.items()))

    def table(self, spark: SparkSession, root: str) -> KeyedTable:
        keys = "".join(f"{k} string, " for k in self.keys)
        sums = "".join(f", {k} double" for k in self.sums)
        return KeyedTable(spark, f"{root}/open", f"window_start timestamp, window_end timestamp, {keys}records bigint{sums}", ["window_start", "window_end", *self.keys], [F.col("window_start")])


def advance(rows: DataFrame, panel: Panel, root: str, stream: str, number: int) -> None:
    """One batch: late rows go to late/, windows that it closes to closed/, open ones stay in the state. Rows without a time are late."""
    spark = rows.sparkSession
    state = panel.table(spark, root)
    last = state.before()
    version = last["version"] + (0 if (last["note"] or {}).get("batch") == [stream, number] else 1)
    before = state.before(version)
    mark = F.lit((before["note"] or {}).get("watermark")).cast("timestamp")
    passed = lambda m: F.coalesce(F.col("window_end") <= m, F.lit(False))
    windowed = panel.windowed(rows).persist()
    try:
        late = rows.where(F.col(panel.time).isNull()).withColumns({c: F.lit(None).cast("timestamp") for c in ("window_start", "window_end")}).unionByName(windowed.where(passed(mark)))
        late.write.mode("overwrite").parquet(f"{root}/late/batch={version}")
        newest = windowed.agg((F.max(panel.time) - F.expr(f"INTERVAL {panel.delay}")).alias("m")).select(F.date_format(F.greatest("m", mark), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("m")).first().m
        now = F.lit(newest).cast("timestamp")
        fresh = panel.summed(windowed.where(~passed(mark)))
        open_now = state.rows_of(before)
        total = lambda d: d.groupBy(*state.keys).agg(*(F.sum(c).alias(c) for c in ("records", *panel.sums))).select(*open_now.columns)
        total(fresh.unionByName(open_now)).where(passed(now)).write.mode("overwrite").parquet(f"{root}/closed/batch={version}")
        # what closes is touched too, so that it leaves the state
        touching = fresh.withColumn("_new", F.lit(True)).unionByName(open_now.where(passed(now)).withColumn("_new", F.lit(False)))
        state.merge(touching, version, lambda b, c: total(b.where("_new").drop("_new").unionByName(c)).where(~passed(now)), {"batch": [stream, number], "watermark": newest})
    finally:
        windowed.unpersist()


def run_panel(stream: DataFrame, panel: Panel, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a stream of rows into a panel's tables under root."""

    def batch(df: DataFrame, number: int) -> None:
        advance(df, panel, root, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "", number)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def closed_windows(spark: SparkSession, panel: Panel, root: str) -> DataFrame:
    """The windows that are over: window_start, window_end, keys, records and sums. Each is there once."""
    table = panel.table(spark, root)
    names = ["window_start", "window_end", *panel.keys, "records", *panel.sums]
    return spark.read.schema(table.schema).parquet(f"{root}/closed").select(*names) if Folder(spark, root).exists("closed") else spark.createDataFrame([], table.schema)


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/late")


def log_volume_panel(width: str = "1 hour", delay: str = "10 minutes") -> Panel:
    """Records of each service."""
    return Panel("timestamp", {"service": F.col("service")}, width=width, delay=delay)


def log_level_panel(width: str = "1 hour", delay: str = "10 minutes") -> Panel:
    """Records of each level; of warnings and errors, if the stream has no others."""
    return Panel("timestamp", {"level": F.col("level")}, width=width, delay=delay)


def task_status_panel(width: str = "1 hour", delay: str = "10 minutes") -> Panel:
    """Tasks of each status by their start."""
    return Panel("started_at", {"status": F.col("status")}, width=width, delay=delay)


def task_duration_panel(width: str = "1 hour", delay: str = "10 minutes") -> Panel:
    """Finished tasks of each type by their start, with their seconds: mean_seconds is seconds / records."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1e6
    return Panel("started_at", {"task_type": F.col("task_type")}, {"seconds": seconds}, width, delay)
