"""Topics in files: messages are published in batches that count as a whole, and read as a stream by partition and offset.

A log is a folder. data/<batch>/ has the messages as Parquet, commits/<number> what counts: each file's topic, partition,
first offset and number of messages, and where every partition ends. Writers stage files first and commit them by one
small file that is there whole or not at all; what isn't committed isn't seen. Streams name a start for each partition
(earliest, latest or an offset), take at most so many messages a trigger, and fail where offsets are missing.

The source runs in Python workers, so the folder must be one that pyarrow opens by its address (file, hdfs, s3, gs).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from quartzite.streaming.folders import Folder

SCHEMA = "key binary, value binary, topic string, partition int, offset bigint"
#: Messages of an Arrow batch between source and Spark.
ROWS = 1_000


def publish(messages: DataFrame, root: str, batch: str, partitions: int = 3) -> bool:
    """Publishes messages (key, value, topic) as one batch; False if a batch of this name is there already.

    A key's messages go to one partition, null keys to any by their value; within a partition a batch's messages are in
    the order of `at`, if there is such a column, and of key and value. A file's messages stay together.
    """
    spark = messages.sparkSession
    commits = Folder(spark, f"{root}/commits")
    if _committed(commits, batch):
        return False
    order = ["at", "key", "value"] if "at" in messages.columns else ["key", "value"]
    staged = f"{root}/data/{batch}"
    dealt = messages.withColumn("partition", F.pmod(F.xxhash64(F.coalesce("key", "value")), F.lit(partitions)).cast("int"))
    columns = [F.col("topic").alias("_topic"), F.col("partition").alias("_partition"), *order]
    dealt.select(*columns).repartitionByRange("_topic", "_partition", *order).sortWithinPartitions("_topic", "_partition", *order).write.mode("overwrite").partitionBy("_topic", "_partition").parquet(staged)
    found = spark.read.schema("key binary, value binary, _topic string, _partition int").parquet(staged)
    # files of a partition in the order of their tasks, which is that of their messages
    files = sorted((r["_topic"], r["_partition"], r.name, r.n) for r in found.groupBy("_topic", "_partition", F.col("_metadata.file_path").alias("name")).agg(F.count(F.lit(1)).alias("n")).collect())
    while True:
        known = commits.names()
        last = json.loads(commits.text(known[-1])) if known else {"number": -1, "ends": {}}
        if any(json.loads(commits.text(n))["batch"] == batch for n in known[-1:]):
            return False
        ends, segments = {t: dict(p) for t, p in last["ends"].items()}, []
        for topic, part, name, n in files:
            first = ends.setdefault(topic, {}).get(str(part), 0)
            segments.append({"topic": topic, "partition": part, "first": first, "n": n, "file": name})
            ends[topic][str(part)] = first + n
        number = last["number"] + 1
        if commits.create(f"{number:012d}", json.dumps({"number": number, "batch": batch, "ends": ends, "segments": segments})):
            return True


def _committed(commits: Folder, batch: str) -> bool:
    return any(json.loads(commits.text(n))["batch"] == batch for n in reversed(commits.names()))


def expire(spark: SparkSession, root: str, keep: int) -> None:
    """Removes all but the last `keep` commits with their messages: streams that still need them fail."""
    commits = Folder(spark, f"{root}/commits")
    for name in commits.names()[:-keep] if keep else commits.names():
        batch = json.loads(commits.text(name))["batch"]
        commits.remove(name)
        Folder(spark, f"{root}/data").remove(batch)


class _Log:
    """What is committed, as Python workers see it."""

    def __init__(self, root: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(root)
        self.known: dict[str, dict] = {}

    def commits(self) -> list[dict]:
        """All commits, the last one first; each is read once."""
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.path}/commits", allow_not_found=True))
        names = sorted((f.base_name for f in found if f.base_name[0] not in "._"), reverse=True)
        for name in names:
            if name not in self.known:
                with self.fs.open_input_stream(f"{self.path}/commits/{name}") as f:
                    self.known[name] = json.loads(f.read())
        self.known = {n: self.known[n] for n in names}
        return list(self.known.values())


class _Segment(InputPartition):
    def __init__(self, topic: str, partition: int, first: int, start: int, end: int, n: int, file: str):
        self.topic, self.partition, self.first, self.start, self.end, self.n, self.file = topic, partition, first, start, end, n, file


class _Reader(DataSourceStreamReader):
    """Offsets are {topic: {partition: next offset}}.

    The engine doesn't tell where it stands when it asks how far to go; so with a bound, each plan's end is noted under the
    group's name, and the next bound counts from there. A plan is noted again when its batch runs again.
    """

    def __init__(self, options):
        self.log, self.starting = _Log(options["path"]), options.get("startingoffsets", "earliest")
        self.topics, self.most, self.group = options["subscribe"].split(","), int(options.get("maxoffsetspertrigger", 0)), options.get("group")
        if self.most and not self.group:
            raise ValueError("maxOffsetsPerTrigger needs a group, under which the stream's position is noted")
        self.at: dict | None = None

    def _ends(self) -> dict:
        last = self.log.commits()[:1]
        ends = last[0]["ends"] if last else {}
        return {t: dict(ends.get(t, {})) for t in self.topics}

    def _begins(self) -> dict:
        """The first offset of each partition that is still there."""
        out: dict = {}
        for c in self.log.commits():
            for s in c["segments"]:
                at = out.setdefault(s["topic"], {})
                at[str(s["partition"])] = min(s["first"], at.get(str(s["partition"]), s["first"]))
        return {t: out.get(t, {}) for t in self.topics}

    def initialOffset(self) -> dict:
        if self.starting == "latest":
            start = self._ends()
        else:
            begins, ends = self._begins(), self._ends()
            start = {t: {p: begins[t].get(p, e) for p, e in at.items()} for t, at in ends.items()}
            if self.starting != "earliest":
                for t, at in json.loads(self.starting).items():
                    for p, o in at.items():
                        start[t][p] = {-2: start[t].get(p, 0), -1: ends[t].get(p, 0)}.get(o, o)
        return start

    def _note(self) -> str:
        return f"{self.log.path}/groups/{self.group}"

    def latestOffset(self) -> dict:
        ends = self._ends()
        if not self.most:
            return ends
        if self.at is None and self.log.fs.get_file_info(self._note()).is_file:
            with self.log.fs.open_input_stream(self._note()) as f:
                self.at = json.loads(f.read())
        if self.at is None:
            self.at = self.initialOffset()
        left = self.most
        waiting = [(t, p) for t, at in ends.items() for p in at]
        out = {t: {p: self.at.get(t, {}).get(p, 0) for p in at} for t, at in ends.items()}
        # an even share for each partition, what some don't need for the others
        while left and (short := [(t, p) for t, p in waiting if out[t][p] < ends[t][p]]):
            share = max(1, left // len(short))
            for t, p in short:
                more = min(share, left, ends[t][p] - out[t][p])
                out[t][p] += more
                left -= more
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.most:
            self.at = end
            self.log.fs.create_dir(f"{self.log.path}/groups")
            with self.log.fs.open_output_stream(self._note()) as f:
                f.write(json.dumps(end).encode())
        # a partition that appeared since the start is read from its beginning
        wanted = {(t, p): (start.get(t, {}).get(p, 0), e) for t, at in end.items() for p, e in at.items()}
        out = []
        for c in self.log.commits():
            for s in c["segments"]:
                a, b = wanted.get((s["topic"], str(s["partition"])), (0, 0))
                a, b = max(a, s["first"]), min(b, s["first"] + s["n"])
                if a < b:
                    out.append(_Segment(s["topic"], s["partition"], s["first"], a, b, s["n"], s["file"]))
        for (t, p), (a, b) in wanted.items():
            there = sum(x.end - x.start for x in out if (x.topic, str(x.partition)) == (t, p))
            if there != max(0, b - a):
                raise ValueError(f"{t}, partition {p}: {b - a - there} of the messages from offset {a} to {b} are gone")
        return out

    def read(self, partition: _Segment) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(partition.file)
        at = partition.first
        with fs.open_input_file(path) as f:
            file = pyarrow.parquet.ParquetFile(f)
            if file.metadata.num_rows != partition.n:
                raise ValueError(f"{partition.file} has {file.metadata.num_rows} messages, not {partition.n}")
            for batch in file.iter_batches(ROWS, columns=["key", "value"]):
                a, b = max(partition.start - at, 0), min(partition.end - at, batch.num_rows)
                if a < b:
                    n, cut = b - a, batch.slice(a, b - a)
                    columns = [cut.column("key").cast(pa.binary()), cut.column("value").cast(pa.binary()), pa.array([partition.topic] * n, pa.string()), pa.array([partition.partition] * n, pa.int32()), pa.array(range(at + a, at + b), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["key", "value", "topic", "partition", "offset"])
                at += batch.num_rows


class EventLog(DataSource):
    """spark.readStream.format("event_log") with path, subscribe, startingOffsets, maxOffsetsPerTrigger and group."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_log(spark: SparkSession, root: str, topics: Sequence[str], starting: str | dict = "earliest", most: int | None = None, group: str | None = None) -> DataFrame:
    """A stream of a log's messages: key, value, topic, partition, offset. Offsets live in the checkpoint; options as read_events has them."""
    from quartzite.sources.readers import offset_options

    spark.dataSource.register(EventLog)
    reader = spark.readStream.format("event_log").option("path", root).options(**offset_options(topics, starting, most))
    return (reader.option("group", group) if group else reader).load()
