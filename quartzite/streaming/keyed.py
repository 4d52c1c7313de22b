"""State that grows with its keys, not with the batches that made it: tables in hash buckets, and claims of events.

A batch reads and rewrites only the buckets that its keys fall in. What a bucket was before stays until the new version
is committed by one small file, and a while longer; so readers see whole versions, and a batch that runs again begins
from the version before it, whatever it left behind.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.streaming.folders import Folder

#: Rows of a bucket beyond which the number of buckets doubles, and versions that stay readable.
BUCKET_ROWS, KEEP = 1_000_000, 3
#: Offsets of a topic's partition that share a bucket: a batch of consecutive offsets falls in few.
PLACES = 65_536


class KeyedTable:
    """A table with one row for each key, in versions with ascending numbers.

    No column is named bucket. The driver holds the list of buckets: a line for each million rows.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: Sequence[str], spread: Sequence[Column] | None = None, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.schema, self.keys, self.bucket_rows = spark, root.rstrip("/"), schema, list(keys), bucket_rows
        self.spread = list(spread or map(F.col, keys))
        self.notes = Folder(spark, f"{self.root}/versions")

    def versions(self) -> list[int]:
        return sorted(int(n) for n in self.notes.names())

    def manifest(self, version: int) -> dict:
        return json.loads(self.notes.text(f"{version:012d}"))

    def before(self, version: int | None = None) -> dict:
        """The manifest of the last version below one, or of the last at all; an empty table's without any."""
        known = [v for v in self.versions() if version is None or v < version]
        return self.manifest(known[-1]) if known else {"version": -1, "buckets": 1, "files": {}, "note": None}

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last by default."""
        return self.rows_of(self.manifest(version) if version is not None else self.before())

    def rows_of(self, manifest: dict, buckets: Sequence[str] | None = None) -> DataFrame:
        """The rows that a manifest names, of all buckets or some."""
        files = [f for b, (f, _) in manifest["files"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*files) if files else self.spark.createDataFrame([], self.schema)

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.spread), F.lit(n)).cast("int")

    def _touched(self, batch: DataFrame, manifest: dict) -> dict[str, int]:
        """The batch's rows in each bucket that it touches: a row for each bucket comes to the driver."""
        return {str(r.b): r.n for r in batch.groupBy(self._bucket(manifest["buckets"]).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def slice(self, batch: DataFrame, version: int | None = None) -> DataFrame:
        """The rows, as they were before a version, of the buckets that a batch's keys fall in."""
        manifest = self.before(version)
        return self.rows_of(manifest, set(self._touched(batch, manifest)))

    def merge(self, batch: DataFrame, version: int, how: Callable[[DataFrame, DataFrame], DataFrame], note: dict | None = None) -> None:
        """Commits a version: how(batch, rows of the touched buckets) gives those buckets' new rows.

        It begins from the last version below this one; if this version is there already, it is replaced.
        """
        old = self.before(version)
        touched = self._touched(batch, old)
        n, rows = old["buckets"], sum(k for _, k in old["files"].values()) + sum(touched.values())
        while rows > n * self.bucket_rows:
            n *= 2
        if n != old["buckets"]:
            touched = dict.fromkeys(old["files"], 0) | touched
        kept = {b: f for b, f in old["files"].items() if b not in touched and n == old["buckets"]}
        files = dict(kept)
        if touched:
            folder = f"{self.root}/data/{version:012d}-{uuid.uuid4().hex[:8]}"
            new = how(batch, self.rows_of(old, set(touched)))
            new.withColumn("bucket", self._bucket(n)).repartition("bucket").write.partitionBy("bucket").parquet(folder)
            written = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder)
            files |= {str(r.bucket): (f"{folder}/bucket={r.bucket}", r.n) for r in written.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        text = json.dumps({"version": version, "buckets": n, "files": files, "note": note})
        name = f"{version:012d}"
        if self.notes.exists(name):
            self.notes.remove(name)
        if not self.notes.create(name, text):
            raise RuntimeError(f"{self.root}: another writer committed version {version}")
        self._forget()

    def _forget(self) -> None:
        """Removes versions that are KEEP or more behind, and the files that only they name."""
        known = self.versions()
        gone, live = known[:-KEEP], {f for v in known[-KEEP:] for f, _ in self.manifest(v)["files"].values()}
        for v in gone:
            for f, _ in self.manifest(v)["files"].values():
                if f not in live:
                    Folder(self.spark, f.rpartition("/")[0]).remove(f.rpartition("/")[2])
            self.notes.remove(f"{v:012d}")


def insert_new(batch: DataFrame, current: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of current, and those of a batch whose key isn't there, one for each: for merge()."""
    fresh = batch.dropDuplicates(list(keys)).join(current.select(*keys), list(keys), "left_anti")
    return current.unionByName(fresh.select(*current.columns))


class Claims:
    """Which events have been taken, by id and by place (topic, partition, offset), with work that follows the batch.

    Each batch of a stream is a version; the same batch of the same stream is the same version again, and what it claimed
    itself the first time doesn't count against it. A stream with a new checkpoint goes on behind the last version.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS):
        self.ids = KeyedTable(spark, f"{root}/ids", "event_id string", ["event_id"], bucket_rows=bucket_rows)
        block = F.floor(F.col("offset") / PLACES)
        self.places = KeyedTable(spark, f"{root}/places", "topic string, partition int, offset bigint", ["topic", "partition", "offset"], [F.col("topic"), F.col("partition"), block], bucket_rows)

    def version(self, stream: str, number: int) -> int:
        """The version of a stream's batch: the last one, if the batch has come so far before, else the next."""
        last = self.ids.before()
        if last["note"] == {"stream": stream, "batch": number}:
            return last["version"]
        if number > 0 and last["version"] < 0:
            raise RuntimeError(f"{self.ids.root}: the claims of batches before {number} are gone")
        return last["version"] + 1

    def fresh(self, events: DataFrame, version: int) -> DataFrame:
        """Events that no batch before has claimed, neither by id nor by place; of equals within the batch the first place."""
        place = ["topic", "partition", "offset"]
        first = lambda d, keys: d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*place))).where("_k = 1").drop("_k")
        new = events.join(self.ids.slice(events, version), "event_id", "left_anti").join(self.places.slice(events, version), place, "left_anti")
        return first(first(new, place), ["event_id"]).select(*events.columns)

    def commit(self, fresh: DataFrame, version: int, stream: str, number: int) -> None:
        """Claims events for good. The ids are written last: they say that the batch is over."""
        add = lambda b, c: c.unionByName(b)
        self.places.merge(fresh.select("topic", "partition", "offset"), version, add)
        self.ids.merge(fresh.select("event_id"), version, add, {"stream": stream, "batch": number})
