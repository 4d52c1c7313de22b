"""A store of immutable shards with size-tiered compaction, by DataFrame operations only.

Arrivals are appended as runs of small Parquet files. Runs of about the same size (one tier: sizes within a factor of
`fanout`) are merged once there are `fanout` of them, into files of about the target size, so each row is written again
a logarithmic number of times. Every append and merge is committed by a new manifest: one file, named by its version and
created without overwriting, so of two writers one fails. (File systems that create a file only if it isn't there, as
HDFS does, settle the race; on others writers need a lock.) A manifest counts once its last line is there. Readers take
the files that the highest version names. The last `keep` versions stay readable: what only older ones name is removed.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Runs of a tier that are merged together; bytes of the smallest tier, and of a file of a merged run.
FANOUT, SMALLEST, TARGET = 4, 1 << 20, 128 << 20
#: Versions that stay readable; seconds after which a manifest without its last line is a dead writer's.
KEEP, STALE = 4, 600
_END = "end"


class ShardStore:
    """One store in one folder. Null columns, repeated rows and empty arrivals are kept as they come."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT, smallest: int = SMALLEST, target: int = TARGET, keep: int = KEEP):
        self.spark, self.root, self.fanout, self.smallest, self.target, self.keep = spark, root.rstrip("/"), fanout, smallest, target, max(1, keep)
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(self.path(f"{self.root}/manifests"))

    def _manifest(self, version: int):
        return self.path(f"{self.root}/manifests/{version:08d}")

    def _lines(self, version: int) -> list[str]:
        source = self.fs.open(self._manifest(version))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").split("\n")
        finally:
            source.close()

    def _versions(self) -> list[int]:
        """Numbers of all manifests, finished or not, the latest first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/manifests"))]
        return sorted((int(n) for n in names if n.isdigit()), reverse=True)

    def version(self) -> int:
        """The number of the last finished manifest; 0 without any."""
        return next((v for v in self._versions() if self._lines(v)[-1] == _END), 0)

    def runs(self, version: int | None = None) -> list[Row]:
        """The manifest's rows: run, folder, tier, bytes, files, first and last arrival. One row for each live run."""
        version = self.version() if version is None else version
        rows = [Row(**json.loads(x)) for x in self._lines(version)[:-1]] if version else []
        return sorted(rows, key=lambda r: (r.first, r.run))

    def tier(self, size: int) -> int:
        return 0 if size <= self.smallest else int(math.log(size / self.smallest, self.fanout)) + 1

    def _described(self, run: str, folder: str, first: int, last: int) -> dict:
        files = [s.getLen() for s in self.fs.listStatus(self.path(folder)) if s.getPath().getName().endswith(".parquet")]
        return {"run": run, "folder": folder, "tier": self.tier(sum(files)), "bytes": sum(files), "files": len(files), "first": first, "last": last}

    def _commit(self, rows: list[dict], version: int) -> int:
        """Makes rows the manifest after `version`, if no other writer has."""
        last, new = max(self._versions(), default=0), version + 1
        if last > version and self.version() == version and time.time() - self.fs.getFileStatus(self._manifest(last)).getModificationTime() / 1000 > STALE:
            new = last + 1  # a writer died over the manifests in between
        try:
            out = self.fs.create(self._manifest(new), False)
        except Exception as error:
            raise RuntimeError(f"version {new} was committed by another writer") from error
        out.write(bytearray("".join(json.dumps(r) + "\n" for r in rows) + _END, "utf-8"))
        out.close()
        self._forget(new)
        return new

    def _forget(self, version: int) -> None:
        """Removes versions that are `keep` or more behind, and the runs that only they name."""
        known = [v for v in self._versions() if v <= version]
        live = {r.folder for v in known[: self.keep] if self._lines(v)[-1] == _END for r in self.runs(v)}
        for v in reversed(known[self.keep :]):
            for r in self.runs(v) if self._lines(v)[-1] == _END else []:
                if r.folder not in live:
                    self.fs.delete(self.path(r.folder), True)
            self.fs.delete(self._manifest(v), False)

    def adopt(self, folder: str, arrival: int) -> int:
        """Appends a written folder of small files as the run of one arrival; then merges what is due."""
        version = self.version()
        rows = [r.asDict() for r in self.runs(version)]
        version = self._commit([*rows, self._described(uuid.uuid4().hex, folder, arrival, arrival)], version)
        return self.compact(version)

    def append(self, df: DataFrame, arrival: int) -> int:
        """Writes df as the run of one arrival and appends it; returns the version."""
        folder = f"{self.root}/runs/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return self.adopt(folder, arrival)

    def compact(self, version: int) -> int:
        """Merges tiers that have `fanout` runs, the smallest tier first, until none has."""
        while True:
            rows = [r.asDict() for r in self.runs(version)]
            tiers: dict[int, list] = {}
            for r in rows:
                tiers.setdefault(r["tier"], []).append(r)
            due = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if due is None:
                return version
            folder = f"{self.root}/runs/{uuid.uuid4().hex}"
            size = sum(r["bytes"] for r in due)
            merged = self.spark.read.parquet(*[r["folder"] for r in due])
            merged.coalesce(max(1, -(-size // self.target))).write.parquet(folder)
            new = self._described(uuid.uuid4().hex, folder, min(r["first"] for r in due), max(r["last"] for r in due))
            new["tier"] = max(new["tier"], due[0]["tier"] + 1)  # merging never leaves a run where it was
            gone = {r["run"] for r in due}
            version = self._commit([*(r for r in rows if r["run"] not in gone), new], version)

    def read(self, version: int | None = None, like: DataFrame | None = None) -> DataFrame | None:
        """All rows of a version, with the shard (file) that each is in. An empty store has no rows of like's columns; without like, None."""
        runs = self.runs(version)
        if not runs:
            return None if like is None else like.limit(0).withColumn("shard", F.lit(None).cast("string"))
        return self.spark.read.parquet(*[r.folder for r in runs]).withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1))


def append_arrivals(store: ShardStore, df: DataFrame, arrival: Column) -> int:
    """Deals df by `arrival`, a whole number, and appends its arrivals in ascending order; one scan of df writes all of them.

    Rows without an arrival are arrival -1. df must not have a column named arrival of another meaning: it is replaced.
    No rows, no arrivals. Returns the store's last version.
    """
    staged, part = f"{store.root}/staged-{uuid.uuid4().hex}", "_arrival_part"
    df.withColumn("arrival", F.coalesce(arrival.cast("int"), F.lit(-1))).withColumn(part, F.col("arrival")).write.partitionBy(part).parquet(staged)
    folders = [str(s.getPath().getName()) for s in store.fs.listStatus(store.path(staged))]
    version = store.version()
    for k in sorted(int(f.split("=")[1]) for f in folders if f.startswith(f"{part}=")):
        version = store.adopt(f"{staged}/{part}={k}", k)
    return version
