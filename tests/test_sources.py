"""Sources that are read in parts: lines by splits, tables by ranges of keys, objects by folders."""

import datetime

import pytest
from pyspark.sql import functions as F

from quartzite.sources import readers as R
from quartzite.streaming import ingest as I


def test_line_numbers_whatever_the_splits(spark, tmp_path):
    lines = {f"cap{k}.tsv": [f"{k}-{i} " + "x" * (i % 97) for i in range(n)] for k, n in enumerate((4000, 1, 0, 2500))}
    for name, found in lines.items():
        (tmp_path / name).write_text("\n".join(found))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("64k", "10m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = R.numbered_lines(spark, f"file://{tmp_path}/*.tsv")
            got = {}
            for r in df.collect():
                got.setdefault(r.path.rpartition("/")[2], {})[r.line_no] = r.value
            assert got == {name: dict(enumerate(found, 1)) for name, found in lines.items() if found}
            assert size == "10m" or spark.read.text(f"file://{tmp_path}/*.tsv").rdd.getNumPartitions() > 4
            fields = R.read_packet_fields(spark, f"file://{tmp_path}/*.tsv")
            assert {(r.capture_id, r.packet_no) for r in fields.select("capture_id", "packet_no").collect()} == {(name[:-4], i) for name, found in lines.items() for i in range(1, len(found) + 1)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranges_of_keys_have_every_row_once(spark):
    df = spark.range(-20, 120).select(F.when(F.col("id") % 10 != 3, F.col("id")).alias("k"))
    for lower, upper, parts in ((0, 99, 7), (0, 0, 4), (5, 9, 50), (0, 99, 1)):
        predicates = R.key_ranges("k", lower, upper, parts)
        assert len(predicates) <= parts
        assert {r.n for r in df.select(sum(F.coalesce(F.expr(p), F.lit(False)).cast("int") for p in predicates).alias("n")).distinct().collect()} == {1}
    with pytest.raises(ValueError):
        R.key_ranges("k", 5, 1, 3)
    with pytest.raises(ValueError, match="may not be read"):
        R.load_jdbc(spark, "jdbc:none", "reviews", ["id", "author_name"])


def test_objects_of_many_folders_and_what_becomes_of_their_captures(spark, tmp_path):
    keys = [f"p{k % 40}/q{k % 3}/o{k}" for k in range(10_000)] + ["top"]
    for k, key in enumerate(keys):
        path = tmp_path / "objects" / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (k % 5))
    objects = R.list_objects(spark, f"file://{tmp_path}/objects")
    assert {(r.object_key, r["size"]) for r in objects.collect()} == {(key, k % 5) for k, key in enumerate(keys)}
    assert {r.object_key for r in R.list_objects(spark, f"file://{tmp_path}/objects", depth=2).collect()} == set(keys)
    assert R.list_objects(spark, f"file://{tmp_path}/nothing").collect() == []
    now = datetime.datetime(2024, 1, 2)
    rows = [(f"c{k}", "pending_upload", key, k % 5 + (k % 7 == 0), now) for k, key in enumerate(keys)] + [("lost", "pending_upload", "p1/none", 1, now)]
    captures = spark.createDataFrame(rows, "id string, status string, object_key string, capture_size_bytes long, expires_at timestamp").withColumn("analysis_started_at", F.lit(None).cast("timestamp"))
    got = {r.id: (r.new_status, r.change_reason) for r in I.reconcile(captures, objects, F.lit(now), 60).collect()}
    assert got["lost"] == ("expired", "object_missing") and got["c7"] == ("expired", "object_size_mismatch") and got["c8"] == ("uploaded", None)
    assert sum(v[0] == "uploaded" for v in got.values()) == sum(k % 7 != 0 for k in range(len(keys)))
    done = captures.withColumn("status", F.when(F.col("id") == "c8", "analyzed").otherwise("uploaded"))
    assert [r.object_key for r in I.cleanable(done).join(objects, "object_key").collect()] == [keys[8]]


def test_release_manifests_and_logs(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"schema_version": 1, "release_events": [{"release_event_id": "r1", "release_date": "2024-01-15", "release_date_verified": true}]}')
    (tmp_path / "l.json").write_text('{"timestamp": "2024-01-01T00:00:00Z", "level": "error", "service": "s", "duration_seconds": 1.5}\n{"level": "info"}\n')
    (row,) = R.read_release_manifest(spark, f"file://{tmp_path}/r.json").collect()
    assert str(row.release_date) == "2024-01-15" and row.release_date_verified is True and row.notes is None
    assert R.read_release_manifest(spark, None).count() == 0
    logs = R.read_logs(spark, f"file://{tmp_path}/l.json")
    assert [(r.level, r.duration_seconds) for r in logs.collect()] == [("error", 1.5), ("info", None)]
    assert R.read_logs(spark, f"file://{tmp_path}/l*.json", stream=True).isStreaming
    spark.range(3).selectExpr("id", "'n' as name", "'secret' as token").write.parquet(f"file://{tmp_path}/t")
    assert R.load_table(spark, f"file://{tmp_path}/t", "applications").columns == ["id", "name"]
