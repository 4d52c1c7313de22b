import os

import pytest
from pyspark.sql import functions as F

from quartzite.llm import queries
from quartzite.llm.compaction import ShardStore, append_arrivals


def data(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 512).alias("text"), F.lit(None).cast("string").alias("shard_note"))


def test_appends_merges_and_versions(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", smallest=4_000, target=60_000)
    assert store.read() is None and store.version() == 0
    for k in range(9):
        store.append(data(spark, 200, 200 * k).coalesce(1), k)
        runs = store.runs()
        tiers = [r.tier for r in runs]
        assert all(tiers.count(t) < 4 for t in tiers)
        assert sorted(r.doc_id for r in store.read().collect()) == [*range(200 * (k + 1))]
        spans = sorted((r.first, r["last"]) for r in runs)
        assert spans[0][0] == 0 and spans[-1][1] == k and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert any(r.tier > 0 for r in runs) and store.read().select("shard").distinct().count() == sum(r.files for r in runs)


def test_old_versions_stay_readable_for_a_while(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", smallest=1_000_000, keep=3)
    for k in range(8):
        store.append(data(spark, 20, 20 * k).coalesce(1), k)
    last = store.version()
    assert last == 10  # eight arrivals, two merges
    rows = {v: store.read(v).count() for v in (last, last - 1, last - 2)}
    assert rows == {last: 160, last - 1: 160, last - 2: 140}
    named = {r.folder.split("/")[-1] for v in rows for r in store.runs(v)}
    assert {p.name for p in (tmp_path / "s/runs").iterdir()} == named
    assert sorted(int(p.name) for p in (tmp_path / "s/manifests").iterdir() if p.name.isdigit()) == sorted(rows)


def test_only_one_writer_commits_a_version(spark, tmp_path):
    store, other = (ShardStore(spark, f"file://{tmp_path}/s") for _ in range(2))
    version = store.append(data(spark, 5), 0)
    rows, theirs = ([r.asDict() for r in s.runs()] for s in (store, other))
    assert store._commit(rows, version) == version + 1
    with pytest.raises(RuntimeError):
        other._commit(theirs[:0], version)
    assert [r.asDict() for r in store.runs()] == rows


def test_a_writer_that_died_leaves_the_store_as_it_was(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    version = store.append(data(spark, 5), 0)
    half = tmp_path / f"s/manifests/{version + 1:08d}"
    half.write_text('{"run": "x"')
    assert store.version() == version and store.read().count() == 5
    with pytest.raises(RuntimeError):  # it may still be writing
        store.append(data(spark, 1), 1)
    os.utime(half, (0, 0))
    assert store.append(data(spark, 2), 1) == version + 2 and store.read().count() == 7


def test_arrivals_with_nulls_repeats_and_none(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", smallest=1_000)
    df = spark.createDataFrame([(1, "a", 9, 1), (1, "a", 9, 1), (None, None, 9, 1), (6, "", 9, 1), (40, "b", 9, 1)], "doc_id long, text string, arrival int, part int")
    append_arrivals(store, df, F.col("doc_id"))
    assert sorted((r.doc_id or -1, r.text or "", r.arrival, r.part) for r in store.read().collect()) == [(-1, "", -1, 1), (1, "a", 1, 1), (1, "a", 1, 1), (6, "", 6, 1), (40, "b", 40, 1)]
    empty = ShardStore(spark, f"file://{tmp_path}/e")
    assert append_arrivals(empty, df.limit(0), F.lit(0)) == 0 and empty.read() is None
    assert empty.read(like=df).columns == [*df.columns, "shard"] and empty.read(like=df).count() == 0


def test_query_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_compaction(spark, str(tmp_path))
    assert got.count() == 0 and got.columns == ["doc_id", "arrival", "n_bytes", "text_sha256"]
