"""Event source, claims and states over many batches, restarts and failures."""

import json

import pytest
from pyspark.sql import functions as F

from quartzite.sources import event_log, readers, sinks
from quartzite.streaming import ingest as I
from quartzite.streaming.folders import Folder
from quartzite.streaming.keyed import Claims, KeyedTable, insert_new

UUID = "00000000-0000-4000-8000-{:012d}"
REVIEW, TOPIC = "playstore.review.observed", "playstore.review-observed.v1"
REVIEWS = "crawl_task_id string, application_id string, package_name string, observed_at timestamp, position int, external_review_id string, source_at timestamp, author_name string, thumbs_up_count long, score int, content string, source_adapter string"


def reviews(spark, rows):
    """(number, application, review, day, content) as observed reviews."""
    made = [(UUID.format(n), UUID.format(a), "com.a.b", f"2024-01-{day:02d}", 1, r, f"2024-01-{day:02d}", "", 0, 3, content, "x") for n, a, r, day, content in rows]
    df = spark.createDataFrame(made, REVIEWS.replace("timestamp", "string"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("observed_at", "source_at")})


def publish(spark, root, name, rows, partitions=3):
    return event_log.publish(sinks.enveloped(reviews(spark, rows), REVIEW, TOPIC, "observed_at"), root, name, partitions)


def contents(spark, root):
    return sorted(r.content for r in spark.read.parquet(f"{root}/review_observed").collect())


def test_published_batches_come_back_once_through_restarts(spark, tmp_path):
    log, root, ck = f"file://{tmp_path}/log", f"file://{tmp_path}/out", f"file://{tmp_path}/ck"
    assert publish(spark, log, "one", [(k, k % 4, f"r{k}", 1 + k % 9, f"c{k}") for k in range(40)])
    assert not publish(spark, log, "one", [(99, 1, "r", 1, "never")])  # the batch is there already
    reviews(spark, [(77, 1, "r", 1, "staged only")]).write.parquet(f"{log}/data/half")
    run = lambda: I.run_ingest(event_log.read_log(spark, log, [TOPIC], most=15, group="g"), root, ck).awaitTermination()
    run()
    first = contents(spark, root)
    assert len(first) == 15  # the bound of a trigger
    run()
    run()
    assert contents(spark, root) == sorted(f"c{k}" for k in range(40))
    publish(spark, log, "two", [(k, k % 4, f"r{k}", 1 + k % 9, f"c{k}") for k in range(35, 50)])  # five of them are known events
    run()
    run()
    assert contents(spark, root) == sorted(f"c{k}" for k in range(50))
    ledger = spark.read.parquet(f"{root}/ledger")
    assert ledger.count() == 50 and ledger.where("schema_version = 1 and ingested_at is not null").count() == 50
    assert spark.read.parquet(f"{root}/quarantine").count() == 0
    # the states are what all batches make of one table
    want = sorted((r.application_id, r.external_review_id, r.content, r.first_observed_at) for r in I.current_reviews(spark.read.parquet(f"{root}/review_observed")).collect())
    assert sorted((r.application_id, r.external_review_id, r.content, r.first_observed_at) for r in I.review_state(spark, root).read().collect()) == want
    assert I.observation_state(spark, root).read().count() == 50
    # a new checkpoint reads everything again, and nothing counts twice
    I.run_ingest(event_log.read_log(spark, log, [TOPIC]), root, f"file://{tmp_path}/other").awaitTermination()
    assert contents(spark, root) == sorted(f"c{k}" for k in range(50))


def test_starts_and_gaps(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    for name in ("a", "b"):
        publish(spark, log, name, [(k, 0, f"{name}{k}", 1, f"{name}{k}") for k in range(6)], partitions=1)
    query = lambda ck, starting, **more: event_log.read_log(spark, log, [TOPIC], starting, **more).writeStream.trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/{ck}")

    def offsets(ck, starting):
        found = []
        query(ck, starting).foreachBatch(lambda df, _: found.extend(r.offset for r in df.collect())).start().awaitTermination()
        return sorted(found)

    assert offsets("earliest", "earliest") == [*range(12)] and offsets("at", {TOPIC: {0: 7}}) == [*range(7, 12)]
    assert offsets("latest", "latest") == []
    publish(spark, log, "c", [(k, 0, f"c{k}", 1, "x") for k in range(3)], partitions=1)
    assert offsets("latest", "latest") == [12, 13, 14]
    event_log.expire(spark, log, 1)
    assert offsets("now", "earliest") == [12, 13, 14]
    with pytest.raises(Exception, match="5 of the messages from offset 7 to 15 are gone"):
        offsets("lost", {TOPIC: {0: 7}})
    assert readers.offset_options(["x", "y"], {"x": {0: 5}}, 100) == {"subscribe": "x,y", "startingOffsets": '{"x": {"0": 5}}', "failOnDataLoss": "true", "maxOffsetsPerTrigger": "100"}
    with pytest.raises(ValueError):
        readers.offset_options(["x"], "yesterday")


def test_claims_of_many_batches_read_what_a_batch_touches(spark, tmp_path):
    root, seen = f"file://{tmp_path}/claims", set()
    schema = "event_id string, topic string, partition int, offset long"
    for b in range(20):
        ids = [*range(b * 8, b * 8 + 8), max(0, b * 8 - 5)]  # the last is an event of an earlier batch at a new place
        rows = [(f"e{i}", "t", 0, b * 10 + k) for k, i in enumerate(ids)] + [("other", "t", 0, max(0, b * 10 - 7))] * (b > 0)
        claims = Claims(spark, root, bucket_rows=40)  # as after a restart
        version, batch = claims.version("s", b), spark.createDataFrame(rows, schema).coalesce(1)
        want = {f"e{i}" for i in ids} - seen
        if b % 6 == 1:
            assert {r.event_id for r in claims.fresh(batch, version).collect()} == want, b
        new = [r for k, r in enumerate(rows) if r[0] in want and r[0] not in {x[0] for x in rows[:k]}]
        claims.commit(spark.createDataFrame(new, schema).coalesce(1), version, "s", b)
        if b % 12 == 1:  # the batch runs again after its claims were written
            again = Claims(spark, root)
            assert again.version("s", b) == version and {r.event_id for r in again.fresh(batch, version).collect()} == want
        seen |= want
    assert claims.ids.read().count() == len(seen) and len(claims.ids.versions()) <= 3
    assert claims.ids.before()["buckets"] >= 4
    # one event touches one bucket's file, whatever the number of batches was
    one = batch.limit(1)
    assert len(claims.ids.slice(one).inputFiles()) == 1 and len(claims.places.slice(one).inputFiles()) <= 1
    assert claims.version("new checkpoint", 0) == 20
    with pytest.raises(RuntimeError, match="gone"):
        Claims(spark, f"file://{tmp_path}/lost").version("s", 7)


def test_state_by_buckets_is_state_by_batches(spark, tmp_path):
    schema = "application_id string, external_review_id string, score int, content string, first_observed_at timestamp, last_observed_at timestamp"
    keys = ["application_id", "external_review_id"]
    table = KeyedTable(spark, f"file://{tmp_path}/t", schema, keys, bucket_rows=15)
    plain = spark.createDataFrame([], schema)
    for b in range(4):
        rows = [(f"a{k % 3}", f"r{(k * 7 + b * 5) % (20 + 20 * b)}", f"2024-01-{1 + (k * 5 + b * 3) % 20:02d}", k % 5, f"c{b}-{k}", 0, k) for k in range(30)]
        batch = spark.createDataFrame(rows, "application_id string, external_review_id string, observed_at string, score int, content string, partition int, offset long").withColumn("observed_at", F.col("observed_at").cast("timestamp"))
        table.merge(batch, b, I.upsert_reviews)
        plain = spark.createDataFrame(I.upsert_reviews(batch, plain).collect(), schema)
        state = sorted(map(tuple, table.read().collect()))
        assert state == sorted(map(tuple, plain.collect()))
        table.merge(batch, b, I.upsert_reviews)  # again
        assert sorted(map(tuple, table.read().collect())) == state
    before = table.before()
    one = spark.createDataFrame([("a0", "r0", 5, "late", 0, 1)], "application_id string, external_review_id string, score int, content string, partition int, offset long").withColumn("observed_at", F.lit("2023-01-01").cast("timestamp"))
    table.merge(one, 4, I.upsert_reviews)
    changed = [b for b, f in table.before()["files"].items() if before["files"].get(b) != f]
    assert len(changed) == 1 and before["buckets"] > 2
    assert str(table.read().where("application_id = 'a0' and external_review_id = 'r0'").first().first_observed_at)[:4] == "2023"
    assert table.versions() == [2, 3, 4]


def test_an_empty_batch_and_a_second_writer(spark, tmp_path):
    table = KeyedTable(spark, f"file://{tmp_path}/t", "k long, v string", ["k"])
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, v string")
    assert table.read().collect() == []
    table.merge(rows.limit(0), 0, lambda b, c: insert_new(b, c, ["k"]))
    table.merge(rows, 1, lambda b, c: insert_new(b, c, ["k"]))
    assert table.read().count() == 2 and table.read(0).count() == 0
    notes = Folder(spark, f"file://{tmp_path}/notes")
    assert notes.create("x", "one") and not notes.create("x", "two") and notes.text("x") == "one" and notes.names() == ["x"]


def test_tasks_of_another_kind_stop_the_batch(spark, tmp_path):
    log, root = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    publish(spark, log, "one", [(1, 5, "r", 1, "c")])
    tasks = lambda kind: I.task_references(lambda: spark.createDataFrame([(UUID.format(1), UUID.format(5), kind)], "id string, application_id string, task_type string"))
    run = lambda kind: I.run_ingest(event_log.read_log(spark, log, [TOPIC]), root, f"file://{tmp_path}/ck", references=tasks(kind)).awaitTermination()
    with pytest.raises(Exception, match="reference"):
        run("app_details")
    assert not Folder(spark, f"{root}/claims/ids/versions").names()
    run("reviews")
    assert contents(spark, root) == ["c"]


def test_ids_and_times_of_wire_events(spark):
    app, at = UUID.format(1), "2024-01-01T00:00:00Z"
    review = {"crawl_task_id": app, "application_id": app, "package_name": " ", "observed_at": "2026-01-01T00:00Z", "position": 1, "external_review_id": "r", "source_at": at, "author_name": "n", "thumbs_up_count": 0, "score": 3, "content": "c", "source_adapter": "x"}
    ready = {"capture_id": app, "analysis_id": app, "application_id": app, "package_name": " ", "scenario": "upload", "object_key": "k", "capture_format": "pcap", "capture_size_bytes": 5, "transfer_file_size_bytes": 5, "expected_sha256": "1" * 64, "uploaded_at": at}
    sent = [(REVIEW, TOPIC, review), (REVIEW, TOPIC, review | {"crawl_task_id": "t1"}), (REVIEW, TOPIC, review | {"package_name": ""}), (REVIEW, TOPIC, review | {"observed_at": "2026-01-01T00Z"}), (REVIEW, TOPIC, review | {"observed_at": "2026-02-31T00:00:00Z"})]
    sent += [("network.capture.ready", "network.capture-ready.v1", ready), ("network.capture.ready", "network.capture-ready.v1", ready | {"package_name": "x"}), ("network.capture.ready", "network.capture-ready.v1", ready | {"package_name": "x", "analysis_id": "a"})]
    rows = [(app, json.dumps({"event_id": UUID.format(k), "event_type": e, "schema_version": 1, "occurred_at": at, "payload": p}), t, 0, k) for k, (e, t, p) in enumerate(sent)]
    df = spark.createDataFrame(rows, "key string, value string, topic string, partition int, offset long").withColumns({c: F.col(c).cast("binary") for c in ("key", "value")})
    got = I.classify(df)
    assert {r.offset for r in got.where("reason is null").collect()} == {0, 6}
    assert str(I.decoded(got.where("reason is null"), REVIEW).first().observed_at) == "2026-01-01 00:00:00"


def test_a_panel_on_a_stream_is_the_batch_panel_of_what_was_in_time(spark, tmp_path):
    import datetime

    from quartzite.streaming import windows as W

    schema, start = "timestamp timestamp, level string, service string", datetime.datetime(2024, 1, 1)
    root, panel = f"file://{tmp_path}/out", W.log_level_panel("1 hour", "30 minutes")
    at = lambda minutes, level="error": (start + datetime.timedelta(minutes=minutes), level, "s")
    batches = [[at(5), at(50), at(70)], [at(58, "warning"), at(40, "error"), at(200), (None, "error", "s")], [at(30), at(150), at(400)]]
    for b, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{b}")
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
        W.run_panel(stream, panel, root, f"file://{tmp_path}/ck").awaitTermination()
    got = sorted((r.window_start.hour, r.level, r.records) for r in W.closed_windows(spark, panel, root).collect())
    # 70 minutes less 30 closes nothing, so 58 and 40 are in time; then 30 is late, and 150 isn't, as its window ends after 200 less 30
    assert got == [(0, "error", 3), (0, "warning", 1), (1, "error", 1), (2, "error", 1), (3, "error", 1)]
    assert sorted((r.timestamp - start).total_seconds() / 60 if r.timestamp else -1 for r in W.late_rows(spark, root).collect()) == [-1, 30]
    W.advance(spark.createDataFrame(batches[2], schema), panel, root, "other", 0)  # all of it is late now, but the newest window
    assert sorted((r.window_start.hour, r.level, r.records) for r in W.closed_windows(spark, panel, root).collect()) == got


def test_events_are_classified_by_compiled_steps(spark):
    """Only the step of analyses may be interpreted, and no method may be too large for the JVM to compile; a table's event types are read at once."""
    from quartzite.bindings import Bound
    from quartzite.catalog_streams import wire

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = I.classify(wire(Bound(spark, "/root/testdata/sf0.001")).limit(50))
        plan = d._jdf.queryExecution()
        steps = [line for line in plan.executedPlan().toString().splitlines() if "Generate inline" in line]
        stages = plan.debug().codegenToSeq()
        assert len(steps) > 5 and sum("*(" not in line for line in steps) <= 1
        assert max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000
        parts = I.routed(spark.createDataFrame([("e", "t", 0, 1, "x", "{}")], "event_id string, topic string, partition int, offset bigint, event_type string, payload string"))
        assert parts["review_observed"]._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_types_of_payload_fields(spark):
    u = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    base = {"crawl_task_id": u(1), "application_id": u(2), "package_name": "com.a.b", "collected_at": "2024-01-01T00:00:00Z", "min_installs": 1, "score": 3, "ratings_count": 1, "reviews_count": 1, "store_updated_on": None, "version": None, "ad_supported": True, "source_adapter": "a"}
    changes = {
        True: [{}, {"score": 3.5}, {"score": 1e0}, {"version": ""}, {"version": "1"}, {"store_updated_on": "2024-01-02"}, {"package_name": " "}],
        False: [{"score": "3"}, {"score": None}, {"score": 5.5}, {"version": {"a": 1}}, {"version": 1}, {"store_updated_on": 5}, {"store_updated_on": "soon"}, {"min_installs": 1.0}, {"min_installs": -1}, {"min_installs": 12345678901234567890}, {"min_installs": None}, {"ad_supported": "true"}, {"package_name": ""}, {"package_name": ["a"]}, {"collected_at": "2024-01-01T00:00:00"}, {"collected_at": "2024-13-01T00:00:00Z"}, {"more": 1}, {"crawl_task_id": "t1"}],
    }
    sent = [(ok, {**base, **change}) for ok, many in changes.items() for change in many] + [(False, [base]), (False, None), (False, {k: v for k, v in base.items() if k != "version"})]
    body = lambda p: json.dumps({"event_id": u(9), "event_type": "playstore.app_stats.collected", "schema_version": 1, "occurred_at": "2024-01-01T00:00:00Z", "payload": p})
    df = spark.createDataFrame([(u(2).encode(), body(p).encode(), "playstore.app-stats.v1", 0, n) for n, (_, p) in enumerate(sent)], event_log.SCHEMA)
    got = {r.offset: r.reason for r in I.classify(df).collect()}
    assert [got[n] for n in range(len(sent))] == [None if ok else "invalid_envelope_or_payload" for ok, _ in sent]
