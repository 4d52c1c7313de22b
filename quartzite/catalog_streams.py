"""Queries on ingestion and panels as streams see them, batch after batch with state between, and on what is read from files."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.bindings import Bound
from quartzite.operators import packets
from quartzite.session import shared_folder
from quartzite.sources import event_log, readers, sinks
from quartzite.streaming import ingest, windows
from quartzite.streaming.keyed import Claims

#: Batches that a query runs: an event's batch is its day's place among them, and every tenth event comes one batch late.
BATCHES = 3


def batch_of(n: int = BATCHES):
    return F.least(F.day("ts") % n + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0), F.lit(n)).cast("int")


def keyed_reviews(t: Bound) -> DataFrame:
    """The state of reviews after batches of observations, in buckets."""
    root = shared_folder(t.spark, "reviews")
    seen = t["ev"].where("event_type in ('purchase', 'signup')").select(
        F.col("user_id").cast("string").alias("application_id"), F.concat(F.lit("r"), F.col("k") % 10).alias("external_review_id"), F.col("ts").alias("observed_at"), F.col("ts").alias("source_at"), F.lit("n").alias("author_name"),
        F.col("k").cast("bigint").alias("thumbs_up_count"), (1 + F.col("event_id") % 5).cast("int").alias("score"), F.concat(F.lit("c"), "event_id").alias("content"), F.lit("a").alias("source_adapter"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), batch_of().alias("_b"),
    )
    state = ingest.review_state(t.spark, root)
    for b in range(BATCHES + 1):
        state.merge(seen.where(F.col("_b") == b).drop("_b"), b, ingest.upsert_reviews)
    return state.read().select("application_id", "external_review_id", "thumbs_up_count", "score", "content", "first_observed_at", "last_observed_at")


def claimed_batches(t: Bound) -> DataFrame:
    """Which batch claims each event, when a seventh of all events come again in the next batch at another place, and a ninth at the same."""
    root = shared_folder(t.spark, "claims")
    one = t["ev"].select(F.concat(F.lit("e"), "event_id").alias("event_id"), F.lit("t").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), batch_of().alias("_b"))
    again = one.where("offset % 7 = 0").withColumns({"offset": F.col("offset") + 10_000_000, "_b": F.col("_b") + 1})
    same = one.where("offset % 9 = 0").withColumns({"event_id": F.concat("event_id", F.lit("x")), "_b": F.col("_b") + 1})
    sent, out = one.unionByName(again).unionByName(same), None
    for b in range(BATCHES + 2):
        claims = Claims(t.spark, root)
        version = claims.version("q", b)
        batch = sent.where(F.col("_b") == b).drop("_b")
        claims.fresh(batch, version).write.parquet(f"{root}/taken/batch={b}")
        claims.commit(t.spark.read.parquet(f"{root}/taken/batch={b}"), version, "q", b)
    out = t.spark.read.parquet(f"{root}/taken")
    return out.select("event_id", F.col("offset").alias("place"), F.col("batch").cast("int").alias("batch"))


def wire(t: Bound) -> DataFrame:
    """Events published as they are on the wire: reviews, and snapshots of which some break the contract."""
    uuid = lambda c: F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(c.cast("string"), 12, "0"))
    task = F.when(F.col("k") % 10 == 3, F.concat(F.lit("t"), "event_id")).otherwise(uuid(F.col("event_id")))
    base = t["ev"].select("event_id", "event_type", "k", "ts", task.alias("crawl_task_id"), uuid(F.col("user_id")).alias("application_id"), F.lit("com.a.b").alias("package_name"))
    fields = ["crawl_task_id", "application_id", "package_name"]
    reviews = base.where("event_type in ('purchase', 'signup')").select(
        *fields, F.col("ts").alias("observed_at"), (F.col("k") % 1002).cast("int").alias("position"), F.concat(F.lit("r"), "event_id").alias("external_review_id"), F.col("ts").alias("source_at"),
        F.lit("").alias("author_name"), F.col("k").alias("thumbs_up_count"), F.lit(3).alias("score"), F.lit("c").alias("content"), F.lit("a").alias("source_adapter"),
    )
    stats = base.where("event_type in ('click', 'view', 'error')").select(
        *fields, F.col("ts").alias("collected_at"), F.col("k").alias("min_installs"), (F.col("k") % 60 / 10).alias("score"), F.col("k").alias("ratings_count"), F.col("k").alias("reviews_count"),
        F.when(F.col("k") % 2 == 0, F.to_date("ts")).alias("store_updated_on"), F.lit(None).cast("string").alias("version"), F.lit(True).alias("ad_supported"), F.lit("a").alias("source_adapter"),
    )
    sent = [("playstore.review.observed", "playstore.review-observed.v1", reviews, "observed_at"), ("playstore.app_stats.collected", "playstore.app-stats.v1", stats, "collected_at")]
    made = [sinks.enveloped(df, kind, topic, at) for kind, topic, df, at in sent]
    return made[0].unionByName(made[1]).select("key", "value", "topic", F.lit(0).alias("partition"), F.xxhash64("value").alias("offset"))


def wire_reasons(t: Bound) -> DataFrame:
    """Events as they are on the wire by topic and reason."""
    return ingest.classify(wire(t)).groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("events"))


def wire_routed(t: Bound) -> DataFrame:
    """Typed rows of the wire's good events by table, and the extremes of what they hold."""
    path = shared_folder(t.spark, "good")  # as run_ingest does, so that each table doesn't classify all of them
    ingest.split_invalid(ingest.classify(wire(t)))[0].select("event_id", "event_type", "topic", "partition", "offset", "payload").write.parquet(path)
    parts = ingest.routed(t.spark.read.parquet(path))
    reviews = parts["review_observed"].groupBy("application_id").agg(F.count(F.lit(1)).alias("events"), F.max("observed_at").alias("latest"), F.sum("thumbs_up_count").alias("total"), F.max(F.lit("reviews")).alias("kind"))
    stats = parts["app_stats_collected"].groupBy("application_id").agg(F.count(F.lit(1)).alias("events"), F.max("collected_at").alias("latest"), F.sum("min_installs").alias("total"), F.max(F.lit("stats")).alias("kind"))
    return reviews.unionByName(stats)


def ingest_run(t: Bound) -> DataFrame:
    """Wire events published in two batches, of which the second repeats some of the first, and ingested by a run of a bounded stream and one without a bound: rows of each table and state."""
    root = shared_folder(t.spark, "ingest")
    half = F.pmod(F.xxhash64("value"), F.lit(6))
    wire(t).select("key", "value", "topic").write.parquet(f"{root}/sent")  # made once, read by the count and by what each batch sorts and writes
    sent, log = t.spark.read.parquet(f"{root}/sent"), f"{root}/log"
    topics = ["playstore.app-stats.v1", "playstore.review-observed.v1"]
    run = lambda **options: ingest.run_ingest(event_log.read_log(t.spark, log, topics, **options), f"{root}/out", f"{root}/ck").awaitTermination()
    event_log.publish(sent.where(half < 3), log, "one")
    run(most=max(1, sent.count() // 4), group="q")
    event_log.publish(sent.where(half > 1), log, "two")
    run()
    read = lambda name: t.spark.read.parquet(f"{root}/out/{name}")
    one = lambda name, d: d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
    parts = {"stats": read("app_stats_collected"), "reviews": read("review_observed"), "ledger": read("ledger"), "refused events": read("quarantine").select("event_id").distinct(), "review state": ingest.review_state(t.spark, f"{root}/out").read(), "observations": ingest.observation_state(t.spark, f"{root}/out").read(), "snapshots": ingest.snapshot_state(t.spark, f"{root}/out").read()}
    return reduce(DataFrame.unionByName, [one(name, d) for name, d in parts.items()])


def _panel(t: Bound, rows: DataFrame, panel: windows.Panel) -> DataFrame:
    root = shared_folder(t.spark, "panel")
    for b in range(BATCHES + 1):
        windows.advance(rows.where(F.col("_b") == b).drop("_b"), panel, root, "q", b)
    closed = windows.closed_windows(t.spark, panel, root)
    late = windows.late_rows(t.spark, root).groupBy("window_start", "window_end", *(c.cast("string").alias(k) for k, c in panel.keys.items())).agg(F.count(F.lit(1)).alias("late"))
    return closed.join(late, ["window_start", "window_end", *panel.keys], "left").withColumn("late", F.coalesce("late", F.lit(0))).drop("window_end")


def _in_time(t: Bound) -> DataFrame:
    """Events dealt to batches by their place in time, so that windows close."""
    span = t["ev"].agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    at = F.floor((F.unix_micros("ts") - F.unix_micros("a")) * BATCHES / (F.unix_micros("z") - F.unix_micros("a") + 1))
    return t["ev"].crossJoin(F.broadcast(span)).withColumn("_b", (at + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0)).cast("int")).drop("a", "z")


def log_windows(t: Bound) -> DataFrame:
    """Hourly records of services from a stream whose every tenth record comes a batch late, with the late ones counted."""
    return _panel(t, _in_time(t).select(F.col("ts").alias("timestamp"), F.concat(F.lit("svc"), F.col("user_id") % 7).alias("service"), "_b"), windows.log_volume_panel("1 hour", "6 hours"))


def task_windows(t: Bound) -> DataFrame:
    """Hourly seconds of finished tasks from the same stream."""
    task = F.when(F.col("event_type").isin("purchase", "signup"), "reviews").otherwise("app_details")
    rows = _in_time(t).where("k % 3 < 2").select(F.col("ts").alias("started_at"), (F.col("ts") + F.expr("INTERVAL 1 SECOND") * F.when(F.col("k") % 3 == 0, 30).otherwise(90)).alias("finished_at"), task.alias("task_type"), "_b")
    return _panel(t, rows, windows.task_duration_panel("1 hour", "1 day"))


def packet_files(t: Bound) -> DataFrame:
    """The dissector's lines, written to files and read back with their numbers as typed packets; some have no time."""
    path = shared_folder(t.spark, "packets")
    tcp, n = F.col("event_type").isin("click", "view"), lambda c: c.cast("string")
    cells = {
        "frame.time_epoch": F.when(F.col("k") % 25 != 1, F.concat(n(F.col("event_id")), F.lit(".5"))), "frame.len": n(60 + F.col("k")), "frame.cap_len": F.format_string("0x%x", 60 + F.col("k")), "frame.packet_flags_direction": F.when(F.col("event_id") % 2 == 0, "2").when(F.col("k") % 3 > 0, "1"),
        "ip.len": F.when(F.col("user_id") % 4 > 0, n(40 + F.col("k"))), "ipv6.plen": F.when(F.col("user_id") % 4 == 0, n(F.col("k"))), "ip.src": F.lit("10.0.0.1,10.0.0.2"), "ip.dst": F.lit("1.1.1.1"),
        "tcp.srcport": F.when(tcp, "5000"), "tcp.dstport": F.when(tcp, "443"), "tcp.len": F.when(tcp, n(F.col("k"))), "tcp.flags.syn": F.when(F.col("k") % 7 == 0, "1"), "udp.srcport": F.when(F.col("event_type") == "signup", "53"), "udp.dstport": F.when(F.col("event_type") == "signup", "5353"), "udp.length": F.when(F.col("event_type") == "signup", n(F.col("k"))),
    }
    line = F.concat_ws("\t", *(F.concat(F.lit('"'), F.coalesce(cells.get(c, F.lit("")), F.lit("")), F.lit('"')) for c in readers.PACKET_FIELDS))
    t["ev"].select(line.alias("value")).write.text(path)
    lines = readers.read_packet_fields(t.spark, path)
    found = packets.normalize_packets(lines).groupBy("transport", "direction", "ip_version").agg(F.count(F.lit(1)).alias("packets"), F.sum("network_bytes").alias("network_bytes"), F.sum("l4_payload_bytes").alias("payload_bytes"), F.count_if("tcp_syn").alias("syns"), F.max("captured_len").alias("longest"))
    numbers = lines.groupBy("capture_id").agg(F.max("packet_no").alias("last"), F.count_distinct("packet_no").alias("n")).agg(F.sum("last").alias("lines"), F.sum("n").alias("numbers"))
    return found.crossJoin(F.broadcast(numbers))


def manifest_files(t: Bound) -> DataFrame:
    """Experiment manifests of at most some thousand captures, one JSON document a file, read back as one table."""
    path = shared_folder(t.spark, "manifests")
    known = [c.split(" ")[0] for c in readers.EXPERIMENT.split(", ")]
    m = t["experiment_manifest"]
    body = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.collect_list(F.struct(*(c for c in known if c in m.columns))).alias("captures")))
    m.groupBy("experiment_id", F.floor(F.regexp_extract("capture_id", r"\d+", 0).cast("bigint") / 2000)).agg(body.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_experiment_manifest(t.spark, path).select("capture_id", "experiment_id", "trial_number", "pair_id", "capture_started_at_utc", "transfer_completed", "test_file_size_bytes", "protocol_notes")


STREAMS: dict[str, Callable[[Bound], DataFrame]] = {
    "str_keyed_reviews": keyed_reviews, "str_claimed_batches": claimed_batches, "str_wire_reasons": wire_reasons, "str_wire_routed": wire_routed, "str_log_windows": log_windows, "str_task_windows": task_windows,
    "str_ingest_run": ingest_run, "src_packet_files": packet_files, "src_manifest_files": manifest_files,
}
