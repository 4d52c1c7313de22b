"""Packets, rules, enrichment, ingestion and sources on small hand-made rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from quartzite.functions import exprs as X
from quartzite.functions.stats import nearest_rank
from quartzite.operators import enrich as E
from quartzite.operators import filters
from quartzite.operators import packets as P
from quartzite.operators import quality as Q
from quartzite.operators import temporal as T
from quartzite.sources import readers as R
from quartzite.sources import sinks
from quartzite.streaming import ingest as I

PACKET = """capture_id string, packet_no long, timestamp double, frame_len long, captured_len long, direction string, ip_version int, network_bytes long, src_ip string, dst_ip string, src_port int, dst_port int, transport string, l4_payload_bytes long, tcp_stream int,
 ip_fragment boolean, ecn_ce boolean, icmp_error boolean, tcp_syn boolean, tcp_ack boolean, tcp_rst boolean, tcp_retransmission boolean, tcp_fast_retransmission boolean, tcp_spurious_retransmission boolean, tcp_zero_window boolean, tcp_window_full boolean, tcp_out_of_order boolean, tcp_duplicate_ack boolean, tcp_lost_segment boolean,
 tcp_window_size int, tcp_initial_rtt_seconds double, tcp_ack_rtt_seconds double, quic boolean, quic_version string, quic_packet_type string, quic_spin_bit int, dns_is_response boolean, dns_response_code int, dns_time_seconds double"""
NAMES = [c.split()[0] for c in PACKET.replace("\n", " ").split(",")]


def packet(no, ts, way="tx", **more):
    a, b = ("10.0.0.1", 5000), ("1.1.1.1", 443)
    src, dst = (a, b) if way == "tx" else (b, a)
    base = {n: None for n in NAMES} | {n: False for n in NAMES if n.split("_")[0] in ("tcp", "ip", "ecn", "icmp", "quic") and n in PACKET and f"{n} boolean" in PACKET and n != "dns_is_response"}
    base |= {"capture_id": "c", "packet_no": no, "timestamp": ts, "frame_len": 120, "captured_len": 120, "direction": way, "ip_version": 4, "network_bytes": 120, "src_ip": src[0], "src_port": src[1], "dst_ip": dst[0], "dst_port": dst[1], "transport": "tcp", "l4_payload_bytes": 0}
    return tuple((base | more)[n] for n in NAMES)


def metrics(spark, rows, scenario="upload", size=100, **options):
    captures = spark.createDataFrame([("c", scenario, size)], "capture_id string, scenario string, transfer_file_size_bytes long")
    return P.capture_metrics(spark.createDataFrame(rows, PACKET), captures, **options).first()


#: An upload of seven packets, and what the metrics of it must be.
SEVEN = [
    packet(1, 0.0, tcp_syn=True), packet(2, 0.1, "rx", tcp_syn=True, tcp_ack=True, tcp_initial_rtt_seconds=0.1), packet(3, 0.2, tcp_ack=True, tcp_ack_rtt_seconds=0.05), packet(4, 1.0, l4_payload_bytes=100),
    packet(5, 1.2, "rx", tcp_zero_window=True, tcp_window_size=0), packet(6, 1.5, "rx", tcp_window_size=4096), packet(7, 2.0, l4_payload_bytes=50, tcp_retransmission=True, tcp_fast_retransmission=True, tcp_out_of_order=True),
]
OF_SEVEN = {
    "comparison_ready": True, "tcp_rtt_available": True, "network_bytes_total": 840, "tx_network_bytes": 480, "flow_count": 1, "flows_for_80pct_payload": 1, "top_flow_payload_share": 1, "effective_file_throughput_mbps": 0.0008, "primary_direction_amplification_ratio": 4.8,
    "total_transfer_amplification_ratio": 8.4, "reverse_path_cost_ratio": 0.75, "tcp_successful_handshake_count": 1, "tcp_initial_rtt_p50_ms": 100, "tcp_ack_rtt_p95_ms": 50, "tcp_retransmission_count": 1, "tcp_recovery_tax": 1 / 3, "tcp_zero_window_duration_ms": 300, "tcp_receiver_stall_ratio": 0.15, "tcp_out_of_order_count": 1,
}


def test_tcp_capture(spark):
    m = metrics(spark, SEVEN)
    assert all(math.isclose(m[name], value, rel_tol=1e-9) for name, value in OF_SEVEN.items())
    assert m.analysis_warnings == [] and m.quic_versions_seen is None and m.udp_flow_count is None and m.dns_query_count is None


def test_missing_direction_and_acknowledgement(spark):
    m = metrics(spark, [packet(1, 0.0, tcp_syn=True, direction=None), packet(2, 0.1, "rx", tcp_syn=True, tcp_ack=True)])
    assert not m.direction_metadata_available and m.tx_network_bytes is None and m.tcp_successful_handshake_count == 0
    assert m.analysis_warnings == ["direction_unavailable", "missing_tcp_handshake", "no_primary_payload"]


def test_stalls_of_both_sides_merge_and_stay_open(spark):
    m = metrics(spark, [packet(1, 0.0, tcp_zero_window=True, tcp_window_size=0), packet(2, 0.1, "rx", tcp_zero_window=True, tcp_window_size=0), packet(3, 0.2, tcp_window_size=5), packet(4, 0.5, "rx")])
    assert math.isclose(m.tcp_zero_window_duration_ms, 500) and "tcp_zero_window_open_at_capture_end" in m.analysis_warnings


def test_quic_needs_supported_fields(spark):
    rows = [packet(1, 0.0, transport="udp", quic=True, quic_version="0x1", quic_packet_type="Initial", quic_spin_bit=0), packet(2, 0.2, "rx", transport="udp", quic=True, quic_version="0x1", quic_packet_type="0"), packet(3, 0.3, transport="udp", quic=True, quic_spin_bit=1)]
    m = metrics(spark, rows)
    assert m.quic_versions_seen == ["0x1"] and math.isclose(m.quic_initial_rtt_avg_ms, 200) and m.quic_spin_rtt_sample_count == 1 and m.tcp_connection_count is None
    assert metrics(spark, rows, supported=frozenset()).quic_version_count is None


def test_capture_without_packets_has_a_row(spark):
    captures = spark.createDataFrame([("none", "upload", 100)], "capture_id string, scenario string, transfer_file_size_bytes long")
    m = P.capture_metrics(spark.createDataFrame([packet(1, 0.0)], PACKET), captures).first()
    assert m.packet_count == 0 and m.analysis_warnings == ["direction_unavailable", "no_primary_payload"] and m.flows_for_80pct_payload == 0


def test_raw_fields_to_packets(spark, tmp_path):
    line = {c: "" for c in R.PACKET_FIELDS} | {"frame.time_epoch": "1.5", "frame.len": "100", "frame.cap_len": "100", "frame.packet_flags_direction": "2", "ip.src": "1.1.1.1,9.9.9.9", "ip.dst": "2.2.2.2", "ip.len": "0x54", "ip.dsfield.ecn": "3", "udp.srcport": "53", "udp.dstport": "99", "udp.length": "30", "dns.flags.response": "1", "dns.flags.rcode": "3"}
    (tmp_path / "cap7.tsv").write_text("\n".join(["\t".join(f'"{line[c]}"' for c in R.PACKET_FIELDS), "\t".join(R.PACKET_FIELDS and [""] * len(R.PACKET_FIELDS))]) + "\n")
    got = P.normalize_packets(R.read_packet_fields(spark, str(tmp_path))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.capture_id, r.direction, r.src_ip, r.network_bytes, r.l4_payload_bytes, r.transport, r.ecn_ce, r.dns_is_response, r.dns_response_code) == ("cap7", "tx", "1.1.1.1", 84, 22, "udp", True, True, 3)


def test_nearest_rank(spark):
    for n in (1, 2, 19, 20, 21, 100):
        assert spark.range(1, n + 1).agg(nearest_rank("cast(id as double)", 95)).first()[0] == math.ceil(0.95 * n)


def test_scalar_expressions(spark):
    one = spark.createDataFrame([("Jan 2, 2024", "0x1f,3", "http", 0.05, [0.1, 0.2, 0.3, 0.2, 0.2])], "d string, n string, p string, s double, q array<double>")
    r = one.select(X.parse_store_date("d").cast("string"), X.first_int("n"), X.valid_package("p"), X.compound_label("s"), X.collapse_labels("q", {"negative": [0, 1], "neutral": [2], "positive": [3, 4]}), X.parse_store_date(F.lit("Never updated")), X.parse_store_date(F.lit("1700000000")).cast("string"), X.ratio(F.lit(1), F.lit(0))).first()
    assert tuple(r) == ("2024-01-02", 31, False, "positive", "positive", None, "2023-11-14", None)


def test_interval_operators(spark):
    d = spark.createDataFrame([("k", 0.0, 2.0), ("k", 1.0, 3.0), ("k", 5.0, 5.0), ("k", 6.0, 7.0)], "k string, s double, e double")
    assert T.union_length(d, ["k"], "s", "e", "x").first().x == 4
    r = spark.createDataFrame([("a", "1", 1, 10), ("a", "2", 2, 3), ("a", "3", 5, 6), ("a", "4", 11, 12)], "k string, i string, s int, e int")
    assert {x.i for x in T.overlaps(r, "k", "i", "s", "e").collect()} == {"2", "3"}  # also what lies under a longer earlier one
    assert filters.after_key(r, ["k", "i"], ("a", "2")).count() == 2


def test_manifest_rules(spark, tmp_path):
    one = {c.split()[0]: None for c in R.EXPERIMENT.split(", ")} | {"capture_id": "x", "trial_number": 0, "application_package": "bad", "scenario": "sideways", "capture_started_at_utc": "2024-01-01T00:00:00Z", "capture_finished_at_utc": "2024-01-01T00:00:00Z", "transfer_completed": False}
    (tmp_path / "m.json").write_text(json.dumps({"schema_version": 1, "captures": [one, one | {"pair_id": "p"}]}, indent=1))
    m = R.read_experiment_manifest(spark, f"{tmp_path}/m.json")
    assert m.count() == 2 and R.read_experiment_manifest(spark, None).columns == m.columns
    rules = {r.rule for r in Q.check_experiment(m).collect()}
    assert rules == {"required", "uuid", "positive", "package", "enum", "order", "provenance"}
    assert {r.rule for r in Q.check_pairs(m).collect()} == {"pair_size", "pair_applications", "pair_conditions"}
    assert Q.check_unique(m, ["capture_id"], "capture_id").count() == 2 and Q.check_catalogues(m, {"scenario": spark.createDataFrame([("upload",)], "v string")}).count() == 2
    assert Q.manifest_fingerprint(m, "capture_id").first()[0] == Q.manifest_fingerprint(m.repartition(3), "capture_id").first()[0]
    ids = Q.with_cohorts(m).select("file_cohort_id", "comparison_cohort_id").collect()
    assert ids[0].file_cohort_id.startswith("file_") and {r.comparison_cohort_id is None for r in ids} == {True, False}


def test_captures_without_a_pair_are_no_group(spark):
    m = spark.range(1000).select(F.col("id").alias("capture_id"), F.when(F.col("id") < 4, F.floor(F.col("id") / 2)).alias("pair_id"), F.concat(F.lit("a"), F.col("id") % 4).alias("application_package"), F.lit("f").alias("test_file_sha256"), F.lit(1).alias("test_file_size_bytes"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = Q.with_cohorts(m).withColumn("_task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    ids = {r.capture_id: r.comparison_cohort_id for r in got}
    assert len(ids) == len(got) == 1000 and ids[0] == ids[1] != ids[2] == ids[3] and not any(ids[k] for k in range(4, 1000))
    assert len({r._task for r in got if r.capture_id > 3}) == 4


def test_release_rules_and_windows(spark):
    rel = spark.createDataFrame([("r", "com.a.b", "1", "1", "2024-02-15", "day", True), ("r", "com.a.b", "1", "2", "2024-02-20", "day", True), ("s", "com.a.b", "1", "2", "2024-02-20", "month", True)], "release_event_id string, application_package string, previous_version string, new_version string, d string, release_date_precision string, release_date_verified boolean")
    rel = Q.default_windows(rel.withColumns({"release_date": F.to_date("d")} | {c: F.lit(None).cast("date") for c in ("baseline_start", "baseline_end", "followup_start", "followup_end")}))
    rows = {r.new_version + r.release_event_id: r for r in rel.collect()}
    assert str(rows["1r"].baseline_start) == "2024-02-01" and str(rows["1r"].followup_end) == "2024-02-29" and rows["2s"].baseline_start is None
    assert {r.rule for r in Q.check_releases(rel).collect()} == {"versions", "unique"} and Q.check_overlaps(rel).count() == 1


def test_private_columns_are_refused(spark):
    df = spark.createDataFrame([(1, "x")], "id long, secret string")
    with pytest.raises(ValueError):
        R.allowlisted(df, "reviews", ["id", "secret"])
    assert R.allowlisted(df, "reviews").columns == ["id"]


def test_capture_files(spark, tmp_path):
    import hashlib

    good = bytes.fromhex("d4c3b2a1") + b"x"
    (tmp_path / "a.pcap").write_bytes(good)
    (tmp_path / "b.pcap").write_bytes(b"????")
    rows = [("a", "pcap", hashlib.sha256(good).hexdigest()), ("b", "pcap", ""), ("c", "pcap", "")]
    got = R.verify_captures(spark.read.format("binaryFile").load(str(tmp_path)), spark.createDataFrame(rows, "capture_id string, capture_format string, capture_sha256 string"))
    assert {r.capture_id: r.problem for r in got.collect()} == {"a": None, "b": "unknown_format", "c": "file_missing"}


def test_raw_responses(spark):
    body = ")]}'\n" + json.dumps([["w", "x", json.dumps([[["r1", 5], ["r2", 1]]])]])
    got = R.explode_review_responses(spark.createDataFrame([(1, body), (2, "broken")], "id long, body string"), 10).collect()
    assert [(r.id, r.position, json.loads(r.item)) for r in got] == [(1, 1, ["r1", 5]), (1, 2, ["r2", 1])]


def test_flatten_and_messages(spark):
    df = spark.sql("select 'a' as application_id, named_struct('x', 1) as traffic, cast(null as struct<y:int>) as tcp")
    r = sinks.flatten_analysis(df).first()
    assert (r.x, r.y) == (1, None)
    m = sinks.event_messages(df).first()
    assert bytes(m.key) == b"a" and json.loads(bytes(m.value))["traffic"] == {"x": 1}


def test_enrichment(spark):
    obs = spark.createDataFrame([(1, "t1", "good", "pending", None, 0), (1, "t2", "good", "pending", None, 2), (2, "t3", None, "pending", None, 2), (3, "t4", "bad", "done", "negative", 1)], "review_id long, crawl_task_id string, content string, sentiment_status string, sentiment_label string, sentiment_attempt_count int").withColumns({"sentiment_language": F.lit("en"), "sentiment_processed_at": F.lit("2024-01-01").cast("timestamp")})
    assert E.identities(obs).count() == 3

    def scorer(texts):
        if len(texts) > 1:
            raise RuntimeError("a batch fails")
        if texts[0] is None:
            raise ValueError("no text")
        return ["positive" if "good" in texts[0] else "negative"]

    scored = {r.review_id: r for r in E.score_sentiment(E.identities(obs).withColumn("sentiment_language", F.lit("en")), {"en": scorer}).collect()}
    assert scored[1].sentiment_label == "positive" and scored[2].sentiment_error.startswith("ValueError")
    results = spark.createDataFrame([(1, "good", "done", "positive", "en"), (3, "bad", "done", "positive", "en")], "review_id long, content string, new_status string, new_label string, new_language string")
    after = {r.crawl_task_id: (r.sentiment_status, r.sentiment_label) for r in E.apply_results(obs, results).collect()}
    assert after == {"t1": ("done", "positive"), "t2": ("done", "positive"), "t3": ("pending", None), "t4": ("done", "negative")}
    failed = {r.crawl_task_id: (r.sentiment_status, r.sentiment_attempt_count) for r in E.record_failures(obs, obs.where("review_id < 3").select("review_id", "content")).collect()}
    assert failed["t1"] == ("pending", 1) and failed["t2"] == ("failed", 3) and failed["t3"] == ("failed", 3) and failed["t4"] == ("done", 1)
    again = E.reuse(spark.createDataFrame([(3, "t9", "bad")], "review_id long, crawl_task_id string, content string"), obs).first()
    assert (again.reused_status, again.reused_label) == ("done", "negative")
    told = E.detect_language(spark.createDataFrame([("ok text",), ("a1",), ("xx text",), (None,)], "content string"), lambda ts: [("en", 0.99) if t.startswith("ok") else ("zz", 0.99) for t in ts])
    assert [r.language_status for r in told.collect()] == ["ok", "too_short", "unsupported", "too_short"]


def test_gate_of_batches(spark):
    rows = [("good", k, "r", 5, 0, "c", "2024-01-01") for k in range(20)] + [("good", 20, "r", 9, 0, "c", "2024-01-01"), ("bad", 1, "r", 5, 0, "c", "2024-01-01"), ("bad", 2, None, 5, 0, "c", "2024-01-01"), ("none", 1, "r", 9, 0, "c", "2024-01-01")]
    d = E.normalize_reviews(spark.createDataFrame(rows, "batch_id string, position int, external_review_id string, score int, thumbs_up_count int, content string, source_at string"))
    assert {r.batch_id for r in E.gate_batches(d).collect()} == {"good"} and E.gate_batches(d).count() == 20


def message(no, at, text, score=3, key="a", event=None):
    payload = {"crawl_task_id": f"t{no}", "application_id": "a", "package_name": "com.a.b", "observed_at": at, "position": 1, "external_review_id": "r", "source_at": at, "author_name": "n", "thumbs_up_count": 0, "score": score, "content": text, "source_adapter": "x"}
    body = {"event_id": event or f"00000000-0000-4000-8000-{no:012d}", "event_type": "review_observed", "schema_version": 1, "occurred_at": at, "payload": payload}
    return key, json.dumps(body), "reviews", 0, no


def test_stream_runs_with_exactly_once_effect(spark, tmp_path):
    schema = "key string, value string, topic string, partition int, offset long"
    source, root = tmp_path / "in", str(tmp_path / "out")
    first = [message(1, "2024-01-02T00:00:00Z", "newer"), message(2, "2024-01-01T00:00:00Z", "older"), message(3, "2024-01-01T00:00:00", "no zone"), message(4, "2024-01-03T00:00:00Z", "again", event="00000000-0000-4000-8000-000000000001"), ("a", "{", "reviews", 0, 5)]
    spark.createDataFrame(first, schema).coalesce(1).write.json(f"{source}/1")

    def run():
        stream = spark.readStream.schema(schema).json(f"{source}/*").withColumns({c: F.col(c).cast("binary") for c in ("key", "value")})
        I.run_ingest(stream, root, str(tmp_path / "ck")).awaitTermination()
        return sorted(r.content for r in spark.read.parquet(f"{root}/review_observed").collect()), spark.read.parquet(f"{root}/quarantine").groupBy("reason").count().collect(), spark.read.parquet(f"{root}/ledger").count()

    seen, bad, n = run()
    assert seen == ["newer", "older"] and n == 2 and {(r.reason, r["count"]) for r in bad} == {("invalid_envelope_or_payload", 1), ("invalid_json", 1)}
    spark.createDataFrame([*first[:2], message(6, "2024-01-04T00:00:00Z", "later")], schema).coalesce(1).write.json(f"{source}/2")
    seen, _, n = run()
    assert seen == ["later", "newer", "older"] and n == 3


def test_upsert_order_and_ties(spark):
    schema = "application_id string, external_review_id string, observed_at timestamp, score int, content string, partition int, offset long"
    batch = lambda *rows: spark.createDataFrame([("a", "r", *r) for r in rows], schema.replace("timestamp", "string")).withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    none = spark.createDataFrame([], "application_id string, external_review_id string, score int, content string, first_observed_at timestamp, last_observed_at timestamp")
    one = I.upsert_reviews(batch(("2024-01-02", 1, "x", 0, 1), ("2024-01-02", 2, "y", 0, 2), ("2024-01-01", 3, "z", 0, 3)), none)
    assert one.first().content == "y" and str(one.first().first_observed_at)[:10] == "2024-01-01"
    assert I.upsert_reviews(batch(("2024-01-01", 5, "late", 0, 9)), one).first().content == "y"
    assert I.upsert_reviews(batch(("2024-01-02", 5, "tie", 0, 9)), one).first().content == "tie"


def test_lifecycle(spark):
    c = spark.createDataFrame([("a", "pending_upload", "k1", 5, "2024-01-01"), ("b", "pending_upload", "k2", 5, "2024-01-01"), ("c", "uploaded", "k3", 5, None), ("d", "analyzed", "k3", 5, None), ("e", "analyzed", "k4", 5, None)], "id string, status string, object_key string, capture_size_bytes long, e string")
    c = c.withColumns({"expires_at": F.col("e").cast("timestamp"), "analysis_started_at": F.lit(None).cast("timestamp"), "object_deleted_at": F.lit(None).cast("timestamp")})
    now = F.lit("2024-01-02").cast("timestamp")
    got = {r.id: (r.new_status, r.change_reason, r.emit) for r in I.reconcile(c, spark.createDataFrame([("k1", 5)], "object_key string, size long"), now, 60).collect()}
    assert got == {"a": ("uploaded", None, True), "b": ("expired", "object_missing", False), "c": ("uploaded", None, True), "d": ("analyzed", None, False), "e": ("analyzed", None, False)}
    assert {r.object_key for r in I.cleanable(c).collect()} == {"k4"} and {r.id for r in I.claimable(c, now, 60).collect()} == {"c"} and I.retryable(c).count() == 0
    with pytest.raises(ValueError):
        I.require_consistent(c, c.where("id <> 'a'"), ["id"])


def analysis(**changes):
    """The payload of an analysis, as it is sent; changes by group or field."""
    value = {"int": 3, "positive": 3, "float": 1.5, "ratio": 0.5, "bool": True, "format": "pcap", "texts": ["x"]}
    groups = {g: {name: None if kind == "ratio?" else value[kind.rstrip("?")] for kind, names in kinds.items() for name in names.split()} for g, kinds in I.ANALYSIS.items()}
    ids = {c: "00000000-0000-4000-8000-00000000000a" for c in ("analysis_id", "capture_id", "application_id")}
    p = ids | {"package_name": "com.a", "scenario": "upload", "analyzed_at": "2024-01-01T00:00:00Z", "analyzer_version": "1", "tshark_version": "4", "source_analyzer": "tshark", "verified_sha256": "0" * 64} | groups | {"tcp": None}
    for k, v in changes.items():
        p[k] = p[k] | v if isinstance(v, dict) else v
    return p


def test_event_types_and_topics_of_the_wire(spark, tmp_path):
    app, at = "00000000-0000-4000-8000-00000000000a", "2024-01-01T00:00:00Z"
    stats = {"crawl_task_id": app, "application_id": app, "package_name": "com.a", "collected_at": at, "min_installs": 5, "score": 4.5, "ratings_count": 1, "reviews_count": 1, "store_updated_on": None, "version": None, "ad_supported": True, "source_adapter": "x"}
    review = {"crawl_task_id": app, "application_id": app, "package_name": "com.a", "observed_at": at, "position": 1, "external_review_id": "r", "source_at": at, "author_name": "n", "thumbs_up_count": 0, "score": 3, "content": "c", "source_adapter": "x"}
    ready = {"capture_id": app, "analysis_id": app, "application_id": app, "package_name": "com.a", "scenario": "upload", "object_key": "k", "capture_format": "pcap", "capture_size_bytes": 5, "transfer_file_size_bytes": 5, "expected_sha256": "1" * 64, "uploaded_at": at}
    short = analysis()
    del short["source_analyzer"], short["capture"]["analysis_warnings"]
    lost = analysis()
    del lost["flow"]["flow_count"]
    kind, topic = "network.analysis.collected", "network.analysis-collected.v1"
    sent = [
        ("playstore.app_stats.collected", "playstore.app-stats.v1", stats), ("playstore.review.observed", "playstore.review-observed.v1", review), ("network.capture.ready", "network.capture-ready.v1", ready),
        (kind, topic, analysis()), (kind, topic, short), (kind, "captures", analysis()), (kind, topic, lost), (kind, topic, analysis(ip={"ip_fragment_rate": 2})), (kind, topic, analysis(dns={"dns_query_count": -1})),
        ("playstore.review.observed", "playstore.review-observed.v1", review | {"author_name": "", "content": " "}), ("playstore.app_stats.collected", "playstore.app-stats.v1", stats | {"version": ""}), (kind, topic, analysis(flow=None)), (kind, topic, analysis(udp={"more": 1})), (kind, topic, analysis(scenario="other")), (kind, topic, analysis(traffic={"network_bytes_total": "5"})),
    ]
    rows = [(app, json.dumps({"event_id": f"00000000-0000-4000-8000-{k:012d}", "event_type": e, "schema_version": 1, "occurred_at": at, "payload": p}), t, 0, k) for k, (e, t, p) in enumerate(sent)]
    schema, root = "key string, value string, topic string, partition int, offset long", str(tmp_path / "out")
    spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*").withColumns({c: F.col(c).cast("binary") for c in ("key", "value")})
    I.run_ingest(stream, root, str(tmp_path / "ck")).awaitTermination()
    bad = {r.offset: r.reason for r in spark.read.parquet(f"{root}/quarantine").collect()}
    assert bad == {5: "topic_event_mismatch"} | dict.fromkeys([6, 7, 8, 11, 12, 13, 14], "invalid_envelope_or_payload")
    wide = {r.offset: r for r in spark.read.parquet(f"{root}/network_analysis_collected").collect()}
    assert sorted(wide) == [3, 4] and wide[3].flow_count == 3 and wide[3].tcp_reset_count is None and wide[3].quic_versions_seen == ["x"]
    assert wide[4].source_analyzer == "tshark" and wide[4].analysis_warnings == []
    assert [spark.read.parquet(f"{root}/{t}").count() for t in ("app_stats_collected", "review_observed", "network_capture_ready", "ledger")] == [2, 2, 1, 7]
    assert spark.read.parquet(f"{root}/network_capture_ready").first().capture_sha256 == "1" * 64


def test_manifest_version_and_what_it_allows(spark, tmp_path):
    import json

    one = {"schema_version": 1, "allowed_device_models": ["d1"], "allowed_network_profiles": ["p1", "p2"], "allowed_comparison_cohorts": [["com.a.x", "com.b.x"]], "captures": [{"capture_id": "c1", "device_model": "d1", "network_profile": "p9", "protocol_notes": "a {{b}}"}]}
    (tmp_path / "one.json").write_text(json.dumps(one))
    (tmp_path / "two.json").write_text(json.dumps(one | {"schema_version": 2}))
    captures = R.read_experiment_manifest(spark, f"file://{tmp_path}/one.json")
    allowed = R.read_catalogues(spark, f"file://{tmp_path}/one.json")
    assert [tuple(r) for r in allowed.pop("cohorts").collect()] == [("com.a.x", "com.b.x")]
    assert [r.message for r in Q.check_catalogues(captures, allowed).collect()] == ["network_profile isn't allowed: p9"]
    assert [r.message for r in Q.check_experiment(captures).where("rule = 'template'").collect()] == ["protocol_notes holds a template control"]
    with pytest.raises(Exception, match="schema_version must be 1"):
        R.read_experiment_manifest(spark, f"file://{tmp_path}/two.json").collect()


def test_state_after_batches_and_rows_without_reference(spark, tmp_path):
    schema, root = "key string, value string, topic string, partition int, offset long", str(tmp_path / "out")
    apps = lambda *ids: {"review_observed": (lambda: spark.createDataFrame([(i,) for i in ids], "application_id string"), ["application_id"])}

    def run(number, rows, references):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(f"{tmp_path}/in/{number}")
        resume(references)

    def resume(references):
        stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*").withColumns({c: F.col(c).cast("binary") for c in ("key", "value")})
        I.run_ingest(stream, root, str(tmp_path / "ck"), references=references).awaitTermination()

    run(1, [message(1, "2024-01-02T00:00:00Z", "x", score=1), message(2, "2024-01-02T00:00:00Z", "y", score=2)], apps("a"))
    with pytest.raises(Exception, match="reference"):
        run(2, [message(3, "2024-01-02T00:00:00Z", "tie", score=5)], apps("b"))
    assert spark.read.parquet(f"{root}/ledger").count() == 2
    resume(apps("a"))  # the batch runs again
    run(3, [message(4, "2024-01-01T00:00:00Z", "late", score=4)], apps("a"))
    observed = spark.read.parquet(f"{root}/review_observed")
    now = I.current_reviews(observed).collect()
    assert [(r.content, r.score, str(r.first_observed_at)[:10], str(r.last_observed_at)[:10]) for r in now] == [("tie", 5, "2024-01-01", "2024-01-02")]
    again = observed.where("offset = 1").withColumn("batch", F.lit(9)).withColumn("content", F.lit("again"))
    assert sorted(r.content for r in I.kept_observations(observed.unionByName(again)).collect()) == ["late", "tie", "x", "y"]
