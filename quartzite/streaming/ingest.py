"""Event ingestion with exactly-once effect: classify, quarantine, claim, route, write; progress is the stream's checkpoint.

A micro-batch is a version of its claims. It writes its data and state under that number before the claims, and the
claims before the checkpoint moves on. If it fails or runs again, it has the same number, begins from the claims and state
before it, and overwrites what it left, so nothing counts twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.window import Window

from quartzite.operators.temporal import latest_per
from quartzite.sources.sinks import flatten_analysis
from quartzite.streaming.folders import Folder
from quartzite.streaming.keyed import Claims, KeyedTable, insert_new

KEYS = ["event_id", "event_type", "occurred_at", "payload", "schema_version"]
_ANALYSIS = "network.analysis.collected"
#: Fixed values, as are CONTRACTS below: the groups of an analysis: fields by kind; a kind with ? may be null, a ratio is in 0 to 1, no number is negative. The last four groups may be null.
ANALYSIS: dict[str, dict[str, str]] = {
    "capture": {"format": "capture_format", "positive": "capture_size_bytes transfer_file_size_bytes", "float": "capture_duration_ms", "int": "packet_count truncated_packet_count analysis_warning_count", "texts": "analysis_warnings"},
    "capabilities": {"bool": "direction_metadata_available payload_plaintext_available handshake_observed tcp_present quic_present other_udp_present tcp_rtt_available quic_initial_rtt_available quic_spin_rtt_available dns_metrics_available comparison_ready"},
    "traffic": {"int": "network_bytes_total l4_payload_bytes_total ip_transport_header_bytes", "int?": "tx_network_bytes rx_network_bytes tx_l4_payload_bytes rx_l4_payload_bytes tx_packet_count rx_packet_count", "ratio?": "ip_transport_header_overhead_ratio"},
    "protocol_mix": {"int": "tcp_bytes quic_identified_bytes other_udp_bytes", "ratio?": "tcp_byte_share quic_byte_share other_udp_byte_share ipv4_byte_share ipv6_byte_share"},
    "ip": {"int": "ip_fragment_count ecn_ce_packet_count icmp_error_count", "ratio?": "ip_fragment_rate ecn_ce_packet_rate"},
    "flow": {"int": "flow_count flows_for_80pct_payload", "int?": "unique_remote_ip_count", "ratio?": "top_flow_payload_share", "float": "connection_churn_per_mib"},
    "transfer": {"float?": "observed_primary_payload_span_ms average_network_throughput_mbps peak_1s_network_throughput_mbps p95_1s_network_throughput_mbps effective_file_throughput_mbps primary_direction_amplification_ratio reverse_path_cost_ratio", "float": "total_transfer_amplification_ratio"},
    "tcp": {
        "int": "tcp_connection_count tcp_successful_handshake_count tcp_incomplete_handshake_count tcp_data_segment_count tcp_retransmission_count tcp_fast_retransmission_count tcp_spurious_retransmission_count tcp_retransmitted_payload_bytes tcp_zero_window_count tcp_window_full_count tcp_reset_count tcp_out_of_order_count tcp_duplicate_ack_count tcp_lost_segment_indicator_count",
        "ratio?": "tcp_handshake_success_rate tcp_retransmission_rate tcp_recovery_tax tcp_receiver_stall_ratio tcp_reset_rate", "float": "tcp_zero_window_duration_ms tcp_active_duration_ms",
        "float?": "tcp_initial_rtt_avg_ms tcp_initial_rtt_p50_ms tcp_initial_rtt_p95_ms tcp_ack_rtt_min_ms tcp_ack_rtt_p50_ms tcp_ack_rtt_p95_ms tcp_rtt_tail_inflation",
    },
    "quic": {"int?": "quic_identified_connection_count quic_version_count quic_retry_count quic_version_negotiation_count quic_0rtt_observed_count quic_spin_rtt_sample_count", "texts?": "quic_versions_seen", "float?": "quic_initial_rtt_avg_ms quic_initial_rtt_p50_ms quic_initial_rtt_p95_ms quic_spin_rtt_min_ms quic_spin_rtt_p50_ms quic_spin_rtt_p95_ms"},
    "udp": {"int": "udp_flow_count udp_datagram_count udp_network_bytes udp_payload_bytes", "float?": "udp_payload_size_p50 udp_payload_size_p95", "ratio?": "udp_bidirectional_byte_ratio"},
    "dns": {"int": "dns_query_count dns_response_count dns_failure_count", "float?": "dns_rtt_p50_ms dns_rtt_p95_ms"},
}
_ANALYSIS_TEXTS = "analysis_id capture_id application_id package_name scenario analyzed_at analyzer_version tshark_version source_analyzer verified_sha256".split()
#: Fields of an analysis that have a default and may be missing.
_DEFAULTED = {"source_analyzer", "analysis_warnings"}
_STORED = {"int": "bigint", "positive": "bigint", "float": "double", "ratio": "double", "bool": "boolean", "format": "string", "texts": "array<string>"}


def _fields_of(group: str) -> list[tuple[str, str]]:
    return [(name, kind) for kind, names in ANALYSIS[group].items() for name in names.split()]


_ANALYSIS_SCHEMA = ", ".join([
    *(f"{c} {'timestamp' if c == 'analyzed_at' else 'string'}" for c in _ANALYSIS_TEXTS),
    *(f"{g} struct<{', '.join(f'{name}: {_STORED[kind.rstrip("?")]}' for name, kind in _fields_of(g))}>" for g in ANALYSIS),
])
_APP_STATS = "crawl_task_id string, application_id string, package_name string, collected_at timestamp, min_installs bigint, score double, ratings_count bigint, reviews_count bigint, store_updated_on date, version string, ad_supported boolean, source_adapter string"
_REVIEW = "crawl_task_id string, application_id string, package_name string, observed_at timestamp, position int, external_review_id string, source_at timestamp, author_name string, thumbs_up_count bigint, score int, content string, source_adapter string"
#: Event type: (topic, payload schema); the events as they are on the wire, then the short names of messages made from the test tables
CONTRACTS: dict[str, tuple[str, str]] = {
    "playstore.app_stats.collected": ("playstore.app-stats.v1", _APP_STATS),
    "playstore.review.observed": ("playstore.review-observed.v1", _REVIEW),
    "network.capture.ready": ("network.capture-ready.v1", "capture_id string, analysis_id string, application_id string, package_name string, scenario string, object_key string, capture_format string, capture_size_bytes bigint, transfer_file_size_bytes bigint, expected_sha256 string, uploaded_at timestamp"),
    _ANALYSIS: ("network.analysis-collected.v1", _ANALYSIS_SCHEMA),
    "app_stats_collected": ("app-stats", _APP_STATS),
    "review_observed": ("reviews", _REVIEW),
    "network_capture_ready": ("captures", "capture_id string, application_id string, package_name string, scenario string, capture_format string, capture_sha256 string, capture_size_bytes bigint, transfer_file_size_bytes bigint, object_key string"),
}
#: Payload fields of the wire's events that are UUIDs; the ids of the short names are free.
UUIDS = {
    "playstore.app_stats.collected": ("crawl_task_id", "application_id"), "playstore.review.observed": ("crawl_task_id", "application_id"),
    "network.capture.ready": ("capture_id", "analysis_id", "application_id"), _ANALYSIS: ("analysis_id", "capture_id", "application_id"),
}
#: The tables of event types that aren't named as their table is.
TABLES = {"playstore.app_stats.collected": "app_stats_collected", "playstore.review.observed": "review_observed", "network.capture.ready": "network_capture_ready", _ANALYSIS: "network_analysis_collected"}
OPTIONAL = {"store_updated_on", "version"}
#: Text fields of the wire's store events of which white space is enough.
LENIENT = dict.fromkeys(["playstore.app_stats.collected", "playstore.review.observed"], ("package_name", "external_review_id", "source_adapter"))
#: Text fields that may be blank.
BLANK = {"author_name", "content", "version"}
#: The reasons for which an event isn't taken, in the order in which they are looked for.
REASONS = ("missing_value", "invalid_json", "invalid_envelope", "unsupported_event_type", "unsupported_schema_version", "topic_event_mismatch", "invalid_envelope_or_payload", "missing_key", "invalid_utf8_key", "application_key_mismatch")
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


def _instant(text: Column) -> Column:
    """A time as it is on the wire, where seconds may be missing."""
    return F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2})(?=[Z+-])", "$1:00").try_cast("timestamp")


def _untimed(schema: str) -> str:
    """The schema with times as text: from_json doesn't take all that a cast does."""
    return re.sub(r"(?<= )timestamp(?=,|$)", "string", schema)


def same_keys(text: Column, names: list[str]) -> Column:
    """Does a JSON object have exactly these keys?"""
    return F.sort_array(F.json_object_keys(text)) == F.array(*map(F.lit, sorted(names)))


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are worked out once for each row, however often they are used: a generator isn't merged into what uses it."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def _analysis_ok(schema: str) -> Column:
    """The same of an analysis: one pattern over the types of all its fields, then the ranges."""
    number = r"(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+, ?\d+\))"
    kinds = {"int": "BIGINT", "positive": "BIGINT", "float": number, "ratio": number, "bool": "BOOLEAN", "format": "STRING", "texts": "ARRAY<(STRING|VOID)>"}

    def pattern(fields: dict[str, str]) -> str:
        parts = [f"({name}: {kind}, )?" if name in _DEFAULTED else f"{name}: {kind}, " for name, kind in sorted(fields.items())]
        return f"OBJECT<{''.join(parts).removesuffix(', ')}>"

    null = lambda kind, may: f"({kind}|VOID)" if may else kind
    groups = {g: null(pattern({name: null(kinds[kind.rstrip("?")], kind.endswith("?")) for name, kind in _fields_of(g)}), g in ("tcp", "quic", "udp", "dns")) for g in ANALYSIS}
    shape = F.col("_type").rlike(f"^{pattern(dict.fromkeys(_ANALYSIS_TEXTS, 'STRING') | groups)}$")
    p = F.to_json("_p")

    def ranges(v: Column) -> Column:
        of = lambda *want: F.array(*(v[g][name].cast("double") for g in ANALYSIS for name, kind in _fields_of(g) if kind.rstrip("?") in want))
        ok = (F.array_min(of("int", "float", "ratio")) >= 0) & (F.array_min(of("positive")) > 0) & F.coalesce(F.array_max(of("ratio")) <= 1, F.lit(True))
        for c in UUIDS[_ANALYSIS]:
            ok = ok & v[c].rlike(UUID)
        for c in ("package_name", "analyzer_version", "tshark_version"):
            ok = ok & (F.trim(v[c]) != "")
        ok = ok & v["scenario"].isin("upload", "download") & v["capture"]["capture_format"].isin("pcap", "pcapng") & v["verified_sha256"].rlike("^[0-9a-f]{64}$") & F.coalesce(v["source_analyzer"] == "tshark", F.lit(True))
        return ok & _instant(v["analyzed_at"]).isNotNull() & F.coalesce(F.forall(v["capture"]["analysis_warnings"], lambda x: F.trim(x) != ""), F.lit(True))

    # parsed once, whatever number of fields is looked at
    return shape & F.get_json_object(p, "$.analyzed_at").rlike(AWARE) & F.transform(F.array(F.from_json(p, _untimed(schema))), ranges)[0]


def _shape(schema: str) -> str:
    """A pattern over the type of a whole payload: its fields, no more and no fewer, whole numbers as such."""
    kinds = {"bigint": "BIGINT", "int": "BIGINT", "boolean": "BOOLEAN", "double": r"(BIGINT|DOUBLE|DECIMAL\(\d+, ?\d+\))"}
    fields = dict(f.split(" ") for f in schema.split(", "))
    parts = [f"{name}: {f'({kind}|VOID)' if name in OPTIONAL else kind}" for name, kind in sorted((name, kinds.get(kind, "STRING")) for name, kind in fields.items())]
    return f"^OBJECT<{', '.join(parts)}>$"


def _payload_ok(event_type: str, schema: str, v: Column) -> Column:
    """What a payload of the right shape holds: ranges, texts that aren't blank, times with a zone. v has its fields, each read once."""
    ok = F.lit(True)
    for field in schema.split(", "):
        name, kind = field.split(" ")
        text = v[name]
        good = {
            "string": (F.trim(text) != "") | ((text != "") & F.lit(name in LENIENT.get(event_type, ()))) | F.lit(name in BLANK), "bigint": text >= 0, "int": text >= 0,
            "timestamp": text.rlike(AWARE) & _instant(text).isNotNull(), "date": text.try_cast("date").isNotNull(),
        }.get(kind, F.lit(True))
        good = F.coalesce(good, F.lit(False))
        ok = ok & ((good | text.isNull()) if name in OPTIONAL else good)
    for name in UUIDS.get(event_type, ()):
        ok = ok & v[name].rlike(UUID)
    if event_type == "network.capture.ready":
        ok = ok & v["scenario"].isin("upload", "download") & v["capture_format"].isin("pcap", "pcapng") & v["expected_sha256"].rlike("^[0-9a-f]{64}$") & (v["capture_size_bytes"] > 0) & (v["transfer_file_size_bytes"] > 0)
    if TABLES.get(event_type, event_type) == "app_stats_collected":
        ok = ok & v["score"].between(0, 5)
    if TABLES.get(event_type, event_type) == "review_observed":
        ok = ok & v["score"].between(1, 5) & v["position"].between(1, 1000)
    return F.coalesce(ok, F.lit(False))


def _fields(schema: str) -> str:
    """A payload's fields as a struct's type; whole numbers are long, times text."""
    wide = {"int": "bigint", "timestamp": "string", "date": "string"}
    return f"struct<{', '.join(f'{name}: {wide.get(kind, kind)}' for name, kind in (f.split(' ') for f in schema.split(', ')))}>"


def classify(messages: DataFrame, contracts: dict[str, tuple[str, str]] = CONTRACTS) -> DataFrame:
    """Messages (key, value, topic, partition, offset) with event_id, event_type, occurred_at, payload and `reason`; NULL where the event is good.

    Each step is compiled to a method of its own, of a size that the JVM compiles in turn (8000 bytes); that is why keys are
    sorted by sort_array, each kind of payload has a step, and so have analyses, whose check Spark only interprets.
    """
    get = lambda path, kind="string": F.try_variant_get("_v", path, kind)
    d = _once(messages, _text=F.col("value").cast("string"), _v=F.try_parse_json(F.col("value").cast("string")))
    d = _once(d, event_id=get("$.event_id"), event_type=get("$.event_type"), _version=F.schema_of_variant(get("$.schema_version", "variant")), schema_version=get("$.schema_version", "int"), occurred_at=get("$.occurred_at"), _p=get("$.payload", "variant"))
    d = _once(d, _type=F.schema_of_variant("_p"))
    topic = F.lit(None).cast("string")
    alike: dict[tuple, list[str]] = {}  # event types of one table, schema and strictness are checked by the same expression
    for name, (where, schema) in contracts.items():
        topic = F.when(F.col("event_type") == name, where).otherwise(topic)
        alike.setdefault((TABLES.get(name, name), schema, name in UUIDS), []).append(name)
    fields = {schema: f"_f{k}" for k, schema in enumerate(dict.fromkeys(schema for name, (_, schema) in contracts.items() if name != _ANALYSIS))}
    of = {schema: F.col("event_type").isin(*(name for name, (_, other) in contracts.items() if other == schema)) for schema in fields}
    d = _once(d, **{at: F.when(of[schema] & F.col("_type").rlike(_shape(schema)), F.try_variant_get("_p", "$", _fields(schema))) for schema, at in fields.items()})
    good = F.lit(False)
    for k, ((_, schema, _), names) in enumerate(alike.items()):
        ok = F.coalesce(_analysis_ok(schema), F.lit(False)) if names[0] == _ANALYSIS else F.col(fields[schema]).isNotNull() & _payload_ok(names[0], schema, F.col(fields[schema]))
        d = _once(d, **{f"_ok{k}": F.when(F.col("event_type").isin(*names), ok)})
        good = F.coalesce(F.col(f"_ok{k}"), good)
    d = _once(d, _good=good)
    envelope = F.col("event_id").rlike(UUID) & F.col("occurred_at").rlike(AWARE) & _instant(F.col("occurred_at")).isNotNull()
    utf8 = F.is_valid_utf8(F.col("key").cast("string"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    # what isn't an object has no keys
    conditions = [
        F.col("value").isNull(), F.col("_v").isNull(), no(same_keys(F.col("_text"), KEYS)), no(F.col("event_type").isin(*contracts)), no((F.col("_version") == "BIGINT") & (F.col("schema_version") == 1)), no(topic == F.col("topic")),
        no(envelope) | no(F.col("_good")), F.col("key").isNull(), no(utf8), no(F.try_variant_get("_p", "$.application_id", "string") == F.col("key").cast("string")),
    ]
    reason = F.lit(None).cast("string")
    for bad, name in reversed([*zip(conditions, REASONS, strict=True)]):
        reason = F.when(bad, name).otherwise(reason)
    columns = [*messages.columns, "event_id", "event_type", "schema_version", "occurred_at"]
    return _once(d, reason=reason).select(*columns, F.to_json("_p").alias("payload"), "reason")


def split_invalid(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and the rest with their reason."""
    return classified.where("reason is null").drop("reason"), classified.where("reason is not null")


def claim(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """Events that no earlier one has claimed, neither by event_id nor by place; of equals within a batch the first place."""
    place = ["topic", "partition", "offset"]
    first = lambda d, keys: d.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*place))).where("_k = 1").drop("_k")
    fresh = batch.join(ledger.select("event_id"), "event_id", "left_anti").join(ledger.select(*place), place, "left_anti")
    return first(first(fresh, place), ["event_id"]).select(*batch.columns)


def decoded(events: DataFrame, event_type: str | list[str], contracts: dict[str, tuple[str, str]] = CONTRACTS) -> DataFrame:
    """The payloads of one event type, or of some with one schema, as typed columns, beside their event's place; an analysis as one wide row."""
    names = [event_type] if isinstance(event_type, str) else list(event_type)
    d = events.where(F.col("event_type").isin(*names))
    schema = contracts[names[0]][1]
    d = d.select("event_id", "topic", "partition", "offset", F.from_json("payload", _untimed(schema)).alias("p")).select("event_id", "topic", "partition", "offset", "p.*")
    d = d.withColumns({c: _instant(F.col(c)) for c in re.findall(r"(\w+) timestamp(?:,|$)", schema)})
    if names[0] == _ANALYSIS:
        return flatten_analysis(d).withColumns({"source_analyzer": F.coalesce("source_analyzer", F.lit("tshark")), "analysis_warnings": F.coalesce("analysis_warnings", F.array().cast("array<string>"))})
    return d.withColumnRenamed("expected_sha256", "capture_sha256")


def routed(events: DataFrame, contracts: dict[str, tuple[str, str]] = CONTRACTS) -> dict[str, DataFrame]:
    """For each table the typed rows of its event types; those with one schema are read together, as each read works the events out anew."""
    alike: dict[tuple[str, str], list[str]] = {}
    for event_type, (_, schema) in contracts.items():
        alike.setdefault((TABLES.get(event_type, event_type), schema), []).append(event_type)
    parts: dict[str, DataFrame] = {}
    for (table, _), names in alike.items():
        rows = decoded(events, names, contracts)
        parts[table] = parts[table].unionByName(rows, allowMissingColumns=True) if table in parts else rows
    return parts


def upsert_reviews(batch: DataFrame, current: DataFrame, key: tuple[str, ...] = ("application_id", "external_review_id"), arrival: tuple[str, ...] = ("partition", "offset")) -> DataFrame:
    """The whole current state after a batch: an observation wins if it isn't older than the state; ties go to the later arrival; first sights only go back.

    current has the key, first_observed_at, last_observed_at and the batch's other columns.
    """
    keys = list(key)
    rest = [c for c in current.columns if c not in (*keys, "first_observed_at", "last_observed_at")]
    top = F.max_by(F.struct(*rest), F.struct("observed_at", *arrival)).alias("new")
    b = batch.groupBy(*keys).agg(top, F.max("observed_at").alias("new_at"), F.min("observed_at").alias("new_first"))
    c = current.select(*keys, F.struct(*rest).alias("old"), F.col("last_observed_at").alias("old_at"), F.col("first_observed_at").alias("old_first"))
    d = c.join(b, keys, "full_outer")
    won = F.col("old_at").isNull() | F.coalesce(F.col("new_at") >= F.col("old_at"), F.lit(False))
    d = d.select(*keys, F.when(won, F.col("new")).otherwise(F.col("old")).alias("s"), F.least("old_first", "new_first").alias("first_observed_at"), F.when(won, F.col("new_at")).otherwise(F.col("old_at")).alias("last_observed_at"))
    return d.select(*keys, *(F.col(f"s.{c}").alias(c) for c in rest), "first_observed_at", "last_observed_at").select(*current.columns)


def append_observations(batch: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of a batch that aren't there yet: one for each task and review."""
    keys = ["crawl_task_id", "external_review_id"]
    return latest_per(batch, keys, ["offset"]).join(observations.select(*keys), keys, "left_anti")


def current_reviews(observed: DataFrame) -> DataFrame:
    """The state of reviews after all batches of run_ingest's review_observed table, merged as it is read: what upsert_reviews makes of one batch after the other."""
    empty = observed.limit(0).withColumns({"first_observed_at": F.col("observed_at"), "last_observed_at": F.col("observed_at")}).drop("observed_at", "event_id", "topic", "partition", "offset", "batch")
    return upsert_reviews(observed, empty, arrival=("batch", "partition", "offset"))


def kept_observations(observed: DataFrame) -> DataFrame:
    """The observations of all batches of run_ingest's review_observed table, each task and review once, as append_observations keeps them."""
    w = Window.partitionBy("crawl_task_id", "external_review_id").orderBy("batch", F.desc("offset"))
    return observed.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def require_consistent(batch: DataFrame, reference: DataFrame, on: list[str]) -> DataFrame:
    """The batch, if every row has its reference; else an error, before anything is written."""
    lost = batch.join(reference.select(*on).distinct(), on, "left_anti")
    if not lost.isEmpty():
        raise ValueError("the batch names rows that its reference doesn't have")
    return batch


def match_ready(events: DataFrame, captures: DataFrame) -> DataFrame:
    """Ready captures whose attributes equal those of their lifecycle row."""
    same = ["application_id", "scenario", "capture_sha256", "capture_size_bytes", "transfer_file_size_bytes"]
    c = captures.select(F.col("id").alias("capture_id"), "status", *(F.col(x).alias(f"_{x}") for x in same))
    d = events.join(c, "capture_id")
    for x in same:
        d = d.where(F.col(x).eqNullSafe(F.col(f"_{x}")))
    return d.drop(*(f"_{x}" for x in same))


def claimable(captures: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Captures to analyse: uploaded ones, and those whose analysis began too long ago."""
    old = F.unix_micros(now) - F.unix_micros("analysis_started_at") > stale_seconds * 1_000_000
    return captures.where((F.col("status") == "uploaded") | ((F.col("status") == "analyzing") & F.coalesce(old, F.lit(True))))


def reconcile(captures: DataFrame, objects: DataFrame, now: Column, stale_seconds: int) -> DataFrame:
    """Each capture's status after a look at the objects (object_key, size), why it changed, and whether its event goes out again."""
    d = captures.join(objects.select("object_key", F.col("size").alias("_size")), "object_key", "left")
    late = F.coalesce(F.col("expires_at") <= now, F.lit(False)) & (F.col("status") == "pending_upload")
    there = F.col("_size").isNotNull() & (F.col("_size") == F.col("capture_size_bytes"))
    stale = (F.col("status") == "analyzing") & F.coalesce(F.unix_micros(now) - F.unix_micros("analysis_started_at") > stale_seconds * 1_000_000, F.lit(True))
    return d.withColumns({
        "new_status": F.when(late & there, "uploaded").when(late, "expired").otherwise(F.col("status")), "change_reason": F.when(late & F.col("_size").isNull(), "object_missing").when(late & ~there, "object_size_mismatch"),
        "emit": (late & there) | (F.col("status") == "uploaded") | stale,
    }).drop("_size")


def cleanable(captures: DataFrame, terminal: tuple[str, ...] = ("analyzed", "failed", "expired")) -> DataFrame:
    """Objects of which every reference has ended."""
    return captures.groupBy("object_key").agg(F.bool_and(F.col("status").isin(*terminal)).alias("done"), F.count(F.lit(1)).alias("captures")).where("done").drop("done")


def retryable(captures: DataFrame) -> DataFrame:
    """Failed captures whose object is kept."""
    return captures.where((F.col("status") == "failed") & F.col("object_deleted_at").isNull())


def dedupe_captures(captures: DataFrame) -> DataFrame:
    """One capture for each application, scenario and checksum, the first; with whether later ones disagree on its sizes."""
    keys = ["application_id", "scenario", "capture_sha256"]
    w = Window.partitionBy(*keys)
    facts = F.struct("capture_size_bytes", "transfer_file_size_bytes")
    d = captures.withColumns({"copies": F.count(F.lit(1)).over(w), "conflict": F.min(facts).over(w) != F.max(facts).over(w), "_k": F.row_number().over(w.orderBy("created_at", "id"))})
    return d.where("_k = 1").drop("_k")


def task_references(tasks: Callable[[], DataFrame], captures: Callable[[], DataFrame] | None = None) -> dict[str, tuple[Callable[[], DataFrame], list[str]]]:
    """What run_ingest checks as `references`: snapshots and observations belong to a task of their kind and application, analyses to a capture in the same state.

    tasks has id, application_id and task_type; captures id, analysis_id, application_id, package_name, scenario and
    verified_sha256. Both are asked for anew in each batch.
    """
    of = lambda kind: lambda: tasks().where(F.col("task_type") == kind).select(F.col("id").alias("crawl_task_id"), "application_id")
    out: dict = {"app_stats_collected": (of("app_details"), ["crawl_task_id", "application_id"]), "review_observed": (of("reviews"), ["crawl_task_id", "application_id"])}
    if captures is not None:
        out["network_analysis_collected"] = (lambda: captures().withColumnRenamed("id", "capture_id"), ["capture_id", "analysis_id", "application_id", "package_name", "scenario", "verified_sha256"])
    return out


_REVIEW_KEY = ["application_id", "external_review_id"]
_REVIEW_STATE = "application_id string, external_review_id string, source_at timestamp, author_name string, thumbs_up_count bigint, score int, content string, source_adapter string, first_observed_at timestamp, last_observed_at timestamp"


def review_state(spark: SparkSession, root: str) -> KeyedTable:
    """The reviews as run_ingest has them now: one row each, by upsert_reviews batch after batch."""
    return KeyedTable(spark, f"{root}/state/reviews", _REVIEW_STATE, _REVIEW_KEY)


def observation_state(spark: SparkSession, root: str) -> KeyedTable:
    """One observation for each task and review, the first that came."""
    return KeyedTable(spark, f"{root}/state/observations", "crawl_task_id string, application_id string, external_review_id string, observed_at timestamp, position int, score int, thumbs_up_count bigint, content string, source_at timestamp, source_adapter string", ["crawl_task_id", *_REVIEW_KEY])


def snapshot_state(spark: SparkSession, root: str) -> KeyedTable:
    """One snapshot for each task, the first that came."""
    return KeyedTable(spark, f"{root}/state/snapshots", _APP_STATS, ["crawl_task_id"])


def merge_states(spark: SparkSession, root: str, parts: dict[str, DataFrame], version: int) -> None:
    """Brings the states to a version by what a batch has for them; of equal keys in a batch the first place counts."""
    place = ["topic", "partition", "offset"]

    def first(rows: DataFrame, table: KeyedTable) -> DataFrame:
        columns = [c.split(" ")[0] for c in table.schema.split(", ")]
        return rows.groupBy(*table.keys).agg(F.min_by(F.struct(*(c for c in columns if c not in table.keys)), F.struct(*place)).alias("_r")).select(*table.keys, "_r.*").select(*columns)

    if "review_observed" in parts:
        rows = parts["review_observed"]
        review_state(spark, root).merge(rows, version, upsert_reviews)
        seen = observation_state(spark, root)
        seen.merge(first(rows, seen), version, lambda b, c: insert_new(b, c, seen.keys))
    if "app_stats_collected" in parts:
        snapshots = snapshot_state(spark, root)
        snapshots.merge(first(parts["app_stats_collected"], snapshots), version, lambda b, c: insert_new(b, c, snapshots.keys))


def _adopt_ledger(spark: SparkSession, claims: Claims, path: str, stream_id: str, number: int) -> None:
    """Claims what a ledger without claims has: all of it for a new checkpoint, else the batches before this one."""
    known = spark.read.parquet(path)
    last = known.agg(F.max("batch")).first()[0]
    if last is None or number == last == 0:
        return  # the first batch came no further than its ledger, and runs again
    before = number - 1 if number else last
    claims.commit(known.where(F.col("batch") <= before), before, stream_id if number else "", before)


def run_ingest(
    stream: DataFrame, root: str, checkpoint: str, handlers: dict[str, Callable[[DataFrame], DataFrame]] | None = None, once: bool = True, references: dict[str, tuple[Callable[[], DataFrame], list[str]]] | None = None
) -> StreamingQuery:
    """Runs a stream of messages into tables under root: ledger, quarantine, one for each kind of event (TABLES), claims and states.

    handlers may turn an event type's typed rows into what is stored, and raise to stop the batch before it is written.
    references: for a table, what gives the rows that each of its own must have, and the columns on which (see
    task_references); a row without one stops the batch, and leaves no claim. Event tables only grow, and aren't read
    again: what is known of earlier batches is in claims and in the states (review_state, observation_state,
    snapshot_state), of which a batch reads and rewrites the buckets that its keys fall in. Each batch's rows are in a
    folder of its version, which a rerun overwrites. A ledger without claims, of an earlier release, is claimed first.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        stream_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
        claims, folder = Claims(spark, f"{root}/claims"), Folder(spark, root)
        if not claims.ids.versions() and folder.exists("ledger"):
            _adopt_ledger(spark, claims, f"{root}/ledger", stream_id, number)
        version = claims.version(stream_id, number)
        classified = classify(df).persist()
        try:
            good, bad = split_invalid(classified)
            fresh = claims.fresh(good, version).persist()
            by_table = {TABLES.get(name, name): f for name, f in (handlers or {}).items()}
            parts = {name: by_table.get(name, lambda d: d)(part) for name, part in routed(fresh).items()}
            for name, (rows, on) in (references or {}).items():
                if name in parts:
                    require_consistent(parts[name], rows(), on)
            bad.drop("payload").write.mode("overwrite").parquet(f"{root}/quarantine/batch={version}")
            for name, part in parts.items():
                part.write.mode("overwrite").parquet(f"{root}/{name}/batch={version}")
            merge_states(spark, root, {name: spark.read.parquet(f"{root}/{name}/batch={version}") for name in ("review_observed", "app_stats_collected") if name not in by_table}, version)
            fresh.select("event_id", "event_type", "schema_version", "topic", "partition", "offset", F.current_timestamp().alias("ingested_at")).write.mode("overwrite").parquet(f"{root}/ledger/batch={version}")
            claims.commit(fresh, version, stream_id, number)
            fresh.unpersist()
        finally:
            classified.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
