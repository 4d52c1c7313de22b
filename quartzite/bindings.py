"""The engine's tables as views on the test tables, in SQL that Spark and DuckDB both read.

Every role is derived from the rows of a test table, so its size follows theirs. {name} stands for a table or an earlier
role.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: The instant to which ages refer.
AS_OF = "2024-02-01 00:00:00"

ROLES: dict[str, str] = {
    "ev": """SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type, value, CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS BIGINT) AS k FROM {events}""",
    "applications": """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, 'com.app.n' || CAST(c_custkey AS STRING) AS package_name, c_custkey % 7 <> 0 AS is_active,
        CASE WHEN c_custkey % 3 <> 0 THEN 'en' END AS language_code, CASE WHEN c_custkey % 3 <> 0 THEN 'ir' END AS country_code, CAST('2023-12-01 00:00:00' AS TIMESTAMP) AS created_at FROM {customer}""",
    "categories": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'cat_' || n_name AS code, n_name AS name FROM {nation}",
    "application_categories": """SELECT CAST(c_custkey AS STRING) AS application_id, CAST(c_nationkey AS BIGINT) AS category_id, TRUE AS is_primary FROM {customer} WHERE c_custkey % 11 <> 0
        UNION ALL SELECT CAST(c_custkey AS STRING), CAST((c_nationkey + 1) % 25 AS BIGINT), c_custkey % 4 = 0 FROM {customer} WHERE c_custkey % 2 = 0""",
    "crawl_tasks": """SELECT 't' || CAST(event_id AS STRING) AS id, CAST(CAST(ts AS DATE) AS STRING) AS crawl_run_id, CAST(user_id AS STRING) AS application_id,
        CASE WHEN event_type IN ('purchase', 'signup') THEN 'reviews' ELSE 'app_details' END AS task_type,
        CASE WHEN event_type = 'error' OR k = 1 THEN 'failed' WHEN k = 2 THEN 'running' ELSE 'succeeded' END AS status,
        CASE WHEN event_id % 5 = 0 THEN 'us' ELSE 'ir' END AS country_code, CASE WHEN event_id % 5 = 0 THEN 'en' ELSE 'fa' END AS language_code, ts AS started_at,
        CASE WHEN k % 3 = 0 THEN ts + INTERVAL '30' SECOND WHEN k % 3 = 1 THEN ts + INTERVAL '90' SECOND END AS finished_at, 1 + k % 3 AS attempt_count,
        CASE WHEN event_type = 'error' AND k % 4 <> 0 THEN 'E' || CAST(k % 30 AS STRING) END AS error_code FROM {ev}""",
    "crawl_runs": """SELECT crawl_run_id AS id, min(started_at) AS started_at, CASE WHEN count(*) % 3 <> 0 THEN max(finished_at) END AS finished_at,
        CASE WHEN count(*) % 5 = 0 THEN 'running' ELSE 'partially_failed' END AS status FROM {crawl_tasks} GROUP BY crawl_run_id""",
    "playstore_app_snapshots": """SELECT event_id AS id, 't' || CAST(event_id AS STRING) AS crawl_task_id, CAST(user_id AS STRING) AS application_id, ts AS collected_at,
        CASE WHEN k % 17 <> 0 THEN CAST(k % 50 AS DOUBLE) / 10 END AS score, k AS ratings_count, CAST(floor(k / 2) AS BIGINT) AS reviews_count, CAST(1000 * (1 + floor(k / 20)) AS BIGINT) AS min_installs,
        CASE WHEN k % 5 <> 0 THEN CAST(ts AS DATE) END AS store_updated_on, 'v' || CAST(k % 3 AS STRING) AS version, k % 2 = 0 AS ad_supported, 'adapter' AS source_adapter FROM {ev} WHERE event_type IN ('click', 'view', 'error')""",
    "review_observations": """SELECT 't' || CAST(event_id AS STRING) AS crawl_task_id, user_id * 10 + k % 10 AS review_id, ts AS observed_at, 1 + k % 100 AS position, 1 + CAST(floor(k / 10) AS BIGINT) % 5 AS score, k AS thumbs_up_count, 'adapter' AS source_adapter,
        CASE WHEN k % 5 = 0 THEN 'pending' WHEN k % 11 = 1 THEN 'skipped' WHEN k % 13 = 2 THEN 'failed' ELSE 'done' END AS sentiment_status,
        CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'positive' WHEN k % 3 = 1 THEN 'neutral' ELSE 'negative' END AS sentiment_label,
        CASE WHEN k % 4 = 0 THEN NULL WHEN k % 2 = 0 THEN 'en' ELSE 'fa' END AS sentiment_language FROM {ev} WHERE event_type IN ('purchase', 'signup')""",
    "reviews": """SELECT review_id AS id, CAST(CAST(floor(review_id / 10) AS BIGINT) AS STRING) AS application_id, 'r' || CAST(review_id AS STRING) AS external_review_id, min(observed_at) AS source_at,
        min(observed_at) AS first_observed_at, max(observed_at) AS last_observed_at, count(*) AS versions FROM {review_observations} GROUP BY review_id""",
    "ord": """SELECT o_orderkey AS o, o_totalprice AS p, CAST(floor(o_orderkey / 12) AS BIGINT) AS g, o_orderkey % 12 AS a, CAST(floor(o_orderkey / 240) AS BIGINT) % 4 AS e,
        CAST('2024-01-01 06:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(CASE WHEN CAST(floor(o_orderkey / 240) AS BIGINT) % 4 = 0 THEN o_orderkey % 14 ELSE 15 + o_orderkey % 14 END AS INT) AS seen FROM {orders}""",
    "network_captures": """SELECT 'c' || CAST(o AS STRING) AS id, CAST(CASE WHEN o % 53 = 0 THEN 99 ELSE a END AS STRING) AS application_id, CASE WHEN g % 2 = 0 THEN 'upload' ELSE 'download' END AS scenario,
        CASE WHEN o % 13 = 0 THEN 'uploaded' WHEN o % 17 = 0 THEN 'failed' WHEN o % 71 = 0 THEN 'analyzing' ELSE 'analyzed' END AS status, 1000 + o % 977 AS capture_size_bytes, 1048576 * (1 + g % 2) AS transfer_file_size_bytes,
        'h' || CAST(o % 4001 AS STRING) AS capture_sha256, 'k' || CAST(o % 4001 AS STRING) AS object_key, seen AS created_at, seen + INTERVAL '1' HOUR AS uploaded_at FROM {ord} WHERE o % 43 <> 0""",
    "network_analysis_results": """SELECT 'c' || CAST(o AS STRING) AS capture_id, CAST(a AS STRING) AS application_id, 'com.app.n' || CAST(a AS STRING) AS package_name,
        CASE WHEN o % 61 = 0 THEN 'other' WHEN g % 2 = 0 THEN 'upload' ELSE 'download' END AS scenario, seen + INTERVAL '2' HOUR AS analyzed_at, 1000.0 + o % 500 AS capture_duration_ms,
        CASE WHEN o % 29 = 0 THEN 1 ELSE 0 END AS truncated_packet_count, CASE WHEN o % 31 <> 0 THEN o % 7 <> 0 END AS comparison_ready, o % 37 <> 0 AS direction_metadata_available,
        o % 3 = 0 AS handshake_observed, o % 5 <> 0 AS tcp_present, o % 5 = 0 OR o % 9 = 0 AS quic_present, o % 4 = 0 AS other_udp_present, o % 5 <> 0 AND o % 6 <> 0 AS tcp_rtt_available, o % 10 = 0 AS quic_initial_rtt_available,
        o % 20 = 0 AS quic_spin_rtt_available, o % 2 = 0 AS dns_metrics_available, CAST(CASE WHEN o % 41 <> 0 THEN 100.0 + o % 900 END AS DOUBLE) AS observed_primary_payload_span_ms,
        CASE WHEN o % 41 <> 0 THEN p / 10000 END AS effective_file_throughput_mbps, p / 20000 AS average_network_throughput_mbps, CASE WHEN o % 47 <> 0 THEN 1 + p / 1000000 END AS total_transfer_amplification_ratio,
        1 + p / 2000000 AS primary_direction_amplification_ratio, p / 3000000 AS reverse_path_cost_ratio, o % 1000 AS network_bytes_total, CASE WHEN o % 19 <> 0 THEN p / 4000000 END AS ip_transport_header_overhead_ratio,
        CASE WHEN o % 5 <> 0 THEN o % 8 END AS tcp_connection_count, CASE WHEN o % 5 <> 0 THEN CAST(o % 8 AS DOUBLE) / 8 END AS tcp_handshake_success_rate, CASE WHEN o % 5 <> 0 THEN p / 5000 END AS tcp_initial_rtt_avg_ms, CASE WHEN o % 5 <> 0 THEN p / 6000 END AS tcp_initial_rtt_p50_ms,
        CASE WHEN o % 5 <> 0 THEN p / 3000 END AS tcp_ack_rtt_p95_ms, CASE WHEN o % 5 <> 0 THEN o % 6 END AS tcp_retransmission_count, CASE WHEN o % 5 <> 0 THEN CAST(o % 6 AS DOUBLE) / 6 END AS tcp_retransmission_rate,
        CASE WHEN o % 5 <> 0 AND o % 23 <> 0 THEN p / 7000000 END AS tcp_recovery_tax, CASE WHEN o % 5 <> 0 THEN p / 8000000 END AS tcp_receiver_stall_ratio, CASE WHEN o % 5 <> 0 THEN p / 9000000 END AS tcp_reset_rate,
        CAST(o % 11 AS DOUBLE) / 11 AS tcp_byte_share, CAST(o % 10 AS DOUBLE) / 10 AS quic_byte_share, CAST(o % 9 AS DOUBLE) / 9 AS other_udp_byte_share, o % 4 AS analysis_warning_count FROM {ord} WHERE o % 43 <> 0 AND o % 67 <> 0""",
    "experiment_manifest": """SELECT CASE WHEN o % 73 = 0 THEN 'x' ELSE 'c' END || CAST(o AS STRING) AS capture_id, 'e' || CAST(e AS STRING) AS experiment_id, 's' || CAST(CAST(floor(o / 480) AS BIGINT) % 5 AS STRING) AS session_id,
        g % 20 AS trial_number, CASE WHEN a < 6 THEN 'p' || CAST(g AS STRING) || '_' || CAST(CAST(floor(a / 2) AS BIGINT) AS STRING) END AS pair_id, 'com.app.n' || CAST(a AS STRING) AS application_package,
        CASE WHEN g % 2 = 0 THEN 'upload' ELSE 'download' END AS scenario, seen AS capture_started_at_utc, seen + INTERVAL '10' MINUTE AS capture_finished_at_utc, o % 59 <> 0 AS transfer_completed,
        'file_' || CAST(g % 2 AS STRING) AS file_cohort_id, 1048576 * (1 + g % 2) AS test_file_size_bytes, CASE WHEN e = 0 AND o % 79 <> 0 THEN '1.0' ELSE '2.0' END AS app_version, 'device' AS device_model,
        CASE WHEN o % 83 = 0 THEN '13' ELSE '14' END AS android_version, 'wifi' AS network_type, 'profile_' || CAST(g % 2 AS STRING) AS network_profile, 'tool' AS capture_tool, '1' AS capture_tool_version,
        o % 89 <> 0 AS capture_isolation_confirmed, o % 97 <> 0 AS cache_cleared_or_download_verified, CASE WHEN e % 2 = 0 THEN 'before' ELSE 'after' END AS experiment_phase,
        CASE WHEN a < 6 THEN 'cohort_' || CAST(CAST(floor(a / 2) AS BIGINT) AS STRING) END AS comparison_cohort_id FROM {ord}""",
    "release_manifest": """SELECT 'rel' || CAST(n_nationkey AS STRING) AS release_event_id, 'com.app.n' || CAST(n_nationkey AS STRING) AS application_package, '1.0' AS previous_version, '2.0' AS new_version,
        DATE '2024-01-15' AS release_date, CASE WHEN n_nationkey % 7 = 6 THEN 'month' ELSE 'day' END AS release_date_precision, n_nationkey % 9 <> 8 AS release_date_verified, DATE '2024-01-01' AS baseline_start, DATE '2024-01-14' AS baseline_end,
        CASE WHEN n_nationkey % 11 <> 10 THEN DATE '2024-01-16' END AS followup_start, CASE WHEN n_nationkey % 11 <> 10 THEN DATE '2024-01-29' END AS followup_end,
        'e0' AS experiment_id_before, CASE WHEN n_nationkey % 5 <> 4 THEN 'e1' END AS experiment_id_after FROM {nation}""",
    "capabilities": """SELECT CASE WHEN count(*) = 0 THEN 'NETWORK_EMPTY' ELSE 'NETWORK_COMPARISON_READY' END AS network_state, 'VERIFIED_EXPERIMENT_AVAILABLE' AS experiment_state, 'RELEASE_METADATA_AVAILABLE' AS release_state,
        'SENTIMENT_DATA_AVAILABLE' AS sentiment_state, 'ANNOTATIONS_UNAVAILABLE' AS topic_state FROM {network_captures}""",
    "packets": """SELECT 'cap' || CAST(user_id AS STRING) AS capture_id, event_id AS packet_no, CAST(event_id AS DOUBLE) / 64 + CAST(k AS DOUBLE) / 1024 AS timestamp, 60 + k * 10 AS frame_len, CASE WHEN event_id % 211 = 0 THEN 50 ELSE 60 + k * 10 END AS captured_len,
        CASE WHEN user_id % 10 = 3 AND k % 20 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 'tx' ELSE 'rx' END AS direction, CAST(CASE WHEN k % 33 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 6 ELSE 4 END AS INT) AS ip_version, 40 + k * 10 AS network_bytes,
        CASE WHEN event_id % 2 = 0 THEN '10.0.0.1' ELSE '93.0.0.' || CAST(k % 3 AS STRING) END AS src_ip, CASE WHEN event_id % 2 = 0 THEN '93.0.0.' || CAST(k % 3 AS STRING) ELSE '10.0.0.1' END AS dst_ip,
        CAST(CASE WHEN event_id % 2 = 0 THEN 5000 + k % 2 ELSE 443 END AS INT) AS src_port, CAST(CASE WHEN event_id % 2 = 0 THEN 443 ELSE 5000 + k % 2 END AS INT) AS dst_port,
        CASE WHEN event_type IN ('click', 'view') THEN 'tcp' WHEN event_type IN ('purchase', 'signup') THEN 'udp' ELSE 'other' END AS transport, CASE WHEN k % 6 = 0 THEN 0 ELSE k * 9 END AS l4_payload_bytes,
        CAST(CASE WHEN user_id % 3 = 0 THEN k % 4 END AS INT) AS tcp_stream, k % 50 = 7 AS ip_fragment, k % 40 = 9 AS ecn_ce, event_type = 'error' AND k % 4 = 0 AS icmp_error, k % 7 < 2 AS tcp_syn, k % 7 > 0 AS tcp_ack, k % 45 = 1 AS tcp_rst,
        k % 15 = 2 AS tcp_retransmission, k % 60 = 4 AS tcp_fast_retransmission, k % 70 = 5 AS tcp_spurious_retransmission, k % 8 = 3 AS tcp_zero_window, k % 30 = 6 AS tcp_window_full, k % 35 = 8 AS tcp_out_of_order, k % 36 = 9 AS tcp_duplicate_ack, k % 37 = 10 AS tcp_lost_segment,
        CAST(CASE WHEN k % 8 = 3 THEN 0 WHEN k % 5 = 0 THEN NULL ELSE 1000 END AS INT) AS tcp_window_size, CASE WHEN k % 9 = 0 THEN CAST(k AS DOUBLE) / 1024 END AS tcp_initial_rtt_seconds, CASE WHEN k % 4 = 1 THEN CAST(k AS DOUBLE) / 512 END AS tcp_ack_rtt_seconds,
        event_type = 'purchase' AND user_id % 2 = 0 AS quic, CASE WHEN k % 10 = 0 THEN '0x00000000' ELSE '0x0000000' || CAST(1 + k % 2 AS STRING) END AS quic_version, CASE WHEN k % 6 = 0 THEN 'Initial' WHEN k % 6 = 1 THEN '1' WHEN k % 31 = 2 THEN 'Retry' END AS quic_packet_type,
        CAST(CASE WHEN k % 3 <> 0 THEN k % 2 END AS INT) AS quic_spin_bit, CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN k % 2 = 0 END AS dns_is_response, CAST(CASE WHEN k % 12 = 0 THEN 3 ELSE 0 END AS INT) AS dns_response_code, CASE WHEN k % 4 = 0 THEN CAST(k AS DOUBLE) / 2048 END AS dns_time_seconds FROM {ev}""",
    "packet_captures": """SELECT 'cap' || CAST(user_id AS STRING) AS capture_id, CASE WHEN user_id % 2 = 0 THEN 'upload' ELSE 'download' END AS scenario, 1048576 * (1 + user_id % 3) AS transfer_file_size_bytes, count(*) AS events FROM {ev} GROUP BY user_id
        UNION ALL SELECT 'empty' || CAST(n_nationkey AS STRING), 'upload', 1048576, 0 FROM {nation}""",
    "texts": """SELECT event_id, user_id, event_type, k, CASE k % 7 WHEN 0 THEN 'Never updated' WHEN 1 THEN CAST(1700000000 + event_id * 3600 AS STRING) WHEN 2 THEN 'Jan 2, 2024' WHEN 3 THEN '2024-02-' || lpad(CAST(1 + k % 28 AS STRING), 2, '0') || 'T10:00:00'
        WHEN 4 THEN 'Dec 31, 2023' WHEN 5 THEN '' END AS updated, CASE k % 5 WHEN 0 THEN 'com.app.n' || CAST(k AS STRING) WHEN 1 THEN 'app' WHEN 2 THEN '1com.app' WHEN 3 THEN 'com..x' ELSE 'Org.a_b.C9' END AS package,
        CASE k % 3 WHEN 0 THEN repeat('0a', 32) WHEN 1 THEN repeat('0A', 32) ELSE 'zz' END AS digest, CASE k % 6 WHEN 0 THEN '17,4' WHEN 1 THEN '0x1f' WHEN 2 THEN '' WHEN 3 THEN 'x' WHEN 4 THEN ' 25 ,1' END AS whole,
        CASE k % 4 WHEN 0 THEN '2.5,1' WHEN 1 THEN 'False' WHEN 2 THEN '0' END AS part, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'fa' END AS language, CAST(k AS DOUBLE) / 50 - 1 AS compound,
        CASE WHEN k % 9 = 0 THEN NULL ELSE 'né' || event_type || CAST(k AS STRING) END AS note,
        CASE k % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'hello there' WHEN 2 THEN 'salam donya' WHEN 3 THEN '12 34 a' WHEN 4 THEN 'guten tag' ELSE 'hmm maybe' END AS said FROM {ev}""",
    "outcomes": """SELECT crawl_task_id, review_id, CASE WHEN review_id % 7 = 0 THEN NULL ELSE 'text ' || CAST(position % 3 AS STRING) END AS content, sentiment_status, sentiment_label, sentiment_language, observed_at AS sentiment_processed_at,
        CAST(position % 3 AS INT) AS sentiment_attempt_count FROM {review_observations}""",
    "faulty_manifest": """SELECT '00000000-0000-4000-8000-' || lpad(CAST(o AS STRING), CASE WHEN o % 103 = 0 THEN 11 ELSE 12 END, '0') AS capture_id, '10000000-0000-4000-8000-' || lpad(CAST(e AS STRING), 12, '0') AS experiment_id,
        CASE WHEN o % 109 = 0 THEN '' ELSE '30000000-0000-4000-8000-' || lpad(CAST(CAST(floor(o / 480) AS BIGINT) % 5 AS STRING), 12, '0') END AS session_id, CAST(CASE WHEN o % 113 = 0 THEN 0 ELSE 1 + g % 20 END AS INT) AS trial_number,
        CASE WHEN a < 6 THEN '20000000-0000-4000-8000-' || lpad(CAST(g * 3 + CAST(floor(a / 2) AS BIGINT) AS STRING), 12, '0') END AS pair_id, CASE WHEN o % 127 = 0 THEN 'bad' ELSE 'com.app.n' || CAST(CASE WHEN o % 12 = 1 AND g % 5 = 0 THEN a - 1 ELSE a END AS STRING) END AS application_package,
        CASE WHEN o % 131 = 0 THEN 'sideload' WHEN g % 2 = 0 THEN 'upload' ELSE 'download' END AS scenario, seen AS capture_started_at_utc, CASE WHEN o % 137 = 0 THEN seen ELSE seen + INTERVAL '10' MINUTE END AS capture_finished_at_utc,
        CASE WHEN o % 139 = 0 THEN 'abc' ELSE repeat('0a', 32) END AS test_file_sha256, 1048576 * (1 + g % 2) AS test_file_size_bytes, CASE WHEN o % 149 = 0 THEN ' ' ELSE 'device_' || CAST(g % 3 AS STRING) END AS device_model, 'profile_' || CAST(g % 4 AS STRING) AS network_profile,
        o % 59 <> 0 AS transfer_completed, CASE WHEN o % 151 <> 0 THEN o % 89 <> 0 END AS capture_isolation_confirmed, o % 97 <> 0 AS cache_cleared_or_download_verified, CASE WHEN o % 157 = 0 THEN NULL ELSE '1.0' END AS app_version, CASE WHEN o % 83 = 0 THEN '13' ELSE '14' END AS android_version,
        'wifi' AS network_type, 'tool' AS capture_tool, '1' AS capture_tool_version, CASE WHEN e % 2 = 0 THEN 'before' ELSE 'after' END AS experiment_phase FROM {ord}""",
    "faulty_releases": """SELECT 'rel' || CAST(c_custkey - CASE WHEN c_custkey % 20 = 1 THEN 1 ELSE 0 END AS STRING) AS release_event_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE 'com.app.n' || CAST(c_custkey % 10 AS STRING) END AS application_package, '1.0' AS previous_version,
        CASE WHEN c_custkey % 7 = 0 THEN '1.0' WHEN c_custkey % 17 = 0 THEN ' ' ELSE '2.0' END AS new_version, DATE '2024-01-15' AS release_date, CASE WHEN c_custkey % 6 = 0 THEN 'month' WHEN c_custkey % 13 = 0 THEN 'week' ELSE 'day' END AS release_date_precision,
        c_custkey % 8 <> 0 AS release_date_verified, CASE WHEN c_custkey % 5 = 0 THEN DATE '2024-01-16' END AS baseline_start, CASE WHEN c_custkey % 11 = 0 THEN DATE '2024-01-15' END AS baseline_end,
        CASE WHEN c_custkey % 10 = 3 THEN DATE '2024-01-15' END AS followup_start, CASE WHEN c_custkey % 12 = 7 THEN DATE '2024-01-10' END AS followup_end FROM {customer}""",
    "lifecycle": """SELECT id, application_id, scenario, capture_sha256, capture_size_bytes, transfer_file_size_bytes, object_key, CASE CAST(substr(id, 2) AS BIGINT) % 6 WHEN 0 THEN 'pending_upload' WHEN 1 THEN 'uploaded' WHEN 2 THEN 'analyzing' WHEN 3 THEN 'failed' WHEN 4 THEN 'analyzed' ELSE 'expired' END AS status,
        created_at + INTERVAL '1' DAY AS expires_at, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 4 <> 0 THEN created_at + INTERVAL '2' DAY END AS analysis_started_at, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 5 = 0 THEN created_at END AS object_deleted_at FROM {network_captures}""",
    "objects": "SELECT object_key, min(capture_size_bytes) AS size FROM {network_captures} WHERE CAST(substr(object_key, 2) AS BIGINT) % 3 <> 0 GROUP BY object_key",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")


def _needs(sql: str) -> set[str]:
    return set(re.findall(r"(?<!\{)\{(\w+)\}", sql))


class Bound(dict):
    """The roles as DataFrames, each made when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self.spark, self.dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        if name in BASE:
            self[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        else:
            self[name] = self.spark.sql(ROLES[name], **{n: self[n] for n in _needs(ROLES[name])})
        return self[name]


@lru_cache
def _order(names: tuple[str, ...]) -> tuple[str, ...]:
    out: list[str] = []

    def visit(name: str) -> None:
        if name in ROLES and name not in out:
            for n in sorted(_needs(ROLES[name])):
                visit(n)
            out.append(name)

    for n in names:
        visit(n)
    return tuple(out)


def with_roles(sql: str) -> str:
    """A DuckDB query in which {role} stands for a role, with the roles it needs put before it as common tables."""
    used = _order(tuple(sorted(_needs(sql))))
    plain = lambda s: s.format(**{n: n for n in _needs(s)})
    body = plain(sql).strip()
    ctes = [f"{n} AS ({plain(ROLES[n])})" for n in used]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join([*ctes, body[5:]])
    return "WITH " + ",\n".join(ctes) + "\n" + body if ctes else body
