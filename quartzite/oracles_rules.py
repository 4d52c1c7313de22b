"""The queries of catalog_rules as DuckDB SQL over the bound roles. Names of rules, messages and states are fixed values of the contract; {{ and }} are braces."""

from __future__ import annotations

from quartzite.bindings import with_roles


def _case(name: str, captures: str | None, trials: str | None, releases: str | None, observations: str | None) -> str:
    """Counts for one case; None: there is no such table, or none with the columns."""
    n = lambda table, where, none: f"(SELECT count(*) FROM {{{table}}} WHERE {where})" if where else none
    best = f"(SELECT coalesce(max(n), 0) FROM (SELECT count(*) FILTER (WHERE transfer_completed) AS n FROM {{experiment_manifest}} WHERE {trials} GROUP BY experiment_id, session_id, application_package, scenario))" if trials else "0"
    return f"SELECT '{name}' AS \"case\", {n('network_captures', captures, 'NULL')} AS c, {n('experiment_manifest', trials, '0')} AS e, {best} AS best, {n('release_manifest', releases, '0')} AS r, {n('review_observations', observations, 'NULL')} AS s"


CASES = " UNION ALL ".join([
    _case("whole", "TRUE", "TRUE", "TRUE", "sentiment_status = 'done'"), _case("thin", "status = 'failed'", "trial_number = 7", "release_date_precision = 'month'", "sentiment_status = 'failed' AND sentiment_status = 'done'"),
    _case("empty", "status = 'none'", "trial_number < 0", "release_date_precision = 'year'", "sentiment_status = 'none'"), _case("no manifest", "TRUE", None, None, "sentiment_status = 'done'"), _case("no columns", None, "TRUE", "TRUE", None),
])

UUID = "^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$"
PACKAGE = r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+$"


def broken(source: str, record: str, rules: list[tuple[str, str, str]]) -> str:
    """A row for each rule that a row breaks."""
    return " UNION ALL ".join(f"SELECT CAST({record} AS VARCHAR) AS record, '{rule}' AS rule, '{message}' AS message FROM {source} WHERE {bad}" for rule, bad, message in rules)


def blank(c: str) -> str:
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"


MANIFEST = [
    *(("required", blank(c), f"{c} is missing") for c in ("capture_id", "experiment_id", "session_id", "trial_number", "application_package", "scenario", "capture_started_at_utc", "capture_finished_at_utc", "test_file_sha256", "test_file_size_bytes", "device_model", "network_profile")),
    *(("uuid", f"NOT regexp_matches({c}, '{UUID}')", f"{c} is no UUID") for c in ("capture_id", "experiment_id", "session_id", "pair_id")),
    *(("positive", f"{c} <= 0", f"{c} must be positive") for c in ("trial_number", "test_file_size_bytes")),
    ("package", f"NOT regexp_matches(application_package, '{PACKAGE}')", "application_package is no package name"), ("hash", "NOT regexp_matches(test_file_sha256, '^[0-9a-f]{{64}}$')", "test_file_sha256 is no SHA-256"), ("enum", "scenario NOT IN ('upload', 'download')", "scenario is unknown"),
    ("order", "capture_finished_at_utc <= capture_started_at_utc", "capture must finish after its start"),
    *(("provenance", f"{c} IS NOT TRUE", f"{c} must be true") for c in ("transfer_completed", "capture_isolation_confirmed", "cache_cleared_or_download_verified")),
]
TRIAL = "experiment_id, session_id, application_package, scenario, app_version, device_model, android_version, network_type, network_profile, test_file_sha256, trial_number"
SAME = "experiment_id session_id scenario trial_number test_file_sha256 test_file_size_bytes device_model android_version network_type network_profile capture_tool capture_tool_version experiment_phase".split()
WINDOWED = """w AS (SELECT release_event_id, application_package, previous_version, new_version, release_date, release_date_precision, coalesce(baseline_start, CASE WHEN ok THEN release_date - 14 END) AS baseline_start, coalesce(baseline_end, CASE WHEN ok THEN release_date - 1 END) AS baseline_end,
 coalesce(followup_start, CASE WHEN ok THEN release_date + 1 END) AS followup_start, coalesce(followup_end, CASE WHEN ok THEN release_date + 14 END) AS followup_end FROM (SELECT *, release_date_verified AND release_date_precision = 'day' AS ok FROM {faulty_releases}))"""
RELEASES = [
    *(("required", blank(c), f"{c} is missing") for c in ("release_event_id", "application_package", "new_version", "release_date_precision")), ("enum", "release_date_precision NOT IN ('day', 'month', 'unknown')", "precision is unknown"),
    ("package", f"NOT regexp_matches(application_package, '{PACKAGE}')", "application_package is no package name"), ("versions", "previous_version = new_version", "versions must differ"), ("order", "baseline_start > baseline_end", "baseline ends before it starts"),
    ("order", "followup_start > followup_end", "follow-up ends before it starts"), ("around", "baseline_end >= release_date", "baseline must end before the release"), ("around", "followup_start <= release_date", "follow-up must start after the release"),
]
REUSED = """b AS (SELECT review_id, content, sentiment_status AS st, sentiment_label AS lb, sentiment_language AS lg FROM {outcomes} WHERE sentiment_status IN ('done', 'skipped')
 QUALIFY row_number() OVER (PARTITION BY review_id, content ORDER BY (sentiment_status = 'done') DESC, sentiment_processed_at DESC NULLS LAST, crawl_task_id) = 1),
 p AS (SELECT o.*, b.st, b.lb, b.lg FROM {outcomes} o LEFT JOIN b ON b.review_id = o.review_id AND b.content IS NOT DISTINCT FROM o.content WHERE o.sentiment_status = 'pending')"""
SPOILED = """s AS (SELECT * REPLACE (tcp_byte_share * 1.2 AS tcp_byte_share, tcp_connection_count - 1 AS tcp_connection_count, network_bytes_total - 2 AS network_bytes_total, -tcp_reset_rate AS tcp_reset_rate), network_bytes_total - 1 AS capture_size_bytes FROM {network_analysis_results})"""
COUNTS = "capture_duration_ms truncated_packet_count analysis_warning_count network_bytes_total tcp_connection_count tcp_retransmission_count total_transfer_amplification_ratio observed_primary_payload_span_ms average_network_throughput_mbps effective_file_throughput_mbps primary_direction_amplification_ratio reverse_path_cost_ratio tcp_initial_rtt_avg_ms tcp_initial_rtt_p50_ms tcp_ack_rtt_p95_ms".split()
SHARES = "ip_transport_header_overhead_ratio tcp_byte_share quic_byte_share other_udp_byte_share tcp_handshake_success_rate tcp_retransmission_rate tcp_recovery_tax tcp_receiver_stall_ratio tcp_reset_rate".split()
ANALYSES = [("enum", "scenario NOT IN ('upload', 'download')", "scenario is unknown"), ("range", "capture_size_bytes <= 0", "capture_size_bytes is out of range"), *(("range", f"{c} < 0", f"{c} is out of range") for c in COUNTS), *(("range", f"{c} NOT BETWEEN 0 AND 1", f"{c} is out of range") for c in SHARES)]
LATE = "status = 'pending_upload' AND coalesce(expires_at <= TIMESTAMP '2024-01-16', FALSE)"
STALE = "status = 'analyzing' AND coalesce(date_diff('second', analysis_started_at, TIMESTAMP '2024-01-16') > 86400, TRUE)"

SQL: dict[str, str] = {
    "fn_expressions": r"""SELECT event_id, coalesce(nullif(language, ''), 'en') AS locale, CASE WHEN regexp_matches(updated, '^[0-9]{{9,11}}$') THEN CAST(make_timestamp(TRY_CAST(updated AS BIGINT) * 1000000) AS DATE) WHEN updated LIKE '____-__-__T%' THEN TRY_CAST(substr(updated, 1, 10) AS DATE)
 WHEN updated LIKE '___ %, ____' THEN CAST(try_strptime(updated, '%b %-d, %Y') AS DATE) END AS updated_on, regexp_full_match(package, '[A-Za-z][A-Za-z0-9_]*([.][A-Za-z][A-Za-z0-9_]*)+') AS package_ok, regexp_full_match(digest, '[0-9a-f]{{64}}') AS digest_ok,
 CASE trim(split_part(whole, ',', 1)) WHEN '0x1f' THEN 31 ELSE TRY_CAST(trim(split_part(whole, ',', 1)) AS BIGINT) END AS whole, TRY_CAST(trim(split_part(part, ',', 1)) AS DOUBLE) AS part, coalesce(lower(trim(split_part(part, ',', 1))) NOT IN ('', '0', 'false', 'no'), FALSE) AS is_set,
 'file_' || substr(sha256(package || chr(31) || CAST(k AS VARCHAR)), 1, 20) AS opaque, sha256('{{"k":' || CAST(k AS VARCHAR) || ',"package":"' || package || '"}}') AS request, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS mood,
 CASE WHEN k % 10 + k % 7 >= k % 3 AND k % 10 + k % 7 >= k % 5 + k % 4 THEN 'negative' WHEN k % 3 >= k % 5 + k % 4 THEN 'neutral' ELSE 'positive' END AS collapsed, substr(note, 1, 7) AS note FROM {texts}""",
    "fn_sorted_set": "SELECT user_id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (WHERE event_type NOT IN ('error', 'view')), '') AS kinds FROM {ev} GROUP BY 1",
    "prj_allowlisted": "SELECT id, application_id, external_review_id, source_at, first_observed_at, last_observed_at FROM {reviews}",
    "win_as_of_latest": """SELECT r.release_event_id, s.id AS snapshot_id, s.score FROM {release_manifest} r JOIN {applications} a ON a.package_name = r.application_package JOIN {playstore_app_snapshots} s ON s.application_id = a.id AND s.collected_at < CAST(r.release_date AS TIMESTAMP)
 QUALIFY row_number() OVER (PARTITION BY r.release_event_id ORDER BY s.collected_at DESC, s.id DESC) = 1""",
    "flt_fixtures": "SELECT id, package_name FROM {applications} WHERE package_name NOT IN ('com.app.n1', 'com.app.n2', 'com.app.n3')",
    "flt_applications": "SELECT id, created_at FROM {applications} WHERE is_active", "flt_captures": "SELECT id, scenario, status FROM {network_captures} WHERE scenario = 'upload' AND status = 'analyzed'",
    "srt_keyset_page": "SELECT started_at, id FROM {crawl_tasks} WHERE (started_at, id) > (TIMESTAMP '2024-01-10 00:00:00', 't5') ORDER BY started_at, id LIMIT 200",
    "snk_messages": """SELECT application_id AS key, '{{"id":"' || id || '","application_id":"' || application_id || '","attempt_count":' || CAST(attempt_count AS VARCHAR) || '}}' AS value FROM {crawl_tasks}""",
    "snk_insert_absent": "SELECT id, name FROM {applications} WHERE NOT is_active",
    "snk_flatten": "SELECT capture_id, capture_duration_ms, truncated_packet_count, CASE WHEN tcp_present THEN tcp_connection_count END AS tcp_connection_count, CASE WHEN tcp_present THEN tcp_recovery_tax END AS tcp_recovery_tax FROM {network_analysis_results}",
    "src_review_responses": "SELECT event_id, CAST(n AS INTEGER) AS position, 'i' || CAST(n - 1 AS VARCHAR) || '-' || CAST(event_id AS VARCHAR) AS item FROM (SELECT event_id, unnest(generate_series(1, k % 5 + 1)) AS n FROM {ev} WHERE k % 11 <> 0)",
    "src_capture_files": """SELECT 'c' || CAST(event_id AS VARCHAR) AS capture_id, CASE WHEN k % 10 = 9 THEN 'file_missing' WHEN k % 4 = 3 THEN 'unknown_format' WHEN k % 4 = 1 AND k % 8 = 1 THEN 'format_mismatch' WHEN k % 7 = 0 THEN 'checksum_mismatch' END AS problem FROM {ev}""",
    "joi_seed_absent": "SELECT * FROM {categories}",
    "enr_identities": "SELECT DISTINCT review_id, content FROM {outcomes}",
    "enr_reuse": f"WITH {REUSED} SELECT crawl_task_id, review_id, st AS reused_status, lb AS reused_label, lg AS reused_language FROM p",
    "enr_apply_results": """SELECT crawl_task_id, review_id, CASE WHEN hit THEN 'done' ELSE sentiment_status END AS sentiment_status, CASE WHEN hit THEN 'neutral' ELSE sentiment_label END AS sentiment_label, CASE WHEN hit THEN 'en' ELSE sentiment_language END AS sentiment_language
 FROM (SELECT *, sentiment_status = 'pending' AND review_id % 2 = 0 AS hit FROM {outcomes})""",
    "enr_record_failures": """SELECT crawl_task_id, review_id, CASE WHEN hit AND sentiment_attempt_count + 1 >= 3 THEN 'failed' ELSE sentiment_status END AS sentiment_status, sentiment_attempt_count + CAST(hit AS INTEGER) AS sentiment_attempt_count
 FROM (SELECT *, sentiment_status = 'pending' AND review_id % 3 = 0 AS hit FROM {outcomes})""",
    "enr_run_stats": f"""WITH {REUSED}, z AS (SELECT *, CASE WHEN st IS NOT NULL THEN st WHEN review_id % 2 = 0 THEN 'done' WHEN sentiment_attempt_count + 1 >= 3 THEN 'failed' ELSE 'pending' END AS now FROM p)
 SELECT count(*) AS pending_observations, count(st) AS reused_results, (SELECT count(*) FROM (SELECT DISTINCT review_id, content FROM z WHERE st IS NULL)) AS newly_analyzed_texts, count(*) FILTER (WHERE now = 'done') AS done_observations, count(*) FILTER (WHERE now = 'skipped') AS skipped_observations,
 count(*) FILTER (WHERE now = 'failed') AS failed_observations, count(*) FILTER (WHERE now = 'pending') AS retry_pending_observations, CAST(1.5 AS DOUBLE) AS duration_seconds FROM z""",
    "enr_language": "SELECT event_id, CASE k % 6 WHEN 0 THEN 'too_short' WHEN 3 THEN 'too_short' WHEN 4 THEN 'unsupported' WHEN 5 THEN 'low_confidence' ELSE 'ok' END AS language_status, CASE k % 6 WHEN 1 THEN 'en' WHEN 2 THEN 'fa' END AS sentiment_language FROM {ev}",
    "enr_sentiment": """SELECT event_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 1 THEN 'negative' WHEN k % 6 = 4 THEN NULL ELSE 'neutral' END AS sentiment_label, CASE WHEN k % 5 <> 0 AND k % 6 = 4 THEN 'ValueError: unscorable' END AS sentiment_error FROM {ev}""",
    "enr_requested": """SELECT user_id || '/' || CAST(ts AS DATE) AS batch_id, count(*) + 2 AS requested, count(*) FILTER (WHERE event_id % 3 <> 0) AS received, count(*) FILTER (WHERE event_id % 3 <> 0 AND k % 50 <> 7 AND k % 40 <> 3) AS accepted,
 count(*) FILTER (WHERE event_id % 3 <> 0 AND (k % 50 = 7 OR k % 40 = 3)) AS skipped FROM {ev} GROUP BY 1""",
    "dq_manifest_rules": broken("{faulty_manifest}", "capture_id", MANIFEST),
    "dq_catalogues": """SELECT capture_id AS record, 'catalogue' AS rule, 'device_model isn''t allowed: ' || device_model AS message FROM {faulty_manifest} WHERE device_model NOT IN ('device_0', 'device_1')
 UNION ALL SELECT capture_id, 'catalogue', 'network_profile isn''t allowed: ' || network_profile FROM {faulty_manifest} WHERE network_profile NOT IN ('profile_0', 'profile_1', 'profile_2')""",
    "dq_trials": f"SELECT capture_id AS record, 'unique' AS rule, '{TRIAL} must be unique' AS message FROM {{faulty_manifest}} QUALIFY count(*) OVER (PARTITION BY {TRIAL}) > 1",
    "dq_pairs": f"""WITH g AS (SELECT pair_id, count(*) AS n, list_sort(list(DISTINCT application_package)) AS apps, {' AND '.join(f'coalesce(min({c}) = max({c}), FALSE)' for c in SAME)} AS same FROM {{faulty_manifest}} WHERE pair_id IS NOT NULL GROUP BY 1)
 {broken("g", "pair_id", [("pair_size", "n <> 2", "a pair has exactly two captures"), ("pair_applications", "len(apps) <> 2", "a pair has two applications"), ("pair_conditions", "NOT same", "conditions of a pair differ"), ("pair_cohort", "apps NOT IN (['com.app.n0', 'com.app.n1'], ['com.app.n2', 'com.app.n3'])", "the applications are no allowed cohort")])}""",
    "dq_cohort_ids": """WITH g AS (SELECT pair_id, string_agg(DISTINCT application_package, chr(31) ORDER BY application_package) AS apps FROM {faulty_manifest} WHERE pair_id IS NOT NULL GROUP BY 1)
 SELECT capture_id, 'file_' || substr(sha256(test_file_sha256 || chr(31) || CAST(test_file_size_bytes AS VARCHAR)), 1, 20) AS file_cohort_id, CASE WHEN apps IS NOT NULL THEN 'cohort_' || substr(sha256(apps), 1, 20) END AS comparison_cohort_id FROM {faulty_manifest} LEFT JOIN g USING (pair_id)""",
    "dq_default_windows": f"WITH {WINDOWED} SELECT release_event_id, application_package, baseline_start, baseline_end, followup_start, followup_end FROM w",
    "dq_release_rules": f"WITH {WINDOWED} {broken('w', 'release_event_id', RELEASES)} UNION ALL SELECT record, 'unique', 'release_event_id must be unique' FROM (SELECT release_event_id AS record, count(*) OVER (PARTITION BY release_event_id) AS n FROM w) WHERE n > 1",
    "dq_release_overlaps": f"""WITH {WINDOWED} SELECT release_event_id AS record, 'overlap' AS rule, 'analysis windows overlap' AS message FROM (SELECT *, max(followup_end) OVER (PARTITION BY application_package ORDER BY baseline_start, followup_end, release_event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest
 FROM w WHERE baseline_start IS NOT NULL AND followup_end IS NOT NULL) WHERE latest >= baseline_start""",
    "dq_analysis_results": f"WITH {SPOILED} {broken('s', 'capture_id', ANALYSES)}",
    "log_expanded": """SELECT event_id, CASE WHEN k % 13 <> 0 THEN ts END AS timestamp, 'svc' || CAST(user_id % 7 AS VARCHAR) AS service, CASE WHEN k % 13 <> 0 THEN event_type END AS event, CASE WHEN k % 13 = 0 THEN 'plain ' ELSE 'm ' END || CAST(k AS VARCHAR) AS message,
 CASE WHEN k % 13 <> 0 AND k % 3 = 0 THEN value END AS duration_seconds FROM {ev}""",
    "dq_gates": "SELECT unnest(['base', 'network', 'experiment', 'release', 'sentiment']) AS capability, unnest([TRUE, network_state NOT IN ('NETWORK_SCHEMA_MISSING', 'NETWORK_GRANTS_MISSING'), experiment_state = 'VERIFIED_EXPERIMENT_AVAILABLE', release_state = 'RELEASE_METADATA_AVAILABLE', sentiment_state = 'SENTIMENT_DATA_AVAILABLE']) AS enabled FROM {capabilities}",
    "dq_optional_columns": "SELECT crawl_task_id, review_id, CAST(NULL AS VARCHAR) AS sentiment_status, CAST(NULL AS VARCHAR) AS sentiment_label, CAST(NULL AS VARCHAR) AS sentiment_language FROM {review_observations}",
    "dq_fingerprint": """SELECT sha256(string_agg(sha256('{{"new_version":"' || new_version || '","previous_version":"' || previous_version || '","release_event_id":"' || release_event_id || '"}}'), chr(10) ORDER BY release_event_id)) AS fingerprint FROM {release_manifest}""",
    "dq_table_rules": f"""WITH s AS (SELECT * REPLACE (CAST(ratings_count AS DOUBLE) / 15 AS score, 't' || CAST(floor(id / 50) AS BIGINT) AS crawl_task_id, ratings_count - 3 AS min_installs) FROM {{playstore_app_snapshots}}),
        o AS (SELECT * REPLACE (position * 11 AS position, CASE WHEN thumbs_up_count % 50 = 7 THEN 'lost' ELSE sentiment_status END AS sentiment_status) FROM {{review_observations}}),
        v AS (SELECT * REPLACE (CASE WHEN versions % 3 = 1 THEN last_observed_at - INTERVAL 1 DAY ELSE last_observed_at END AS last_observed_at) FROM {{reviews}}),
        a AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 5 <> 0 THEN country_code END AS country, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN created_at END AS deactivated_at FROM {{applications}}),
        n AS (SELECT *, CASE WHEN capture_size_bytes % 2 = 0 THEN capture_sha256 END AS analysis_id FROM {{network_captures}})
        SELECT 'playstore_app_snapshots' AS source, * FROM ({broken('s', 'id', [("range", "score > 5", "score is out of range"), ("range", "min_installs < 0", "min_installs is out of range"), ("unique", "crawl_task_id IN (SELECT crawl_task_id FROM s GROUP BY 1 HAVING count(*) > 1)", "crawl_task_id must be unique")])})
        UNION ALL SELECT 'review_observations', * FROM ({broken('o', 'crawl_task_id', [("range", "position > 1000", "position is out of range"), ("enum", "sentiment_status = 'lost'", "sentiment_status is unknown")])})
        UNION ALL SELECT 'reviews', * FROM ({broken('v', 'id', [("order", "first_observed_at > last_observed_at", "first_observed_at is after last_observed_at")])})
        UNION ALL SELECT 'applications', * FROM ({broken('a', 'id', [("pair", "(language_code IS NULL) <> (country IS NULL)", "language_code and country_code go together"), ("state", "is_active = (deactivated_at IS NOT NULL)", "deactivated_at is set when is_active isnt")]).replace("isnt", "isn''t")})
        UNION ALL SELECT 'network_captures', * FROM ({broken('n', 'id', [("range", "transfer_file_size_bytes <= 1048576", "transfer_file_size_bytes is out of range"), ("unique", "analysis_id IN (SELECT analysis_id FROM n GROUP BY 1 HAVING count(*) > 1)", "analysis_id must be unique")])})""",
    "dq_capability_states": f"""SELECT "case", CASE WHEN c IS NULL THEN 'NETWORK_SCHEMA_MISSING' WHEN c = 0 THEN 'NETWORK_EMPTY' WHEN best >= 3 THEN 'NETWORK_COMPARISON_READY' WHEN e > 0 THEN 'NETWORK_COMPARISON_INSUFFICIENT' ELSE 'NETWORK_DATA_AVAILABLE' END AS network_state,
        CASE WHEN e > 0 THEN 'VERIFIED_EXPERIMENT_AVAILABLE' ELSE 'MANIFEST_NOT_SUPPLIED' END AS experiment_state, CASE WHEN r > 0 THEN 'RELEASE_METADATA_AVAILABLE' ELSE 'MANIFEST_NOT_SUPPLIED' END AS release_state,
        CASE WHEN s IS NULL THEN 'SENTIMENT_SCHEMA_MISSING' WHEN s > 0 THEN 'SENTIMENT_DATA_AVAILABLE' ELSE 'SENTIMENT_EMPTY' END AS sentiment_state, 'ANNOTATIONS_UNAVAILABLE' AS topic_state FROM ({CASES})""",
    "srt_listing_order": """SELECT 'capture' AS kind, id, row_number() OVER (PARTITION BY application_id ORDER BY created_at DESC, id) AS place FROM {network_captures} WHERE scenario = 'upload'
        UNION ALL SELECT 'application', id, row_number() OVER (PARTITION BY language_code ORDER BY created_at, id) FROM {applications} WHERE is_active""",
    "str_consistent": "SELECT application_id, count(*) AS tasks FROM {crawl_tasks} WHERE application_id IN (SELECT id FROM {applications}) GROUP BY 1",
    "str_match_ready": "SELECT id AS capture_id, status FROM {lifecycle} WHERE capture_size_bytes % 10 <> 0",
    "str_claimable": f"SELECT id, status FROM {{lifecycle}} WHERE status = 'uploaded' OR ({STALE})",
    "str_retryable": "SELECT id FROM {lifecycle} WHERE status = 'failed' AND object_deleted_at IS NULL",
    "str_reconcile": f"""SELECT id, CASE WHEN late AND there THEN 'uploaded' WHEN late THEN 'expired' ELSE status END AS new_status, CASE WHEN late AND size IS NULL THEN 'object_missing' WHEN late AND NOT there THEN 'object_size_mismatch' END AS change_reason, (late AND there) OR status = 'uploaded' OR stale AS emit
 FROM (SELECT l.*, o.size, {LATE} AS late, coalesce(o.size = capture_size_bytes, FALSE) AS there, {STALE} AS stale FROM {{lifecycle}} l LEFT JOIN {{objects}} o USING (object_key))""",
    "str_append_observations": """WITH s AS (SELECT 't' || CAST(CAST(floor(event_id / 4) AS BIGINT) AS VARCHAR) AS crawl_task_id, 'r' || CAST(k % 2 AS VARCHAR) AS external_review_id, event_id AS "offset", user_id FROM {ev})
 SELECT crawl_task_id, external_review_id, "offset" FROM s WHERE (crawl_task_id, external_review_id) NOT IN (SELECT crawl_task_id, external_review_id FROM s WHERE user_id % 5 = 0) QUALIFY row_number() OVER (PARTITION BY crawl_task_id, external_review_id ORDER BY "offset" DESC) = 1""",
}


def rules_sql() -> dict[str, str]:
    from quartzite.oracles import question_sql
    from quartzite.oracles_more import MORE, REASON

    out = {name: with_roles(sql) for name, sql in SQL.items()}
    out["flt_either_side"] = f"SELECT pair_id, application_a, application_b, pair_status FROM ({question_sql()['q32_paired_comparison']}) WHERE application_a = 'com.app.n1' OR application_b = 'com.app.n1'"
    out["str_current_reviews"] = with_roles(MORE["str_upsert_reviews"])
    out["dsh_ledger"] = with_roles(f"WITH {REASON} SELECT CASE WHEN event_type IN ('click', 'view', 'error') THEN 'app_stats_collected' ELSE 'review_observed' END AS event_type, count(*) AS events, max(make_timestamp((\"offset\" + 1700000000) * 1000000)) AS last_ingested_at FROM cl GROUP BY 1")
    return out
