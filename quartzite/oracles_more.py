"""Panels, logs, packets, enrichment, ingestion and quality rules as DuckDB SQL over the bound roles."""

from __future__ import annotations

from quartzite.bindings import with_roles

DUR = "date_diff('microsecond', started_at, finished_at) / 1000000.0"
RANGE = "BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
LOGS = "lg AS (SELECT ts AS timestamp, CASE WHEN k % 5 = 0 THEN 'error' WHEN k % 5 = 1 THEN 'warning' ELSE 'info' END AS level, 'svc' || (user_id % 7) AS service, event_type AS event, CASE WHEN k % 3 = 0 THEN value END AS duration_seconds FROM {ev})"
BATCH = """bt AS (SELECT user_id || '/' || CAST(ts AS DATE) AS batch_id, event_id AS position, CASE WHEN k % 50 <> 7 THEN 1 + k % 5 END AS score, k % 50 = 7 AS bad_score, k % 40 = 3 AS bad_time FROM {ev})"""
REASON = """rs AS (SELECT event_id AS "offset", user_id, event_type, k, ts, CASE WHEN k = 10 THEN 'missing_value' WHEN k = 11 THEN 'invalid_json' WHEN k = 9 THEN 'invalid_envelope' WHEN k = 7 THEN 'unsupported_event_type' WHEN k = 8 THEN 'unsupported_schema_version' WHEN k = 15 THEN 'topic_event_mismatch'
 WHEN event_type IN ('click', 'view', 'error') AND k = 6 THEN 'invalid_envelope_or_payload' WHEN k = 12 THEN 'missing_key' WHEN k = 13 THEN 'invalid_utf8_key' WHEN k = 14 THEN 'application_key_mismatch' END AS reason,
 '00000000-0000-4000-8000-' || lpad(CAST(CASE WHEN k = 5 THEN event_id - event_id % 2 ELSE event_id END AS VARCHAR), 12, '0') AS uid, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'app-stats' ELSE 'reviews' END AS tp FROM {ev}),
 cl AS (SELECT * FROM rs WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY uid ORDER BY tp, user_id % 3, "offset") = 1)"""
R = lambda n, d: f"CASE WHEN {d} > 0 THEN {n} / ({d}) END"
SPAN = lambda v: f"(sum({v} - {v} % 1) + sum({v} % 1))"
FLOW = "CASE WHEN ip_version IS NOT NULL AND src_ip IS NOT NULL AND dst_ip IS NOT NULL AND src_port IS NOT NULL AND dst_port IS NOT NULL AND transport IN ('tcp', 'udp') THEN CAST(ip_version AS VARCHAR) || transport || CASE WHEN (src_ip, src_port) <= (dst_ip, dst_port) THEN src_ip || ':' || src_port || '|' || dst_ip || ':' || dst_port ELSE dst_ip || ':' || dst_port || '|' || src_ip || ':' || src_port END END"
POS = "(timestamp, packet_no)"
AGAIN = "(tcp_retransmission OR tcp_fast_retransmission OR tcp_spurious_retransmission)"
NET = f"""WITH pk AS (SELECT *, {FLOW} AS flow, ip_version IN (4, 6) AS ip FROM {{packets}}),
 ba AS (SELECT capture_id, (max(timestamp) - min(timestamp)) * 1000 AS capture_duration_ms, count(*) AS packet_count, count(*) FILTER (WHERE captured_len < frame_len) AS truncated_packet_count, coalesce(bool_and(direction IS NOT NULL) FILTER (WHERE ip), false) AS way, count(*) FILTER (WHERE icmp_error) AS icmp_error_count,
  {", ".join(f"coalesce(sum(network_bytes) FILTER (WHERE {w}), 0) AS {n}" for w, n in (("ip", "nb"), ("ip AND direction = 'tx'", "txn"), ("ip AND direction = 'rx'", "rxn"), ("ip AND transport = 'tcp'", "tcpb"), ("ip AND quic", "qb"), ("ip AND transport = 'udp' AND NOT quic", "ub"), ("ip_version = 4", "v4"), ("ip_version = 6", "v6")))},
  {", ".join(f"coalesce(sum(l4_payload_bytes) FILTER (WHERE {w}), 0) AS {n}" for w, n in (("ip", "pb"), ("ip AND direction = 'tx'", "txp"), ("ip AND direction = 'rx'", "rxp")))}, {", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for w, n in (("ip AND direction = 'tx'", "txc"), ("ip AND direction = 'rx'", "rxc"), ("ip", "ipc"), ("ip AND ip_fragment", "fr"), ("ip AND ecn_ce", "ec")))},
  {", ".join(f"(max(timestamp) FILTER (WHERE ip AND direction = '{d}' AND l4_payload_bytes > 0) - min(timestamp) FILTER (WHERE ip AND direction = '{d}' AND l4_payload_bytes > 0)) * 1000 AS {d}s" for d in ("tx", "rx"))}, count(DISTINCT CASE WHEN direction = 'tx' THEN dst_ip ELSE src_ip END) FILTER (WHERE ip) AS rem FROM pk GROUP BY 1),
 fl AS (SELECT capture_id, flow, sum(l4_payload_bytes) AS fp FROM pk WHERE ip AND flow IS NOT NULL GROUP BY ALL), fr AS (SELECT fl.*, pb, row_number() OVER (PARTITION BY capture_id ORDER BY fp DESC) AS k, sum(fp) OVER (PARTITION BY capture_id ORDER BY fp DESC ROWS UNBOUNDED PRECEDING) AS s FROM fl JOIN ba USING (capture_id)),
 fs AS (SELECT capture_id, count(*) AS fc, max(fp) AS top, coalesce(min(k) FILTER (WHERE s >= pb * 0.8), count(*)) AS need FROM fr GROUP BY 1),
 bk AS (SELECT capture_id, max(m) AS peak, quantile_disc(m, 0.95) AS p95 FROM (SELECT capture_id, floor(timestamp), sum(network_bytes) * 8 / 1000000.0 AS m FROM pk WHERE ip GROUP BY ALL) GROUP BY 1),
 tp AS (SELECT *, coalesce('s' || tcp_stream, 'f' || flow) AS conn FROM pk WHERE ip AND transport = 'tcp'),
 hs AS (SELECT DISTINCT a.capture_id, a.conn FROM tp a JOIN tp b ON b.capture_id = a.capture_id AND b.conn = a.conn AND b.src_ip = a.dst_ip AND b.src_port = a.dst_port AND b.dst_ip = a.src_ip AND b.dst_port = a.src_port AND b.tcp_syn AND b.tcp_ack AND (b.timestamp, b.packet_no) > (a.timestamp, a.packet_no)
  JOIN tp c ON c.capture_id = a.capture_id AND c.conn = a.conn AND c.src_ip = a.src_ip AND c.src_port = a.src_port AND c.dst_ip = a.dst_ip AND c.dst_port = a.dst_port AND c.tcp_ack AND NOT c.tcp_syn AND (c.timestamp, c.packet_no) > (b.timestamp, b.packet_no) WHERE a.tcp_syn AND NOT a.tcp_ack),
 mk AS (SELECT capture_id, conn, src_ip, src_port, dst_ip, dst_port, timestamp, packet_no, tcp_zero_window AS op, lag(tcp_zero_window) OVER w AS pv, min(CASE WHEN NOT tcp_zero_window THEN timestamp END) OVER (PARTITION BY capture_id, conn, src_ip, src_port, dst_ip, dst_port ORDER BY timestamp, packet_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM tp WHERE conn IS NOT NULL AND (tcp_zero_window OR tcp_window_size > 0) WINDOW w AS (PARTITION BY capture_id, conn, src_ip, src_port, dst_ip, dst_port ORDER BY timestamp, packet_no)),
 co AS (SELECT capture_id, conn, max(timestamp) AS la, max(timestamp) - min(timestamp) AS act, bool_or(tcp_rst) AS rst, arg_min(tcp_initial_rtt_seconds * 1000, {POS}) FILTER (WHERE tcp_initial_rtt_seconds IS NOT NULL) AS rtt FROM tp WHERE conn IS NOT NULL GROUP BY ALL),
 st AS (SELECT m.capture_id, m.conn, timestamp AS b, coalesce(nx, la) AS e, nx IS NULL AS o FROM mk m JOIN co USING (capture_id, conn) WHERE op AND NOT coalesce(pv, false)),
 un AS (SELECT capture_id, conn, {SPAN('x')} AS z FROM (SELECT capture_id, conn, greatest(0, e - greatest(b, coalesce(mx, b))) AS x FROM (SELECT *, max(e) OVER (PARTITION BY capture_id, conn ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM st WHERE e > b)) GROUP BY ALL),
 cn AS (SELECT capture_id, count(*) AS cc, count(hs.conn) AS ok, avg(rtt) AS ra, quantile_disc(rtt, 0.5) AS r5, quantile_disc(rtt, 0.95) AS r9, {SPAN('coalesce(z, 0)')} * 1000 AS zd, {SPAN('act')} * 1000 AS ad, count(*) FILTER (WHERE rst) AS rs FROM co LEFT JOIN hs USING (capture_id, conn) LEFT JOIN un USING (capture_id, conn) GROUP BY 1),
 op AS (SELECT capture_id, bool_or(o) AS o FROM st GROUP BY 1),
 tt AS (SELECT capture_id, min(tcp_ack_rtt_seconds * 1000) AS am, quantile_disc(tcp_ack_rtt_seconds * 1000, 0.5) AS a5, quantile_disc(tcp_ack_rtt_seconds * 1000, 0.95) AS a9, count(*) FILTER (WHERE l4_payload_bytes > 0) AS ds, count(*) FILTER (WHERE {AGAIN}) AS rc, count(*) FILTER (WHERE tcp_fast_retransmission) AS fa, count(*) FILTER (WHERE tcp_spurious_retransmission) AS sp, coalesce(sum(l4_payload_bytes) FILTER (WHERE {AGAIN}), 0) AS rb, sum(l4_payload_bytes) AS tb,
  {", ".join(f"count(*) FILTER (WHERE {c}) AS {n}" for c, n in (("tcp_zero_window", "zc"), ("tcp_window_full", "wf"), ("tcp_out_of_order", "oo"), ("tcp_duplicate_ack", "da"), ("tcp_lost_segment", "ls")))} FROM tp GROUP BY 1),
 qk AS (SELECT * FROM pk WHERE ip AND quic), qf AS (SELECT capture_id, abs(min(timestamp) FILTER (WHERE direction = 'rx' AND lower(quic_packet_type) IN ('0', 'initial')) - min(timestamp) FILTER (WHERE direction = 'tx' AND lower(quic_packet_type) IN ('0', 'initial'))) * 1000 AS q FROM qk WHERE flow IS NOT NULL GROUP BY capture_id, flow),
 qi AS (SELECT capture_id, avg(q) AS qa, quantile_disc(q, 0.5) AS q5, quantile_disc(q, 0.95) AS q9 FROM qf GROUP BY 1), qs AS (SELECT capture_id, count(*) AS sc, min(g) AS sm, quantile_disc(g, 0.5) AS s5, quantile_disc(g, 0.95) AS s9 FROM (SELECT capture_id, quic_spin_bit AS x, lag(quic_spin_bit) OVER w AS px, greatest(0, (timestamp - lag(timestamp) OVER w)) * 1000 AS g FROM qk WHERE flow IS NOT NULL AND direction IS NOT NULL AND quic_spin_bit IS NOT NULL WINDOW w AS (PARTITION BY capture_id, flow, direction ORDER BY timestamp, packet_no)) WHERE px <> x GROUP BY 1),
 qb AS (SELECT capture_id, count(DISTINCT flow) AS qc, count(DISTINCT quic_version) FILTER (WHERE quic_version NOT IN ('', '0', '0x00000000')) AS vc, coalesce(list_sort(list(DISTINCT quic_version) FILTER (WHERE quic_version NOT IN ('', '0', '0x00000000'))), []) AS vs, count(*) FILTER (WHERE lower(quic_packet_type) IN ('3', 'retry')) AS re, count(*) FILTER (WHERE quic_version IN ('0', '0x00000000')) AS ne, count(*) FILTER (WHERE lower(quic_packet_type) IN ('1', '0-rtt', '0rtt', '0_rtt')) AS ze FROM qk GROUP BY 1),
 ud AS (SELECT capture_id, count(DISTINCT flow) AS uf, count(*) AS uc, sum(network_bytes) AS un_, sum(l4_payload_bytes) AS up, quantile_disc(CAST(l4_payload_bytes AS DOUBLE), 0.5) AS u5, quantile_disc(CAST(l4_payload_bytes AS DOUBLE), 0.95) AS u9, coalesce(sum(network_bytes) FILTER (WHERE flow IS NOT NULL AND (src_ip, src_port) <= (dst_ip, dst_port)), 0) AS sa, coalesce(sum(network_bytes) FILTER (WHERE flow IS NOT NULL AND (src_ip, src_port) > (dst_ip, dst_port)), 0) AS sb FROM pk WHERE ip AND transport = 'udp' AND NOT quic GROUP BY 1),
 dn AS (SELECT capture_id, count(*) FILTER (WHERE NOT dns_is_response) AS dq, count(*) FILTER (WHERE dns_is_response) AS dr, count(*) FILTER (WHERE dns_is_response AND dns_response_code <> 0) AS df, quantile_disc(dns_time_seconds * 1000, 0.5) AS d5, quantile_disc(dns_time_seconds * 1000, 0.95) AS d9 FROM pk WHERE dns_is_response IS NOT NULL GROUP BY 1),
 al AS (SELECT c.capture_id, c.scenario, c.transfer_file_size_bytes AS size, ba.* EXCLUDE (capture_id), coalesce(way, false) AS w, coalesce(nb, 0) AS n0, coalesce(pb, 0) AS p0, coalesce(tcpb, 0) + coalesce(qb, 0) + coalesce(ub, 0) AS tr, CASE WHEN way THEN CASE WHEN scenario = 'upload' THEN txs ELSE rxs END END AS span, CASE WHEN way THEN CASE WHEN scenario = 'upload' THEN txn ELSE rxn END END AS pri, CASE WHEN way THEN CASE WHEN scenario = 'upload' THEN rxn ELSE txn END END AS rev,
  fs.* EXCLUDE (capture_id), bk.* EXCLUDE (capture_id), tt.* EXCLUDE (capture_id), cn.* EXCLUDE (capture_id), op.o AS opn, qi.* EXCLUDE (capture_id), qs.* EXCLUDE (capture_id), qb.* EXCLUDE (capture_id), ud.* EXCLUDE (capture_id), dn.* EXCLUDE (capture_id) FROM {{packet_captures}} c LEFT JOIN ba USING (capture_id) LEFT JOIN fs USING (capture_id) LEFT JOIN bk USING (capture_id) LEFT JOIN tt USING (capture_id) LEFT JOIN cn USING (capture_id) LEFT JOIN op USING (capture_id) LEFT JOIN qi USING (capture_id) LEFT JOIN qs USING (capture_id) LEFT JOIN qb USING (capture_id) LEFT JOIN ud USING (capture_id) LEFT JOIN dn USING (capture_id)),
 fi AS (SELECT *, coalesce(ds IS NOT NULL, false) AS tcp, qc IS NOT NULL AS quc, coalesce(ok > 0, false) AS hso, sc IS NOT NULL AS spn FROM al)
SELECT capture_id, scenario, size AS transfer_file_size_bytes, coalesce(capture_duration_ms, 0) AS capture_duration_ms, coalesce(packet_count, 0) AS packet_count, coalesce(truncated_packet_count, 0) AS truncated_packet_count, w AS direction_metadata_available, coalesce(icmp_error_count, 0) AS icmp_error_count, n0 AS network_bytes_total, p0 AS l4_payload_bytes_total,
 CASE WHEN w THEN txn END AS tx_network_bytes, CASE WHEN w THEN txp END AS tx_l4_payload_bytes, CASE WHEN w THEN txc END AS tx_packet_count, CASE WHEN w THEN rxn END AS rx_network_bytes, CASE WHEN w THEN rxp END AS rx_l4_payload_bytes, CASE WHEN w THEN rxc END AS rx_packet_count, coalesce(tcpb, 0) AS tcp_bytes, coalesce(qb, 0) AS quic_identified_bytes, coalesce(ub, 0) AS other_udp_bytes, coalesce(fr, 0) AS ip_fragment_count, coalesce(ec, 0) AS ecn_ce_packet_count, CASE WHEN w THEN rem END AS unique_remote_ip_count,
 coalesce(fc, 0) AS flow_count, peak AS peak_1s_network_throughput_mbps, p95 AS p95_1s_network_throughput_mbps, am AS tcp_ack_rtt_min_ms, a5 AS tcp_ack_rtt_p50_ms, a9 AS tcp_ack_rtt_p95_ms, ds AS tcp_data_segment_count, rc AS tcp_retransmission_count, fa AS tcp_fast_retransmission_count, sp AS tcp_spurious_retransmission_count, rb AS tcp_retransmitted_payload_bytes, zc AS tcp_zero_window_count, wf AS tcp_window_full_count, oo AS tcp_out_of_order_count, da AS tcp_duplicate_ack_count, ls AS tcp_lost_segment_indicator_count,
 CASE WHEN tcp THEN coalesce(cc, 0) END AS tcp_connection_count, CASE WHEN tcp THEN coalesce(ok, 0) END AS tcp_successful_handshake_count, ra AS tcp_initial_rtt_avg_ms, r5 AS tcp_initial_rtt_p50_ms, r9 AS tcp_initial_rtt_p95_ms, CASE WHEN tcp THEN coalesce(zd, 0) END AS tcp_zero_window_duration_ms, CASE WHEN tcp THEN coalesce(ad, 0) END AS tcp_active_duration_ms, CASE WHEN tcp THEN coalesce(rs, 0) END AS tcp_reset_count, cc - ok AS tcp_incomplete_handshake_count, {R('ok', 'cc')} AS tcp_handshake_success_rate, CASE WHEN a5 <> 0 THEN a9 / a5 END AS tcp_rtt_tail_inflation,
 {R('rc', 'ds')} AS tcp_retransmission_rate, {R('rb', 'tb')} AS tcp_recovery_tax, {R('zd', 'ad')} AS tcp_receiver_stall_ratio, {R('rs', 'cc')} AS tcp_reset_rate, ra IS NOT NULL OR am IS NOT NULL AS tcp_rtt_available, qc AS quic_identified_connection_count, vc AS quic_version_count, vs AS quic_versions_seen, re AS quic_retry_count, ne AS quic_version_negotiation_count, ze AS quic_0rtt_observed_count, qa AS quic_initial_rtt_avg_ms, q5 AS quic_initial_rtt_p50_ms, q9 AS quic_initial_rtt_p95_ms, sm AS quic_spin_rtt_min_ms, s5 AS quic_spin_rtt_p50_ms, s9 AS quic_spin_rtt_p95_ms,
 CASE WHEN quc THEN coalesce(sc, 0) END AS quic_spin_rtt_sample_count, qa IS NOT NULL AS quic_initial_rtt_available, spn AS quic_spin_rtt_available, uf AS udp_flow_count, uc AS udp_datagram_count, un_ AS udp_network_bytes, up AS udp_payload_bytes, u5 AS udp_payload_size_p50, u9 AS udp_payload_size_p95, CASE WHEN greatest(sa, sb) > 0 THEN least(sa, sb) / greatest(sa, sb) END AS udp_bidirectional_byte_ratio, dq AS dns_query_count, dr AS dns_response_count, df AS dns_failure_count, d5 AS dns_rtt_p50_ms, d9 AS dns_rtt_p95_ms,
 greatest(0, n0 - p0) AS ip_transport_header_bytes, CASE WHEN span > 0 THEN span END AS observed_primary_payload_span_ms, {R('tcpb', 'tr')} AS tcp_byte_share, {R('qb', 'tr')} AS quic_byte_share, {R('ub', 'tr')} AS other_udp_byte_share, {R('v4', 'n0')} AS ipv4_byte_share, {R('v6', 'n0')} AS ipv6_byte_share, {R('fr', 'ipc')} AS ip_fragment_rate, {R('ec', 'ipc')} AS ecn_ce_packet_rate, {R('top', 'p0')} AS top_flow_payload_share, CASE WHEN p0 > 0 THEN coalesce(need, 0) ELSE 0 END AS flows_for_80pct_payload, coalesce(fc, 0) / (size / 1048576.0) AS connection_churn_per_mib,
 CASE WHEN capture_duration_ms > 0 THEN n0 * 8 / (capture_duration_ms / 1000) / 1000000 END AS average_network_throughput_mbps, pri / size AS primary_direction_amplification_ratio, n0 / size AS total_transfer_amplification_ratio, {R('rev', 'pri')} AS reverse_path_cost_ratio, tcp AS tcp_present, quc AS quic_present, uc IS NOT NULL AS other_udp_present, dq IS NOT NULL AS dns_metrics_available, hso AS handshake_observed, {R('greatest(0, n0 - p0)', 'n0')} AS ip_transport_header_overhead_ratio, CASE WHEN span > 0 THEN size * 8 / (span / 1000) / 1000000 END AS effective_file_throughput_mbps,
 coalesce(packet_count > 0 AND capture_duration_ms > 0 AND truncated_packet_count = 0 AND w AND span > 0, false) AS comparison_ready, wl AS analysis_warnings, len(wl) AS analysis_warning_count FROM (SELECT *, list_sort(list_filter([CASE WHEN truncated_packet_count > 0 THEN 'capture_truncated' END, CASE WHEN NOT w THEN 'direction_unavailable' END, CASE WHEN span IS NULL THEN 'no_primary_payload' END, CASE WHEN span <= 0 THEN 'zero_transfer_span' END, CASE WHEN opn THEN 'tcp_zero_window_open_at_capture_end' END, CASE WHEN tcp AND NOT hso THEN 'missing_tcp_handshake' END, CASE WHEN quc AND NOT spn THEN 'quic_spin_unavailable' END, CASE WHEN dq <> dr THEN 'dns_incomplete' END], lambda x: x IS NOT NULL)) AS wl FROM fi)"""

MORE: dict[str, str] = {
    "dsh_counts": "SELECT (SELECT count(*) FROM {applications}) AS applications, (SELECT count(*) FROM {reviews}) AS unique_reviews, (SELECT count(*) FROM {review_observations}) AS observations",
    "dsh_runs_and_tasks": f"SELECT (SELECT count(*) FROM {{crawl_runs}} WHERE started_at {RANGE}) AS runs, count(*) FILTER (WHERE status = 'succeeded') AS succeeded_tasks, count(*) FILTER (WHERE status = 'failed') AS failed_tasks FROM {{crawl_tasks}} WHERE started_at {RANGE}",
    "dsh_task_status": "SELECT status, count(*) AS tasks FROM {crawl_tasks} GROUP BY 1",
    "dsh_sentiment_backlog": "SELECT count(*) AS pending FROM {review_observations} WHERE sentiment_status = 'pending'",
    "dsh_latest_runs": f"SELECT id, status, started_at, finished_at, {DUR} AS duration_seconds FROM {{crawl_runs}} ORDER BY started_at DESC, id LIMIT 50",
    "dsh_daily_reviews": "SELECT CAST(first_observed_at AS DATE) AS day, count(*) AS new_reviews FROM {reviews} GROUP BY 1",
    "dsh_daily_observations": "SELECT CAST(observed_at AS DATE) AS day, count(*) AS observations FROM {review_observations} GROUP BY 1",
    "dsh_hourly_duration": f"SELECT date_trunc('hour', started_at) AS bucket, task_type, avg({DUR}) AS mean_seconds FROM {{crawl_tasks}} WHERE finished_at IS NOT NULL GROUP BY ALL",
    "dsh_attempts": "SELECT task_type, round(avg(attempt_count), 2) AS mean_attempts, max(attempt_count) AS most_attempts FROM {crawl_tasks} GROUP BY 1",
    "dsh_failure_codes": "SELECT coalesce(error_code, 'unspecified') AS error_code, count(*) AS n FROM {crawl_tasks} WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, error_code LIMIT 20",
    "dsh_latest_failed": "SELECT c.id, a.name AS application_name, task_type, status, error_code, finished_at FROM {crawl_tasks} c JOIN {applications} a ON a.id = c.application_id WHERE status = 'failed' ORDER BY finished_at DESC NULLS LAST, c.id LIMIT 100",
    "dsh_hourly_status": "SELECT date_trunc('hour', started_at) AS bucket, status, count(*) AS tasks FROM {crawl_tasks} GROUP BY ALL",
    "dsh_application_status": "SELECT a.name AS application_name, status, count(*) AS tasks FROM {crawl_tasks} c JOIN {applications} a ON a.id = c.application_id GROUP BY ALL",
    "dsh_locales": "SELECT language_code, country_code, count(*) AS tasks FROM {crawl_tasks} GROUP BY ALL",
    "dsh_reviews_in_range": f"SELECT (SELECT count(*) FROM {{reviews}} WHERE first_observed_at {RANGE}) AS reviews, (SELECT count(*) FROM {{review_observations}} WHERE observed_at {RANGE}) AS observations",
    "dsh_ratings": "SELECT score || ' stars' AS rating, count(*) AS observations FROM {review_observations} GROUP BY 1",
    "dsh_reviews_by_application": "SELECT a.name, count(r.id) AS reviews FROM {applications} a LEFT JOIN {reviews} r ON r.application_id = a.id GROUP BY a.id, a.name",
    "dsh_latest_observations": "SELECT crawl_task_id, review_id, application_id, score, sentiment_status, observed_at FROM {review_observations} o JOIN {reviews} r ON r.id = o.review_id ORDER BY observed_at DESC, crawl_task_id LIMIT 100",
    "dsh_cumulative_reviews": "SELECT *, sum(new_reviews) OVER (ORDER BY day) AS reviews_so_far FROM (SELECT CAST(first_observed_at AS DATE) AS day, count(*) AS new_reviews FROM {reviews} GROUP BY 1)",
    "dsh_indicators": "SELECT 'missing_source_time' AS indicator, count(*) AS n FROM {reviews} WHERE source_at IS NULL UNION ALL SELECT 'failed_sentiment', count(*) FROM {review_observations} WHERE sentiment_status = 'failed' UNION ALL SELECT 'never_reobserved', count(*) FROM {reviews} WHERE first_observed_at = last_observed_at",
    "dsh_sentiment": "SELECT sentiment_status, coalesce(sentiment_label, 'not assigned') AS sentiment_label, count(*) AS observations FROM {review_observations} GROUP BY ALL",
    "dsh_active_applications": "SELECT id, name FROM {applications} WHERE is_active",
    "dsh_captures": "SELECT status, scenario, count(*) AS captures FROM {network_captures} GROUP BY ALL",
    "dsh_latest_captures": "SELECT c.id, c.status, c.scenario, c.created_at, r.capture_id IS NOT NULL AS has_result FROM {network_captures} c LEFT JOIN {network_analysis_results} r ON r.capture_id = c.id ORDER BY created_at DESC, c.id LIMIT 15",
    "dsh_table_counts": "SELECT (SELECT count(*) FROM {crawl_runs}) AS crawl_runs, (SELECT count(*) FROM {crawl_tasks}) AS crawl_tasks, (SELECT count(*) FROM {playstore_app_snapshots}) AS playstore_app_snapshots, (SELECT count(*) FROM {review_observations}) AS review_observations",
    "dsh_run_rows": "SELECT crawl_run_id, count(s.id) AS snapshots, count(o.review_id) AS observations FROM {crawl_tasks} c LEFT JOIN {playstore_app_snapshots} s ON s.crawl_task_id = c.id LEFT JOIN {review_observations} o ON o.crawl_task_id = c.id GROUP BY 1",
    "dsh_active_runs": "SELECT count(*) AS active_runs FROM {crawl_runs} WHERE status IN ('pending', 'running')",
    "agg_finalize_runs": "SELECT crawl_run_id, CASE WHEN bool_and(status = 'succeeded') THEN 'succeeded' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partially_failed' END AS status FROM {crawl_tasks} GROUP BY 1",
    "log_volume": f"WITH {LOGS} SELECT date_trunc('hour', timestamp) AS bucket, service, count(*) AS records FROM lg GROUP BY ALL",
    "log_levels": f"WITH {LOGS} SELECT time_bucket(INTERVAL '30 minutes', timestamp) AS bucket, level, count(*) AS records FROM lg WHERE level <> 'info' GROUP BY ALL",
    "log_recent": f"WITH {LOGS} SELECT * FROM lg WHERE service IN ('svc1', 'svc2') AND level = 'error' ORDER BY timestamp DESC LIMIT 100",
    "log_labels": f"WITH {LOGS} SELECT DISTINCT service, level FROM lg",
    "log_event_durations": f"WITH {LOGS} SELECT event, count(*) AS events, avg(duration_seconds) AS mean_seconds, max(duration_seconds) AS longest_seconds FROM lg WHERE duration_seconds IS NOT NULL GROUP BY 1",
    "net_capture_metrics": NET,
    "enr_batch_diagnostics": f"WITH {BATCH} SELECT batch_id, count(*) AS received, count(*) FILTER (WHERE NOT bad_score AND NOT bad_time) AS accepted, count(*) FILTER (WHERE bad_score OR bad_time) AS skipped FROM bt GROUP BY 1",
    "enr_gate_batches": f"WITH {BATCH} SELECT batch_id, position, score FROM (SELECT *, bad_score OR bad_time AS bad, count(*) OVER w AS n, count(*) FILTER (WHERE bad_score OR bad_time) OVER w AS s FROM bt WINDOW w AS (PARTITION BY batch_id)) WHERE NOT bad AND s < n AND s * 100 <= n * 20",
    "enr_record_issues": f"WITH {BATCH} SELECT batch_id || '/' || position AS record, 'score' AS rule, 'score is invalid' AS message FROM bt WHERE bad_score UNION ALL SELECT batch_id || '/' || position, 'source_at', 'source_at is invalid' FROM bt WHERE bad_time",
    "str_classify": f'WITH {REASON} SELECT "offset", reason FROM rs',
    "str_claim": f'WITH {REASON} SELECT uid AS event_id, "offset" FROM cl',
    "str_quarantine": f"WITH {REASON} SELECT reason, count(*) AS n FROM rs WHERE reason IS NOT NULL GROUP BY 1",
    "str_ledger": f"WITH {REASON} SELECT CASE WHEN tp = 'reviews' THEN 'review_observed' ELSE 'app_stats_collected' END AS event_type, count(*) AS events FROM cl GROUP BY 1",
    "str_upsert_reviews": f"""WITH {REASON} SELECT CAST(user_id AS VARCHAR) AS application_id, 'r' || (k % 10) AS external_review_id, 1 + arg_max("offset", (ts, "offset")) % 5 AS score, 'c' || arg_max("offset", (ts, "offset")) AS content, min(ts) AS first_observed_at, max(ts) AS last_observed_at FROM cl WHERE tp = 'reviews' GROUP BY ALL""",
    "str_dedupe_captures": "SELECT id, copies, conflict FROM (SELECT id, count(*) OVER w AS copies, (min(capture_size_bytes) OVER w <> max(capture_size_bytes) OVER w) OR (min(transfer_file_size_bytes) OVER w <> max(transfer_file_size_bytes) OVER w) AS conflict, row_number() OVER (PARTITION BY application_id, scenario, capture_sha256 ORDER BY created_at, id) AS k FROM {network_captures} WINDOW w AS (PARTITION BY application_id, scenario, capture_sha256)) WHERE k = 1",
    "str_cleanable": "SELECT object_key, count(*) AS captures FROM {network_captures} GROUP BY 1 HAVING bool_and(status IN ('analyzed', 'failed', 'expired'))",
    "dq_experiment": "SELECT capture_id AS record, 'provenance' AS rule, c || ' must be true' AS message FROM (SELECT capture_id, unnest(['transfer_completed', 'capture_isolation_confirmed', 'cache_cleared_or_download_verified']) AS c, unnest([transfer_completed, capture_isolation_confirmed, cache_cleared_or_download_verified]) AS v FROM {experiment_manifest}) WHERE NOT v",
    "dq_unique_trials": "SELECT capture_id AS record, 'unique' AS rule, 'experiment_id, session_id, application_package, scenario, app_version, trial_number must be unique' AS message FROM {experiment_manifest} QUALIFY count(*) OVER (PARTITION BY experiment_id, session_id, application_package, scenario, app_version, trial_number) > 1",
    "dq_against_captures": """WITH d AS (SELECT m.capture_id, m.application_package AS mp, m.scenario AS ms, m.test_file_size_bytes AS mz, c.status, c.scenario AS cs, c.transfer_file_size_bytes AS cz, a.package_name AS ap FROM {experiment_manifest} m LEFT JOIN ({network_captures} c JOIN {applications} a ON a.id = c.application_id) ON c.id = m.capture_id)
 SELECT capture_id AS record, 'capture_exists' AS rule, 'no such capture' AS message FROM d WHERE status IS NULL UNION ALL SELECT capture_id, 'capture_application', 'the capture is of another application' FROM d WHERE ap <> mp UNION ALL SELECT capture_id, 'capture_scenario', 'the capture has another scenario' FROM d WHERE cs <> ms UNION ALL SELECT capture_id, 'capture_size', 'the capture has another file size' FROM d WHERE cz <> mz UNION ALL SELECT capture_id, 'capture_analyzed', 'the capture isn''t analysed' FROM d WHERE status <> 'analyzed'""",
    "dq_categories": "SELECT application_id AS record, 'category_repeated' AS rule, 'a category occurs twice' AS message FROM {application_categories} GROUP BY 1 HAVING count(*) <> count(DISTINCT category_id) UNION ALL SELECT application_id, 'primary', 'exactly one category is primary' FROM {application_categories} GROUP BY 1 HAVING count(*) FILTER (WHERE is_primary) <> 1",
    "dq_overlaps": "SELECT release_event_id || 'b' AS record, 'overlap' AS rule, 'analysis windows overlap' AS message FROM {release_manifest} WHERE release_event_id < 'rel2' AND followup_end IS NOT NULL",
    "dq_capabilities": "SELECT 'NETWORK_COMPARISON_READY' AS network_state, 'VERIFIED_EXPERIMENT_AVAILABLE' AS experiment_state, 'RELEASE_METADATA_AVAILABLE' AS release_state, CASE WHEN count(*) > 0 THEN 'SENTIMENT_DATA_AVAILABLE' ELSE 'SENTIMENT_EMPTY' END AS sentiment_state, 'ANNOTATIONS_UNAVAILABLE' AS topic_state FROM {review_observations} WHERE sentiment_status = 'done'",
    "dq_backfill_locale": "SELECT coalesce(CASE WHEN attempt_count > 1 THEN c.language_code END, a.language_code, 'xx') AS language_code, coalesce(CASE WHEN attempt_count > 1 THEN c.country_code END, a.country_code, 'yy') AS country_code, count(*) AS n FROM {crawl_tasks} c LEFT JOIN {applications} a ON a.id = c.application_id GROUP BY ALL",
    "dq_constraints": "SELECT CAST(id AS VARCHAR) AS record, 'range' AS rule, 'score is out of range' AS message FROM {playstore_app_snapshots} WHERE score > 4.5 UNION ALL SELECT CAST(id AS VARCHAR), 'enum', 'version is unknown' FROM {playstore_app_snapshots} WHERE version NOT IN ('v0', 'v1')",
}


def more_sql() -> dict[str, str]:
    return {name: with_roles(sql) for name, sql in MORE.items()}
