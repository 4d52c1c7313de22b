"""DuckDB's SQL for the queries of catalog_streams."""

from __future__ import annotations

from quartzite.bindings import with_roles
from quartzite.catalog_streams import BATCHES

_B = f"CAST(least(day(ts) % {BATCHES} + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END, {BATCHES}) AS INTEGER)"
_UUID = "'00000000-0000-4000-8000-' || lpad(CAST({} AS VARCHAR), 12, '0')"
_IN_TIME = f"""e AS (SELECT *, CAST(floor((epoch_us(ts) - a) * {BATCHES} / (z - a + 1)) AS INTEGER) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS b FROM {{ev}}, (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS z FROM {{ev}}))"""


def _windows(rows: str, key: str, delay: str, sums: str = "", columns: str = "") -> str:
    """Windows that are over after the last batch; a row is late if its window ended before the latest time of earlier batches less the delay."""
    return f"""WITH {_IN_TIME}, r AS ({rows}), w AS (SELECT *, date_trunc('hour', seen) AS window_start, date_trunc('hour', seen) + INTERVAL 1 HOUR AS window_end FROM r),
marks AS (SELECT x.b, (SELECT max(seen) FROM r WHERE r.b < x.b) - INTERVAL {delay} AS mark FROM (SELECT DISTINCT b FROM r) x),
j AS (SELECT w.*, coalesce(window_end <= mark, FALSE) AS too_late FROM w JOIN marks USING (b)),
g AS (SELECT window_start, window_end, {key}, count(*) FILTER (WHERE NOT too_late) AS records, count(*) FILTER (WHERE too_late) AS late{sums} FROM j GROUP BY window_start, window_end, {key})
SELECT window_start, {key}, records, late{columns} FROM g WHERE records > 0 AND window_end <= (SELECT max(seen) - INTERVAL {delay} FROM r)"""


STREAM_SQL = {
    "str_keyed_reviews": f"""SELECT CAST(user_id AS VARCHAR) AS application_id, 'r' || (k % 10) AS external_review_id, arg_max(k, (ts, {_B}, event_id)) AS thumbs_up_count, CAST(1 + arg_max(event_id, (ts, {_B}, event_id)) % 5 AS INTEGER) AS score,
        'c' || arg_max(event_id, (ts, {_B}, event_id)) AS content, min(ts) AS first_observed_at, max(ts) AS last_observed_at FROM {{ev}} WHERE event_type IN ('purchase', 'signup') GROUP BY ALL""",
    "str_claimed_batches": f"""SELECT 'e' || event_id AS event_id, event_id AS place, {_B} AS batch FROM {{ev}}""",
    "str_wire_reasons": """SELECT topic, reason, count(*) AS events FROM (SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'playstore.review-observed.v1' ELSE 'playstore.app-stats.v1' END AS topic,
        CASE WHEN k % 10 = 3 OR (event_type IN ('purchase', 'signup') AND NOT k % 1002 BETWEEN 1 AND 1000) OR (event_type NOT IN ('purchase', 'signup') AND k % 60 > 50) THEN 'invalid_envelope_or_payload' END AS reason FROM {ev} WHERE event_type IN ('purchase', 'signup', 'click', 'view', 'error')) GROUP BY ALL""",
    "str_wire_routed": f"""SELECT {_UUID.format('user_id')} AS application_id, count(*) AS events, max(ts) AS latest, CAST(sum(k) AS BIGINT) AS total, CASE WHEN event_type IN ('purchase', 'signup') THEN 'reviews' ELSE 'stats' END AS kind FROM {{ev}}
        WHERE event_type IN ('purchase', 'signup', 'click', 'view', 'error') AND k % 10 <> 3 AND CASE WHEN event_type IN ('purchase', 'signup') THEN k % 1002 BETWEEN 1 AND 1000 ELSE k % 60 <= 50 END GROUP BY ALL""",
    "str_log_windows": _windows("SELECT ts AS seen, 'svc' || user_id % 7 AS service, b FROM e", "service", "6 HOURS"),
    "str_task_windows": _windows("SELECT ts AS seen, CASE WHEN event_type IN ('purchase', 'signup') THEN 'reviews' ELSE 'app_details' END AS task_type, CASE WHEN k % 3 = 0 THEN 30 ELSE 90 END AS s, b FROM e WHERE k % 3 < 2", "task_type", "1 DAY", ", CAST(sum(s) FILTER (WHERE NOT too_late) AS DOUBLE) AS seconds", ", seconds"),
    "str_ingest_run": """WITH w AS (SELECT event_type IN ('purchase', 'signup') AS review, k % 10 <> 3 AND CASE WHEN event_type IN ('purchase', 'signup') THEN k % 1002 BETWEEN 1 AND 1000 ELSE k % 60 <= 50 END AS good FROM {ev} WHERE event_type IN ('purchase', 'signup', 'click', 'view', 'error')),
        n AS (SELECT count(*) FILTER (WHERE good AND review) AS r, count(*) FILTER (WHERE good AND NOT review) AS s, count(*) FILTER (WHERE NOT good) AS bad FROM w)
        SELECT unnest(['stats', 'reviews', 'ledger', 'refused events', 'review state', 'observations', 'snapshots']) AS source, unnest([s, r, r + s, bad, r, r, s]) AS rows FROM n""",
    "src_packet_files": """WITH p AS (SELECT *, CASE WHEN event_type IN ('click', 'view') THEN 'tcp' WHEN event_type = 'signup' THEN 'udp' ELSE 'other' END AS transport, CASE WHEN event_id % 2 = 0 THEN 'tx' WHEN k % 3 > 0 THEN 'rx' END AS direction FROM {ev})
        SELECT transport, direction, CASE WHEN user_id % 4 > 0 THEN 4 ELSE 6 END AS ip_version, count(*) AS packets, CAST(sum(40 + k) AS BIGINT) AS network_bytes, CAST(sum(CASE transport WHEN 'tcp' THEN k WHEN 'udp' THEN greatest(0, k - 8) ELSE 0 END) AS BIGINT) AS payload_bytes,
        count(*) FILTER (WHERE k % 7 = 0) AS syns, max(60 + k) AS longest, (SELECT count(*) FROM p) AS lines, (SELECT count(*) FROM p) AS numbers FROM p WHERE k % 25 <> 1 GROUP BY ALL""",
    "src_manifest_files": "SELECT capture_id, experiment_id, CAST(trial_number AS INTEGER) AS trial_number, pair_id, capture_started_at_utc, transfer_completed, test_file_size_bytes, CAST(NULL AS VARCHAR) AS protocol_notes FROM {experiment_manifest}",
}


def stream_sql() -> dict[str, str]:
    return {name: with_roles(sql) for name, sql in STREAM_SQL.items()}
