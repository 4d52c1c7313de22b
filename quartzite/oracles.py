"""The questions as DuckDB SQL over the bound roles, written by themselves: picks by QUALIFY, pivots by FILTER."""

from __future__ import annotations

from quartzite.bindings import AS_OF, with_roles

A = f"TIMESTAMP '{AS_OF}'"
AGE = lambda ts: f"date_diff('microsecond', {ts}, {A}) / 3600000000.0"
ELIG = """SELECT s.id AS sid, s.application_id AS application_id, a.name AS application_name, a.package_name, c.country_code AS crawl_country_code, c.language_code AS crawl_language_code, s.collected_at, CAST(s.collected_at AS DATE) AS d,
 s.score, s.ratings_count, s.reviews_count, s.min_installs, s.source_adapter, s.store_updated_on, s.version, s.ad_supported
 FROM {playstore_app_snapshots} s JOIN {crawl_tasks} c ON c.id = s.crawl_task_id AND c.application_id = s.application_id AND c.task_type = 'app_details' AND c.status = 'succeeded' JOIN {applications} a ON a.id = s.application_id"""
LOC = "application_id, crawl_country_code, crawl_language_code"
DAILY = f"SELECT *, count(*) OVER (PARTITION BY {LOC}, d) AS snapshots_in_day FROM el QUALIFY row_number() OVER (PARTITION BY {LOC}, d ORDER BY collected_at DESC, sid DESC) = 1"
PREV = f"(PARTITION BY {LOC} ORDER BY d)"
CAT = "SELECT ac.application_id AS app, c.id AS cid, c.code AS primary_category_code, c.name AS primary_category_name FROM (SELECT application_id, min(category_id) AS m FROM {application_categories} WHERE is_primary GROUP BY 1) ac JOIN {categories} c ON c.id = ac.m"
NAMED = "application_id, application_name, package_name, crawl_country_code, crawl_language_code"
NAMES = NAMED[16:]
OBS = """SELECT o.*, r.application_id AS app, r.first_observed_at, a.name AS application_name, a.package_name, c.country_code AS crawl_country_code, c.language_code AS crawl_language_code FROM {review_observations} o JOIN {reviews} r ON r.id = o.review_id
 JOIN {crawl_tasks} c ON c.id = o.crawl_task_id AND c.application_id = r.application_id AND c.task_type = 'reviews' AND c.status = 'succeeded' JOIN {applications} a ON a.id = r.application_id"""


def cohort(start: str | None = None, end: str | None = None) -> str:
    return f"WITH ob AS ({OBS}{f' WHERE CAST(o.observed_at AS DATE) <= DATE {end!r}' if end else ''}), co AS (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY observed_at DESC, crawl_task_id DESC) = 1), ch AS (SELECT * FROM co{f' WHERE CAST(first_observed_at AS DATE) >= DATE {start!r}' if start else ''}) "


OK = "(sentiment_status = 'done' AND coalesce(sentiment_label IN ('positive', 'neutral', 'negative'), false))"
TRI = """SELECT m.*, a.name AS application_name, c.id AS cid, c.status, c.scenario AS cs, c.transfer_file_size_bytes AS csize, r.capture_id AS rid, r.scenario AS rs, r.package_name AS rp, r.* EXCLUDE (capture_id, scenario, package_name, application_id)
 FROM {experiment_manifest} m LEFT JOIN {applications} a ON a.package_name = m.application_package LEFT JOIN {network_captures} c ON c.id = m.capture_id%s LEFT JOIN {network_analysis_results} r ON r.capture_id = c.id"""
TRIALS, LOOSE = TRI % " AND c.application_id = a.id", TRI % ""
ATT = "(status = 'analyzed' AND cs = scenario AND rs = scenario AND rp = application_package)"
PROV = "(transfer_completed AND capture_isolation_confirmed AND cache_cleared_or_download_verified AND csize = test_file_size_bytes)"
MEAS = "(comparison_ready AND direction_metadata_available AND truncated_packet_count = 0 AND observed_primary_payload_span_ms > 0 AND effective_file_throughput_mbps IS NOT NULL)"
E = {
    "throughput": f"({ATT} AND {PROV} AND {MEAS})", "amplification": f"({ATT} AND {PROV} AND total_transfer_amplification_ratio IS NOT NULL)", "overhead": f"({ATT} AND network_bytes_total > 0 AND ip_transport_header_overhead_ratio IS NOT NULL)",
    "initial_rtt": f"({ATT} AND tcp_present AND tcp_rtt_available AND tcp_initial_rtt_avg_ms IS NOT NULL)", "ack_rtt": f"({ATT} AND tcp_present AND tcp_rtt_available AND tcp_ack_rtt_p95_ms IS NOT NULL)", "recovery_tax": f"({ATT} AND tcp_present AND tcp_recovery_tax IS NOT NULL)",
}
VALUE = {"throughput": "effective_file_throughput_mbps", "amplification": "total_transfer_amplification_ratio", "overhead": "ip_transport_header_overhead_ratio", "initial_rtt": "tcp_initial_rtt_avg_ms", "ack_rtt": "tcp_ack_rtt_p95_ms", "recovery_tax": "tcp_recovery_tax"}
SHOWN = {"throughput": "median_per_capture_effective_file_throughput_mbps", "amplification": "median_per_capture_total_transfer_amplification_ratio", "overhead": "median_per_capture_ip_transport_header_overhead_ratio", "initial_rtt": "median_of_per_capture_tcp_initial_rtt_average_ms", "ack_rtt": "median_of_per_capture_tcp_ack_rtt_p95_ms", "recovery_tax": "median_per_capture_tcp_recovery_tax"}
N8 = "experiment_id, session_id, trial_number, application_name, application_package, scenario, network_profile, capture_started_at_utc"
COND = "file_cohort_id, test_file_size_bytes, app_version, device_model, android_version, network_type, network_profile, capture_tool, capture_tool_version, experiment_phase"
PK = "('com.app.n0', 'com.app.n1', 'com.app.n2', 'com.app.n3')"
NETC = "scenario, file_cohort_id, test_file_size_bytes, device_model, android_version, network_type, network_profile, capture_tool, capture_tool_version"
WIN = "baseline_start, baseline_end, followup_start, followup_end"


def _counts(x: str, noun: str) -> str:
    return f"WITH el AS ({ELIG}), dl AS ({DAILY}) SELECT {NAMES}, d AS snapshot_day_utc, collected_at AS daily_last_collected_at, {x} AS published_cumulative_{x}, lag({x}) OVER w AS previous_{x}, {x} - lag({x}) OVER w AS observed_{noun}_count_change, {x} < lag({x}) OVER w AS negative_correction, date_diff('day', lag(d) OVER w, d) AS days_since_previous_observation, snapshots_in_day FROM dl WINDOW w AS {PREV}"


def _pivot_net() -> str:
    """Captures of a release's windows, as q38 and q41 look at them."""
    rec = f"({ATT} AND {PROV} AND tcp_present AND tcp_recovery_tax IS NOT NULL)"
    ver = "CASE WHEN experiment_id = experiment_id_before THEN app_version = previous_version WHEN experiment_id = experiment_id_after THEN app_version = new_version ELSE false END"
    common = f"CASE WHEN cid IS NULL THEN 'capture_missing' WHEN status <> 'analyzed' THEN 'capture_not_analyzed' WHEN rid IS NULL THEN 'analysis_missing' WHEN cs <> scenario OR rs <> scenario OR rp <> application_package THEN 'source_attribution_mismatch' WHEN NOT transfer_completed THEN 'transfer_incomplete' WHEN NOT capture_isolation_confirmed OR NOT cache_cleared_or_download_verified THEN 'provenance_incomplete' WHEN csize <> test_file_size_bytes THEN 'transfer_size_mismatch' WHEN NOT ({ver}) THEN 'application_version_mismatch' END"
    return f"""tr AS ({TRIALS}), pc AS (SELECT t.*, m.release_event_id, m.release_date, CASE WHEN t.experiment_id = m.experiment_id_before AND CAST(capture_started_at_utc AS DATE) BETWEEN m.baseline_start AND m.baseline_end THEN 'before'
 WHEN t.experiment_id = m.experiment_id_after AND CAST(capture_started_at_utc AS DATE) BETWEEN m.followup_start AND m.followup_end THEN 'after' END AS period, {common} AS cmn,
 coalesce(({ver}) AND {E['throughput']}, false) AS th, coalesce(({ver}) AND {E['amplification']}, false) AS am, coalesce(({ver}) AND {rec}, false) AS re,
 coalesce({common}, CASE WHEN NOT coalesce({E['throughput']}, false) THEN 'throughput_prerequisite_missing' END) AS th_x, coalesce({common}, CASE WHEN NOT coalesce({E['amplification']}, false) THEN 'amplification_prerequisite_missing' END) AS am_x,
 coalesce({common}, CASE WHEN NOT coalesce({rec}, false) THEN 'tcp_recovery_metric_unavailable' END) AS re_x, CASE WHEN status = 'analyzed' THEN rid END AS arid
 FROM tr t JOIN (SELECT * RENAME (application_package AS mp) FROM {{release_manifest}}) m ON m.mp = t.application_package WHERE m.release_date_verified AND m.release_date_precision = 'day')"""


MET = {"throughput": ("th", "effective_file_throughput_mbps", "effective_mbps"), "amplification": ("am", "total_transfer_amplification_ratio", "amplification"), "recovery": ("re", "tcp_recovery_tax", "tcp_recovery_tax")}
BA = ("before", "after")
F = lambda p: f"FILTER (WHERE period = '{p}')"
NETN = ", ".join(f"count(DISTINCT {c}) FILTER (WHERE period = '{p}') AS %s{p}_{n}_n" for c, n in (("capture_id", "manifest"), ("cid", "observed"), ("arid", "analyzed")) for p in BA)
NETE = ", ".join(f"count(DISTINCT capture_id) FILTER (WHERE period = '{p}' AND {k}) AS {p}_{m}_eligible_n" for m, (k, _, _) in MET.items() for p in BA)


def _q38() -> str:
    raw = ", ".join(f"quantile_cont({v}, 0.5) FILTER (WHERE period = '{p}' AND {k}) AS {p}_{m}_raw, string_agg(DISTINCT {k}_x, ', ' ORDER BY {k}_x) FILTER (WHERE period = '{p}' AND NOT {k}) AS {p}_{m}_exclusion_reasons" for m, (k, v, _) in MET.items() for p in BA)
    ok = {m: f"(before_{m}_eligible_n >= 3 AND after_{m}_eligible_n >= 3)" for m in MET}
    more = ", ".join([*(f"{p}_manifest_n - {p}_{m}_eligible_n AS {p}_{m}_excluded_n" for m in MET for p in BA), *(f"CASE WHEN {ok[m]} THEN {p}_{m}_raw END AS {p}_median_{s}" for m, (_, _, s) in MET.items() for p in BA), *(f"CASE WHEN {ok[m]} THEN after_{m}_raw - before_{m}_raw END AS {s}_after_minus_before" for m, (_, _, s) in MET.items())])
    return f"WITH {_pivot_net()}, g AS (SELECT release_event_id, application_package, release_date, {NETC}, {NETN % (('',) * 6)}, {NETE}, {raw} FROM pc WHERE period IS NOT NULL GROUP BY ALL) SELECT *, {more}, CASE WHEN {' AND '.join(ok.values())} THEN 'all_metrics_descriptive_before_after_not_causal' WHEN {' OR '.join(ok.values())} THEN 'partial_metric_readiness' ELSE 'insufficient_under_3_each_period' END AS comparison_status FROM g"


def _states(succeeded: bool) -> str:
    only = " AND c.application_id = r.application_id AND c.task_type = 'reviews' AND c.status = 'succeeded'" if succeeded else ""
    where = "" if succeeded else " WHERE m.release_date_verified AND m.release_date_precision = 'day'"
    return f"""pd AS (SELECT m.release_event_id, m.application_package, m.release_date, p.* FROM {{release_manifest}} m, LATERAL (VALUES ('before', m.baseline_start, m.baseline_end), ('after', m.followup_start, m.followup_end)) p(period, ps, pe){where}),
 st AS (SELECT pd.*, CAST(pe + 1 AS TIMESTAMP) AS cut, r.id AS rid, o.*, c.country_code, c.language_code FROM pd JOIN {{applications}} a ON a.package_name = pd.application_package JOIN {{reviews}} r ON r.application_id = a.id AND CAST(r.first_observed_at AS DATE) BETWEEN ps AND pe
 JOIN {{review_observations}} o ON o.review_id = r.id AND o.observed_at < CAST(pe + 1 AS TIMESTAMP) JOIN {{crawl_tasks}} c ON c.id = o.crawl_task_id{only} QUALIFY row_number() OVER (PARTITION BY release_event_id, period, r.id ORDER BY o.observed_at DESC, o.crawl_task_id DESC) = 1)"""


def _q40() -> str:
    n = lambda p, w="": f"count(DISTINCT rid) FILTER (WHERE period = '{p}'{w})"
    cols = ", ".join(f"max(pe) {F(p)} AS {p}_period_end, max(cut) {F(p)} AS {p}_as_of_cutoff_exclusive_utc, {n(p)} AS {p}_unique_sampled_reviews, avg(score) {F(p)} AS {p}_mean_sampled_review_stars, {n(p, ' AND score <= 2')} / nullif({n(p)}, 0) AS {p}_low_star_share, max(observed_at) {F(p)} AS {p}_latest_observation_at_utc, {n(p, f' AND {OK}')} AS {p}_classified_sentiment_reviews, {n(p, f' AND NOT {OK}')} AS {p}_historical_sentiment_unavailable_reviews, {n(p, f' AND {OK} AND sentiment_label = {chr(39)}negative{chr(39)}')} / nullif({n(p, f' AND {OK}')}, 0) AS {p}_negative_sentiment_share" for p in BA)
    return f"WITH {_states(False)}, g AS (SELECT release_event_id, application_package, release_date, country_code, language_code, {cols} FROM st GROUP BY ALL) SELECT *, after_mean_sampled_review_stars - before_mean_sampled_review_stars AS sampled_stars_after_minus_before, after_low_star_share - before_low_star_share AS low_star_share_after_minus_before, after_negative_sentiment_share - before_negative_sentiment_share AS negative_sentiment_share_after_minus_before FROM g"


def _q41() -> str:
    few = " OR ".join(f"{p}_{m}_eligible_n < 3" for m in MET for p in BA)
    nos, nor = "(s.rel IS NULL OR store_before_days = 0 OR store_after_days = 0)", "(v.rel IS NULL OR review_before_n = 0 OR review_after_n = 0)"
    counts = ", ".join([f"network_{p}_{n}_n" for n in ("manifest", "observed", "analyzed") for p in BA] + [f"{p}_{m}_eligible_n" for m in MET for p in BA])
    return f"""WITH el AS ({ELIG}), {_states(True)}, {_pivot_net()},
 s AS (SELECT m.release_event_id AS rel, crawl_country_code AS store_country_code, crawl_language_code AS store_language_code, count(DISTINCT d) FILTER (WHERE d BETWEEN baseline_start AND baseline_end) AS store_before_days, count(DISTINCT d) FILTER (WHERE d BETWEEN followup_start AND followup_end) AS store_after_days, max(collected_at) AS store_latest_source_at
  FROM el JOIN {{release_manifest}} m ON m.application_package = el.package_name WHERE d BETWEEN baseline_start AND baseline_end OR d BETWEEN followup_start AND followup_end GROUP BY ALL),
 v AS (SELECT release_event_id AS rel, country_code AS vc, language_code AS vl, count(DISTINCT rid) {F('before')} AS review_before_n, count(DISTINCT rid) {F('after')} AS review_after_n, max(observed_at) AS review_latest_source_at FROM st GROUP BY ALL),
 n AS (SELECT release_event_id AS rel, {NETC}, {NETN % (('network_',) * 6)}, {NETE}, max(capture_finished_at_utc) AS network_latest_source_at FROM pc WHERE period IS NOT NULL GROUP BY ALL)
 SELECT m.release_event_id, m.application_package, m.release_date, previous_version, new_version, release_date_precision, release_date_verified, store_country_code, store_language_code, n.* EXCLUDE (rel), store_before_days, store_after_days, review_before_n, review_after_n, store_latest_source_at, review_latest_source_at, network_state,
 CASE WHEN s.rel IS NULL THEN 'store_locale_unavailable' WHEN {nos} THEN 'store_same_locale_period_missing' ELSE 'store_same_locale_ready' END AS store_locale_status, CASE WHEN {nor} THEN 'same_locale_review_cohort_missing' ELSE 'same_locale_review_cohort_ready' END AS store_review_locale_status,
 CASE WHEN NOT release_date_verified OR release_date_precision <> 'day' THEN 'release_metadata_insufficient' WHEN baseline_start IS NULL OR baseline_end IS NULL OR followup_start IS NULL OR followup_end IS NULL THEN 'release_windows_missing' WHEN {nos} THEN 'store_same_locale_period_missing' WHEN {nor} THEN 'same_locale_review_cohort_missing'
 WHEN network_state NOT IN ('NETWORK_DATA_AVAILABLE', 'NETWORK_COMPARISON_INSUFFICIENT', 'NETWORK_COMPARISON_READY') THEN 'base_store_review_ready_network_unavailable' WHEN n.rel IS NULL THEN 'no_period_eligible_network_conditions' WHEN {few} THEN 'network_metric_period_insufficient' ELSE 'multi_source_descriptive_evidence_available' END AS evidence_matrix_status
 FROM {{release_manifest}} m LEFT JOIN s ON s.rel = m.release_event_id LEFT JOIN v ON v.rel = m.release_event_id AND v.vc = s.store_country_code AND v.vl = s.store_language_code LEFT JOIN n ON n.rel = m.release_event_id, {{capabilities}}"""


def _pairs() -> str:
    same = [c for c in "experiment_id, session_id, scenario, trial_number, file_cohort_id, test_file_size_bytes, device_model, android_version, network_type, network_profile, comparison_cohort_id, capture_tool, capture_tool_version, experiment_phase".split(", ")]
    shown = ", ".join(f"min({c}) AS {c}" for c in same if c not in ("trial_number", "experiment_phase"))
    sides = ", ".join(f"max(application_package) FILTER (WHERE side = {k}) AS application_{s}, bool_or(th) FILTER (WHERE side = {k}) AS application_{s}_throughput_eligible, bool_or(am) FILTER (WHERE side = {k}) AS application_{s}_amplification_eligible, max(effective_file_throughput_mbps) FILTER (WHERE side = {k} AND th) AS application_{s}_effective_mbps, max(total_transfer_amplification_ratio) FILTER (WHERE side = {k} AND am) AS application_{s}_amplification" for s, k in (("a", 1), ("b", 2)))
    one = " AND ".join(f"count(DISTINCT {c}) = 1" for c in same)
    return f"""WITH tr AS ({TRIALS}), sd AS (SELECT *, {E['throughput']} AS th, {E['amplification']} AS am, row_number() OVER (PARTITION BY pair_id ORDER BY application_package, capture_id) AS side FROM tr WHERE pair_id IS NOT NULL),
 g AS (SELECT pair_id, {shown}, max(capture_started_at_utc) AS pair_observed_at_utc, count(*) AS pair_members, {sides}, bool_and(th) AS throughput_both_eligible, bool_and(am) AS amplification_both_eligible, count(*) = 2 AND count(DISTINCT application_package) = 2 AND {one} AS pair_conditions_valid FROM sd GROUP BY pair_id)
 SELECT *, CASE WHEN pair_conditions_valid AND throughput_both_eligible THEN application_b_effective_mbps - application_a_effective_mbps END AS b_minus_a_effective_mbps, CASE WHEN pair_conditions_valid AND amplification_both_eligible THEN application_b_amplification - application_a_amplification END AS b_minus_a_amplification,
 CASE WHEN NOT pair_conditions_valid THEN 'invalid_pair_identity_or_conditions' WHEN NOT throughput_both_eligible AND NOT amplification_both_eligible THEN 'both_metrics_ineligible' WHEN NOT throughput_both_eligible THEN 'throughput_pair_ineligible' WHEN NOT amplification_both_eligible THEN 'amplification_pair_ineligible' ELSE 'descriptive_paired_observation' END AS pair_status FROM g"""


NDAY = f"SELECT application_package AS np, scenario, network_profile, CAST(capture_started_at_utc AS DATE) AS nd, count(DISTINCT capture_id) AS network_capture_count, max(capture_finished_at_utc) AS network_source_at_utc, quantile_cont(effective_file_throughput_mbps, 0.5) FILTER (WHERE comparison_ready) AS median_per_capture_effective_file_throughput_mbps, count(DISTINCT rid) FILTER (WHERE comparison_ready AND effective_file_throughput_mbps IS NOT NULL) AS throughput_eligible_n FROM ({LOOSE}) GROUP BY ALL"
SNAP = "SELECT s.*, s.id AS sid, CAST(s.collected_at AS DATE) AS d, c.country_code AS crawl_country_code, c.language_code AS crawl_language_code FROM {playstore_app_snapshots} s JOIN {crawl_tasks} c ON c.id = s.crawl_task_id WHERE c.status = 'succeeded'%s"
STORE_LAST = f"SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY {LOC} ORDER BY collected_at DESC, sid DESC) = 1"

QUESTIONS: dict[str, str] = {
    "q01_portfolio_current": f"""WITH el AS ({ELIG}), ct AS ({CAT}), la AS (SELECT *, count(*) OVER (PARTITION BY application_id) AS n FROM el QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY collected_at DESC, sid DESC) = 1)
 SELECT a.id AS application_id, a.name AS application_name, a.package_name, a.is_active, primary_category_code, primary_category_name, a.country_code AS registry_country_code, a.language_code AS registry_language_code, crawl_country_code, crawl_language_code, collected_at AS latest_collected_at, score AS latest_store_score_0_to_5,
 ratings_count, reviews_count, min_installs AS min_installs_threshold, store_updated_on, version, ad_supported, source_adapter, n AS successful_snapshot_count, collected_at IS NOT NULL AS has_successful_snapshot, CASE WHEN collected_at IS NULL THEN 'missing' ELSE 'available' END AS snapshot_coverage_status, round({AGE('collected_at')}, 1) AS snapshot_age_hours
 FROM {{applications}} a LEFT JOIN ct ON ct.app = a.id LEFT JOIN la ON la.application_id = a.id""",
    "q02_store_rating_daily": f"WITH el AS ({ELIG}) SELECT {NAMED}, d AS snapshot_day_utc, collected_at AS daily_last_collected_at, score AS store_score_0_to_5, ratings_count, reviews_count, source_adapter, snapshots_in_day FROM ({DAILY}) WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'",
    "q03_rating_vs_category": f"""WITH el AS ({ELIG}), ct AS ({CAT}), la AS (SELECT el.*, ct.* FROM (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY {LOC} ORDER BY collected_at DESC, sid DESC) = 1) el LEFT JOIN ct ON ct.app = el.application_id),
 pe AS (SELECT f.application_id AS fa, f.crawl_country_code AS fc, f.crawl_language_code AS fl, count(DISTINCT p.application_id) AS n, quantile_cont(p.score, 0.5) AS m FROM la f JOIN la p ON p.cid = f.cid AND p.application_id <> f.application_id AND p.crawl_country_code = f.crawl_country_code AND p.crawl_language_code = f.crawl_language_code AND p.d = f.d GROUP BY ALL)
 SELECT application_id, application_name, package_name, primary_category_code, primary_category_name, crawl_country_code, crawl_language_code, d AS comparator_day_utc, collected_at AS latest_collected_at, score AS application_store_score_0_to_5, coalesce(n, 0) AS peer_app_count, CASE WHEN n >= 2 THEN m END AS peer_median_score_0_to_5, CASE WHEN n >= 2 THEN score - m END AS score_minus_peer_median,
 CASE WHEN cid IS NULL THEN 'no_primary_category' WHEN coalesce(n, 0) = 0 THEN 'no_same_date_locale_peers' WHEN n = 1 THEN 'insufficient_one_peer' WHEN n = 2 THEN 'limited_two_peer_sample' ELSE 'three_plus_peers' END AS peer_benchmark_status, round({AGE('collected_at')}, 1) AS data_age_hours FROM la LEFT JOIN pe ON fa = application_id AND fc = crawl_country_code AND fl = crawl_language_code""",
    "q04_counts_growth": f"WITH el AS ({ELIG}), dl AS ({DAILY}) SELECT {NAMED}, d AS snapshot_day_utc, collected_at AS daily_last_collected_at, snapshots_in_day, " + ", ".join(f"{x}, lag({x}) OVER w AS previous_{x}, {x} - lag({x}) OVER w AS {x}_change, CASE WHEN lag({x}) OVER w IS NOT NULL THEN {x} < lag({x}) OVER w END AS {x}_negative_correction" for x in ("ratings_count", "reviews_count")) + f", lag(d) OVER w AS previous_observation_day_utc, date_diff('day', lag(d) OVER w, d) AS days_since_previous_observation FROM dl WINDOW w AS {PREV} QUALIFY d >= DATE '2024-01-10'",
    "q05_install_milestones": f"""WITH el AS ({ELIG}), dl AS (SELECT *, lag(min_installs) OVER w AS pv, lag(d) OVER w AS pd FROM ({DAILY}) WINDOW w AS {PREV}) SELECT {NAMED}, d AS snapshot_day_utc, collected_at AS daily_last_collected_at, snapshots_in_day, min_installs AS min_installs_threshold, pv AS previous_min_installs_threshold, CASE WHEN min_installs <> pv THEN min_installs - pv END AS observed_threshold_change,
 CASE WHEN pv IS NULL OR min_installs > pv THEN min_installs END AS newly_observed_higher_threshold, CASE WHEN pv IS NULL THEN 'first_observation' WHEN min_installs > pv THEN 'higher_threshold' WHEN min_installs < pv THEN 'lower_revision' ELSE 'unchanged' END AS threshold_observation_status, min_installs < pv AS is_negative_threshold_revision, pd AS previous_observation_day_utc, date_diff('day', pd, d) AS days_since_previous_observation FROM dl""",
    "q06_executive_summary": f"WITH el AS ({ELIG}), la AS (SELECT application_id, max(collected_at) AS c FROM el GROUP BY 1) SELECT count(*) AS portfolio_application_count, count(c) AS applications_with_snapshot, count(*) - count(c) AS applications_missing_snapshot, max(c) AS newest_snapshot_at, min(c) AS oldest_latest_snapshot_at, {AGE('max(c)')} AS newest_snapshot_age_hours, {AGE('min(c)')} AS oldest_latest_snapshot_age_hours FROM {{applications}} a LEFT JOIN la ON la.application_id = a.id",
    "q07_category_summary": f"WITH el AS ({ELIG}), ct AS ({CAT}), la AS (SELECT * FROM el QUALIFY row_number() OVER (PARTITION BY application_id ORDER BY collected_at DESC, sid DESC) = 1) SELECT primary_category_code, primary_category_name, count(*) AS application_count, count(collected_at) AS applications_with_snapshot, avg(score) AS mean_latest_store_score_0_to_5, min(collected_at) AS oldest_latest_snapshot_at, max(collected_at) AS newest_latest_snapshot_at FROM {{applications}} a LEFT JOIN ct ON ct.app = a.id LEFT JOIN la ON la.application_id = a.id GROUP BY ALL",
    "q08_rating_changes": f"WITH el AS ({ELIG}), dl AS ({DAILY}) SELECT {NAMED}, d AS snapshot_day_utc, collected_at AS daily_last_collected_at, score AS store_score_0_to_5, lag(score) OVER w AS previous_store_score_0_to_5, score - lag(score) OVER w AS store_score_change_points, lag(d) OVER w AS previous_observation_day_utc, date_diff('day', lag(d) OVER w, d) AS days_since_previous_observation, snapshots_in_day FROM dl WINDOW w AS {PREV}",
    "q09_investigation": f"""WITH el AS ({ELIG}), dl AS (SELECT *, lag(d) OVER w AS pd, lag(score) OVER w AS ps, lag(ratings_count) OVER w AS pr, lag(reviews_count) OVER w AS pv FROM ({DAILY}) WINDOW w AS {PREV}) SELECT {NAMES}, d AS snapshot_day_utc, collected_at, score AS latest_score_0_to_5, score - ps AS score_change_points, ratings_count - pr AS ratings_count_change, reviews_count - pv AS reviews_count_change, date_diff('day', pd, d) AS observation_gap_days,
 CASE WHEN pd IS NULL THEN 'no_baseline' WHEN ratings_count < pr OR reviews_count < pv THEN 'negative_count_correction' WHEN date_diff('day', pd, d) > 1 THEN 'observation_gap' WHEN score <> ps THEN 'rating_changed' ELSE 'no_defined_signal' END AS investigation_signal FROM dl QUALIFY row_number() OVER (PARTITION BY {LOC} ORDER BY d DESC) = 1""",
    "q10_star_distribution": cohort("2024-01-03", "2024-01-20") + f"SELECT {NAMES}, score AS review_stars_1_to_5, count(*) AS unique_review_count, max(observed_at) AS latest_observation_at FROM ch GROUP BY ALL",
    "q11_review_cohort_kpis": cohort() + f"SELECT {NAMES}, count(*) AS unique_review_count, avg(score) AS mean_unique_review_stars_1_to_5, count(*) FILTER (WHERE score < 3) AS negative_review_count_1_2_stars, count(*) FILTER (WHERE score > 3) AS positive_review_count_4_5_stars, count(*) FILTER (WHERE score < 3) / count(*) AS negative_review_share, count(*) FILTER (WHERE score > 3) / count(*) AS positive_review_share, min(first_observed_at) AS earliest_first_observed_at, max(first_observed_at) AS latest_first_observed_at, max(observed_at) AS latest_observed_at, {AGE('max(observed_at)')} AS observation_age_hours FROM ch GROUP BY ALL",
    "q12_review_revisions": f"WITH ob AS ({OBS}), tr AS (SELECT *, lag(score) OVER (PARTITION BY review_id ORDER BY observed_at, crawl_task_id) AS ps FROM ob) SELECT {NAMES}, CAST(observed_at AS DATE) AS transition_day_utc, count(*) AS score_revision_count, count(*) FILTER (WHERE score > ps) AS score_upgrade_count, count(*) FILTER (WHERE score < ps) AS score_downgrade_count FROM tr WHERE ps <> score AND crawl_country_code = 'ir' GROUP BY ALL",
    "q13_sentiment_coverage": cohort() + f"SELECT {NAMES}, count(*) AS eligible_unique_reviews, " + ", ".join(f"count(*) FILTER (WHERE sentiment_status = '{s}') AS {s}_reviews" for s in ("pending", "skipped", "failed", "done")) + f", count(*) FILTER (WHERE {OK}) AS classified_unique_reviews, count(*) FILTER (WHERE {OK}) / count(*) AS classification_coverage, max(observed_at) AS latest_observed_at FROM ch GROUP BY ALL",
    "q14_sentiment_distribution": cohort() + f"SELECT *, sum(classified_unique_reviews_for_label) OVER w AS classified_sample_size, classified_unique_reviews_for_label / sum(classified_unique_reviews_for_label) OVER w AS sentiment_share FROM (SELECT {NAMES}, sentiment_label, count(*) AS classified_unique_reviews_for_label FROM ch WHERE {OK} GROUP BY ALL) WINDOW w AS (PARTITION BY {NAMES})",
    "q15_sentiment_trend": cohort() + f"SELECT {NAMES}, CAST(first_observed_at AS DATE) AS first_observed_day_utc, count(*) AS eligible_unique_reviews, count(*) FILTER (WHERE {OK}) AS classified_unique_reviews, count(*) FILTER (WHERE {OK} AND sentiment_label = 'negative') AS negative_classified_reviews, count(*) FILTER (WHERE {OK} AND sentiment_label = 'negative') / nullif(count(*) FILTER (WHERE {OK}), 0) AS negative_sentiment_share FROM ch GROUP BY ALL",
    "q16_sentiment_language": cohort() + f"SELECT *, sum(unique_classified_reviews) OVER w AS language_classified_sample_size, unique_classified_reviews / sum(unique_classified_reviews) OVER w AS share_in_language FROM (SELECT {NAMES}, sentiment_language, sentiment_label, count(*) AS unique_classified_reviews FROM ch WHERE {OK} GROUP BY ALL) WINDOW w AS (PARTITION BY {NAMES}, sentiment_language)",
    "q17_stars_vs_sentiment": cohort() + f"SELECT {NAMES}, score AS review_stars_1_to_5, CASE WHEN {OK} THEN sentiment_label ELSE 'unclassified' END AS sentiment_measure, count(*) AS unique_review_count, count(*) FILTER (WHERE {OK}) AS classified_sample_size FROM ch GROUP BY ALL",
    "q18_direct_pair": f"WITH el AS ({ELIG}), dl AS ({DAILY}) SELECT a.d AS snapshot_day_utc, a.crawl_country_code, a.crawl_language_code, a.score AS score_a, a.collected_at AS collected_at_a, b.score AS score_b, b.collected_at AS collected_at_b, a.score - b.score AS a_minus_b_score_points FROM dl a JOIN dl b ON a.d = b.d AND a.crawl_country_code = b.crawl_country_code AND a.crawl_language_code = b.crawl_language_code WHERE a.package_name = 'com.app.n1' AND b.package_name = 'com.app.n2'",
    "q19_ratings_count_changes": _counts("ratings_count", "ratings"),
    "q20_reviews_count_changes": _counts("reviews_count", "reviews"),
    "q21_current_install_threshold": f"WITH el AS ({ELIG}) SELECT {NAMES}, min_installs AS min_installs_threshold, collected_at AS latest_collected_at FROM el QUALIFY row_number() OVER (PARTITION BY {LOC} ORDER BY collected_at DESC, sid DESC) = 1",
    "q22_latest_rating": f"WITH el AS ({ELIG}) SELECT {NAMES}, score AS latest_store_score_0_to_5, collected_at AS latest_collected_at FROM el QUALIFY row_number() OVER (PARTITION BY {LOC} ORDER BY collected_at DESC, sid DESC) = 1",
    "q23_first_observed_daily": f"WITH ob AS ({OBS}) SELECT {NAMES}, CAST(first_observed_at AS DATE) AS first_observed_day_utc, count(*) AS newly_observed_unique_reviews FROM (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY review_id ORDER BY observed_at, crawl_task_id) = 1) GROUP BY ALL",
    "q24_sampling_coverage": f"WITH ob AS ({OBS}), sa AS (SELECT app, crawl_country_code AS cc, crawl_language_code AS cl, count(DISTINCT review_id) AS u, max(observed_at) AS l FROM ob GROUP BY ALL), tk AS (SELECT a.id AS app, a.name AS application_name, a.package_name, c.country_code AS crawl_country_code, c.language_code AS crawl_language_code, count(*) AS review_crawl_tasks, count(*) FILTER (WHERE status = 'succeeded') AS successful_review_crawl_tasks FROM {{crawl_tasks}} c JOIN {{applications}} a ON a.id = c.application_id WHERE task_type = 'reviews' GROUP BY ALL) SELECT {NAMES}, review_crawl_tasks, successful_review_crawl_tasks, successful_review_crawl_tasks / review_crawl_tasks AS crawl_task_success_share, coalesce(u, 0) AS unique_reviews_in_sample, l AS latest_review_observation_at FROM tk LEFT JOIN sa ON sa.app = tk.app AND cc = crawl_country_code AND cl = crawl_language_code",
    "q25_network_readiness": "SELECT c.*, (SELECT count(*) FROM {experiment_manifest}) AS manifest_capture_count, (SELECT count(DISTINCT experiment_id) FROM {experiment_manifest}) AS experiment_count, (SELECT count(*) FROM {experiment_manifest} WHERE transfer_completed AND capture_isolation_confirmed AND cache_cleared_or_download_verified) AS provenance_complete_count, (SELECT count(pair_id) FROM {experiment_manifest}) AS paired_capture_count, CASE WHEN network_state = 'NETWORK_EMPTY' THEN 'schema is readable but contains no captures' ELSE 'descriptive comparison available, not causal' END AS operator_interpretation FROM {capabilities} c",
    "q26_experiment_coverage": f"""WITH tr AS ({TRIALS}), me AS (SELECT tr.*, m.* FROM tr, LATERAL (VALUES ('effective_file_throughput_mbps', status = 'analyzed' AND {PROV} AND rid IS NOT NULL AND {MEAS}), ('total_transfer_amplification_ratio', status = 'analyzed' AND {PROV} AND rid IS NOT NULL AND total_transfer_amplification_ratio IS NOT NULL), ('ip_transport_header_overhead_ratio', rid IS NOT NULL AND ip_transport_header_overhead_ratio IS NOT NULL), ('tcp_recovery_tax', rid IS NOT NULL AND tcp_present AND tcp_recovery_tax IS NOT NULL)) m(metric_name, eligible)),
 ex AS (SELECT *, CASE WHEN eligible THEN NULL WHEN status IS NULL THEN 'capture_not_found' WHEN status <> 'analyzed' THEN 'capture_not_analyzed' WHEN NOT transfer_completed THEN 'transfer_incomplete' WHEN csize <> test_file_size_bytes THEN 'transfer_size_mismatch' WHEN NOT capture_isolation_confirmed THEN 'capture_isolation_unconfirmed' WHEN NOT cache_cleared_or_download_verified THEN 'cache_or_download_verification_missing' WHEN rid IS NULL THEN 'analysis_missing' WHEN truncated_packet_count > 0 THEN 'truncated_packets'
 WHEN metric_name = 'effective_file_throughput_mbps' AND NOT direction_metadata_available THEN 'direction_metadata_missing' WHEN metric_name = 'effective_file_throughput_mbps' AND observed_primary_payload_span_ms IS NULL THEN 'primary_payload_span_missing' WHEN metric_name = 'tcp_recovery_tax' AND NOT tcp_present THEN 'tcp_not_present' ELSE 'metric_unavailable' END AS x FROM me)
 SELECT experiment_id, session_id, application_name, application_package, scenario, network_profile, metric_name, count(DISTINCT capture_id) AS manifest_capture_count, count(DISTINCT capture_id) FILTER (WHERE rid IS NOT NULL) AS analyzed_capture_count, count(DISTINCT capture_id) FILTER (WHERE eligible) AS eligible_capture_count, string_agg(DISTINCT x, ', ' ORDER BY x) AS exclusion_reasons, min(capture_started_at_utc) AS first_capture_at_utc, max(capture_finished_at_utc) AS last_capture_at_utc FROM ex GROUP BY ALL""",
    "q27_trial_transfer": f"""WITH tr AS ({TRIALS}) SELECT capture_id, experiment_id, session_id, trial_number, pair_id, application_name, application_package, scenario, network_profile, device_model, app_version, capture_started_at_utc, capture_finished_at_utc, test_file_size_bytes, capture_duration_ms, observed_primary_payload_span_ms, CASE WHEN status = 'analyzed' AND {PROV} AND {MEAS} THEN effective_file_throughput_mbps END AS effective_file_throughput_mbps, average_network_throughput_mbps,
 CASE WHEN status = 'analyzed' AND transfer_completed AND capture_isolation_confirmed AND csize = test_file_size_bytes THEN total_transfer_amplification_ratio END AS total_transfer_amplification_ratio, CASE WHEN rid IS NULL THEN 'analysis_missing' WHEN NOT comparison_ready THEN 'comparison_not_ready' WHEN truncated_packet_count > 0 THEN 'truncated_packets' WHEN NOT direction_metadata_available THEN 'direction_metadata_missing' ELSE 'eligible' END AS throughput_eligibility FROM tr""",
    "q28_network_efficiency": f"WITH tr AS ({TRIALS}) SELECT capture_id, {N8}, network_bytes_total, test_file_size_bytes, CASE WHEN status = 'analyzed' AND {PROV} THEN total_transfer_amplification_ratio END AS total_transfer_amplification_ratio, CASE WHEN network_bytes_total > 0 THEN ip_transport_header_overhead_ratio END AS ip_transport_header_overhead_ratio, primary_direction_amplification_ratio, reverse_path_cost_ratio, coalesce(status = 'analyzed' AND {PROV}, false) AND total_transfer_amplification_ratio IS NOT NULL AS amplification_eligible, coalesce(network_bytes_total > 0, false) AND ip_transport_header_overhead_ratio IS NOT NULL AS header_overhead_eligible FROM tr",
    "q29_tcp_stability": f"WITH tr AS ({TRIALS}) SELECT capture_id, {N8}, tcp_present, quic_present, " + ", ".join(f"CASE WHEN tcp_present THEN {v} END AS {k}" for k, v in {"tcp_connection_count": "tcp_connection_count", "tcp_handshake_success_rate": "tcp_handshake_success_rate", "tcp_initial_rtt_average_ms": "tcp_initial_rtt_avg_ms", "tcp_initial_rtt_p50_within_capture_ms": "tcp_initial_rtt_p50_ms", "tcp_ack_rtt_p95_within_capture_ms": "tcp_ack_rtt_p95_ms", "tcp_retransmitted_segment_indicator_count": "tcp_retransmission_count", "tcp_retransmitted_segment_indicator_ratio": "tcp_retransmission_rate", "tcp_retransmitted_payload_share_recovery_tax": "tcp_recovery_tax", "tcp_receiver_stall_ratio": "tcp_receiver_stall_ratio", "tcp_reset_flow_ratio": "tcp_reset_rate"}.items()) + ", CASE WHEN tcp_present THEN 'eligible_tcp_capture' WHEN rid IS NULL THEN 'analysis_missing' WHEN quic_present THEN 'not_applicable_quic_without_tcp' ELSE 'tcp_not_observed' END AS tcp_metric_status FROM tr",
    "q30_protocol_capability": f"WITH tr AS ({TRIALS}) SELECT capture_id, {N8}, rid IS NOT NULL AS analysis_available, comparison_ready, direction_metadata_available, handshake_observed, tcp_present, quic_present, other_udp_present, tcp_rtt_available, quic_initial_rtt_available, quic_spin_rtt_available, dns_metrics_available, tcp_byte_share, quic_byte_share, other_udp_byte_share, analysis_warning_count, CASE WHEN tcp_present AND quic_present THEN 'mixed_tcp_quic' WHEN quic_present THEN 'quic_observed_tcp_metrics_not_applicable' WHEN tcp_present THEN 'tcp_observed' WHEN rid IS NULL THEN 'analysis_missing' ELSE 'other_or_unclassified_transport' END AS protocol_capability_status FROM tr",
    "q31_benchmark_summary": f"WITH tr AS ({TRIALS}), g AS (SELECT experiment_id, session_id, application_name, application_package, scenario, comparison_cohort_id, {COND}, count(DISTINCT capture_id) AS n_total, count(DISTINCT capture_id) FILTER (WHERE rid IS NOT NULL) AS n_analyzed, " + ", ".join(f"count(DISTINCT capture_id) FILTER (WHERE {e}) AS {k}_eligible_n, quantile_cont({VALUE[k]}, 0.5) FILTER (WHERE {e}) AS m_{k}" for k, e in E.items()) + f", min(effective_file_throughput_mbps) FILTER (WHERE {E['throughput']}) AS lo, max(effective_file_throughput_mbps) FILTER (WHERE {E['throughput']}) AS hi, array_agg(effective_file_throughput_mbps ORDER BY trial_number, capture_id) FILTER (WHERE {E['throughput']}) AS vs FROM tr GROUP BY ALL) SELECT * EXCLUDE (lo, hi, vs, " + ", ".join(f"m_{k}" for k in E) + "), throughput_eligible_n AS n_valid, CASE WHEN throughput_eligible_n < 3 THEN 'insufficient_under_3' WHEN throughput_eligible_n <= 5 THEN 'descriptive_only_3_to_5' ELSE 'descriptive_sample_over_5' END AS comparison_status, " + ", ".join(f"CASE WHEN {k}_eligible_n < 3 THEN 'insufficient_under_3' ELSE 'eligible' END AS {k}_status, CASE WHEN {k}_eligible_n >= 3 THEN m_{k} END AS {SHOWN[k]}" for k in E) + ", " + ", ".join(f"CASE WHEN throughput_eligible_n >= 3 THEN {x} END AS {y}" for x, y in (("lo", "min_effective_file_throughput_mbps"), ("hi", "max_effective_file_throughput_mbps"), ("vs", "eligible_trial_effective_throughput_values_mbps"))) + " FROM g",
    "q32_paired_comparison": _pairs(),
    "q33_source_coverage": f"""WITH sn AS ({SNAP % " AND c.task_type = 'app_details'"}), s AS ({STORE_LAST}), r AS (SELECT r.application_id, count(DISTINCT r.id) AS u, max(o.observed_at) AS ro FROM {{reviews}} r LEFT JOIN {{review_observations}} o ON o.review_id = r.id GROUP BY 1), n AS (SELECT application_package AS np, count(DISTINCT capture_id) AS mc, count(DISTINCT rid) AS ac, count(DISTINCT rid) FILTER (WHERE comparison_ready) AS cc, max(capture_finished_at_utc) AS nf FROM ({LOOSE}) GROUP BY 1)
 SELECT a.name AS application_name, a.package_name, s.crawl_country_code AS store_country_code, s.crawl_language_code AS store_language_code, s.score AS latest_store_score_0_to_5, s.collected_at AS latest_store_observed_at_utc, u AS unique_sampled_reviews, ro AS latest_review_observed_at_utc, mc AS manifest_capture_count, ac AS analyzed_capture_count, cc AS comparison_ready_capture_count, nf AS latest_network_capture_at_utc, date_diff('microsecond', least(s.collected_at, ro, nf), greatest(s.collected_at, ro, nf)) / 3600000000.0 AS cross_source_observation_gap_hours
 FROM {{applications}} a LEFT JOIN s ON s.application_id = a.id LEFT JOIN r ON r.application_id = a.id LEFT JOIN n ON np = a.package_name WHERE a.package_name IN {PK}""",
    "q34_store_network_daily": f"""WITH sn AS ({SNAP % " AND c.task_type = 'app_details'"}), s AS (SELECT sn.*, a.package_name AS sp, count(*) OVER (PARTITION BY {LOC}, d) AS k FROM sn JOIN {{applications}} a ON a.id = sn.application_id QUALIFY row_number() OVER (PARTITION BY {LOC}, d ORDER BY collected_at DESC, sid DESC) = 1), n AS ({NDAY})
 SELECT coalesce(sp, np) AS package_name, coalesce(d, nd) AS observed_day_utc, crawl_country_code AS store_country_code, crawl_language_code AS store_language_code, score AS store_score_0_to_5, collected_at AS store_source_at_utc, scenario, network_profile, network_capture_count, throughput_eligible_n, median_per_capture_effective_file_throughput_mbps, network_source_at_utc, CASE WHEN d = nd THEN 'same_utc_day_only_not_causal' WHEN d IS NULL THEN 'store_missing_for_network_day' ELSE 'network_missing_for_store_day' END AS alignment_status
 FROM s FULL JOIN n ON np = sp AND nd = d WHERE coalesce(sp, np) IN {PK}""",
    "q35_user_voice_network": f"""WITH rv AS (SELECT a.package_name AS rp, r.id, CAST(r.first_observed_at AS DATE) AS rd, o.score FROM {{reviews}} r JOIN {{applications}} a ON a.id = r.application_id JOIN {{review_observations}} o ON o.review_id = r.id AND o.observed_at < CAST(CAST(r.first_observed_at AS DATE) + 1 AS TIMESTAMP) QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY o.observed_at DESC, o.crawl_task_id DESC) = 1),
 rd AS (SELECT rp, rd, CAST(rd + 1 AS TIMESTAMP) AS as_of_cutoff_exclusive_utc, count(*) AS unique_sampled_reviews, avg(score) AS mean_sampled_review_stars_1_to_5, count(*) FILTER (WHERE score <= 2) / count(*) AS low_star_share FROM rv GROUP BY rp, rd), n AS ({NDAY})
 SELECT coalesce(rp, np) AS package_name, coalesce(rd, nd) AS utc_day, as_of_cutoff_exclusive_utc, unique_sampled_reviews, mean_sampled_review_stars_1_to_5, low_star_share, scenario, network_profile, network_capture_count AS manifest_capture_count, median_per_capture_effective_file_throughput_mbps FROM rd FULL JOIN n ON np = rp AND nd = rd WHERE coalesce(rp, np) IN {PK}""",
    "q36_pair_comparison_matrix": f"""WITH sn AS ({SNAP % ""}), s AS ({STORE_LAST}), lr AS (SELECT r.application_id AS ra, o.score FROM {{review_observations}} o JOIN {{reviews}} r ON r.id = o.review_id QUALIFY row_number() OVER (PARTITION BY r.id ORDER BY o.observed_at DESC, o.crawl_task_id DESC) = 1), r AS (SELECT ra, count(*) AS u, avg(score) AS st FROM lr GROUP BY 1),
 n AS (SELECT application_package AS np, experiment_id, session_id, scenario, {COND}, count(DISTINCT capture_id) AS manifest_capture_count, count(DISTINCT capture_id) FILTER (WHERE {E['throughput']}) AS comparison_ready_n, quantile_cont(effective_file_throughput_mbps, 0.5) FILTER (WHERE {E['throughput']}) AS med, max(capture_finished_at_utc) AS network_source_at_utc FROM ({LOOSE}) GROUP BY ALL)
 SELECT CASE WHEN a.package_name IN ('com.app.n0', 'com.app.n1') THEN 'first' ELSE 'second' END AS comparison_pair, a.name AS application_name, a.package_name, s.crawl_country_code AS store_country_code, s.crawl_language_code AS store_language_code, s.score AS latest_store_score_0_to_5, s.collected_at AS store_source_at_utc, u AS unique_sampled_reviews, st AS mean_observed_review_stars, n.* EXCLUDE (np, med),
 CASE WHEN comparison_ready_n >= 3 THEN med END AS median_per_capture_effective_file_throughput_mbps, CASE WHEN coalesce(comparison_ready_n, 0) < 3 THEN 'network_comparison_insufficient' WHEN comparison_ready_n <= 5 THEN 'network_descriptive_only_3_to_5' ELSE 'network_descriptive_sample_over_5' END AS network_interpretation
 FROM {{applications}} a LEFT JOIN s ON s.application_id = a.id LEFT JOIN r ON ra = a.id LEFT JOIN n ON np = a.package_name WHERE a.package_name IN {PK}""",
    "q37_release_readiness": "SELECT m.*, c.*, CASE WHEN NOT release_date_verified THEN 'release_date_unverified' WHEN release_date_precision <> 'day' THEN 'release_date_not_day_precision' WHEN baseline_start IS NULL OR baseline_end IS NULL OR followup_start IS NULL OR followup_end IS NULL THEN 'before_after_windows_missing' ELSE 'release_metadata_ready_observational_only' END AS release_readiness FROM {release_manifest} m, {capabilities} c",
    "q38_release_network_before_after": _q38(),
    "q39_release_store_before_after": f"""WITH sn AS ({SNAP % " AND c.task_type = 'app_details'"}), dl AS (SELECT * FROM sn QUALIFY row_number() OVER (PARTITION BY {LOC}, d ORDER BY collected_at DESC, sid DESC) = 1),
 pd AS (SELECT m.release_event_id, m.application_package, m.release_date, dl.*, crawl_country_code AS country_code, crawl_language_code AS language_code, CASE WHEN d BETWEEN baseline_start AND baseline_end THEN 'before' WHEN d BETWEEN followup_start AND followup_end THEN 'after' END AS period FROM dl JOIN {{applications}} a ON a.id = dl.application_id JOIN {{release_manifest}} m ON m.application_package = a.package_name WHERE release_date_verified AND release_date_precision = 'day'),
 g AS (SELECT release_event_id, application_package, release_date, country_code, language_code, """ + ", ".join(f"count(DISTINCT d) {F(p)} AS {p}_observed_days, quantile_cont(score, 0.5) {F(p)} AS {p}_median_daily_store_score, arg_max(ratings_count, d) {F(p)} AS {p}_endpoint_ratings_count, arg_max(reviews_count, d) {F(p)} AS {p}_endpoint_reviews_count, max(collected_at) {F(p)} AS {p}_latest_source_at_utc" for p in BA) + """ FROM pd WHERE period IS NOT NULL GROUP BY ALL)
 SELECT *, after_median_daily_store_score - before_median_daily_store_score AS store_score_after_minus_before, after_endpoint_ratings_count - before_endpoint_ratings_count AS observed_ratings_count_endpoint_difference, after_endpoint_reviews_count - before_endpoint_reviews_count AS observed_reviews_count_endpoint_difference, CASE WHEN before_observed_days = 0 OR after_observed_days = 0 THEN 'missing_period' ELSE 'observational_store_before_after_historical_locale' END AS comparison_status FROM g""",
    "q40_release_user_voice": _q40(),
    "q41_release_evidence": _q41(),
    "q42_release_exclusions": "SELECT release_event_id, application_package, release_date, release_date_precision, release_date_verified, network_state, experiment_state, sentiment_state, topic_state, concat_ws(', ', CASE WHEN NOT release_date_verified THEN 'unverified_release_date' END, CASE WHEN release_date_precision <> 'day' THEN 'release_date_not_exact_day' END, CASE WHEN baseline_start IS NULL OR baseline_end IS NULL THEN 'baseline_window_missing' END, CASE WHEN followup_start IS NULL OR followup_end IS NULL THEN 'followup_window_missing' END, CASE WHEN experiment_id_before IS NULL OR experiment_id_after IS NULL THEN 'network_experiment_ids_missing' END, CASE WHEN sentiment_state <> 'SENTIMENT_DATA_AVAILABLE' THEN 'sentiment_unavailable' END, CASE WHEN topic_state <> 'TOPIC_ANNOTATIONS_AVAILABLE' THEN 'network_complaint_topics_unavailable' END) AS exclusions FROM {release_manifest}, {capabilities}",
}


def question_sql() -> dict[str, str]:
    return {name: with_roles(sql) for name, sql in QUESTIONS.items()}
