"""Questions on network captures under experiment manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.exprs import ladder, newest, oldest, share, utc_day
from quartzite.functions.stats import count_where, distinct_where, gated, median_where, once, ordered_values, reasons, sample_label, side, uniform
from quartzite.operators import filters as E
from quartzite.operators.temporal import LOCALE, daily_last, latest_per, number_sides
from quartzite.plans.reviews import as_of_day_end, last_scores
from quartzite.plans.store import Tables, applications, snapshots

CONDITION = ["file_cohort_id", "test_file_size_bytes", "app_version", "device_model", "android_version", "network_type", "network_profile", "capture_tool", "capture_tool_version", "experiment_phase"]
NAMES = ["experiment_id", "session_id", "trial_number", "application_name", "application_package", "scenario", "network_profile", "capture_started_at_utc"]


def trials(t: Tables, own_application: bool = True, application=None, scenario=None, experiment=None, session=None, network_profile=None, start_date=None, end_date=None) -> DataFrame:
    """Manifest rows with their application, capture and analysis, where there are any.

    The manifest and the dimension drive: rows of which the capture is missing stay. own_application: the capture must
    be of the manifest's application.
    """
    m = t["experiment_manifest"]
    for column, value in (("application_package", application), ("scenario", scenario), ("experiment_id", experiment), ("session_id", session), ("network_profile", network_profile)):
        m = E.opt(m, column, value)
    m = E.between_days(m, E.started_day(), start_date, end_date)
    named = t["applications"].select(F.col("id").alias("_app"), F.col("name").alias("application_name"), F.col("package_name").alias("application_package"))
    c = t["network_captures"].select(F.col("id").alias("source_capture_id"), F.col("application_id").alias("capture_application_id"), F.col("scenario").alias("capture_scenario"), F.col("status").alias("capture_status"), F.col("transfer_file_size_bytes").alias("captured_size_bytes"))
    r = t["network_analysis_results"].withColumnsRenamed({"capture_id": "analyzed_capture", "scenario": "analysis_scenario", "package_name": "analysis_package"}).drop("application_id")
    on = F.col("source_capture_id") == F.col("capture_id")
    if own_application:
        on = on & (F.col("capture_application_id") == F.col("_app"))
    found = m.join(named, "application_package", "left").join(c, on, "left").join(r, F.col("analyzed_capture") == F.col("source_capture_id"), "left")
    return found.withColumn("analysis_available", F.col("analyzed_capture").isNotNull()).drop("_app", "capture_application_id")


def network_readiness(t: Tables) -> DataFrame:
    """Q25: one row on what can be asked."""
    whole = F.col("transfer_completed") & F.col("capture_isolation_confirmed") & F.col("cache_cleared_or_download_verified")
    m = t["experiment_manifest"].agg(F.count(F.lit(1)).alias("manifest_capture_count"), F.count_distinct("experiment_id").alias("experiment_count"), count_where(whole).alias("provenance_complete_count"), F.count("pair_id").alias("paired_capture_count"))
    text = ladder(
        (F.col("network_state") == "NETWORK_SCHEMA_MISSING", "network tables are not deployed"), (F.col("network_state") == "NETWORK_GRANTS_MISSING", "reader lacks the exact network columns"),
        (F.col("network_state") == "NETWORK_EMPTY", "schema is readable but contains no captures"), (F.col("experiment_state") != "VERIFIED_EXPERIMENT_AVAILABLE", "validated experiment metadata is required"),
        (F.col("network_state") == "NETWORK_COMPARISON_READY", "descriptive comparison available, not causal"), otherwise="capture-level evidence available, comparison thresholds may be insufficient",
    )
    return t["capabilities"].crossJoin(F.broadcast(m)).withColumn("operator_interpretation", text)


def metric_flags() -> dict[str, Column]:
    """For each metric, whether a capture counts for it."""
    ready = F.col("comparison_ready") & F.col("direction_metadata_available") & (F.col("truncated_packet_count") == 0) & (F.col("observed_primary_payload_span_ms") > 0) & F.col("effective_file_throughput_mbps").isNotNull()
    base = (F.col("capture_status") == "analyzed") & E.proven() & F.col("analysis_available")
    return {
        "effective_file_throughput_mbps": base & ready,
        "total_transfer_amplification_ratio": base & F.col("total_transfer_amplification_ratio").isNotNull(),
        "ip_transport_header_overhead_ratio": F.col("analysis_available") & F.col("ip_transport_header_overhead_ratio").isNotNull(),
        "tcp_recovery_tax": F.col("analysis_available") & F.col("tcp_present") & F.col("tcp_recovery_tax").isNotNull(),
    }


def unpivot_metrics(df: DataFrame) -> DataFrame:
    """A row for each capture and metric, with whether the capture counts for it."""
    return df.select("*", F.inline(F.array(*(F.struct(F.lit(k).alias("metric_name"), v.alias("eligible")) for k, v in metric_flags().items()))))


def exclusion_reason(metric: str, eligible: Column) -> Column:
    """Why a capture doesn't count for a metric; NULL if it does."""
    speed, recovery = F.lit(metric == "effective_file_throughput_mbps"), F.lit(metric == "tcp_recovery_tax")
    return F.when(eligible, F.lit(None)).otherwise(ladder(
        (F.col("capture_status").isNull(), "capture_not_found"), (F.col("capture_status") != "analyzed", "capture_not_analyzed"), (~F.col("transfer_completed"), "transfer_incomplete"),
        (F.col("captured_size_bytes") != F.col("test_file_size_bytes"), "transfer_size_mismatch"), (~F.col("capture_isolation_confirmed"), "capture_isolation_unconfirmed"),
        (~F.col("cache_cleared_or_download_verified"), "cache_or_download_verification_missing"), (~F.col("analysis_available"), "analysis_missing"), (F.col("truncated_packet_count") > 0, "truncated_packets"),
        (speed & ~F.col("direction_metadata_available"), "direction_metadata_missing"), (speed & F.col("observed_primary_payload_span_ms").isNull(), "primary_payload_span_missing"),
        (recovery & ~F.col("tcp_present"), "tcp_not_present"), otherwise="metric_unavailable",
    ))


def experiment_coverage(t: Tables, **f) -> DataFrame:
    """Q26: for each condition and metric, how many captures count, and why the others don't. Metrics become rows after the counting."""
    keys, flags = ["experiment_id", "session_id", "application_name", "application_package", "scenario", "network_profile"], metric_flags()
    d = once(trials(t, **f), keys, "capture_id", {"_total": F.lit(True), "_analyzed": F.col("analysis_available")} | {f"_ok_{k}": ok for k, ok in flags.items()})
    g = d.groupBy(*keys).agg(
        F.count_if("_total").alias("manifest_capture_count"), F.count_if("_analyzed").alias("analyzed_capture_count"), F.min("capture_started_at_utc").alias("first_capture_at_utc"), F.max("capture_finished_at_utc").alias("last_capture_at_utc"),
        *(F.count_if(f"_ok_{k}").alias(f"_n_{k}") for k in flags), *(reasons(exclusion_reason(k, ok)).alias(f"_why_{k}") for k, ok in flags.items()),
    )
    rows = F.inline(F.array(*(F.struct(F.lit(k).alias("metric_name"), F.col(f"_n_{k}").alias("eligible_capture_count"), F.col(f"_why_{k}").alias("exclusion_reasons")) for k in flags)))
    g = g.select(*keys, "manifest_capture_count", "analyzed_capture_count", "first_capture_at_utc", "last_capture_at_utc", rows)
    return g.select(*keys, "metric_name", "manifest_capture_count", "analyzed_capture_count", "eligible_capture_count", "exclusion_reasons", "first_capture_at_utc", "last_capture_at_utc")


def trial_transfer(t: Tables, **f) -> DataFrame:
    """Q27: one row for each capture; what isn't comparable is NULL."""
    d = trials(t, **f)
    analyzed = F.col("capture_status") == "analyzed"
    status = ladder((~F.col("analysis_available"), "analysis_missing"), (~F.col("comparison_ready"), "comparison_not_ready"), (F.col("truncated_packet_count") > 0, "truncated_packets"), (~F.col("direction_metadata_available"), "direction_metadata_missing"), otherwise="eligible")
    ready = F.col("comparison_ready") & F.col("direction_metadata_available") & (F.col("truncated_packet_count") == 0) & (F.col("observed_primary_payload_span_ms") > 0)
    moved = analyzed & F.col("transfer_completed") & F.col("capture_isolation_confirmed") & (F.col("captured_size_bytes") == F.col("test_file_size_bytes"))
    return d.select(
        "capture_id", *NAMES[:3], "pair_id", *NAMES[3:7], "device_model", "app_version", "capture_started_at_utc", "capture_finished_at_utc", "test_file_size_bytes", "capture_duration_ms", "observed_primary_payload_span_ms",
        F.when(analyzed & E.proven() & ready, F.col("effective_file_throughput_mbps")).alias("effective_file_throughput_mbps"), "average_network_throughput_mbps",
        F.when(moved, F.col("total_transfer_amplification_ratio")).alias("total_transfer_amplification_ratio"), status.alias("throughput_eligibility"),
    )


def network_efficiency(t: Tables, **f) -> DataFrame:
    """Q28."""
    d = trials(t, **f).withColumns({
        "total_transfer_amplification_ratio": F.when((F.col("capture_status") == "analyzed") & E.proven(), F.col("total_transfer_amplification_ratio")),
        "ip_transport_header_overhead_ratio": F.when(F.col("network_bytes_total") > 0, F.col("ip_transport_header_overhead_ratio")),
    })
    return d.select("capture_id", *NAMES, "network_bytes_total", "test_file_size_bytes", "total_transfer_amplification_ratio", "ip_transport_header_overhead_ratio", "primary_direction_amplification_ratio", "reverse_path_cost_ratio", F.col("total_transfer_amplification_ratio").isNotNull().alias("amplification_eligible"), F.col("ip_transport_header_overhead_ratio").isNotNull().alias("header_overhead_eligible"))


TCP_SHOWN = {"tcp_connection_count": "tcp_connection_count", "tcp_handshake_success_rate": "tcp_handshake_success_rate", "tcp_initial_rtt_average_ms": "tcp_initial_rtt_avg_ms", "tcp_initial_rtt_p50_within_capture_ms": "tcp_initial_rtt_p50_ms", "tcp_ack_rtt_p95_within_capture_ms": "tcp_ack_rtt_p95_ms", "tcp_retransmitted_segment_indicator_count": "tcp_retransmission_count", "tcp_retransmitted_segment_indicator_ratio": "tcp_retransmission_rate", "tcp_retransmitted_payload_share_recovery_tax": "tcp_recovery_tax", "tcp_receiver_stall_ratio": "tcp_receiver_stall_ratio", "tcp_reset_flow_ratio": "tcp_reset_rate"}


def tcp_stability(t: Tables, **f) -> DataFrame:
    """Q29: NULL, not zero, where there was no TCP."""
    status = ladder((F.col("tcp_present"), "eligible_tcp_capture"), (~F.col("analysis_available"), "analysis_missing"), (F.col("quic_present"), "not_applicable_quic_without_tcp"), otherwise="tcp_not_observed")
    return trials(t, **f).select("capture_id", *NAMES, "tcp_present", "quic_present", *(F.when(F.col("tcp_present"), F.col(v)).alias(k) for k, v in TCP_SHOWN.items()), status.alias("tcp_metric_status"))


CAPABILITY_COLUMNS = ["analysis_available", "comparison_ready", "direction_metadata_available", "handshake_observed", "tcp_present", "quic_present", "other_udp_present", "tcp_rtt_available", "quic_initial_rtt_available", "quic_spin_rtt_available", "dns_metrics_available", "tcp_byte_share", "quic_byte_share", "other_udp_byte_share", "analysis_warning_count"]


def protocol_capability(t: Tables, **f) -> DataFrame:
    """Q30."""
    status = ladder((F.col("tcp_present") & F.col("quic_present"), "mixed_tcp_quic"), (F.col("quic_present"), "quic_observed_tcp_metrics_not_applicable"), (F.col("tcp_present"), "tcp_observed"), (~F.col("analysis_available"), "analysis_missing"), otherwise="other_or_unclassified_transport")
    return trials(t, **f).select("capture_id", *NAMES, *CAPABILITY_COLUMNS, status.alias("protocol_capability_status"))


#: name: (eligibility, value, shown as)
BENCHMARKS = {
    "throughput": (E.eligible_throughput, "effective_file_throughput_mbps", "median_per_capture_effective_file_throughput_mbps"),
    "amplification": (E.eligible_amplification, "total_transfer_amplification_ratio", "median_per_capture_total_transfer_amplification_ratio"),
    "overhead": (E.eligible_overhead, "ip_transport_header_overhead_ratio", "median_per_capture_ip_transport_header_overhead_ratio"),
    "initial_rtt": (E.eligible_initial_rtt, "tcp_initial_rtt_avg_ms", "median_of_per_capture_tcp_initial_rtt_average_ms"),
    "ack_rtt": (E.eligible_ack_rtt, "tcp_ack_rtt_p95_ms", "median_of_per_capture_tcp_ack_rtt_p95_ms"),
    "recovery_tax": (E.eligible_recovery, "tcp_recovery_tax", "median_per_capture_tcp_recovery_tax"),
}


def benchmark_summary(t: Tables, **f) -> DataFrame:
    """Q31: six medians for each condition, each shown from three eligible captures up."""
    keys = ["experiment_id", "session_id", "application_name", "application_package", "scenario", "comparison_cohort_id", *CONDITION]
    d = trials(t, **f).withColumns({f"{k}_ok": e() for k, (e, _, _) in BENCHMARKS.items()})
    speed, ok = "effective_file_throughput_mbps", F.col("throughput_ok")
    d = once(d, keys, "capture_id", {"_total": F.lit(True), "_analyzed": F.col("analysis_available")} | {f"_{k}_once": F.col(f"{k}_ok") for k in BENCHMARKS})
    g = d.groupBy(*keys).agg(
        F.count_if("_total").alias("n_total"), F.count_if("_analyzed").alias("n_analyzed"), *(F.count_if(f"_{k}_once").alias(f"{k}_eligible_n") for k in BENCHMARKS), *(median_where(v, F.col(f"{k}_ok")).alias(f"_{k}") for k, (_, v, _) in BENCHMARKS.items()),
        F.min(F.when(ok, F.col(speed))).alias("_min"), F.max(F.when(ok, F.col(speed))).alias("_max"), ordered_values(speed, ["trial_number", "capture_id"], ok).alias("_values"),
    )
    n = "throughput_eligible_n"
    return g.select(
        *keys, "n_total", "n_analyzed", F.col(n).alias("n_valid"), *(f"{k}_eligible_n" for k in BENCHMARKS), sample_label(n).alias("comparison_status"),
        *(F.when(F.col(f"{k}_eligible_n") < 3, "insufficient_under_3").otherwise("eligible").alias(f"{k}_status") for k in BENCHMARKS), *(gated(f"_{k}", f"{k}_eligible_n").alias(out) for k, (_, _, out) in BENCHMARKS.items()),
        gated("_min", n).alias("min_effective_file_throughput_mbps"), gated("_max", n).alias("max_effective_file_throughput_mbps"), gated("_values", n).alias("eligible_trial_effective_throughput_values_mbps"),
    )


def paired_comparison(t: Tables, application=None, scenario=None, experiment=None, session=None, network_profile=None, start_date=None, end_date=None) -> DataFrame:
    """Q32: both captures of a pair, side by side, if all their conditions agree; filters hold for whole pairs."""
    same = ["experiment_id", "session_id", "scenario", "trial_number", "file_cohort_id", "test_file_size_bytes", "device_model", "android_version", "network_type", "network_profile", "comparison_cohort_id", "capture_tool", "capture_tool_version", "experiment_phase"]
    shown = [c for c in same if c not in ("trial_number", "experiment_phase")]
    d = trials(t).where("pair_id is not null").withColumns({"throughput_ok": E.eligible_throughput(), "amplification_ok": E.eligible_amplification()})
    d = number_sides(d, "pair_id", ["application_package", "capture_id"])
    sides = []
    for name, k in (("a", 1), ("b", 2)):
        at = F.col("side") == k
        sides += [side("application_package", at).alias(f"application_{name}")]
        for metric, value, short in (("throughput", "effective_file_throughput_mbps", "effective_mbps"), ("amplification", "total_transfer_amplification_ratio", "amplification")):
            sides += [F.bool_or(F.when(at, F.col(f"{metric}_ok"))).alias(f"application_{name}_{metric}_eligible"), side(value, at & F.col(f"{metric}_ok")).alias(f"application_{name}_{short}")]
    g = d.groupBy("pair_id").agg(
        *(F.min(c).alias(c) for c in shown), F.max("capture_started_at_utc").alias("pair_observed_at_utc"), F.count(F.lit(1)).alias("pair_members"), *sides, *(F.bool_and(f"{m}_ok").alias(f"{m}_both_eligible") for m in ("throughput", "amplification")),
        (uniform(*same) & (F.count_distinct("application_package") == 2)).alias("_same"),
    ).withColumn("pair_conditions_valid", (F.col("pair_members") == 2) & F.col("_same")).drop("_same")
    both = {m: F.col("pair_conditions_valid") & F.col(f"{m}_both_eligible") for m in ("throughput", "amplification")}
    no = {m: ~F.col(f"{m}_both_eligible") for m in both}
    status = ladder((~F.col("pair_conditions_valid"), "invalid_pair_identity_or_conditions"), (no["throughput"] & no["amplification"], "both_metrics_ineligible"), (no["throughput"], "throughput_pair_ineligible"), (no["amplification"], "amplification_pair_ineligible"), otherwise="descriptive_paired_observation")
    g = g.withColumns({
        "b_minus_a_effective_mbps": F.when(both["throughput"], F.col("application_b_effective_mbps") - F.col("application_a_effective_mbps")),
        "b_minus_a_amplification": F.when(both["amplification"], F.col("application_b_amplification") - F.col("application_a_amplification")), "pair_status": status,
    })
    g = E.either_side(g, "application_a", "application_b", application)
    for column, value in (("scenario", scenario), ("experiment_id", experiment), ("session_id", session), ("network_profile", network_profile)):
        g = E.opt(g, column, value)
    return E.between_days(g, utc_day("pair_observed_at_utc"), start_date, end_date)


def source_coverage(t: Tables, packages, application=None, country=None, language=None) -> DataFrame:
    """Q33: each source is summed up by itself; the gap is between the newest and the oldest of them."""
    s = latest_per(snapshots(t, own_task=False), LOCALE, ["collected_at", "snapshot_id"]).select("application_id", "crawl_country_code", "crawl_language_code", "collected_at", "score")
    seen = t["review_observations"].select("review_id", "observed_at")
    r = t["reviews"].select(F.col("id").alias("review_id"), "application_id").join(seen, "review_id", "left").groupBy("application_id").agg(F.count_distinct("review_id").alias("unique_sampled_reviews"), F.max("observed_at").alias("latest_review_observed_at_utc"))
    n = trials(t, own_application=False).groupBy("application_package").agg(F.count_distinct("capture_id").alias("manifest_capture_count"), F.count_distinct("analyzed_capture").alias("analyzed_capture_count"), distinct_where("analyzed_capture", F.col("comparison_ready")).alias("comparison_ready_capture_count"), F.max("capture_finished_at_utc").alias("latest_network_capture_at_utc"))
    a = E.opt(E.in_cohort(applications(t), packages), "package_name", application).select("application_id", "application_name", "package_name")
    d = a.join(s, "application_id", "left").join(r, "application_id", "left").join(n.withColumnRenamed("application_package", "package_name"), "package_name", "left")
    d = E.opt(E.opt(d, "crawl_country_code", country), "crawl_language_code", language)
    ends = ("collected_at", "latest_review_observed_at_utc", "latest_network_capture_at_utc")
    gap = (F.unix_micros(newest(*ends)) - F.unix_micros(oldest(*ends))) / 3.6e9
    return d.select(
        "application_name", "package_name", F.col("crawl_country_code").alias("store_country_code"), F.col("crawl_language_code").alias("store_language_code"), F.col("score").alias("latest_store_score_0_to_5"), F.col("collected_at").alias("latest_store_observed_at_utc"),
        "unique_sampled_reviews", "latest_review_observed_at_utc", "manifest_capture_count", "analyzed_capture_count", "comparison_ready_capture_count", "latest_network_capture_at_utc", gap.alias("cross_source_observation_gap_hours"),
    )


def _network_daily(t: Tables) -> DataFrame:
    ok = F.col("comparison_ready") & F.col("effective_file_throughput_mbps").isNotNull()
    return trials(t, own_application=False).groupBy(F.col("application_package").alias("n_package"), "scenario", "network_profile", E.started_day().alias("n_day")).agg(
        F.count_distinct("capture_id").alias("network_capture_count"), F.max("capture_finished_at_utc").alias("network_source_at_utc"),
        median_where("effective_file_throughput_mbps", ok).alias("median_per_capture_effective_file_throughput_mbps"), distinct_where("analyzed_capture", ok).alias("throughput_eligible_n"),
    )


def store_network_daily(t: Tables, packages, application=None, scenario=None, network_profile=None, country=None, language=None, start_date=None, end_date=None) -> DataFrame:
    """Q34: store days and network days side by side, whichever is missing."""
    named = applications(t).select("application_id", "package_name")
    s = daily_last(snapshots(t, own_task=False)).join(named, "application_id").select("package_name", F.col("crawl_country_code").alias("store_country_code"), F.col("crawl_language_code").alias("store_language_code"), "snapshot_day_utc", F.col("collected_at").alias("store_source_at_utc"), F.col("score").alias("store_score_0_to_5"))
    n = _network_daily(t)
    d = s.join(n, (F.col("n_package") == F.col("package_name")) & (F.col("n_day") == F.col("snapshot_day_utc")), "full_outer")
    status = ladder((F.col("snapshot_day_utc") == F.col("n_day"), "same_utc_day_only_not_causal"), (F.col("snapshot_day_utc").isNull(), "store_missing_for_network_day"), otherwise="network_missing_for_store_day")
    d = d.withColumns({"alignment_status": status, "package_name": F.coalesce("package_name", "n_package"), "observed_day_utc": F.coalesce("snapshot_day_utc", "n_day")}).drop("n_package", "n_day", "snapshot_day_utc")
    d = E.in_cohort(d, packages)
    for column, value in (("package_name", application), ("scenario", scenario), ("network_profile", network_profile), ("store_country_code", country), ("store_language_code", language)):
        d = E.opt(d, column, value)
    return E.between_days(d, "observed_day_utc", start_date, end_date)


def user_voice_network(t: Tables, packages, application=None, scenario=None, network_profile=None, start_date=None, end_date=None) -> DataFrame:
    """Q35: first-sight cohorts as of their day's end beside the network days."""
    named = applications(t).select("application_id", "package_name")
    n, low = F.count(F.lit(1)), count_where(F.col("score") <= 2)
    r = as_of_day_end(t).join(named, "application_id").groupBy("package_name", "cohort_day_utc").agg(F.max("as_of_cutoff_exclusive_utc").alias("as_of_cutoff_exclusive_utc"), n.alias("unique_sampled_reviews"), F.avg("score").alias("mean_sampled_review_stars_1_to_5"), share(low, n).alias("low_star_share"))
    w = _network_daily(t).drop("network_source_at_utc", "throughput_eligible_n").withColumnRenamed("network_capture_count", "manifest_capture_count")
    d = r.join(w, (F.col("n_package") == F.col("package_name")) & (F.col("n_day") == F.col("cohort_day_utc")), "full_outer")
    d = d.withColumns({"package_name": F.coalesce("package_name", "n_package"), "utc_day": F.coalesce("cohort_day_utc", "n_day")}).drop("n_package", "n_day", "cohort_day_utc")
    d = E.opt(E.opt(E.opt(E.in_cohort(d, packages), "package_name", application), "scenario", scenario), "network_profile", network_profile)
    return E.between_days(d, "utc_day", start_date, end_date)


def pair_comparison_matrix(t: Tables, pairs: dict[str, tuple[str, str]], application=None, comparison_pair=None, country=None, language=None) -> DataFrame:
    """Q36: the sources of both sides of named pairs; the store pick takes any task type."""
    which = ladder(*((F.col("package_name").isin(*apps), name) for name, apps in pairs.items()))
    a = E.in_cohort(applications(t), [p for apps in pairs.values() for p in apps]).withColumn("comparison_pair", which).select("application_id", "application_name", "package_name", "comparison_pair")
    s = latest_per(snapshots(t, own_task=False, task_type=None), LOCALE, ["collected_at", "snapshot_id"]).select("application_id", F.col("crawl_country_code").alias("store_country_code"), F.col("crawl_language_code").alias("store_language_code"), F.col("score").alias("latest_store_score_0_to_5"), F.col("collected_at").alias("store_source_at_utc"))
    r = last_scores(t).groupBy("application_id").agg(F.count(F.lit(1)).alias("unique_sampled_reviews"), F.avg("score").alias("mean_observed_review_stars"))
    keys = [F.col("application_package").alias("package_name"), "experiment_id", "session_id", "scenario", *CONDITION]
    ok = F.col("ok")
    packages = [p for apps in pairs.values() for p in apps]
    n = trials(t, own_application=False).where(F.col("application_package").isin(packages)).withColumn("ok", E.eligible_throughput())
    n = once(n, ["application_package", "experiment_id", "session_id", "scenario", *CONDITION], "capture_id", {"_every": F.lit(True), "_ready": ok})
    n = n.groupBy(*keys).agg(F.count_if("_every").alias("manifest_capture_count"), F.count_if("_ready").alias("comparison_ready_n"), median_where("effective_file_throughput_mbps", ok).alias("_median"), F.max("capture_finished_at_utc").alias("network_source_at_utc"))
    d = a.join(s, "application_id", "left").join(r, "application_id", "left").join(n, "package_name", "left").drop("application_id")
    d = E.opt(E.opt(E.opt(E.opt(d, "package_name", application), "comparison_pair", comparison_pair), "store_country_code", country), "store_language_code", language)
    label = sample_label(F.coalesce("comparison_ready_n", F.lit(0)), "network_comparison_insufficient", "network_descriptive_only_3_to_5", "network_descriptive_sample_over_5")
    return d.withColumns({"median_per_capture_effective_file_throughput_mbps": gated("_median", "comparison_ready_n"), "network_interpretation": label}).drop("_median")
