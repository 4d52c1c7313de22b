"""Questions on what was seen before and after a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.exprs import join_reasons, known_true, ladder, share, utc_day
from quartzite.functions.stats import distinct_where, median_where, once, reasons, side
from quartzite.operators import filters as E
from quartzite.operators.temporal import daily_last, endpoints, label_period, latest_per, periods
from quartzite.plans.experiments import trials
from quartzite.plans.reviews import LABELS
from quartzite.plans.store import Tables, applications, snapshots

RELEASE = ["release_event_id", "application_package", "release_date"]
WINDOWS = ["baseline_start", "baseline_end", "followup_start", "followup_end"]
NETWORK_CONDITION = ["scenario", "file_cohort_id", "test_file_size_bytes", "device_model", "android_version", "network_type", "network_profile", "capture_tool", "capture_tool_version"]


def _chosen(df: DataFrame, application=None, release_event=None, start_date=None, end_date=None) -> DataFrame:
    df = E.opt(E.opt(df, "application_package", application), "release_event_id", release_event)
    return E.between_days(df, "release_date", start_date, end_date)


def with_capability(df: DataFrame, capabilities: DataFrame, how: str = "inner") -> DataFrame:
    """df beside the one row of capabilities; with how='left' that row stays even if df is empty."""
    one = F.broadcast(capabilities)
    return capabilities.join(df, F.lit(True), "left") if how == "left" else df.crossJoin(one)


def release_readiness(t: Tables, **f) -> DataFrame:
    """Q37."""
    missing = F.lit(False)
    for c in WINDOWS:
        missing = missing | F.col(c).isNull()
    status = ladder((F.col("release_event_id").isNull(), "release_manifest_missing"), (~F.col("release_date_verified"), "release_date_unverified"), (F.col("release_date_precision") != "day", "release_date_not_day_precision"), (missing, "before_after_windows_missing"), otherwise="release_metadata_ready_observational_only")
    return _chosen(with_capability(t["release_manifest"], t["capabilities"], "left"), **f).withColumn("release_readiness", status)


def _at(period: str) -> Column:
    return F.col("period") == period


def period_captures(t: Tables) -> DataFrame:
    """Captures of a release's experiments within its windows, with what they count for; one row for each release, condition and capture."""
    r = E.verified_day(t["release_manifest"]).select(*RELEASE, "previous_version", "new_version", *WINDOWS, "experiment_id_before", "experiment_id_after")
    d = trials(t).withColumn("_day", E.started_day()).join(F.broadcast(r), "application_package")
    was, now = F.col("experiment_id") == F.col("experiment_id_before"), F.col("experiment_id") == F.col("experiment_id_after")
    period = F.when(was & F.col("_day").between(F.col("baseline_start"), F.col("baseline_end")), "before").when(now & F.col("_day").between(F.col("followup_start"), F.col("followup_end")), "after")
    version = F.when(was, F.col("app_version") == F.col("previous_version")).when(now, F.col("app_version") == F.col("new_version")).otherwise(False)
    common = ladder(
        (F.col("source_capture_id").isNull(), "capture_missing"), (F.col("capture_status") != "analyzed", "capture_not_analyzed"), (~F.col("analysis_available"), "analysis_missing"),
        ((F.col("capture_scenario") != F.col("scenario")) | (F.col("analysis_scenario") != F.col("scenario")) | (F.col("analysis_package") != F.col("application_package")), "source_attribution_mismatch"),
        (~F.col("transfer_completed"), "transfer_incomplete"), (~F.col("capture_isolation_confirmed") | ~F.col("cache_cleared_or_download_verified"), "provenance_incomplete"),
        (F.col("captured_size_bytes") != F.col("test_file_size_bytes"), "transfer_size_mismatch"), (~F.col("version_matches_period"), "application_version_mismatch"),
    )
    d = d.withColumns({"period": period, "version_matches_period": version}).where("period is not null").withColumn("_common", common)
    sources = {"throughput": (E.eligible_throughput(), "throughput_prerequisite_missing"), "amplification": (E.eligible_amplification(), "amplification_prerequisite_missing"), "recovery": (E.eligible_recovery(True), "tcp_recovery_metric_unavailable")}
    return d.withColumns(
        {f"{k}_eligible": known_true(F.col("version_matches_period") & ok) for k, (ok, _) in sources.items()} | {f"{k}_exclusion_reason": F.coalesce("_common", F.when(~known_true(ok), F.lit(why))) for k, (ok, why) in sources.items()}
    ).withColumn("analyzed_capture_id", F.when(F.col("capture_status") == "analyzed", F.col("analyzed_capture")))


METRICS = {"throughput": ("effective_file_throughput_mbps", "effective_mbps"), "amplification": ("total_transfer_amplification_ratio", "amplification"), "recovery": ("tcp_recovery_tax", "tcp_recovery_tax")}


def release_network_before_after(t: Tables, scenario=None, network_profile=None, **f) -> DataFrame:
    """Q38: three medians on each side of a release, shown where both sides have three captures."""
    keys = [*RELEASE, *NETWORK_CONDITION]
    both = [(p, m) for m in METRICS for p in ("before", "after")]
    # a capture's source and analysis bear its own id, so that all counts are of captures
    counts = {f"{p}_{n}_n": _at(p) & F.col(c).isNotNull() for c, n in (("capture_id", "manifest"), ("source_capture_id", "observed"), ("analyzed_capture_id", "analyzed")) for p in ("before", "after")}
    counts |= {f"{p}_{m}_eligible_n": _at(p) & F.col(f"{m}_eligible") for p, m in both}
    d = once(period_captures(t), keys, "capture_id", {f"_{k}": flag for k, flag in counts.items()})
    g = d.groupBy(*keys).agg(
        *(F.count_if(f"_{k}").alias(k) for k in counts), *(reasons(f"{m}_exclusion_reason", _at(p) & ~F.col(f"{m}_eligible")).alias(f"{p}_{m}_exclusion_reasons") for p, m in both),
        *(median_where(METRICS[m][0], _at(p) & F.col(f"{m}_eligible")).alias(f"{p}_{m}_raw") for p, m in both),
    )
    ready = {m: (F.col(f"before_{m}_eligible_n") >= 3) & (F.col(f"after_{m}_eligible_n") >= 3) for m in METRICS}
    more = {f"{p}_{m}_excluded_n": F.col(f"{p}_manifest_n") - F.col(f"{p}_{m}_eligible_n") for p, m in both}
    for m, (_, short) in METRICS.items():
        more |= {f"{p}_median_{short}": F.when(ready[m], F.col(f"{p}_{m}_raw")) for p in ("before", "after")}
        more[f"{short}_after_minus_before"] = F.when(ready[m], F.col(f"after_{m}_raw") - F.col(f"before_{m}_raw"))
    every, some = ready["throughput"] & ready["amplification"] & ready["recovery"], ready["throughput"] | ready["amplification"] | ready["recovery"]
    more["comparison_status"] = ladder((every, "all_metrics_descriptive_before_after_not_causal"), (some, "partial_metric_readiness"), otherwise="insufficient_under_3_each_period")
    return _chosen(E.opt(E.opt(g.withColumns(more), "scenario", scenario), "network_profile", network_profile), **f)


def release_store_before_after(t: Tables, country=None, language=None, **f) -> DataFrame:
    """Q39: median daily score and the end of each side, within one locale."""
    named = applications(t).select("application_id", F.col("package_name").alias("application_package"))
    d = daily_last(snapshots(t, own_task=False)).join(named, "application_id").withColumnsRenamed({"snapshot_day_utc": "day_utc", "crawl_country_code": "country_code", "crawl_language_code": "language_code"})
    r = E.verified_day(t["release_manifest"]).select(*RELEASE, *WINDOWS)
    p = d.join(F.broadcast(r), "application_package").withColumn("period", label_period("day_utc")).where("period is not null")
    p = endpoints(p, ["release_event_id", "country_code", "language_code", "period"], ["day_utc", "collected_at"])
    sides = ("before", "after")
    last = F.col("endpoint_rank") == 1
    g = p.groupBy(*RELEASE, "country_code", "language_code").agg(
        *(distinct_where("day_utc", _at(s)).alias(f"{s}_observed_days") for s in sides), *(median_where("score", _at(s)).alias(f"{s}_median_daily_store_score") for s in sides),
        *(side(f"{x}_count", _at(s) & last).alias(f"{s}_endpoint_{x}_count") for x in ("ratings", "reviews") for s in sides), *(side("collected_at", _at(s)).alias(f"{s}_latest_source_at_utc") for s in sides),
    )
    none = (F.col("before_observed_days") == 0) | (F.col("after_observed_days") == 0)
    g = g.withColumns({
        "store_score_after_minus_before": F.col("after_median_daily_store_score") - F.col("before_median_daily_store_score"),
        **{f"observed_{x}_count_endpoint_difference": F.col(f"after_endpoint_{x}_count") - F.col(f"before_endpoint_{x}_count") for x in ("ratings", "reviews")},
        "comparison_status": F.when(none, "missing_period").otherwise("observational_store_before_after_historical_locale"),
    })
    return _chosen(E.opt(E.opt(g, "country_code", country), "language_code", language), **f)


def review_states(t: Tables, releases: DataFrame, succeeded_only: bool) -> DataFrame:
    """For each release and period, its first-sight cohort with each review as of the period's end."""
    named = t["applications"].select(F.col("id").alias("application_id"), F.col("package_name").alias("application_package"))
    r = t["reviews"].select(F.col("id").alias("review_id"), "application_id", "first_observed_at")
    c = t["crawl_tasks"].select(F.col("id").alias("crawl_task_id"), F.col("application_id").alias("_app"), "task_type", "status", "country_code", "language_code")
    p = F.broadcast(periods(releases))
    d = r.join(named, "application_id").join(p, "application_package").where(utc_day("first_observed_at").between(F.col("period_start"), F.col("period_end")))
    seen = t["review_observations"].drop("thumbs_up_count", "source_adapter").join(c, "crawl_task_id")
    d = d.join(seen, "review_id").where("observed_at < as_of_cutoff_exclusive_utc")
    if succeeded_only:
        d = d.where("_app = application_id and task_type = 'reviews' and status = 'succeeded'")
    return latest_per(d, ["release_event_id", "period", "review_id"], ["observed_at", "crawl_task_id"])


def release_user_voice(t: Tables, sentiment: bool = True, country=None, language=None, **f) -> DataFrame:
    """Q40: each period's cohort as of its end; a task's status is not looked at. Without sentiment its columns are NULL."""
    d = review_states(t, E.verified_day(t["release_manifest"]).select(*RELEASE, *WINDOWS), False)
    if not sentiment:
        d = d.withColumns({"sentiment_status": F.lit(None).cast("string"), "sentiment_label": F.lit(None).cast("string")})
    ok = F.coalesce((F.col("sentiment_status") == "done") & F.col("sentiment_label").isin(*LABELS), F.lit(False))
    bad = F.coalesce((F.col("sentiment_status") == "done") & (F.col("sentiment_label") == "negative"), F.lit(False))
    shown = (lambda c: c) if sentiment else (lambda c: F.when(F.lit(False), c))
    aggs = []
    for s in ("before", "after"):
        n = F.count_if(_at(s))  # a review is one row of its release and period
        aggs += [
            F.max(F.when(_at(s), F.col("period_end"))).alias(f"{s}_period_end"), side("as_of_cutoff_exclusive_utc", _at(s)).alias(f"{s}_as_of_cutoff_exclusive_utc"), n.alias(f"{s}_unique_sampled_reviews"), F.avg(F.when(_at(s), F.col("score"))).alias(f"{s}_mean_sampled_review_stars"),
            share(F.count_if(_at(s) & (F.col("score") <= 2)), n).alias(f"{s}_low_star_share"), side("observed_at", _at(s)).alias(f"{s}_latest_observation_at_utc"),
            shown(F.count_if(_at(s) & ok)).alias(f"{s}_classified_sentiment_reviews"), shown(F.count_if(_at(s) & ~ok)).alias(f"{s}_historical_sentiment_unavailable_reviews"),
            shown(share(F.count_if(_at(s) & bad), F.count_if(_at(s) & ok))).alias(f"{s}_negative_sentiment_share"),
        ]
    g = d.groupBy(*RELEASE, "country_code", "language_code").agg(*aggs)
    g = g.withColumns({f"{out}_after_minus_before": F.col(f"after_{x}") - F.col(f"before_{x}") for out, x in (("sampled_stars", "mean_sampled_review_stars"), ("low_star_share", "low_star_share"), ("negative_sentiment_share", "negative_sentiment_share"))})
    return _chosen(E.opt(E.opt(g, "country_code", country), "language_code", language), **f)


def release_evidence(t: Tables, network: bool = True, **f) -> DataFrame:
    """Q41: for each release, locale and condition, what each source has; without network its columns are typed NULLs."""
    r = t["release_manifest"]
    named = t["applications"].select(F.col("id").alias("application_id"), F.col("package_name").alias("application_package"))
    windows = F.broadcast(r.select("release_event_id", "application_package", *WINDOWS))
    s = snapshots(t).join(named, "application_id").withColumn("day", utc_day("collected_at")).join(windows, "application_package").withColumn("period", label_period("day"))
    inside = lambda a, b: F.col("day").between(F.col(a), F.col(b))
    before, after = inside("baseline_start", "baseline_end"), inside("followup_start", "followup_end")
    # days first, so that no more than a row for each is dealt
    s = s.where(before | after).groupBy("release_event_id", F.col("crawl_country_code").alias("store_country_code"), F.col("crawl_language_code").alias("store_language_code"), "day").agg(F.bool_or(before).alias("_before"), F.bool_or(after).alias("_after"), F.max("collected_at").alias("_at"))
    s = s.groupBy("release_event_id", "store_country_code", "store_language_code").agg(F.count_if("_before").alias("store_before_days"), F.count_if("_after").alias("store_after_days"), F.max("_at").alias("store_latest_source_at"))
    v = review_states(t, r.select("release_event_id", "application_package", *WINDOWS), True).groupBy("release_event_id", F.col("country_code").alias("store_country_code"), F.col("language_code").alias("store_language_code")).agg(
        F.count_if(_at("before")).alias("review_before_n"), F.count_if(_at("after")).alias("review_after_n"), F.max("observed_at").alias("review_latest_source_at"), F.lit(True).alias("_reviews"),
    )
    counts = [f"network_{p}_{n}_n" for n in ("manifest", "observed", "analyzed") for p in ("before", "after")] + [f"{p}_{m}_eligible_n" for m in METRICS for p in ("before", "after")]
    d = r.join(s.withColumn("_store", F.lit(True)), "release_event_id", "left").join(v, ["release_event_id", "store_country_code", "store_language_code"], "left")
    if network:
        keys = ["release_event_id", *NETWORK_CONDITION]
        flags = {f"network_{p}_{k}_n": _at(p) & F.col(c).isNotNull() for c, k in (("capture_id", "manifest"), ("source_capture_id", "observed"), ("analyzed_capture_id", "analyzed")) for p in ("before", "after")}
        flags |= {f"{p}_{m}_eligible_n": _at(p) & F.col(f"{m}_eligible") for m in METRICS for p in ("before", "after")}
        n = once(period_captures(t), keys, "capture_id", {f"_{k}": flag for k, flag in flags.items()})
        n = n.groupBy(*keys).agg(*(F.count_if(f"_{k}").alias(k) for k in flags), F.max("capture_finished_at_utc").alias("network_latest_source_at"), F.lit(True).alias("_network"))
        d = d.join(n, "release_event_id", "left")
    else:
        d = d.withColumns({c: F.lit(None).cast("string") for c in NETWORK_CONDITION} | {c: F.lit(None).cast("bigint") for c in counts} | {"network_latest_source_at": F.lit(None).cast("timestamp"), "_network": F.lit(None).cast("boolean")})
    d = d.crossJoin(F.broadcast(t["capabilities"].select("network_state")))
    no_store, no_reviews = F.col("_store").isNull() | (F.col("store_before_days") == 0) | (F.col("store_after_days") == 0), F.col("_reviews").isNull() | (F.col("review_before_n") == 0) | (F.col("review_after_n") == 0)
    few = F.lit(False)
    for c in counts[6:]:
        few = few | (F.col(c) < 3)
    gaps = F.lit(False)
    for c in WINDOWS:
        gaps = gaps | F.col(c).isNull()
    status = ladder(
        (~F.col("release_date_verified") | (F.col("release_date_precision") != "day"), "release_metadata_insufficient"), (gaps, "release_windows_missing"), (no_store, "store_same_locale_period_missing"), (no_reviews, "same_locale_review_cohort_missing"),
        (~F.col("network_state").isin("NETWORK_DATA_AVAILABLE", "NETWORK_COMPARISON_INSUFFICIENT", "NETWORK_COMPARISON_READY"), "base_store_review_ready_network_unavailable"), (F.col("_network").isNull(), "no_period_eligible_network_conditions"),
        (few, "network_metric_period_insufficient"), otherwise="multi_source_descriptive_evidence_available",
    )
    d = _chosen(d, **f)
    return d.select(
        *RELEASE, "previous_version", "new_version", "release_date_precision", "release_date_verified", "store_country_code", "store_language_code", *NETWORK_CONDITION, "store_before_days", "store_after_days", "review_before_n", "review_after_n", *counts,
        "store_latest_source_at", "review_latest_source_at", "network_latest_source_at", "network_state",
        ladder((F.col("_store").isNull(), "store_locale_unavailable"), (no_store, "store_same_locale_period_missing"), otherwise="store_same_locale_ready").alias("store_locale_status"),
        F.when(no_reviews, "same_locale_review_cohort_missing").otherwise("same_locale_review_cohort_ready").alias("store_review_locale_status"), status.alias("evidence_matrix_status"),
    )


def release_exclusions(t: Tables, **f) -> DataFrame:
    """Q42: all reasons why a release can't be compared, in one text."""
    d = _chosen(with_capability(t["release_manifest"], t["capabilities"]), **f)
    null = lambda a, b: F.col(a).isNull() | F.col(b).isNull()
    text = join_reasons(
        (~F.col("release_date_verified"), "unverified_release_date"), (F.col("release_date_precision") != "day", "release_date_not_exact_day"), (null("baseline_start", "baseline_end"), "baseline_window_missing"), (null("followup_start", "followup_end"), "followup_window_missing"),
        (null("experiment_id_before", "experiment_id_after"), "network_experiment_ids_missing"), (F.col("sentiment_state") != "SENTIMENT_DATA_AVAILABLE", "sentiment_unavailable"), (F.col("topic_state") != "TOPIC_ANNOTATIONS_AVAILABLE", "network_complaint_topics_unavailable"),
    )
    return d.select(*RELEASE, "release_date_precision", "release_date_verified", "network_state", "experiment_state", "sentiment_state", "topic_state", text.alias("exclusions"))
