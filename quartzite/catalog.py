"""Every query of the package, bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.bindings import AS_OF, Bound
from quartzite.operators import enrich, packets, quality
from quartzite.operators.filters import eligible_throughput
from quartzite.plans import dashboards, experiments, releases, reviews, store
from quartzite.session import shared_folder
from quartzite.streaming import ingest

PACKAGES = [f"com.app.n{k}" for k in range(4)]
PAIRS = {"first": ("com.app.n0", "com.app.n1"), "second": ("com.app.n2", "com.app.n3")}


def as_of():
    return F.lit(AS_OF).cast("timestamp")


QUESTIONS: dict[str, Callable[[Bound], DataFrame]] = {
    "q01_portfolio_current": lambda t: store.portfolio_current(t, as_of()),
    "q02_store_rating_daily": lambda t: store.store_rating_daily(t, date(2024, 1, 5), date(2024, 1, 20)),
    "q03_rating_vs_category": lambda t: store.rating_vs_category(t, as_of()),
    "q04_counts_growth": lambda t: store.counts_growth(t, start_date=date(2024, 1, 10)),
    "q05_install_milestones": store.install_milestones,
    "q06_executive_summary": lambda t: store.executive_summary(t, as_of()),
    "q07_category_summary": store.category_summary,
    "q08_rating_changes": store.rating_changes,
    "q09_investigation": store.investigation,
    "q10_star_distribution": lambda t: reviews.star_distribution(t, start_date=date(2024, 1, 3), end_date=date(2024, 1, 20)),
    "q11_review_cohort_kpis": lambda t: reviews.review_cohort_kpis(t, as_of()),
    "q12_review_revisions": lambda t: reviews.review_revisions(t, country="ir"),
    "q13_sentiment_coverage": reviews.sentiment_coverage,
    "q14_sentiment_distribution": reviews.sentiment_distribution,
    "q15_sentiment_trend": reviews.sentiment_trend,
    "q16_sentiment_language": reviews.sentiment_language,
    "q17_stars_vs_sentiment": reviews.stars_vs_sentiment,
    "q18_direct_pair": lambda t: store.direct_pair(t, "com.app.n1", "com.app.n2"),
    "q19_ratings_count_changes": store.ratings_count_changes,
    "q20_reviews_count_changes": store.reviews_count_changes,
    "q21_current_install_threshold": store.current_install_threshold,
    "q22_latest_rating": store.latest_rating,
    "q23_first_observed_daily": reviews.first_observed_daily,
    "q24_sampling_coverage": reviews.sampling_coverage,
    "q25_network_readiness": experiments.network_readiness,
    "q26_experiment_coverage": experiments.experiment_coverage,
    "q27_trial_transfer": experiments.trial_transfer,
    "q28_network_efficiency": experiments.network_efficiency,
    "q29_tcp_stability": experiments.tcp_stability,
    "q30_protocol_capability": experiments.protocol_capability,
    "q31_benchmark_summary": experiments.benchmark_summary,
    "q32_paired_comparison": experiments.paired_comparison,
    "q33_source_coverage": lambda t: experiments.source_coverage(t, PACKAGES),
    "q34_store_network_daily": lambda t: experiments.store_network_daily(t, PACKAGES),
    "q35_user_voice_network": lambda t: experiments.user_voice_network(t, PACKAGES),
    "q36_pair_comparison_matrix": lambda t: experiments.pair_comparison_matrix(t, PAIRS),
    "q37_release_readiness": releases.release_readiness,
    "q38_release_network_before_after": releases.release_network_before_after,
    "q39_release_store_before_after": releases.release_store_before_after,
    "q40_release_user_voice": releases.release_user_voice,
    "q41_release_evidence": releases.release_evidence,
    "q42_release_exclusions": releases.release_exclusions,
}


D = dashboards
PANELS: dict[str, Callable[[Bound], DataFrame]] = {
    "dsh_counts": D.panel_counts, "dsh_runs_and_tasks": lambda t: D.panel_runs_and_tasks(t, *map(instant, ("2024-01-05", "2024-01-20"))), "dsh_task_status": D.panel_task_status, "dsh_sentiment_backlog": D.panel_sentiment_backlog,
    "dsh_latest_runs": D.panel_latest_runs, "dsh_daily_reviews": D.panel_daily_reviews, "dsh_daily_observations": D.panel_daily_observations, "dsh_hourly_duration": D.panel_hourly_duration, "dsh_attempts": D.panel_attempts,
    "dsh_failure_codes": D.panel_failure_codes, "dsh_latest_failed": D.panel_latest_failed, "dsh_hourly_status": D.panel_hourly_status, "dsh_application_status": D.panel_application_status, "dsh_locales": D.panel_locales,
    "dsh_reviews_in_range": lambda t: D.panel_reviews_in_range(t, *map(instant, ("2024-01-05", "2024-01-20"))), "dsh_ratings": D.panel_ratings, "dsh_reviews_by_application": D.panel_reviews_by_application, "dsh_latest_observations": D.panel_latest_observations,
    "dsh_cumulative_reviews": D.panel_cumulative_reviews, "dsh_indicators": D.indicators, "dsh_sentiment": D.panel_sentiment, "dsh_active_applications": D.panel_active_applications, "dsh_captures": D.panel_captures, "dsh_latest_captures": D.panel_latest_captures,
    "dsh_table_counts": D.panel_table_counts, "dsh_run_rows": D.panel_run_rows, "dsh_active_runs": D.panel_active_runs, "agg_finalize_runs": lambda t: D.finalize_runs(t["crawl_tasks"]),
}


def instant(text: str):
    return F.lit(text).cast("timestamp")


def logs(t: Bound) -> DataFrame:
    """Events as log records: the type is the event, the user the service, k the level."""
    level = F.when(F.col("k") % 5 == 0, "error").when(F.col("k") % 5 == 1, "warning").otherwise("info")
    return t["ev"].select(F.col("ts").alias("timestamp"), level.alias("level"), F.concat(F.lit("svc"), F.col("user_id") % 7).alias("service"), F.col("event_type").alias("event"), F.when(F.col("k") % 3 == 0, F.col("value")).alias("duration_seconds"))


def batches(t: Bound) -> DataFrame:
    """Events as review records in batches of a user's day."""
    return enrich.normalize_reviews(t["ev"].select(
        F.concat_ws("/", "user_id", F.to_date("ts")).alias("batch_id"), F.col("event_id").alias("position"), F.col("event_id").cast("string").alias("external_review_id"), F.when(F.col("k") % 50 != 7, 1 + F.col("k") % 5).alias("score"),
        F.col("k").alias("thumbs_up_count"), F.col("event_type").alias("content"), F.when(F.col("k") % 40 != 3, F.col("ts")).alias("source_at"),
    ))


def messages(t: Bound) -> DataFrame:
    """Events as ingestion messages, some of them broken in each of the ways there are."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    stats = F.col("event_type").isin("click", "view", "error")
    app, uuid = F.col("user_id").cast("string"), F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.when(F.col("k") == 5, F.col("event_id") - F.col("event_id") % 2).otherwise(F.col("event_id")).cast("string"), 12, "0"))
    one = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("crawl_task_id"), app.alias("application_id"), F.lit("com.app.x").alias("package_name"), iso.alias("collected_at"), (F.col("k") * 1000).alias("min_installs"), (F.col("k") % 50 / 10 + F.when(F.col("k") == 6, 9).otherwise(0)).alias("score"), F.col("k").alias("ratings_count"), F.col("k").alias("reviews_count"), F.to_date("ts").cast("string").alias("store_updated_on"), F.lit("1").alias("version"), F.lit(True).alias("ad_supported"), F.lit("a").alias("source_adapter")))
    two = F.to_json(F.struct(F.concat(F.lit("t"), "event_id").alias("crawl_task_id"), app.alias("application_id"), F.lit("com.app.x").alias("package_name"), iso.alias("observed_at"), (1 + F.col("k")).alias("position"), F.concat(F.lit("r"), F.col("k") % 10).alias("external_review_id"), iso.alias("source_at"), F.lit("n").alias("author_name"), F.col("k").alias("thumbs_up_count"), (1 + F.col("event_id") % 5).alias("score"), F.concat(F.lit("c"), "event_id").alias("content"), F.lit("a").alias("source_adapter")))
    body = F.concat(F.lit('{"event_id":"'), uuid, F.lit('","event_type":"'), F.when(F.col("k") == 7, "other").when(stats, "app_stats_collected").otherwise("review_observed"), F.lit('","schema_version":'), F.when(F.col("k") == 8, "2").otherwise("1"), F.when(F.col("k") == 9, ',"extra":1').otherwise(""), F.lit(',"occurred_at":"'), iso, F.lit('","payload":'), F.when(stats, one).otherwise(two), F.lit("}"))
    value = F.when(F.col("k") == 10, F.lit(None)).when(F.col("k") == 11, F.lit("{broken")).otherwise(body)
    key = F.when(F.col("k") == 12, F.lit(None).cast("binary")).when(F.col("k") == 13, F.lit(b"\xff\xfe")).when(F.col("k") == 14, F.lit("x").cast("binary")).otherwise(app.cast("binary"))
    topic = F.when(F.col("k") == 15, "captures").when(stats, "app-stats").otherwise("reviews")
    return t["ev"].select(key.alias("key"), value.cast("binary").alias("value"), topic.alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"))


def ingested(t: Bound) -> tuple[DataFrame, DataFrame]:
    """Good events that are claimed, and the invalid ones."""
    good, bad = ingest.split_invalid(ingest.classify(messages(t)))
    empty = good.limit(0).select("event_id", "event_type", "topic", "partition", "offset")
    return ingest.claim(good, empty), bad


def lww(t: Bound) -> DataFrame:
    """The state of reviews after two batches that overlap in time: even offsets, then odd ones."""
    path = shared_folder(t.spark, "observed")  # as run_ingest does, so that each batch doesn't parse all of them
    ingest.decoded(ingested(t)[0], "review_observed").select("application_id", "external_review_id", "observed_at", "score", "content", "partition", "offset").write.parquet(path)
    seen = t.spark.read.parquet(path)
    none = seen.limit(0).select("application_id", "external_review_id", "score", "content", F.col("observed_at").alias("first_observed_at"), F.col("observed_at").alias("last_observed_at"))
    first = ingest.upsert_reviews(seen.where("offset % 2 = 0"), none)
    return ingest.upsert_reviews(seen.where("offset % 2 = 1"), first)


def ledger(t: Bound) -> DataFrame:
    return ingested(t)[0].groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def tcp_columns(t: Bound) -> DataFrame:
    return packets.capture_metrics(t["packets"], t["packet_captures"])


TRIAL_CONDITION = ["experiment_id", "session_id", "application_package", "scenario", *experiments.CONDITION]
OTHERS: dict[str, Callable[[Bound], DataFrame]] = {
    "log_volume": lambda t: D.log_volume(logs(t)), "log_levels": lambda t: D.log_levels(logs(t), "30 minutes"), "log_recent": lambda t: D.recent_logs(logs(t), "svc[12]", "error", 100), "log_labels": lambda t: D.log_labels(logs(t)), "log_event_durations": lambda t: D.event_durations(logs(t)),
    "net_capture_metrics": tcp_columns,
    "enr_batch_diagnostics": lambda t: enrich.batch_diagnostics(batches(t)), "enr_gate_batches": lambda t: enrich.gate_batches(batches(t), 20).select("batch_id", "position", "score"), "enr_record_issues": lambda t: enrich.record_issues(batches(t)),
    "str_classify": lambda t: ingest.classify(messages(t)).select("offset", "reason"), "str_claim": lambda t: ingested(t)[0].select("event_id", "offset"), "str_quarantine": lambda t: ingested(t)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n")), "str_upsert_reviews": lww, "str_ledger": ledger,
    "str_dedupe_captures": lambda t: ingest.dedupe_captures(t["network_captures"]).select("id", "copies", "conflict"), "str_cleanable": lambda t: ingest.cleanable(t["network_captures"]),
    "dq_experiment": lambda t: quality.violations(t["experiment_manifest"], "capture_id", [("order", F.col("capture_finished_at_utc") <= F.col("capture_started_at_utc"), "x"), *(("provenance", ~F.col(c), f"{c} must be true") for c in ("transfer_completed", "capture_isolation_confirmed", "cache_cleared_or_download_verified"))]),
    "dq_unique_trials": lambda t: quality.check_unique(t["experiment_manifest"], ["experiment_id", "session_id", "application_package", "scenario", "app_version", "trial_number"], "capture_id"),
    "dq_against_captures": lambda t: quality.check_against_captures(t["experiment_manifest"], t["network_captures"], t["applications"]), "dq_categories": lambda t: quality.check_categories(t["application_categories"]), "dq_overlaps": lambda t: quality.check_overlaps(t["release_manifest"].unionByName(t["release_manifest"].withColumns({"release_event_id": F.concat("release_event_id", F.lit("b")), "baseline_start": F.date_add("baseline_start", 20)}).where("release_event_id < 'rel2'"))),
    "dq_capabilities": lambda t: quality.capabilities(t["network_captures"], experiments.trials(t), t["release_manifest"], t["review_observations"], TRIAL_CONDITION, eligible_throughput()),
    "dq_backfill_locale": lambda t: quality.backfill_locale(t["crawl_tasks"].withColumns({c: F.when(F.col("attempt_count") > 1, F.col(c)) for c in ("language_code", "country_code")}), t["applications"], "xx", "yy").groupBy("language_code", "country_code").agg(F.count(F.lit(1)).alias("n")),
    "dq_constraints": lambda t: quality.check_constraints(t["playstore_app_snapshots"], "id", {"score": (0, 4.5)}, {"version": ["v0", "v1"]}, ["ratings_count"]),
}


def bound(make: Callable[[Bound], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: make(Bound(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quartzite.catalog_rules import RULES
    from quartzite.catalog_streams import STREAMS

    return {name: bound(make) for name, make in (QUESTIONS | PANELS | OTHERS | RULES | STREAMS).items()}


def oracle_sql() -> dict[str, str]:
    from quartzite.oracles import question_sql
    from quartzite.oracles_more import more_sql
    from quartzite.oracles_rules import rules_sql
    from quartzite.oracles_streams import stream_sql

    return question_sql() | more_sql() | rules_sql() | stream_sql()
