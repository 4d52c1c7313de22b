"""Queries on rules, expressions, sources, sinks, enrichment and ingestion, bound to the test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.bindings import Bound
from quartzite.functions import exprs as X
from quartzite.operators import enrich, filters, quality, temporal
from quartzite.plans import dashboards, experiments
from quartzite.sources import readers, sinks
from quartzite.streaming import ingest

NOW = "2024-01-16 00:00:00"
DEVICES, PROFILES = ["device_0", "device_1"], ["profile_0", "profile_1", "profile_2"]
COHORTS = [("com.app.n0", "com.app.n1"), ("com.app.n3", "com.app.n2")]
GROUPS = {"negative": [0, 1], "neutral": [2], "positive": [3, 4]}


def now():
    return F.lit(NOW).cast("timestamp")


def expressions(t: Bound) -> DataFrame:
    p = F.array(*((F.col("k") % n).cast("double") for n in (10, 7, 3, 5, 4)))
    return t["texts"].select(
        "event_id", X.effective_locale("language", "en").alias("locale"), X.parse_store_date("updated").alias("updated_on"), X.valid_package("package").alias("package_ok"), X.valid_sha256("digest").alias("digest_ok"), X.first_int("whole").alias("whole"), X.first_float("part").alias("part"),
        X.flag("part").alias("is_set"), X.opaque_id("file", "package", "k").alias("opaque"), X.fingerprint("package", "k").alias("request"), X.compound_label("compound").alias("mood"), X.collapse_labels(p, GROUPS).alias("collapsed"), X.clip("note", 7).alias("note"),
    )


def detector(texts: list[str]) -> list[tuple[str, float]]:
    known = {"hello": ("en", 0.9), "salam": ("fa", 0.95), "guten": ("de", 0.99)}
    return [known.get(x.split(" ")[0], ("en", 0.5)) for x in texts]


def english(texts: list[str]) -> list[str]:
    """Fails on a batch that holds what it can't score."""
    if any(x == "guten tag" for x in texts):
        raise ValueError("unscorable")
    return ["positive" if x.startswith("hello") else "neutral" for x in texts]


def persian(texts: list[str]) -> list[str]:
    return ["negative"] * len(texts)


def languages(t: Bound) -> DataFrame:
    return enrich.detect_language(t["texts"].select("event_id", "said"), detector, text="said").select("event_id", "language_status", "sentiment_language")


def sentiments(t: Bound) -> DataFrame:
    language = F.when(F.col("k") % 5 == 0, None).when(F.col("k") % 2 == 0, "en").otherwise("fa")
    df = t["texts"].select("event_id", "said", language.alias("sentiment_language"))
    return enrich.score_sentiment(df, {"en": english, "fa": persian}, text="said").select("event_id", "sentiment_label", "sentiment_error")


def waiting(t: Bound) -> DataFrame:
    return t["outcomes"].where("sentiment_status = 'pending'")


def scored(t: Bound) -> DataFrame:
    """Outcomes of even reviews' texts."""
    return enrich.identities(t["outcomes"]).where("review_id % 2 = 0").select("*", F.lit("done").alias("new_status"), F.lit("neutral").alias("new_label"), F.lit("en").alias("new_language"))


def run_counters(t: Bound) -> DataFrame:
    """A run: earlier outcomes are taken over, even reviews are scored, the others fail once more."""
    pending = enrich.reuse(waiting(t), t["outcomes"])
    rest = pending.where("reused_status is null")
    after = enrich.record_failures(enrich.apply_results(rest.drop("reused_status", "reused_label", "reused_language"), scored(t)), rest.where("review_id % 2 = 1"))
    taken = pending.where("reused_status is not null").withColumn("sentiment_status", F.col("reused_status"))
    return enrich.run_stats(pending, after.select("sentiment_status").unionByName(taken.select("sentiment_status")), F.lit(1.5))


def applied(t: Bound) -> DataFrame:
    d = enrich.apply_results(t["outcomes"], scored(t))
    return d.select("crawl_task_id", "review_id", "sentiment_status", "sentiment_label", "sentiment_language")


def failed(t: Bound) -> DataFrame:
    d = enrich.record_failures(t["outcomes"], t["outcomes"].where("review_id % 3 = 0"))
    return d.select("crawl_task_id", "review_id", "sentiment_status", "sentiment_attempt_count")


def requested(t: Bound) -> DataFrame:
    from quartzite.catalog import batches

    asked = t["ev"].groupBy(F.concat_ws("/", "user_id", F.to_date("ts")).alias("batch_id")).agg((F.count(F.lit(1)) + 2).alias("requested"))
    return enrich.batch_diagnostics(batches(t).where("position % 3 <> 0"), asked)


def catalogues(t: Bound) -> DataFrame:
    make = lambda values: t.spark.createDataFrame([(v,) for v in values], "v string")
    return quality.check_catalogues(t["faulty_manifest"], {"device_model": make(DEVICES), "network_profile": make(PROFILES)})


def pairs(t: Bound) -> DataFrame:
    return quality.check_pairs(t["faulty_manifest"], t.spark.createDataFrame(COHORTS, "a string, b string"))


def default_windows(t: Bound) -> DataFrame:
    return quality.default_windows(t["faulty_releases"]).select("release_event_id", "application_package", "baseline_start", "baseline_end", "followup_start", "followup_end")


def gates(t: Bound) -> DataFrame:
    """Which questions may run, by the one row of states."""
    row = t["capabilities"].first().asDict()
    return t.spark.createDataFrame([(c, quality.enabled(c, row)) for c in ("base", "network", "experiment", "release", "sentiment")], "capability string, enabled boolean")


def without_sentiment(t: Bound) -> DataFrame:
    columns = {"sentiment_status": "string", "sentiment_label": "string", "sentiment_language": "string"}
    return quality.optional_columns(t["review_observations"].drop(*columns), False, columns).select("crawl_task_id", "review_id", *columns)


def fingerprinted(t: Bound) -> DataFrame:
    return quality.manifest_fingerprint(t["release_manifest"].select("release_event_id", "previous_version", "new_version"), "release_event_id")


def nested(t: Bound) -> DataFrame:
    """Analyses as nested events, without a tcp group where there was no TCP."""
    tcp = F.when(F.col("tcp_present"), F.struct("tcp_connection_count", "tcp_recovery_tax"))
    return t["network_analysis_results"].select("capture_id", F.struct("capture_duration_ms", "truncated_packet_count").alias("capture"), tcp.alias("tcp"))


def inserted(t: Bound) -> DataFrame:
    apps = t["applications"].select("id", "name")
    return sinks.insert_absent(apps.unionByName(apps), t["applications"].where("is_active"), ["id"])


def messages_out(t: Bound) -> DataFrame:
    out = sinks.event_messages(t["crawl_tasks"].select("id", "application_id", "attempt_count"))
    return out.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def consistent(t: Bound) -> DataFrame:
    known = t["applications"].select(F.col("id").alias("application_id"))
    tasks = t["crawl_tasks"].join(known, "application_id", "left_semi")
    return ingest.require_consistent(tasks, known, ["application_id"]).groupBy("application_id").agg(F.count(F.lit(1)).alias("tasks"))


def ready(t: Bound) -> DataFrame:
    events = t["lifecycle"].select(F.col("id").alias("capture_id"), "application_id", "scenario", "capture_sha256", F.when(F.col("capture_size_bytes") % 10 == 0, 1).otherwise(F.col("capture_size_bytes")).alias("capture_size_bytes"), "transfer_file_size_bytes")
    return ingest.match_ready(events, t["lifecycle"]).select("capture_id", "status")


def reconciled(t: Bound) -> DataFrame:
    return ingest.reconcile(t["lifecycle"], t["objects"], now(), 86_400).select("id", "new_status", "change_reason", "emit")


def appended(t: Bound) -> DataFrame:
    seen = t["ev"].select(F.concat(F.lit("t"), F.floor(F.col("event_id") / 4)).alias("crawl_task_id"), F.concat(F.lit("r"), F.col("k") % 2).alias("external_review_id"), F.col("event_id").alias("offset"), "user_id")
    there = seen.where("user_id % 5 = 0").select("crawl_task_id", "external_review_id").distinct()
    return ingest.append_observations(seen, there).select("crawl_task_id", "external_review_id", "offset")


def responses(t: Bound) -> DataFrame:
    """Raw responses of up to five items behind their guard line, some of them broken."""
    items = F.transform(F.slice(F.array(*(F.lit(f"i{n}") for n in range(5))), 1, (F.col("k") % 5 + 1).cast("int")), lambda x: F.concat(x, F.lit("-"), F.col("event_id")))
    body = F.concat(F.lit(")]}'\n\n"), F.to_json(F.array(F.array(F.lit("w"), F.lit("x"), F.to_json(F.array(items))))))
    raw = t["ev"].select("event_id", F.when(F.col("k") % 11 == 0, F.lit(")]}'\nbroken")).otherwise(body).alias("body"))
    return readers.explode_review_responses(raw).select("event_id", "position", "item")


def capture_files(t: Bound) -> DataFrame:
    """Files with the magic numbers of their formats, or other bytes, against rows of which some have no file."""
    head = F.when(F.col("k") % 4 == 0, F.unhex(F.lit("D4C3B2A1"))).when(F.col("k") % 4 == 1, F.unhex(F.lit("0A0D0D0A"))).when(F.col("k") % 4 == 2, F.unhex(F.lit("A1B23C4D"))).otherwise(F.unhex(F.lit("00000000")))
    content = F.concat(head, F.col("event_id").cast("string").cast("binary"))
    files = t["ev"].where("k % 10 <> 9").select(F.concat(F.lit("s3://b/d/c"), "event_id", F.lit(".pcap")).alias("path"), content.alias("content"), F.octet_length(content).cast("bigint").alias("length"))
    rows = t["ev"].select(F.concat(F.lit("c"), "event_id").alias("capture_id"), F.when(F.col("k") % 8 == 1, "pcap").when(F.col("k") % 4 == 1, "pcapng").otherwise("pcap").alias("capture_format"), F.when(F.col("k") % 7 == 0, F.lit("x")).otherwise(F.sha2(content, 256)).alias("capture_sha256"))
    return readers.verify_captures(files, rows).select("capture_id", "problem")


def read_tasks(t: Bound) -> DataFrame:
    return readers.allowlisted(t["reviews"], "reviews")


def analyses(t: Bound) -> DataFrame:
    """Violations of analysis results that were spoiled a little."""
    d = t["network_analysis_results"].withColumns({"tcp_byte_share": F.col("tcp_byte_share") * 1.2, "tcp_connection_count": F.col("tcp_connection_count") - 1, "capture_size_bytes": F.col("network_bytes_total") - 1, "network_bytes_total": F.col("network_bytes_total") - 2, "tcp_reset_rate": -F.col("tcp_reset_rate")})
    return quality.check_analysis_results(d)


def state_of_reviews(t: Bound) -> DataFrame:
    """The reviews' state read from what two batches left: even offsets, then odd ones."""
    from quartzite.catalog import ingested

    seen = ingest.decoded(ingested(t)[0], "review_observed").withColumn("batch", F.col("offset") % 2)
    return ingest.current_reviews(seen).select("application_id", "external_review_id", "score", "content", "first_observed_at", "last_observed_at")


def expanded(t: Bound) -> DataFrame:
    """Log lines as text, some of them no JSON, with the service as a label."""
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.lit("inner").alias("service"), F.col("event_type").alias("event"), F.concat(F.lit("m "), "k").alias("message"), F.when(F.col("k") % 3 == 0, F.col("value")).alias("duration_seconds")))
    raw = t["ev"].select("event_id", F.concat(F.lit("svc"), F.col("user_id") % 7).alias("service"), F.when(F.col("k") % 13 == 0, F.concat(F.lit("plain "), "k")).otherwise(line).alias("line"))
    return dashboards.expand_logs(raw, labels=("service",)).select("event_id", "timestamp", "service", "event", "message", "duration_seconds")


def claimed(t: Bound) -> DataFrame:
    from quartzite.catalog import ingested

    return dashboards.panel_ledger(ingested(t)[0].withColumn("ingested_at", F.timestamp_seconds(F.col("offset") + 1_700_000_000)))


def as_of_release(t: Bound) -> DataFrame:
    """The last score of each application before its release day began."""
    apps = t["applications"].select(F.col("id").alias("application_id"), F.col("package_name").alias("application_package"))
    cut = t["release_manifest"].join(apps, "application_package").select("release_event_id", "application_id", F.col("release_date").cast("timestamp").alias("cutoff"))
    seen = t["playstore_app_snapshots"].select("application_id", F.col("id").alias("snapshot_id"), "collected_at", "score")
    return temporal.as_of_latest(seen, cut, ["application_id"], ["release_event_id"], "collected_at", "snapshot_id", "cutoff").select("release_event_id", "snapshot_id", "score")


def kinds(t: Bound) -> DataFrame:
    d = t["ev"].groupBy("user_id").agg(X.sorted_set("event_type", ("error", "view")).alias("kinds"))
    return d.select("user_id", F.array_join("kinds", ",").alias("kinds"))


def table_rules(t: Bound) -> DataFrame:
    """Rules of five tables, of rows some of which break each of them."""
    k = F.col("ratings_count")
    snapshots = t["playstore_app_snapshots"].withColumns({"score": k.cast("double") / 15, "crawl_task_id": F.concat(F.lit("t"), F.floor(F.col("id") / 50)), "min_installs": k - 3})
    observations = t["review_observations"].withColumns({"position": F.col("position") * 11, "sentiment_status": F.when(F.col("thumbs_up_count") % 50 == 7, "lost").otherwise(F.col("sentiment_status"))})
    reviews = t["reviews"].withColumn("last_observed_at", F.when(F.col("versions") % 3 == 1, F.col("last_observed_at") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("last_observed_at")))
    n = F.col("id").cast("bigint")
    applications = t["applications"].withColumns({"country_code": F.when(n % 5 != 0, F.col("country_code")), "deactivated_at": F.when(n % 4 == 0, F.col("created_at"))})
    captures = t["network_captures"].withColumns({"analysis_id": F.when(F.col("capture_size_bytes") % 2 == 0, F.col("capture_sha256")), "transfer_file_size_bytes": F.col("transfer_file_size_bytes") - 1048576})
    tables = {"playstore_app_snapshots": snapshots, "review_observations": observations, "reviews": reviews, "applications": applications, "network_captures": captures}
    return reduce(DataFrame.unionByName, [quality.check_table(df, name).withColumn("source", F.lit(name)) for name, df in tables.items()])


def capability_states(t: Bound) -> DataFrame:
    """The five states where tables are whole, thin, empty or without columns; groups of trials are sessions of an application, and a completed transfer counts."""
    m, group, ok = t["experiment_manifest"], ["experiment_id", "session_id", "application_package", "scenario"], F.col("transfer_completed")
    c, r, o = t["network_captures"], t["release_manifest"], t["review_observations"]
    cases = {
        "whole": (c, m, r, o), "thin": (c.where("status = 'failed'"), m.where("trial_number = 7"), r.where("release_date_precision = 'month'"), o.where("sentiment_status = 'failed'")),
        "empty": (c.where("status = 'none'"), m.where("trial_number < 0"), r.where("release_date_precision = 'year'"), o.where("sentiment_status = 'none'")), "no manifest": (c, None, None, o), "no columns": (None, m, r, o.drop("sentiment_status")),
    }
    found = [quality.capabilities(*tables, group if tables[1] is not None else (), ok).withColumn("case", F.lit(name)) for name, tables in cases.items()]
    return reduce(DataFrame.unionByName, found)


def listing_order(t: Bound) -> DataFrame:
    """The order in which captures and applications are listed, as a rank within each application and each language."""
    ranked = lambda df, key: df.withColumn("_at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_at")))
    captures = ranked(filters.list_captures(t["network_captures"], scenario="upload"), "application_id").select(F.lit("capture").alias("kind"), "id", "place")
    return captures.unionByName(ranked(filters.list_applications(t["applications"], True), "language_code").select(F.lit("application").alias("kind"), "id", "place"))


RULES: dict[str, Callable[[Bound], DataFrame]] = {
    "fn_expressions": expressions, "fn_sorted_set": kinds, "prj_allowlisted": read_tasks, "win_as_of_latest": as_of_release,
    "flt_fixtures": lambda t: filters.exclude_fixture(t["applications"], [f"com.app.n{k}" for k in range(1, 4)]).select("id", "package_name"),
    "flt_either_side": lambda t: experiments.paired_comparison(t, application="com.app.n1").select("pair_id", "application_a", "application_b", "pair_status"),
    "flt_applications": lambda t: filters.list_applications(t["applications"], True).select("id", "created_at"), "flt_captures": lambda t: filters.list_captures(t["network_captures"], scenario="upload", status="analyzed").select("id", "scenario", "status"),
    "srt_keyset_page": lambda t: filters.after_key(t["crawl_tasks"].select("started_at", "id"), ["started_at", "id"], [F.lit("2024-01-10 00:00:00").cast("timestamp"), "t5"]).orderBy("started_at", "id").limit(200),
    "snk_messages": messages_out, "snk_insert_absent": inserted, "snk_flatten": lambda t: sinks.flatten_analysis(nested(t)), "src_review_responses": responses, "src_capture_files": capture_files,
    "joi_seed_absent": lambda t: quality.seed_absent(t["categories"].where("id % 2 = 0"), t["categories"], "id"),
    "enr_identities": lambda t: enrich.identities(t["outcomes"]), "enr_reuse": lambda t: enrich.reuse(waiting(t), t["outcomes"]).select("crawl_task_id", "review_id", "reused_status", "reused_label", "reused_language"),
    "enr_apply_results": applied, "enr_record_failures": failed, "enr_run_stats": run_counters, "enr_language": languages, "enr_sentiment": sentiments, "enr_requested": requested,
    "dq_manifest_rules": lambda t: quality.check_experiment(t["faulty_manifest"]), "dq_catalogues": catalogues, "dq_trials": lambda t: quality.check_unique(t["faulty_manifest"], quality.TRIAL, "capture_id"), "dq_pairs": pairs,
    "dq_cohort_ids": lambda t: quality.with_cohorts(t["faulty_manifest"]).select("capture_id", "file_cohort_id", "comparison_cohort_id"), "dq_default_windows": default_windows, "dq_release_rules": lambda t: quality.check_releases(quality.default_windows(t["faulty_releases"])),
    "dq_release_overlaps": lambda t: quality.check_overlaps(quality.default_windows(t["faulty_releases"])), "dq_gates": gates, "dq_optional_columns": without_sentiment, "dq_fingerprint": fingerprinted,
    "str_consistent": consistent, "str_match_ready": ready, "str_claimable": lambda t: ingest.claimable(t["lifecycle"], now(), 86_400).select("id", "status"), "str_retryable": lambda t: ingest.retryable(t["lifecycle"]).select("id"), "str_reconcile": reconciled, "str_append_observations": appended,
    "dsh_ledger": claimed, "dq_analysis_results": analyses, "log_expanded": expanded, "str_current_reviews": state_of_reviews,
    "dq_capability_states": capability_states, "dq_table_rules": table_rules, "srt_listing_order": listing_order,
}
