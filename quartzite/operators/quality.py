"""Rules on manifests and tables: every check gives (record, rule, message), one row for each violation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import fingerprint, opaque_id, valid_package, valid_sha256
from quartzite.functions.stats import uniform
from quartzite.operators.temporal import overlaps
from quartzite.streaming.ingest import ANALYSIS

#: What identifies records, what the captures of a pair must have alike, and what tells trials apart.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PAIR_SAME = ["experiment_id", "session_id", "scenario", "trial_number", "test_file_sha256", "test_file_size_bytes", "device_model", "android_version", "network_type", "network_profile", "capture_tool", "capture_tool_version", "experiment_phase"]
TRIAL = ["experiment_id", "session_id", "application_package", "scenario", "app_version", "device_model", "android_version", "network_type", "network_profile", "test_file_sha256", "trial_number"]


def violations(df: DataFrame, record: str, rules: Sequence[tuple[str, Column, str]]) -> DataFrame:
    """A row for each rule that a row breaks; a condition that is NULL isn't a violation. One scan for all rules."""
    if not rules:
        return df.limit(0).select(F.col(record).cast("string").alias("record"), *(F.lit("").alias(c) for c in ("rule", "message")))
    found = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(message).alias("message"))) for rule, bad, message in rules)))
    return df.select(F.col(record).cast("string").alias("record"), F.inline(found))


def _missing(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def _template(df: DataFrame) -> list[tuple[str, Column, str]]:
    """No text may hold what the queries' templates are controlled by."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return [("template", F.col(c).rlike(r"\{\{|\}\}|\[\[|\]\]|\x00"), f"{c} holds a template control") for c in texts]


def check_experiment(df: DataFrame) -> DataFrame:
    """DQ-01 to DQ-03: fields, types, order and provenance of an experiment manifest."""
    rules = [("required", _missing(c), f"{c} is missing") for c in ("capture_id", "experiment_id", "session_id", "trial_number", "application_package", "scenario", "capture_started_at_utc", "capture_finished_at_utc", "test_file_sha256", "test_file_size_bytes", "device_model", "network_profile")]
    rules += [("uuid", ~F.col(c).rlike(UUID), f"{c} is no UUID") for c in ("capture_id", "experiment_id", "session_id", "pair_id")]
    rules += [("positive", F.col(c) <= 0, f"{c} must be positive") for c in ("trial_number", "test_file_size_bytes")]
    rules += [("package", ~valid_package("application_package"), "application_package is no package name"), ("hash", ~valid_sha256("test_file_sha256"), "test_file_sha256 is no SHA-256"), ("enum", ~F.col("scenario").isin("upload", "download"), "scenario is unknown")]
    rules += [("order", F.col("capture_finished_at_utc") <= F.col("capture_started_at_utc"), "capture must finish after its start")]
    rules += [("provenance", ~F.coalesce(F.col(c), F.lit(False)), f"{c} must be true") for c in ("transfer_completed", "capture_isolation_confirmed", "cache_cleared_or_download_verified")]
    return violations(df, "capture_id", rules + _template(df))


def check_catalogues(df: DataFrame, catalogues: dict[str, DataFrame], record: str = "capture_id") -> DataFrame:
    """DQ-04: values that aren't in the one-column catalogue of their column."""
    out = None
    for column, allowed in catalogues.items():
        d = df.where(F.col(column).isNotNull()).join(F.broadcast(allowed.toDF(column)), column, "left_anti").select(F.col(record).cast("string").alias("record"), F.lit("catalogue").alias("rule"), F.concat(F.lit(f"{column} isn't allowed: "), F.col(column).cast("string")).alias("message"))
        out = d if out is None else out.unionByName(d)
    return out


def check_unique(df: DataFrame, keys: Sequence[str], record: str, rule: str = "unique") -> DataFrame:
    """DQ-05, DQ-12: every row of a key that occurs more than once."""
    d = df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1")
    return d.select(F.col(record).cast("string").alias("record"), F.lit(rule).alias("rule"), F.lit(f"{', '.join(keys)} must be unique").alias("message"))


def check_pairs(df: DataFrame, cohorts: DataFrame | None = None) -> DataFrame:
    """DQ-06: a pair has two captures of different applications under the same conditions, of an allowed cohort (a, b)."""
    apps = F.array_sort(F.collect_set("application_package"))
    g = df.where("pair_id is not null").groupBy("pair_id").agg(F.count(F.lit(1)).alias("n"), apps.alias("apps"), uniform(*PAIR_SAME).alias("same"))
    rules = [("pair_size", F.col("n") != 2, "a pair has exactly two captures"), ("pair_applications", F.size("apps") != 2, "a pair has two applications"), ("pair_conditions", ~F.col("same"), "conditions of a pair differ")]
    if cohorts is not None:
        g = g.join(F.broadcast(cohorts.select(F.array_sort(F.array("a", "b")).alias("apps"), F.lit(True).alias("allowed"))), "apps", "left")
        rules.append(("pair_cohort", F.col("allowed").isNull(), "the applications are no allowed cohort"))
    return violations(g, "pair_id", rules)


def with_cohorts(df: DataFrame) -> DataFrame:
    """Opaque ids: of the file, and of the applications of a capture's pair. Captures without a pair are dealt one by one, as they aren't a group."""
    w = Window.partitionBy("pair_id", F.when(F.col("pair_id").isNull(), F.col("capture_id")))
    apps = F.when(F.col("pair_id").isNotNull(), F.array_join(F.array_sort(F.collect_set("application_package").over(w)), "\x1f"))
    d = df.withColumn("_apps", apps)
    return d.withColumns({"file_cohort_id": opaque_id("file", "test_file_sha256", "test_file_size_bytes"), "comparison_cohort_id": F.when(F.col("_apps").isNotNull(), opaque_id("cohort", "_apps"))}).drop("_apps")


def check_against_captures(df: DataFrame, captures: DataFrame, applications: DataFrame) -> DataFrame:
    """DQ-07: what the manifest says against the capture's row."""
    a = applications.select(F.col("id").alias("_app"), F.col("package_name").alias("_package"))
    c = captures.select(F.col("id").alias("capture_id"), F.col("application_id").alias("_app"), F.col("scenario").alias("_scenario"), F.col("status").alias("_status"), F.col("transfer_file_size_bytes").alias("_size")).join(a, "_app", "left")
    d = df.select("capture_id", "application_package", "scenario", "test_file_size_bytes").join(c, "capture_id", "left")
    return violations(d, "capture_id", [
        ("capture_exists", F.col("_status").isNull(), "no such capture"), ("capture_application", F.col("_package") != F.col("application_package"), "the capture is of another application"), ("capture_scenario", F.col("_scenario") != F.col("scenario"), "the capture has another scenario"),
        ("capture_size", F.col("_size") != F.col("test_file_size_bytes"), "the capture has another file size"), ("capture_analyzed", F.col("_status") != "analyzed", "the capture isn't analysed"),
    ])


def default_windows(df: DataFrame, days: int = 14) -> DataFrame:
    """DQ-09: windows of `days` days on both sides of a verified, exact release day, where none are given."""
    exact = F.col("release_date_verified") & (F.col("release_date_precision") == "day")
    at = F.col("release_date")
    made = {"baseline_start": F.date_sub(at, days), "baseline_end": F.date_sub(at, 1), "followup_start": F.date_add(at, 1), "followup_end": F.date_add(at, days)}
    return df.withColumns({c: F.coalesce(c, F.when(exact, v)) for c, v in made.items()})


def check_releases(df: DataFrame) -> DataFrame:
    """DQ-08: fields, precision, versions, and windows in order around the release."""
    at = F.col("release_date")
    rules = [("required", _missing(c), f"{c} is missing") for c in ("release_event_id", "application_package", "new_version", "release_date_precision")]
    rules += [
        ("enum", ~F.col("release_date_precision").isin("day", "month", "unknown"), "precision is unknown"), ("package", ~valid_package("application_package"), "application_package is no package name"), ("versions", F.col("previous_version") == F.col("new_version"), "versions must differ"),
        ("order", F.col("baseline_start") > F.col("baseline_end"), "baseline ends before it starts"), ("order", F.col("followup_start") > F.col("followup_end"), "follow-up ends before it starts"),
        ("around", F.col("baseline_end") >= at, "baseline must end before the release"), ("around", F.col("followup_start") <= at, "follow-up must start after the release"),
    ]
    return violations(df, "release_event_id", rules + _template(df)).unionByName(check_unique(df, ["release_event_id"], "release_event_id"))


def check_overlaps(df: DataFrame) -> DataFrame:
    """DQ-10: analysis windows of one application that overlap another release's."""
    d = overlaps(df.withColumns({"_from": F.col("baseline_start"), "_to": F.col("followup_end")}), "application_package", "release_event_id", "_from", "_to")
    return d.select(F.col("release_event_id").cast("string").alias("record"), F.lit("overlap").alias("rule"), F.lit("analysis windows overlap").alias("message"))


def check_constraints(df: DataFrame, record: str, ranges: dict[str, tuple[float | None, float | None]] | None = None, enums: dict[str, Sequence[str]] | None = None, non_negative: Sequence[str] = (), shares: Sequence[str] = ()) -> DataFrame:
    """DQ-11: generated rules for ranges, enums, counts and ratios; NULL passes."""
    rules = []
    for c, (low, high) in ((ranges or {}) | {c: (0, None) for c in non_negative} | {c: (0, 1) for c in shares}).items():
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(c) < low)
        if high is not None:
            bad = bad | (F.col(c) > high)
        rules.append(("range", bad, f"{c} is out of range"))
    rules += [("enum", ~F.col(c).isin(*values), f"{c} is unknown") for c, values in (enums or {}).items()]
    return violations(df, record, rules)


#: What must hold in each table: its record's column, unique keys, ranges, enums, counts that aren't negative, pairs of columns in order, and pairs that are null together.
TABLE_RULES: dict[str, dict] = {
    "applications": {"record": "id", "unique": [["package_name"]], "together": [("language_code", "country_code")], "unless": [("is_active", "deactivated_at")]},
    "categories": {"record": "id", "unique": [["code"]]},
    "ingested_events": {"record": "event_id", "unique": [["event_id"], ["topic", "partition", "offset"]], "ranges": {"schema_version": (1, None)}, "counts": ["partition", "offset"]},
    "playstore_app_snapshots": {"record": "id", "unique": [["crawl_task_id"]], "ranges": {"score": (0, 5)}, "counts": ["min_installs", "ratings_count", "reviews_count"]},
    "reviews": {"record": "id", "unique": [["application_id", "external_review_id"]], "ranges": {"score": (1, 5)}, "counts": ["thumbs_up_count"], "ordered": [("first_observed_at", "last_observed_at")]},
    "review_observations": {
        "record": "crawl_task_id", "unique": [["crawl_task_id", "review_id"]], "ranges": {"position": (1, 1000), "score": (1, 5)}, "counts": ["thumbs_up_count"],
        "enums": {"sentiment_status": ("pending", "done", "skipped", "failed"), "sentiment_label": ("positive", "neutral", "negative")},
    },
    "network_captures": {
        "record": "id", "unique": [["ready_event_id"], ["analysis_id"], ["analysis_event_id"]], "ranges": {"capture_size_bytes": (1, None), "transfer_file_size_bytes": (1, None)}, "counts": ["analysis_attempt_count"],
        "enums": {"scenario": ("upload", "download"), "capture_format": ("pcap", "pcapng"), "status": ("pending_upload", "uploaded", "analyzing", "analyzed", "failed", "expired")},
    },
}


def check_table(df: DataFrame, table: str) -> DataFrame:
    """DQ-11, DQ-12 on one of TABLE_RULES: every row that breaks what must hold there. Rules on columns that df lacks don't count; a NULL key is no key."""
    r, has = TABLE_RULES[table], lambda *names: all(c in df.columns for c in names)
    record = r["record"]
    found = check_constraints(df, record, {c: v for c, v in r.get("ranges", {}).items() if has(c)}, {c: v for c, v in r.get("enums", {}).items() if has(c)}, [c for c in r.get("counts", ()) if has(c)])
    rules = [("order", F.col(a) > F.col(b), f"{a} is after {b}") for a, b in r.get("ordered", ()) if has(a, b)]
    rules += [("pair", F.col(a).isNull() != F.col(b).isNull(), f"{a} and {b} go together") for a, b in r.get("together", ()) if has(a, b)]
    rules += [("state", F.col(a) == F.col(b).isNotNull(), f"{b} is set when {a} isn't") for a, b in r.get("unless", ()) if has(a, b)]
    found = found.unionByName(violations(df, record, rules))
    for keys in r.get("unique", ()):
        if has(*keys):
            found = found.unionByName(check_unique(df.dropna(subset=keys), keys, record))
    return found


def check_analysis_results(df: DataFrame, record: str = "capture_id") -> DataFrame:
    """DQ-11 on analysis results: of the columns of an analysis that df has, counts, durations and rates aren't negative, shares lie within 0 and 1, sizes are above zero."""
    kinds = {name: kind.rstrip("?") for group in ANALYSIS.values() for kind, names in group.items() for name in names.split() if name in df.columns}
    of = lambda *want: [c for c, kind in kinds.items() if kind in want]
    found = check_constraints(df, record, enums={c: ("pcap", "pcapng") for c in of("format")} | ({"scenario": ("upload", "download")} if "scenario" in df.columns else {}), non_negative=of("int", "float"), shares=of("ratio"))
    return found.unionByName(violations(df, record, [("range", F.col(c) <= 0, f"{c} is out of range") for c in of("positive")]))


def check_categories(assigned: DataFrame) -> DataFrame:
    """DQ-13: an application has categories, each once, and one of them is primary."""
    g = assigned.groupBy("application_id").agg(F.count("category_id").alias("n"), F.count_distinct("category_id").alias("d"), F.count_if("is_primary").alias("p"))
    return violations(g, "application_id", [("category_missing", F.col("n") == 0, "no category"), ("category_repeated", F.col("n") != F.col("d"), "a category occurs twice"), ("primary", F.col("p") != 1, "exactly one category is primary")])


def capabilities(captures: DataFrame | None, trials: DataFrame | None, releases: DataFrame | None, observations: DataFrame | None, condition: Sequence[str] = (), eligible: Column | None = None) -> DataFrame:
    """DQ-14: one row of five states, from which tables and columns there are and what rows they hold.

    A missing table is None. trials needs the columns of `condition` and those of `eligible`.
    """
    any_ = captures if captures is not None else trials if trials is not None else releases if releases is not None else observations
    spark = any_.sparkSession
    one = spark.range(1).drop("id")
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias(name)) if d is not None else one.withColumn(name, F.lit(0).cast("bigint"))
    done = observations.where("sentiment_status = 'done'") if observations is not None and "sentiment_status" in observations.columns else None
    row = count(captures, "c").crossJoin(count(trials, "e")).crossJoin(count(releases, "r")).crossJoin(count(done, "s"))
    best = trials.groupBy(*condition).agg(F.count_if(eligible).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("best")) if trials is not None and condition else one.withColumn("best", F.lit(0).cast("bigint"))
    row = row.crossJoin(best)
    network = F.lit("NETWORK_SCHEMA_MISSING") if captures is None else F.when(F.col("c") == 0, "NETWORK_EMPTY").when(F.col("best") >= 3, "NETWORK_COMPARISON_READY").when(F.col("e") > 0, "NETWORK_COMPARISON_INSUFFICIENT").otherwise("NETWORK_DATA_AVAILABLE")
    return row.select(
        network.alias("network_state"), F.when(F.col("e") > 0, "VERIFIED_EXPERIMENT_AVAILABLE").otherwise("MANIFEST_NOT_SUPPLIED").alias("experiment_state"), F.when(F.col("r") > 0, "RELEASE_METADATA_AVAILABLE").otherwise("MANIFEST_NOT_SUPPLIED").alias("release_state"),
        (F.lit("SENTIMENT_SCHEMA_MISSING") if done is None else F.when(F.col("s") > 0, "SENTIMENT_DATA_AVAILABLE").otherwise("SENTIMENT_EMPTY")).alias("sentiment_state"), F.lit("ANNOTATIONS_UNAVAILABLE").alias("topic_state"),
    )


def enabled(capability: str, row: dict[str, str]) -> bool:
    """DQ-15: may a question of this capability run?"""
    return {
        "base": True, "network": row["network_state"] not in ("NETWORK_SCHEMA_MISSING", "NETWORK_GRANTS_MISSING"), "experiment": row["experiment_state"] == "VERIFIED_EXPERIMENT_AVAILABLE",
        "release": row["release_state"] == "RELEASE_METADATA_AVAILABLE", "sentiment": row["sentiment_state"] == "SENTIMENT_DATA_AVAILABLE",
    }[capability]


def optional_columns(df: DataFrame, present: bool, columns: dict[str, str]) -> DataFrame:
    """DQ-16: df as it is, or with the columns as typed NULLs."""
    return df if present else df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items()})


def manifest_fingerprint(df: DataFrame, key: str) -> DataFrame:
    """DQ-17: SHA-256 of all rows' digests in key order; rows are digested where they are."""
    rows = df.select(F.struct(F.col(key).cast("string").alias("k"), fingerprint(*df.columns).alias("d")).alias("x"))
    return rows.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["d"]), "\n"), 256).alias("fingerprint"))


def backfill_locale(tasks: DataFrame, applications: DataFrame, language: str, country: str) -> DataFrame:
    """DQ-19: a task without a locale takes its application's, else the default."""
    a = applications.select(F.col("id").alias("application_id"), F.col("language_code").alias("_l"), F.col("country_code").alias("_c"))
    d = tasks.join(a, "application_id", "left")
    return d.withColumns({"language_code": F.coalesce("language_code", "_l", F.lit(language)), "country_code": F.coalesce("country_code", "_c", F.lit(country))}).drop("_l", "_c")


def seed_absent(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """JOI-15: target and those rows whose key it doesn't have."""
    return target.unionByName(rows.join(target, key, "left_anti").select(*target.columns))
