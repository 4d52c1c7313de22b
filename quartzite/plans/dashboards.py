"""Panels over crawl, review and capture tables, and aggregates of structured logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.functions.exprs import label, seconds_between, utc_day
from quartzite.operators.filters import opt, time_range
from quartzite.operators.temporal import running_total
from quartzite.plans.store import Tables
from quartzite.sources.readers import LOG


def _n():
    return F.count(F.lit(1))


def newest(df: DataFrame, ts: str, n: int, *ties: str) -> DataFrame:
    """The n latest rows, rows without a time last; a top-k, not a full sort."""
    return df.orderBy(F.desc_nulls_last(ts), *ties).limit(n)


def top_groups(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(_n().alias("n")).orderBy(F.desc("n"), key).limit(n)


def tumbling(df: DataFrame, ts: str, size: str, *keys) -> DataFrame:
    """df grouped by buckets of fixed size; the bucket's start is `bucket`. Works on streams with a watermark too."""
    return df.groupBy(F.window(ts, size).alias("w"), *keys)


def _tasks(t: Tables, start=None, end=None, application=None) -> DataFrame:
    return opt(time_range(t["crawl_tasks"], "started_at", start, end), "application_id", application)


def panel_counts(t: Tables, application=None) -> DataFrame:
    """DSH-01: applications, unique reviews and observations."""
    r = opt(t["reviews"], "application_id", application)
    seen = t["review_observations"] if application is None else t["review_observations"].join(r.select(F.col("id").alias("review_id")), "review_id")
    return t["applications"].agg(_n().alias("applications")).crossJoin(r.agg(_n().alias("unique_reviews"))).crossJoin(seen.agg(_n().alias("observations")))


def panel_runs_and_tasks(t: Tables, start=None, end=None, application=None) -> DataFrame:
    """DSH-02: runs, and succeeded and failed tasks of a time range."""
    runs = time_range(t["crawl_runs"], "started_at", start, end).agg(_n().alias("runs"))
    return runs.crossJoin(_tasks(t, start, end, application).agg(*(F.count_if(F.col("status") == s).alias(f"{s}_tasks") for s in ("succeeded", "failed"))))


def panel_task_status(t: Tables, start=None, end=None, application=None) -> DataFrame:
    """DSH-03."""
    return _tasks(t, start, end, application).groupBy("status").agg(_n().alias("tasks"))


def panel_sentiment_backlog(t: Tables) -> DataFrame:
    """DSH-04."""
    return t["review_observations"].agg(F.count_if(F.col("sentiment_status") == "pending").alias("pending"))


def panel_latest_runs(t: Tables, n: int = 50) -> DataFrame:
    """DSH-05: with their duration, NULL while they run."""
    return newest(t["crawl_runs"].select("id", "status", "started_at", "finished_at", seconds_between("started_at", "finished_at").alias("duration_seconds")), "started_at", n, "id")


def panel_daily_reviews(t: Tables, start=None, end=None, application=None) -> DataFrame:
    """DSH-06: new reviews of each day."""
    return time_range(opt(t["reviews"], "application_id", application), "first_observed_at", start, end).groupBy(utc_day("first_observed_at").alias("day")).agg(_n().alias("new_reviews"))


def panel_daily_observations(t: Tables, start=None, end=None) -> DataFrame:
    """DSH-06: observations of each day."""
    return time_range(t["review_observations"], "observed_at", start, end).groupBy(utc_day("observed_at").alias("day")).agg(_n().alias("observations"))


def panel_hourly_duration(t: Tables, start=None, end=None, application=None) -> DataFrame:
    """DSH-07: mean duration of finished tasks by hour and type."""
    done = _tasks(t, start, end, application).where("finished_at is not null")
    return tumbling(done, "started_at", "1 hour", "task_type").agg(F.avg(seconds_between("started_at", "finished_at")).alias("mean_seconds")).select(F.col("w.start").alias("bucket"), "task_type", "mean_seconds")


def panel_attempts(t: Tables, start=None, end=None) -> DataFrame:
    """DSH-08."""
    return _tasks(t, start, end).groupBy("task_type").agg(F.round(F.avg("attempt_count"), 2).alias("mean_attempts"), F.max("attempt_count").alias("most_attempts"))


def panel_failure_codes(t: Tables, start=None, end=None, n: int = 20) -> DataFrame:
    """DSH-09: a missing code is `unspecified`."""
    failed = _tasks(t, start, end).where("status = 'failed'").withColumn("error_code", F.coalesce("error_code", F.lit("unspecified")))
    return top_groups(failed, "error_code", n)


def panel_latest_failed(t: Tables, n: int = 100, application=None, status: str | None = "failed") -> DataFrame:
    """DSH-10: the last failed tasks with their application; tasks that haven't ended come last."""
    named = t["applications"].select(F.col("id").alias("application_id"), F.col("name").alias("application_name"))
    d = opt(_tasks(t, application=application), "status", status).join(named, "application_id")
    return newest(d.select("id", "application_name", "task_type", "status", "error_code", "finished_at"), "finished_at", n, "id")


def panel_hourly_status(t: Tables, start=None, end=None) -> DataFrame:
    """DSH-11."""
    return tumbling(_tasks(t, start, end), "started_at", "1 hour", "status").agg(_n().alias("tasks")).select(F.col("w.start").alias("bucket"), "status", "tasks")


def panel_application_status(t: Tables, start=None, end=None) -> DataFrame:
    """DSH-12: by application and status."""
    named = t["applications"].select(F.col("id").alias("application_id"), F.col("name").alias("application_name"))
    return _tasks(t, start, end).join(named, "application_id").groupBy("application_name", "status").agg(_n().alias("tasks"))


def panel_locales(t: Tables, application=None) -> DataFrame:
    """DSH-12: by crawl language and country."""
    return _tasks(t, application=application).groupBy("language_code", "country_code").agg(_n().alias("tasks"))


def panel_reviews_in_range(t: Tables, start=None, end=None) -> DataFrame:
    """DSH-13."""
    return time_range(t["reviews"], "first_observed_at", start, end).agg(_n().alias("reviews")).crossJoin(time_range(t["review_observations"], "observed_at", start, end).agg(_n().alias("observations")))


def panel_ratings(t: Tables) -> DataFrame:
    """DSH-14: observations by stars."""
    return t["review_observations"].groupBy(label("score", " stars").alias("rating")).agg(_n().alias("observations"))


def panel_reviews_by_application(t: Tables) -> DataFrame:
    """DSH-15: applications without reviews count zero."""
    r = t["reviews"].groupBy("application_id").agg(_n().alias("n"))
    return t["applications"].select(F.col("id").alias("application_id"), "name").join(r, "application_id", "left").select("name", F.coalesce("n", F.lit(0)).alias("reviews"))


def panel_latest_observations(t: Tables, n: int = 100) -> DataFrame:
    """DSH-16."""
    d = t["review_observations"].join(t["reviews"].select(F.col("id").alias("review_id"), "application_id"), "review_id")
    return newest(d.select("crawl_task_id", "review_id", "application_id", "score", "sentiment_status", "observed_at"), "observed_at", n, "crawl_task_id")


def panel_cumulative_reviews(t: Tables) -> DataFrame:
    """DSH-17: facts are summed to days before the running total."""
    return running_total(panel_daily_reviews(t), "day", "new_reviews", "reviews_so_far")


def indicators(t: Tables) -> DataFrame:
    """DSH-18, DQ-18: counts of what is missing or failed."""
    r, o = t["reviews"], t["review_observations"]
    rows = [("missing_source_time", r.where("source_at is null")), ("failed_sentiment", o.where("sentiment_status = 'failed'")), ("never_reobserved", r.where("first_observed_at = last_observed_at"))]
    return reduce(DataFrame.unionByName, [d.agg(_n().alias("n")).select(F.lit(name).alias("indicator"), "n") for name, d in rows])


def panel_sentiment(t: Tables) -> DataFrame:
    """DSH-19."""
    return t["review_observations"].groupBy("sentiment_status", F.coalesce("sentiment_label", F.lit("not assigned")).alias("sentiment_label")).agg(_n().alias("observations"))


def panel_active_applications(t: Tables) -> DataFrame:
    """DSH-20."""
    return t["applications"].where("is_active").select("id", "name").orderBy("name")


def panel_ledger(ledger: DataFrame) -> DataFrame:
    """DSH-21: claimed events by type, with the last time."""
    return ledger.groupBy("event_type").agg(_n().alias("events"), F.max("ingested_at").alias("last_ingested_at"))


def panel_captures(t: Tables) -> DataFrame:
    """DSH-22: captures by status and scenario."""
    return t["network_captures"].groupBy("status", "scenario").agg(_n().alias("captures"))


def panel_latest_captures(t: Tables, n: int = 15) -> DataFrame:
    """DSH-22: the last captures, and whether they have a result."""
    r = t["network_analysis_results"].select(F.col("capture_id").alias("id"), F.lit(True).alias("has_result"))
    return newest(t["network_captures"].select("id", "status", "scenario", "created_at").join(r, "id", "left").withColumn("has_result", F.coalesce("has_result", F.lit(False))), "created_at", n, "id")


def panel_table_counts(t: Tables) -> DataFrame:
    """DSH-23: four counts in one row."""
    one = [t[n].agg(_n().alias(n)) for n in ("crawl_runs", "crawl_tasks", "playstore_app_snapshots", "review_observations")]
    return reduce(DataFrame.crossJoin, one)


def panel_run_rows(t: Tables) -> DataFrame:
    """DSH-23: what each run has produced."""
    c = t["crawl_tasks"].select(F.col("id").alias("crawl_task_id"), "crawl_run_id")
    s = t["playstore_app_snapshots"].select("crawl_task_id", F.lit(1).alias("s"), F.lit(0).alias("o"))
    o = t["review_observations"].select("crawl_task_id", F.lit(0).alias("s"), F.lit(1).alias("o"))
    return s.unionByName(o).join(c, "crawl_task_id").groupBy("crawl_run_id").agg(F.sum("s").alias("snapshots"), F.sum("o").alias("observations"))


def panel_active_runs(t: Tables) -> DataFrame:
    """DSH-24."""
    return t["crawl_runs"].where(F.col("status").isin("pending", "running")).agg(_n().alias("active_runs"))


def finalize_runs(tasks: DataFrame) -> DataFrame:
    """AGG-20: a run's status from its tasks'."""
    ok, bad = F.count_if(F.col("status") == "succeeded"), F.count_if(F.col("status") == "failed")
    return tasks.groupBy("crawl_run_id").agg(_n().alias("n"), ok.alias("ok"), bad.alias("bad")).select("crawl_run_id", F.when(F.col("ok") == F.col("n"), "succeeded").when(F.col("bad") == F.col("n"), "failed").otherwise("partially_failed").alias("status"))


def log_volume(logs: DataFrame, every: str = "1 hour") -> DataFrame:
    """LOG-01: records of each service and interval."""
    return tumbling(logs, "timestamp", every, "service").agg(_n().alias("records")).select(F.col("w.start").alias("bucket"), "service", "records")


def log_levels(logs: DataFrame, every: str = "1 hour") -> DataFrame:
    """LOG-02: warnings and errors of each interval."""
    return tumbling(logs.where(F.lower("level").isin("warning", "error")), "timestamp", every, "level").agg(_n().alias("records")).select(F.col("w.start").alias("bucket"), "level", "records")


def recent_logs(logs: DataFrame, service: str = ".*", level: str = ".*", n: int = 1000) -> DataFrame:
    """LOG-03: the last records of which service and level match."""
    return newest(logs.where(F.col("service").rlike(f"^(?:{service})$") & F.col("level").rlike(f"^(?:{level})$")), "timestamp", n)


def expand_logs(lines: DataFrame, text: str = "line", labels: tuple[str, ...] = ()) -> DataFrame:
    """LOG-03: raw log lines with the fields of their JSON as columns; of a line that is no JSON the whole text is the message. Labels (columns of lines) win over fields of their name."""
    d = lines.withColumn("_j", F.from_json(text, LOG))
    names = [c.split(" ")[0] for c in LOG.split(", ")]
    broken = F.try_parse_json(F.col(text)).isNull()
    found = {c: F.coalesce(F.col(c), F.col(f"_j.{c}")) if c in labels else F.col(f"_j.{c}") for c in names}
    found["message"] = F.when(broken, F.col(text)).otherwise(found["message"])
    return d.select(*(c for c in lines.columns if c not in (text, *names)), *(v.alias(c) for c, v in found.items()))


def log_labels(logs: DataFrame) -> DataFrame:
    """LOG-04."""
    return logs.select("service", "level").distinct()


def event_durations(logs: DataFrame) -> DataFrame:
    """LOG-05: durations by event."""
    return logs.where("duration_seconds is not null").groupBy("event").agg(_n().alias("events"), F.avg("duration_seconds").alias("mean_seconds"), F.max("duration_seconds").alias("longest_seconds"))
