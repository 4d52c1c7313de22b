"""Questions on store snapshots. t is the bundle of tables, f holds optional filters; as_of is a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import age_hours, ladder
from quartzite.operators.filters import between_days, exclude_fixture, opt, succeeded
from quartzite.operators.temporal import LOCALE, daily_last, delta, gap_days, is_correction, latest_per, with_previous

Tables = dict[str, DataFrame]


def primary_category(t: Tables) -> DataFrame:
    """One category at most for each application: the smallest primary one."""
    first = t["application_categories"].where("is_primary").groupBy("application_id").agg(F.min("category_id").alias("primary_category_id"))
    names = t["categories"].select(F.col("id").alias("primary_category_id"), F.col("code").alias("primary_category_code"), F.col("name").alias("primary_category_name"))
    return first.join(names, "primary_category_id")


def applications(t: Tables, fixtures=(), application=None) -> DataFrame:
    found = t["applications"].withColumnsRenamed({"id": "application_id", "name": "application_name"})
    return opt(exclude_fixture(found, fixtures), "package_name", application)


def snapshots(t: Tables, country=None, language=None, own_task: bool = True, task_type: str | None = "app_details") -> DataFrame:
    """Snapshots of succeeded tasks with the crawl's locale; own_task: the task must be of the snapshot's application."""
    tasks = succeeded(t["crawl_tasks"], task_type).select(F.col("id").alias("crawl_task_id"), F.col("application_id").alias("task_application_id"), F.col("country_code").alias("crawl_country_code"), F.col("language_code").alias("crawl_language_code"))
    tasks = opt(opt(tasks, "crawl_country_code", country), "crawl_language_code", language)
    found = t["playstore_app_snapshots"].withColumnRenamed("id", "snapshot_id").join(tasks, "crawl_task_id")
    return (found.where("task_application_id = application_id") if own_task else found).drop("task_application_id")


def eligible(t: Tables, fixtures=(), application=None, country=None, language=None, **_) -> DataFrame:
    named = applications(t, fixtures, application).select("application_id", "application_name", "package_name")
    return snapshots(t, country, language).join(named, "application_id")


def portfolio(t: Tables, fixtures=(), application=None, category=None) -> DataFrame:
    return opt(applications(t, fixtures, application).join(primary_category(t), "application_id", "left"), "primary_category_code", category)


def portfolio_current(t: Tables, as_of: Column, fixtures=(), application=None, category=None, country=None, language=None) -> DataFrame:
    """Q01: every application with its latest snapshot, also without one."""
    last = latest_per(snapshots(t, country, language), ["application_id"], ["collected_at", "snapshot_id"], "successful_snapshot_count")
    base = portfolio(t, fixtures, application, category).withColumnsRenamed({"country_code": "registry_country_code", "language_code": "registry_language_code"})
    return base.join(last, "application_id", "left").select(
        "application_id", "application_name", "package_name", "is_active", "primary_category_code", "primary_category_name",
        "registry_country_code", "registry_language_code", "crawl_country_code", "crawl_language_code",
        F.col("collected_at").alias("latest_collected_at"), F.col("score").alias("latest_store_score_0_to_5"), "ratings_count", "reviews_count",
        F.col("min_installs").alias("min_installs_threshold"), "store_updated_on", "version", "ad_supported", "source_adapter", "successful_snapshot_count",
        F.col("collected_at").isNotNull().alias("has_successful_snapshot"),
        F.when(F.col("collected_at").isNull(), "missing").otherwise("available").alias("snapshot_coverage_status"),
        age_hours("collected_at", as_of, 1).alias("snapshot_age_hours"),
    )


NAMED = ["application_id", "application_name", "package_name", "crawl_country_code", "crawl_language_code"]


def store_rating_daily(t: Tables, start_date=None, end_date=None, **f) -> DataFrame:
    """Q02: the last snapshot of each UTC day; days are filtered after the pick."""
    days = between_days(daily_last(eligible(t, **f)), "snapshot_day_utc", start_date, end_date)
    return days.select(*NAMED, "snapshot_day_utc", F.col("collected_at").alias("daily_last_collected_at"), F.col("score").alias("store_score_0_to_5"), "ratings_count", "reviews_count", "source_adapter", "snapshots_in_day")


def rating_vs_category(t: Tables, as_of: Column, application=None, category=None, **f) -> DataFrame:
    """Q03: the latest score against the median of peers of the same category, locale and day; the application filter comes after the peers."""
    last = latest_per(eligible(t, **f), LOCALE, ["collected_at", "snapshot_id"]).withColumn("comparator_day_utc", F.to_date("collected_at"))
    last = last.join(primary_category(t), "application_id", "left")
    same = ["primary_category_id", "crawl_country_code", "crawl_language_code", "comparator_day_utc"]
    # an application has one row in each group: its peers are the rest, and their median is that of the sorted scores without its own
    known = F.lit(True)
    for c in same:
        known = known & F.col(c).isNotNull()
    w = Window.partitionBy(*same)
    last = last.withColumns({"_n": F.count(F.lit(1)).over(w), "_m": F.count("score").over(w), "_k": F.row_number().over(w.orderBy(F.col("score").asc_nulls_last(), "application_id")) - 1})
    middle = {f"_at{k}": F.max(F.when(F.col("_k") == F.floor((F.col("_m") + k) / 2) - 1, F.col("score"))).over(w) for k in range(4)}
    last = last.withColumns(middle)

    def without_own(k: int) -> Column:
        """Of the others' sorted scores, the one before (k = 0) or after (k = 1) the middle."""
        before = F.floor((F.col("_m") + k) / 2) - 1 < F.col("_k")
        return F.when(F.col("score").isNull(), F.col(f"_at{k + 1}")).when(before, F.col(f"_at{k}")).otherwise(F.col(f"_at{k + 2}"))

    low, high = without_own(0), without_own(1)
    median = F.when(low == high, low).otherwise(0.5 * low + 0.5 * high)
    out = last.withColumns({"peer_app_count": F.when(known, F.col("_n") - 1).otherwise(0), "peer_median": F.when(known, median)})
    enough = F.col("peer_app_count") >= 2
    status = ladder((F.col("primary_category_id").isNull(), "no_primary_category"), (F.col("peer_app_count") == 0, "no_same_date_locale_peers"), (F.col("peer_app_count") == 1, "insufficient_one_peer"), (F.col("peer_app_count") == 2, "limited_two_peer_sample"), otherwise="three_plus_peers")
    out = opt(opt(out, "package_name", application), "primary_category_code", category)
    return out.select(
        "application_id", "application_name", "package_name", "primary_category_code", "primary_category_name", "crawl_country_code", "crawl_language_code", "comparator_day_utc",
        F.col("collected_at").alias("latest_collected_at"), F.col("score").alias("application_store_score_0_to_5"), "peer_app_count",
        F.when(enough, F.col("peer_median")).alias("peer_median_score_0_to_5"), F.when(enough, F.col("score") - F.col("peer_median")).alias("score_minus_peer_median"),
        status.alias("peer_benchmark_status"), age_hours("collected_at", as_of, 1).alias("data_age_hours"),
    )


def _sequence(t: Tables, values: dict[str, str], start_date=None, end_date=None, **f) -> DataFrame:
    """Daily last snapshots with the day before's values; days are filtered after the look back."""
    found = with_previous(daily_last(eligible(t, **f)), LOCALE, "snapshot_day_utc", {"previous_observation_day_utc": "snapshot_day_utc"} | values)
    return between_days(found, "snapshot_day_utc", start_date, end_date)


def _gap() -> Column:
    return gap_days("snapshot_day_utc", "previous_observation_day_utc").alias("days_since_previous_observation")


def counts_growth(t: Tables, **f) -> DataFrame:
    """Q04: changes of ratings and reviews since the observed day before."""
    d = _sequence(t, {"previous_ratings_count": "ratings_count", "previous_reviews_count": "reviews_count"}, **f)
    changes = [c for x in ("ratings_count", "reviews_count") for c in (F.col(x), F.col(f"previous_{x}"), delta(x, f"previous_{x}").alias(f"{x}_change"), is_correction(x, f"previous_{x}").alias(f"{x}_negative_correction"))]
    return d.select(*NAMED, "snapshot_day_utc", F.col("collected_at").alias("daily_last_collected_at"), "snapshots_in_day", *changes, "previous_observation_day_utc", _gap())


def install_milestones(t: Tables, **f) -> DataFrame:
    """Q05: changes of the install threshold."""
    d = _sequence(t, {"previous_min_installs_threshold": "min_installs"}, **f)
    now, before = F.col("min_installs"), F.col("previous_min_installs_threshold")
    return d.select(
        *NAMED, "snapshot_day_utc", F.col("collected_at").alias("daily_last_collected_at"), "snapshots_in_day", now.alias("min_installs_threshold"), before,
        F.when(before.isNotNull() & (now != before), now - before).alias("observed_threshold_change"),
        F.when(before.isNull() | (now > before), now).alias("newly_observed_higher_threshold"),
        ladder((before.isNull(), "first_observation"), (now > before, "higher_threshold"), (now < before, "lower_revision"), otherwise="unchanged").alias("threshold_observation_status"),
        is_correction("min_installs", "previous_min_installs_threshold").alias("is_negative_threshold_revision"), "previous_observation_day_utc", _gap(),
    )


def _latest_of(t: Tables, base: DataFrame, country=None, language=None) -> DataFrame:
    last = latest_per(snapshots(t, country, language), ["application_id"], ["collected_at", "snapshot_id"])
    return base.join(last.select("application_id", "collected_at", "score", "ratings_count", "reviews_count"), "application_id", "left")


def executive_summary(t: Tables, as_of: Column, fixtures=(), application=None, country=None, language=None) -> DataFrame:
    """Q06: one row on the portfolio, also of an empty one."""
    last = _latest_of(t, applications(t, fixtures, application).select("application_id"), country, language)
    one = last.agg(F.count(F.lit(1)).alias("portfolio_application_count"), F.count("collected_at").alias("applications_with_snapshot"), F.max("collected_at").alias("newest_snapshot_at"), F.min("collected_at").alias("oldest_latest_snapshot_at"))
    return one.withColumns({
        "applications_missing_snapshot": F.col("portfolio_application_count") - F.col("applications_with_snapshot"),
        "newest_snapshot_age_hours": age_hours("newest_snapshot_at", as_of), "oldest_latest_snapshot_age_hours": age_hours("oldest_latest_snapshot_at", as_of),
    })


def category_summary(t: Tables, fixtures=(), application=None, category=None, country=None, language=None) -> DataFrame:
    """Q07: applications and mean latest score of each primary category, and of none."""
    last = _latest_of(t, portfolio(t, fixtures, application, category).drop("country_code", "language_code"), country, language)
    return last.groupBy("primary_category_code", "primary_category_name").agg(
        F.count(F.lit(1)).alias("application_count"), F.count("collected_at").alias("applications_with_snapshot"), F.avg("score").alias("mean_latest_store_score_0_to_5"),
        F.min("collected_at").alias("oldest_latest_snapshot_at"), F.max("collected_at").alias("newest_latest_snapshot_at"),
    )


def rating_changes(t: Tables, **f) -> DataFrame:
    """Q08: score changes since the observed day before."""
    d = _sequence(t, {"previous_store_score_0_to_5": "score"}, **f)
    return d.select(*NAMED, "snapshot_day_utc", F.col("collected_at").alias("daily_last_collected_at"), F.col("score").alias("store_score_0_to_5"), "previous_store_score_0_to_5", delta("score", "previous_store_score_0_to_5").alias("store_score_change_points"), "previous_observation_day_utc", _gap(), "snapshots_in_day")


def investigation(t: Tables, **f) -> DataFrame:
    """Q09: the latest day of each application and locale, with the signal to look into."""
    d = daily_last(eligible(t, **f))
    d = with_previous(d, LOCALE, "snapshot_day_utc", {"previous_day": "snapshot_day_utc", "previous_score": "score", "previous_ratings": "ratings_count", "previous_reviews": "reviews_count"})
    d = d.withColumn("k", F.row_number().over(Window.partitionBy(*LOCALE).orderBy(F.desc("snapshot_day_utc")))).where("k = 1")
    gap = gap_days("snapshot_day_utc", "previous_day")
    signal = ladder((F.col("previous_day").isNull(), "no_baseline"), ((F.col("ratings_count") < F.col("previous_ratings")) | (F.col("reviews_count") < F.col("previous_reviews")), "negative_count_correction"), (gap > 1, "observation_gap"), (F.col("score") != F.col("previous_score"), "rating_changed"), otherwise="no_defined_signal")
    return d.select(
        *NAMED[1:], "snapshot_day_utc", "collected_at", F.col("score").alias("latest_score_0_to_5"), delta("score", "previous_score").alias("score_change_points"),
        delta("ratings_count", "previous_ratings").alias("ratings_count_change"), delta("reviews_count", "previous_reviews").alias("reviews_count_change"), gap.alias("observation_gap_days"), signal.alias("investigation_signal"),
    )


def direct_pair(t: Tables, app_a: str, app_b: str, start_date=None, end_date=None, country=None, language=None) -> DataFrame:
    """Q18: the scores of two applications on the same day and locale."""
    days = daily_last(eligible(t, country=country, language=language).where(F.col("package_name").isin(app_a, app_b)))
    same = ["snapshot_day_utc", "crawl_country_code", "crawl_language_code"]
    a, b = (days.where(F.col("package_name") == p).select(*same, F.col("score").alias(f"score_{s}"), F.col("collected_at").alias(f"collected_at_{s}")) for p, s in ((app_a, "a"), (app_b, "b")))
    return between_days(a.join(b, same), "snapshot_day_utc", start_date, end_date).withColumn("a_minus_b_score_points", F.col("score_a") - F.col("score_b"))


def _count_changes(t: Tables, x: str, noun: str, **f) -> DataFrame:
    d = _sequence(t, {f"previous_{x}": x}, **f)
    return d.select(*NAMED[1:], "snapshot_day_utc", F.col("collected_at").alias("daily_last_collected_at"), F.col(x).alias(f"published_cumulative_{x}"), f"previous_{x}", delta(x, f"previous_{x}").alias(f"observed_{noun}_count_change"), (F.col(x) < F.col(f"previous_{x}")).alias("negative_correction"), _gap(), "snapshots_in_day")


def ratings_count_changes(t: Tables, **f) -> DataFrame:
    """Q19."""
    return _count_changes(t, "ratings_count", "ratings", **f)


def reviews_count_changes(t: Tables, **f) -> DataFrame:
    """Q20."""
    return _count_changes(t, "reviews_count", "reviews", **f)


def current_install_threshold(t: Tables, **f) -> DataFrame:
    """Q21: the latest install threshold of each application and locale."""
    last = latest_per(eligible(t, **f), LOCALE, ["collected_at", "snapshot_id"])
    return last.select(*NAMED[1:], F.col("min_installs").alias("min_installs_threshold"), F.col("collected_at").alias("latest_collected_at"))


def latest_rating(t: Tables, **f) -> DataFrame:
    """Q22: the latest score of each application and locale."""
    last = latest_per(eligible(t, **f), LOCALE, ["collected_at", "snapshot_id"])
    return last.select(*NAMED[1:], F.col("score").alias("latest_store_score_0_to_5"), F.col("collected_at").alias("latest_collected_at"))
