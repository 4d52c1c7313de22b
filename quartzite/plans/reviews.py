"""Questions on reviews and their sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import age_hours, share, utc_day
from quartzite.functions.stats import count_where, share_of_total
from quartzite.operators.filters import between_days, opt, succeeded
from quartzite.operators.temporal import earliest_per, latest_per, transitions
from quartzite.plans.store import Tables, applications, primary_category

GROUP = ["application_name", "package_name", "crawl_country_code", "crawl_language_code"]
LABELS = ("positive", "neutral", "negative")


def observations(t: Tables, fixtures=(), application=None, country=None, language=None, statuses: bool = True) -> DataFrame:
    """Observations of succeeded review tasks of the review's own application, with names and the crawl's locale."""
    tasks = t["crawl_tasks"].where("task_type = 'reviews'")
    tasks = (succeeded(tasks) if statuses else tasks).select(F.col("id").alias("crawl_task_id"), "application_id", F.col("country_code").alias("crawl_country_code"), F.col("language_code").alias("crawl_language_code"))
    tasks = opt(opt(tasks, "crawl_country_code", country), "crawl_language_code", language)
    reviews = t["reviews"].select(F.col("id").alias("review_id"), "application_id", "first_observed_at")
    named = applications(t, fixtures, application).select("application_id", "application_name", "package_name")
    seen = t["review_observations"].drop("thumbs_up_count", "source_adapter")
    return seen.join(reviews, "review_id").join(tasks, ["crawl_task_id", "application_id"]).join(named, "application_id")


def review_cohort(t: Tables, start_date=None, end_date=None, category=None, **f) -> DataFrame:
    """Each review as it was last seen up to end_date; start_date holds for the first sight, after the pick."""
    seen = observations(t, **f)
    if category is not None:
        seen = opt(seen.join(primary_category(t), "application_id", "left"), "primary_category_code", category)
    seen = opt(seen, utc_day("observed_at"), end_date, "<=")
    return opt(latest_per(seen, ["review_id"], ["observed_at", "crawl_task_id"]), utc_day("first_observed_at"), start_date, ">=")


def classified() -> Column:
    return F.coalesce((F.col("sentiment_status") == "done") & F.col("sentiment_label").isin(*LABELS), F.lit(False))


def star_distribution(t: Tables, **f) -> DataFrame:
    """Q10."""
    return review_cohort(t, **f).groupBy(*GROUP, F.col("score").alias("review_stars_1_to_5")).agg(F.count(F.lit(1)).alias("unique_review_count"), F.max("observed_at").alias("latest_observation_at"))


def review_cohort_kpis(t: Tables, as_of: Column, **f) -> DataFrame:
    """Q11."""
    n, low, high = F.count(F.lit(1)), count_where(F.col("score").isin(1, 2)), count_where(F.col("score").isin(4, 5))
    return review_cohort(t, **f).groupBy(*GROUP).agg(
        n.alias("unique_review_count"), F.avg("score").alias("mean_unique_review_stars_1_to_5"), low.alias("negative_review_count_1_2_stars"), high.alias("positive_review_count_4_5_stars"),
        share(low, n).alias("negative_review_share"), share(high, n).alias("positive_review_share"), F.min("first_observed_at").alias("earliest_first_observed_at"),
        F.max("first_observed_at").alias("latest_first_observed_at"), F.max("observed_at").alias("latest_observed_at"), age_hours(F.max("observed_at"), as_of).alias("observation_age_hours"),
    )


def review_revisions(t: Tables, start_date=None, end_date=None, country=None, language=None, **f) -> DataFrame:
    """Q12: star changes by day; even the locale filters after the look back."""
    found = transitions(observations(t, **f), "review_id", ["observed_at", "crawl_task_id"], "score", "previous_score").withColumn("transition_day_utc", utc_day("observed_at"))
    found = between_days(opt(opt(found, "crawl_country_code", country), "crawl_language_code", language), "transition_day_utc", start_date, end_date)
    return found.groupBy(*GROUP, "transition_day_utc").agg(F.count(F.lit(1)).alias("score_revision_count"), count_where(F.col("score") > F.col("previous_score")).alias("score_upgrade_count"), count_where(F.col("score") < F.col("previous_score")).alias("score_downgrade_count"))


def sentiment_coverage(t: Tables, **f) -> DataFrame:
    """Q13."""
    n, done = F.count(F.lit(1)), count_where(classified())
    each = [count_where(F.col("sentiment_status") == s).alias(f"{s}_reviews") for s in ("pending", "skipped", "failed", "done")]
    return review_cohort(t, **f).groupBy(*GROUP).agg(n.alias("eligible_unique_reviews"), *each, done.alias("classified_unique_reviews"), share(done, n).alias("classification_coverage"), F.max("observed_at").alias("latest_observed_at"))


def sentiment_distribution(t: Tables, **f) -> DataFrame:
    """Q14."""
    found = review_cohort(t, **f).where(classified()).groupBy(*GROUP, "sentiment_label").agg(F.count(F.lit(1)).alias("classified_unique_reviews_for_label"))
    return share_of_total(found, GROUP, "classified_unique_reviews_for_label", "classified_sample_size", "sentiment_share")


def sentiment_trend(t: Tables, **f) -> DataFrame:
    """Q15: by the day of first sight."""
    done, bad = count_where(classified()), count_where((F.col("sentiment_status") == "done") & (F.col("sentiment_label") == "negative"))
    return review_cohort(t, **f).groupBy(*GROUP, utc_day("first_observed_at").alias("first_observed_day_utc")).agg(F.count(F.lit(1)).alias("eligible_unique_reviews"), done.alias("classified_unique_reviews"), bad.alias("negative_classified_reviews"), share(bad, done).alias("negative_sentiment_share"))


def sentiment_language(t: Tables, **f) -> DataFrame:
    """Q16: within the language that was inferred, not crawled."""
    found = review_cohort(t, **f).where(classified()).groupBy(*GROUP, "sentiment_language", "sentiment_label").agg(F.count(F.lit(1)).alias("unique_classified_reviews"))
    return share_of_total(found, [*GROUP, "sentiment_language"], "unique_classified_reviews", "language_classified_sample_size", "share_in_language")


def stars_vs_sentiment(t: Tables, **f) -> DataFrame:
    """Q17: stars by label, the unclassified too."""
    measure = F.when(classified(), F.col("sentiment_label")).otherwise("unclassified").alias("sentiment_measure")
    return review_cohort(t, **f).groupBy(*GROUP, F.col("score").alias("review_stars_1_to_5"), measure).agg(F.count(F.lit(1)).alias("unique_review_count"), count_where(classified()).alias("classified_sample_size"))


def first_observed_daily(t: Tables, start_date=None, end_date=None, country=None, language=None, **f) -> DataFrame:
    """Q23: reviews by the day of first sight, under the locale that saw them first."""
    found = earliest_per(observations(t, **f), ["review_id"], ["observed_at", "crawl_task_id"]).withColumn("first_observed_day_utc", utc_day("first_observed_at"))
    found = between_days(opt(opt(found, "crawl_country_code", country), "crawl_language_code", language), "first_observed_day_utc", start_date, end_date)
    return found.groupBy(*GROUP, "first_observed_day_utc").agg(F.count(F.lit(1)).alias("newly_observed_unique_reviews"))


def sampling_coverage(t: Tables, fixtures=(), application=None, country=None, language=None) -> DataFrame:
    """Q24: tasks and samples are each summed up before they meet, so neither multiplies the other."""
    named = applications(t, fixtures, application).select("application_id", "application_name", "package_name")
    tasks = t["crawl_tasks"].where("task_type = 'reviews'").withColumnsRenamed({"country_code": "crawl_country_code", "language_code": "crawl_language_code"})
    tasks = opt(opt(tasks, "crawl_country_code", country), "crawl_language_code", language)
    n, ok = F.count(F.lit(1)), count_where(F.col("status") == "succeeded")
    per = tasks.join(named, "application_id").groupBy("application_id", *GROUP).agg(n.alias("review_crawl_tasks"), ok.alias("successful_review_crawl_tasks"), share(ok, n).alias("crawl_task_success_share"))
    keys = ["application_id", "crawl_country_code", "crawl_language_code"]
    sample = observations(t, fixtures, application, country, language).groupBy(*keys).agg(F.count_distinct("review_id").alias("unique_reviews_in_sample"), F.max("observed_at").alias("latest_review_observation_at"))
    return per.join(sample, keys, "left").withColumn("unique_reviews_in_sample", F.coalesce("unique_reviews_in_sample", F.lit(0))).drop("application_id")


def as_of_day_end(t: Tables) -> DataFrame:
    """Each review as it was last seen on the UTC day of its first sight."""
    first = t["reviews"].select(F.col("id").alias("review_id"), "application_id", "first_observed_at", utc_day("first_observed_at").alias("cohort_day_utc"))
    seen = t["review_observations"].select("review_id", "crawl_task_id", "observed_at", "score")
    cutoff = F.date_add("cohort_day_utc", 1).cast("timestamp")
    return latest_per(first.withColumn("as_of_cutoff_exclusive_utc", cutoff).join(seen, "review_id").where("observed_at < as_of_cutoff_exclusive_utc"), ["review_id"], ["observed_at", "crawl_task_id"])


def last_scores(t: Tables) -> DataFrame:
    w = Window.partitionBy("review_id").orderBy(F.desc("observed_at"), F.desc("crawl_task_id"))
    seen = t["review_observations"].select("review_id", "score", "observed_at", "crawl_task_id").withColumn("k", F.row_number().over(w)).where("k = 1")
    return seen.join(t["reviews"].select(F.col("id").alias("review_id"), "application_id"), "review_id")
