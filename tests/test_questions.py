"""Every registered query with SQL, on the smallest tables, against DuckDB; and the traps that the tables don't show."""

import datetime
import decimal
import math
import os
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from quartzite import catalog
from quartzite.bindings import Bound
from quartzite.plans import experiments, releases, reviews, store

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None or isinstance(v, datetime.date):
        return str(v)
    if isinstance(v, (float, int)):
        return "nan" if v != v else f"{v:.7g}"
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, found):
    order = sorted(columns)
    return sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in found)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


SLOW = {"net_capture_metrics"}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    found = db.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, found.fetchall())


def events_against_sql(spark, folder, events):
    """net_capture_metrics on events (event_id, user_id, event_type, k), and its SQL's rows; both by capture."""
    made = [(e, datetime.datetime(2024, 1, 1), u, t, 1.0, f'{{"k": {k}}}') for e, u, t, k in events]
    spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    spark.read.parquet(f"{SF}/nation.parquet").write.parquet(f"{folder}/nation.parquet")
    c = duckdb.connect()
    for name in ("events", "nation"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    found = c.execute(catalog.oracle_sql()["net_capture_metrics"])
    names = [d[0] for d in found.description]
    sql = {r["capture_id"]: r for r in (dict(zip(names, row)) for row in found.fetchall())}
    return {r.capture_id: r.asDict() for r in catalog.queries()["net_capture_metrics"](spark, str(folder)).collect()}, sql


def test_quic_with_no_known_version_has_an_empty_list(spark, tmp_path):
    got, sql = events_against_sql(spark, tmp_path, [(0, 2, "purchase", 10), (1, 4, "purchase", 11), (2, 3, "click", 5)])
    for side in (got, sql):
        assert [(side[c]["quic_version_count"], side[c]["quic_versions_seen"]) for c in ("cap2", "cap4", "cap3")] == [(0, []), (1, ["0x00000002"]), (None, None)]
    assert got == sql


def test_long_durations_add_up_alike_in_any_order(spark, tmp_path):
    far = 2**52 + 1  # six connections, each from second 0 to far / 64; added one by one they lose their last digits
    length, plain_sum = far / 64, 0.0
    for _ in range(6):
        plain_sum += length
    assert plain_sum * 1000 != math.fsum([length] * 6) * 1000
    got, sql = events_against_sql(spark, tmp_path, [(e, 2, "click", k) for e in (0, far) for k in range(1, 7)])
    assert got["cap2"]["tcp_connection_count"] == 6
    assert got["cap2"]["tcp_active_duration_ms"] == sql["cap2"]["tcp_active_duration_ms"] == math.fsum([length] * 6) * 1000
    assert got == sql


@pytest.fixture(scope="module")
def seed(spark):
    """A handful of rows that show where a filter stands."""
    ts = lambda s: datetime.datetime.fromisoformat(s)
    make = spark.createDataFrame
    tasks = [(f"t{k}", "a" if k < 6 else "b", "app_details" if k not in (8, 9) else "reviews", "failed" if k == 5 else "succeeded", "fa", "ir") for k in range(11)]
    snaps = [(1, "t0", "a", ts("2024-01-01 10:00"), 4.0, 100), (2, "t1", "a", ts("2024-01-01 23:59"), 4.1234567, 120), (3, "t2", "a", ts("2024-01-04 01:00"), 4.5, 110), (4, "t3", "a", ts("2024-01-05 01:00"), None, 130), (5, "t5", "a", ts("2024-01-06 01:00"), 1.0, 1), (6, "t6", "b", ts("2024-01-05 05:00"), 3.0, 10)]
    return {
        "applications": make([("a", "A", "com.a.x", True, None, None), ("b", "B", "com.b.x", True, None, None), ("c", "C", "com.fix.x", True, None, None)], "id string, name string, package_name string, is_active boolean, language_code string, country_code string"),
        "categories": make([(1, "one", "One"), (2, "two", "Two")], "id long, code string, name string"),
        "application_categories": make([("a", 2, True), ("a", 1, True), ("b", 1, True), ("a", 1, False)], "application_id string, category_id long, is_primary boolean"),
        "crawl_tasks": make(tasks, "id string, application_id string, task_type string, status string, language_code string, country_code string"),
        "playstore_app_snapshots": make(snaps, "id long, crawl_task_id string, application_id string, collected_at timestamp, score double, ratings_count long").withColumns({"reviews_count": F.col("ratings_count"), "min_installs": F.lit(5000), "store_updated_on": F.lit(None).cast("date"), "version": F.lit("1"), "ad_supported": F.lit(True), "source_adapter": F.lit("x")}),
        "reviews": make([(1, "b", ts("2024-01-02 10:00"), ts("2024-01-05 10:00"))], "id long, application_id string, first_observed_at timestamp, last_observed_at timestamp"),
        "review_observations": make([("t8", 1, ts("2024-01-02 10:00"), 1, "done", "negative"), ("t9", 1, ts("2024-01-05 10:00"), 4, "done", "positive")], "crawl_task_id string, review_id long, observed_at timestamp, score int, sentiment_status string, sentiment_label string").withColumn("sentiment_language", F.lit("fa")),
    }


def test_the_day_before_may_lie_outside_the_range(seed):
    got = store.counts_growth(seed, application="com.a.x", start_date=date(2024, 1, 4)).orderBy("snapshot_day_utc").collect()
    assert [(r.ratings_count_change, r.ratings_count_negative_correction, r.days_since_previous_observation) for r in got] == [(-10, True, 3), (20, False, 1)]


def test_last_of_a_day_and_how_many_it_has(seed):
    first = store.store_rating_daily(seed, application="com.a.x").orderBy("snapshot_day_utc").first()
    assert (first.store_score_0_to_5, first.snapshots_in_day) == (4.1234567, 2)


def test_fixtures_go_and_missing_snapshots_stay(seed):
    got = {r.package_name: r for r in store.portfolio_current(seed, F.lit("2024-01-07").cast("timestamp"), fixtures=["com.fix.x"]).collect()}
    assert set(got) == {"com.a.x", "com.b.x"} and got["com.a.x"].primary_category_code == "one" and got["com.a.x"].successful_snapshot_count == 4
    assert store.portfolio_current(seed, F.lit("2024-01-07").cast("timestamp")).where("snapshot_coverage_status = 'missing'").count() == 1


def test_application_filter_comes_after_peers(seed):
    got = store.rating_vs_category(seed, F.lit("2024-01-07").cast("timestamp"), application="com.b.x").collect()
    assert [(r.peer_app_count, r.peer_benchmark_status, r.peer_median_score_0_to_5) for r in got] == [(1, "insufficient_one_peer", None)]


def test_end_filters_before_the_pick_and_start_after(seed):
    early = reviews.star_distribution(seed, end_date=date(2024, 1, 3)).collect()
    assert [r.review_stars_1_to_5 for r in early] == [1]
    assert reviews.star_distribution(seed, start_date=date(2024, 1, 3)).count() == 0
    assert [r.score_upgrade_count for r in reviews.review_revisions(seed, start_date=date(2024, 1, 5)).collect()] == [1]


def test_later_revisions_do_not_rewrite_a_cohort(seed):
    assert [r.score for r in reviews.as_of_day_end(seed).collect()] == [1]


def test_empty_tables_still_answer(seed):
    none = {k: v.limit(0) for k, v in seed.items()}
    one = store.executive_summary(none, F.lit("2024-01-07").cast("timestamp")).collect()
    assert len(one) == 1 and one[0].portfolio_application_count == 0 and one[0].newest_snapshot_at is None
    assert store.category_summary(none).count() == 0


def test_capability_row_stays_without_releases(spark):
    t = Bound(spark, SF)
    t["release_manifest"] = t["release_manifest"].limit(0)
    got = releases.release_readiness(t).collect()
    assert len(got) == 1 and got[0].release_readiness == "release_manifest_missing"


def test_optional_blocks_are_typed_nulls(spark):
    t = Bound(spark, SF)
    assert releases.release_evidence(t, network=False).where("network_before_manifest_n is not null").count() == 0
    got = releases.release_user_voice(t, sentiment=False)
    assert got.where("before_classified_sentiment_reviews is not null").count() == 0 and dict(got.dtypes)["before_classified_sentiment_reviews"] == "bigint"


def test_filters_reach_the_scan_and_windows_share_a_shuffle(spark):
    df = catalog.queries()["q04_counts_growth"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(application_id") <= 2


def test_medians_are_gated(spark):
    got = experiments.benchmark_summary(Bound(spark, SF))
    assert got.where("n_valid < 3 and median_per_capture_effective_file_throughput_mbps is not null").count() == 0
    assert got.where("n_valid >= 3 and median_per_capture_effective_file_throughput_mbps is null").count() == 0
