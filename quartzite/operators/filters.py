"""Optional filters, cohorts and eligibility."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions.exprs import utc_day


def opt(df: DataFrame, column: str | Column, value, op: str = "=") -> DataFrame:
    """df, filtered only if there is a value. Where it is called is part of a question's meaning."""
    if value is None:
        return df
    c, v = (F.col(column) if isinstance(column, str) else column), F.lit(value)
    return df.where({"=": c == v, ">=": c >= v, "<=": c <= v}[op])


def between_days(df: DataFrame, day: str | Column, start=None, end=None) -> DataFrame:
    return opt(opt(df, day, start, ">="), day, end, "<=")


def exclude_fixture(df: DataFrame, packages: Sequence[str]) -> DataFrame:
    return df.where(~F.col("package_name").isin(*packages)) if packages else df


def succeeded(tasks: DataFrame, task_type: str | None = None) -> DataFrame:
    found = tasks.where(F.col("status") == "succeeded")
    return found if task_type is None else found.where(F.col("task_type") == task_type)


def in_cohort(df: DataFrame, packages: Sequence[str], column: str = "package_name") -> DataFrame:
    return df.where(F.col(column).isin(*packages))


def either_side(df: DataFrame, a: str, b: str, value) -> DataFrame:
    return df if value is None else df.where((F.col(a) == value) | (F.col(b) == value))


def verified_day(releases: DataFrame) -> DataFrame:
    return releases.where(F.col("release_date_verified") & (F.col("release_date_precision") == "day"))


def time_range(df: DataFrame, ts: str, start=None, end=None) -> DataFrame:
    return opt(opt(df, ts, start, ">="), ts, end, "<=")


def after_key(df: DataFrame, keys: Sequence[str], values: Sequence | None) -> DataFrame:
    """Rows after a key in the order of the keys; all without one."""
    return df if values is None else df.where(F.struct(*keys) > F.struct(*map(F.lit, values)))


def list_applications(applications: DataFrame, active: bool | None = None) -> DataFrame:
    return opt(applications, "is_active", active).orderBy("created_at", "id")


def list_captures(captures: DataFrame, application=None, scenario=None, status=None) -> DataFrame:
    found = opt(opt(opt(captures, "application_id", application), "scenario", scenario), "status", status)
    return found.orderBy(F.desc("created_at"), "id")


def _all(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def attributed() -> Column:
    """Is a capture analysed, and do its sources agree on scenario and package? Columns of trials(); three-valued."""
    return _all(F.col("capture_status") == "analyzed", F.col("capture_scenario") == F.col("scenario"), F.col("analysis_scenario") == F.col("scenario"), F.col("analysis_package") == F.col("application_package"))


def proven() -> Column:
    return _all(F.col("transfer_completed"), F.col("capture_isolation_confirmed"), F.col("cache_cleared_or_download_verified"), F.col("captured_size_bytes") == F.col("test_file_size_bytes"))


def measured() -> Column:
    """Is the throughput of a capture comparable?"""
    return _all(F.col("comparison_ready"), F.col("direction_metadata_available"), F.col("truncated_packet_count") == 0, F.col("observed_primary_payload_span_ms") > 0, F.col("effective_file_throughput_mbps").isNotNull())


def eligible_throughput() -> Column:
    return attributed() & proven() & measured()


def eligible_amplification() -> Column:
    return attributed() & proven() & F.col("total_transfer_amplification_ratio").isNotNull()


def eligible_overhead() -> Column:
    return attributed() & (F.col("network_bytes_total") > 0) & F.col("ip_transport_header_overhead_ratio").isNotNull()


def eligible_initial_rtt() -> Column:
    return attributed() & F.col("tcp_present") & F.col("tcp_rtt_available") & F.col("tcp_initial_rtt_avg_ms").isNotNull()


def eligible_ack_rtt() -> Column:
    return attributed() & F.col("tcp_present") & F.col("tcp_rtt_available") & F.col("tcp_ack_rtt_p95_ms").isNotNull()


def eligible_recovery(provenance: bool = False) -> Column:
    base = attributed() & F.col("tcp_present") & F.col("tcp_recovery_tax").isNotNull()
    return base & proven() if provenance else base


def started_day() -> Column:
    return utc_day("capture_started_at_utc")
