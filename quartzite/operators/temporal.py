"""Latest, daily, previous, as-of, period and interval operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import day_end, utc_day
from quartzite.functions.stats import span_sum

LOCALE = ["application_id", "crawl_country_code", "crawl_language_code"]


def _desc(order: list[str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in order]


def latest_per(df: DataFrame, keys: list[str], order: list[str], count_as: str | None = None) -> DataFrame:
    """The last row of each key by `order`, with the number of all its rows; one shuffle on the keys."""
    if count_as:
        df = df.withColumn(count_as, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def earliest_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def daily_last(df: DataFrame, keys: list[str] = LOCALE, ts: str = "collected_at", tie: str = "snapshot_id", day: str = "snapshot_day_utc") -> DataFrame:
    """The last row of each key and UTC day, and how many the day has.

    Rows are dealt by the keys without the day, so that a window over days that follows needs no other shuffle.
    """
    return latest_per(df.withColumn(day, utc_day(ts)).repartition(*keys), [*keys, day], [ts, tie], "snapshots_in_day")


def with_previous(df: DataFrame, keys: list[str], order: str, cols: dict[str, str]) -> DataFrame:
    """Adds, for each {new: old}, the value of `old` in the row before of the same key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns({new: F.lag(old).over(w) for new, old in cols.items()})


def gap_days(day: str, previous: str) -> Column:
    return F.datediff(F.col(day), F.col(previous))


def delta(x: str, previous: str) -> Column:
    return F.col(x) - F.col(previous)


def is_correction(x: str, previous: str) -> Column:
    """Did a cumulative count fall? NULL without a row before."""
    return F.when(F.col(previous).isNotNull(), F.col(x) < F.col(previous))


def transitions(df: DataFrame, key: str, order: list[str], value: str, previous: str) -> DataFrame:
    """Rows whose value differs from the one before of the same key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(previous, F.lag(value).over(w)).where(F.col(previous).isNotNull() & (F.col(previous) != F.col(value)))


def as_of_latest(obs: DataFrame, cutoffs: DataFrame, on: list[str], keys: list[str], ts: str, tie: str, cutoff: str) -> DataFrame:
    """For each key, the last observation strictly before its cutoff: later ones can't rewrite the past."""
    return latest_per(cutoffs.join(obs, on).where(F.col(ts) < F.col(cutoff)), keys, [ts, tie])


def periods(releases: DataFrame) -> DataFrame:
    """Two rows for each release: its period before and after, with days and the exclusive cutoff; one scan."""
    rows = F.array(*(F.struct(F.lit(name).alias("period"), F.col(a).alias("period_start"), F.col(b).alias("period_end"), day_end(b).alias("as_of_cutoff_exclusive_utc")) for name, a, b in (("before", "baseline_start", "baseline_end"), ("after", "followup_start", "followup_end"))))
    return releases.select("*", F.inline(rows))


def label_period(day: str) -> Column:
    """before or after, by the release's windows; NULL outside of both."""
    return F.when(F.col(day).between(F.col("baseline_start"), F.col("baseline_end")), "before").when(F.col(day).between(F.col("followup_start"), F.col("followup_end")), "after")


def endpoints(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ranks rows within keys, the last first."""
    return df.withColumn("endpoint_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*_desc(order))))


def number_sides(df: DataFrame, pair: str, order: list[str]) -> DataFrame:
    return df.withColumn("side", F.row_number().over(Window.partitionBy(pair).orderBy(*order)))


def running_total(df: DataFrame, order: str, n: str, out: str) -> DataFrame:
    """n summed up to each row. One task sums: give it days, not facts."""
    return df.withColumn(out, F.sum(n).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def ranked_to_share(df: DataFrame, keys: list[str], n: str, total: str, part: float) -> DataFrame:
    """df with _reached: its rank by n within keys where the sum of n so far, largest first, has reached `part` of `total`; else NULL."""
    w = Window.partitionBy(*keys).orderBy(F.desc(n))
    ranked = df.withColumn("_k", F.row_number().over(w)).withColumn("_sum", F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.withColumn("_reached", F.when(F.col("_sum") >= F.col(total) * part, F.col("_k"))).drop("_k", "_sum")


def count_to_share(df: DataFrame, keys: list[str], n: str, total: str, part: float, out: str) -> DataFrame:
    """For each key, how many of its rows, largest n first, reach `part` of `total`; all of them if they never do."""
    return ranked_to_share(df, keys, n, total, part).groupBy(*keys).agg(F.coalesce(F.min("_reached"), F.count(F.lit(1))).alias(out))


def union_length(df: DataFrame, keys: list[str], start: str, end: str, out: str) -> DataFrame:
    """For each key, the length of the union of its intervals; empty ones don't count."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0.0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return df.where(F.col(end) > F.col(start)).withColumn("_fresh", fresh).groupBy(*keys).agg(span_sum("_fresh").alias(out))


def islands(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, ts: str) -> DataFrame:
    """Stretches from a row that opens to the next that closes, for each key: keys, start, end (NULL while it is open).

    A row that opens inside an open stretch changes nothing.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    marks = df.withColumn("_open", opens).withColumn("_close", closes).where(F.col("_open") | F.col("_close"))
    marks = marks.withColumn("_before", F.lag("_open").over(w))
    marks = marks.withColumn("_end", F.first(F.when(F.col("_close"), F.col(ts)), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return marks.where(F.col("_open") & ~F.coalesce("_before", F.lit(False))).select(*keys, F.col(ts).alias("start"), F.col("_end").alias("end"))


def flips(df: DataFrame, keys: list[str], order: list[str], bit: str, ts: str, out: str) -> DataFrame:
    """Rows at which a bit differs from the one before of its key, with the time since that one."""
    w = Window.partitionBy(*keys).orderBy(*order)
    found = df.where(F.col(bit).isNotNull()).withColumn("_bit", F.lag(bit).over(w)).withColumn("_ts", F.lag(ts).over(w))
    return found.where(F.col("_bit") != F.col(bit)).withColumn(out, F.greatest(F.lit(0.0), F.col(ts) - F.col("_ts"))).drop("_bit", "_ts")


def overlaps(df: DataFrame, key: str, ident: str, start: str, end: str) -> DataFrame:
    """Rows whose range begins before an earlier range of the same key has ended."""
    w = Window.partitionBy(key).orderBy(start, end, ident).rowsBetween(Window.unboundedPreceding, -1)
    return df.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_latest", F.max(end).over(w)).where(F.col("_latest") >= F.col(start)).drop("_latest")
