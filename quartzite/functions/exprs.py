"""Scalar expressions: Column to Column, all on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PACKAGE = r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+$"
UNIT = "\x1f"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d as double; NULL where d is NULL or not above zero."""
    return F.when(col(d) > 0, col(n).cast("double") / col(d))


def share(n: Column, d: Column) -> Column:
    return n.cast("double") / F.nullif(d, F.lit(0)).cast("double")


def utc_day(ts: Column | str) -> Column:
    """The day of an instant; the session's zone is UTC."""
    return F.to_date(col(ts))


def day_end(day: Column | str) -> Column:
    """The first instant after a UTC day."""
    return F.date_add(col(day), 1).cast("timestamp")


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """NULL if either end is missing."""
    return (F.unix_micros(col(end)) - F.unix_micros(col(start))) / 1e6


def age_hours(ts: Column | str, as_of: Column, digits: int | None = None) -> Column:
    """Hours from ts to the as-of instant, which is always a parameter."""
    hours = (F.unix_micros(as_of) - F.unix_micros(col(ts))) / 3.6e9
    return hours if digits is None else F.round(hours, digits)


def newest(*ts: Column | str) -> Column:
    return F.greatest(*map(col, ts))


def oldest(*ts: Column | str) -> Column:
    return F.least(*map(col, ts))


def ladder(*arms: tuple[Column, str], otherwise: str | None = None) -> Column:
    """The label of the first condition that is true; order matters, NULL isn't true."""
    chain = reduce(lambda w, arm: w.when(arm[0], F.lit(arm[1])), arms[1:], F.when(arms[0][0], F.lit(arms[0][1])))
    return chain.otherwise(F.lit(otherwise).cast("string"))


def join_reasons(*arms: tuple[Column, str]) -> Column:
    """The labels of all true conditions, comma-separated; empty if none."""
    return F.concat_ws(", ", *(F.when(c, F.lit(s)) for c, s in arms))


def known_true(flag: Column | str) -> Column:
    return F.coalesce(col(flag), F.lit(False))


def effective_locale(value: Column | str, default: str) -> Column:
    return F.coalesce(F.nullif(col(value), F.lit("")), F.lit(default))


def parse_store_date(text: Column | str) -> Column:
    """`Never updated` and what no form fits give NULL; epoch seconds, `Jan 2, 2024` and ISO dates give a day."""
    t = F.trim(col(text))
    epoch = F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), F.to_date(F.timestamp_seconds(t.try_cast("double"))))
    return F.coalesce(epoch, F.when(t.rlike(r"^[A-Za-z]{3} \d{1,2}, \d{4}$"), F.to_date(F.try_to_timestamp(t, F.lit("MMM d, yyyy")))), F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(t, 1, 10).try_cast("date")))


def valid_package(text: Column | str) -> Column:
    return col(text).rlike(PACKAGE)


def valid_sha256(text: Column | str) -> Column:
    return col(text).rlike("^[0-9a-f]{64}$")


def opaque_id(prefix: str, *values: Column | str) -> Column:
    """prefix and the first 20 hex digits of the values' SHA-256, joined by a unit separator."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.concat_ws(UNIT, *(col(v).cast("string") for v in values)), 256), 1, 20))


def fingerprint(*values: str) -> Column:
    """SHA-256 of the values as JSON with sorted keys."""
    return F.sha2(F.to_json(F.struct(*sorted(values)), {"ignoreNullFields": "false"}), 256)


def flow_key(version: str = "ip_version", src: str = "src_ip", sport: str = "src_port", dst: str = "dst_ip", dport: str = "dst_port", transport: str = "transport") -> Column:
    """One key for both directions of a flow, the smaller endpoint first; NULL if a part is missing or it isn't TCP or UDP."""
    a, b = F.struct(F.col(src).alias("ip"), F.col(sport).alias("port")), F.struct(F.col(dst).alias("ip"), F.col(dport).alias("port"))
    whole = F.col(version).isNotNull() & F.col(src).isNotNull() & F.col(dst).isNotNull() & F.col(sport).isNotNull() & F.col(dport).isNotNull() & F.col(transport).isin("tcp", "udp")
    return F.when(whole, F.struct(F.col(version).alias("version"), F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.col(transport).alias("transport")))


def label(value: Column | str, suffix: str) -> Column:
    return F.concat(col(value).cast("string"), F.lit(suffix))


def sorted_set(value: Column | str, exclude: tuple[str, ...] = ()) -> Column:
    """Aggregate: distinct values but the excluded ones, sorted."""
    v = col(value)
    return F.array_sort(F.collect_set(F.when(~v.isin(*exclude), v) if exclude else v))


def compound_label(score: Column | str) -> Column:
    """Compound scores from 0.05 up are positive, from -0.05 down negative."""
    s = col(score)
    return F.when(s >= 0.05, "positive").when(s <= -0.05, "negative").when(s.isNotNull(), "neutral")


def collapse_labels(probabilities: Column | str, groups: dict[str, list[int]]) -> Column:
    """The group of the largest summed probability; of equals the first named."""
    p = col(probabilities)
    sums = [F.struct(sum((F.get(p, F.lit(i)) for i in at), F.lit(0.0)).alias("p"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, at) in enumerate(groups.items())]
    return F.when(p.isNotNull(), F.greatest(*sums)["name"])


def clip(text: Column | str, n: int) -> Column:
    return F.substring(col(text), 1, n)


def first_of(text: Column | str) -> Column:
    """The first of a comma list."""
    return F.trim(F.split(col(text), ",")[0])


def first_int(text: Column | str) -> Column:
    """The first of a comma list as a number, decimal or 0x hexadecimal; NULL if it is none."""
    t = F.lower(first_of(text))
    return F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("bigint")).otherwise(t.try_cast("bigint"))


def first_float(text: Column | str) -> Column:
    return first_of(text).try_cast("double")


def flag(text: Column | str) -> Column:
    """A field is set if it holds something besides 0, false or no; missing is not set."""
    t = F.lower(first_of(text))
    return F.coalesce(~t.isin("", "0", "false", "no"), F.lit(False))
