"""Where tables go: keyed events, insert-if-absent, and flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUPS = ("capture", "capabilities", "traffic", "protocol_mix", "ip", "flow", "transfer", "tcp", "quic", "udp", "dns")


def event_messages(df: DataFrame, key: str = "application_id") -> DataFrame:
    """Rows as messages: the row as JSON, keyed by its application so that one application's events keep their order."""
    return df.select(F.col(key).cast("string").cast("binary").alias("key"), F.to_json(F.struct(*df.columns)).cast("binary").alias("value"))


def enveloped(df: DataFrame, event_type: str, topic: str, occurred_at: str, version: int = 1, key: str = "application_id") -> DataFrame:
    """Rows as messages of an event type (key, value, topic, at): the row is the payload of an envelope with event_id, type, version and time.

    The id is made of type and payload, so that a row that is published again is the same event. Times are written in
    UTC; null fields stay, as the contract names every field.
    """
    kinds = dict(df.dtypes)
    iso = lambda c: F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'") if kinds[c] == "timestamp" else F.col(c)
    payload = F.to_json(F.struct(*(iso(c).alias(c) for c in df.columns)), {"ignoreNullFields": "false"})
    digest = F.sha2(F.concat(F.lit(f"{event_type} {version} "), payload), 256)
    part = lambda a, n: F.substring(digest, a, n)
    uuid = F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("8"), part(14, 3)), F.concat(F.lit("a"), part(18, 3)), part(21, 12))
    body = F.concat(F.lit('{"event_id":"'), uuid, F.lit(f'","event_type":"{event_type}","schema_version":{version},"occurred_at":"'), iso(occurred_at), F.lit('","payload":'), payload, F.lit("}"))
    return df.select(F.col(key).cast("string").cast("binary").alias("key"), body.cast("binary").alias("value"), F.lit(topic).alias("topic"), F.col(occurred_at).alias("at"))


def write_events(df: DataFrame, servers: str, topic: str, key: str = "application_id") -> None:
    event_messages(df, key).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def insert_absent(batch: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a batch that a keyed table doesn't have, one for each key."""
    return batch.dropDuplicates(list(keys)).join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)


def flatten_analysis(df: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """A nested analysis event as one wide row; an absent group gives NULL columns."""
    return df.select(*(c for c in df.columns if c not in groups), *(f"{g}.*" for g in groups if g in df.columns))
