"""Where tables come from: event streams, tables, manifests, dissected packets, capture files, logs, raw responses."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns that may be read of each table (what isn't named is private), and the fields of manifests and logs.
ALLOWED: dict[str, tuple[str, ...]] = {
    "applications": ("id", "name", "package_name", "is_active", "language_code", "country_code", "created_at"),
    "categories": ("id", "code", "name"),
    "application_categories": ("application_id", "category_id", "is_primary"),
    "crawl_runs": ("id", "status", "started_at", "finished_at"),
    "crawl_tasks": ("id", "crawl_run_id", "application_id", "task_type", "status", "language_code", "country_code", "started_at", "finished_at", "attempt_count", "error_code"),
    "playstore_app_snapshots": ("id", "crawl_task_id", "application_id", "collected_at", "score", "ratings_count", "reviews_count", "min_installs", "store_updated_on", "version", "ad_supported", "source_adapter"),
    "reviews": ("id", "application_id", "external_review_id", "source_at", "score", "first_observed_at", "last_observed_at", "source_adapter"),
    "review_observations": ("crawl_task_id", "review_id", "observed_at", "position", "score", "thumbs_up_count", "source_adapter", "sentiment_status", "sentiment_label", "sentiment_language"),
    "network_captures": ("id", "application_id", "scenario", "capture_size_bytes", "transfer_file_size_bytes", "status", "created_at", "uploaded_at", "analysis_finished_at"),
}
EXPERIMENT = "capture_id string, experiment_id string, session_id string, trial_number int, pair_id string, application_package string, scenario string, capture_started_at_utc timestamp, capture_finished_at_utc timestamp, transfer_completed boolean, test_file_sha256 string, test_file_size_bytes bigint, app_version string, device_model string, android_version string, network_type string, network_profile string, capture_tool string, capture_tool_version string, capture_isolation_confirmed boolean, cache_cleared_or_download_verified boolean, protocol_notes string, validation_notes string, experiment_phase string"
RELEASE = "release_event_id string, application_package string, previous_version string, new_version string, release_date date, release_date_precision string, release_date_source string, release_evidence_reference string, release_date_verified boolean, baseline_start date, baseline_end date, followup_start date, followup_end date, transition_period_start date, transition_period_end date, experiment_id_before string, experiment_id_after string, notes string"
LOG = "timestamp timestamp, level string, service string, logger string, event string, message string, duration_seconds double"
#: The dissector's fields, in the order of its tab-separated output.
PACKET_FIELDS = """frame.time_epoch frame.len frame.cap_len frame.packet_flags_direction frame.protocols ip.version ip.len ip.src ip.dst ip.flags.mf ip.frag_offset ip.dsfield.ecn ipv6.plen ipv6.src ipv6.dst ipv6.tclass ipv6.fraghdr.offset
 tcp.srcport tcp.dstport tcp.stream tcp.len tcp.flags.syn tcp.flags.ack tcp.flags.reset tcp.window_size_value tcp.analysis.initial_rtt tcp.analysis.ack_rtt tcp.analysis.retransmission tcp.analysis.fast_retransmission tcp.analysis.spurious_retransmission
 tcp.analysis.zero_window tcp.analysis.window_full tcp.analysis.out_of_order tcp.analysis.duplicate_ack tcp.analysis.lost_segment udp.srcport udp.dstport udp.length quic.version quic.long.packet_type quic.spin_bit
 dns.flags.response dns.flags.rcode dns.time icmp.type icmpv6.type""".split()
#: The first four bytes of capture files.
MAGIC = {"D4C3B2A1": "pcap", "A1B2C3D4": "pcap", "4D3CB2A1": "pcap", "A1B23C4D": "pcap", "0A0D0D0A": "pcapng"}


def offset_options(topics: Sequence[str], starting: str | dict[str, dict[int, int]] = "earliest", most: int | None = None) -> dict[str, str]:
    """Options of an event stream: topics, where each partition starts (earliest, latest, or {topic: {partition: offset}}, -2 and -1 being those two), and how many messages a trigger takes at most. Lost messages are an error."""
    if isinstance(starting, dict):
        starting = json.dumps({t: {str(p): o for p, o in at.items()} for t, at in starting.items()})
    elif starting not in ("earliest", "latest"):
        raise ValueError("a stream starts at earliest, latest, or an offset for each partition")
    options = {"subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "true"}
    return options | ({"maxOffsetsPerTrigger": str(most)} if most else {})


def read_events(spark: SparkSession, servers: str, topics: Sequence[str], starting: str | dict[str, dict[int, int]] = "earliest", most: int | None = None) -> DataFrame:
    """A stream of keyed events of several topics: key, value, topic, partition, offset, timestamp. Offsets live in the checkpoint."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).options(**offset_options(topics, starting, most)).load()


def allowlisted(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The allowed columns of a table; asking for another is an error, before anything is read."""
    wanted = list(columns or (c for c in ALLOWED[table] if c in df.columns))
    private = [c for c in wanted if c not in ALLOWED[table]]
    if private:
        raise ValueError(f"{table}: columns that may not be read: {', '.join(private)}")
    return df.select(*wanted)


def load_table(spark: SparkSession, path: str, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    return allowlisted(spark.read.parquet(path), table, columns)


def key_ranges(column: str, lower: int, upper: int, parts: int) -> list[str]:
    """Predicates that deal a table's rows by a whole-numbered key: one for each range, the outer ones open, null keys with the first. Each row passes exactly one."""
    if parts < 1 or upper < lower:
        raise ValueError("one range or more, from the lower to the upper key")
    cuts = sorted({lower + (upper - lower + 1) * k // parts for k in range(1, parts)} - {lower})
    if not cuts:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts, cuts[1:], strict=False)]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *inner, f"{column} >= {cuts[-1]}"]


def load_jdbc(spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 1, where: str | None = None, **options: str) -> DataFrame:
    """The allowed columns of a database's table; with a key, by as many connections as parts, each with its range of keys. `where` is pushed to all of them."""
    wanted = list(columns or ALLOWED[table])
    private = [c for c in wanted if c not in ALLOWED[table]]
    if private:
        raise ValueError(f"{table}: columns that may not be read: {', '.join(private)}")
    query = f"(SELECT {', '.join(dict.fromkeys([*wanted, *([key] if key else [])]))} FROM {table}{f' WHERE {where}' if where else ''}) t"
    found = spark.read.jdbc(url, query, predicates=key_ranges(key, *bounds, parts), properties=options) if key else spark.read.jdbc(url, query, properties=options)
    return allowlisted(found.select(*wanted), table, wanted)


def typed_empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema: a missing manifest is this, and every question still runs."""
    return spark.createDataFrame([], schema)


def _manifest(spark: SparkSession, path: str | None, field: str, schema: str) -> DataFrame:
    if path is None:
        return typed_empty(spark, schema)
    found = spark.read.schema(f"schema_version int, {field} array<struct<{', '.join(':'.join(c.split(' ')) for c in schema.split(', '))}>>").option("multiLine", "true").json(path)
    rows = F.when(F.col("schema_version") == 1, F.col(field)).otherwise(F.raise_error(F.lit("the manifest's schema_version must be 1")))
    return found.select(F.explode(rows).alias("x")).select("x.*")


def read_experiment_manifest(spark: SparkSession, path: str | None) -> DataFrame:
    """One row for each capture of a manifest; typed and empty without one."""
    return _manifest(spark, path, "captures", EXPERIMENT)


def read_catalogues(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What an experiment manifest allows: devices and network profiles by the column they are for (see check_catalogues), and cohorts (a, b)."""
    found = spark.read.schema("allowed_device_models array<string>, allowed_network_profiles array<string>, allowed_comparison_cohorts array<array<string>>").option("multiLine", "true").json(path)
    out = {column: found.select(F.explode(field).alias("v")) for column, field in (("device_model", "allowed_device_models"), ("network_profile", "allowed_network_profiles"))}
    return out | {"cohorts": found.select(F.explode("allowed_comparison_cohorts").alias("c")).select(F.col("c")[0].alias("a"), F.col("c")[1].alias("b"))}


def read_release_manifest(spark: SparkSession, path: str | None) -> DataFrame:
    return _manifest(spark, path, "release_events", RELEASE)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files with their number in the file, from 1: path, line_no, value. Files are read in as many splits as they have.

    A line's number is that of its split's lines before it and of the splits before that: only a row for each split is
    shuffled, whatever a file's length is.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"), "value")
    splits = raw.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.withColumn("_before", before).drop("_n")
    return raw.join(splits, ["path", "_block"]).select("path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_no"), "value")


def read_packet_fields(spark: SparkSession, path: str) -> DataFrame:
    """The dissector's output of many captures, one file each: all fields as text, with capture_id (the file's name) and packet_no, the number of its line."""
    lines = numbered_lines(spark, path)
    cells = F.split("value", "\t", -1)
    unquoted = lambda c: F.regexp_replace(c, '^"(.*)"$', "$1")
    name = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(name.alias("capture_id"), F.col("line_no").alias("packet_no"), *(unquoted(F.get(cells, F.lit(k))).alias(field) for k, field in enumerate(PACKET_FIELDS)))


def list_objects(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """The objects below a folder, object_key (its path from there) and size, without a look at what they hold.

    The driver lists `depth` levels of folders; what is below each of them is listed by a task. root must be an address
    that pyarrow opens (file, hdfs, s3, gs). A folder that isn't there has no objects.
    """
    fs, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/"))
    found, level = [], [base]
    for k in range(depth):
        below = [i for p in level for i in fs.get_file_info(pyarrow.fs.FileSelector(p, allow_not_found=True))]
        found += [(i.path, False) for i in below if i.type == pyarrow.fs.FileType.File]
        level = [i.path for i in below if i.type == pyarrow.fs.FileType.Directory]
    rows = spark.createDataFrame([*found, *((p, True) for p in level)], "path string, folder boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            for r in batch.to_pylist():
                infos = fs.get_file_info(pyarrow.fs.FileSelector(r["path"], recursive=True) if r["folder"] else [r["path"]])
                files = [i for i in infos if i.type == pyarrow.fs.FileType.File]
                yield pa.RecordBatch.from_arrays([pa.array([i.path[len(base) + 1 :] for i in files], pa.string()), pa.array([i.size for i in files], pa.int64())], ["object_key", "size"])

    return rows.repartition(max(1, min(len(level) + 1, spark.sparkContext.defaultParallelism * 4))).mapInArrow(run, "object_key string, size bigint")


def verify_captures(files: DataFrame, captures: DataFrame) -> DataFrame:
    """Capture files (binaryFile) against their rows (capture_id, capture_format, capture_sha256): format by magic number, and checksum.

    Content isn't kept; a row without a file, and a file of unknown format, are told apart by `problem`.
    """
    magic = F.hex(F.substring("content", 1, 4))
    known = F.create_map(*(x for k, v in MAGIC.items() for x in (F.lit(k), F.lit(v))))
    f = files.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("capture_id"), F.try_element_at(known, magic).alias("found_format"), F.sha2("content", 256).alias("found_sha256"), "length")
    d = captures.join(f, "capture_id", "left")
    problem = F.when(F.col("found_sha256").isNull(), "file_missing").when(F.col("found_format").isNull(), "unknown_format").when(F.col("found_format") != F.col("capture_format"), "format_mismatch").when(F.col("found_sha256") != F.col("capture_sha256"), "checksum_mismatch")
    return d.withColumn("problem", problem)


def read_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Structured log records, one JSON object a line."""
    return (spark.readStream if stream else spark.read).schema(LOG).json(path)


def explode_review_responses(df: DataFrame, limit: int = 1000, body: str = "body") -> DataFrame:
    """Raw review responses to one row for each item with its position from 1: an outer list behind a guard line holds a JSON text of a list of items.

    Bodies that don't parse have no rows; `limit`, at most 1000, bounds the items of a response as the source does.
    """
    outer = F.try_parse_json(F.regexp_replace(F.col(body), r"^\)\]\}'\s*", ""))
    inner = F.try_parse_json(F.try_variant_get(outer, "$[0][2]", "string"))
    items = F.from_json(F.to_json(F.try_variant_get(inner, "$[0]", "variant")), "array<string>")
    return df.withColumn("_items", items).select(*df.columns, F.posexplode(F.slice("_items", 1, min(limit, 1000))).alias("_at", "item")).withColumn("position", F.col("_at") + 1).drop("_at")
