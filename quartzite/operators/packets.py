"""Packets of many captures reduced to one row of metrics for each capture, by grouping and windows.

Packets carry capture_id and packet_no; equal timestamps go by packet_no. Percentiles are nearest-rank. Where a protocol
doesn't occur its metrics are NULL, not zero; where a denominator is zero a ratio is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quartzite.functions.exprs import first_float, first_int, first_of, flag, flow_key, ratio
from quartzite.functions.stats import nearest_rank, span_sum
from quartzite.operators.temporal import flips, islands, ranked_to_share, union_length

SUPPORTED = frozenset({"quic.version", "quic.long.packet_type", "quic.spin_bit"})
MIB = 1_048_576
ID = "capture_id"


def _seen(c: str) -> Column:
    return F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")) != ""


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Dissected fields (strings, named as the dissector names them) to typed packets; rows without time or lengths go.

    IPv4 counts its own length, IPv6 its payload and 40 bytes of header; a UDP datagram's payload is its length less 8.
    """
    f = lambda c: F.col(f"`{c}`")
    n = lambda c: first_int(f(c))
    v4, v6 = n("ip.len").isNotNull(), n("ipv6.plen").isNotNull()
    tcp, udp = (n(f"{p}.srcport").isNotNull() & n(f"{p}.dstport").isNotNull() for p in ("tcp", "udp"))
    quic = F.array_contains(F.split(F.lower(F.coalesce(f("frame.protocols"), F.lit(""))), ":"), "quic") | _seen("quic.version") | _seen("quic.long.packet_type") | _seen("quic.spin_bit")
    network = F.greatest(F.lit(0), F.when(v4, n("ip.len")).when(v6, n("ipv6.plen") + 40))
    payload = F.greatest(F.lit(0), F.when(tcp, n("tcp.len")).when(udp, F.coalesce(n("udp.length"), F.lit(0)) - 8))
    way = F.lower(F.trim(f("frame.packet_flags_direction")))
    ecn = F.when(v4, n("ip.dsfield.ecn")).when(v6, n("ipv6.tclass").bitwiseAND(3))
    fragment = flag(f("ip.flags.mf")) | (F.coalesce(n("ip.frag_offset"), F.lit(0)) > 0) | _seen("ipv6.fraghdr.offset")
    icmp = F.coalesce(n("icmp.type").isin(3, 4, 5, 11, 12), F.lit(False)) | F.coalesce(n("icmpv6.type") < 128, F.lit(False))
    out = raw.select(
        ID, "packet_no", first_float(f("frame.time_epoch")).alias("timestamp"), first_int(f("frame.len")).alias("frame_len"), first_int(f("frame.cap_len")).alias("captured_len"),
        F.when(way.isin("2", "outbound", "sent"), "tx").when(way.isin("1", "inbound", "received"), "rx").alias("direction"), F.when(v4, 4).when(v6, 6).alias("ip_version"), F.coalesce(network, F.lit(0)).alias("network_bytes"),
        F.when(v4, first_of(f("ip.src"))).when(v6, first_of(f("ipv6.src"))).alias("src_ip"), F.when(v4, first_of(f("ip.dst"))).when(v6, first_of(f("ipv6.dst"))).alias("dst_ip"),
        *(F.when(tcp, first_int(f(f"tcp.{p}port"))).when(udp, first_int(f(f"udp.{p}port"))).cast("int").alias(f"{p}_port") for p in ("src", "dst")),
        F.when(tcp, "tcp").when(udp, "udp").otherwise("other").alias("transport"), F.coalesce(payload, F.lit(0)).alias("l4_payload_bytes"), first_int(f("tcp.stream")).cast("int").alias("tcp_stream"),
        fragment.alias("ip_fragment"), F.coalesce(ecn == 3, F.lit(False)).alias("ecn_ce"), icmp.alias("icmp_error"),
        *(flag(f(c)).alias(o) for c, o in (("tcp.flags.syn", "tcp_syn"), ("tcp.flags.ack", "tcp_ack"), ("tcp.flags.reset", "tcp_rst"))),
        *(flag(f(f"tcp.analysis.{c}")).alias(f"tcp_{o}") for c, o in (("retransmission", "retransmission"), ("fast_retransmission", "fast_retransmission"), ("spurious_retransmission", "spurious_retransmission"), ("zero_window", "zero_window"), ("window_full", "window_full"), ("out_of_order", "out_of_order"), ("duplicate_ack", "duplicate_ack"), ("lost_segment", "lost_segment"))),
        n("tcp.window_size_value").cast("int").alias("tcp_window_size"), first_float(f("tcp.analysis.initial_rtt")).alias("tcp_initial_rtt_seconds"), first_float(f("tcp.analysis.ack_rtt")).alias("tcp_ack_rtt_seconds"),
        quic.alias("quic"), F.nullif(first_of(f("quic.version")), F.lit("")).alias("quic_version"), F.nullif(first_of(f("quic.long.packet_type")), F.lit("")).alias("quic_packet_type"), first_int(f("quic.spin_bit")).cast("int").alias("quic_spin_bit"),
        (n("dns.flags.response") != 0).alias("dns_is_response"), first_int(f("dns.flags.rcode")).cast("int").alias("dns_response_code"), first_float(f("dns.time")).alias("dns_time_seconds"),
    )
    return out.where("timestamp is not null and frame_len is not null and captured_len is not null")


def _n(where: Column | str) -> Column:
    return F.count_if(F.expr(where) if isinstance(where, str) else where)


def _sum(value: str, where: str | None = None) -> Column:
    return F.coalesce(F.sum(F.when(F.expr(where), F.col(value)) if where else F.col(value)), F.lit(0))


def _kinds(packets: DataFrame) -> DataFrame:
    """Packets with what they count for: _ip, and of those _tcp, _quic and _udp (datagrams that aren't QUIC); _dns over all packets."""
    ip = F.coalesce(F.col("ip_version").isin(4, 6), F.lit(False))
    kinds = {"_ip": ip, "_tcp": ip & (F.col("transport") == "tcp"), "_quic": ip & F.col("quic"), "_udp": ip & (F.col("transport") == "udp") & ~F.col("quic"), "_dns": F.col("dns_is_response").isNotNull()}
    return packets.withColumns({k: F.coalesce(c, F.lit(False)) for k, c in kinds.items()})


def _basics() -> dict[str, Column]:
    """NET-01, NET-02: duration, counts, and whether every IP packet has a direction."""
    return {
        "capture_duration_ms": (F.max("timestamp") - F.min("timestamp")) * 1000, "packet_count": F.count(F.lit(1)), "truncated_packet_count": _n("captured_len < frame_len"), "icmp_error_count": _n("icmp_error"),
        "direction_metadata_available": F.coalesce(F.bool_and(F.when(F.col("_ip"), F.col("direction").isNotNull())), F.lit(False)),
    }


def _totals() -> dict[str, Column]:
    """NET-03 to NET-05 and what NET-08 needs."""
    out = {"network_bytes_total": _sum("network_bytes", "_ip"), "l4_payload_bytes_total": _sum("l4_payload_bytes", "_ip")}
    for d in ("tx", "rx"):
        way = f"_ip and direction = '{d}'"
        at = F.expr(f"if({way} and l4_payload_bytes > 0, timestamp, null)")
        out |= {f"{d}_network_bytes": _sum("network_bytes", way), f"{d}_l4_payload_bytes": _sum("l4_payload_bytes", way), f"{d}_packet_count": _n(way), f"_{d}_first": F.min(at), f"_{d}_last": F.max(at)}
    out |= {"tcp_bytes": _sum("network_bytes", "_tcp"), "quic_identified_bytes": _sum("network_bytes", "_quic"), "other_udp_bytes": _sum("network_bytes", "_udp")} | {f"_ipv{v}": _sum("network_bytes", f"_ip and ip_version = {v}") for v in (4, 6)}
    remote = F.nullif(F.expr("if(_ip, if(direction = 'tx', dst_ip, src_ip), null)"), F.lit(""))
    return out | {"_ip_packets": _n("_ip"), "ip_fragment_count": _n("_ip and ip_fragment"), "ecn_ce_packet_count": _n("_ip and ecn_ce"), "unique_remote_ip_count": F.size(F.collect_set(remote)).cast("bigint")}


def _tcp_totals() -> dict[str, Column]:
    again, ack = "_tcp and (tcp_retransmission or tcp_fast_retransmission or tcp_spurious_retransmission)", "tcp_ack_rtt_seconds * 1000"
    flags = (("zero_window", "zero_window_count"), ("window_full", "window_full_count"), ("out_of_order", "out_of_order_count"), ("duplicate_ack", "duplicate_ack_count"), ("lost_segment", "lost_segment_indicator_count"))
    return {
        "tcp_ack_rtt_min_ms": F.min(F.expr(f"if(_tcp, {ack}, null)")), "tcp_ack_rtt_p50_ms": nearest_rank(ack, 50, "_tcp"), "tcp_ack_rtt_p95_ms": nearest_rank(ack, 95, "_tcp"), "tcp_data_segment_count": _n("_tcp and l4_payload_bytes > 0"),
        "tcp_retransmission_count": _n(again), "tcp_fast_retransmission_count": _n("_tcp and tcp_fast_retransmission"), "tcp_spurious_retransmission_count": _n("_tcp and tcp_spurious_retransmission"), "tcp_retransmitted_payload_bytes": _sum("l4_payload_bytes", again),
        "_payload": _sum("l4_payload_bytes", "_tcp"), **{f"tcp_{o}": _n(f"_tcp and tcp_{c}") for c, o in flags},
    }


def _quic_totals(supported: frozenset[str]) -> dict[str, Column]:
    """NET-18; what the dissector can't tell is NULL."""
    known = lambda field, c: c if field in supported else F.lit(None).cast("bigint")
    kind = F.lower("quic_packet_type")
    seen = F.array_sort(F.collect_set(F.when(F.col("_quic") & ~F.col("quic_version").isin("", "0", "0x00000000"), F.col("quic_version"))))
    return {
        "quic_version_count": known("quic.version", F.size(seen).cast("bigint")), "quic_versions_seen": seen if "quic.version" in supported else F.lit(None).cast("array<string>"),
        "quic_retry_count": known("quic.long.packet_type", _n(F.col("_quic") & kind.isin("3", "retry"))), "quic_version_negotiation_count": known("quic.version", _n(F.col("_quic") & F.col("quic_version").isin("0", "0x00000000"))),
        "quic_0rtt_observed_count": known("quic.long.packet_type", _n(F.col("_quic") & kind.isin("1", "0-rtt", "0rtt", "0_rtt"))),
    }


def _udp_totals() -> dict[str, Column]:
    """NET-21: sides follow the smaller endpoint of each flow, summed over flows."""
    mine, size = F.struct(F.col("src_ip").alias("ip"), F.col("src_port").alias("port")) == F.col("flow.a"), "cast(l4_payload_bytes as double)"
    return {
        "udp_datagram_count": _n("_udp"), "udp_network_bytes": F.sum(F.expr("if(_udp, network_bytes, null)")), "udp_payload_bytes": F.sum(F.expr("if(_udp, l4_payload_bytes, null)")), "udp_payload_size_p50": nearest_rank(size, 50, "_udp"), "udp_payload_size_p95": nearest_rank(size, 95, "_udp"),
        "_a": F.coalesce(F.sum(F.when(F.col("_udp") & mine, F.col("network_bytes"))), F.lit(0)), "_b": F.coalesce(F.sum(F.when(F.col("_udp") & ~mine, F.col("network_bytes"))), F.lit(0)),
    }


def _dns_totals() -> dict[str, Column]:
    """NET-22: over all packets."""
    ms = "dns_time_seconds * 1000"
    return {"dns_query_count": _n("_dns and not dns_is_response"), "dns_response_count": _n("_dns and dns_is_response"), "dns_failure_count": _n("_dns and dns_is_response and dns_response_code <> 0"), "dns_rtt_p50_ms": nearest_rank(ms, 50, "_dns"), "dns_rtt_p95_ms": nearest_rank(ms, 95, "_dns")}


def capture_totals(packets: DataFrame, supported: frozenset[str] = SUPPORTED) -> DataFrame:
    """Everything that is summed over the packets of a capture, in one aggregation; a protocol's columns are NULL where it doesn't occur."""
    groups = {"tcp": _tcp_totals(), "quic": _quic_totals(supported), "udp": _udp_totals(), "dns": _dns_totals()}
    flat = _basics() | _totals() | {k: c for g in groups.values() for k, c in g.items()} | {f"_n_{k}": _n(f"_{k}") for k in groups}
    d = packets.withColumn("flow", flow_key()).groupBy(ID).agg(*(c.alias(k) for k, c in flat.items()))
    d = d.withColumns({c: F.when(F.col(f"_n_{k}") > 0, F.col(c)) for k, g in groups.items() for c in g})
    return d.withColumn("udp_bidirectional_byte_ratio", ratio(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def flows(packets: DataFrame, totals: DataFrame) -> DataFrame:
    """NET-06: flows, the largest one's payload, and how many reach 80 % of the whole payload; flows of QUIC and of other datagrams, and NET-19: QUIC's first round trips."""
    first = [F.min(F.when(F.col("_quic") & (F.col("direction") == s) & F.lower("quic_packet_type").isin("0", "initial"), F.col("timestamp"))) for s in ("rx", "tx")]
    per = packets.where("_ip").withColumn("flow", flow_key()).where("flow is not null").groupBy(ID, "flow").agg(
        F.sum("l4_payload_bytes").alias("payload"), (F.abs(first[0] - first[1]) * 1000).alias("rtt"), F.bool_or("_quic").alias("_of_quic"), F.bool_or("_udp").alias("_of_udp")
    )
    per = per.repartition(ID).join(totals.select(ID, "l4_payload_bytes_total"), ID)
    many = ranked_to_share(per, [ID], "payload", "l4_payload_bytes_total", 0.8)
    return many.groupBy(ID).agg(
        F.count(F.lit(1)).alias("flow_count"), F.max("payload").alias("_largest"), F.coalesce(F.min("_reached"), F.count(F.lit(1))).alias("_needed"), _n("_of_quic").alias("_quic_flows"), _n("_of_udp").alias("_udp_flows"),
        F.avg("rtt").alias("quic_initial_rtt_avg_ms"), nearest_rank("rtt", 50).alias("quic_initial_rtt_p50_ms"), nearest_rank("rtt", 95).alias("quic_initial_rtt_p95_ms"),
    )


def throughput_buckets(packets: DataFrame) -> DataFrame:
    """NET-07: bits of each wall-clock second."""
    per = packets.where("_ip").groupBy(ID, F.floor("timestamp").alias("second")).agg((F.sum("network_bytes") * 8 / 1e6).alias("mbps"))
    return per.groupBy(ID).agg(F.max("mbps").alias("peak_1s_network_throughput_mbps"), nearest_rank("mbps", 95).alias("p95_1s_network_throughput_mbps"))


def _connections(packets: DataFrame) -> DataFrame:
    """TCP packets with their connection: the stream, else the flow; NULL if there is neither."""
    return packets.where("_tcp").withColumn("conn", F.coalesce(F.concat(F.lit("s"), F.col("tcp_stream")), F.concat(F.lit("f"), F.to_json(flow_key()))))


ORDER = ["timestamp", "packet_no"]


def tcp_handshakes(tcp: DataFrame) -> DataFrame:
    """NET-11: connections with SYN, then SYN-ACK back, then ACK. The earliest SYN of each side, and the earliest answer after it, are enough."""
    a, b = (F.struct(F.coalesce(f"{s}_ip", F.lit("")).alias("ip"), F.coalesce(f"{s}_port", F.lit(-1)).alias("port")) for s in ("src", "dst"))
    d = tcp.where("conn is not null and (tcp_syn or tcp_ack)").select(ID, "conn", F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).alias("ends"), (a == F.least(a, b)).alias("side"), F.struct(*ORDER).alias("pos"), "tcp_syn", "tcp_ack")
    w = Window.partitionBy(ID, "conn", "ends")
    first = {s: F.min(F.when((F.col("side") == s) & F.col("tcp_syn") & ~F.col("tcp_ack"), F.col("pos"))).over(w) for s in (True, False)}
    d = d.withColumns({f"syn{s}": c for s, c in first.items()})
    second = {s: F.min(F.when((F.col("side") != s) & F.col("tcp_syn") & F.col("tcp_ack") & (F.col("pos") > F.col(f"syn{s}")), F.col("pos"))).over(w) for s in (True, False)}
    d = d.withColumns({f"answer{s}": c for s, c in second.items()})
    third = [(F.col("side") == s) & ~F.col("tcp_syn") & F.col("tcp_ack") & (F.col("pos") > F.col(f"answer{s}")) for s in (True, False)]
    return d.groupBy(ID, "conn").agg(F.coalesce(F.bool_or(third[0] | third[1]), F.lit(False)).alias("done"))


def tcp_stalls(tcp: DataFrame) -> DataFrame:
    """NET-15: for each connection, how long either side's window was closed, and whether one was still at the end."""
    way = ["src_ip", "src_port", "dst_ip", "dst_port"]
    keyed = tcp.where("conn is not null").withColumn("way", F.to_json(F.struct(*way), {"ignoreNullFields": "false"}))
    closes = ~F.col("tcp_zero_window") & F.coalesce(F.col("tcp_window_size") > 0, F.lit(False))
    found = islands(keyed, [ID, "conn", "way"], ORDER, F.col("tcp_zero_window"), closes, "timestamp")
    ends = keyed.groupBy(ID, "conn").agg(F.max("timestamp").alias("_last"))
    found = found.join(ends, [ID, "conn"]).withColumn("open", F.col("end").isNull()).withColumn("end", F.coalesce("end", "_last"))
    length = union_length(found, [ID, "conn"], "start", "end", "seconds")
    return found.groupBy(ID, "conn").agg(F.bool_or("open").alias("open")).join(length, [ID, "conn"], "left")


def tcp_connections(packets: DataFrame) -> DataFrame:
    """NET-10 to NET-12, NET-15 and NET-16: one row for each capture with TCP connections. All that looks at a connection's packets in order finds them dealt by connection."""
    d = _connections(packets).where("conn is not null").repartition(ID, "conn")
    per = d.groupBy(ID, "conn").agg((F.max("timestamp") - F.min("timestamp")).alias("active"), F.bool_or("tcp_rst").alias("rst"), F.min_by(F.col("tcp_initial_rtt_seconds") * 1000, F.when(F.col("tcp_initial_rtt_seconds").isNotNull(), F.struct(*ORDER))).alias("rtt"))
    per = per.join(tcp_handshakes(d), [ID, "conn"], "left").join(tcp_stalls(d), [ID, "conn"], "left")
    return per.groupBy(ID).agg(
        F.count(F.lit(1)).alias("tcp_connection_count"), _n("done").alias("tcp_successful_handshake_count"), F.avg("rtt").alias("tcp_initial_rtt_avg_ms"), nearest_rank("rtt", 50).alias("tcp_initial_rtt_p50_ms"), nearest_rank("rtt", 95).alias("tcp_initial_rtt_p95_ms"),
        (span_sum(F.coalesce("seconds", F.lit(0.0))) * 1000).alias("tcp_zero_window_duration_ms"), (span_sum("active") * 1000).alias("tcp_active_duration_ms"), _n("rst").alias("tcp_reset_count"), F.coalesce(F.bool_or("open"), F.lit(False)).alias("_open"),
    )


def quic_spins(packets: DataFrame) -> DataFrame:
    """NET-20: the times between flips of the spin bit in each direction of a flow."""
    d = packets.where("_quic").withColumn("flow", flow_key()).where("flow is not null and direction is not null")
    spin = flips(d, [ID, "flow", "direction"], ORDER, "quic_spin_bit", "timestamp", "gap").withColumn("ms", F.col("gap") * 1000)
    return spin.groupBy(ID).agg(F.count(F.lit(1)).alias("_samples"), F.min("ms").alias("quic_spin_rtt_min_ms"), nearest_rank("ms", 50).alias("quic_spin_rtt_p50_ms"), nearest_rank("ms", 95).alias("quic_spin_rtt_p95_ms"))


def _with_protocols(d: DataFrame, supported: frozenset[str]) -> DataFrame:
    """What follows from totals, connections and flows of TCP, QUIC and other datagrams; NULL where they don't occur."""
    has = {k: F.col(f"_n_{k}") > 0 for k in ("tcp", "quic", "udp")}
    d = d.withColumns({c: F.when(has["tcp"], F.coalesce(c, F.lit(0))) for c in ("tcp_connection_count", "tcp_successful_handshake_count", "tcp_reset_count", "tcp_zero_window_duration_ms", "tcp_active_duration_ms")})
    d = d.withColumns({
        "tcp_incomplete_handshake_count": F.col("tcp_connection_count") - F.col("tcp_successful_handshake_count"), "tcp_handshake_success_rate": ratio("tcp_successful_handshake_count", "tcp_connection_count"),
        "tcp_rtt_tail_inflation": F.when(F.col("tcp_ack_rtt_p50_ms") != 0, F.col("tcp_ack_rtt_p95_ms") / F.col("tcp_ack_rtt_p50_ms")), "tcp_retransmission_rate": ratio("tcp_retransmission_count", "tcp_data_segment_count"),
        "tcp_recovery_tax": ratio("tcp_retransmitted_payload_bytes", "_payload"), "tcp_receiver_stall_ratio": ratio("tcp_zero_window_duration_ms", "tcp_active_duration_ms"), "tcp_reset_rate": ratio("tcp_reset_count", "tcp_connection_count"),
        "tcp_rtt_available": F.col("tcp_initial_rtt_avg_ms").isNotNull() | F.col("tcp_ack_rtt_min_ms").isNotNull(), "_open": F.coalesce("_open", F.lit(False)),
    })
    samples = F.when(has["quic"], F.coalesce("_samples", F.lit(0))) if "quic.spin_bit" in supported else F.lit(None).cast("bigint")
    return d.withColumns({
        "quic_identified_connection_count": F.when(has["quic"], F.coalesce("_quic_flows", F.lit(0))), "udp_flow_count": F.when(has["udp"], F.coalesce("_udp_flows", F.lit(0))),
        "quic_spin_rtt_sample_count": samples, "quic_initial_rtt_available": F.col("quic_initial_rtt_avg_ms").isNotNull(), "quic_spin_rtt_available": F.col("_samples").isNotNull(),
    })


def capture_metrics(packets: DataFrame, captures: DataFrame, supported: frozenset[str] = SUPPORTED) -> DataFrame:
    """One row for each capture (capture_id, scenario, transfer_file_size_bytes), also of one without packets."""
    packets = _kinds(packets)
    totals = capture_totals(packets, supported)
    d = captures.select(ID, "scenario", "transfer_file_size_bytes")
    for part in (totals, flows(packets, totals), throughput_buckets(packets), tcp_connections(packets), quic_spins(packets)):
        d = d.join(part, ID, "left")
    d = _with_protocols(d, supported)
    d = d.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("capture_duration_ms", "packet_count", "truncated_packet_count", "icmp_error_count", "network_bytes_total", "l4_payload_bytes_total", "tcp_bytes", "quic_identified_bytes", "other_udp_bytes", "_ipv4", "_ipv6", "_ip_packets", "ip_fragment_count", "ecn_ce_packet_count", "flow_count", "_needed")} | {"direction_metadata_available": F.coalesce("direction_metadata_available", F.lit(False))})
    way = F.col("direction_metadata_available")
    d = d.withColumns({c: F.when(way, F.coalesce(c, F.lit(0))) for s in ("tx", "rx") for c in (f"{s}_network_bytes", f"{s}_l4_payload_bytes", f"{s}_packet_count")} | {"unique_remote_ip_count": F.when(way, F.coalesce("unique_remote_ip_count", F.lit(0)))})
    up = F.col("scenario") == "upload"
    span = F.when(way, F.when(up, F.col("_tx_last") - F.col("_tx_first")).otherwise(F.col("_rx_last") - F.col("_rx_first")) * 1000)
    transport, size = F.col("tcp_bytes") + F.col("quic_identified_bytes") + F.col("other_udp_bytes"), F.col("transfer_file_size_bytes")
    d = d.withColumns({"_span": span, "_primary": F.when(up, F.col("tx_network_bytes")).otherwise(F.col("rx_network_bytes")), "_reverse": F.when(up, F.col("rx_network_bytes")).otherwise(F.col("tx_network_bytes"))})
    d = d.withColumns({
        "ip_transport_header_bytes": F.greatest(F.lit(0), F.col("network_bytes_total") - F.col("l4_payload_bytes_total")), "observed_primary_payload_span_ms": F.when(F.col("_span") > 0, F.col("_span")),
        **{f"{k}_byte_share": ratio(c, transport) for k, c in (("tcp", "tcp_bytes"), ("quic", "quic_identified_bytes"), ("other_udp", "other_udp_bytes"))}, **{f"ipv{v}_byte_share": ratio(f"_ipv{v}", "network_bytes_total") for v in (4, 6)},
        "ip_fragment_rate": ratio("ip_fragment_count", "_ip_packets"), "ecn_ce_packet_rate": ratio("ecn_ce_packet_count", "_ip_packets"), "top_flow_payload_share": ratio("_largest", "l4_payload_bytes_total"),
        "flows_for_80pct_payload": F.when(F.col("l4_payload_bytes_total") > 0, F.col("_needed")).otherwise(0), "connection_churn_per_mib": F.col("flow_count") / (size / MIB),
        "average_network_throughput_mbps": F.when(F.col("capture_duration_ms") > 0, F.col("network_bytes_total") * 8 / (F.col("capture_duration_ms") / 1000) / 1e6), "primary_direction_amplification_ratio": F.col("_primary") / size,
        "total_transfer_amplification_ratio": F.col("network_bytes_total") / size, "reverse_path_cost_ratio": ratio("_reverse", "_primary"), "tcp_present": F.col("tcp_data_segment_count").isNotNull(), "quic_present": F.col("quic_identified_connection_count").isNotNull(),
        "other_udp_present": F.col("udp_datagram_count").isNotNull(), "dns_metrics_available": F.col("dns_query_count").isNotNull(), "handshake_observed": F.coalesce(F.col("tcp_successful_handshake_count") > 0, F.lit(False)),
        **{c: F.coalesce(c, F.lit(False)) for c in ("tcp_rtt_available", "quic_initial_rtt_available", "quic_spin_rtt_available")},
    })
    d = d.withColumns({
        "ip_transport_header_overhead_ratio": ratio("ip_transport_header_bytes", "network_bytes_total"), "effective_file_throughput_mbps": size * 8 / (F.col("observed_primary_payload_span_ms") / 1000) / 1e6,
        "comparison_ready": (F.col("packet_count") > 0) & (F.col("capture_duration_ms") > 0) & (F.col("truncated_packet_count") == 0) & way & F.col("observed_primary_payload_span_ms").isNotNull(),
    })
    codes = [
        (F.col("truncated_packet_count") > 0, "capture_truncated"), (~way, "direction_unavailable"), (F.col("_span").isNull(), "no_primary_payload"), (F.col("_span") <= 0, "zero_transfer_span"), (F.col("_open"), "tcp_zero_window_open_at_capture_end"),
        (F.col("tcp_present") & ~F.col("handshake_observed"), "missing_tcp_handshake"), (F.col("quic_present") & ~F.col("quic_spin_rtt_available"), "quic_spin_unavailable"), (F.col("dns_query_count") != F.col("dns_response_count"), "dns_incomplete"),
    ]
    warned = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(s)) for c, s in codes))))
    d = d.withColumn("analysis_warnings", warned).withColumn("analysis_warning_count", F.size("analysis_warnings"))
    return d.select(*(c for c in d.columns if not c.startswith("_")))
