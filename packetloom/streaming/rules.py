"""The detectors per event-time window.

A window's profile is built in two stateful steps: packets are folded per
(window, host) or (window, source, port), and those rows per window or source.
State then grows with distinct hosts and ports, not with packets, distinct
counts are exact, and no set of hosts is ever held in one row.  A window is
judged once, when the watermark passes its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, FIN, RST, SYN, has_bit, strict_flags, tolerant_flags
from packetloom.functions.ports import port_to_service
from packetloom.operators.detect import bruteforce, ddos, portscan, synflood
from packetloom.operators.detect import common as c

KEYS = ["window_start"]


def _windowed(packets: DataFrame, delay: str) -> DataFrame:
    return packets.withWatermark("timestamp", delay)


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window.start")).drop("window")


def _per_host(packets: DataFrame, window: str, delay: str, mask, extra: list) -> DataFrame:
    """First step: one row per (window, side, address); sums are carried by the target side."""
    sides = _windowed(packets, delay).withColumn("_m", mask).select(
        "timestamp", "protocol", "packet_length", "packet_number", "_m",
        F.inline(F.array(F.struct(F.lit("src").alias("side"), F.col("src_ip").alias("ip")),
                         F.struct(F.lit("dst").alias("side"), F.col("dst_ip").alias("ip")))))
    return sides.groupBy(F.window("timestamp", window), "side", "ip").agg(
        F.count(F.lit(1)).alias("packets"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min("packet_number").alias("first_packet"), *extra)


def _fold(hosts: DataFrame, weight: str, sums: list[str]) -> DataFrame:
    """Second step: one row per window."""
    target = (F.col("side") == "dst") & F.col("ip").isNotNull() & (F.col(weight) > 0)
    source = (F.col("side") == "src") & F.col("ip").isNotNull() & (F.col(weight) > 0)

    def of_targets(name: str):
        return F.sum(F.when(F.col("side") == "dst", F.col(name)).otherwise(0)).alias(name)

    # the window of a window: chained aggregates group by the first step's window column
    return _flat(hosts.groupBy("window").agg(
        F.sum(F.when(F.col("side") == "dst", F.col("packets")).otherwise(0)).alias("total_packets"), *[of_targets(n) for n in sums],
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        F.count_if(source).alias("unique_src_ips"), F.min(F.when(source, F.col("ip"))).alias("only_src_ip"),
        F.coalesce(F.max(F.when(target, F.col(weight))), F.lit(0)).alias("top_dst_count"),
        F.min_by("ip", F.when(target, F.struct((-F.col(weight)).alias("o"), F.col("ip").alias("i")))).alias("top_dst_ip")))


def ddos_alerts(packets: DataFrame, limits: c.Thresholds = c.Thresholds(), window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    protocol = F.upper(F.coalesce("protocol", F.lit("")))
    hosts = _per_host(packets, window, delay, strict_flags(F.col("tcp_flags")), [
        F.sum(F.coalesce("packet_length", F.lit(0)).cast("long")).alias("total_bytes"),
        F.count_if(protocol == "UDP").alias("udp_count"), F.count_if(protocol.startswith("ICMP")).alias("icmp_count")])
    span = c.duration()
    profile = _fold(hosts, "packets", ["total_bytes", "udp_count", "icmp_count"]).withColumns({
        "packets_per_second": c.per_second(F.col("total_packets"), span), "bytes_per_second": c.per_second(F.col("total_bytes"), span),
        "top_dst_fraction": F.round(F.col("top_dst_count") / F.greatest(F.col("total_packets"), F.lit(1)), 4)})
    return c.emit(profile, ddos.rules(limits, growth=False), ddos.NAME, ddos.PRIORITY, KEYS)


def synflood_alerts(packets: DataFrame, limits: c.Thresholds = c.Thresholds(), window: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    tcp = F.upper(F.coalesce("protocol", F.lit(""))) == "TCP"
    hosts = _per_host(packets, window, delay, tolerant_flags(F.col("tcp_flags")), [
        F.count_if(tcp).alias("total_tcp_packets"), F.count_if(tcp & has_bit(F.col("_m"), SYN)).alias("syn_count"),
        F.count_if(tcp & has_bit(F.col("_m"), ACK)).alias("ack_count")])
    span, syn, ack = c.duration(), F.col("syn_count"), F.col("ack_count")
    profile = _fold(hosts, "total_tcp_packets", ["total_tcp_packets", "syn_count", "ack_count"]).withColumns({
        "duration_seconds": span, "syn_per_second": c.per_second(syn, span),
        "syn_ack_ratio": F.coalesce(F.when(syn + ack > 0, syn / (syn + ack)), F.lit(0.0)),
        "syn_fraction_of_tcp": F.coalesce(F.when(F.col("total_tcp_packets") > 0, syn / F.col("total_tcp_packets")), F.lit(0.0)),
        "half_open_estimate": F.greatest(F.lit(0), syn - ack)})
    return c.emit(profile, synflood.rules(limits), synflood.NAME, synflood.PRIORITY, KEYS)


def portscan_alerts(packets: DataFrame, limits: c.Thresholds = c.Thresholds(), window: str = "60 seconds",
                    slide: str | None = None, delay: str = "60 seconds") -> DataFrame:
    rows = _windowed(packets, delay).filter(F.col("src_ip").isNotNull()).withColumn("_m", strict_flags(F.col("tcp_flags")))
    parts = rows.select(
        "timestamp", "src_ip", "packet_length", "packet_number", "_m",
        F.inline(F.array(F.struct(F.col("dst_port").alias("port"), F.lit(None).cast("string").alias("host"), F.lit(True).alias("is_port")),
                         F.struct(F.lit(None).cast("int").alias("port"), F.col("dst_ip").alias("host"), F.lit(False).alias("is_port")))))
    flags = {"syn_count": SYN, "ack_count": ACK, "rst_count": RST, "fin_count": FIN}
    cells = parts.groupBy(F.window("timestamp", window, slide or window), "src_ip", "port", "host", "is_port").agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.coalesce("packet_length", F.lit(0)).cast("long")).alias("bytes"),
        F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min("packet_number").alias("first_packet"),
        *[F.count_if(has_bit(F.col("_m"), bit)).alias(n) for n, bit in flags.items()])

    def of_ports(name: str):
        return F.sum(F.when(F.col("is_port"), F.col(name)).otherwise(0))

    # at most 65 536 ports per source; hosts are counted
    sources = _flat(cells.groupBy("window", "src_ip").agg(
        of_ports("packets").alias("total_packets"), of_ports("bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        *[of_ports(n).alias(n) for n in flags], F.sort_array(F.collect_list("port")).alias("ports"),
        F.count("host").alias("unique_hosts"), F.coalesce(F.min("host"), F.lit("UNKNOWN")).alias("primary_target")))
    span, n_ports = c.duration(), F.size("ports")
    profile = sources.withColumns({
        "unique_ports": n_ports, "avg_packet_size": F.col("total_bytes") / F.col("total_packets"), "duration_seconds": span,
        "ports_per_second": c.per_second(n_ports, span), "scan_pattern": portscan.scan_pattern(F.col("ports"))})
    return c.emit(profile, portscan.rules(limits), portscan.NAME, portscan.PRIORITY, KEYS)


def bruteforce_alerts(packets: DataFrame, limits: c.Thresholds = c.Thresholds(), window: str = "60 seconds",
                      slide: str | None = None, delay: str = "60 seconds") -> DataFrame:
    """Per service target; see :func:`spray_alerts` for the rule over many targets."""
    return c.emit(_services(packets, limits, window, slide, delay).filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()),
                  bruteforce.service_rules(limits), bruteforce.NAME, bruteforce.PRIORITY, KEYS)


def spray_alerts(packets: DataFrame, limits: c.Thresholds = c.Thresholds(), window: str = "60 seconds",
                 slide: str | None = None, delay: str = "60 seconds") -> DataFrame:
    services = _services(packets, limits, window, slide, delay, flat=False).filter(F.col("src_ip").isNotNull())
    profile = _flat(services.groupBy("window", "src_ip").agg(
        F.sum("attempts").alias("total_attempts"), F.count("dst_ip").alias("unique_targets"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        F.slice(F.sort_array(F.collect_set("service")), 1, 10).alias("services")))
    return c.emit(profile, bruteforce.spray_rules(limits), bruteforce.NAME, bruteforce.PRIORITY, KEYS)


def _services(packets: DataFrame, limits: c.Thresholds, window: str, slide: str | None, delay: str, flat: bool = True) -> DataFrame:
    auth = bruteforce.auth_traffic(_windowed(packets, delay), limits.bruteforce_extra_ports)
    rows = auth.groupBy(F.window("timestamp", window, slide or window), "src_ip", "dst_ip", "dst_port").agg(
        F.count(F.lit(1)).alias("attempts"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"),
        F.min("packet_number").alias("first_packet"))
    span = c.duration()
    rows = rows.withColumns({"duration_seconds": span, "attempts_per_second": c.per_second(F.col("attempts"), span),
                             "service": port_to_service(F.col("dst_port"))})
    return _flat(rows) if flat else rows
