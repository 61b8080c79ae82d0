"""Port scans and host sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, FIN, RST, SYN, strict_flags
from packetloom.operators.detect import common as c

NAME, PRIORITY = "Port Scan Detector", 20
MIN_PACKETS = 3


def source_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per source (and ``keys``): ports, hosts, sizes, times and flags.

    Packets are first folded to one row per (source, port) and per (source,
    host).  A source sending a third of all packets then brings at most 65 536
    port rows to its final aggregate, and its hosts are counted, not collected.
    """
    group = [*keys, "src_ip"]
    rows = c.weighted(df).filter(F.col("src_ip").isNotNull())
    mask = strict_flags(F.col("tcp_flags"))
    flags = ("syn_count", "ack_count", "rst_count", "fin_count")
    by_port = rows.groupBy(*group, "dst_port").agg(
        F.sum("_packets").alias("packets"), F.sum("_bytes").alias("bytes"), *c.seen(), *c.flag_counts(mask, syn=SYN, ack=ACK, rst=RST, fin=FIN))
    ports = by_port.groupBy(*group).agg(
        F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        *[F.sum(n).alias(n) for n in flags],
        F.sort_array(F.collect_list("dst_port")).alias("ports"))
    hosts = (rows.filter(F.col("dst_ip").isNotNull()).groupBy(*group, "dst_ip").agg(F.count(F.lit(1)).alias("n"))
             .groupBy(*group).agg(F.count(F.lit(1)).alias("unique_hosts"), F.min("dst_ip").alias("primary_target")))
    span = c.duration()
    n_ports = F.size("ports")
    return ports.join(hosts, group, "left").withColumns({
        "unique_ports": n_ports, "unique_hosts": F.coalesce("unique_hosts", F.lit(0)),
        "primary_target": F.coalesce("primary_target", F.lit("UNKNOWN")),
        "avg_packet_size": F.col("total_bytes") / F.col("total_packets"),
        "duration_seconds": span, "ports_per_second": c.per_second(n_ports, span),
        "scan_pattern": scan_pattern(F.col("ports"))})


def scan_pattern(ports: Column) -> Column:
    """SEQUENTIAL when the gaps between sorted ports vary little, else RANDOM; HORIZONTAL under 3 ports.

    Gaps are integers, so their sums are exact; the variance is the population one.
    """
    gaps = F.zip_with(F.slice(ports, 2, F.greatest(F.size(ports) - 1, F.lit(1))),
                      F.slice(ports, 1, F.greatest(F.size(ports) - 1, F.lit(1))),
                      lambda later, earlier: (later - earlier).cast("long"))
    sums = F.aggregate(gaps, F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q")),
                       lambda acc, g: F.struct((acc["s"] + g).alias("s"), (acc["q"] + g * g).alias("q")))
    n = F.size(ports) - 1
    variance = sums["q"] / n - (sums["s"] / n) * (sums["s"] / n)
    return F.when(F.size(ports) < 3, "HORIZONTAL").when(variance < 100, "SEQUENTIAL").otherwise("RANDOM")


def rules(limits: c.Thresholds) -> list:
    limit, syn_limit = limits.portscan_unique_ports, limits.portscan_syn_ratio
    ports, hosts = F.col("unique_ports"), F.col("unique_hosts")
    syn, ack, rst = F.col("syn_count"), F.col("ack_count"), F.col("rst_count")
    enough = F.col("total_packets") >= MIN_PACKETS
    many_ports = enough & (ports >= limit)
    ratio = syn / F.greatest(syn + ack, F.lit(1))
    scan = c.capped(0.97, c.ramp(0.55, 0.25, ports / max(limit, 1), 4))
    scan = c.bonus(F.round("avg_packet_size", 1) < 80, scan, 0.05)
    scan = c.bonus(rst / F.greatest(syn, F.lit(1)) > 0.5, scan, 0.04)

    def grade(x):
        return c.graded(x, 5, 3, 1.5)

    src, target = F.col("src_ip"), F.col("primary_target")
    return [
        c.rule(many_ports, "PortScan-Horizontal", grade(ports / limit), scan, src, target,
               "Block the source and check the probed services.",
               {"rule": "HORIZONTAL_SCAN", "scan_type": F.col("scan_pattern"), "unique_ports_probed": ports, "target_hosts": hosts,
                "avg_packet_size": F.round("avg_packet_size", 1), "ports_per_second": F.round("ports_per_second", 2),
                "sampled_ports": F.array_join(F.slice("ports", 1, 20).cast("array<string>"), ",")}),
        c.rule(enough & (ports < limit) & (hosts >= limit) & (ports <= 5), "PortScan-Vertical", grade(hosts / limit),
               c.capped(0.95, c.ramp(0.55, 0.25, hosts / max(limit, 1), 4)), src, F.lit("MULTIPLE"),
               "Isolate the source and look for worm-like spread.",
               {"rule": "VERTICAL_SCAN", "unique_hosts_probed": hosts, "syn_count": syn, "ack_count": ack,
                "probed_ports": F.array_join(F.slice("ports", 1, 5).cast("array<string>"), ",")}),
        c.rule(enough & (syn + ack >= 5) & (ratio >= syn_limit) & (ports >= max(5, limit // 4)), "PortScan-SYNStealth", "HIGH",
               c.capped(0.98, c.above(0.65, 0.30, F.round(ratio, 3), syn_limit)), src, target,
               "Drop half-open probes from the source and review firewall logs.",
               {"rule": "SYN_STEALTH", "syn_count": syn, "ack_count": ack, "rst_count": rst, "syn_ratio": F.round(ratio, 3),
                "unique_ports_probed": ports}),
    ]


def detect(df: DataFrame, limits: c.Thresholds = c.Thresholds(), keys: Sequence[str] = ()) -> DataFrame:
    return c.emit(source_profile(df, keys), rules(limits), NAME, PRIORITY, keys)
