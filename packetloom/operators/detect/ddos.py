"""Volumetric floods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, SYN, strict_flags
from packetloom.operators.detect import common as c
from packetloom.operators.selection import cut_at_rank

NAME, PRIORITY = "DDoS Detector", 10


def window_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys`` (or one in all): volume, rates, hosts, top target, protocol and flag counts.

    The first aggregate is per target address, the second folds it, so packets
    aimed at one victim meet only as one partial row per task.  Distinct
    sources are counted the same way.
    """
    mask = strict_flags(F.col("tcp_flags"))
    protocol = F.upper(F.coalesce("protocol", F.lit("")))
    df = c.weighted(df)
    by_target = df.groupBy(*keys, "dst_ip").agg(
        F.sum("_packets").alias("packets"), F.sum("_bytes").alias("bytes"), *c.seen(),
        c.number_of(protocol == "TCP").alias("tcp_count"), c.number_of(protocol == "UDP").alias("udp_count"),
        c.number_of(protocol.startswith("ICMP")).alias("icmp_count"), *c.flag_counts(mask, syn=SYN, ack=ACK))
    # most packets first, the smaller address among equals: a null target never wins
    top = F.max(F.when(F.col("dst_ip").isNotNull(), F.col("packets")))
    totals = by_target.groupBy(*keys).agg(
        F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
        F.min("first_packet").alias("first_packet"),
        F.count("dst_ip").alias("unique_dst_ips"), top.alias("top_dst_count"),
        F.min_by("dst_ip", F.when(F.col("dst_ip").isNotNull(),
                                  F.struct((-F.col("packets")).alias("o"), F.col("dst_ip").alias("ip")))).alias("top_dst_ip"),
        *[F.sum(n).alias(n) for n in ("tcp_count", "udp_count", "icmp_count", "syn_count", "ack_count")])
    sources = (df.filter(F.col("src_ip").isNotNull()).groupBy(*keys, "src_ip").agg(F.count(F.lit(1)).alias("n"))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_src_ips"), F.min("src_ip").alias("only_src_ip")))
    joined = totals.join(sources, list(keys), "left") if keys else totals.crossJoin(F.broadcast(sources))
    span = c.duration()
    return joined.withColumns({
        "unique_src_ips": F.coalesce("unique_src_ips", F.lit(0)),
        "duration_seconds": span,
        "packets_per_second": c.per_second(F.col("total_packets"), span),
        "bytes_per_second": c.per_second(F.col("total_bytes"), span),
        "top_dst_count": F.coalesce("top_dst_count", F.lit(0)),
        "top_dst_fraction": F.round(F.coalesce("top_dst_count", F.lit(0)) / F.greatest(F.col("total_packets"), F.lit(1)), 4),
    })


def growth_rate(df: DataFrame, split: str = "median") -> DataFrame:
    """One row: packets after the split time against packets up to it.

    ``median`` splits at the median packet time, so the result is never
    positive; ``midpoint`` splits half way between first and last packet.  The
    median is found by counting, not by holding all times in one task.
    """
    times = df.select(F.unix_micros("timestamp").alias("t")).filter(F.col("t").isNotNull())
    if split == "midpoint":
        bounds = times.agg(((F.min("t") + F.max("t")) / 2).alias("mid"))
        counted = times.crossJoin(F.broadcast(bounds)).agg(
            F.count_if(F.col("t") <= F.col("mid")).alias("first"), F.count_if(F.col("t") > F.col("mid")).alias("second"))
    else:
        n = times.count()
        # the lower of the two middle values: counting "<=" it equals counting "<=" the median
        cut = cut_at_rank(times, "t", n - (n - 1) // 2) if n > 1 else None
        limit = cut.value if cut else times.agg(F.min("t")).first()[0]
        counted = times.agg(F.count_if(F.col("t") <= F.lit(limit)).alias("first"),
                            F.count_if(F.col("t") > F.lit(limit)).alias("second"))
    return counted.select(F.coalesce(F.when(F.col("first") > 0, F.round(
        (F.col("second") - F.col("first")) / F.col("first"), 4)), F.lit(0.0)).alias("growth_rate"))


def rules(limits: c.Thresholds, growth: bool) -> list:
    pps, bps = F.col("packets_per_second"), F.col("bytes_per_second")
    pps_limit, bps_limit = limits.ddos_packets_per_second, limits.ddos_bytes_per_second
    many = F.col("unique_src_ips") > 10
    source = F.when(F.col("unique_src_ips") > 1, "MULTIPLE").otherwise(F.coalesce("only_src_ip", F.lit("UNKNOWN")))
    target = F.coalesce("top_dst_ip", F.lit("MULTIPLE"))
    shown_pps, shown_bps = F.round(pps, 2), F.round(bps, 2)
    total = F.greatest(F.col("total_packets"), F.lit(1))
    udp, icmp = F.col("udp_count") / total, F.col("icmp_count") / total
    share = F.greatest(udp, icmp)
    flood = F.when(udp >= icmp, "UDP").otherwise("ICMP")
    fraction = F.col("top_dst_fraction")
    out = [
        c.rule(pps > pps_limit, "DDoS-VolumeFlood", c.graded(pps / pps_limit, 5, 2, 1.5),
               c.bonus(many, c.capped(0.95, c.ramp(0.50, 0.30, shown_pps / max(pps_limit, 1), 2)), 0.05),
               source, target, "Rate-limit at the edge and move the target behind a scrubbing service.",
               {"rule": "PPS_FLOOD", "packets_per_second": shown_pps, "threshold": F.lit(pps_limit),
                "total_packets": F.col("total_packets"), "unique_src_ips": F.col("unique_src_ips")}),
        c.rule(bps > bps_limit, "DDoS-BandwidthFlood", c.graded(bps / bps_limit, 5, 2, 1.5),
               c.capped(0.95, c.ramp(0.50, 0.30, shown_bps / max(bps_limit, 1), 2)),
               source, target, "Rate-limit at the edge and ask the upstream provider to filter.",
               {"rule": "BPS_FLOOD", "bytes_per_second": shown_bps, "threshold": F.lit(bps_limit),
                "total_bytes": F.col("total_bytes"), "mbps": F.round(bps * 8 / 1e6, 2)}),
        c.rule((F.col("unique_src_ips") >= limits.ddos_unique_src_ips) & (fraction >= 0.70), "DDoS-Distributed", "HIGH",
               c.bonus(many, c.capped(0.98, F.lit(0.60) + 0.15 * F.least(F.col("unique_src_ips") / max(limits.ddos_unique_src_ips, 1), F.lit(3.0))
                                      + 0.15 * F.round(fraction, 3)), 0.05),
               F.lit("MULTIPLE"), F.col("top_dst_ip"), "Ask the upstream provider to null-route the target; filter known bad sources.",
               {"rule": "DISTRIBUTED_ATTACK", "unique_src_ips": F.col("unique_src_ips"),
                "target_traffic_fraction": F.round(fraction, 3), "packets_to_target": F.col("top_dst_count")}),
        c.rule((share >= 0.75) & (pps >= pps_limit * 0.30), F.concat(F.lit("DDoS-"), flood, F.lit("Flood")), "HIGH",
               c.capped(0.92, F.lit(0.55) + 0.35 * F.round(share, 3)),
               source, target, F.concat(F.lit("Limit inbound "), flood, F.lit(" and drop spoofed sources.")),
               {"rule": "PROTOCOL_FLOOD", "dominant_protocol": flood, "protocol_fraction": F.round(share, 3),
                "packets_per_second": shown_pps}),
    ]
    if growth:
        rate = F.col("growth_rate")
        out.append(c.rule(
            (rate > 2.0) & (pps > pps_limit * 0.5), "DDoS-RapidGrowth", "MEDIUM",
            c.bonus(many, c.capped(0.90, F.lit(0.55) + 0.10 * F.least(F.round(rate, 3), F.lit(5.0))), 0.05),
            source, target, "Switch mitigation on before the link fills; warn the provider.",
            {"rule": "RAPID_GROWTH", "growth_rate": F.round(rate, 3), "packets_per_second": shown_pps}))
    return out


def detect(df: DataFrame, limits: c.Thresholds = c.Thresholds(), keys: Sequence[str] = (), packets: DataFrame | None = None) -> DataFrame:
    """Alert rows; the growth rule is evaluated only when it can fire (``midpoint`` split).

    It needs the times of single packets: where ``df`` is folded, those of ``packets``.
    """
    profile = window_profile(df, keys)
    growth = limits.ddos_growth == "midpoint" and not keys
    if growth:
        profile = profile.crossJoin(F.broadcast(growth_rate(df if packets is None else packets, "midpoint")))
    return c.emit(profile.filter(F.col("total_packets") > 0), rules(limits, growth), NAME, PRIORITY, keys)
