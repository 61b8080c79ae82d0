"""Half-open connection floods."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, FIN, RST, SYN, has_bit, tolerant_flags
from packetloom.operators.detect import common as c

NAME, PRIORITY = "SYN Flood Detector", 15
MIN_TCP_PACKETS = 5


def window_profile(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per ``keys``: TCP handshake counters, ratios and the top target.

    Durations cover all packets, counters only TCP ones.  Without a flags
    column every TCP packet counts as a SYN.
    """
    tcp = F.upper(F.coalesce("protocol", F.lit(""))) == "TCP" if "protocol" in df.columns else F.lit(True)
    mask = tolerant_flags(F.col("tcp_flags")) if "tcp_flags" in df.columns else F.lit(SYN).cast("long")

    def seen(test):
        return c.number_of(tcp & test)

    df = c.weighted(df)
    by_target = df.groupBy(*keys, "dst_ip").agg(
        F.sum("_packets").alias("packets"), *c.seen(), c.number_of(tcp).alias("tcp"),
        seen(has_bit(mask, SYN)).alias("syn_count"), seen(has_bit(mask, ACK)).alias("ack_count"),
        seen(mask.bitwiseAND(SYN | ACK) == (SYN | ACK)).alias("syn_ack_count"),
        seen(has_bit(mask, RST)).alias("rst_count"), seen(has_bit(mask, FIN)).alias("fin_count"))
    is_target = F.col("dst_ip").isNotNull() & (F.col("tcp") > 0)
    totals = by_target.groupBy(*keys).agg(
        F.sum("packets").alias("total_packets"), F.sum("tcp").alias("total_tcp_packets"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        *[F.sum(n).alias(n) for n in ("syn_count", "ack_count", "syn_ack_count", "rst_count", "fin_count")],
        F.max(F.when(is_target, F.col("tcp"))).alias("top_dst_count"),
        F.min_by("dst_ip", F.when(is_target, F.struct((-F.col("tcp")).alias("o"), F.col("dst_ip").alias("ip")))).alias("top_dst_ip"))
    sources = (df.filter(tcp & F.col("src_ip").isNotNull()).groupBy(*keys, "src_ip").agg(F.count(F.lit(1)).alias("n"))
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("unique_src_ips")))
    joined = totals.join(sources, list(keys), "left") if keys else totals.crossJoin(F.broadcast(sources))
    span = c.duration()
    syn, ack, tcp_total = F.col("syn_count"), F.col("ack_count"), F.col("total_tcp_packets")
    return joined.withColumns({
        "unique_src_ips": F.coalesce("unique_src_ips", F.lit(0)),
        "duration_seconds": span,
        "syn_per_second": c.per_second(syn, span), "ack_per_second": c.per_second(ack, span),
        "syn_ack_ratio": F.coalesce(F.when(syn + ack > 0, syn / (syn + ack)), F.lit(0.0)),
        "syn_fraction_of_tcp": F.coalesce(F.when(tcp_total > 0, syn / tcp_total), F.lit(0.0)),
        "half_open_estimate": F.greatest(F.lit(0), syn - ack),
        "top_dst_fraction": F.round(F.coalesce("top_dst_count", F.lit(0)) / F.greatest(tcp_total, F.lit(1)), 4),
    })


def rules(limits: c.Thresholds) -> list:
    dominance, low_ack = limits.synflood_syn_dominance, limits.synflood_syn_ack_ratio
    rate_limit, open_limit = limits.synflood_syn_per_second, limits.synflood_half_open_limit
    share, ratio = F.col("syn_fraction_of_tcp"), F.col("syn_ack_ratio")
    rate, half_open = F.col("syn_per_second"), F.col("half_open_estimate")
    source = F.when(F.col("unique_src_ips") > 1, "MULTIPLE").otherwise("")
    target = F.coalesce("top_dst_ip", F.lit(""))
    advice = "Turn on SYN cookies and limit new connections per source in front of the target."
    shared = {"syn_count": F.col("syn_count"), "ack_count": F.col("ack_count"), "unique_src_ips": F.col("unique_src_ips")}

    def grade(x):
        return c.graded(x, 3, 2, 1.3)

    enough = F.col("total_tcp_packets") >= MIN_TCP_PACKETS
    return [
        c.rule(enough & (share >= dominance), "SYNFlood-Dominance", grade(share / dominance),
               c.capped(0.97, c.above(0.55, 0.35, F.round(share, 3), dominance)), source, target, advice,
               {"rule": "SYN_DOMINANCE", "syn_fraction_of_tcp": F.round(share, 3), **shared}),
        c.rule(enough & (ratio >= low_ack) & (F.col("syn_count") >= 10), "SYNFlood-LowACK", grade(ratio / low_ack),
               c.bonus(half_open > 100, c.capped(0.98, c.above(0.60, 0.35, F.round(ratio, 3), low_ack)), 0.04), source, target, advice,
               {"rule": "LOW_ACK_RATIO", "syn_ack_ratio": F.round(ratio, 3), "half_open_estimate": half_open, **shared}),
        c.rule(enough & (rate >= rate_limit), "SYNFlood-HighRate", grade(rate / rate_limit),
               c.capped(0.97, c.ramp(0.55, 0.30, F.round(rate, 2) / max(rate_limit, 1), 4)), source, target, advice,
               {"rule": "HIGH_SYN_RATE", "syn_per_second": F.round(rate, 2), "duration_seconds": F.round("duration_seconds", 2), **shared}),
        c.rule(enough & (half_open >= open_limit) & (ratio >= 0.60), "SYNFlood-HalfOpen", grade(half_open / max(open_limit, 1)),
               c.capped(0.95, c.ramp(0.60, 0.25, half_open / max(open_limit, 1), 4)), source, target, advice,
               {"rule": "HALF_OPEN_EXHAUSTION", "half_open_estimate": half_open, "syn_ack_ratio": F.round(ratio, 3), **shared}),
    ]


def detect(df: DataFrame, limits: c.Thresholds = c.Thresholds(), keys: Sequence[str] = ()) -> DataFrame:
    return c.emit(window_profile(df, keys), rules(limits), NAME, PRIORITY, keys)
