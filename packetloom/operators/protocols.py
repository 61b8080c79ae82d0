"""Protocol shares, ranks, baselines and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.ports import port_to_application
from packetloom.operators.clean import normalise_protocols
from packetloom.operators.traffic import category_counts

# Transport names looked for when no transport column exists.
TRANSPORTS = ("TCP", "UDP", "ICMP", "ARP")

# Named shares of the protocol report.
NAMED_SHARES = {
    "tcp_pct": ("TCP",), "udp_pct": ("UDP",), "icmp_pct": ("ICMP",), "arp_pct": ("ARP",),
    "http_pct": ("HTTP", "HTTP-ALT"), "https_pct": ("HTTPS", "HTTPS-ALT"), "dns_pct": ("DNS",),
    "ntp_pct": ("NTP",), "malformed_pct": ("MALFORMED",), "unknown_pct": ("UNKNOWN",),
}


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.coalesce(F.when(whole > 0, F.round(part / whole * 100, digits)), F.lit(0.0))


def protocol_distribution(df: DataFrame) -> DataFrame:
    return category_counts(normalise_protocols(df), "protocol")


def transport_distribution(df: DataFrame) -> DataFrame:
    """Counts of the transport column, else of the protocols that name a transport."""
    rows = normalise_protocols(df)
    if "transport_layer" in df.columns:
        return category_counts(rows, "transport_layer")
    return category_counts(rows.filter(F.col("protocol").isin(*TRANSPORTS)), "protocol")


def application_distribution(df: DataFrame) -> DataFrame:
    """Counts of the hint column, else of the destination port's application."""
    rows = normalise_protocols(df)
    hint = F.coalesce(F.col("app_layer_hint"), F.lit("OTHER")) if "app_layer_hint" in df.columns \
        else port_to_application(F.col("dst_port"))
    return category_counts(rows.withColumn("application", hint), "application")


def protocol_totals(df: DataFrame) -> DataFrame:
    """(protocol, packets, bytes) in one aggregate; ``df`` has canonical names."""
    return df.groupBy("protocol").agg(
        F.count(F.lit(1)).alias("packet_count"),
        F.sum(F.col("packet_length").cast("long")).alias("byte_count"),
        F.avg("packet_length").alias("mean_size"))


def protocol_report(df: DataFrame) -> DataFrame:
    """Per protocol: volume, shares, mean size and rank.

    One scan; the windows run on one row per protocol.
    """
    totals = protocol_totals(normalise_protocols(df))
    everything = Window.partitionBy()
    order = Window.orderBy(F.desc("packet_count"), F.asc("protocol"))
    return totals.select(
        "protocol", "packet_count", "byte_count",
        percent(F.col("packet_count"), F.sum("packet_count").over(everything)).alias("percentage"),
        percent(F.col("byte_count"), F.sum("byte_count").over(everything)).alias("byte_percentage"),
        F.round("mean_size", 2).alias("avg_packet_size"),
        F.row_number().over(order).alias("rank"))


def protocol_shares(df: DataFrame) -> DataFrame:
    """One row: totals and the named protocol shares."""
    totals = protocol_totals(normalise_protocols(df))
    whole = F.sum("packet_count")
    return totals.agg(
        whole.alias("total_packets"), F.count("protocol").alias("total_protocols"),
        *[percent(F.sum(F.when(F.col("protocol").isin(*names), F.col("packet_count")).otherwise(0)),
                  whole).alias(column) for column, names in NAMED_SHARES.items()])


def distribution_chart(df: DataFrame, metric: str = "protocol_distribution",
                       n: int | None = None) -> DataFrame:
    source = {"protocol_distribution": protocol_distribution,
              "transport_layer": transport_distribution,
              "application_layer": application_distribution}[metric](df)
    return source if n is None else source.limit(n)


def protocol_profile(df: DataFrame) -> DataFrame:
    """Per raw protocol: packets, bytes, share, mean size, distinct sources and ports.

    The two distinct counts are each taken from rows already reduced to one per
    (protocol, value), so a protocol holding most packets stays spread out.
    """
    rows = df.filter(F.col("protocol").isNotNull())
    base = protocol_totals(rows)
    sources = rows.filter(F.col("src_ip").isNotNull()).groupBy("protocol", "src_ip").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy("protocol").agg(F.count(F.lit(1)).alias("unique_src_ips"))
    ports = rows.filter(F.col("dst_port").isNotNull()).groupBy("protocol", "dst_port").agg(F.count(F.lit(1)).alias("_n")) \
        .groupBy("protocol").agg(F.count(F.lit(1)).alias("unique_dst_ports"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (base.join(sources, "protocol", "left").join(ports, "protocol", "left")
            .crossJoin(F.broadcast(total))
            .select("protocol", "packet_count", "byte_count",
                    percent(F.col("packet_count"), F.col("_total")).alias("percentage"),
                    F.round("mean_size", 2).alias("avg_packet_size"),
                    F.coalesce("unique_src_ips", F.lit(0)).alias("unique_src_ips"),
                    F.coalesce("unique_dst_ports", F.lit(0)).alias("unique_dst_ports")))


def protocol_baseline(df: DataFrame) -> DataFrame:
    """Share of each raw protocol in per cent; write it out to keep it as the baseline."""
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return (df.filter(F.col("protocol").isNotNull()).groupBy("protocol")
            .agg(F.count(F.lit(1)).alias("packets")).crossJoin(F.broadcast(total))
            .select("protocol", percent(F.col("packets"), F.col("_total")).alias("percentage")))


def protocol_drift(current: DataFrame, baseline: DataFrame | None, points: float = 20.0) -> DataFrame:
    """Protocols whose share moved more than ``points`` from the baseline (absent there = 0)."""
    shares = protocol_baseline(current)
    if baseline is None:
        baseline = shares.withColumnRenamed("percentage", "baseline_pct")
        return _drift(shares.join(baseline, "protocol"), points).filter(F.lit(False))
    return _drift(shares.join(baseline.withColumnRenamed("percentage", "baseline_pct"),
                              "protocol", "left"), points)


def _drift(joined: DataFrame, points: float) -> DataFrame:
    before = F.coalesce(F.col("baseline_pct"), F.lit(0.0))
    delta = F.abs(F.col("percentage") - before)
    return joined.filter(delta > points).select(
        "protocol", "percentage", before.alias("baseline_pct"), F.round(delta, 2).alias("delta_pct"),
        F.format_string("share moved from %.1f%% to %.1f%%", before, F.col("percentage")).alias("reason"))
