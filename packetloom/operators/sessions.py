"""Capture sessions and report records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.traffic import basic_stats, host_cardinality, top_talkers


def session_totals(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """Per capture session: packets, bytes, start, end and alerts."""
    totals = packets.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total_packets"), F.sum(F.col("packet_length").cast("long")).alias("total_bytes"),
        F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    counts = alerts.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    return totals.join(counts, "session_id", "left").select(
        "session_id", "total_packets", "total_bytes", F.coalesce("n", F.lit(0)).alias("total_alerts"), "start_time", "end_time")


def traffic_export(df: DataFrame, n: int = 10) -> DataFrame:
    """(metric, value) text rows: the counters, then one row per top talker."""
    record = basic_stats(df).crossJoin(F.broadcast(host_cardinality(df)))
    names = ["total_packets", "total_bytes", "capture_duration_seconds", "packets_per_second", "bytes_per_second",
             "unique_src_ips", "unique_dst_ips"]
    pairs = ", ".join(f"'{c}', cast({c} AS double)" for c in names)
    rows = record.select(F.expr(f"stack({len(names)}, {pairs}) AS (metric, value)"))
    tops = top_talkers(df, n).select(
        F.concat(F.lit("top_"), F.col("side"), F.lit("_ip:"), F.col("ip")).alias("metric"), F.col("packets").cast("double").alias("value"))
    return rows.unionByName(tops)


def executive_summary(packets: DataFrame, alerts: DataFrame, health: DataFrame) -> DataFrame:
    """One record for management: threat, health, volumes, alert counts."""
    level = F.upper("severity")
    counted = alerts.agg(F.count(F.lit(1)).alias("total_alerts"), *[
        F.count_if(level == s.upper()).alias(f"{s}_alerts") for s in ("critical", "high", "medium", "low")])
    threat = F.when(F.col("critical_alerts") > 0, "CRITICAL").when(F.col("high_alerts") > 0, "HIGH") \
        .when(F.col("total_alerts") > 0, "MEDIUM").otherwise("LOW")
    traffic = basic_stats(packets).select("total_packets", "total_bytes", F.col("capture_duration_seconds").alias("capture_duration_s"))
    return (counted.withColumn("overall_threat_level", threat).crossJoin(F.broadcast(traffic)).crossJoin(F.broadcast(host_cardinality(packets)))
            .crossJoin(F.broadcast(health.select("health_score", "health_status"))))
