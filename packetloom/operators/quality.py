"""Network quality index from the one-row metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.health import EPS, between, clamp

LEVELS = ((90.0, "Excellent"), (75.0, "Good"), (55.0, "Fair"))


@dataclass(frozen=True)
class QualityLimits:
    link_bits_per_second: float = 1e9
    ttl_std: tuple[float, float] = (20.0, 60.0)
    busy_link: float = 0.50
    # weights in dimension order
    weights: tuple[float, ...] = (0.20, 0.25, 0.25, 0.15, 0.15)


def level(score: Column) -> Column:
    label = F.lit("Poor")
    for least, name in reversed(LEVELS):
        label = F.when(score >= least, name).otherwise(label)
    return label


def dimensions(metrics: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """Five rows: dimension, score, weight, proxy_metric, proxy_value, quality."""
    warn, crit = limits.ttl_std
    std, size = F.col("ttl_std"), F.col("mean_length")
    by_ttl = F.when(std >= crit, 20.0).when(std >= warn, 60 - 40 * between(std, warn, crit)) \
        .otherwise(F.least(F.lit(100.0), 80 + 20 * (1 - std / (warn + EPS))))
    ttl_level = F.when(std >= crit, "Poor").when(std >= warn, "Fair").when(by_ttl < 90, "Good").otherwise("Excellent")
    by_size = F.when(size > 1200, 50.0).when(size > 800, 70.0).otherwise(85.0)
    has_ttl = F.col("ttl_count") >= 2

    use = F.col("avg_bytes_per_second") / F.lit(limits.link_bits_per_second / 8)
    burst = F.least(F.lit(20.0), F.when(F.col("avg_bytes_per_second") > 0,
                                        F.col("peak_bytes_per_second") / F.col("avg_bytes_per_second")).otherwise(1.0))
    busy = limits.busy_link
    use_score = F.when(use >= 0.90, 5.0).when(use >= busy, 60 * (1 - between(use, busy, 0.90))) \
        .otherwise(F.least(F.lit(100.0), 100 * (1 - use / (busy + EPS)) + 40))
    congestion = 0.6 * use_score + 0.4 * F.greatest(F.lit(10.0), 100 - (burst - 1) * 10)

    intact = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (1 - F.col("malformed_pct") / 100 * 5)))
    size_cv = F.coalesce(F.when(F.col("avg_packet_size") > 0, F.col("std_packet_size") / F.col("avg_packet_size")), F.lit(0.0))
    delivery = 0.6 * intact + 0.4 * F.least(F.lit(100.0), F.greatest(F.lit(10.0), 100 - size_cv * 30))

    src, dst = (F.greatest(F.col(c), F.lit(1)) for c in ("unique_src_ips", "unique_dst_ips"))
    symmetry = F.least(src, dst) / F.greatest(src, dst)
    most = F.log2(F.greatest(F.col("protocol_count"), F.lit(1)).cast("double"))
    spread = F.coalesce(F.when(most > 0, F.col("protocol_entropy") / most), F.lit(0.0))
    balance = 0.5 * (50 + 50 * symmetry) + 0.5 * (40 + 60 * spread)

    cv, short = F.col("minute_cv"), F.col("minute_count") < 2
    steady = F.when(short, 70.0).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(10.0), 100 - cv * 25)))
    parts = [
        ("Estimated Latency Score", F.when(has_ttl, by_ttl).otherwise(by_size),
         F.when(has_ttl, "ttl_standard_deviation").otherwise("avg_packet_size_fallback"),
         F.when(has_ttl, F.round(std, 4)).otherwise(F.round(size, 2)),
         F.when(has_ttl, ttl_level).otherwise(F.when(size > 1200, "Fair").otherwise("Good"))),
        ("Estimated Congestion Score", congestion, F.lit("bw_util_and_burst_ratio"), F.round(use * 100, 4), level(congestion)),
        ("Packet Delivery Efficiency", delivery, F.lit("malformed_pct_and_size_cv"), F.round("malformed_pct", 4), level(delivery)),
        ("Traffic Balance Score", balance, F.lit("ip_symmetry_and_protocol_entropy"), F.round(symmetry, 4), level(balance)),
        ("Network Stability Score", steady, F.lit("per_minute_bytes_cv"), F.when(short, 0.0).otherwise(F.round(cv, 4)),
         F.when(short, "Good").otherwise(level(steady))),
    ]
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("dimension"), clamp(score).alias("score"), F.lit(weight).alias("weight"),
        metric.alias("proxy_metric"), value.alias("proxy_value"), quality.alias("quality"))
        for i, ((name, score, metric, value, quality), weight) in enumerate(zip(parts, limits.weights))])
    return metrics.select(F.explode(rows).alias("d")).select("d.*")


def quality_report(metrics: DataFrame, limits: QualityLimits = QualityLimits()) -> DataFrame:
    """One row: the index, its level and how many dimensions fall short."""
    index = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum(F.col("score") * F.col("weight"))))
    return dimensions(metrics, limits).agg(
        F.round(index, 2).alias("quality_index"), level(index).alias("quality_level"),
        F.count_if(F.col("quality").isin("Fair", "Poor")).alias("note_count"))


def notes(parts: DataFrame) -> DataFrame:
    """Text for every dimension that is Fair or Poor."""
    return parts.filter(F.col("quality").isin("Fair", "Poor")).select(
        "dimension", "quality", F.concat(F.col("dimension"), F.lit(" is "), F.col("quality"),
                                         F.format_string(" (score=%.0f)", F.col("score"))).alias("note"))
