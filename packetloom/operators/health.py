"""Network health score from the one-row metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.operators.profile import positions

EPS = 1e-9

# Score bands, best first.
STATUS_BANDS = ((90.0, "Excellent"), (75.0, "Good"), (55.0, "Moderate"), (35.0, "Poor"))
ADVICE = {
    "Bandwidth Utilisation": "Add link capacity or shape traffic.",
    "Packet Rate": "Find the busiest sources and limit or spread their load.",
    "Malformed Packets": "Check interfaces, cables and drivers for faults.",
    "Protocol Diversity": "Review which protocols should be on this network.",
    "Host Concentration": "Look into the busiest host.",
    "Traffic Stability": "Find bursty applications and smooth them.",
}
BAD = ("WARN", "HIGH", "CRITICAL")


@dataclass(frozen=True)
class HealthLimits:
    link_bits_per_second: float = 1e9
    bandwidth: tuple[float, float, float] = (0.60, 0.80, 0.95)
    packet_rate: tuple[float, float, float] = (50_000.0, 100_000.0, 500_000.0)
    malformed: tuple[float, float, float] = (0.05, 0.15, 0.30)
    diversity: tuple[float, float] = (1.0, 2.5)
    concentration: tuple[float, float] = (0.60, 0.85)
    stability: tuple[float, float] = (1.5, 3.0)
    # weights in component order
    weights: tuple[float, ...] = (0.25, 0.15, 0.20, 0.15, 0.10, 0.15)


def between(x: Column, low: float, high: float) -> Column:
    """Position of ``x`` between two limits, 0 to 1."""
    return (x - low) / (high - low + EPS)


def clamp(x: Column) -> Column:
    return F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), x)), 2)


def _easy(x: Column, limit: float) -> Column:
    return 80 + 20 * (1 - x / (limit + EPS))


def components(metrics: DataFrame, limits: HealthLimits = HealthLimits()) -> DataFrame:
    """Six rows: component, score, weight, metric_value, threshold, status."""
    use = F.col("avg_bytes_per_second") / F.lit(limits.link_bits_per_second / 8)
    pps = F.col("avg_packets_per_second")
    bad = F.col("malformed_pct") / 100
    entropy = F.coalesce("protocol_entropy", F.lit(0.0))
    top = F.col("top_src_count") / F.greatest(F.col("total_packets"), F.lit(1))
    cv = F.col("minute_cv")

    def three(x, bounds, warn_base, warn_gain, high_gain, worst):
        warn, high, crit = bounds
        score = F.when(x >= crit, worst).when(x >= high, high_gain * (1 - between(x, high, crit))) \
            .when(x >= warn, warn_base + warn_gain * (1 - between(x, warn, high))).otherwise(_easy(x, warn))
        status = F.when(x >= crit, "CRITICAL").when(x >= high, "HIGH").when(x >= warn, "WARN").otherwise("OK")
        return clamp(score), status

    def two(x, bounds):
        warn, crit = bounds
        score = F.when(x >= crit, 10.0).when(x >= warn, 40 * (1 - between(x, warn, crit))).otherwise(_easy(x, warn))
        status = F.when(x >= crit, "CRITICAL").when(x >= warn, "WARN").otherwise("OK")
        return clamp(score), status

    low, best = limits.diversity
    mixed = F.round(F.when(entropy >= best, 95.0).when(entropy >= low, 50 + 45 * between(entropy, low, best))
                    .otherwise(F.greatest(F.lit(10.0), 50 * entropy / (low + EPS))), 2)
    steady, steady_status = two(cv, limits.stability)
    short = F.col("minute_count") < 2
    parts = [
        ("Bandwidth Utilisation", *three(use, limits.bandwidth, 40, 40, 40, 10.0), F.round(use * 100, 4), limits.bandwidth[0] * 100),
        ("Packet Rate", *three(pps, limits.packet_rate, 60, 20, 40, 10.0), F.round(pps, 2), limits.packet_rate[0]),
        ("Malformed Packets", *three(bad, limits.malformed, 55, 25, 20, 5.0), F.round("malformed_pct", 4), limits.malformed[0] * 100),
        ("Protocol Diversity", mixed, F.when(entropy >= low, "OK").otherwise("WARN"), F.round(entropy, 4), low),
        ("Host Concentration", *two(top, limits.concentration), F.round(top * 100, 4), limits.concentration[0] * 100),
        ("Traffic Stability", F.when(short, 70.0).otherwise(steady), F.when(short, "OK").otherwise(steady_status),
         F.when(short, 0.0).otherwise(F.round(cv, 4)), limits.stability[0]),
    ]
    rows = F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(name).alias("component"), score.alias("score"), F.lit(weight).alias("weight"),
        metric.alias("metric_value"), F.lit(float(limit)).alias("threshold"), status.alias("status"))
        for i, ((name, score, status, metric, limit), weight) in enumerate(zip(parts, limits.weights))])
    return metrics.select(F.explode(rows).alias("c")).select("c.*")


def status_of(score: Column) -> Column:
    label = F.lit("Critical")
    for least, name in reversed(STATUS_BANDS):
        label = F.when(score >= least, name).otherwise(label)
    return label


def stability_label(cv: Column) -> Column:
    return F.when(cv >= 3.0, "Highly Unstable").when(cv >= 1.5, "Unstable") \
        .when(cv >= 0.5, "Moderate").otherwise("Stable")


def growth_rate(per_second: DataFrame) -> DataFrame:
    """One row: packets of the later half of the non-empty seconds against the earlier half."""
    rows = positions(per_second)
    early = F.col("pos") <= F.floor(F.col("n") / 2)
    first = F.coalesce(F.sum(F.when(early, F.col("packets"))), F.lit(0))
    second = F.coalesce(F.sum(F.when(~early, F.col("packets"))), F.lit(0))
    return rows.agg(F.when((F.count(F.lit(1)) < 2) | (first == 0), F.lit(0.0)).otherwise(
        F.round((second - first) / first, 4)).alias("packet_growth_rate"))


def health_report(metrics: DataFrame, per_second: DataFrame, limits: HealthLimits = HealthLimits()) -> DataFrame:
    """One row: score, status and the figures behind it."""
    parts = components(metrics, limits)
    score = parts.agg(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.sum(F.col("score") * F.col("weight")))).alias("raw"),
        F.max(F.when(F.col("component") == "Traffic Stability", F.col("metric_value"))).alias("cv"),
        F.count_if(F.col("status").isin(*BAD)).alias("issue_count"))
    use = F.col("avg_bytes_per_second") / F.lit(limits.link_bits_per_second / 8) * 100
    return metrics.crossJoin(F.broadcast(score)).crossJoin(F.broadcast(growth_rate(per_second))).select(
        F.round("raw", 2).alias("health_score"), status_of(F.col("raw")).alias("health_status"),
        F.round(F.least(use, F.lit(100.0)), 4).alias("bandwidth_utilisation_pct"),
        "avg_packets_per_second", "avg_bytes_per_second", "avg_packet_size", "malformed_pct",
        F.round("protocol_entropy", 4).alias("protocol_diversity_entropy"),
        F.col("unique_src_ips").alias("unique_hosts"), stability_label(F.col("cv")).alias("traffic_stability"),
        "packet_growth_rate", "issue_count", F.col("capture_end").alias("computed_for"))


def component_table(parts: DataFrame) -> DataFrame:
    return parts.select("component", F.round("score", 1).alias("score"), "status", "weight",
                        F.round("metric_value", 4).alias("metric_value"))


def issues(parts: DataFrame) -> DataFrame:
    """One row per component that is not OK, with what to do about it."""
    advice = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return parts.filter(F.col("status").isin(*BAD)).select(
        "component", "status",
        F.concat(F.lit("["), F.col("status"), F.lit("] "), F.col("component"),
                 F.format_string(": %.2f", F.col("metric_value"))).alias("message"),
        F.element_at(advice, F.col("component")).alias("recommendation"))


def health_alert(report: DataFrame) -> DataFrame:
    """Alert row when the status is Moderate or worse."""
    status = F.col("health_status")
    return report.filter(~status.isin("Excellent", "Good")).select(
        F.lit("NetworkHealth").alias("attack_type"),
        F.when(status == "Moderate", "LOW").when(status == "Poor", "HIGH")
        .when(status == "Critical", "CRITICAL").otherwise("MEDIUM").alias("severity"),
        F.lit("N/A").alias("source_ip"), F.lit("N/A").alias("destination_ip"),
        F.col("computed_for").alias("timestamp"),
        F.concat(F.format_string("Health score %.1f is ", F.col("health_score")), status).alias("description"))
