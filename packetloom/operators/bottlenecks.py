"""Bottleneck checks: each gives zero or more event rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.alerts import literal_rows, severity_rank
from packetloom.operators.profile import NetworkProfile, positions
from packetloom.operators.selection import exact_quantiles
from packetloom.schemas import SEVERITIES


@dataclass(frozen=True)
class BottleneckLimits:
    link_bits_per_second: float = 1e9
    bandwidth: tuple[float, float] = (0.60, 0.90)
    packet_rate: tuple[float, float] = (50_000.0, 500_000.0)
    z_score: float = 3.0
    spike_iqr: float = 1.5
    dominance: float = 0.80
    concentration: float = 0.70
    size_iqr: float = 3.0
    growth_window: int = 3


def _event(when: Column, check: str, severity: Column | str, metric: Column | str, value: Column, threshold: Column,
           description: Column, advice: str, host: Column | None = None) -> Column:
    """One candidate event: a struct when the test holds, else null."""
    def text(x):
        return F.lit(x) if isinstance(x, str) else x
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(check).alias("check_name"), text(severity).alias("severity"), description.alias("description"),
        F.lit(advice).alias("recommendation"), text(metric).alias("metric_name"),
        value.cast("double").alias("metric_value"), threshold.cast("double").alias("threshold_value"),
        (host if host is not None else F.lit(None).cast("string")).alias("affected_ip")))


def _events(frame: DataFrame, *candidates: Column) -> DataFrame:
    return frame.select(F.explode(F.filter(F.array(*candidates), lambda e: e.isNotNull())).alias("e")).select("e.*")


def bandwidth_saturation(metrics: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    link = limits.link_bits_per_second / 8
    warn, crit = limits.bandwidth
    mean, peak = F.col("avg_bytes_per_second"), F.col("peak_bytes_per_second")
    grave = mean / link >= crit
    return _events(
        metrics,
        _event(mean / link >= warn, "bandwidth_avg", F.when(grave, "CRITICAL").otherwise("MEDIUM"), "avg_bytes_per_second", mean,
               F.when(grave, link * crit).otherwise(link * warn),
               F.format_string("mean rate %.0f B/s", mean), "Add capacity or shape traffic."),
        _event(peak / link >= crit, "bandwidth_peak", "HIGH", "peak_bytes_per_second", peak, F.lit(link * crit),
               F.format_string("peak rate %.0f B/s", peak), "Limit bursts or give priority to what matters."))


def packet_rate_level(metrics: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    warn, crit = limits.packet_rate
    pps = F.col("avg_packets_per_second")
    grave = pps >= crit
    return _events(metrics, _event(
        pps >= warn, "pps_avg", F.when(grave, "CRITICAL").otherwise("MEDIUM"), "avg_packets_per_second", pps,
        F.when(grave, crit).otherwise(warn), F.format_string("mean rate %.0f packets/s", pps), "Find the sources and limit them."))


def zscore_spike(per_second: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    """The first second whose packet count is ``z_score`` deviations off the mean."""
    x = F.col("packets").cast("double")
    stats = per_second.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    off = F.abs(F.try_divide(x - F.col("mean"), F.col("std")))
    found = (per_second.crossJoin(F.broadcast(stats))
             .filter((F.col("n") >= 3) & (F.col("std") > 0)).filter(off >= limits.z_score)
             .agg(F.min_by(x, "interval_start").alias("x"), F.max("mean").alias("mean"), F.max("std").alias("std")))
    return _events(found, _event(
        F.col("x").isNotNull(), "pps_spike_zscore", "HIGH", "packets_per_second", F.col("x"),
        F.col("mean") + limits.z_score * F.col("std"), F.format_string("spike of %.0f packets/s", F.col("x")), "Look for the burst's source."))


def iqr_spike(per_second: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    """The largest second above the upper quartile fence."""
    x = F.col("packets").cast("double")
    low, high = exact_quantiles(per_second, ["packets"], [0.25, 0.75])["packets"]
    q = per_second.agg(F.count(F.lit(1)).alias("n"), F.max(x).alias("x"))
    fence = F.lit(None).cast("double") if low is None else F.lit(high + limits.spike_iqr * (high - low))
    return _events(q, _event(
        (F.col("n") >= 4) & (F.col("x") > fence), "pps_spike_iqr", "MEDIUM", "packets_per_second", F.col("x"), fence,
        F.format_string("outlier of %.0f packets/s", F.col("x")), "Check which application bursts."))


def protocol_dominance(protocols: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    whole = F.sum("packet_count").over(Window.partitionBy())
    share = F.col("packet_count") / F.col("whole")
    return _events(protocols.withColumn("whole", whole), _event(
        share >= limits.dominance, "protocol_dominance", F.when(share >= 0.95, "CRITICAL").otherwise("HIGH"),
        F.concat(F.lit("protocol_"), F.col("protocol"), F.lit("_fraction")), F.round(share * 100, 2), F.lit(limits.dominance * 100),
        F.concat(F.col("protocol"), F.lit(" dominates")), "Check for a flood or a misconfigured application."))


def malformed_rate(metrics: DataFrame) -> DataFrame:
    bad = F.col("malformed_pct")
    return _events(metrics, _event(
        bad >= 5.0, "malformed_packets", F.when(bad >= 30, "CRITICAL").when(bad >= 15, "HIGH").otherwise("MEDIUM"),
        "malformed_pct", bad, F.when(bad >= 15, 15.0).otherwise(5.0), F.format_string("%.1f%% malformed", bad), "Check interfaces and drivers."))


def host_concentration(metrics: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    total = F.greatest(F.col("total_packets"), F.lit(1))
    top, top3 = F.col("top_src_count") / total, F.col("top3_src_count") / total
    return _events(
        metrics,
        _event(top >= limits.concentration, "host_top_talker", F.when(top >= 0.85, "CRITICAL").otherwise("HIGH"), "top_talker_fraction",
               F.round(top * 100, 2), F.lit(limits.concentration * 100), F.concat(F.col("top_src_ip"), F.lit(" sends most packets")),
               "Look into this host.", F.col("top_src_ip")),
        _event((F.col("unique_src_ips") >= 3) & (top3 >= 0.90), "host_concentration_top3", "MEDIUM", "top3_concentration_fraction",
               F.round(top3 * 100, 2), F.lit(90.0), F.lit("three hosts send most packets"), "Review policy for these hosts."))


def size_anomaly(lengths: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    """Shares of packets outside the outer quartile fences, from the table of lengths."""
    x = F.col("packet_length").cast("double")
    q = lengths.agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q")).select(
        (F.col("q")[1] + limits.size_iqr * (F.col("q")[1] - F.col("q")[0])).alias("upper"),
        F.greatest(F.lit(0.0), F.col("q")[0] - limits.size_iqr * (F.col("q")[1] - F.col("q")[0])).alias("lower"))
    counted = lengths.crossJoin(F.broadcast(q)).agg(
        F.sum("n").alias("total"), F.max("upper").alias("upper"), F.max("lower").alias("lower"),
        (F.sum(F.when(x > F.col("upper"), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("over"),
        (F.sum(F.when(x < F.col("lower"), F.col("n")).otherwise(0)) / F.sum("n") * 100).alias("under"))
    enough = F.col("total") >= 4
    return _events(
        counted,
        _event(enough & (F.col("over") >= 5), "oversized_packets", F.when(F.col("over") >= 15, "HIGH").otherwise("MEDIUM"),
               "oversized_packet_pct", F.round("over", 2), F.col("upper"), F.lit("many oversized packets"), "Check MTU settings."),
        _event(enough & (F.col("under") >= 10), "undersized_packets", "LOW", "undersized_packet_pct", F.round("under", 2),
               F.col("lower"), F.lit("many tiny packets"), "Check which application sends tiny packets."))


def queue_growth(per_minute: DataFrame, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    """Share of minute slices whose bytes rise strictly.

    Slices start at every minute but the last ``growth_window``; the very last
    slice is left out, as in the definition.  Minutes are numbered day by day, and each is
    handed to the slices that it is part of, so no task sees the whole series.
    """
    w = limits.growth_window
    rows = positions(per_minute.select("interval_start", "bytes"))
    starts = F.explode(F.sequence(F.col("pos") - w + 1, F.col("pos"))).alias("start")
    slices = rows.select(starts, "n", F.struct("pos", "bytes").alias("m")).filter(
        (F.col("n") >= w + 1) & F.col("start").between(1, F.col("n") - w)).groupBy("start").agg(
        F.transform(F.array_sort(F.collect_list("m")), lambda m: m["bytes"]).alias("b"))
    rising = F.forall(F.sequence(F.lit(0), F.lit(max(w - 2, 0))), lambda k: (F.get("b", k) < F.get("b", k + 1)) | F.lit(w < 2))
    share = slices.agg(F.try_divide(F.count_if(rising), F.count(F.lit(1))).alias("share"))
    x = F.col("share")
    return _events(share, _event(
        x >= 0.50, "queue_growth", F.when(x >= 0.70, "HIGH").otherwise("MEDIUM"), "queue_growth_fraction", F.round(x * 100, 2),
        F.when(x >= 0.70, 70.0).otherwise(50.0), F.lit("byte volume keeps rising"), "Check queues and buffer settings."))


def all_events(profile: NetworkProfile, limits: BottleneckLimits = BottleneckLimits()) -> DataFrame:
    parts = [
        bandwidth_saturation(profile.metrics, limits), packet_rate_level(profile.metrics, limits),
        zscore_spike(profile.per_second, limits), iqr_spike(profile.per_second, limits),
        protocol_dominance(profile.protocols, limits), malformed_rate(profile.metrics),
        host_concentration(profile.metrics, limits), size_anomaly(profile.lengths, limits),
        queue_growth(profile.per_minute, limits)]
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return events


def checks_run(metrics: DataFrame) -> DataFrame:
    """One row: how many checks the packets allowed.

    Two of bandwidth, packet rate and protocol mix each, one of sizes, one of queue growth,
    and two of hosts, of which one falls away where no packet names a source.
    """
    return metrics.select(F.when(F.col("top_src_ip").isNull(), 9).otherwise(10).alias("total_checks"))


def bottleneck_report(events: DataFrame, metrics: DataFrame | None = None) -> DataFrame:
    """One row: events, worst severity, grave counts, and, of the profile's ``metrics``, the number of checks run."""
    report = _report(events)
    return report if metrics is None else report.drop("total_checks").crossJoin(F.broadcast(checks_run(metrics)))


def _report(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count(F.lit(1)).alias("event_count"),
        F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("NONE")).alias("max_severity"),
        F.count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("severity") == "HIGH").alias("high_count"), F.lit(10).alias("total_checks"))


def filter_events(events: DataFrame, severity: str | None = None, check: str | None = None) -> DataFrame:
    test = F.lit(True)
    if severity:
        test = test & (F.col("severity") == severity)
    if check:
        test = test & (F.col("check_name") == check)
    return events.filter(test).select("check_name", "severity", "description", "recommendation")


def severity_counts(events: DataFrame) -> DataFrame:
    """All four severities, zero counts kept."""
    levels = literal_rows(events, "severity", SEVERITIES)
    counts = events.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "severity", "left").select("severity", F.coalesce("n", F.lit(0)).alias("events"))


def check_matrix(events: DataFrame) -> DataFrame:
    return events.groupBy("check_name").agg(
        F.count(F.lit(1)).alias("events"), F.max_by("severity", severity_rank(F.col("severity"))).alias("max_severity"))


def escalate(events: DataFrame) -> DataFrame:
    """Alert rows of grave events."""
    return events.filter(F.col("severity").isin("HIGH", "CRITICAL")).select(
        F.concat(F.lit("Bottleneck:"), F.col("check_name")).alias("attack_type"), "severity",
        F.coalesce("affected_ip", F.lit("N/A")).alias("source_ip"), F.lit("N/A").alias("destination_ip"),
        F.substring("description", 1, 500).alias("description"))
