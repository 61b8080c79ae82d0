"""Pieces shared by the detectors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import has_bit


@dataclass(frozen=True)
class Thresholds:
    """Default limits of all rules; override by keyword."""
    ddos_packets_per_second: int = 1_000
    ddos_bytes_per_second: int = 10_485_760
    ddos_unique_src_ips: int = 50
    ddos_growth: str = "median"
    synflood_syn_ack_ratio: float = 0.85
    synflood_syn_dominance: float = 0.70
    synflood_syn_per_second: float = 500.0
    synflood_half_open_limit: int = 100
    portscan_unique_ports: int = 20
    portscan_syn_ratio: float = 0.85
    bruteforce_failed_attempts: int = 10
    bruteforce_rapid_rate: float = 2.0
    bruteforce_rapid_min_attempts: int = 10
    bruteforce_spray_targets: int = 5
    bruteforce_extra_ports: tuple[int, ...] = field(default_factory=tuple)


def flag_counts(mask: Column, **bits: int) -> list[Column]:
    return [number_of(has_bit(mask, bit)).alias(f"{name}_count") for name, bit in bits.items()]


def weighted(df: DataFrame) -> DataFrame:
    """Rows that say how many packets they stand for: packets count one each, :func:`folded` rows stay."""
    if "_packets" in df.columns:
        return df
    return df.withColumns({
        "_packets": F.lit(1).cast("long"), "_bytes": F.coalesce("packet_length", F.lit(0)).cast("long") if "packet_length" in df.columns else F.lit(0).cast("long"),
        "_first": F.col("timestamp"), "_last": F.col("timestamp"), "_number": F.col("packet_number")})


def folded(df: DataFrame) -> DataFrame:
    """Packets of equal ends, port, protocol and flags as one row; all rules can be told from these.

    Summed a task first, so a flood is one row a task in the shuffle.
    """
    names = [c for c in ("src_ip", "dst_ip", "dst_port", "protocol", "tcp_flags") if c in df.columns]
    return weighted(df).groupBy(*names).agg(
        F.sum("_packets").alias("_packets"), F.sum("_bytes").alias("_bytes"), F.min("_first").alias("_first"),
        F.max("_last").alias("_last"), F.min("_number").alias("_number"))


def number_of(test: Column) -> Column:
    """Packets for which the test holds."""
    return F.coalesce(F.sum(F.when(test, F.col("_packets"))), F.lit(0).cast("long"))


TIMES = (F.min, "_first", "first_seen"), (F.max, "_last", "last_seen"), (F.min, "_number", "first_packet")


def seen() -> list[Column]:
    """When and with which packet a group began, and when it ended."""
    return [pick(source).alias(name) for pick, source, name in TIMES]


def duration(start: str = "first_seen", end: str = "last_seen") -> Column:
    return F.coalesce((F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6), F.lit(0.0))


def per_second(amount: Column, seconds: Column) -> Column:
    return F.coalesce(F.when(seconds > 0, amount / seconds), F.lit(0.0))


def graded(ratio: Column, critical: float, high: float, medium: float) -> Column:
    """Severity by how far the observed value exceeds its threshold."""
    return F.when(ratio >= critical, "CRITICAL").when(ratio >= high, "HIGH") \
        .when(ratio >= medium, "MEDIUM").otherwise("LOW")


def capped(cap: float, value: Column) -> Column:
    return F.least(F.lit(cap), value)


def ramp(base: float, gain: float, ratio: Column, reach: float) -> Column:
    """``base`` plus ``gain`` spread over an excess of ``reach`` thresholds."""
    return F.lit(base) + F.lit(gain) * F.least(ratio - 1, F.lit(reach)) / F.lit(reach)


def above(base: float, gain: float, value: Column, threshold: float) -> Column:
    """``base`` plus ``gain`` times the part of the range above ``threshold`` that is used."""
    return F.lit(base) + F.lit(gain) * (F.greatest(F.lit(0.0), value - threshold) / (1 - threshold + 1e-9))


def bonus(test: Column, confidence: Column, extra: float) -> Column:
    return F.when(test, F.least(F.lit(0.99), confidence + extra)).otherwise(confidence)


def rule(when: Column, attack_type: Column | str, severity: Column | str, confidence: Column,
         source: Column, target: Column, advice: Column | str, evidence: dict[str, Column | str],
         port: Column | None = None) -> Column:
    """One candidate alert: a struct when the test holds, else null."""
    text = [part for key, value in evidence.items()
            for part in (F.lit(key), (F.lit(value) if isinstance(value, str) else value).cast("string"))]
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        (F.lit(attack_type) if isinstance(attack_type, str) else attack_type).alias("attack_type"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        F.round(confidence, 3).alias("confidence"),
        source.alias("source_ip"), target.alias("destination_ip"),
        F.create_map(*text).alias("evidence"),
        (F.lit(advice) if isinstance(advice, str) else advice).alias("recommendation"),
        (port if port is not None else F.lit(None)).cast("int").alias("dst_port")))


def emit(profile: DataFrame, rules: Sequence[Column], detector: str, priority: int,
         keys: Sequence[str] = ()) -> DataFrame:
    """Alert rows of every rule that fired; ``keys`` (e.g. the window) are carried along.

    The alert time is the last packet time of the profile, so a re-run gives
    the same alert and the same id.
    """
    hits = profile.select(
        *keys, F.col("last_seen").alias("timestamp"), F.col("first_packet"),
        F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    flat = hits.select(*keys, "timestamp", "first_packet", "r.*")
    identity = F.concat_ws("|", "attack_type", "source_ip", "destination_ip",
                           F.coalesce(F.col("dst_port").cast("string"), F.lit("")),
                           F.coalesce(F.unix_micros("timestamp").cast("string"), F.lit("")))
    return flat.select(
        F.md5(identity).alias("alert_id"), "attack_type", "severity", "confidence", "source_ip",
        "destination_ip", "timestamp", "evidence", "recommendation",
        F.lit(detector).alias("detector_name"), "dst_port", F.lit(None).cast("string").alias("protocol"),
        F.concat(F.col("attack_type"), F.lit(" from "), F.col("source_ip"), F.lit(" to "),
                 F.col("destination_ip")).alias("description"),
        F.lit(priority).alias("priority"), "first_packet", *keys)
