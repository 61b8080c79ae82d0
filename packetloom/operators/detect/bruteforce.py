"""Password guessing against services with a login."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, SYN, strict_flags
from packetloom.functions.ports import AUTH_PORTS, port_to_service
from packetloom.operators.detect import common as c

NAME, PRIORITY = "Brute Force Detector", 30

# Further login ports always watched.
EXTRA_PORTS = (587, 465, 110, 143, 3306, 5432)


def auth_traffic(df: DataFrame, extra_ports: Sequence[int] = ()) -> DataFrame:
    """Packets to login ports; the test reaches the file scan."""
    return df.filter(F.col("dst_port").isin(*sorted({*AUTH_PORTS, *EXTRA_PORTS, *extra_ports})))


def service_profile(auth: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per (source, target, port): attempts, sizes, times, rate and flags."""
    mask = strict_flags(F.col("tcp_flags"))
    span = c.duration()
    return c.weighted(auth).groupBy(*keys, "src_ip", "dst_ip", "dst_port").agg(
        F.sum("_packets").alias("attempts"), (F.sum("_bytes") / F.sum("_packets")).alias("avg_packet_size"), *c.seen(),
        *c.flag_counts(mask, syn=SYN, ack=ACK),
    ).withColumns({"duration_seconds": span, "attempts_per_second": c.per_second(F.col("attempts"), span),
                   "service": port_to_service(F.col("dst_port"))})


def spray_profile(services: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per source from the service rows: attempts and distinct (target, port) pairs."""
    return services.filter(F.col("src_ip").isNotNull()).groupBy(*keys, "src_ip").agg(
        F.sum("attempts").alias("total_attempts"), F.count("dst_ip").alias("unique_targets"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first_packet").alias("first_packet"),
        F.slice(F.sort_array(F.collect_set("service")), 1, 10).alias("services"))


def service_rules(limits: c.Thresholds) -> list:
    need, rate_need = limits.bruteforce_failed_attempts, limits.bruteforce_rapid_rate
    attempts, rate = F.col("attempts"), F.col("attempts_per_second")
    guess = c.capped(0.97, c.ramp(0.60, 0.25, attempts / max(need, 1), 5))
    guess = c.bonus(F.round(rate, 3) >= 5.0, guess, 0.04)
    guess = c.bonus(F.round("duration_seconds", 2) >= 30, guess, 0.03)
    facts = {"service": F.col("service"), "dst_port": F.col("dst_port"), "attempt_count": attempts,
             "connection_rate": F.round(rate, 3), "duration_seconds": F.round("duration_seconds", 2)}
    flagged = attempts >= need
    return [
        c.rule(flagged, F.concat(F.lit("BruteForce-"), F.upper("service")), c.graded(attempts / need, 10, 5, 2), guess,
               F.col("src_ip"), F.col("dst_ip"), "Lock the account out for a while and block the source.",
               {"rule": "SERVICE_BRUTEFORCE", **facts}, F.col("dst_port")),
        c.rule(~flagged & (rate >= rate_need) & (attempts >= limits.bruteforce_rapid_min_attempts), "BruteForce-RapidReconnect", "MEDIUM",
               c.capped(0.94, c.ramp(0.60, 0.25, F.round(rate, 3) / max(rate_need, 1), 4)),
               F.col("src_ip"), F.col("dst_ip"), "Limit new connections per source to this service.",
               {"rule": "RAPID_RECONNECT", **facts}, F.col("dst_port")),
    ]


def spray_rules(limits: c.Thresholds) -> list:
    targets = F.col("unique_targets")
    return [c.rule(
        (F.col("total_attempts") >= limits.bruteforce_failed_attempts) & (targets >= limits.bruteforce_spray_targets),
        "BruteForce-CredentialSpray", "HIGH",
        c.capped(0.95, c.ramp(0.60, 0.25, targets / max(limits.bruteforce_spray_targets, 1), 3)),
        F.col("src_ip"), F.lit("MULTIPLE"), "Block the source and watch the targeted accounts.",
        {"rule": "CREDENTIAL_SPRAY", "unique_targets": targets, "total_attempts": F.col("total_attempts"),
         "services_targeted": F.array_join("services", ",")})]


def detect(df: DataFrame, limits: c.Thresholds = c.Thresholds(), keys: Sequence[str] = ()) -> DataFrame:
    services = service_profile(auth_traffic(df, limits.bruteforce_extra_ports), keys)
    per_service = services.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    return c.emit(per_service, service_rules(limits), NAME, PRIORITY, keys).unionByName(
        c.emit(spray_profile(services, keys), spray_rules(limits), NAME, PRIORITY, keys))
