"""Interval aggregates over packet time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.text import interval_seconds, seconds_between

LINK_BITS_PER_SECOND = 1_000_000_000
DAY = 86_400


def floor_time(ts: Column, seconds: int, origin: Column | None = None) -> Column:
    """Start of the ``seconds``-long slot holding ``ts``, counted from ``origin`` (else the epoch)."""
    step = seconds * 1_000_000
    micros = F.unix_micros(ts)
    base = F.unix_micros(origin) if origin is not None else F.lit(0)
    return F.timestamp_micros(micros - F.pmod(micros - base, F.lit(step)))


def interval_totals(df: DataFrame, seconds: int) -> DataFrame:
    """(interval_start, bytes, packets) of non-empty intervals.

    Slots start at midnight of the first day.  For lengths that divide a day
    that is the same as counting from the epoch and needs no look at the data;
    other lengths first read the earliest time.
    """
    rows = df.filter(F.col("timestamp").isNotNull() & F.col("packet_length").isNotNull())
    origin = None
    if DAY % seconds:
        first = rows.agg(F.date_trunc("day", F.min("timestamp")).alias("_origin"))
        rows = rows.crossJoin(F.broadcast(first))
        origin = F.col("_origin")
    return (rows.groupBy(floor_time(F.col("timestamp"), seconds, origin).alias("interval_start"))
            .agg(F.sum(F.col("packet_length").cast("long")).alias("bytes"),
                 F.count(F.lit(1)).alias("packets")))


def roll_up(seconds_frame: DataFrame, seconds: int) -> DataFrame:
    """Coarser intervals from finer ones, without touching packets again."""
    return (seconds_frame.groupBy(floor_time(F.col("interval_start"), seconds).alias("interval_start"))
            .agg(F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets")))


def with_rates(totals: DataFrame, seconds: int) -> DataFrame:
    return totals.select(
        "interval_start", "bytes", "packets",
        F.round(F.col("bytes") / F.lit(float(seconds)), 4).alias("bytes_per_second"),
        F.round(F.col("packets") / F.lit(float(seconds)), 4).alias("packets_per_second"))


def traffic_timeline(df: DataFrame, freq: str = "1min") -> DataFrame:
    """Bytes, packets and per-second rates of each non-empty interval."""
    seconds = interval_seconds(freq)
    return with_rates(interval_totals(df, seconds), seconds)


def throughput(df: DataFrame) -> DataFrame:
    return traffic_timeline(df, "1s")


def fill_minutes(counts: DataFrame, *values: str, seconds: int = 60) -> DataFrame:
    """Add the empty slots between the first and last ``minute`` with zeros.

    The calendar is exploded day by day and then within the day, so no single
    array grows with the length of the capture.
    """
    step = F.expr(f"INTERVAL {seconds} SECONDS")
    bounds = counts.agg(F.min("minute").alias("lo"), F.max("minute").alias("hi")) \
        .filter(F.col("lo").isNotNull())
    days = bounds.select("lo", "hi", F.explode(F.sequence(
        F.date_trunc("day", F.col("lo")), F.date_trunc("day", F.col("hi")),
        F.expr("INTERVAL 1 DAY"))).alias("day"))
    slots = days.select("lo", "hi", F.explode(F.sequence(
        F.col("day"), F.col("day") + F.expr("INTERVAL 1 DAY") - step, step)).alias("minute")) \
        .filter(F.col("minute").between(F.col("lo"), F.col("hi"))).select("minute")
    return slots.join(counts, "minute", "left").select(
        "minute", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def minute_timeline(df: DataFrame) -> DataFrame:
    """Packets and bytes of every UTC minute from first to last, empty ones as 0."""
    counts = (df.filter(F.col("timestamp").isNotNull())
              .groupBy(floor_time(F.col("timestamp"), 60).alias("minute"))
              .agg(F.count(F.col("packet_length")).alias("packets"),
                   F.coalesce(F.sum(F.col("packet_length").cast("long")), F.lit(0)).alias("bytes")))
    return fill_minutes(counts, "packets", "bytes")


def protocol_timeline(df: DataFrame, protocol: str | None = None) -> DataFrame:
    """Zero-filled packets per minute, of one protocol or of all."""
    rows = df.filter(F.col("protocol") == protocol.upper()) if protocol else df
    return minute_timeline(rows).select("minute", "packets")


def peak_periods(df: DataFrame, freq: str = "1min", n: int = 10, by: str = "bytes") -> DataFrame:
    """The ``n`` busiest intervals; among equals the earliest wins."""
    return traffic_timeline(df, freq).orderBy(F.desc(by), F.asc("interval_start")).limit(n)


def bandwidth_metrics(df: DataFrame, link_bps: float = LINK_BITS_PER_SECOND,
                      seconds: DataFrame | None = None) -> DataFrame:
    """One row: totals, mean and peak rates, peak share of the link (at most 100 %)."""
    per_second = seconds if seconds is not None else interval_totals(df, 1)
    peaks = per_second.agg(F.max("bytes").alias("peak_bytes"), F.max("packets").alias("peak_packets"))
    rows = df.filter(F.col("timestamp").isNotNull() & F.col("packet_length").isNotNull())
    totals = rows.agg(
        F.coalesce(F.sum(F.col("packet_length").cast("long")), F.lit(0)).alias("total_bytes"),
        F.count(F.lit(1)).alias("total_packets"),
        F.min("timestamp").alias("capture_start"), F.max("timestamp").alias("capture_end"))
    span = F.coalesce(seconds_between(F.col("capture_start"), F.col("capture_end")), F.lit(0.0))

    def per_sec(column: str) -> Column:
        return F.coalesce(F.when(span > 0, F.round(F.col(column) / span, 4)), F.lit(0.0))

    peak = F.coalesce(F.col("peak_bytes"), F.lit(0)).cast("double")
    return totals.crossJoin(F.broadcast(peaks)).select(
        "total_bytes", "total_packets", F.round(span, 4).alias("capture_duration_seconds"),
        per_sec("total_bytes").alias("avg_bytes_per_second"),
        F.round(peak, 4).alias("peak_bytes_per_second"),
        per_sec("total_packets").alias("avg_packets_per_second"),
        F.coalesce(F.col("peak_packets"), F.lit(0)).cast("double").alias("peak_packets_per_second"),
        F.least(F.lit(100.0), F.round(peak / F.lit(link_bps / 8.0) * 100, 4))
        .alias("bandwidth_utilisation_pct"),
        "capture_start", "capture_end")


def bandwidth_report(df: DataFrame, n: int = 10) -> DataFrame:
    """Long table of the bandwidth report: one row per metric, second, minute and top interval.

    The per-second aggregate is the only pass over packets besides the totals;
    minutes and top intervals are rolled up from it.
    """
    per_second = interval_totals(df, 1)
    per_minute = with_rates(roll_up(per_second, 60), 60)
    head = bandwidth_metrics(df, seconds=per_second).select(
        F.lit("total").alias("section"), F.col("capture_start").alias("interval_start"),
        F.col("total_bytes").alias("bytes"), F.col("total_packets").alias("packets"),
        F.col("avg_bytes_per_second").alias("bytes_per_second"),
        F.col("avg_packets_per_second").alias("packets_per_second"))
    top = per_minute.orderBy(F.desc("bytes"), F.asc("interval_start")).limit(n)
    parts = (("second", with_rates(per_second, 1)), ("minute", per_minute), ("peak", top))
    for section, part in parts:
        head = head.unionByName(part.withColumn("section", F.lit(section)))
    return head


def rate_series(df: DataFrame, metric: str = "bytes_per_minute") -> DataFrame:
    """Ordered (interval_start, value); the value is a per-second rate."""
    value, _, unit = metric.partition("_per_")
    freq = "1s" if unit == "second" else "1min"
    column = "packets_per_second" if value == "packets" else "bytes_per_second"
    return traffic_timeline(df, freq).select("interval_start", F.col(column).alias("value")) \
        .orderBy("interval_start")


def bytes_by_protocol(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("protocol").isNotNull()).groupBy("protocol")
            .agg(F.sum(F.col("packet_length").cast("long")).alias("bytes"))
            .orderBy(F.desc("bytes"), F.asc("protocol")))
