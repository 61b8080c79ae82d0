"""Small frames every score is computed from.

The packet table is read twice however many scores are asked for: once folded
to (second, protocol), once folded to hosts.  Both folded frames are written to
the checkpoint folder, so that the many small aggregates on top of them never
reach back to the packets.  The table of packet lengths is a third read, made
only for the checks that need it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.text import seconds_between
from packetloom.operators.clean import normalise_protocols
from packetloom.operators.timeseries import floor_time, roll_up
from packetloom.operators.traffic import talker_counts
from packetloom.session import checkpoint_root


@dataclass(frozen=True)
class NetworkProfile:
    """``metrics`` is one row; the others hold one row per second, minute, protocol, host or length."""
    metrics: DataFrame
    per_second: DataFrame
    per_minute: DataFrame
    protocols: DataFrame
    sources: DataFrame
    lengths: DataFrame


def _wide(value: Column) -> Column:
    """Sum of whole numbers with room for squares over any table."""
    return F.sum(value.cast("decimal(38,0)"))


def _sample_std(n: Column, total: Column, squares: Column) -> Column:
    """Sample deviation from exact sums; null under two values."""
    count = n.cast("decimal(20,0)")
    return F.when(n > 1, F.sqrt((count * squares - total * total).cast("double") / (n.cast("double") * (n - 1).cast("double"))))


def network_profile(df: DataFrame) -> NetworkProfile:
    checkpoint_root(df.sparkSession)
    rows = normalise_protocols(df)
    length, ttl = F.col("packet_length").cast("long"), F.col("ttl").cast("long")
    cells = rows.groupBy(floor_time(F.col("timestamp"), 1).alias("interval_start"), "protocol").agg(
        F.sum(length).alias("bytes"), F.count(F.lit(1)).alias("packets"), F.sum(length * length).alias("squares"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.count("ttl").alias("ttl_n"), F.sum(ttl).alias("ttl_sum"), F.sum(ttl * ttl).alias("ttl_squares")).checkpoint()
    per_second = cells.filter(F.col("interval_start").isNotNull()).groupBy("interval_start").agg(
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"))
    per_minute = roll_up(per_second, 60)
    protocols = cells.groupBy("protocol").agg(
        F.sum("packets").alias("packet_count"), F.sum("bytes").alias("byte_count"))
    talkers = talker_counts(rows).checkpoint()
    sources = talkers.filter(F.col("side") == "src")
    lengths = rows.groupBy("packet_length").agg(F.count(F.lit(1)).alias("n"))

    timed = F.col("interval_start").isNotNull()
    sums = cells.agg(
        F.sum("packets").alias("total_packets"), F.sum("bytes").alias("total_bytes"), F.max("last").alias("capture_end"),
        F.coalesce(seconds_between(F.min("first"), F.max("last")), F.lit(0.0)).alias("_span"),
        F.coalesce(F.sum(F.when(timed, F.col("bytes"))), F.lit(0)).alias("_bytes"),
        F.coalesce(F.sum(F.when(timed, F.col("packets"))), F.lit(0)).alias("_packets"),
        _wide(F.col("bytes")).alias("_s"), _wide(F.col("squares")).alias("_q"), F.sum("ttl_n").alias("ttl_count"),
        _wide(F.col("ttl_sum")).alias("_ts"), _wide(F.col("ttl_squares")).alias("_tq"))

    def per_sec(total: str) -> Column:
        return F.coalesce(F.when(F.col("_span") > 0, F.round(F.col(total) / F.col("_span"), 4)), F.lit(0.0))

    mean = F.try_divide(F.col("total_bytes"), F.col("total_packets"))
    totals = sums.select(
        "total_packets", "total_bytes", "capture_end", F.round("_span", 4).alias("duration_seconds"),
        per_sec("_bytes").alias("avg_bytes_per_second"), per_sec("_packets").alias("avg_packets_per_second"),
        mean.alias("mean_length"), F.round(mean, 2).alias("avg_packet_size"),
        F.round(_sample_std(F.col("total_packets"), F.col("_s"), F.col("_q")), 2).alias("std_packet_size"),
        "ttl_count", _sample_std(F.col("ttl_count"), F.col("_ts"), F.col("_tq")).alias("ttl_std"))
    peaks = per_second.agg(F.max("bytes").cast("double").alias("peak_bytes_per_second"),
                           F.max("packets").cast("double").alias("peak_packets_per_second"))
    minutes = per_minute.agg(
        F.count(F.lit(1)).alias("minute_count"),
        F.coalesce(F.when(F.avg("bytes") > 0, F.stddev_samp("bytes") / F.avg("bytes")), F.lit(0.0)).alias("minute_cv"))
    whole = F.sum("packet_count").over(Window.partitionBy())
    share = F.col("packet_count") / F.col("whole")
    shares = protocols.withColumn("whole", whole).agg(
        F.count(F.lit(1)).alias("protocol_count"), (-F.sum(share * F.log2(share))).alias("protocol_entropy"),
        F.round(F.sum(F.when(F.col("protocol") == "MALFORMED", F.col("packet_count")).otherwise(0))
                / F.max("whole") * 100, 2).alias("malformed_pct"))
    best = Window.partitionBy("side").orderBy(F.desc("packets"), F.asc("ip"))
    counted = talkers.groupBy("side").agg(F.count(F.lit(1)).alias("hosts"))
    top3 = (sources.withColumn("r", F.row_number().over(best)).filter("r <= 3")
            .agg(F.max(F.when(F.col("r") == 1, F.col("ip"))).alias("top_src_ip"),
                 F.coalesce(F.max("packets"), F.lit(0)).alias("top_src_count"),
                 F.coalesce(F.sum("packets"), F.lit(0)).alias("top3_src_count")))
    hosts = counted.agg(
        F.coalesce(F.max(F.when(F.col("side") == "src", F.col("hosts"))), F.lit(0)).alias("unique_src_ips"),
        F.coalesce(F.max(F.when(F.col("side") == "dst", F.col("hosts"))), F.lit(0)).alias("unique_dst_ips"))
    metrics = totals
    for part in (peaks, minutes, shares, hosts, top3):  # one row each
        metrics = metrics.crossJoin(F.broadcast(part))
    return NetworkProfile(metrics, per_second, per_minute, protocols, sources, lengths)


def positions(frame: DataFrame, time: str = "interval_start") -> DataFrame:
    """``frame`` with ``pos`` (1..n in time order) and ``n``, numbered day by day.

    Only the day counts meet in one task, never the rows themselves.
    """
    day = F.to_date(time)
    days = frame.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_day")) - F.col("_rows")
    offsets = days.select("_day", before.alias("_before"), F.sum("_rows").over(Window.partitionBy()).alias("n"))
    inside = F.row_number().over(Window.partitionBy("_day").orderBy(time))
    return (frame.withColumn("_day", day).withColumn("_in", inside).join(offsets, "_day")
            .withColumn("pos", F.col("_before") + F.col("_in")).drop("_day", "_in", "_before"))
