"""Live bandwidth windows and the rates read from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.timeseries import LINK_BITS_PER_SECOND

HISTORY = 120


def bandwidth_windows(packets: DataFrame, interval: str = "1 second", delay: str = "30 seconds",
                      interface: str | None = None, link_bps: float = LINK_BITS_PER_SECOND) -> DataFrame:
    """Bytes, packets and link share per window and interface.

    Rows later than ``delay`` behind the newest are dropped; the dropped number
    is in the query progress (``numRowsDroppedByWatermark``).
    """
    name = F.col(interface) if interface else F.lit("unknown")
    windows = (packets.withWatermark("timestamp", delay).groupBy(F.window("timestamp", interval), name.alias("interface"))
               .agg(F.sum(F.coalesce("packet_length", F.lit(0)).cast("long")).alias("bytes"), F.count(F.lit(1)).alias("packets")))
    seconds = (F.unix_micros("window_end") - F.unix_micros("window_start")) / 1e6
    rows = windows.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "interface", "bytes", "packets")
    return rows.withColumn("bytes_per_second", F.col("bytes") / seconds).withColumn(
        "utilisation_pct", F.round(F.least(F.col("bytes_per_second") / F.lit(link_bps / 8) * 100, F.lit(100.0)), 4))


def recent_rates(windows: DataFrame, last_n: int | None = None, history: int = HISTORY) -> DataFrame:
    """One row: mean byte rate of the last windows (at most ``history``), latest share, highest rate.

    A top-k of at most ``history`` rows over the table of windows.
    """
    size = min(last_n or history, history)
    recent = windows.orderBy(F.desc("window_start"), F.asc("interface")).limit(size)
    now = recent.agg(F.round(F.avg("bytes_per_second"), 4).alias("average_bps"),
                     F.max_by("utilisation_pct", "window_start").alias("current_utilisation"))
    return now.crossJoin(F.broadcast(windows.agg(F.max("bytes_per_second").alias("peak_bps"))))
