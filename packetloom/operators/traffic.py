"""Traffic counters, talkers, sizes and category counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.text import seconds_between
from packetloom.session import checkpoint_root

CHART_COLUMNS = ("src_ip", "dst_ip", "protocol", "packet_size_category", "transport_layer")


def rate(amount: Column, seconds: Column, digits: int = 4) -> Column:
    """``amount`` per second, 0 when there is no positive duration."""
    return F.coalesce(F.when(seconds > 0, F.round(amount / seconds, digits)), F.lit(0.0))


def _basic_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("total_packets"),
            F.coalesce(F.sum(F.col("packet_length").cast("long")), F.lit(0)).alias("total_bytes"),
            F.min("timestamp").alias("capture_start"), F.max("timestamp").alias("capture_end")]


def _basic_columns() -> list[Column]:
    seconds = F.coalesce(seconds_between(F.col("capture_start"), F.col("capture_end")), F.lit(0.0))
    return [F.col("total_packets"), F.col("total_bytes"), F.round(seconds, 4).alias("capture_duration_seconds"),
            rate(F.col("total_packets"), seconds).alias("packets_per_second"),
            rate(F.col("total_bytes"), seconds).alias("bytes_per_second"), F.col("capture_start"), F.col("capture_end")]


def _size_sums() -> list[Column]:
    length = F.col("packet_length")
    return [F.round(F.avg(length), 2).alias("avg_packet_size"),
            F.min(length).alias("min_packet_size"), F.max(length).alias("max_packet_size"),
            F.round(F.percentile(length, F.lit(0.5)), 2).alias("median_packet_size"),
            F.round(F.stddev_samp(length), 2).alias("std_packet_size")]


SIZE_COLUMNS = ("avg_packet_size", "min_packet_size", "max_packet_size", "median_packet_size", "std_packet_size")


def basic_stats(df: DataFrame) -> DataFrame:
    """One row: packets, bytes, time range, duration and rates.

    Rows without a time still count in packets and bytes.
    """
    return df.agg(*_basic_sums()).select(*_basic_columns())


def talker_counts(df: DataFrame) -> DataFrame:
    """(side, ip, packets) for both directions from one scan; null addresses are out.

    Partial sums per (side, ip) are taken before the shuffle, so a host that
    sends most of the packets costs one row per task.
    """
    sides = df.select(F.expr("stack(2, 'src', src_ip, 'dst', dst_ip) AS (side, ip)"))
    return (sides.filter(F.col("ip").isNotNull())
            .groupBy("side", "ip").agg(F.count(F.lit(1)).alias("packets")))


def host_cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row: distinct sources and destinations (``approx`` uses a sketch)."""
    if approx:
        return df.agg(F.approx_count_distinct("src_ip").alias("unique_src_ips"),
                      F.approx_count_distinct("dst_ip").alias("unique_dst_ips"))
    return count_hosts(talker_counts(df))


def count_hosts(talkers: DataFrame) -> DataFrame:
    return talkers.agg(F.count_if(F.col("side") == "src").alias("unique_src_ips"),
                       F.count_if(F.col("side") == "dst").alias("unique_dst_ips"))


def top_talkers(df: DataFrame, n: int = 10) -> DataFrame:
    """(side, rank, ip, packets) of the ``n`` busiest hosts on each side."""
    return rank_hosts(talker_counts(df), n)


def rank_hosts(talkers: DataFrame, n: int) -> DataFrame:
    """Spark keeps only the best ``n`` rows of every task before the rank shuffle (window group limit)."""
    order = Window.partitionBy("side").orderBy(F.desc("packets"), F.asc("ip"))
    return (talkers.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= n).select("side", "rank", "ip", "packets"))


def _stored_talkers(df: DataFrame) -> DataFrame:
    """Talker counts written to the checkpoint folder, for use by several parts of one record."""
    checkpoint_root(df.sparkSession)
    return talker_counts(df).checkpoint()


def packet_statistics(df: DataFrame) -> DataFrame:
    """Mean, min, max, median and sample deviation of packet length.

    The exact median keeps one counter per distinct length, at most 65 536.
    """
    return df.agg(*_size_sums())


def category_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value of ``column``, null values left out, most frequent first."""
    return (df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category"))
            .agg(F.count(F.lit(1)).alias("packets")).orderBy(F.desc("packets"), F.asc("category")))


def top_categories(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    return category_counts(df, column).limit(n)


def as_nested(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """Fold an already aggregated, small frame into one row with one array column."""
    return df.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))


def traffic_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """One record: counters, hosts, sizes, protocol counts, top talkers and minute series."""
    from packetloom.operators.timeseries import minute_timeline

    talkers = _stored_talkers(df)
    tops = rank_hosts(talkers, n)
    protocols = as_nested(
        category_counts(df, "protocol").select(F.col("category").alias("protocol"), "packets"),
        "protocol_counts", "protocol", "packets")
    minutes = as_nested(minute_timeline(df).select("minute", "packets", "bytes"),
                        "minute_series", "minute", "packets", "bytes")
    totals = df.agg(*_basic_sums(), *_size_sums()).select(*_basic_columns(), *SIZE_COLUMNS)
    record = totals.crossJoin(F.broadcast(count_hosts(talkers)))
    for side in ("src", "dst"):
        ranked = as_nested(tops.filter(F.col("side") == side).select("rank", "ip", "packets"),
                           f"top_{side}_ips", "rank", "ip", "packets")
        record = record.crossJoin(F.broadcast(ranked))
    return record.crossJoin(F.broadcast(protocols)).crossJoin(minutes)


def ingest_summary(df: DataFrame, n: int = 10) -> DataFrame:
    """One record of what an ingest run wrote."""
    talkers = _stored_talkers(df)
    tops = rank_hosts(talkers, n)
    length = F.col("packet_length")
    totals = df.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.round(F.avg(length), 2).alias("avg_packet_size"),
        F.max(length).alias("max_packet_size"), F.min(length).alias("min_packet_size"),
        F.count_if(F.col("src_ip").isNotNull() & (F.col("src_ip") != "None")).alias("packets_with_ip"),
        F.count_if(F.col("src_ip").isNull() | (F.col("src_ip") == "None")).alias("packets_without_ip"),
        F.min("timestamp").alias("capture_start"), F.max("timestamp").alias("capture_end"))
    record = totals.crossJoin(F.broadcast(count_hosts(talkers)))
    for column in ("protocol", "transport_layer"):
        record = record.crossJoin(as_nested(category_counts(df, column),
                                            f"{column}_distribution", "category", "packets"))
    for side in ("src", "dst"):
        record = record.crossJoin(as_nested(
            tops.filter(F.col("side") == side).select("rank", "ip", "packets"),
            f"top_{side}_ips", "rank", "ip", "packets"))
    return record


def length_histogram(df: DataFrame, bins: int = 50) -> DataFrame:
    """Equal-width bins of packet length over all rows; empty bins are left out."""
    span = df.agg(F.min("packet_length").alias("lo"), F.max("packet_length").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    bin_no = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("packet_length") - F.col("lo")) / width))).cast("int")
    # one row per distinct length first: the bin arithmetic then runs on <= 65 536 rows
    lengths = (df.filter(F.col("packet_length").isNotNull())
               .groupBy("packet_length").agg(F.count(F.lit(1)).alias("n")))
    return (lengths.crossJoin(F.broadcast(span))
            .groupBy(bin_no.alias("bin"),
                     F.round(F.col("lo") + bin_no * width, 4).alias("bin_start"))
            .agg(F.sum("n").alias("packets")))

