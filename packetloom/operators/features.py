"""Packet features: engineered columns, rolling statistics, feature matrix."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.flags import ACK, FIN, PSH, RST, SYN, feature_flags, has_bit
from packetloom.functions.ip import is_private_ip
from packetloom.functions.text import size_class
from packetloom.session import checkpoint_root

EPS = 1e-9
Step = Callable[[DataFrame], DataFrame]
WINDOWS = (5, 10, 30)
ROLLED = ("packet_length", "src_port", "dst_port", "ttl")
PROTOCOLS = ("TCP", "UDP", "ICMP", "ARP", "DNS")
HALO = max(WINDOWS) - 1
BUCKET_ROWS = 10_000
# about 60 bytes a value: 120 MB at most, whatever the size of the packet table
BROADCAST_VALUES = 2_000_000


# ---- engineered columns ---------------------------------------------------------

def with_frequency(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Rows plus how often their value of each (column, name) occurs; 0 for null.

    A grouped count joined back rather than a window: counts are combined
    before their shuffle, so a value holding many rows costs one row per task.
    One pass with a small sketch tells how many values there are: up to
    ``BROADCAST_VALUES`` the counts are broadcast and the packets stay where
    they are; beyond that the join is left to Spark, whose skew handling splits
    the partitions of frequent values.
    """
    sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c, _ in columns]).first()
    for column, name in columns:
        counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name))
        if sizes[column] <= BROADCAST_VALUES:
            counts = F.broadcast(counts)
        df = df.join(counts, column, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))
    return df


def engineer(df: DataFrame) -> DataFrame:
    """The nine columns added at ingest."""
    transport = F.upper("transport_layer")

    def mark(test: Column) -> Column:
        return F.coalesce(test, F.lit(False)).cast("int")

    flagged = df.withColumns({
        "is_tcp": mark(transport == "TCP"), "is_udp": mark(transport == "UDP"),
        "is_icmp": mark(transport.startswith("ICMP")),
        "packet_size_category": size_class(F.col("packet_length")),
        "hour_of_day": F.hour("timestamp"),
        "is_private_src": is_private_ip(F.col("src_ip")).cast("int"),
        "is_private_dst": is_private_ip(F.col("dst_ip")).cast("int")})
    return with_frequency(flagged, ("src_ip", "src_ip_frequency"), ("dst_ip", "dst_ip_frequency"))


# ---- order and buckets -----------------------------------------------------------

def running_offsets(counts: DataFrame, key: str, rows: str, group: int = 4096) -> DataFrame:
    """``counts`` with ``_before``: rows in all smaller keys.  Two levels, so no task sees all keys."""
    part = counts.withColumn("_group", F.floor(F.col(key) / F.lit(group)))
    inside = Window.partitionBy("_group").orderBy(key)
    upper = part.groupBy("_group").agg(F.sum(rows).alias("_rows"))
    upper = upper.select("_group", (F.sum("_rows").over(Window.orderBy("_group")) - F.col("_rows")).alias("_base"))
    return part.join(upper, "_group").select(
        key, (F.col("_base") + F.sum(rows).over(inside) - F.col(rows)).alias("_before"))


def _bucket_table(cells: DataFrame, bucket_rows: int, most: int, group: int = 4096) -> DataFrame:
    """(``_session``, ``_cell``, ``_bucket``) of sessions of several buckets.

    Cells follow each other into buckets by the rows before them, a cell counting ``most``
    at most, so that every bucket but the last of a session has ``bucket_rows`` less
    ``most`` at least.  Running totals are taken in two levels: no task sees all
    cells of a long session.
    """
    part = cells.select("_session", "_cell", F.least("_rows", F.lit(most)).alias("_n"), F.floor(F.col("_cell") / F.lit(group)).alias("_group"))
    upper = part.groupBy("_session", "_group").agg(F.sum("_n").alias("_sum"))
    by_group = Window.partitionBy("_session").orderBy("_group")
    upper = upper.select(F.col("_session").alias("_s"), F.col("_group").alias("_g"), (F.sum("_sum").over(by_group) - F.col("_sum")).alias("_base"))
    inside = Window.partitionBy("_session", "_group").orderBy("_cell")
    before = F.col("_base") + F.sum("_n").over(inside) - F.col("_n")
    placed = part.join(upper, F.col("_session").eqNullSafe(F.col("_s")) & F.col("_group").eqNullSafe(F.col("_g"))).select(
        "_session", "_cell", F.floor(before / F.lit(bucket_rows)).alias("_bucket"))
    several = placed.groupBy(F.col("_session").alias("_s")).agg(F.max("_bucket").alias("_last")).filter("_last > 0")
    return placed.join(several, F.col("_session").eqNullSafe(F.col("_s"))).select("_session", "_cell", "_bucket", "_last")


def _bounded(table: DataFrame, limit: int = BROADCAST_VALUES) -> DataFrame:
    """Broadcast up to ``limit`` rows; a larger table is left to Spark."""
    return F.broadcast(table) if table.limit(limit + 1).count() <= limit else table


def bucketed(df: DataFrame, order: str, bucket_rows: int, session: str | None = None, halo: int = HALO) -> DataFrame:
    """Rows with ``_session``, ``_own`` and ``_bucket``, the last ``halo`` rows of a bucket also in the next one of their session.

    Row frames of up to ``halo + 1`` rows computed per (session, bucket) then equal frames
    over the whole session.  A scan of two columns counts cells of the order, which make
    buckets; a second one finds from which number on a bucket's rows are its last ones; the
    rows then take both from a small table and have not moved yet.  Everything follows
    from the values, so a task that runs again does the same.  Rows without a number come
    first in the first bucket.
    """
    if bucket_rows <= halo:
        raise ValueError("a bucket must hold more rows than the halo")
    cell_rows = max(1, min(bucket_rows // 2, bucket_rows - halo))
    checkpoint_root(df.sparkSession)
    rows = df.withColumns({"_session": F.col(session) if session else F.lit(0), "_cell": F.floor(F.col(order) / F.lit(cell_rows)).cast("long")})
    cells = rows.groupBy("_session", "_cell").agg(F.count(F.lit(1)).alias("_rows"))
    table = _bucket_table(cells, bucket_rows, cell_rows).checkpoint()
    if table.isEmpty():
        return rows.withColumns({"_own": F.lit(0).cast("long"), "_bucket": F.lit(0).cast("long")}).drop("_cell")

    def placed(left: DataFrame, right: DataFrame, *more: str) -> DataFrame:
        right = right.select(F.col("_session").alias("_s"), F.col("_cell").alias("_c"), *more)
        return left.join(_bounded(right), F.col("_session").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")), "left").drop("_s", "_c")
    numbers = placed(rows.select("_session", "_cell", F.col(order).alias("_at")), table, "_bucket").filter("_bucket IS NOT NULL")
    from_last = F.row_number().over(Window.partitionBy("_session", "_bucket").orderBy(F.desc("_at")))
    tails = numbers.withColumn("_r", from_last).filter(F.col("_r") <= halo).groupBy("_session", "_bucket").agg(F.min("_at").alias("_tail"))
    tails = tails.select(F.col("_session").alias("_ts"), F.col("_bucket").alias("_tb"), "_tail")
    ends = table.join(tails, F.col("_session").eqNullSafe(F.col("_ts")) & (F.col("_bucket") == F.col("_tb"))).select(
        "_session", "_cell", "_bucket", F.when(F.col("_bucket") < F.col("_last"), F.col("_tail")).alias("_tail")).checkpoint()
    found = placed(rows, ends, F.col("_bucket").alias("_own"), "_tail").withColumn("_own", F.coalesce("_own", F.lit(0).cast("long")))
    both = F.when(F.col(order) >= F.col("_tail"), F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))
    return found.withColumn("_bucket", F.explode(both)).drop("_cell", "_tail")


def in_order():
    return Window.partitionBy("_session", "_bucket").orderBy("_idx")


def frame(rows: int):
    return in_order().rowsBetween(-(rows - 1), 0)


def rolling(df: DataFrame, *steps: Step, order: str = "packet_number", bucket_rows: int = BUCKET_ROWS,
            contiguous: bool = False, session: str | None = None) -> DataFrame:
    """Apply windowed ``steps`` in packet order of the whole capture, or of each ``session``.

    All steps share one partitioning and order, so together they cost one shuffle and one
    sort.  With ``session``, the name of a column, no frame crosses from one session to
    another and every session counts from its own first packet; without it all rows are
    one capture.  ``contiguous`` says that ``order`` is 0 or 1, 2, 3 ... without gaps in
    each session, as the ingest job numbers packets; buckets then follow from the number
    and need no scan.
    """
    if contiguous:
        own, number = F.floor(F.col(order) / F.lit(bucket_rows)), F.col(order).cast("long")
        tail = F.pmod(number, F.lit(bucket_rows)) >= bucket_rows - HALO
        rows = df.withColumns({"_session": F.col(session) if session else F.lit(0), "_own": own}).withColumn(
            "_bucket", F.explode(F.when(tail, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    else:
        rows = bucketed(df, order, bucket_rows, session)
    rows = rows.withColumn("_idx", F.col(order).cast("long")).withColumn("_n", F.row_number().over(in_order()))
    for step in steps:
        rows = step(rows)
    return rows.filter(F.col("_bucket") == F.col("_own")).drop("_session", "_idx", "_own", "_bucket", "_n")


def window_sums(df: DataFrame, values: dict[str, Column], windows: Sequence[int]) -> DataFrame:
    """Columns ``<name>_<w>``: sums of whole numbers over the last ``w`` rows.

    A running total less the running total ``w`` rows back: constant work per
    row, and exact, as bucket totals stay far below 2^63.
    """
    so_far = in_order().rowsBetween(Window.unboundedPreceding, 0)
    total = {f"_t_{name}": F.sum(value.cast("long")).over(so_far) for name, value in values.items()}
    sums = {f"{name}_{w}": F.col(f"_t_{name}") - F.coalesce(F.lag(f"_t_{name}", w).over(in_order()), F.lit(0))
            for name in values for w in windows}
    return df.withColumns(total).withColumns(sums).drop(*total)


def seen(w: int) -> Column:
    """Rows in the frame of ``w`` rows."""
    return F.least(F.col("_n"), F.lit(w)).cast("long")


def mean_of(name: str, w: int) -> Column:
    return F.col(f"{name}_{w}") / seen(w)


def variance_of(name: str, square: str, w: int) -> Column:
    """Sample variance from exact sums; 0 for a single row."""
    n, s, q = seen(w), F.col(f"{name}_{w}"), F.col(f"{square}_{w}")
    return F.coalesce(F.try_divide(n * q - s * s, n * (n - 1)), F.lit(0.0))


# ---- feature steps ---------------------------------------------------------------

def number(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def base_features() -> dict[str, Column]:
    length, src, dst = number("packet_length"), number("src_port"), number("dst_port")
    protocol = F.upper(F.coalesce("protocol", F.lit("UNKNOWN")))
    hour = 2 * 3.141592653589793 * number("hour_of_day") / 24

    def flag(test: Column) -> Column:
        return test.cast("int")

    return {
        "packet_length_sq": length * length, "packet_length_log": F.log1p(length),
        "port_ratio": dst / F.greatest(src, F.lit(1.0)),
        "dst_port_privileged": flag(dst.between(0, 1023)), "dst_port_ephemeral": flag(dst.between(49152, 65535)),
        "src_port_privileged": flag(src.between(0, 1023)),
        **{f"proto_{p.lower()}": flag(protocol.startswith(p)) for p in PROTOCOLS},
        "src_ip_frequency_log": F.log1p(number("src_ip_frequency")), "dst_ip_frequency_log": F.log1p(number("dst_ip_frequency")),
        "hour_sin": F.sin(hour), "hour_cos": F.cos(hour),
    }


def flag_features() -> dict[str, Column]:
    mask = feature_flags(F.col("tcp_flags"))
    return {f"flag_{n}": has_bit(mask, bit).cast("int")
            for n, bit in (("syn", SYN), ("ack", ACK), ("rst", RST), ("fin", FIN), ("psh", PSH))}


def syn_ratio(df: DataFrame) -> DataFrame:
    """SYN share over the last ten packets; needs the flag features."""
    rows = window_sums(df, {"_syn": F.col("flag_syn"), "_ack": F.col("flag_ack")}, [10])
    syn, ack = F.col("_syn_10"), F.col("_ack_10")
    return rows.withColumn("syn_ack_ratio", syn / (syn + ack + EPS)).drop("_syn_10", "_ack_10")


def whole(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(0).cast("long"))


def rolling_statistics(df: DataFrame, columns: Sequence[str] = ROLLED) -> DataFrame:
    """Mean, sample deviation, extremes and range over the last 5, 10 and 30 packets.

    Extremes of 10 and 30 rows are put together from those of 5 rows, which
    are the only ones read row by row.
    """
    sums = {f"_s_{c}": whole(c) for c in columns} | {f"_q_{c}": whole(c) * whole(c) for c in columns}
    rows = window_sums(df, sums, WINDOWS)
    ends = (("min", F.min, F.least), ("max", F.max, F.greatest))
    rows = rows.withColumns({f"{c}_w5_{n}": pick(number(c)).over(frame(5)) for c in columns for n, pick, _ in ends})

    def spread(big: int, small: int) -> dict[str, Column]:
        return {f"{c}_w{big}_{n}": join(*[F.coalesce(F.lag(f"{c}_w{small}_{n}", k).over(in_order()), F.col(f"{c}_w{small}_{n}"))
                                          for k in range(0, big, small)])
                for c in columns for n, _, join in ends}

    rows = rows.withColumns(spread(10, 5)).withColumns(spread(30, 10))
    out = {}
    for c in columns:
        for w in WINDOWS:
            out |= {f"{c}_w{w}_mean": mean_of(f"_s_{c}", w), f"{c}_w{w}_std": F.sqrt(variance_of(f"_s_{c}", f"_q_{c}", w)),
                    f"{c}_w{w}_range": F.col(f"{c}_w{w}_max") - F.col(f"{c}_w{w}_min")}
    return rows.withColumns(out).drop(*[f"{n}_{w}" for n in sums for w in WINDOWS])


def diversity(df: DataFrame) -> DataFrame:
    """Distinct ports of the last 30 packets and the source's share of their frequencies.

    The last 30 values are gathered once for all features that need them.
    """
    rows = window_sums(_recent(df), {"_freq": whole("src_ip_frequency")}, [30])

    def distinct(field: str) -> Column:
        return F.size(F.array_distinct(F.transform("_recent", lambda x: x[field]))).cast("double")

    return rows.withColumns({
        "dst_port_nunique_w30": distinct("dst_port"), "src_port_nunique_w30": distinct("src_port"),
        "src_ip_concentration": number("src_ip_frequency") / (F.col("_freq_30") + EPS)}).drop("_freq_30", "_recent")


def _recent(df: DataFrame) -> DataFrame:
    if "_recent" in df.columns:
        return df
    return df.withColumn("_recent", F.collect_list(F.struct(
        whole("dst_port").alias("dst_port"), whole("src_port").alias("src_port"),
        F.coalesce(F.col("protocol"), F.lit("\u0000")).alias("protocol"))).over(frame(30)))


def protocol_entropy(df: DataFrame) -> DataFrame:
    """Entropy of the last 30 protocols; a missing protocol is a class of its own."""
    names = F.transform("_recent", lambda x: x["protocol"])

    def part(total: Column, name: Column, items: Column) -> Column:
        share = F.size(F.filter(items, lambda x: x == name)) / F.size(items)
        return total + share * F.log2(share + EPS)

    # bind the list once, then use it in both loops
    total = F.get(F.transform(F.array(names), lambda items: F.aggregate(
        F.array_distinct(items), F.lit(0.0), lambda acc, name: part(acc, name, items))), F.lit(0))
    return _recent(df).withColumn("protocol_entropy_w30", -total)


def burstiness(df: DataFrame) -> DataFrame:
    length, src, dst = number("packet_length"), number("src_ip_frequency"), number("dst_ip_frequency")
    rows = window_sums(df, {"_s": whole("packet_length"), "_q": whole("packet_length") * whole("packet_length")}, [30])
    mean = F.when(F.col("_n") >= 2, mean_of("_s", 30)).otherwise(0.0)
    return rows.withColumns({
        "burstiness_index": variance_of("_s", "_q", 30) / (mean + EPS), "traffic_density": mean / (length + EPS),
        "traffic_imbalance": F.abs(src - dst) / (src + dst + EPS),
        "connection_freq_w10": seen(10).cast("double"),
        "is_malformed": F.coalesce(F.upper("protocol").contains("MALFORM"), F.lit(False)).cast("int"),
        "is_tiny_packet": (length < 20).cast("int"),
    }).drop("_s_30", "_q_30")


def zscore_statistics(df: DataFrame, columns: Sequence[str] = ROLLED) -> DataFrame:
    """One row: mean and sample deviation of each column."""
    return df.agg(*[f(number(c)).alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])


def with_zscores(df: DataFrame, stats: DataFrame, columns: Sequence[str] = ROLLED) -> DataFrame:
    scores = {f"{c}_zscore": F.when(F.col(f"_s_{c}") > 0, F.least(F.lit(5.0), F.greatest(
        F.lit(-5.0), F.try_divide(number(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}"))))).otherwise(0.0) for c in columns}
    return df.crossJoin(F.broadcast(stats)).withColumns(scores).drop(*[f"_{n}_{c}" for c in columns for n in "ms"])


def zscore_features(df: DataFrame, columns: Sequence[str] = ROLLED) -> DataFrame:
    """Deviation from the global mean in sample deviations, clipped at five."""
    return with_zscores(df, zscore_statistics(df, columns), columns)


Z_COLUMNS = ROLLED
RAW_FEATURES = ("packet_length", "src_port", "dst_port", "ttl", "ip_version", "is_tcp", "is_udp", "is_icmp",
                "src_ip_frequency", "dst_ip_frequency", "hour_of_day", "is_private_src", "is_private_dst")


ROLLING_FEATURES = (
    "syn_ack_ratio", *[f"{c}_w{w}_{k}" for c in ROLLED for w in WINDOWS for k in ("mean", "std", "min", "max", "range")])
LATE_FEATURES = ("dst_port_nunique_w30", "src_port_nunique_w30", "src_ip_concentration", "protocol_entropy_w30",
                 "burstiness_index", "traffic_density", "traffic_imbalance", "connection_freq_w10", "is_malformed", "is_tiny_packet")


def feature_names() -> list[str]:
    """The versioned, ordered list of model inputs; identifiers are never among them."""
    return [*RAW_FEATURES, *base_features(), *flag_features(), *ROLLING_FEATURES,
            *[f"{c}_zscore" for c in Z_COLUMNS], *LATE_FEATURES]


def feature_matrix(df: DataFrame, order: str = "packet_number", bucket_rows: int = BUCKET_ROWS,
                   contiguous: bool = False, session: str | None = None) -> DataFrame:
    """Engineered packets plus every feature as a double, null and non-finite values as 0.

    Packets move once, before any feature is made: what needs only its own row or the
    global statistics is added after the windows.
    """
    rows = rolling(df, lambda packets: packets.withColumns(flag_features()), syn_ratio, rolling_statistics, protocol_entropy, diversity, burstiness,
                   order=order, bucket_rows=bucket_rows, contiguous=contiguous, session=session)
    stats = zscore_statistics(df, Z_COLUMNS)
    rows = with_zscores(rows, stats, Z_COLUMNS).withColumns(base_features())
    return rows.withColumns({name: finite(F.col(name)) for name in feature_names()})


def finite(value: Column) -> Column:
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), 0.0).otherwise(x)
