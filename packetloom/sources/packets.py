"""Reading, ingesting and writing packet tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.flags import hex_text
from packetloom.functions.ports import determine_app_hint, determine_protocol
from packetloom.functions.text import epoch_to_timestamp, parse_time
from packetloom.operators.browse import newest
from packetloom.operators.clean import clean_capture, project_base
from packetloom.operators.features import engineer, running_offsets
from packetloom.operators.selection import cut_at_rank, top_rows
from packetloom.operators.traffic import ingest_summary
from packetloom.schemas import CSV_ALIASES, DISSECTED, PACKETS
from packetloom.session import checkpoint_root

SPLIT_TABLE_LIMIT = 1_000_000
_LONG_NAMES = {short: long for long, short in CSV_ALIASES.items()}


# ---- readers ----------------------------------------------------------------------

def read_csv(spark: SparkSession, path: str, must_have_rows: bool = False) -> DataFrame:
    """Packet CSV files (one file, a folder or a glob) with the fixed 23-column layout.

    A missing path is an error; ``must_have_rows`` also refuses an empty one.
    """
    kinds = {T.TimestampType(): T.StringType()}
    schema = T.StructType([T.StructField(_LONG_NAMES.get(f.name, f.name), kinds.get(f.dataType, f.dataType)) for f in PACKETS])
    rows = spark.read.schema(schema).option("header", True).csv(path)
    if must_have_rows and rows.isEmpty():
        raise ValueError(f"no packets in {path}")
    return rows.withColumnsRenamed(CSV_ALIASES).withColumn("timestamp", parse_time(F.col("timestamp")))


def read_table(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Packet table; with ``limit`` only the newest rows.

    The limit becomes a cut-off found by counting, so no task holds ``limit``
    rows; rows without a time come after all others.
    """
    rows = spark.read.parquet(path).drop("session")
    if limit is None:
        return newest(rows, None)
    timed = rows.withColumn("_t", F.unix_micros("timestamp"))
    return top_rows(timed, ["_t", "packet_number"], limit).drop("_t")


def load_packets(spark: SparkSession, path: str, source: str = "csv", limit: int | None = None) -> DataFrame:
    if source == "csv":
        return read_csv(spark, path)
    if source == "table":
        return read_table(spark, path, limit)
    raise ValueError(f"unknown source {source!r}: use 'csv' or 'table'")


def read_dissected(spark: SparkSession, path: str, kind: str = "json") -> DataFrame:
    """Dissector export (JSON lines or CSV with header), with where each row came from."""
    reader = spark.read.schema(DISSECTED)
    rows = reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
    return rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                       F.monotonically_increasing_id().alias("_id"))


# ---- ingest -----------------------------------------------------------------------

def number_rows(df: DataFrame) -> DataFrame:
    """Rows of :func:`read_dissected` plus ``packet_number`` 1, 2, 3 ... in file order.

    The export is parsed once and written, with where each row came from; the rows of every
    file split are counted from what was written, and a row's number is the count before
    its split plus its place inside it.  So numbers and rows cannot come from two different
    ways of splitting, and how the files are split does not show in the numbers.  Rows are
    not shuffled.  A split without a count ends the job instead of losing its rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/parsed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    df = spark.read.schema(df.schema).parquet(path)
    splits = df.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # files in name order, splits in file order; the file level holds one row per file
    files = splits.groupBy("_file").agg(F.sum("_n").alias("_rows"))
    files = files.withColumn("_k", F.row_number().over(Window.orderBy("_file"))).select("_file", "_k", "_rows")
    before_file = running_offsets(files, "_k", "_rows").join(files, "_k").select("_file", "_before")
    inside = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block")) - F.col("_n")
    table = splits.withColumn("_in", inside).join(before_file, "_file").select(
        "_file", "_block", (F.col("_before") + F.col("_in")).alias("_offset"), "_first")
    return numbered_by(df, table)


def numbered_by(df: DataFrame, table: DataFrame) -> DataFrame:
    """Rows with the number that ``table`` (``_file``, ``_block``, ``_offset``, ``_first``) gives them; one without is an error."""
    # a split is some 128 MB of text: only a very large export exceeds the limit
    if table.limit(SPLIT_TABLE_LIMIT + 1).count() <= SPLIT_TABLE_LIMIT:
        table = F.broadcast(table)
    number = F.col("_offset") + F.col("_id") - F.col("_first") + 1
    lost = F.raise_error(F.concat(F.lit("rows of a split without a count: "), F.col("_file"), F.lit(" at "), F.col("_block").cast("string"))).cast("long")
    return df.join(table, ["_file", "_block"], "left").withColumn(
        "packet_number", F.when(F.col("_offset").isNotNull(), number).otherwise(lost)).drop("_file", "_block", "_id", "_offset", "_first")


def _int(name: str) -> Column:
    return F.col(name).try_cast("int")


def to_records(df: DataFrame, ingest_time: Column, skip_non_ip: bool = False) -> DataFrame:
    """Dissected fields to packet records; columns only, no shuffle.

    Addresses come from IPv4, else IPv6, else ARP; ports from TCP, else UDP.
    """
    v4, v6, arp = (F.col(c).isNotNull() for c in ("ip_src", "ipv6_src", "arp_src"))
    tcp = F.col("tcp_srcport").isNotNull() | F.col("tcp_flags").isNotNull() | F.col("tcp_dstport").isNotNull()
    udp = F.col("udp_srcport").isNotNull() | F.col("udp_dstport").isNotNull()

    def layer(four, six, address):
        return F.when(v4, four).when(v6, six).when(arp, address)

    transport = F.when(tcp, "TCP").when(udp, "UDP").when(F.coalesce(F.col("has_icmp"), F.lit(False)), "ICMP") \
        .when(F.coalesce(F.col("has_icmpv6"), F.lit(False)), "ICMPv6")
    records = df.select(
        *(["packet_number"] if "packet_number" in df.columns else []),
        epoch_to_timestamp(F.col("sniff_timestamp"), ingest_time).alias("timestamp"),
        layer(F.col("ip_src"), F.col("ipv6_src"), F.col("arp_src")).alias("src_ip"),
        layer(F.col("ip_dst"), F.col("ipv6_dst"), F.col("arp_dst")).alias("dst_ip"),
        transport.alias("transport_layer"), F.coalesce(_int("length"), _int("captured_length"), F.lit(0)).alias("packet_length"),
        F.when(tcp, _int("tcp_srcport")).when(udp, _int("udp_srcport")).alias("src_port"),
        F.when(tcp, _int("tcp_dstport")).when(udp, _int("udp_dstport")).alias("dst_port"),
        layer(_int("ip_ttl"), _int("ipv6_hlim"), F.lit(None).cast("int")).alias("ttl"),
        F.when(tcp, hex_text(F.col("tcp_flags"))).alias("tcp_flags"),
        layer(F.lit("IPv4"), F.lit("IPv6"), F.lit("ARP")).alias("network_layer"),
        layer(F.lit(4), F.lit(6), F.lit(None).cast("int")).alias("ip_version"), "highest_layer")
    named = records.withColumn("protocol", determine_protocol(
        F.col("highest_layer"), F.col("transport_layer"), F.col("src_port"), F.col("dst_port")))
    hinted = named.withColumn("app_layer_hint", determine_app_hint(F.col("src_port"), F.col("dst_port"), F.col("protocol")))
    if skip_non_ip:
        hinted = hinted.filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    return project_base(hinted)


# ---- writers ----------------------------------------------------------------------

def append_table(df: DataFrame, path: str, session_id: str | None = None) -> None:
    """Add the packets of one or more sessions, one folder a day and session.

    What the table holds of these sessions is replaced: folders that are written anew are
    swapped as the job commits, and days that a session no longer has are taken out after
    that.  So a repeated or restarted run leaves the rows of one run.  The rebalance hint
    lets AQE cut a day holding most rows into several files and join small days.
    """
    rows = df.withColumns({"session_id": F.lit(session_id).cast("string") if session_id or "session_id" not in df.columns
                           else F.col("session_id"), "event_date": F.to_date("timestamp")})
    rows = rows.withColumn("session", session_folder(F.col("session_id")))
    rows.hint("rebalance", F.col("event_date"), F.col("session")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("event_date", "session").parquet(path)
    # one name a folder that this call has written, from a scan of two columns
    written = {(str(r["event_date"] or "__HIVE_DEFAULT_PARTITION__"), r["session"]) for r in rows.select("event_date", "session").distinct().collect()}
    _remove_other_days(df.sparkSession, path, written)


def session_folder(session_id: Column) -> Column:
    """The folder name of a session; never read as a number."""
    return F.concat(F.lit("s-"), F.coalesce(F.sha2(session_id, 256).substr(1, 16), F.lit("none")))


def _remove_other_days(spark: SparkSession, path: str, written: set[tuple[str, str]]) -> None:
    """Take out the folders of the sessions in ``written`` (day, session) of days that are not."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for session in sorted({s for _, s in written}):
        pattern = jvm.Path(f"{path}/event_date=*/session={session}")
        files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.globStatus(pattern) or []:
            if (status.getPath().getParent().getName().removeprefix("event_date="), session) not in written:
                files.delete(status.getPath(), True)


def export_csv(df: DataFrame, path: str) -> None:
    """Header CSV files with the long column names; a folder, written by all tasks."""
    names = [f.name for f in PACKETS if f.name in df.columns]
    rows = df.select(*[F.col(n).alias(_LONG_NAMES.get(n, n)) for n in names])
    if "timestamp" in names:
        rows = rows.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def run_ingest(spark: SparkSession, export_path: str, table_path: str, session_id: str, ingest_time: Column,
               csv_path: str | None = None, kind: str = "json", skip_non_ip: bool = False) -> DataFrame:
    """Dissector export to packet table and CSV; gives the one-row summary.

    The table is written first and everything after reads it back, so the
    export is parsed once and a lost executor costs no re-parse.
    """
    records = to_records(number_rows(read_dissected(spark, export_path, kind)), ingest_time, skip_non_ip)
    # cleaned packets are written before frequencies are counted, so the export is parsed and cleaned once
    path = f"{checkpoint_root(spark)}/cleaned-{uuid.uuid4().hex}"
    clean_capture(records, ingest_time).write.parquet(path)
    append_table(engineer(spark.read.parquet(path)), table_path, session_id)
    # only the session's folders are read back
    written = spark.read.parquet(table_path).filter(F.col("session") == session_folder(F.lit(session_id))).drop("session")
    if csv_path:
        export_csv(written, csv_path)
    return ingest_summary(written)


def keep_newest(spark: SparkSession, path: str, target: str, keep: int = 1_000_000) -> DataFrame | None:
    """Retention: write the newest ``keep`` packets of ``path`` to ``target``.

    Days wholly after the cut-off pass through by partition pruning; only the
    boundary day is compared row by row.  Gives the kept rows, or None when
    nothing has to go.  Packets without a time are the oldest.
    """
    rows = spark.read.parquet(path).drop("session").withColumn("_t", F.unix_micros("timestamp"))
    if rows.count() <= keep:
        return None
    cut = cut_at_rank(rows, "_t", keep)
    if cut is None:  # all packets with a time stay
        timeless = rows.filter(F.col("_t").isNull())
        return _rewritten(spark, rows.filter(F.col("_t").isNotNull()).unionByName(
            top_rows(timeless, ["packet_number"], keep - rows.filter(F.col("_t").isNotNull()).count())), target)
    day = F.to_date(F.timestamp_micros(F.lit(cut.value)))
    boundary = top_rows(rows.filter(F.col("event_date") == day), ["_t", "packet_number"],
                        keep - rows.filter(F.col("event_date") > day).count())
    return _rewritten(spark, rows.filter(F.col("event_date") > day).unionByName(boundary), target)


def _rewritten(spark: SparkSession, rows: DataFrame, target: str) -> DataFrame:
    rows.drop("_t").hint("rebalance", F.col("event_date")).write.mode("overwrite").partitionBy("event_date").parquet(target)
    return spark.read.parquet(target)
