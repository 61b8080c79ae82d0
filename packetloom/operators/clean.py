"""Cleaning, typing and column dialect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.text import parse_time
from packetloom.schemas import CSV_ALIASES, PACKET_BASE

NUMERIC_COLUMNS = ("packet_length", "src_port", "dst_port", "ttl", "protocol_num", "window_size")
MALFORMED_PATTERN = r"(?i)^(_WS[.])?MALFORMED"


def rename_aliases(df: DataFrame, to_long: bool = False) -> DataFrame:
    """``source_ip`` style to ``src_ip`` style; ``to_long`` goes back.

    A column is renamed only when the target name is still free.
    """
    pairs = {v: k for k, v in CSV_ALIASES.items()} if to_long else CSV_ALIASES
    present = set(df.columns)
    return df.withColumnsRenamed(
        {old: new for old, new in pairs.items() if old in present and new not in present})


def _as_int(value: Column) -> Column:
    return value.try_cast("double").try_cast("int")


def coerce_types(df: DataFrame) -> DataFrame:
    """Typed time and numbers, unreadable values null; rows without a length are dropped."""
    present = set(df.columns)
    changed: dict[str, Column] = {}
    if "timestamp" in present:
        kind = df.schema["timestamp"].dataType
        ts = F.col("timestamp")
        changed["timestamp"] = parse_time(ts) if isinstance(kind, T.StringType) else ts.cast("timestamp")
    for name in NUMERIC_COLUMNS:
        if name in present:
            changed[name] = _as_int(F.col(name))
    return df.withColumns(changed).dropna(subset=["packet_length"])


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """One copy of each fully identical row.

    Runs as a hash aggregate over all columns: copies are removed before the
    shuffle, so one row repeated very often does not overload a task.
    """
    return df.dropDuplicates()


def project_base(df: DataFrame) -> DataFrame:
    """The 14 base columns in fixed order; absent ones become typed nulls."""
    present = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PACKET_BASE.fields])


def clean_capture(df: DataFrame, ingest_time: Column) -> DataFrame:
    """Rules applied to freshly parsed packets.

    ``ingest_time`` stands in for a missing packet time; it is passed in so
    that a re-run gives the same rows.
    """
    present = set(df.columns)
    changed: dict[str, Column] = {}
    if "protocol" in present:
        changed["protocol"] = F.trim(F.upper(F.coalesce(F.col("protocol"), F.lit("UNKNOWN"))))
    for name in ("transport_layer", "network_layer"):
        if name in present:
            layer = F.trim(F.upper(F.col(name)))
            changed[name] = F.when(~layer.isin("NAN", "NONE"), layer)
    if "packet_length" in present:
        length = F.nanvl(F.coalesce(F.col("packet_length").try_cast("double"), F.lit(0.0)), F.lit(0.0))
        changed["packet_length"] = F.greatest(
            F.lit(0.0), F.least(F.lit(65535.0), length)).cast("int")
    for name in ("src_port", "dst_port", "ttl", "ip_version"):
        if name in present:
            changed[name] = _as_int(F.col(name))
    if "timestamp" in present:
        kind = df.schema["timestamp"].dataType
        ts = F.col("timestamp")
        ts = parse_time(ts) if isinstance(kind, T.StringType) else ts.cast("timestamp")
        changed["timestamp"] = F.coalesce(ts, ingest_time)
    for name in ("src_ip", "dst_ip"):
        if name in present:
            changed[name] = F.when(F.col(name) != "None", F.col(name))
    return drop_exact_duplicates(df).withColumns(changed)


def prepare_bandwidth(df: DataFrame) -> DataFrame:
    """Rows with both a time and a length.

    The order of rows is not fixed here: every later step aggregates, and a
    global sort of the packet table would be pure cost.
    """
    return coerce_types(df).dropna(subset=["timestamp"])


def normalised_protocol(protocol: Column) -> Column:
    name = F.trim(F.coalesce(protocol, F.lit("UNKNOWN")))
    return F.when(name.rlike(MALFORMED_PATTERN), "MALFORMED").otherwise(F.upper(name))


def normalise_protocols(df: DataFrame) -> DataFrame:
    """Canonical protocol names; rows without a length are dropped."""
    changed = {name: normalised_protocol(F.col(name))
               for name in ("protocol", "transport_layer") if name in df.columns}
    changed["packet_length"] = _as_int(F.col("packet_length"))
    return df.withColumns(changed).dropna(subset=["packet_length"])
