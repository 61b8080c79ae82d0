"""Newest-first queries with filters and pages, and row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, limit: int | None = None, offset: int = 0,
           tiebreak: str = "packet_number") -> DataFrame:
    """Newest rows first; without a limit all rows stay (unordered).

    With a limit Spark keeps the best ``limit + offset`` rows of each task and
    merges those, so the table itself is never sorted.
    """
    if limit is None:
        return df
    ordered = df.orderBy(F.desc_nulls_last("timestamp"), F.desc(tiebreak))
    return (ordered.offset(offset) if offset else ordered).limit(limit)


def _equals(filters: dict[str, object | None]) -> Column:
    test = F.lit(True)
    for name, value in filters.items():
        if value is not None:
            test = test & (F.col(name) == F.lit(value))
    return test


def recent_traffic(df: DataFrame, limit: int = 100, offset: int = 0, protocol: str | None = None,
                   src_ip: str | None = None, label: str | None = None) -> DataFrame:
    """Newest packets with optional equality filters, which reach the scan."""
    rows = df.filter(_equals({"protocol": protocol, "src_ip": src_ip, "label": label}))
    return newest(rows, limit, offset)


def browser_filter(df: DataFrame, src_ip: str | None = None, dst_ip: str | None = None,
                   protocol: str | None = None, min_length: int | None = None,
                   max_length: int | None = None) -> DataFrame:
    """Filters of the packet browser: address patterns (any case), protocol, length range."""
    test = _equals({"protocol": protocol})
    for name, pattern in (("src_ip", src_ip), ("dst_ip", dst_ip)):
        if pattern:
            test = test & F.coalesce(F.col(name).rlike(f"(?i){pattern}"), F.lit(False))
    if min_length is not None:
        test = test & (F.col("packet_length") >= min_length)
    if max_length is not None:
        test = test & (F.col("packet_length") <= max_length)
    return df.filter(test)


def packets_page(df: DataFrame, page: int = 1, page_size: int = 100, **filters) -> tuple[DataFrame, DataFrame]:
    """One page of the filtered packets, newest first, and the total count of matches.

    Filters come before the page cut, so every page but the last is full.
    """
    rows = browser_filter(df, **filters)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return newest(rows, page_size, (page - 1) * page_size), total


def alert_query(alerts: DataFrame, limit: int = 50, severity: str | None = None,
                alert_type: str | None = None, unacknowledged_only: bool = False,
                tiebreak: str = "alert_id") -> DataFrame:
    rows = alerts.filter(_equals({"severity": severity, "attack_type": alert_type}))
    if unacknowledged_only:
        rows = rows.filter(~F.coalesce(F.col("is_acknowledged"), F.lit(False)))
    return newest(rows, limit, tiebreak=tiebreak)


def status_counts(packets: DataFrame, alerts: DataFrame) -> DataFrame:
    """One status row: packets, alerts, open alerts."""
    open_alert = ~F.coalesce(F.col("is_acknowledged"), F.lit(False)) \
        if "is_acknowledged" in alerts.columns else F.lit(True)
    return packets.agg(F.count(F.lit(1)).alias("packets")).crossJoin(alerts.agg(
        F.count(F.lit(1)).alias("alerts"), F.count_if(open_alert).alias("unacknowledged_alerts")))
