"""Stored alerts and acknowledgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.alerts import acknowledge_state
from packetloom.schemas import STORED_ALERTS

ACK_SCHEMA = "alert_id string, ack_time timestamp"


def to_stored(alerts: DataFrame, session_id: str | None = None) -> DataFrame:
    """Alert rows in their stored shape: evidence as JSON text, a description always present."""
    present = set(alerts.columns)

    def column(name: str):
        return F.col(name) if name in present else F.lit(None)

    fallback = F.concat(F.col("attack_type"), F.lit(" detected by "), column("detector_name").cast("string"))
    shaped = {
        "alert_id": F.col("alert_id"), "timestamp": F.col("timestamp"), "alert_type": F.col("attack_type"), "severity": F.col("severity"),
        "src_ip": F.col("source_ip"), "dst_ip": F.col("destination_ip"), "dst_port": column("dst_port"), "protocol": column("protocol"),
        "description": F.coalesce(F.nullif(column("description").cast("string"), F.lit("")), fallback),
        "raw_evidence": F.to_json("evidence") if "evidence" in present else F.lit(None), "detector_name": column("detector_name"),
        "confidence": column("confidence"), "session_id": F.lit(session_id) if session_id else column("session_id")}
    return alerts.select(*[shaped[f.name].cast(f.dataType).alias(f.name) for f in STORED_ALERTS])


def append_alerts(alerts: DataFrame, path: str, session_id: str | None = None) -> None:
    to_stored(alerts, session_id).write.mode("append").parquet(path)


def append_acknowledgement(spark: SparkSession, path: str, alert_ids: list[str], now) -> None:
    """Acknowledgements are only ever added; the earliest one counts."""
    spark.createDataFrame([(a, now) for a in alert_ids], ACK_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_alerts(spark: SparkSession, path: str, ack_path: str | None = None) -> DataFrame:
    alerts = spark.read.schema(STORED_ALERTS).parquet(path)
    acks = spark.read.schema(ACK_SCHEMA).parquet(ack_path) if ack_path else spark.createDataFrame([], ACK_SCHEMA)
    return acknowledge_state(alerts, acks)
