"""Continuous detection: every batch is cleaned, stored, judged and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from packetloom.models.metrics import anomaly_alert
from packetloom.operators.clean import clean_capture
from packetloom.operators.detect.common import Thresholds
from packetloom.operators.detect.run import run_detection
from packetloom.operators.traffic import basic_stats
from packetloom.sources.alerts import to_stored
from packetloom.streaming.sinks import start


def process_batch(root: str, limits: Thresholds = Thresholds(), ingest_time: Column | None = None,
                  anomaly_test: Callable[[DataFrame], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: packets, statistics and alerts of the batch, each in its own folder.

    Folders are named by batch and overwritten when a batch is repeated, so a
    restart after a failure leaves neither gaps nor copies.  Later steps read
    the stored packets of the batch instead of computing them again.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        cleaned = clean_capture(batch, ingest_time if ingest_time is not None else F.current_timestamp())
        folder = f"batch_id={batch_id}"
        cleaned.write.mode("overwrite").parquet(f"{root}/packets/{folder}")
        packets = spark.read.parquet(f"{root}/packets/{folder}")
        basic_stats(packets).write.mode("overwrite").parquet(f"{root}/statistics/{folder}")
        alerts = to_stored(run_detection(packets, limits))
        if anomaly_test is not None:
            flagged = anomaly_alert(packets, anomaly_test(packets)).withColumns({
                "alert_id": F.md5(F.concat(F.lit(f"{batch_id}|"), F.col("attack_type"))), "detector_name": F.lit("Isolation Forest")})
            alerts = alerts.unionByName(to_stored(flagged))
        alerts.write.mode("overwrite").parquet(f"{root}/alerts/{folder}")
    return run


def start_detection(packets: DataFrame, root: str, limits: Thresholds = Thresholds(), every: str | None = "5 seconds",
                    ingest_time: Column | None = None, anomaly_test: Callable[[DataFrame], Column] | None = None) -> StreamingQuery:
    """Run on a stream of packets; ``every=None`` handles what is there and stops."""
    return start(packets, process_batch(root, limits, ingest_time, anomaly_test), f"{root}/checkpoint", every=every)
