"""Sinks and runners shared by the streaming operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: each batch owns one folder and rewrites it when it is repeated."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return run


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append",
          every: str | None = None) -> StreamingQuery:
    """Start the query: a trigger interval for live use, else all data present now and stop."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_batches(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Rows of all batches; an empty frame of the stream's layout when none were written."""
    schema = like.schema.add("batch_id", "long")
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch_id=*")
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def latest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last written state per key, for sinks in update mode."""
    others = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch_id").alias("r")).select(*keys, "r.*")


def run_now(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available, then read the sink."""
    query = start(stream, write_batch(f"{path}/out"), f"{path}/checkpoint", mode)
    query.awaitTermination()
    return read_batches(stream.sparkSession, f"{path}/out", stream)
