"""Spark session settings used by jobs and tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every job relies on.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def sized_for(input_bytes: int, cores: int) -> dict[str, str]:
    """Shuffle and scan settings for an input of this size.

    AQE joins small partitions but never adds any, so the starting number must
    fit the largest shuffle: the packet rows once over, at 256 MB a task.  At
    100 TB that is some 400 000 tasks per full shuffle, and far fewer rows
    after partial aggregation, which AQE then joins.
    """
    target = 256 * 1024 * 1024
    return {
        "spark.sql.shuffle.partitions": str(max(cores, -(-input_bytes // target))),
        "spark.sql.files.maxPartitionBytes": str(target if input_bytes > 100 * target * cores // 10 else 128 * 1024 * 1024),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target // 2),
    }


def build_session(app_name: str = "packetloom", master: str | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Session with the settings above; ``extra`` wins over them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**BASE_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: every timestamp in this library is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    On a cluster this is ``spark.checkpoint.dir``, set by whoever runs it.  Where it is unset
    and the master is local, as in tests, a folder in the warehouse is taken; elsewhere that
    is an error, as no other folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root
