"""Model catalogue: saved models and two append-only tables of what happened to them."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTRY_SCHEMA = "model_key string, version string, created_at timestamp, path string, metrics string, details string"
PROMOTE_SCHEMA = "model_key string, version string, promoted_at timestamp"


def with_active(entries: DataFrame, promotions: DataFrame) -> DataFrame:
    """Entries plus ``is_active``: per key the version promoted last, and only that one."""
    order = Window.partitionBy("model_key").orderBy(F.desc("promoted_at"), F.desc("version"))
    active = (promotions.withColumn("_r", F.row_number().over(order)).filter("_r = 1")
              .select("model_key", "version", F.lit(True).alias("is_active")))
    return entries.join(active, ["model_key", "version"], "left").withColumn("is_active", F.coalesce("is_active", F.lit(False)))


class Catalog:
    """Catalogue below one folder of shared storage."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/{table}")

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")
        except Exception as exc:  # nothing saved yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def save(self, model, model_key: str, metrics: dict | None = None, details: dict | None = None,
             now: dt.datetime | None = None) -> str:
        """Write a new version and make it the active one; gives the version.

        ``model`` is a fitted pipeline, or a function that writes to the path it is given.
        """
        now = now or dt.datetime.now(dt.timezone.utc)
        version = now.strftime("%Y%m%dT%H%M%S%f")
        path = f"{self.root}/models/{model_key}/{version}"
        model(path) if callable(model) and not hasattr(model, "write") else model.write().save(path)
        self._append("entries", (model_key, version, now, path, json.dumps(metrics or {}), json.dumps(details or {})), ENTRY_SCHEMA)
        self.promote(model_key, version, now)
        return version

    def promote(self, model_key: str, version: str, now: dt.datetime | None = None) -> None:
        known = self._read("entries", ENTRY_SCHEMA).filter((F.col("model_key") == model_key) & (F.col("version") == version))
        if known.isEmpty():
            raise ValueError(f"no version {version} of {model_key}")
        self._append("promotions", (model_key, version, now or dt.datetime.now(dt.timezone.utc)), PROMOTE_SCHEMA)

    def entries(self, model_key: str | None = None, active_only: bool = False) -> DataFrame:
        table = with_active(self._read("entries", ENTRY_SCHEMA), self._read("promotions", PROMOTE_SCHEMA))
        if model_key:
            table = table.filter(F.col("model_key") == model_key)
        return table.filter("is_active") if active_only else table

    def active_path(self, model_key: str) -> str | None:
        row = self.entries(model_key, active_only=True).select("path").first()
        return row[0] if row else None

    def load(self, model_key: str) -> PipelineModel | None:
        """Active pipeline of ``model_key``; None when there is none, so that scoring is skipped."""
        path = self.active_path(model_key)
        return PipelineModel.load(path) if path else None
