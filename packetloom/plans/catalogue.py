"""Registry of named queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.sources import fixtures

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


ENTRIES: dict[str, Entry] = {}

# Tables a SQL text may ask for by short name.
TABLES = {
    "p": fixtures.packets_sql("real"),
    "b": fixtures.packets_sql("burst"),
    "a": fixtures.alerts_sql(),
    "r": fixtures.raw_sql(),
}


def over(tables: str, body: str) -> str:
    """SQL ``body`` with the named fixture tables in front of it as CTEs."""
    ctes = ", ".join(f"{name} AS ({TABLES[name]})" for name in tables.split())
    text = body.strip()
    if text.upper().startswith("WITH "):
        return f"WITH {ctes}, {text[5:]}"
    return f"WITH {ctes} {text}"


def plain(df: DataFrame) -> DataFrame:
    """Zone-free times, so that results print alike in every engine."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])


def register(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        if name in ENTRIES:
            raise ValueError(f"query {name} registered twice")
        ENTRIES[name] = Entry(lambda spark, sf_dir: plain(build(spark, sf_dir)), sql)
        return build
    return add


def load_all() -> dict[str, Entry]:
    """Import every module that registers queries."""
    from packetloom.plans import (  # noqa: F401
        queries_alerts,
        queries_basic,
        queries_detect,
        queries_features,
        queries_models,
        queries_score,
        queries_sources,
        queries_streaming,
    )
    return ENTRIES
