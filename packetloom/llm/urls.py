"""URL filter as a sort-merge range join: rules are intervals of reversed-host keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import fresh, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _levels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) with their sort key and ``stack``: all rules whose interval holds the key, widest first.

    The key is the reversed host, ``/`` and the path, so that a rule covers exactly the
    keys that start with its own; of equal rules a block wins.
    """
    named = rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(
        F.concat(F.array_join(_levels(F.col("host")), "."), F.lit("/"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict", F.size(_levels(F.col("host"))).alias("labels"))
    prefixes = named.select("key", F.explode(F.sequence(F.locate("/", F.col("key")), F.length("key"))).alias("size"))
    prefixes = prefixes.select(F.col("key").alias("of"), F.expr("substring(key, 1, size)").alias("key"))
    stacks = named.join(prefixes, "key").groupBy(F.col("of").alias("key")).agg(
        F.array_sort(F.collect_list(F.struct(F.length("key").alias("width"), "key", "rule", "verdict"))).alias("stack"))
    return named.join(stacks, "key")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of every url.

    A rule fits its host and all subdomains where the path starts with the rule's; the
    longest fitting one wins, the longer host first among equals.  Without one, ``rule`` is
    null and the verdict ``default``.  A null url, and one without ``://``, has an empty
    host and path.  Rules that repeat count once; no rules at all give the default.
    Columns of ``pages`` with the names of the results are replaced.

    Every distinct (host, path) gives one key a host level, as many levels as the rule
    with most labels has.  Keys and rules are range-partitioned and sorted together; as
    rules nest or are disjoint, those that hold a key are among the stack of the last rule
    at or before it.  The last rule of earlier partitions is handed on by a table of one
    row a partition, the only thing broadcast.  Hot hosts and urls are one key each here,
    and their rows come back by a plain join that the runtime may split.
    """
    spark = pages.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ruled = stored(rule_table(rules), "url-rules")
    most = ruled.agg(F.max("labels")).first()[0] or 0
    split = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    levels = F.transform(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(max(most, 1)))),
                         lambda n: F.array_join(F.slice("_labels", 1, n), "."))
    keys = split.select("host", "path").distinct().withColumn("_labels", _levels(F.col("host"))).withColumn("_level", F.explode(levels)).select(
        F.concat("_level", F.lit("/"), "path").alias("key"), F.lit(1).alias("kind"), "host", "path",
        F.lit(None).cast(ruled.schema["stack"].dataType).alias("stack"))
    starts = ruled.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    events = stored(keys.unionByName(starts).repartitionByRange(parts, "key", "kind", "host").withColumn("part", F.spark_partition_id()), "url-events")
    ends = events.groupBy("part").agg(F.max_by("stack", F.when(F.col("kind") == 0, F.col("key"))).alias("stack"))
    handed = ends.select("part", F.last("stack", ignorenulls=True).over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    swept = swept.join(F.broadcast(handed), "part", "left").select(
        "host", "path", F.explode(F.filter(F.coalesce("active", "handed"), lambda r: F.col("key").startswith(r["key"]))).alias("r"))
    found, = fresh(pages, "found")
    best = swept.groupBy("host", "path").agg(F.max(F.struct(
        F.length("r.rule").alias("size"), F.locate("/", F.col("r.key")).alias("host_size"), F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))).alias(found))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return split.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", F.col(f"{found}.rule").alias("rule"), F.coalesce(f"{found}.verdict", F.lit(default)).alias("verdict"))
