"""Alert management: cooldown, counts, timelines, tables, acknowledgement, retention."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.selection import top_rows
from packetloom.operators.timeseries import fill_minutes, floor_time
from packetloom.functions.text import interval_seconds
from packetloom.schemas import SEVERITIES
from packetloom.session import checkpoint_root

# Attack families, matched by prefix in this order.
FAMILIES = ("DDoS", "PortScan", "BruteForce", "SYNFlood")
NOT_A_HOST = ("MULTIPLE", "UNKNOWN", "")
KEY = ("source_ip", "attack_type")


def severity_rank(severity: Column) -> Column:
    """1 for LOW to 4 for CRITICAL, 0 for anything else."""
    rank = F.lit(0)
    for i, name in enumerate(SEVERITIES, start=1):
        rank = F.when(severity == name, i).otherwise(rank)
    return rank


def literal_rows(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """A small fixed list as rows, made in the JVM."""
    return df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))


# ---- cooldown ------------------------------------------------------------------

STRETCH_ROWS = 50_000  # alert times that one task walks at a time
FAN_IN = 32  # stretches whose maps are merged into one
_NEVER = np.iinfo(np.int64).min


def cooldown(alerts: DataFrame, window_seconds: float, tiebreak: str = "alert_id",
             light_limit: int = STRETCH_ROWS) -> DataFrame:
    """Per (source, attack type) keep an alert when the last *kept* one is old enough.

    The clock restarts only on kept alerts, so the choice is a chain along time.  The alert
    times are sorted by key and time over all tasks and cut into stretches of
    ``light_limit`` rows, whatever keys they hold.  A key within one stretch is walked
    there.  Of a key that goes on in further stretches, each stretch tells where every
    possible entry leaves it; those maps are merged in a tree, the entries are handed down
    again, and each stretch is walked from its entry.  So a hot key is as many tasks as it
    has stretches.  A map is never larger than the alert times of its key within one window
    from its first.

    Alerts with equal times count as one; the smallest ``tiebreak`` stands for them.  Alerts
    without a time all stay; a null source or type is the same key as an empty one.
    """
    if window_seconds <= 0:
        return alerts
    window = int(window_seconds * 1_000_000)
    keyed = alerts.withColumns({"_t": F.unix_micros("timestamp"),
                                **{f"_{k}": F.coalesce(F.col(k), F.lit("")) for k in KEY}})
    keys = [f"_{k}" for k in KEY]
    kept = _kept_times(keyed, keys, tiebreak, window, max(2, light_limit))
    same = [F.col(f"a.{k}") == F.col(f"k.{k}") for k in [*keys, "_t"]]
    timed = keyed.alias("a").join(kept.alias("k"), [*same, F.col(f"a.{tiebreak}").cast("string") == F.col("k._first")], "left_semi")
    return timed.drop("_t", *keys).unionByName(alerts.filter(F.col("timestamp").isNull()))


def _kept_times(keyed: DataFrame, keys: list[str], tiebreak: str, window: int, rows: int) -> DataFrame:
    checkpoint_root(keyed.sparkSession)
    sorted_times = (keyed.filter(F.col("_t").isNotNull())
                    .groupBy(*keys, "_t").agg(F.min(F.col(tiebreak).cast("string")).alias("_first"))
                    .repartitionByRange(*keys, "_t").sortWithinPartitions(*keys, "_t"))
    # task and row of the sorted table, fixed by writing it
    place = F.monotonically_increasing_id()
    times = sorted_times.withColumn("_stretch", F.shiftright(place, 33) * (1 << 33) + F.floor((place % (1 << 33)) / rows)).checkpoint()
    spans = times.groupBy(*keys).agg(F.min("_stretch").alias("_from"), F.max("_stretch").alias("_to")).filter("_from != _to")
    entries = _entries(times.join(spans.select(*keys), keys, "left_semi"), keys, window)
    ddl = ", ".join(f"{k} string" for k in keys) + ", _t long, _first string"

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*keys, "_t"]).reset_index(drop=True)
        t, enter = group["_t"].to_numpy(np.int64), group["_enter"].fillna(_NEVER).to_numpy(np.int64)
        new = np.append(True, (group[keys].to_numpy()[1:] != group[keys].to_numpy()[:-1]).any(axis=1))
        begins = np.flatnonzero(new)
        ends = np.append(begins[1:], len(t))
        at = np.array([b + np.searchsorted(t[b:e], enter[b]) for b, e in zip(begins, ends)])
        kept = []
        for place, end in zip(at, ends):
            while place < end:
                kept.append(place)
                place += int(np.searchsorted(t[place:end], t[place] + window))
        return group.loc[kept, [*keys, "_t", "_first"]]

    # an entry belongs to one key of a stretch, so no others are held back by it
    return times.join(entries, [*keys, "_stretch"], "left").groupBy("_stretch").applyInPandas(walk, ddl)


def _squeezed(until: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map without steps that lead to the same exit."""
    edge = np.append(leave[1:] != leave[:-1], True)
    return until[edge], leave[edge]


def _through(until: np.ndarray, leave: np.ndarray, free_from: np.ndarray, window: int) -> np.ndarray:
    """When the next alert may be kept after a stretch that was entered at ``free_from``."""
    at = np.searchsorted(until, free_from)
    return np.where(at < len(until), leave[np.minimum(at, len(until) - 1)] + window, free_from)


def _merged(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The map of two stretches in a row: exits of the first enter the second, later entries pass the first by."""
    later = then[0] > first[0][-1]
    leave = _through(*then, first[1] + window, window) - window
    return _squeezed(np.append(first[0], then[0][later]), np.append(leave, then[1][later]))


def _entries(times: DataFrame, keys: list[str], window: int) -> DataFrame:
    """(key, stretch, time from which an alert may be kept there) of keys over several stretches."""
    head = ", ".join(f"{k} string" for k in keys)
    map_ddl = f"{head}, _stretch long, _until array<long>, _leave array<long>, _start long"

    def row(group: pd.DataFrame, until: np.ndarray, leave: np.ndarray, start: int, stretch: int) -> pd.DataFrame:
        use = np.searchsorted(until, start + window) + 1  # no entry is later than a window after the first time
        return pd.DataFrame({**{k: [group[k].iloc[0]] for k in keys}, "_stretch": [stretch], "_until": [until[:use].tolist()], "_leave": [leave[:use].tolist()], "_start": [start]})

    def summarise(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group["_t"].to_numpy(np.int64))
        follow = np.searchsorted(t, t + window)
        # pointer doubling: the last alert reached from each possible entry
        last = np.where(follow < len(t), np.minimum(follow, len(t) - 1), np.arange(len(t)))
        while not np.array_equal(further := last[last], last):
            last = further
        return row(group, *_squeezed(t, t[last]), int(t[0]), int(group["_stretch"].iloc[0]))

    def parts(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(np.asarray(u, np.int64), np.asarray(v, np.int64)) for u, v in zip(group["_until"], group["_leave"])]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_stretch")
        whole, *others = parts(group)
        for part in others:
            whole = _merged(whole, part, window)
        return row(group, *whole, int(group["_start"].iloc[0]), int(group["_parent"].iloc[0]))

    def hand_down(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_stretch")
        free_from, entries = np.int64(group["_enter"].iloc[0]), []
        for part in parts(group):
            entries.append(int(free_from))
            free_from = _through(*part, np.array([free_from]), window)[0]
        return pd.DataFrame({**{k: group[k] for k in keys}, "_stretch": group["_stretch"], "_enter": entries})

    level = times.groupBy(*keys, "_stretch").applyInPandas(summarise, map_ddl)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("_stretch")) - 1
    levels = [level.withColumn("_parent", F.floor(number / FAN_IN)).checkpoint()]
    while not levels[-1].filter("_parent > 0").isEmpty():
        above = levels[-1].groupBy(*keys, "_parent").applyInPandas(merge, map_ddl)
        levels.append(above.withColumn("_parent", F.floor(F.col("_stretch") / FAN_IN)).checkpoint())
    entries = levels[-1].select(*keys, "_parent").distinct().withColumn("_enter", F.lit(int(_NEVER)))
    for level in reversed(levels):
        entries = level.join(entries, [*keys, "_parent"]).groupBy(*keys, "_parent").applyInPandas(hand_down, f"{head}, _stretch long, _enter long").withColumnRenamed("_stretch", "_parent")
    return entries.withColumnRenamed("_parent", "_stretch")


# ---- counts ----------------------------------------------------------------------

def highest_severity(alerts: DataFrame) -> DataFrame:
    """One row with the worst severity, NONE when there are no alerts."""
    return alerts.agg(F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))),
                                 F.lit("NONE")).alias("highest_severity"))


def detector_yield(alerts: DataFrame, detectors: list[tuple[str, int, bool]]) -> DataFrame:
    """(detector_name, priority, enabled, alert_count) for every detector, found or not."""
    listed = alerts.sparkSession.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(name).alias("detector_name"), F.lit(priority).alias("priority"), F.lit(enabled).alias("enabled"))
        for name, priority, enabled in detectors])))
    counts = alerts.groupBy("detector_name").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(listed).join(counts, "detector_name", "left").select(
        "detector_name", "priority", "enabled", F.coalesce("n", F.lit(0)).alias("alert_count"))


def by_type(alerts: DataFrame, prefix: str) -> DataFrame:
    return alerts.filter(F.col("attack_type").startswith(prefix))


def at_or_above(alerts: DataFrame, severity: str) -> DataFrame:
    """Alerts of the given rank or worse, worst first."""
    least = SEVERITIES.index(severity.upper()) + 1 if severity.upper() in SEVERITIES else 0
    rank = severity_rank(F.col("severity"))
    return alerts.filter(rank >= least).orderBy(F.desc(rank), F.desc("timestamp"))


def attack_family(attack_type: Column) -> Column:
    family = F.lit("Other")
    for name in reversed(FAMILIES):
        family = F.when(attack_type.startswith(name), name).otherwise(family)
    return family


def _counts_with_zeros(alerts: DataFrame, label: Column, column: str, values: tuple[str, ...]) -> DataFrame:
    counts = alerts.groupBy(label.alias(column)).agg(F.count(F.lit(1)).alias("n"))
    return literal_rows(alerts, column, values).join(counts, column, "left").select(
        column, F.coalesce("n", F.lit(0)).alias("alerts"))


def attack_counts(alerts: DataFrame) -> DataFrame:
    return _counts_with_zeros(alerts, attack_family(F.col("attack_type")), "family", (*FAMILIES, "Other"))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """All four severities; text that is none of them counts as LOW."""
    level = F.upper("severity")
    label = F.when(level.isin(*SEVERITIES), level).otherwise("LOW")
    return _counts_with_zeros(alerts, label, "severity", SEVERITIES)


def attack_timeline(alerts: DataFrame, freq: str = "1min") -> DataFrame:
    """Alerts per interval from first to last, empty intervals as 0."""
    seconds = interval_seconds(freq)
    counts = (alerts.filter(F.col("timestamp").isNotNull())
              .groupBy(floor_time(F.col("timestamp"), seconds).alias("minute"))
              .agg(F.count("attack_type").alias("alerts")))
    return fill_minutes(counts, "alerts", seconds=seconds).withColumnRenamed("minute", "interval_start")


def alert_trend(alerts: DataFrame) -> DataFrame:
    """Alerts per five minutes; empty slots are absent."""
    return (alerts.filter(F.col("timestamp").isNotNull())
            .groupBy(floor_time(F.col("timestamp"), 300).alias("interval_start"))
            .agg(F.count(F.lit(1)).alias("alerts")))


def alert_table(alerts: DataFrame) -> DataFrame:
    """Display rows, worst first and newest first among equals."""
    rank = severity_rank(F.col("severity"))
    shown = alerts.select(
        F.concat(F.substring("alert_id", 1, 8), F.lit("…")).alias("short_id"), "timestamp", "attack_type",
        "severity", F.concat(F.bround(F.col("confidence") * 100, 0).cast("int").cast("string"), F.lit("%")).alias("confidence"),
        "source_ip", "destination_ip", "detector_name",
        F.substring(F.coalesce("description", F.lit("")), 1, 120).alias("description"), rank.alias("_rank"))
    return shown.orderBy(F.desc("_rank"), F.desc("timestamp")).drop("_rank")


def top_hosts(alerts: DataFrame, column: str, n: int = 10) -> DataFrame:
    return (alerts.filter(F.col(column).isNotNull() & ~F.col(column).isin(*NOT_A_HOST))
            .groupBy(F.col(column).alias("ip")).agg(F.count(F.lit(1)).alias("alerts"))
            .orderBy(F.desc("alerts"), F.asc("ip")).limit(n))


def alert_summary(alerts: DataFrame, n: int = 10) -> DataFrame:
    """One record: totals, families, severities, worst, mean confidence, top hosts, detectors."""
    level = F.upper("severity")
    family = attack_family(F.col("attack_type"))
    record = alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(family == name).alias(f"family_{name.lower()}") for name in (*FAMILIES, "Other")],
        F.count_if((level == "LOW") | ~level.isin(*SEVERITIES)).alias("severity_low"),
        *[F.count_if(level == name).alias(f"severity_{name.lower()}") for name in SEVERITIES[1:]],
        F.coalesce(F.max_by("severity", severity_rank(F.col("severity"))), F.lit("NONE")).alias("highest_severity"),
        F.coalesce(F.round(F.avg("confidence"), 3), F.lit(0.0)).alias("avg_confidence"))
    for column, name in (("source_ip", "top_sources"), ("destination_ip", "top_targets")):
        ranked = top_hosts(alerts, column, n).select((-F.col("alerts")).alias("_o"), "ip", "alerts")
        record = record.crossJoin(ranked.agg(F.transform(
            F.sort_array(F.collect_list(F.struct("_o", "ip", "alerts"))),
            lambda x: F.struct(x["ip"].alias("ip"), x["alerts"].alias("alerts"))).alias(name)))
    detectors = alerts.groupBy("detector_name").agg(F.count(F.lit(1)).alias("alerts"))
    return record.crossJoin(detectors.agg(
        F.sort_array(F.collect_list(F.struct("detector_name", "alerts"))).alias("detector_counts")))


def threat_level(alerts: DataFrame, *by: str) -> DataFrame:
    """Worst severity present, LOW when there is none; one row, or one a value of ``by``."""
    worst = F.max(severity_rank(F.upper("severity")))
    return alerts.groupBy(*by).agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]),
                                   F.greatest(F.lit(1), F.coalesce(worst, F.lit(1)))).alias("threat_level"))


# ---- state ------------------------------------------------------------------------

def acknowledge_state(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """Alerts with their first acknowledgement; later ones change nothing.

    Acknowledgements are appended as (alert_id, ack_time), never updated.
    """
    first = acks.groupBy("alert_id").agg(F.min("ack_time").alias("acknowledged_at"))
    return alerts.join(first, "alert_id", "left").withColumn(
        "is_acknowledged", F.col("acknowledged_at").isNotNull())


def keep_latest(alerts: DataFrame, n: int = 10_000, order: str = "seq") -> DataFrame:
    """The ``n`` alerts inserted last, as a filter on the insertion number."""
    return top_rows(alerts, [order], n)

