"""Ranks, limits and cooldowns on rows without a time, with ties, NaN and infinity."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from packetloom.operators import alerts, prep
from packetloom.operators.detect import run
from packetloom.operators.labels import assign_labels
from packetloom.operators.selection import cut_at_rank, exact_quantiles, top_filter, top_rows
from packetloom.sources import packets as store
from packetloom.streaming import cooldown as live
from packetloom.streaming import sinks

INF, NAN = float("inf"), float("nan")


def ranked(rows, k):
    """Rows by value, those without one last, as plain Python sees it."""
    none = lambda v: v is None or math.isnan(v)
    return sorted((v for _, v in rows), key=lambda v: (none(v), -v if not none(v) else 0))[:k]


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 3.0, INF], [1.0, NAN, 2.0, None, -INF, INF, INF, 5.0, 5.0], [NAN, None, None], [7.0] * 6, [1e308, -1e308, 0.0, 5e-324, 1.0], []])
def test_exactly_k_rows(spark, values):
    rows = list(enumerate(values))
    df = spark.createDataFrame(rows, "id int, x double")
    show = lambda vs: sorted(map(str, vs))
    for k in range(len(rows) + 2):
        got = [r.x for r in top_rows(df, ["x"], k).collect()]
        want = ranked(rows, k)
        assert len(got) == min(k, len(rows))
        missing = lambda vs: ["-" if v is None or math.isnan(v) else str(v) for v in vs]
        assert show(missing(got)) == show(missing(want))
        assert df.filter(top_filter(df, ["x"], k)).count() == min(k, len(rows))


def test_equal_rows_are_cut_too(spark):
    df = spark.createDataFrame([(1, 5)] * 6, "a int, b int")
    assert top_rows(df, ["a"], 2).count() == 2


def test_second_column_decides(spark):
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(None, i) for i in range(10)], "x int, n int")
    assert {(r.x, r.n) for r in top_rows(df, ["x", "n"], 13).collect()} == {(1, i) for i in range(10)} | {(None, i) for i in (7, 8, 9)}


def test_cut_ignores_what_is_no_value(spark):
    df = spark.createDataFrame([(NAN,), (None,), (3.0,), (1.0,), (2.0,)], "x double")
    assert cut_at_rank(df, "x", 2).value == 2.0 and cut_at_rank(df, "x", 3) is None


def test_quantiles_without_nan(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (NAN,), (NAN,), (NAN,), (NAN,), (None,)], "x double")
    assert exact_quantiles(df, ["x"], [0.5]) == {"x": [2.0]}
    filled = prep.impute(df, ["x"], prep.fit_medians(df, ["x"]))
    assert sorted(r.x for r in filled.collect()) == [1.0] + [2.0] * 6 + [3.0]
    low, high = prep.fit_bounds(df, ["x"])
    assert (low, high) == ([1.5 - 3.0], [2.5 + 3.0])


def timed(spark, n):
    """Half of the packets without a time, numbers that repeat."""
    return spark.range(n).select(
        (F.col("id") % (n // 4)).alias("packet_number"),
        F.when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))).alias("timestamp"), F.col("id").alias("session"))


@pytest.mark.parametrize("limit", [10, 400, 500, 501, 750, 1000, 2000])
def test_limits_keep_rows_without_a_time(spark, tmp_path, limit):
    timed(spark, 1000).write.parquet(f"{tmp_path}/t")
    got = store.read_table(spark, f"{tmp_path}/t", limit)
    assert got.count() == min(limit, 1000)
    assert got.filter("timestamp IS NOT NULL").count() == min(limit, 500)


@pytest.mark.parametrize("keep", [100, 500, 700, 999])
def test_retention_with_missing_times(spark, tmp_path, keep):
    timed(spark, 1000).withColumn("event_date", F.to_date("timestamp")).write.partitionBy("event_date").parquet(f"{tmp_path}/t")
    kept = store.keep_newest(spark, f"{tmp_path}/t", f"{tmp_path}/k", keep)
    assert kept.count() == keep and kept.filter("timestamp IS NOT NULL").count() == min(keep, 500)
    assert store.keep_newest(spark, f"{tmp_path}/t", f"{tmp_path}/n", 1000) is None


def test_weak_labels_keep_their_budgets(spark):
    scored = spark.range(500).select((F.col("id") % 5).alias("packet_number"), F.col("id").alias("session"),
                                     *[F.lit(1.0).alias(f"{n}_score") for n in ("syn", "ddos", "bruteforce", "portscan")])
    counts = {r[0]: r[1] for r in assign_labels(scored).groupBy("attack_label").count().collect()}
    assert counts == {"SYNFlood": 40, "DDoS": 100, "BruteForce": 60, "PortScan": 125, "BENIGN": 175}


def test_split_takes_exact_shares_of_repeated_numbers(spark):
    rows = spark.range(300).select((F.col("id") % 3).cast("string").alias("label"), F.lit(1).alias("packet_number"), "id")
    split = prep.stratified_split(rows, "label")
    assert {r[0]: r[1] for r in split.filter("is_test").groupBy("label").count().collect()} == {"0": 20, "1": 20, "2": 20}


ALERT = "alert_id string, source_ip string, attack_type string, timestamp timestamp"


def at(seconds):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=seconds) if seconds is not None else None


def test_alerts_without_a_time_stay(spark):
    df = spark.createDataFrame([("a", "h", "X", at(None)), ("b", "h", "X", at(None)), ("c", "h", "X", at(1)), ("d", "h", "X", at(2))], ALERT)
    assert {r.alert_id for r in alerts.cooldown(df, 60).collect()} == {"a", "b", "c"}


def test_streaming_cooldown_over_batches(spark, tmp_path):
    """A batch that only suppresses, alerts without a time and empty keys, one file a batch."""
    batches = [[("a", "h", "X", 100), ("n1", None, "X", 100)], [("b", "h", "X", 130), ("n2", "", "X", 120)], [("c", "h", "X", 150), ("z", "h", "X", None), ("y", "new", "X", None)],
               [("d", "h", "X", 170)], [("e", "h", "X", 215), ("n3", "", "X", 400)], [("f", "h", "X", 231)]]
    for i, batch in enumerate(batches):
        path = f"{tmp_path}/in/{i}"
        spark.createDataFrame([(*r[:3], at(r[3])) for r in batch], ALERT).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(ALERT).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    got = {r.alert_id for r in sinks.run_now(live.cooldown(stream, 60), f"{tmp_path}/out").collect()}
    rows = spark.createDataFrame([(*r[:3], at(r[3])) for b in batches for r in b], ALERT)
    assert got == {r.alert_id for r in alerts.cooldown(rows, 60).collect()} == {"a", "n1", "d", "f", "n3", "z", "y"}


def test_a_failing_detector_ends_the_run(spark, sf_dir):
    from packetloom.sources import fixtures
    packets = fixtures.packets(spark, sf_dir)

    def broken(df, limits):
        raise RuntimeError("no plan")
    detectors = (*run.DETECTORS, ("broken", 9, broken))
    with pytest.raises(RuntimeError, match="no plan"):
        run.run_detection(packets, detectors=detectors)
    failed = []
    run.run_detection(packets, detectors=detectors, failed=failed)
    assert failed == ["broken"]


def jobs_of(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        result = work()
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_ranks_of_many_keys_in_few_jobs(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    data = {f"c{i}": rng.normal(0, 10.0 ** (i % 9), 3_000).round(i % 4) for i in range(85)}
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), ", ".join(f"{c} double" for c in data)).checkpoint() if spark.sparkContext.getCheckpointDir() else \
        spark.createDataFrame(list(zip(*[v.tolist() for v in data.values()])), ", ".join(f"{c} double" for c in data))
    got, jobs = jobs_of(spark, "quantiles", lambda: exact_quantiles(df, list(data), [0.25, 0.75]))
    for c, v in data.items():
        assert np.allclose(got[c], np.quantile(v, [0.25, 0.75]), rtol=1e-12), c
    assert jobs <= 16  # some two a pass with adaptive execution


def test_quantiles_at_the_infinities(spark):
    df = spark.createDataFrame([(x,) for x in (-INF, 1.0, 2.0, INF, INF, NAN, None)], "x double")
    assert exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 1.0]) == {"x": [-INF, 1.0, 2.0, INF]}


def test_jobs_of_a_split_do_not_grow_with_the_classes(spark):
    counts = {}
    for classes in (2, 12):
        rows = spark.range(1200).select("id", F.col("id").alias("packet_number"), (F.col("id") % classes).cast("string").alias("label"))
        split, counts[classes] = jobs_of(spark, f"split-{classes}", lambda: prep.stratified_split(rows, "label"))
        assert {r["n"] for r in split.filter("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()} == {240 // classes}
    assert counts[12] <= counts[2] + 4
