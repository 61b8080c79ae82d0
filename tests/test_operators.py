"""Distributed algorithms against brute force on small random data."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.models.metrics import auc
from packetloom.operators import alerts as al
from packetloom.operators import bottlenecks, features, health, labels, prep, timeseries
from packetloom.operators.profile import positions
from packetloom.operators.selection import cut_at_rank, exact_quantiles, top_rows
from packetloom.sources import fixtures

START = dt.datetime(2024, 1, 1)


def keep_by_loop(rows, window):
    last, kept = {}, set()
    for source, kind, t, name in sorted(rows, key=lambda r: (r[2], r[3])):
        if (source, kind) not in last or t - last[source, kind] >= window:
            last[source, kind] = t
            kept.add(name)
    return kept


@pytest.mark.parametrize("window, light_limit", [(60, 1000), (60, 0), (3_600, 0), (86_400 * 3, 0), (0, 0)])
def test_cooldown_equals_a_loop(spark, window, light_limit):
    rng = random.Random(window + light_limit)
    rows = [("hot", "x", rng.randrange(0, 40 * 86_400) if i % 2 else rng.randrange(20 * 86_400, 20 * 86_400 + 4_000), f"n{i:05}") for i in range(3_000)]
    rows += [(f"s{i % 7}", "y", rng.randrange(0, 10_000), f"m{i:05}") for i in range(300)]
    df = spark.createDataFrame([(n, s, k, START + dt.timedelta(seconds=t)) for s, k, t, n in rows],
                               "alert_id string, source_ip string, attack_type string, timestamp timestamp")
    kept = {r[0] for r in al.cooldown(df, window, light_limit=light_limit).select("alert_id").collect()}
    expected = keep_by_loop(rows, window) if window else {r[3] for r in rows}
    assert kept == expected


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1_000])
def test_top_rows_equals_a_sort(spark, k):
    rng = random.Random(k)
    rows = [(float(rng.choice([0.0, 1.5, rng.random() * 1e6, -3.25])), i) for i in range(1_000)]
    df = spark.createDataFrame(rows, "score double, id long")
    got = {tuple(r) for r in top_rows(df, ["score", "id"], k).collect()}
    assert got == set(sorted(rows, reverse=True)[:k])


def test_cut_handles_constant_and_huge_values(spark):
    df = spark.createDataFrame([(5,)] * 10, "x long")
    assert cut_at_rank(df, "x", 3).taken == 3
    df = spark.createDataFrame([(2 ** 62 + i,) for i in range(50)], "x long")
    assert cut_at_rank(df, "x", 5).value == 2 ** 62 + 45
    assert cut_at_rank(df, "x", 50) is None


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=5_000), "b": rng.integers(0, 4, 5_000).astype(float), "c": np.exp(rng.normal(size=5_000) * 4)}
    df = spark.createDataFrame(list(zip(*(map(float, v) for v in data.values()))), "a double, b double, c double")
    probabilities = [0.0, 0.05, 0.25, 0.5, 0.75, 1.0]
    for limit in (2_000_000, 40):
        got = exact_quantiles(df, list(data), probabilities, accuracy=200, exact_limit=limit)
        for name, values in data.items():
            assert np.allclose(got[name], np.quantile(values, probabilities), rtol=1e-9)


def test_positions_are_dense(spark):
    times = [START + dt.timedelta(hours=7 * i) for i in range(60)]
    df = spark.createDataFrame([(t,) for t in times], "interval_start timestamp").repartition(5)
    got = [(r.pos, r.n) for r in positions(df).orderBy("interval_start").collect()]
    assert got == [(i + 1, 60) for i in range(60)]


def test_growth_halves_by_position(spark):
    df = spark.createDataFrame([(START + dt.timedelta(seconds=s), n) for s, n in ((0, 1), (1, 2), (50, 3), (51, 4), (99, 5))],
                               "interval_start timestamp, packets long")
    assert health.growth_rate(df).first()[0] == 3.0  # (3+4+5 - 3) / 3
    assert health.growth_rate(df.limit(1)).first()[0] == 0.0


def test_queue_growth_leaves_the_last_slice_out(spark):
    def share(values):
        df = spark.createDataFrame([(START + dt.timedelta(minutes=i), v) for i, v in enumerate(values)], "interval_start timestamp, bytes long")
        rows = bottlenecks.queue_growth(df).collect()
        return rows[0].metric_value if rows else None
    assert share([1, 2, 3, 4, 5]) == 100.0
    assert share([1, 2, 3, 4, 1]) == 100.0
    assert share([1, 2, 3]) is None
    assert share([3, 2, 1, 2, 3]) is None


def test_zero_filled_minutes_cross_midnight(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 23, 58, 30), 10), (dt.datetime(2024, 1, 2, 0, 2, 1), 20)], "timestamp timestamp, packet_length int")
    got = [(r.packets, r.bytes) for r in timeseries.minute_timeline(df).orderBy("minute").collect()]
    assert got == [(1, 10), (0, 0), (0, 0), (0, 0), (1, 20)]


def test_bucketed_windows_equal_one_window(spark, sf_dir):
    packets = features.engineer(fixtures.packets(spark, sf_dir)).withColumns(features.flag_features())
    steps = (features.syn_ratio, features.rolling_statistics, features.protocol_entropy, features.diversity, features.burstiness)
    names = ["packet_number", *features.ROLLING_FEATURES, *features.LATE_FEATURES]
    small = features.rolling(packets, *steps, bucket_rows=64).select(*names)
    whole = features.rolling(packets, *steps, bucket_rows=10 ** 6, contiguous=True).select(*names)
    assert small.exceptAll(whole).count() == 0 and small.count() == packets.count()


def test_rolling_equals_pandas(spark, sf_dir):
    packets = fixtures.packets(spark, sf_dir)
    got = features.rolling(packets, features.rolling_statistics, bucket_rows=50).orderBy("packet_number").toPandas()
    series = packets.orderBy("packet_number").toPandas()["packet_length"].astype(float)
    for w in features.WINDOWS:
        r = series.rolling(w, min_periods=1)
        for name, expected in (("mean", r.mean()), ("std", r.std().fillna(0.0)), ("min", r.min()), ("max", r.max())):
            assert np.allclose(got[f"packet_length_w{w}_{name}"], expected)


def test_frames_stay_in_their_session(spark, sf_dir):
    """Sessions of 1, 40 and 700 packets with numbers of their own, gaps, repeats and a null session."""
    rng = random.Random(3)
    rows = []
    for name, n, step in (("one", 1, 1), ("short", 40, 1), (None, 90, 7), ("long", 700, 1), ("wide", 200, 10 ** 6)):
        rows += [(name, i * step + 1, rng.randrange(40, 1500), rng.randrange(1, 9), rng.randrange(1, 9), 64) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session string, packet_number long, packet_length int, src_port int, dst_port int, ttl int")
    got = features.rolling(df, features.rolling_statistics, bucket_rows=60, session="session").toPandas()
    assert len(got) == len(rows)
    for name, part in got.fillna({"session": "?"}).groupby("session"):
        part = part.sort_values("packet_number")
        r = part["packet_length"].astype(float).rolling(30, min_periods=1)
        assert np.allclose(part["packet_length_w30_mean"], r.mean()) and np.allclose(part["packet_length_w30_max"], r.max()), name


def test_packets_move_once_for_all_features(spark, tmp_path, sf_dir):
    path = str(tmp_path / "engineered")
    features.engineer(fixtures.packets(spark, sf_dir)).write.parquet(path)
    plan = features.feature_matrix(spark.read.parquet(path), bucket_rows=64)._jdf.queryExecution().executedPlan().toString()
    # the rows, the statistics, and the latter's one row
    assert plan.count("FileScan parquet") + plan.count("Scan ExistingRDD") <= 3 and plan.count("Exchange hashpartitioning") == 1


def test_feature_list_is_stable():
    names = features.feature_names()
    assert len(names) == len(set(names)) and not {"packet_number", "session_id"} & set(names)


def test_smote_stays_between_neighbours_and_fills_up(spark):
    rng = random.Random(1)
    rows = [(i, "big", rng.random(), rng.random()) for i in range(400)] + [(1000 + i, "small", 10 + rng.random(), 20 + rng.random()) for i in range(9)]
    df = spark.createDataFrame(rows, "packet_number long, attack_label string, a double, b double")
    made = labels.smote(df, ["a", "b"], target=50)
    counts = {r.attack_label: r["count"] for r in made.groupBy("attack_label").count().collect()}
    assert counts == {"big": 400, "small": 50}
    low = made.filter("attack_label = 'small'").agg(F.min("a"), F.max("a"), F.min("b"), F.max("b")).first()
    assert low[0] >= 10 and low[1] <= 11 and low[2] >= 20 and low[3] <= 21
    again = labels.smote(df, ["a", "b"], target=50)
    assert made.exceptAll(again).count() == 0
    single = spark.createDataFrame(rows[:400] + rows[400:401], df.schema)
    assert labels.smote(single, ["a", "b"], target=50).count() == 401


def test_oversampling_is_repeatable(spark):
    df = spark.createDataFrame([(i, "a" if i < 290 else "b") for i in range(300)], "packet_number long, attack_label string")
    one, two = (labels.random_oversample(df, target=100) for _ in range(2))
    assert one.exceptAll(two).count() == 0
    assert one.filter("attack_label = 'b'").count() == 100 and one.filter("attack_label = 'a'").count() == 290


def test_split_is_stratified_even_for_tiny_classes(spark):
    df = spark.createDataFrame([(i, "a" if i < 1_000 else "b") for i in range(1_010)], "packet_number long, y string")
    got = {r.y: r.t for r in prep.stratified_split(df, "y").groupBy("y").agg(F.count_if("is_test").alias("t")).collect()}
    assert got == {"a": 200, "b": 2}


def test_preprocessing_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 1.0, None if i % 5 == 0 else float(i * i)) for i in range(100)], "a double, constant double, c double")
    fitted = prep.fit(df, ["a", "constant", "c"])
    assert fitted.kept_names == ("a", "c")
    prep.save(spark, fitted, str(tmp_path / "p"))
    assert prep.load(spark, str(tmp_path / "p")) == fitted
    scaled = prep.apply(df, fitted).agg(F.avg("a"), F.stddev_pop("a"), F.avg("c"), F.stddev_pop("c")).first()
    assert np.allclose(scaled, [0, 1, 0, 1], atol=1e-9)


def test_auc_with_ties(spark):
    rows = [(True, 0.9), (True, 0.5), (False, 0.5), (False, 0.1), (True, 0.1)]
    df = spark.createDataFrame(rows, "y boolean, s double")
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert auc(df, F.col("y"), F.col("s")).first()[0] == pytest.approx(sum(pairs) / len(pairs))


def test_one_hot_key_over_many_stretches(spark):
    rng = random.Random(21)
    rows = [("hot", "x", rng.randrange(0, 86_400_000), f"n{i:06}") for i in range(60_000)]
    df = spark.createDataFrame([(n, s, k, START + dt.timedelta(milliseconds=t)) for s, k, t, n in rows], "alert_id string, source_ip string, attack_type string, timestamp timestamp")
    for window in (30, 20_000):
        kept = {r[0] for r in al.cooldown(df, window, light_limit=500).select("alert_id").collect()}
        assert kept == keep_by_loop(rows, window * 1_000)
