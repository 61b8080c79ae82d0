"""Dataset and training jobs, folds, and what they rest on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from packetloom.models import classify, training
from packetloom.operators import alerts, features, prep, selection
from packetloom.sources import fixtures


def test_from_packets_to_judged_models(spark, sf_dir, tmp_path):
    packets = fixtures.packets(spark, sf_dir)
    dataset = training.build_dataset(packets, str(tmp_path / "data"))
    names = features.feature_names()
    assert dataset.columns == ["packet_number", *names, "attack_label"] and dataset.count() == packets.count()
    split = training.split_dataset(dataset, str(tmp_path / "split"))
    assert split.train.join(split.test, "packet_number").count() == 0 and split.train.count() + split.test.count() == packets.count()

    some = ["packet_length", "dst_port", "src_ip_frequency", "syn_ack_ratio", "flag_syn", "dst_port_nunique_w30"]
    anomaly = training.train_anomaly_model(split, some, trees=10)
    assert anomaly.fitted_rows == split.train.filter("attack_label = 'BENIGN'").count()
    assert anomaly.judged.n_samples == split.test.count()
    training.save_anomaly_model(spark, anomaly, str(tmp_path / "anomaly"))
    again = training.load_anomaly_model(spark, str(tmp_path / "anomaly"))
    flagged = [m.classify(split.test, ["packet_number"]).filter("anomaly_label = 'ANOMALY'").select("packet_number").orderBy("packet_number").collect() for m in (anomaly, again)]
    assert flagged[0] == flagged[1]

    attack = training.train_attack_model(split, some, estimator=classify.random_forest(trees=5, depth=5))
    assert attack.judged.n_samples == split.test.count() and attack.judged.accuracy > 0.6
    assert attack.classify(split.test, ["packet_number"]).filter("predicted_label IS NULL").count() == 0


def test_few_benign_rows_fit_on_all(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("packet_number"), F.when(F.col("id") < 6, "BENIGN").otherwise("DDoS").alias("attack_label"), F.rand(1).alias("x"))
    split = training.split_dataset(rows, str(tmp_path / "s"))
    assert training.train_anomaly_model(split, ["x"], trees=3).fitted_rows == split.train.count()


def test_folds_of_every_class_differ_by_one_row(spark):
    rows = spark.range(1000).select(F.col("id").alias("packet_number"), F.when(F.col("id") % 100 == 0, "rare").when(F.col("id") % 3 == 0, None).otherwise("most").alias("label"))
    for cells in (1, 16, 4096):
        folds = classify.stratified_folds(rows, "label", 4, cells=cells)
        sizes = {}
        for r in folds.groupBy("label", "fold").count().collect():
            sizes.setdefault(r["label"], []).append(r["count"])
        assert folds.count() == 1000 and all(len(s) <= 4 and max(s) - min(s + [0] * (4 - len(s))) <= 1 for s in sizes.values())


def test_columns_without_values_are_not_clipped(spark):
    rows = spark.createDataFrame([(1.0, None), (2.0, None), (90.0, None)], "x double, y double")
    low, high = prep.fit_bounds(rows, ["x", "y"])
    assert (low[1], high[1]) == (float("-inf"), float("inf")) and low[0] < high[0]
    assert prep.apply(rows, prep.fit(rows, ["x", "y"])).count() == 3


def test_ties_of_rows_with_maps(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"a{i}", start, {"k": str(i), "j": "x"}, [i], (i,)) for i in range(5)]
    df = spark.createDataFrame(rows, "alert_id string, timestamp timestamp, evidence map<string,string>, ports array<int>, s struct<a:int>")
    kept = selection.top_rows(df.withColumn("t", F.unix_micros("timestamp")), ["t"], 2)
    assert kept.count() == 2
    assert alerts.keep_latest(df.withColumn("seq", F.lit(1)), 3).count() == 3


def test_area_with_an_outlying_score(spark):
    import random

    import numpy as np
    from packetloom.models import metrics
    rng = random.Random(2)
    rows = [(rng.random() < 0.4, round(rng.random(), 3)) for _ in range(3000)] + [(True, 1e300), (False, -1e12), (True, 0.5)]
    df = spark.createDataFrame(rows, "good boolean, s double")
    good, bad = (np.array([s for g, s in rows if g is want]) for want in (True, False))
    want = ((good[:, None] > bad).sum() + 0.5 * (good[:, None] == bad).sum()) / (len(good) * len(bad))
    assert abs(metrics.auc(df, F.col("good"), F.col("s")).first()["auc"] - want) < 1e-12
    cuts = [0.1 * i for i in range(11)] + [1e300]
    bins = df.select(metrics._bin_of(F.col("s"), F.array(*map(F.lit, cuts))).alias("b"), "s").orderBy("s").collect()
    assert [r.b for r in bins] == sorted(r.b for r in bins) and len({r.b for r in bins}) > 500
