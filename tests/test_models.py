"""Models, catalogue and streaming invariants."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from packetloom.models import catalog, classify, iforest
from packetloom.models.metrics import classifier_metrics
from packetloom.streaming import cooldown, sinks

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(1_000)] + [(1_000 + i, 50.0 + i, -50.0) for i in range(5)]
    return spark.createDataFrame(rows, "packet_number long, a double, b double").cache()


def test_planted_outliers_rank_first(spark, points, tmp_path):
    forest = iforest.train(points, ["a", "b"], trees=60)
    scored = iforest.classify(points, forest)
    worst = [r[0] for r in scored.orderBy("anomaly_score").limit(5).collect()]
    assert set(worst) == set(range(1_000, 1_005))
    low, high, share = scored.agg(F.min("anomaly_score"), F.max("anomaly_score"), F.avg((F.col("anomaly_label") == "ANOMALY").cast("int"))).first()
    assert -1 <= low <= high <= 0 and 0.03 <= share <= 0.07
    again = iforest.train(points.repartition(7), ["a", "b"], trees=60)
    assert again.trees == forest.trees and again.cutoff == forest.cutoff
    iforest.save(spark, forest, str(tmp_path / "f"))
    assert iforest.load(spark, str(tmp_path / "f")) == forest


def test_unfitted_models_call_everything_normal(points):
    assert iforest.classify(points, None).filter("anomaly_label <> 'NORMAL'").count() == 0
    assert classify.classify(points, None).filter("is_attack OR predicted_label <> 'BENIGN'").count() == 0


def test_path_length_constant():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert iforest.average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_classifier_reaches_the_target(spark):
    rng = random.Random(2)
    rows = [(i, label, base + rng.random(), rng.random()) for i in range(900) for label, base in [(("BENIGN", 0), ("DDoS", 5), ("PortScan", 9))[i % 3]]]
    df = spark.createDataFrame(rows, "packet_number long, attack_label string, a double, b double")
    model = classify.train(df, ["a", "b"], estimator=classify.random_forest(trees=8, depth=4))
    assert classify.class_names(model) == ["BENIGN", "DDoS", "PortScan"]
    row = classifier_metrics(classify.classify(df, model), "attack_label", "predicted_label").first()
    assert min(row.accuracy, row.precision_macro, row.recall_macro, row.f1_macro) >= 0.90
    top = classify.feature_importance(model, ["a", "b"], df).first()
    assert top.feature == "a"
    unlabelled = classify.classify(df.drop("attack_label"), model)
    assert abs(unlabelled.filter("is_attack").count() - 600) <= 10


def test_catalogue_has_one_active_version(spark, tmp_path):
    store = catalog.Catalog(spark, str(tmp_path / "c"))
    assert store.load("m") is None
    rows = spark.createDataFrame([(i, "a" if i % 2 else "b", float(i % 2)) for i in range(20)], "packet_number long, attack_label string, x double")
    model = classify.train(rows, ["x"], estimator=classify.random_forest(trees=2, depth=2))
    first = store.save(model, "m", {"f1": 0.5}, now=dt.datetime(2024, 1, 1))
    second = store.save(model, "m", {"f1": 0.6}, now=dt.datetime(2024, 1, 2))
    store.save(model, "other", now=dt.datetime(2024, 1, 3))
    assert [r.version for r in store.entries("m", active_only=True).collect()] == [second]
    store.promote("m", first, dt.datetime(2024, 1, 4))
    assert [r.version for r in store.entries("m", active_only=True).collect()] == [first]
    assert store.load("m") is not None and store.entries().count() == 3
    with pytest.raises(ValueError):
        store.promote("m", "none")


def test_stream_cooldown_over_several_batches(spark, tmp_path):
    rng = random.Random(9)
    times = sorted(rng.randrange(0, 5_000) for _ in range(200))
    source = tmp_path / "in"
    source.mkdir()
    schema = "alert_id string, source_ip string, attack_type string, timestamp timestamp"
    for part in range(4):
        rows = [(f"n{i:04}", f"s{i % 3}", "x", START + dt.timedelta(seconds=t)) for i, t in list(enumerate(times))[part * 50:part * 50 + 50]]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source / f"p{part}"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    kept = {r[0] for r in sinks.run_now(cooldown.cooldown(live, 60), str(tmp_path / "run")).select("alert_id").collect()}
    last, expected = {}, set()
    for i, t in enumerate(times):
        if i % 3 not in last or t - last[i % 3] >= 60:
            last[i % 3] = t
            expected.add(f"n{i:04}")
    assert kept == expected


def test_repeated_batches_leave_no_copies(spark, tmp_path):
    sink = sinks.write_batch(str(tmp_path / "t"))
    batch = spark.range(5)
    for _ in range(2):
        sink(batch, 0)
    sink(spark.range(5, 7), 1)
    assert sinks.read_batches(spark, str(tmp_path / "t"), batch).count() == 7
