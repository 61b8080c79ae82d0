"""Queries over models, scoring and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.flags import feature_flags, has_bit
from packetloom.models import catalog, classify, iforest, metrics, training
from packetloom.operators import prep
from packetloom.operators.detect.run import all_alerts
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_detect import _LOW, run_sql
from packetloom.plans.queries_features import PREP, SCALED, SCALE_SQL
from packetloom.session import checkpoint_root
from packetloom.sources import fixtures

INPUTS = ["packet_length", "src_port", "dst_port", "ttl", "flag_syn", "flag_ack"]
_TARGET = "CASE WHEN src_ip = '192.168.1.8' THEN 'PortScan' WHEN dst_port IN (22, 3389) THEN 'BruteForce' ELSE 'BENIGN' END"


def P(spark, d) -> DataFrame:
    return fixtures.packets(spark, d)


def model_rows(spark, d) -> DataFrame:
    mask = feature_flags(F.col("tcp_flags"))
    return P(spark, d).withColumns({"flag_syn": has_bit(mask, 2).cast("int"), "flag_ack": has_bit(mask, 16).cast("int"), "attack_label": F.expr(_TARGET)})


def scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


# ---- anomaly model ---------------------------------------------------------------

@register("o1_forest_training", over("p", "SELECT CAST(50 AS INT) AS trees, true AS samples_bounded, true AS share_near_target, count(*) AS rows FROM p"))
def _(spark, d):
    rows = model_rows(spark, d)
    forest = iforest.train(rows, INPUTS, trees=50)
    scored = iforest.classify(rows, forest)
    bounded = all(len(t[0]) <= 2 * forest.sample for t in forest.trees)
    return scored.agg(F.lit(len(forest.trees)).alias("trees"), F.lit(bounded).alias("samples_bounded"),
                      (F.abs(F.avg((F.col("anomaly_label") == "ANOMALY").cast("double")) - 0.05) < 0.02).alias("share_near_target"), F.count(F.lit(1)).alias("rows"))


@register("o2_forest_scores", over("p", "SELECT packet_number, true AS in_range, true AS label_follows_cutoff FROM p"))
def _(spark, d):
    rows = model_rows(spark, d)
    forest = iforest.train(rows, INPUTS, trees=25)
    path = scratch(spark, "forest")
    iforest.save(spark, forest, path)
    scored = iforest.classify(rows, iforest.load(spark, path))
    return scored.select("packet_number", (F.col("anomaly_score").between(-1, 0) & F.col("anomaly_probability").between(0, 1)).alias("in_range"),
                         ((F.col("anomaly_score") < forest.cutoff) == (F.col("anomaly_label") == "ANOMALY")).alias("label_follows_cutoff"))


def _held(n: str) -> str:
    """Rows that a class of ``n`` rows gives to the test part."""
    return f"CAST(floor({n} * 0.2::DOUBLE + 0.5) AS BIGINT)"


@register("o1_benign_training", over("p", f"""WITH c AS (SELECT {_TARGET} AS l, count(*) AS n FROM p GROUP BY 1) SELECT CAST(sum(n) FILTER (WHERE l = 'BENIGN') - sum({_held('n')}) FILTER (WHERE l = 'BENIGN') AS BIGINT) AS fitted_rows,
    CAST(sum({_held('n')}) AS BIGINT) AS test_rows, CAST(sum({_held('n')}) FILTER (WHERE l <> 'BENIGN') AS BIGINT) AS test_attacks, CAST({len(INPUTS)} AS INT) AS inputs FROM c"""))
def _(spark, d):
    """Fitted on benign rows of the training part alone, judged on rows that neither part of the fit has seen."""
    split = training.split_dataset(model_rows(spark, d).select("packet_number", "attack_label", *INPUTS), scratch(spark, "split"))
    model = training.train_anomaly_model(split, INPUTS, trees=20)
    judged = split.test.agg(F.count(F.lit(1)).alias("test_rows"), F.count_if(F.col("attack_label") != "BENIGN").alias("test_attacks"))
    return judged.select(F.lit(model.fitted_rows).cast("long").alias("fitted_rows"), "test_rows", "test_attacks", F.lit(len(model.fitted.input_names)).alias("inputs"))


# two trees written down: splits at packet_length 400, dst_port 100 and ttl 64
_TREES = (((0, -1, 1, -1, -1), (400.0, 0.0, 100.0, 0.0, 0.0), (1, -1, 3, -1, -1), (2, -1, 4, -1, -1), (0.0, 1.5, 0.0, 3.0, 6.25)),
          ((2, -1, -1), (64.0, 0.0, 0.0), (1, -1, -1), (2, -1, -1), (0.0, 2.0, 4.5)))
FIXED_FOREST = iforest.Forest(("packet_length", "dst_port", "ttl"), 256, _TREES, -0.8, -0.7, 0.1)


@register("o2_fixed_forest", over("p", f"""WITH s AS (SELECT packet_number, -power(2, -(((CASE WHEN packet_length <= 400 THEN 1.5 WHEN dst_port <= 100 THEN 3.0 ELSE 6.25 END + CASE WHEN ttl <= 64 THEN 2.0 ELSE 4.5 END)::DOUBLE / 2)
    / {iforest.average_path(256)!r}::DOUBLE)) AS s FROM p) SELECT packet_number, round(s, 8) AS anomaly_score, CASE WHEN s < -0.8 THEN 'ANOMALY' ELSE 'NORMAL' END AS anomaly_label,
    round(1 / (1 + exp((s + 0.7::DOUBLE) / 0.1::DOUBLE)), 8) AS anomaly_probability FROM s"""))
def _(spark, d):
    return iforest.classify(P(spark, d), FIXED_FOREST).select("packet_number", F.round("anomaly_score", 8).alias("anomaly_score"), "anomaly_label", F.round("anomaly_probability", 8).alias("anomaly_probability"))


@register("o3_strongest_features", over("p", f"""WITH {SCALE_SQL}, u AS (UNPIVOT sc ON {', '.join(SCALED)} INTO NAME name VALUE v)
    SELECT packet_number, string_agg(name, ',' ORDER BY r) AS strongest FROM (SELECT *, row_number() OVER (PARTITION BY packet_number ORDER BY abs(v) DESC, name) AS r FROM u) WHERE r <= 2 GROUP BY 1"""))
def _(spark, d):
    from packetloom.plans.queries_features import holes
    rows = holes(spark, d)
    scaled = prep.apply(rows, prep.fit(rows, PREP), ["packet_number"])
    return scaled.select("packet_number", F.array_join(F.transform(iforest.strongest_features(SCALED, 2), lambda x: x["name"]), ",").alias("strongest"))


# ---- classifiers -----------------------------------------------------------------

def small_forest():
    return classify.random_forest(trees=10, depth=6)


@register("o4_random_forest", over("p", "SELECT count(*) AS rows, true AS accurate FROM p"))
def _(spark, d):
    rows = model_rows(spark, d)
    scored = classify.classify(rows, classify.train(rows, INPUTS, estimator=small_forest()))
    return metrics.classifier_metrics(scored, "attack_label", "predicted_label").select(F.col("n_samples").alias("rows"), (F.col("accuracy") >= 0.9).alias("accurate"))


@register("o5_boosted_trees", over("p", "SELECT count(*) AS rows, true AS accurate FROM p"))
def _(spark, d):
    rows = model_rows(spark, d)
    scored = classify.classify(rows, classify.train(rows, INPUTS, estimator=classify.boosted_trees(rounds=3, depth=4)))
    return metrics.classifier_metrics(scored, "attack_label", "predicted_label").select(F.col("n_samples").alias("rows"), (F.col("accuracy") >= 0.9).alias("accurate"))


@register("o6_batch_classification", over("p", f"SELECT packet_number, {_TARGET} AS attack_label, true AS consistent FROM p"))
def _(spark, d):
    rows = model_rows(spark, d)
    scored = classify.classify(rows, classify.train(rows, INPUTS, estimator=small_forest()))
    best = F.array_max(F.map_values("class_probabilities"))
    return scored.select("packet_number", "attack_label", (
        (F.abs(best - F.col("confidence")) < 1e-4) & (F.col("is_attack") == (F.col("predicted_label") != "BENIGN"))).alias("consistent"))


# Scored rows made from the packet view, so that evaluation can be checked in SQL.
_CLASSES = ("DNS", "TCP", "UDP", "_WS.MALFORMED", "icmp")
_PREDICTED = "CASE WHEN packet_length % 5 = 0 THEN 'TCP' WHEN packet_length % 7 = 0 THEN 'DNS' ELSE protocol END"


def _prob(k: int, cls: str) -> str:
    return f"round(cast((packet_number * {k + 3}) % 97 AS double) / 100 + CASE WHEN protocol = '{cls}' THEN 0.2 ELSE 0 END, 4)"


def predictions(spark, d) -> DataFrame:
    parts = [x for k, cls in enumerate(_CLASSES) for x in (F.lit(cls), F.expr(_prob(k, cls)))]
    return P(spark, d).withColumns({
        "predicted_label": F.expr(_PREDICTED), "class_probabilities": F.create_map(*parts),
        "confidence": F.expr("cast(packet_length % 100 AS double) / 100"), "is_attack": F.expr(f"{_PREDICTED} <> 'DNS'"),
        "flagged": F.expr("packet_length > 900 OR dst_port > 3389"), "is_bad": F.expr("protocol = '_WS.MALFORMED'"),
        "anomaly_score": F.expr("-cast(packet_length AS double) / 2000")})


PRED_SQL = f"""y AS (SELECT *, {_PREDICTED} AS pl, packet_length > 900 OR dst_port > 3389 AS flagged, protocol = '_WS.MALFORMED' AS is_bad, packet_length::DOUBLE / 2000 AS strange FROM p),
  pc AS (SELECT c.label, count(*) FILTER (WHERE protocol = c.label AND pl = c.label)::DOUBLE AS hit, count(*) FILTER (WHERE protocol = c.label)::DOUBLE AS act, count(*) FILTER (WHERE pl = c.label)::DOUBLE AS prd
    FROM y, (SELECT DISTINCT protocol AS label FROM p) c GROUP BY 1),
  pm AS (SELECT *, CASE WHEN prd > 0 THEN hit / prd ELSE 0 END AS precision, hit / act AS recall, 2 * hit / (act + prd) AS f1 FROM pc)"""


@register("o7_classifier_metrics", over("p", f"""WITH {PRED_SQL} SELECT round(sum(hit) / sum(act), 6) AS accuracy, round(avg(precision), 6) AS precision_macro, round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro,
    round(sum(precision * act) / sum(act), 6) AS precision_weighted, round(sum(recall * act) / sum(act), 6) AS recall_weighted, round(sum(f1 * act) / sum(act), 6) AS f1_weighted,
    CAST(sum(act) AS BIGINT) AS n_samples, count(*) AS n_classes FROM pm"""))
def _(spark, d):
    row = metrics.classifier_metrics(predictions(spark, d), "protocol", "predicted_label")
    return row.select(*[F.round(c, 6).alias(c) if c[0] != "n" else c for c in row.columns])


@register("o7_per_class_metrics", over("p", f"WITH {PRED_SQL} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(act AS BIGINT) AS support FROM pm"))
def _(spark, d):
    return metrics.per_class(predictions(spark, d), "protocol", "predicted_label").select(
        "label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _auc_sql(positive: str, score: str, source: str) -> str:
    return f"""SELECT (sum(r) FILTER (WHERE pos) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos)::DOUBLE * count(*) FILTER (WHERE NOT pos)) AS auc
      FROM (SELECT {positive} AS pos, rank() OVER (ORDER BY {score}) + (count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS r FROM {source})"""


@register("o7_one_vs_rest_auc", over("p", "SELECT round(avg(auc), 6) AS roc_auc FROM (" + " UNION ALL ".join(
    _auc_sql(f"protocol = '{c}'", _prob(k, c), "p") for k, c in enumerate(_CLASSES)) + ")"))
def _(spark, d):
    return metrics.one_vs_rest_auc(predictions(spark, d), "protocol", "class_probabilities").select(F.round("roc_auc", 6).alias("roc_auc"))


@register("o7_confusion_matrix", over("p", f"WITH {PRED_SQL} SELECT protocol AS actual, pl AS predicted, count(*) AS rows FROM y GROUP BY 1, 2"))
def _(spark, d):
    return metrics.confusion(predictions(spark, d), "protocol", "predicted_label")


@register("o8_anomaly_metrics", over("p", f"""WITH {PRED_SQL}, z AS (SELECT count(*) AS n_samples, count(*) FILTER (WHERE is_bad AND flagged) AS true_positive, count(*) FILTER (WHERE NOT is_bad AND flagged) AS false_positive,
    count(*) FILTER (WHERE is_bad AND NOT flagged) AS false_negative, count(*) FILTER (WHERE NOT is_bad AND NOT flagged) AS true_negative FROM y)
    SELECT round((true_positive + false_positive)::DOUBLE / n_samples, 6) AS anomaly_rate, z.*, round((true_positive + true_negative)::DOUBLE / n_samples, 6) AS accuracy,
    round(coalesce(true_positive::DOUBLE / nullif(true_positive + false_positive, 0), 0), 6) AS precision, round(true_positive::DOUBLE / (true_positive + false_negative), 6) AS recall,
    round(2.0::DOUBLE * true_positive / (2 * true_positive + false_positive + false_negative), 6) AS f1, round(({_auc_sql('is_bad', 'strange', 'y')}), 6) AS roc_auc FROM z"""))
def _(spark, d):
    row = metrics.anomaly_metrics(predictions(spark, d), F.col("flagged"), F.col("is_bad"), F.col("anomaly_score"))
    return row.withColumns({c: F.round(c, 6) for c in ("anomaly_rate", "accuracy", "precision", "recall", "f1", "roc_auc")})


@register("o9_cross_validation")
def _(spark, d):
    rows = model_rows(spark, d).select("packet_number", "attack_label", *INPUTS)
    scores = classify.cross_validate(rows, INPUTS, folds=3, estimator=classify.random_forest(trees=3, depth=4))
    return scores.crossJoin(classify.cross_validation_summary(scores))


_FOLDS = f"""c AS (SELECT {_TARGET} AS label, count(*) AS n FROM p GROUP BY 1), f AS (SELECT label, n, fold, n // 5 + (fold < n % 5)::BIGINT AS rows FROM c, range(5) r(fold))"""


@register("o9_fold_sizes", over("p", f"WITH {_FOLDS} SELECT label AS attack_label, CAST(fold AS INT) AS fold, rows FROM f"))
def _(spark, d):
    folds = classify.stratified_folds(model_rows(spark, d), folds=5)
    return folds.groupBy("attack_label", "fold").agg(F.count(F.lit(1)).alias("rows"))


@register("o9_scores_of_a_constant", over("p", f"""WITH {_FOLDS}, t AS (SELECT fold, sum(rows) AS total, max(rows) FILTER (WHERE label = 'BENIGN') AS hit, count(*) AS classes FROM f GROUP BY 1)
    SELECT CAST(fold AS INT) AS fold, round(2 * hit / (hit + total)::DOUBLE / classes, 9) AS macro_f1 FROM t"""))
def _(spark, d):
    rows = model_rows(spark, d).select("packet_number", "attack_label", *INPUTS)
    scores = classify.cross_validate(rows, INPUTS, folds=5, fit=lambda part: "BENIGN", predict=lambda part, name: part.withColumn("predicted_label", F.lit(name)))
    return scores.withColumn("macro_f1", F.round("macro_f1", 9))


@register("o10_importance_of_all", over("p", f"SELECT CAST(count(*) AS BIGINT) AS features, 1.0::DOUBLE AS total, true AS in_order, 'dst_port' AS most FROM (VALUES {', '.join(f'({i})' for i in range(len(INPUTS)))}) v"))
def _(spark, d):
    """The label follows from the source, which is no input, and the target port."""
    rows = model_rows(spark, d)
    table = classify.feature_importance(classify.train(rows, INPUTS, estimator=small_forest()), INPUTS, rows, len(INPUTS))
    ranked = table.withColumn("at", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")))
    return ranked.agg(F.count(F.lit(1)).alias("features"), F.round(F.sum("importance"), 4).alias("total"),
                      F.lit([r["feature"] for r in table.collect()] == [r["feature"] for r in ranked.orderBy("at").collect()]).alias("in_order"),
                      F.max_by("feature", "importance").alias("most"))


@register("o10_feature_importance")
def _(spark, d):
    rows = model_rows(spark, d)
    return classify.feature_importance(classify.train(rows, INPUTS, estimator=small_forest()), INPUTS, rows)


@register("o11_prediction_distribution", over("p", f"""WITH {PRED_SQL}, m AS ({' UNION ALL '.join(f"SELECT '{c}' AS label, round(avg({_prob(k, c)}), 4) AS mean_probability FROM p" for k, c in enumerate(_CLASSES))})
    SELECT m.label, count(y.pl) AS rows, round(count(y.pl)::DOUBLE / (SELECT count(*) FROM p) * 100, 2) AS share_pct, mean_probability FROM m LEFT JOIN y ON y.pl = m.label GROUP BY m.label, mean_probability"""))
def _(spark, d):
    rows = predictions(spark, d)
    return metrics.prediction_distribution(rows).join(metrics.mean_probabilities(rows), "label")


@register("o12_anomaly_alert", over("p", f"""WITH {PRED_SQL} SELECT 'ML-AnomalyDetected' AS attack_type, 'HIGH' AS severity, round(least(0.95, 0.6 + count(*) FILTER (WHERE flagged)::DOUBLE / count(*)), 4) AS confidence,
    (SELECT src_ip FROM y WHERE flagged GROUP BY 1 ORDER BY count(*) DESC, src_ip LIMIT 1) AS source_ip, 'MULTIPLE' AS destination_ip, max(timestamp) FILTER (WHERE flagged) AS timestamp,
    count(*) FILTER (WHERE flagged) AS anomaly_count, count(*) AS total_packets FROM y HAVING count(*) FILTER (WHERE flagged) > 50"""))
def _(spark, d):
    return metrics.anomaly_alert(predictions(spark, d), F.col("flagged"))


@register("o13_classifier_alerts", over("p", f"""WITH {PRED_SQL} SELECT concat('ML-', pl) AS attack_type, CASE WHEN count(*) > 20 THEN 'HIGH' WHEN count(*) > 5 THEN 'MEDIUM' ELSE 'LOW' END AS severity,
    max((packet_length % 100)::DOUBLE / 100) AS confidence, 'MULTIPLE' AS source_ip, 'MULTIPLE' AS destination_ip, max(timestamp) AS timestamp, count(*) AS hits FROM y WHERE pl <> 'DNS' GROUP BY pl ORDER BY hits DESC, pl LIMIT 3"""))
def _(spark, d):
    return metrics.classifier_alerts(predictions(spark, d))


@register("o14_rules_versus_model", over("b", f"""WITH {run_sql('b')}, r AS (SELECT split_part(attack_type, '-', 1) AS label, count(*) AS rule_alerts FROM al GROUP BY 1),
    m AS (SELECT {_TARGET} AS label, count(*) AS predicted_rows FROM b GROUP BY 1)
    SELECT coalesce(r.label, m.label) AS label, coalesce(rule_alerts, 0) AS rule_alerts, coalesce(predicted_rows, 0) AS predicted_rows,
    coalesce(round(predicted_rows::DOUBLE / (SELECT count(*) FROM b) * 100, 2), 0) AS predicted_pct FROM r FULL JOIN m ON r.label = m.label"""))
def _(spark, d):
    packets = fixtures.packets(spark, d, "burst")
    return metrics.rules_versus_model(all_alerts(packets, _LOW), packets.withColumn("predicted_label", F.expr(_TARGET)))


# ---- catalogue -------------------------------------------------------------------

@register("o15_active_version", """WITH e AS (SELECT event_type AS model_key, concat('v', CAST(user_id AS VARCHAR)) AS version, ts FROM events),
    k AS (SELECT model_key, version, row_number() OVER (PARTITION BY model_key ORDER BY ts DESC, version DESC) AS r FROM e)
    SELECT DISTINCT e.model_key, e.version, k.r IS NOT NULL AS is_active FROM e LEFT JOIN k ON k.r = 1 AND k.model_key = e.model_key AND k.version = e.version""")
def _(spark, d):
    fixtures.use_utc(spark)
    events = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type AS model_key", "concat('v', cast(user_id AS string)) AS version", "cast(ts AS timestamp) AS promoted_at")
    return catalog.with_active(events.select("model_key", "version").distinct(), events)


@register("o16_saved_model", over("p", f"SELECT {_TARGET} AS attack_label, count(*) AS rows, true AS mostly_right FROM p GROUP BY 1"))
def _(spark, d):
    rows = model_rows(spark, d)
    store = catalog.Catalog(spark, scratch(spark, "catalogue"))
    store.save(classify.train(rows, INPUTS, estimator=small_forest()), "random_forest", {"accuracy": 1.0})
    scored = classify.classify(rows, store.load("random_forest"))
    right = F.avg((F.col("attack_label") == F.col("predicted_label")).cast("double"))
    return scored.groupBy("attack_label").agg(F.count(F.lit(1)).alias("rows"), (right >= 0.8).alias("mostly_right"))
