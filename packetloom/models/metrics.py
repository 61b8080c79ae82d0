"""Evaluation of scored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 1_024
RANGES = 64  # quantile ranges, each of so many bins


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(actual, predicted, rows)."""
    return df.groupBy(F.col(truth).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("rows"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of every class seen as truth or prediction.

    The table is folded to its confusion cells first; the rest works on those.
    """
    cells = confusion(df, truth, predicted)
    sides = cells.select(F.explode(F.array(
        F.struct(F.col("actual").alias("label"), F.when(F.col("actual") == F.col("predicted"), F.col("rows")).otherwise(0).alias("hit"),
                 F.col("rows").alias("actual_rows"), F.lit(0).cast("long").alias("predicted_rows")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("hit"),
                 F.lit(0).cast("long").alias("actual_rows"), F.col("rows").alias("predicted_rows")))).alias("s")).select("s.*")
    sums = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("hit", "actual_rows", "predicted_rows")])
    precision, recall = _ratio(F.col("hit"), F.col("predicted_rows")), _ratio(F.col("hit"), F.col("actual_rows"))
    return sums.select("label", precision.alias("precision"), recall.alias("recall"),
                       _ratio(2 * F.col("hit"), F.col("actual_rows") + F.col("predicted_rows")).alias("f1"),
                       F.col("actual_rows").alias("support"), "hit")


def classifier_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and macro / weighted precision, recall, F1."""
    weight, whole = F.col("support"), F.sum("support")
    return per_class(df, truth, predicted).agg(
        (F.sum("hit") / whole).alias("accuracy"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
        *[(F.sum(F.col(m) * weight) / whole).alias(f"{m}_weighted") for m in ("precision", "recall", "f1")],
        whole.alias("n_samples"), F.count_if(weight > 0).alias("n_classes"))


def _bin_of(score: Column, cuts: Column) -> Column:
    """Number of the bin of a score; it never falls as scores rise."""
    at = F.size(F.filter(cuts, lambda c: c <= score))
    low, high = F.get(cuts, F.greatest(at - 1, F.lit(0))), F.get(cuts, F.least(at, F.size(cuts) - 1))
    share = F.coalesce(F.try_divide(score - low, high - low), F.lit(0.0))
    return at * BINS + F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(share * BINS)))


def auc(df: DataFrame, positive: Column, score: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Exact area under the ROC curve per ``keys``, from counts below and equal.

    Scores are folded to distinct values, cut at approximate quantiles and between those
    into equal widths, and counted bin by bin, so no task needs the whole order of scores,
    also where one score lies far from all others.  Needs scores
    that are not null.
    """
    values = df.select(*keys, positive.cast("long").alias("_p"), score.cast("double").alias("_s")) \
        .groupBy(*keys, "_s").agg(F.sum("_p").alias("_pos"), F.sum(1 - F.col("_p")).alias("_neg"))
    cuts = values.groupBy(*keys).agg(F.percentile_approx("_s", [i / RANGES for i in range(RANGES + 1)], 10_000).alias("_cuts"))
    values = values.join(F.broadcast(cuts), list(keys)) if keys else values.crossJoin(F.broadcast(cuts))
    values = values.withColumn("_bin", _bin_of(F.col("_s"), F.col("_cuts"))).drop("_cuts")
    bins = values.groupBy(*keys, "_bin").agg(F.sum("_neg").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bin")) - F.col("_n")
    bins = bins.select(*keys, "_bin", before.alias("_before"))
    inside = F.sum("_neg").over(Window.partitionBy(*keys, "_bin").orderBy("_s")) - F.col("_neg")
    ranked = values.withColumn("_in", inside).join(bins, [*keys, "_bin"])
    wins = F.sum(F.col("_pos") * (F.col("_before") + F.col("_in") + F.col("_neg") / 2))
    return ranked.groupBy(*keys).agg(F.try_divide(wins, F.sum("_pos").cast("double") * F.sum("_neg")).alias("auc"))


def one_vs_rest_auc(df: DataFrame, truth: str, probabilities: str) -> DataFrame:
    """One row: mean over classes of the area for that class against the rest.

    ``probabilities`` is a map from class to probability.
    """
    long = df.select(F.col(truth).alias("_t"), F.explode(probabilities).alias("_class", "_q"))
    return auc(long, F.col("_t") == F.col("_class"), F.col("_q"), ("_class",)).agg(F.avg("auc").alias("roc_auc"))


def anomaly_metrics(df: DataFrame, flagged: Column, truth: Column | None = None, score: Column | None = None) -> DataFrame:
    """One row: flag rate and, with labels, accuracy, precision, recall, F1, area and the 2x2 counts."""
    rate = F.avg(flagged.cast("double")).alias("anomaly_rate")
    if truth is None:
        return df.agg(rate, F.count(F.lit(1)).alias("n_samples"))
    cells = {"true_positive": truth & flagged, "false_positive": ~truth & flagged, "false_negative": truth & ~flagged, "true_negative": ~truth & ~flagged}
    counts = df.agg(rate, F.count(F.lit(1)).alias("n_samples"), *[F.count_if(test).alias(n) for n, test in cells.items()])
    tp, fp, fn, tn = (F.col(n) for n in cells)
    result = counts.withColumns({
        "accuracy": _ratio(tp + tn, F.col("n_samples")), "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn)})
    if score is None:
        return result
    return result.crossJoin(F.broadcast(auc(df, truth, -score).withColumnRenamed("auc", "roc_auc")))


def prediction_distribution(df: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    """(label, rows, share in per cent)."""
    counts = df.groupBy(F.col(predicted).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share_pct", F.round(F.col("rows") / F.sum("rows").over(Window.partitionBy()) * 100, 2))


def mean_probabilities(df: DataFrame, probabilities: str = "class_probabilities") -> DataFrame:
    return df.select(F.explode(probabilities).alias("label", "p")).groupBy("label").agg(F.round(F.avg("p"), 4).alias("mean_probability"))


# ---- alerts from scored rows --------------------------------------------------------

def anomaly_alert(df: DataFrame, flagged: Column) -> DataFrame:
    """One alert when any row is flagged, naming the source with most flagged rows."""
    by_source = df.groupBy("src_ip").agg(F.count(F.lit(1)).alias("rows"), F.count_if(flagged).alias("hits"), F.max(F.when(flagged, F.col("timestamp"))).alias("last"))
    named = F.col("src_ip").isNotNull() & (F.col("hits") > 0)
    total = by_source.agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"), F.max("last").alias("timestamp"),
                          F.min_by("src_ip", F.when(named, F.struct((-F.col("hits")).alias("o"), F.col("src_ip").alias("s")))).alias("top"))
    hits = F.col("hits")
    return total.filter(hits > 0).select(
        F.lit("ML-AnomalyDetected").alias("attack_type"),
        F.when(hits > 50, "HIGH").when(hits > 10, "MEDIUM").otherwise("LOW").alias("severity"),
        F.round(F.least(F.lit(0.95), 0.6 + hits / F.col("rows")), 4).alias("confidence"),
        F.coalesce("top", F.lit("MULTIPLE")).alias("source_ip"), F.lit("MULTIPLE").alias("destination_ip"), "timestamp",
        hits.alias("anomaly_count"), F.col("rows").alias("total_packets"))


def classifier_alerts(df: DataFrame, n: int = 3, predicted: str = "predicted_label", confidence: str = "confidence") -> DataFrame:
    """Alerts for the ``n`` most frequent attack labels over all scored rows."""
    hits = F.col("hits")
    found = (df.filter(F.col("is_attack")).groupBy(F.col(predicted).alias("label"))
             .agg(F.count(F.lit(1)).alias("hits"), F.max(confidence).alias("confidence"), F.max("timestamp").alias("timestamp"))
             .orderBy(F.desc("hits"), F.asc("label")).limit(n))
    return found.select(
        F.concat(F.lit("ML-"), F.col("label")).alias("attack_type"),
        F.when(hits > 20, "HIGH").when(hits > 5, "MEDIUM").otherwise("LOW").alias("severity"), "confidence",
        F.lit("MULTIPLE").alias("source_ip"), F.lit("MULTIPLE").alias("destination_ip"), "timestamp", hits.alias("hits"))


def rules_versus_model(alerts: DataFrame, scored: DataFrame, predicted: str = "predicted_label") -> DataFrame:
    """Alerts per family beside predicted rows and shares of the class of the same name."""
    family = F.regexp_extract("attack_type", "^[^-]+", 0)
    by_rule = alerts.groupBy(family.alias("label")).agg(F.count(F.lit(1)).alias("rule_alerts"))
    by_model = prediction_distribution(scored, predicted).select("label", F.col("rows").alias("predicted_rows"), F.col("share_pct").alias("predicted_pct"))
    return by_rule.join(by_model, "label", "full_outer").select(
        "label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("rule_alerts", "predicted_rows")],
        F.coalesce("predicted_pct", F.lit(0.0)).alias("predicted_pct"))
