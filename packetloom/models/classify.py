"""Attack classifiers on Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import checkpoint_root

# Labels that are not an attack.
HARMLESS = ("BENIGN", "NORMAL", "UNKNOWN")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Rows plus ``class_weight``: rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    everything = Window.partitionBy()
    weights = counts.select(label, (F.sum("_n").over(everything) / (F.count(F.lit(1)).over(everything) * F.col("_n"))).alias("class_weight"))
    return df.join(F.broadcast(weights), label)


def random_forest(trees: int = 300, depth: int = 20, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, weightCol="class_weight",
                                  featuresCol="features", labelCol="label_index")


def boosted_trees(rounds: int = 300, depth: int = 8, rate: float = 0.05, subsample: float = 0.8, seed: int = 42) -> OneVsRest:
    """One boosted binary model per class, as boosting in Spark ML is binary."""
    base = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed,
                         featuresCol="features", labelCol="label_index")
    return OneVsRest(classifier=base, featuresCol="features", labelCol="label_index")


def train(df: DataFrame, names: Sequence[str], label: str = "attack_label", estimator: Estimator | None = None) -> PipelineModel:
    """Fit label index, feature vector and classifier as one pipeline; labels are indexed alphabetically."""
    stages = [StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc"),
              VectorAssembler(inputCols=list(names), outputCol="features"), estimator or random_forest()]
    return Pipeline(stages=stages).fit(balanced_weights(df, label))


def class_names(model: PipelineModel) -> list[str]:
    return list(next(s for s in model.stages if isinstance(s, StringIndexerModel)).labels)


def classify(df: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Rows plus predicted label, index, confidence, class probabilities and attack mark.

    Without a model every row is BENIGN.  A model without probabilities (one
    boosted model per class) gives the logistic of its margins, normalised.
    """
    if model is None:
        return df.withColumns({"predicted_label": F.lit("BENIGN"), "predicted_index": F.lit(0), "confidence": F.lit(1.0), "is_attack": F.lit(False)})
    names = class_names(model)
    # the label indexer is not needed for scoring, and the label may be absent
    rows = PipelineModel(stages=[s for s in model.stages if not isinstance(s, StringIndexerModel)]).transform(df)
    if "probability" in rows.columns:
        rows = rows.withColumn("_p", vector_to_array("probability"))
    else:
        raw = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-2 * x)))
        rows = rows.withColumn("_raw", raw).withColumn("_p", F.transform(
            "_raw", lambda x: x / F.aggregate("_raw", F.lit(0.0), lambda a, b: a + b)))
    index = F.col("prediction").cast("int")
    label = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), index), F.lit("UNKNOWN"))
    probabilities = F.map_from_arrays(F.array(*[F.lit(n) for n in names]),
                                      F.transform(F.slice("_p", 1, len(names)), lambda x: F.round(x, 4)))
    return rows.withColumns({
        "predicted_label": label, "predicted_index": index, "confidence": F.round(F.get("_p", index), 4),
        "class_probabilities": probabilities, "is_attack": ~F.upper(label).isin(*HARMLESS),
    }).drop("_p", "_raw", "features", "rawPrediction", "probability", "prediction", "label_index")


def feature_importance(model: PipelineModel, names: Sequence[str], df: DataFrame, k: int = 15) -> DataFrame:
    """(feature, importance) of the ``k`` most useful features, normalised to sum 1 over all."""
    tail: Model = model.stages[-1]
    parts = [tail] if hasattr(tail, "featureImportances") else list(getattr(tail, "models", []))
    values = [sum(float(m.featureImportances[i]) for m in parts) for i in range(len(names))]
    total = sum(values) or 1.0
    rows = [(n, round(v / total, 6)) for n, v in zip(names, values)]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.desc("importance"), F.asc("feature")).limit(k)


def stratified_folds(df: DataFrame, label: str = "attack_label", folds: int = 5, order: str = "packet_number", seed: int = 42, cells: int = 4096) -> DataFrame:
    """Rows plus ``fold``: every class is dealt to the folds in turn, so its share in any two differs by one row at most.

    Rows stand in the order of a seeded hash.  They are numbered inside ``cells`` ranges of
    it and shifted by the counts of earlier ranges, so a class of any size is dealt by
    many tasks.
    """
    place = F.xxhash64(F.col(order), F.lit(seed))
    rows = df.withColumns({"_place": place, "_cell": F.pmod(place, F.lit(cells))})
    before = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_rows")).select(
        F.col(label).alias("_l"), F.col("_cell").alias("_c"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_place", order)) - 1
    numbered = rows.withColumn("_in", inside).join(counts, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_cell") == F.col("_c")))
    return numbered.withColumn("fold", F.pmod(F.col("_before") + F.col("_in"), F.lit(folds)).cast("int")).drop("_place", "_cell", "_l", "_c", "_before", "_in")


def cross_validate(df: DataFrame, names: Sequence[str], label: str = "attack_label", folds: int = 5,
                   estimator: Estimator | None = None, order: str = "packet_number", seed: int = 42,
                   fit: Callable[[DataFrame], object] | None = None, predict: Callable[[DataFrame, object], DataFrame] | None = None) -> DataFrame:
    """(fold, macro_f1) rows over stratified folds, which are stored once.

    ``fit`` and ``predict`` (rows plus ``predicted_label``) take another model than the
    library's classifiers.
    """
    from packetloom.models.metrics import classifier_metrics

    checkpoint_root(df.sparkSession)
    rows = stratified_folds(df, label, folds, order, seed).checkpoint()
    fit = fit or (lambda part: train(part, names, label, estimator))
    predict = predict or classify
    result = None
    for fold in range(folds):
        model = fit(rows.filter(F.col("fold") != fold).drop("fold"))
        scored = predict(rows.filter(F.col("fold") == fold).drop("fold"), model)
        f1 = classifier_metrics(scored, label, "predicted_label").select(F.lit(fold).alias("fold"), F.col("f1_macro").alias("macro_f1"))
        result = f1 if result is None else result.unionByName(f1)
    return result


def cross_validation_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.avg("macro_f1").alias("cv_mean"), F.stddev_pop("macro_f1").alias("cv_std"))
