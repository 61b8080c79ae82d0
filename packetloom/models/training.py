"""Training jobs: from packets to a labelled dataset, and from a dataset to judged models.

A dataset is written once and every later step reads it.  Models never see the rows they
are judged on: the split comes first, preprocessing is fitted on the training part alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from packetloom.models import classify, iforest, metrics
from packetloom.operators import features, labels, prep

BENIGN = "BENIGN"
LEAST_BENIGN = 10  # with fewer benign rows the anomaly model is fitted on all


def build_dataset(packets: DataFrame, path: str, order: str = "packet_number", session: str | None = None, label: str = "attack_label") -> DataFrame:
    """``order``, every feature and a weak ``label`` of each packet, written to ``path`` and read back.

    Packets are engineered, turned into the feature matrix and labelled by budget.  The
    scored matrix is written before labels are cut, as the cut-offs are found by counting
    over it.
    """
    spark = packets.sparkSession
    matrix = features.feature_matrix(features.engineer(packets), order=order, session=session)
    labels.label_scores(matrix).write.mode("overwrite").parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    kept = [order, *([session] if session else []), *features.feature_names(), label]
    labels.assign_labels(scored, order).withColumnRenamed("attack_label", label).select(*kept).write.mode("overwrite").parquet(f"{path}/rows")
    return spark.read.parquet(f"{path}/rows")


@dataclass(frozen=True)
class Split:
    train: DataFrame
    test: DataFrame


def split_dataset(dataset: DataFrame, path: str, label: str = "attack_label", order: str = "packet_number", test_share: float = 0.2, seed: int = 42) -> Split:
    """A stratified split, written once so that every later scan reads the same rows."""
    spark = dataset.sparkSession
    marked = prep.stratified_split(dataset, label, order, test_share, seed).withColumn("part", F.when(F.col("is_test"), "test").otherwise("train")).drop("is_test")
    marked.write.mode("overwrite").partitionBy("part").parquet(path)
    rows = spark.read.parquet(path)
    return Split(rows.filter("part = 'train'").drop("part"), rows.filter("part = 'test'").drop("part"))


@dataclass(frozen=True)
class AnomalyModel:
    """A forest with the preprocessing it was fitted with, and how it did on held-out rows."""
    forest: iforest.Forest
    fitted: prep.Fitted
    fitted_rows: int
    judged: Row

    def classify(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return iforest.classify(prep.apply(rows, self.fitted, keep), self.forest)


def train_anomaly_model(split: Split, names: Sequence[str], label: str = "attack_label", order: str = "packet_number",
                        trees: int = iforest.TREES, contamination: float = iforest.CONTAMINATION, seed: int = 42) -> AnomalyModel:
    """Fit on the benign rows of the training part, judge on the test part.

    Preprocessing is fitted on the whole training part.  With fewer than ten benign rows
    the forest is fitted on all of it.  A test row counts as an attack if its label is not
    benign.
    """
    names = list(names)
    fitted = prep.fit(split.train, names)
    benign = split.train.filter(F.col(label) == BENIGN)
    rows = benign if benign.limit(LEAST_BENIGN).count() >= LEAST_BENIGN else split.train
    ready = prep.apply(rows, fitted, [order])
    forest = iforest.train(ready, list(fitted.kept_names), order, trees=trees, contamination=contamination, seed=seed)
    model = AnomalyModel(forest, fitted, ready.count(), Row())
    judged = metrics.anomaly_metrics(model.classify(split.test, [order, label]), F.col("anomaly_label") == "ANOMALY", F.col(label) != BENIGN, F.col("anomaly_score"))
    return AnomalyModel(forest, fitted, model.fitted_rows, judged.first())


@dataclass(frozen=True)
class AttackModel:
    """A classifier with its preprocessing, and how it did on held-out rows."""
    model: PipelineModel
    fitted: prep.Fitted
    judged: Row

    def classify(self, rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return classify.classify(prep.apply(rows, self.fitted, keep), self.model)


def train_attack_model(split: Split, names: Sequence[str], label: str = "attack_label", estimator: Estimator | None = None) -> AttackModel:
    """Fit on the training part, judge by accuracy and macro scores on the test part."""
    fitted = prep.fit(split.train, list(names))
    model = classify.train(prep.apply(split.train, fitted, [label]), fitted.kept_names, label, estimator)
    scored = classify.classify(prep.apply(split.test, fitted, [label]), model)
    return AttackModel(model, fitted, metrics.classifier_metrics(scored, label, "predicted_label").first())


def save_anomaly_model(spark: SparkSession, model: AnomalyModel, path: str) -> None:
    iforest.save(spark, model.forest, f"{path}/forest")
    prep.save(spark, model.fitted, f"{path}/preprocessing")


def load_anomaly_model(spark: SparkSession, path: str) -> AnomalyModel:
    """The saved forest and preprocessing; what it was judged by is in the catalogue."""
    return AnomalyModel(iforest.load(spark, f"{path}/forest"), prep.load(spark, f"{path}/preprocessing"), 0, Row())
