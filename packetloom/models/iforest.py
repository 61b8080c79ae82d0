"""Isolation forest: trees grown in parallel, each on a small sample.

Growing a tree needs at most 256 rows, so sampling is the only step that
touches the whole table: one scan that keeps a bounded number of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.operators.selection import exact_quantiles
from packetloom.session import checkpoint_root

TREES, SAMPLE, CONTAMINATION = 200, 256, 0.05


@dataclass(frozen=True)
class Forest:
    """Node arrays per tree plus what scoring needs: cut-off, mean and deviation of training scores."""
    names: tuple[str, ...]
    sample: int
    trees: tuple[tuple[list[int], list[float], list[int], list[int], list[float]], ...]
    cutoff: float = -math.inf
    mean: float = 0.0
    deviation: float = 1.0


def average_path(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def grow(points: np.ndarray, rng: np.random.Generator, limit: int):
    """Node arrays (feature, threshold, left, right, path length) of one tree; leaves have feature -1."""
    feature, threshold, left, right, path = [], [], [], [], []
    stack = [(np.arange(len(points)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        part = points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        left.append(-1)
        right.append(-1)
        if depth >= limit or len(rows) <= 1 or not len(usable):
            feature.append(-1)
            threshold.append(0.0)
            path.append(depth + average_path(len(rows)))
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        feature.append(f)
        threshold.append(cut)
        path.append(0.0)
        goes_left = part[:, f] <= cut
        stack.append((rows[~goes_left], depth + 1, node, True))
        stack.append((rows[goes_left], depth + 1, node, False))
    return feature, threshold, left, right, path


def tree_samples(df: DataFrame, names: Sequence[str], order: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, features): up to ``sample`` distinct rows for each tree.

    Every row gets ``copies`` chances to be drawn, each for another tree; on a
    large table that is one chance with a tiny probability.
    """
    n = df.count()
    wanted = trees * sample * 1.5
    copies = max(1, min(trees, math.ceil(wanted / max(n, 1))))
    share = min(1.0, wanted / (max(n, 1) * copies))
    place = F.xxhash64(F.col(order), F.lit(seed))
    draws = df.select(order, *names, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("_copy"), place.alias("_place"))
    chance = F.pmod(F.xxhash64("_place", "_copy"), F.lit(1_000_000_007)) / 1_000_000_007
    # the stride keeps the copies of one row in different trees
    tree = F.pmod(F.pmod("_place", F.lit(trees)) + F.col("_copy"), F.lit(trees)).cast("int")
    drawn = draws.filter(chance < share).select(tree.alias("tree"), F.xxhash64("_copy", "_place", F.lit(seed + 1)).alias("_o"), *names)
    ranked = drawn.withColumn("_r", F.row_number().over(Window.partitionBy("tree").orderBy("_o")))
    return ranked.filter(F.col("_r") <= sample).drop("_o", "_r")


def train(df: DataFrame, names: Sequence[str], order: str = "packet_number", trees: int = TREES, sample: int = SAMPLE,
          contamination: float = CONTAMINATION, seed: int = 42) -> Forest:
    """Grow the trees, then set the cut-off at the ``contamination`` quantile of the training scores."""
    names = list(names)
    size = min(sample, max(df.count(), 1))
    limit = max(1, math.ceil(math.log2(max(size, 2))))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        # fixed row order, so that a repeated task grows the same tree
        points = group[names].to_numpy(np.float64)
        points = points[np.lexsort(points.T)]
        return pd.DataFrame({"tree": [tree], "nodes": [json.dumps(grow(points, np.random.default_rng([seed, tree]), limit))]})

    rows = tree_samples(df, names, order, trees, size, seed).groupBy("tree").applyInPandas(build, "tree int, nodes string").collect()
    grown = tuple(tuple(json.loads(r["nodes"])) for r in sorted(rows, key=lambda r: r["tree"]))
    forest = Forest(tuple(names), size, grown)
    # scored once: the statistics and the exact quantile read the stored scores
    checkpoint_root(df.sparkSession)
    scores = df.select(score(forest).alias("s")).checkpoint()
    share = max(0.001, min(0.499, contamination))
    stats = scores.agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    cutoff = exact_quantiles(scores, ["s"], [share])["s"][0]
    return Forest(tuple(names), size, grown, cutoff, stats["m"], max(stats["d"] or 0.0, 1e-9))


def score(forest: Forest) -> Column:
    """Minus the anomaly score: near -1 is strange, near 0 is common.

    The trees hold at most ``2 * sample`` nodes each, whatever they were
    trained on; they travel to each executor once as a broadcast value.
    """
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast([tuple(np.asarray(part) for part in tree) for tree in forest.trees])
    scale = average_path(forest.sample) or 1.0
    if not forest.names:  # nothing to split by: all rows are alike
        return F.lit(-0.5)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees = shared.value
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)  # a single column comes bare
            x = np.column_stack([c.to_numpy(np.float64) for c in columns])
            rows, total = np.arange(len(x)), np.zeros(len(x))
            for feature, threshold, left, right, path in trees:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go_left = x[rows, np.maximum(f, 0)] <= threshold[at]
                    at = np.where(inner, np.where(go_left, left[at], right[at]), at)
                total += path[at]
            yield pd.Series(-np.exp2(-(total / max(len(trees), 1)) / scale))

    return run(*[F.col(n).cast("double") for n in forest.names])


def classify(df: DataFrame, forest: Forest | None) -> DataFrame:
    """Rows plus score, label and anomaly probability; without a forest all are normal."""
    if forest is None:
        return df.withColumns({"anomaly_score": F.lit(0.0), "anomaly_label": F.lit("NORMAL"), "anomaly_probability": F.lit(0.0)})
    scored = df.withColumn("anomaly_score", score(forest))
    z = -(F.col("anomaly_score") - forest.mean) / forest.deviation
    return scored.withColumns({
        "anomaly_label": F.when(F.col("anomaly_score") < forest.cutoff, "ANOMALY").otherwise("NORMAL"),
        "anomaly_probability": 1 / (1 + F.exp(-z))})


def strongest_features(names: Sequence[str], k: int = 5) -> Column:
    """The ``k`` features largest in absolute value, as (name, value) structs."""
    items = F.array(*[F.struct((-F.abs(F.col(n).cast("double"))).alias("o"), F.lit(n).alias("name"),
                               F.round(F.abs(F.col(n).cast("double")), 4).alias("value")) for n in names])
    return F.transform(F.slice(F.array_sort(items), 1, k), lambda x: F.struct(x["name"].alias("name"), x["value"].alias("value")))


def save(spark: SparkSession, forest: Forest, path: str) -> None:
    """One row per tree plus one header row, as JSON text."""
    head = {k: v for k, v in asdict(forest).items() if k != "trees"}
    rows = [(-1, json.dumps(head))] + [(i, json.dumps(t)) for i, t in enumerate(forest.trees)]
    spark.createDataFrame(rows, "tree int, body string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Forest:
    rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["tree"])
    head = json.loads(rows[0]["body"])
    return Forest(tuple(head["names"]), head["sample"], tuple(tuple(json.loads(r["body"])) for r in rows[1:]),
                  head["cutoff"], head["mean"], head["deviation"])
