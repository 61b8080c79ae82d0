"""Fitted preprocessing: impute, clip, select, scale; apply, align, split, save."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators.selection import exact_quantiles, select_ranks, top_filter
from packetloom.session import checkpoint_root

IQR_MULTIPLE = 3.0


@dataclass(frozen=True)
class Fitted:
    """Everything needed to repeat the preprocessing on other rows.

    Input names and kept names are stored apart, so new rows are aligned to
    what was seen at fitting and not to what survived it.
    """
    input_names: tuple[str, ...]
    medians: tuple[float, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    kept_names: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]


def impute(df: DataFrame, names: Sequence[str], medians: Sequence[float]) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), F.lit(float(m)))
                           for n, m in zip(names, medians)})


def clip(df: DataFrame, names: Sequence[str], low: Sequence[float], high: Sequence[float]) -> DataFrame:
    return df.withColumns({n: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.col(n)))
                           for n, lo, hi in zip(names, low, high)})


def fit_medians(df: DataFrame, names: Sequence[str]) -> list[float]:
    """Exact median per column; a column without values gives 0."""
    return [q[0] if q[0] is not None else 0.0 for q in exact_quantiles(df, names, [0.5]).values()]


def fit_bounds(df: DataFrame, names: Sequence[str], multiple: float = IQR_MULTIPLE) -> tuple[list[float], list[float]]:
    """Quartiles moved out by ``multiple`` quartile ranges; a column without values has no bounds."""
    low, high = [], []
    for q1, q3 in exact_quantiles(df, names, [0.25, 0.75]).values():
        if q1 is None:
            low.append(float("-inf"))
            high.append(float("inf"))
            continue
        low.append(q1 - multiple * (q3 - q1))
        high.append(q3 + multiple * (q3 - q1))
    return low, high


def varying_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that are not constant."""
    row = df.agg(*[F.var_pop(n).alias(n) for n in names]).first()
    return [n for n in names if (row[n] or 0.0) > 0.0]


def fit(df: DataFrame, names: Sequence[str]) -> Fitted:
    """Fit all steps.  The columns are written once; every pass reads what was written."""
    checkpoint_root(df.sparkSession)
    df = df.select(*[F.col(n).cast("double").alias(n) for n in names]).checkpoint()
    medians = fit_medians(df, names)
    filled = impute(df, names, medians)
    low, high = fit_bounds(filled, names)
    clipped = clip(filled, names, low, high)
    stats = clipped.agg(*[f(n).alias(f"{n}__{k}") for n in names for k, f in (("mean", F.avg), ("std", F.stddev_pop), ("var", F.var_pop))]).first()
    kept = [n for n in names if (stats[f"{n}__var"] or 0.0) > 0.0]
    return Fitted(tuple(names), tuple(medians), tuple(low), tuple(high), tuple(kept),
                  tuple(stats[f"{n}__mean"] for n in kept), tuple(stats[f"{n}__std"] for n in kept))


def align(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns, then ``names`` in order; absent or null ones are 0."""
    present = set(df.columns)
    return df.select(*keep, *[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in present else F.lit(0.0)).alias(n) for n in names])


def scale(df: DataFrame, names: Sequence[str], means: Sequence[float], deviations: Sequence[float]) -> DataFrame:
    """Mean 0, population deviation 1."""
    return df.withColumns({n: (F.col(n) - m) / (s or 1.0) for n, m, s in zip(names, means, deviations)})


def apply(df: DataFrame, fitted: Fitted, keep: Sequence[str] = ()) -> DataFrame:
    """The fitted steps on other rows: one projection, no shuffle."""
    present = [n for n in fitted.input_names if n in df.columns]
    medians = dict(zip(fitted.input_names, fitted.medians))
    rows = align(impute(df, present, [medians[n] for n in present]), fitted.input_names, keep)
    rows = clip(rows, fitted.input_names, fitted.low, fitted.high).select(*keep, *fitted.kept_names)
    return scale(rows, fitted.kept_names, fitted.means, fitted.deviations)


def stratified_split(df: DataFrame, label: str, order: str = "packet_number", test_share: float = 0.2,
                     seed: int = 42, min_per_class: int = 2) -> DataFrame:
    """Rows plus ``is_test``: each class gives exactly its share of rows, chosen by a seeded hash.

    Per class the hash value that cuts off its share is found by counting, so
    the split itself is a plain expression: rows are not ranked, sorted or
    moved, whatever the size of a class.  With a class of fewer than
    ``min_per_class`` rows the classes are ignored.
    """
    # two bits less than a long, so that differences of hashes cannot overflow
    rows = df.withColumn("_h", F.shiftright(F.xxhash64(F.col(order), F.lit(seed)), 2))
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = min(counts.values(), default=0) >= min_per_class
    key = F.col(label) if apart else F.lit(None).cast(rows.schema[label].dataType)
    sizes = counts if apart else {None: sum(counts.values())}
    takes = {value: int(n * test_share + 0.5) for value, n in sizes.items()}
    # all classes in the same passes: the value from which on the largest hashes are taken
    cuts = select_ranks(rows.select(key.alias("key"), F.col("_h").alias("x")), {v: [sizes[v] - k] for v, k in takes.items() if 0 < k})
    chosen = F.lit(False)
    for value, k in takes.items():
        if k == 0:
            continue
        mine = key.eqNullSafe(F.lit(value)) if apart else F.lit(True)
        cut = cuts[value, sizes[value] - k]
        if sizes[value] - cut.below == k:
            chosen = chosen | (mine & (F.col("_h") >= cut.value))
        else:  # rows of equal hash are parted by their order
            chosen = chosen | (mine & top_filter(rows.filter(mine), ["_h", order], k))
    return rows.withColumn("is_test", chosen).drop("_h")


def save(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """One-row JSON table."""
    spark.createDataFrame([(json.dumps(asdict(fitted)),)], "fitted string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Fitted:
    values = json.loads(spark.read.text(path).first()[0])
    return Fitted(**{k: tuple(v) for k, v in values.items()})
