"""Exact order statistics without sorting the table.

``orderBy().limit(n)`` keeps up to ``n`` rows in one task, which is fine for a
report of a hundred rows and not for "the newest hundred million packets".
Here the n-th value is found by counting: the value range is cut into at most
65 536 bins, the bin holding the rank is kept and cut again, until it holds one
value.  Each round is one scan of one column and returns one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

BINS = 65_536


@dataclass(frozen=True)
class Cut:
    """Rows above ``value`` number ``above``; ``taken`` of the ``equal`` ones complete the rank."""
    value: float | int
    above: int
    taken: int
    equal: int


def _ranked(df: DataFrame, x: Column, k: int) -> tuple[Cut | None, int, int]:
    """(cut at the ``k``-th largest value, rows with a value, rows without one); the cut is None if at most ``k`` have one."""
    column = df.select(x.alias("x"))
    floating = column.schema["x"].dataType.typeName() in ("double", "float")
    if floating:  # NaN is no value, and the infinities are counted apart
        column = column.select(F.nanvl(F.col("x").cast("double"), F.lit(None).cast("double")).alias("x"))
    infinity = F.lit(float("inf"))
    finite = (F.abs("x") != infinity) if floating else F.col("x").isNotNull()
    lo, hi, total, rows_all, top, inner = column.agg(
        F.min(F.when(finite, F.col("x"))), F.max(F.when(finite, F.col("x"))), F.count("x"), F.count(F.lit(1)),
        F.count_if(F.col("x") == infinity) if floating else F.lit(0), F.count_if(F.coalesce(finite, F.lit(False)))).first()
    if total <= k or k <= 0:
        return None, total, rows_all - total
    if k <= top:
        return Cut(float("inf"), 0, k, top), total, rows_all - total
    if k > top + inner:
        return Cut(float("-inf"), top + inner, k - top - inner, total - top - inner), total, rows_all - total
    above, equal = top, inner
    rows = column.filter(finite)
    while lo != hi:
        inside = rows.filter(F.col("x").between(F.lit(lo), F.lit(hi)))
        # the bin number never falls as x grows, so whole bins are ordered; halves where the whole width is no double
        if math.isfinite(hi - lo):
            share = (F.col("x") - F.lit(lo)).cast("double") / F.lit(float(hi - lo))
        else:
            share = (F.col("x") / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
        bins = inside.groupBy(F.least(F.lit(BINS - 1), F.floor(share * BINS)).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        # at most BINS rows reach this window
        upto = F.sum("n").over(Window.orderBy(F.desc("bin")))
        hit = (bins.withColumn("upto", upto).filter(F.col("upto") >= k - above)
               .orderBy(F.desc("bin")).select("n", "lo", "hi", "upto").first())
        if (hit["lo"], hit["hi"]) == (lo, hi):
            raise ArithmeticError(f"values between {lo} and {hi} lie too close to be told apart")
        above += hit["upto"] - hit["n"]
        lo, hi, equal = hit["lo"], hit["hi"], hit["n"]
    return Cut(lo, above, k - above, equal), total, rows_all - total


def cut_at_rank(df: DataFrame, column: str, k: int) -> Cut | None:
    """Value of the ``k``-th largest ``column`` and how many of its copies are in the top ``k``.

    Null and NaN are no values.  None when the table has at most ``k`` rows with a value.
    """
    return _ranked(df, F.col(column), k)[0]


def _row_hash(df: DataFrame) -> Column:
    """A number that tells rows with equal order columns apart, the same in every run.

    Nested columns are hashed as text, maps in the order of their keys, as maps have no hash.
    """
    def hashed(field) -> Column:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, MapType):
            value = F.array_sort(F.transform(F.map_entries(value), lambda e: F.to_json(F.struct(e.alias("e")))))
        return F.to_json(F.struct(value.alias("v"))) if isinstance(field.dataType, (MapType, ArrayType, StructType)) else value
    return F.shiftright(F.xxhash64(*[hashed(f) for f in df.schema]), 2)


def top_rows(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The ``k`` largest rows by the numeric columns ``order``: exactly ``k``, or all where there are fewer.

    Rows without a value (null or NaN) come after all others.  Rows tied on every column of
    ``order`` are decided by a hash of the row; of rows equal in all columns it does not
    matter which are taken.
    """
    columns = [F.col(c) for c in order]
    sure, tied, open_ = _top(df, [*columns, _row_hash(df)], k)
    kept = df.filter(sure)
    return kept if tied is None else kept.unionByName(df.filter(tied).limit(open_))


def top_filter(df: DataFrame, order: Sequence[str], k: int) -> Column:
    """The same as a condition; rows equal in all columns are taken together, so only they can exceed ``k``."""
    sure, tied, _ = _top(df, [*[F.col(c) for c in order], _row_hash(df)], k)
    return sure if tied is None else sure | tied


def _top(df: DataFrame, order: list[Column], k: int) -> tuple[Column, Column | None, int]:
    """(condition of rows in the top ``k``, condition of equal rows of which some more are, how many)."""
    if k <= 0:
        return F.lit(False), None, 0
    x, rest = order[0], order[1:]
    cut, total, missing = _ranked(df, x, k)
    if total + missing <= k:
        return F.lit(True), None, 0
    value = F.nanvl(x.cast("double"), F.lit(None).cast("double")) if df.select(x.alias("x")).schema["x"].dataType.typeName() in ("double", "float") else x
    if cut is None:
        sure, tied, open_ = _top(df.filter(value.isNull()), rest, k - total)
        return value.isNotNull() | sure, None if tied is None else value.isNull() & tied, open_
    higher = F.coalesce(value > F.lit(cut.value), F.lit(False))
    same = F.coalesce(value == F.lit(cut.value), F.lit(False))
    if cut.taken >= cut.equal:
        return higher | same, None, 0
    if not rest:
        return higher, same, cut.taken
    sure, tied, open_ = _top(df.filter(same), rest, cut.taken)
    return higher | (same & sure), None if tied is None else same & tied, open_


GROUP_BINS = 1_024


@dataclass(frozen=True)
class Ranked:
    """The value at a rank, how many values are smaller and how many equal."""
    value: float | int
    below: int
    equal: int


def select_ranks(rows: DataFrame, wanted: dict[object, Sequence[int]], bins: int = GROUP_BINS) -> dict[tuple[object, int], Ranked]:
    """The values at ascending ranks (from 0) of each key of ``rows`` (``key``, ``x``), all from the same passes.

    ``x`` holds numbers, no null, NaN or infinity.  The value range of a key is cut into
    bins, the bins that hold a wanted rank are cut again, until each holds one value.  A
    round is one job for all keys and ranks; it brings ``bins`` rows a bracket at most to
    the driver, and no task holds values.
    """
    spark = rows.sparkSession
    bounds = {r["key"]: (r["n"], r["lo"], r["hi"]) for r in rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}
    kind = rows.schema["x"].dataType.simpleString()
    key_kind = rows.schema["key"].dataType.simpleString()
    found: dict[tuple[object, int], Ranked] = {}
    open_: dict[tuple, list[int]] = {}  # (key, lo, hi, below) and the ranks inside
    for key, ranks in wanted.items():
        n, lo, hi = bounds.get(key, (0, None, None))
        inside = [r for r in dict.fromkeys(ranks) if 0 <= r < n]
        if inside and lo == hi:
            found |= {(key, r): Ranked(lo, 0, n) for r in inside}
        elif inside:
            open_[key, lo, hi, 0] = inside
    while open_:
        brackets = list(open_)
        table = spark.createDataFrame([(i, k, lo, hi) for i, (k, lo, hi, _) in enumerate(brackets)], f"i int, k {key_kind}, lo {kind}, hi {kind}")
        half = lambda c: F.col(c).cast("double") / 2
        # halves, as the whole width of a bracket may be no double; longs are subtracted exactly
        share = (F.col("x") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") if kind == "bigint" \
            else (half("x") - half("lo")) / (half("hi") - half("lo"))
        counts = rows.join(F.broadcast(table), F.col("key").eqNullSafe(F.col("k")) & F.col("x").between(F.col("lo"), F.col("hi"))).groupBy(
            "i", F.least(F.lit(bins - 1), F.floor(share * bins)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        by_bracket: dict[int, list] = {}
        for r in sorted(counts.collect(), key=lambda r: r["bin"]):
            by_bracket.setdefault(r["i"], []).append(r)
        before, open_ = open_, {}
        for i, bracket in enumerate(brackets):
            key, lo, hi, below = bracket
            for r in by_bracket[i]:
                inside = [k for k in before[bracket] if below <= k < below + r["n"]]
                if inside and (r["lo"] == r["hi"]):
                    found |= {(key, k): Ranked(r["lo"], below, r["n"]) for k in inside}
                elif inside and (r["lo"], r["hi"]) == (lo, hi):
                    raise ArithmeticError(f"values between {lo} and {hi} lie too close to be told apart")
                elif inside:
                    open_[key, r["lo"], r["hi"], below] = inside
                below += r["n"]
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
                    accuracy: int = 10_000, exact_limit: int = 2_000_000) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of many columns from shared passes; null and NaN are no values.

    Every column gives its rows a key, and :func:`select_ranks` finds the two ranks around
    each quantile of all columns at once.  ``accuracy`` and ``exact_limit`` are no longer
    needed and have no effect.
    """
    columns = list(dict.fromkeys(columns))
    infinite = float("inf")
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("key"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(columns)])).alias("c")).select("c.*")
    cells = cells.filter(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = {r["key"]: (r["n"], r["low"], r["high"]) for r in cells.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") == -infinite).alias("low"), F.count_if(F.col("x") == infinite).alias("high")).collect()}
    wanted: dict[object, list[int]] = {}
    for key, (n, low, high) in ends.items():
        ranks = {r for p in probabilities for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))}
        wanted[key] = [r - low for r in ranks if low <= r < n - high]
    found = select_ranks(cells.filter(F.abs("x") != infinite), wanted)

    def at(key: int, rank: int) -> float:
        n, low, high = ends[key]
        return -infinite if rank < low else infinite if rank >= n - high else found[key, rank - low].value

    def quantile(key: int, p: float) -> float | None:
        if key not in ends:
            return None
        place = p * (ends[key][0] - 1)
        a, b = at(key, math.floor(place)), at(key, math.ceil(place))
        return a if a == b else a + (b - a) * (place - math.floor(place))
    return {c: [quantile(i, p) for p in probabilities] for i, c in enumerate(columns)}
