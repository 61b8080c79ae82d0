"""Threshold-scaled sketches: every shingle hash below a fixed fraction of the hash range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import bind, text_or_empty

BITS = 48  # of a hash; twelve hex digits


def words(text: Column) -> Column:
    """Lower-cased runs without ASCII white space."""
    return F.array_remove(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), "")


def shingle_hashes(text: Column, size: int = 5) -> Column:
    """48-bit hash of every run of ``size`` words; of all words where there are fewer."""
    def of(w: Column) -> Column:
        wide = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        short = F.array(F.xxhash64(F.array_join(w, " ")))
        hashes = F.when(F.size(w) >= size, wide).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))
        return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - BITS))
    return bind(words(text), of)


def sketch(text: Column, fraction: float = 0.5, size: int = 5) -> Column:
    """Sorted distinct shingle hashes below ``fraction`` of the range.

    A text with words but no such hash keeps its smallest one, so that only wordless texts
    have an empty sketch.  Sketches merge: see ``merge``.
    """
    limit = int(fraction * 2 ** BITS)

    def kept(hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit)))
        return bind(low, lambda found: F.when((F.size(found) == 0) & (F.size(hashes) > 0), F.array(F.array_min(hashes))).otherwise(found))
    return bind(shingle_hashes(text, size), kept)


def merge(a: Column, b: Column, fraction: float = 0.5) -> Column:
    """Sketch of two texts' shingles together, from their sketches alone."""
    limit = int(fraction * 2 ** BITS)
    return bind(F.array_sort(F.array_union(a, b)), lambda both: F.when(
        F.get(both, 0) < limit, F.filter(both, lambda h: h < limit)).otherwise(F.slice(both, 1, 1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has too; two empty sketches are alike."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger, which does not depend on how unequal they are."""
    return F.when(F.size(a) <= F.size(b), containment(a, b)).otherwise(containment(b, a))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def printed(hashes: Column) -> Column:
    """The sketch as text: twelve hex digits a hash, in order."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), BITS // 4, "0")), "")


def fingerprint(docs: DataFrame, text: str = "text", out: str = "sketch", fraction: float = 0.5, size: int = 5) -> DataFrame:
    """``docs`` with the sketch of every whole text in ``out`` (array<bigint>); null counts as empty, no shuffle."""
    return docs.withColumn(out, sketch(text_or_empty(text), fraction, size))


def _bucket(key: Column, bounds: list[int], parts: int) -> Column:
    """Number of the value range that ``key`` is in: equally full ranges, each cut into equal widths."""
    at = sum(((key >= b).cast("int") for b in bounds[1:-1]), F.lit(0))
    low, high = F.get(F.array(*map(F.lit, bounds)), at), F.get(F.array(*map(F.lit, bounds)), at + 1)
    share = (key - low).cast("double") / (high - low + 1).cast("double")
    return at * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor(share * parts).cast("int")))


def with_next(docs: DataFrame, key: str, carried: list[str], out: str = "next", ranges: int = 64) -> DataFrame:
    """``docs`` with ``out``: a struct of the ``carried`` columns of the next row by ascending ``key``.

    Rows with equal keys follow in the order of the carried columns, a null key comes
    first, and after the last row comes the first.  An empty table gives an empty one.

    One shuffle moves every row to the value range of its key, ranges being some times
    the shuffle partitions, from a quantile sketch of the key column.  The first row of a
    range also goes to the range before it, so no window sees more than a range.
    Repeated values of one key stay in one range.
    """
    spark = docs.sparkSession
    # columns with the names used here wait under others
    renamed = {c: f"{c} of the table" for c in docs.columns if c in ("_order", "_range", "_head", "_to", "_wrap", "_copy", "_before", "_last")}
    docs, key, carried = docs.withColumnsRenamed(renamed), renamed.get(key, key), [renamed.get(c, c) for c in carried]
    order = F.coalesce(F.col(key).cast("long"), F.lit(-2 ** 63))
    found = docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / ranges for i in range(ranges + 1)], 0.002)
    bounds = sorted({int(b) for b in found}) or [0]
    bounds = bounds if len(bounds) > 1 else [bounds[0], bounds[0] + 1]
    parts = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // (len(bounds) - 1))
    keyed = docs.withColumn("_order", order).withColumn("_range", F.when(F.col(key).isNull(), -1).otherwise(
        _bucket(F.col("_order"), bounds, parts)))
    # one row a range, so a known number of rows: fit for one window and a broadcast
    by_range = Window.orderBy("_range")
    heads = keyed.groupBy("_range").agg(F.min("_order").alias("_head"))
    last = heads.agg(F.max("_range").alias("_last"))
    heads = heads.withColumn("_before", F.lag("_range").over(by_range)).crossJoin(F.broadcast(last)).select(
        F.col("_head").alias("_order"), F.coalesce("_before", "_last").alias("_to"), F.col("_before").isNull().alias("_wrap"))
    copies = F.when(F.col("_to").isNull(), F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("halo"), F.lit(False).alias("wrap")))).otherwise(
        F.array(F.struct(F.col("_range").alias("to"), F.lit(False).alias("halo"), F.lit(False).alias("wrap")),
                F.struct(F.col("_to").alias("to"), F.lit(True).alias("halo"), F.col("_wrap").alias("wrap"))))
    dealt = keyed.join(F.broadcast(heads), "_order", "left").withColumn("_copy", F.explode(copies))
    order_in = Window.partitionBy("_copy.to").orderBy("_copy.wrap", "_order", *[F.col(f"`{c}`") for c in carried], "_copy.halo")
    following = dealt.withColumn(out, F.lead(F.struct(*[F.col(f"`{c}`") for c in carried])).over(order_in))
    return following.where(~F.col("_copy.halo")).select(*[F.col(f"`{c}`") for c in docs.columns], out).withColumnsRenamed({v: k for k, v in renamed.items()})
