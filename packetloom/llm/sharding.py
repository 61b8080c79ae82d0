"""Sharding by a minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored, text_or_empty

BINS = 32_768  # rows a round of the capacity search brings to the driver, at most twice


class Steps:
    """What is known of the sorted border positions: (first, last) of those in each bin of some stretches.

    ``below`` answers "the largest border not over x" by a lower and an upper bound, which
    are equal unless x falls between the first and the last border of one bin.
    """

    def __init__(self, bins: list[tuple[int, int]]):
        self.firsts = [b[0] for b in bins]
        self.lasts = [b[1] for b in bins]

    def below(self, x: int) -> tuple[int, int]:
        at = bisect_right(self.firsts, x) - 1
        if at < 0:
            return 0, 0
        return (self.lasts[at],) * 2 if self.lasts[at] <= x else (self.firsts[at], x)

    def walk(self, capacity: int, shards: int, start: int, side: int) -> list[int]:
        """Ends of the shards that greedy filling reaches, each by the lower (0) or upper (1) bound."""
        ends = []
        for _ in range(shards):
            start = max(start, self.below(start + capacity)[side])
            ends.append(start)
        return ends

    def smallest(self, low: int, high: int, shards: int, start: int, total: int, side: int) -> int:
        """Smallest capacity in [low, high] whose greedy filling reaches ``total``; ``high`` does."""
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, start, side)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low


def merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(stretches):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _bins(ends: DataFrame, stretches: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """(first, last) border of every filled bin, the stretches cut into bins of ``width``."""
    where, number = F.lit(False), F.lit(None).cast("long")
    for i, (low, high) in enumerate(stretches):
        inside = F.col("end").between(low, high)
        where = where | inside
        number = F.when(inside, F.lit(i).cast("long") * (1 << 40) + F.floor((F.col("end") - low) / width)).otherwise(number)
    found = ends.where(where).groupBy(number.alias("bin")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
    return sorted((r["first"], r["last"]) for r in found.collect())


def cut_points(ends: DataFrame, largest: int, total: int, shards: int, bins: int = BINS) -> list[int]:
    """Ends of ``shards`` contiguous shards of least possible largest size.

    ``ends`` holds the running totals ``end`` of the ordered group sizes.  A capacity is
    checked greedily: every shard is filled up to the last border that fits.  The search
    for the smallest feasible capacity is a binary search over bounds: borders are known
    to a bin, so greedy filling by lower bounds says which capacities are surely feasible
    and by upper bounds which surely are not.  What lies between is looked up again, only
    around the ends that the two fillings reach and with finer bins, until both agree.
    A round's bins are at most half as wide as those before and some ``bins`` in number,
    each two numbers for the driver, whatever the table holds; bins of width 1 are exact.
    """
    width = max(1, -(-total // bins))
    known = _bins(ends, [(1, total)], width)
    low, high = max(largest, -(-total // shards)), total
    while True:
        steps = Steps(known)
        surely = steps.smallest(low, high, shards, 0, total, 0)
        at_least = steps.smallest(low, surely, shards, 0, total, 1)
        low, high = at_least, surely
        reach_low, reach_high = steps.walk(low, shards, 0, 0), steps.walk(high, shards, 0, 1)
        if low == high and reach_low == reach_high:
            return reach_low
        starts = zip([0, *reach_low[:-1]], [0, *reach_high[:-1]], strict=True)
        asked = merged([(max(1, steps.below(a + low)[0]), min(total, b + high)) for a, b in starts])
        width = max(1, min(width // 2, -(-sum(b - a + 1 for a, b in asked) // bins)))
        known = _bins(ends, asked, width)  # no capacity in question reaches a border outside


def _in_order(groups: DataFrame) -> DataFrame:
    """``groups`` with running totals ``end`` of ``bytes`` and ``row_end`` of ``n``, in the order of first id and digest.

    Ranges of the order are written, summed, and each is run through on its own from the
    totals of those before; only one row a range meets in one place.
    """
    ranged = stored(groups.repartitionByRange(F.col("first").asc_nulls_first(), "digest").withColumn("range", F.spark_partition_id()), "ordered-groups")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range").agg(F.sum("bytes").alias("b"), F.sum("n").alias("r"))
    offsets = totals.select("range", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("r").over(before), F.lit(0)).alias("rows_before"))
    within = Window.partitionBy("range").orderBy(F.col("first").asc_nulls_first(), "digest").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), "range").select(
        "digest", "bytes", "n", (F.sum("bytes").over(within) + F.col("bytes_before")).alias("end"), (F.sum("n").over(within) + F.col("rows_before")).alias("row_end"))


def assign(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", bins: int = BINS) -> DataFrame:
    """One row a row of ``docs``: key, size, text_crc32, shard, slot.

    Rows of equal texts are one atomic group (a null text counts as an empty one); groups
    are ordered by their smallest key, nulls first, then by digest.  ``size`` is the UTF-8
    bytes of the text plus one.  Shards are contiguous stretches of that order, cut at the
    smallest capacity that ``shards`` shards can keep; a group above an even share of the
    bytes first gets a shard of its own, so that it does not set the capacity of the
    others.  ``slot`` numbers the rows of a shard from 0 without gaps.

    An empty table gives no rows; repeated rows and keys each have their row and slot;
    shards may stay empty where there are fewer groups.  Other columns are not used.

    Rows are written once without their texts, with the task that read them; counts a
    (group, task) are summed before any shuffle, so a text that a third of all rows hold is
    one row a task there, and its rows are numbered by task, never in one place.
    """
    whole = text_or_empty(text)
    rows = stored(docs.select(
        F.col(key).alias("key"), F.octet_length(whole).cast("long").alias("octets"), F.crc32(whole.cast("binary")).alias("crc"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("nr")), "shard-rows").withColumn("size", F.col("octets") + 1)
    counts = stored(rows.groupBy("digest", "task").agg(F.count("*").alias("n"), F.min("key").alias("first"), F.count("key").alias("named"), F.first("size").alias("size")), "shard-counts")
    groups = stored(counts.groupBy("digest").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes"), F.when(F.sum("named") == F.sum("n"), F.min("first")).alias("first")), "shard-sums")
    # at most shards - 1 groups can be above an even share
    own, left, rest = [], shards, groups.agg(F.sum("bytes")).first()[0] or 0
    for r in groups.orderBy(F.col("bytes").desc(), "digest").limit(shards - 1).select("digest", "bytes").collect():
        if left > 1 and r["bytes"] * left > rest:
            own.append(bytes(r["digest"]))
            left, rest = left - 1, rest - r["bytes"]
    alone = F.lit(None).cast("int")
    for i, digest in enumerate(own):
        alone = F.when(F.col("digest") == F.lit(digest), left + i).otherwise(alone)
    placed = stored(_in_order(groups.where(alone.isNull())), "shard-groups")
    bounds = placed.agg(F.max("bytes").alias("largest"), F.max("end").alias("total")).first()
    cuts = cut_points(placed.select("end"), bounds["largest"], bounds["total"], left, bins) if bounds["total"] else []
    shard = F.lit(left - 1)
    for i, cut in reversed(list(enumerate(cuts))):
        shard = F.when(F.col("end") <= cut, i).otherwise(shard)
    placed = placed.select("digest", shard.alias("shard"), (F.col("row_end") - F.col("n")).alias("rows_before"))
    starts = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_start"))
    placed = placed.join(F.broadcast(starts), "shard").select("digest", "shard", (F.col("rows_before") - F.col("shard_start")).alias("at"))
    single = groups.where(alone.isNotNull()).select("digest", alone.alias("shard"), F.lit(0).cast("long").alias("at"))
    earlier = Window.partitionBy("digest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    parts = counts.select("digest", "task", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_at")).join(placed.unionByName(single), "digest").select(
        "digest", "task", "shard", (F.col("at") + F.col("part_at")).alias("at"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("digest", "task").orderBy("nr")))
    return numbered.join(parts, ["digest", "task"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("i") - 1).cast("long").alias("slot"))
