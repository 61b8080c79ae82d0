"""Benchmark decontamination: word-level Wu-Manber search for passages of test items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lower-cases A-Z and turns every other ASCII byte that is no letter or digit into a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
])


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search tables for one length of test strings, all of ``length`` words.

    A block is the last two words of a position (one word for strings of one word).
    ``shift`` gives how far the search may jump when a block ends there: a block that no
    string holds lets it jump over ``length - 1`` words at once.  At shift 0 the block is
    the end of some string; its bucket holds those strings, compared word by word.
    """

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.skip = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}

    def add(self, words: tuple, item: str) -> None:
        for end in range(self.block, self.length + 1):
            block = words[end - self.block:end]
            self.shift[block] = min(self.shift.get(block, self.skip), self.length - end)
        self.buckets.setdefault(words[-self.block:], {}).setdefault(words, set()).add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(start, items) of every occurrence."""
        length, skip, n = self.length, self.skip, len(words)
        shift, buckets, end = self.shift.get, self.buckets, self.length - 1
        two = self.block == 2
        while end < n:
            block = (words[end - 1], words[end]) if two else (words[end],)
            step = shift(block, skip)
            if step:
                end += step
                continue
            start = end - length + 1
            found = buckets[block].get(tuple(words[start:end + 1]))
            if found:
                yield start, found
            end += 1


def build(items: list[tuple[str, bytes | None]], window: int) -> list[WuManber]:
    """One set of tables per string length: short items must not shorten the jumps of the others."""
    by_length: dict[int, WuManber] = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        if size:
            tables = by_length.setdefault(size, WuManber(size))
            for i in range(len(words) - size + 1):
                tables.add(tuple(words[i:i + size]), item)
    return list(by_length.values())


def union_spans(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list[tuple[str, bytes | None]]]:
    """The test items in blocks of bounded size, one after the other."""
    rows = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("i"), F.col(text).cast("binary").alias("t"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        block.append((row.i, bytes(row.t) if row.t is not None else None))
        held += len(block[-1][1] or b"")
        if held >= block_chars:
            yield block
            block, held = [], 0
    if block:
        yield block


def find_passages(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """``docs`` with a column ``hits``: ``n_words``, ``spans`` and ``item_ids``.

    ``spans`` are the disjoint [start, end) word ranges of ``docs`` inside some ``window``
    consecutive words of a test item (inside all words of an item that has fewer),
    ``item_ids`` the items with such windows, as sorted strings.

    Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
    A null or wordless text has no words and no hits; a wordless item matches nothing; a
    null item id counts as the empty string; repeated items count once.  All other columns
    of ``docs`` are kept as they are (one named ``hits`` would be replaced).

    The test set is the stated query set: it goes to the tasks in blocks of
    ``block_chars`` bytes, each block one pass over the same partitions without a shuffle,
    so that neither driver closure nor task holds more than one block of tables at once.
    """
    out = docs.withColumn("hits", F.lit(None).cast(HITS))
    searched = False
    for block in _blocks(benchmark, item, item_text, block_chars):
        out, searched = _pass(out, text, block, window), True
    return out if searched else _pass(out, text, [], window)


def _pass(df: DataFrame, text: str, block: list[tuple[str, bytes | None]], window: int) -> DataFrame:
    at, hit_at = df.columns.index(text), df.columns.index("hits")
    holder = df.sparkSession.sparkContext.broadcast(block)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = build(holder.value, window)
        for batch in batches:
            column = []
            for value, before in zip(batch.column(at).cast(pa.large_binary()), batch.column(hit_at).to_pylist(), strict=True):
                words = words_of(value.as_py())
                spans, items = [], set()
                for tables in classes:
                    for start, found in tables.search(words):
                        spans.append([start, start + tables.length])
                        items |= found
                if before:
                    spans += before["spans"]
                    items |= set(before["item_ids"])
                column.append({"n_words": len(words), "spans": union_spans(spans), "item_ids": sorted(items)})
            arrays = list(batch.columns)
            arrays[hit_at] = pa.array(column, batch.schema.field(hit_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=batch.schema)

    return df.mapInArrow(search, df.schema)


def n_hit(hits: str = "hits"):
    """Words of a document inside any span."""
    return F.aggregate(F.col(f"{hits}.spans"), F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without those that share a window with a test item; all columns as before."""
    return find_passages(docs, benchmark, **options).where(F.size("hits.spans") == 0).select(*docs.columns)
