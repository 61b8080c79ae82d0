"""Phrase collocations by relational mining of word occurrences, one length after the other."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import arrow_rows, stored

UNKNOWN = "und"
# of every byte: 0 within a word, 1 between words, 2 between pieces; A-Z become a-z
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

COUNT_PAIRS = 700_000  # pairs that are counted at once before they leave a task
BATCH_ROWS = 1000  # texts, or rows of some hundred occurrences, that Python gets at a time
FILTER_BITS = 1 << 26  # of the filter of frequent groups, 8 MB, whatever their number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def joined_id(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The id of the phrase that two overlapping phrases, or two words, make."""
    return _mixed(_mixed(left.view(np.uint64)) * np.uint64(3) + right.view(np.uint64)).view(np.int64)


def word_id(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang)) - (1 << 63)


# --- words of texts ---------------------------------------------------------------------


def occurrences(text: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """Words of UTF-8 bytes, with their piece's number and place in it, all in order."""
    kind = _KIND[text]
    inside = np.concatenate([[False], kind == 0, [False]])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    ends = np.flatnonzero(inside[:-1] & ~inside[1:])
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])
    piece = breaks[starts]
    at = np.arange(len(starts))
    first = np.concatenate([[True], piece[1:] != piece[:-1]]) if len(piece) else np.zeros(0, bool)
    place = at - np.maximum.accumulate(np.where(first, at, 0)) if len(piece) else at
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)), pa.py_buffer(_FOLD[text[kind == 0]])])
    return words, piece, place


def _texts_by_lang(batches: Iterator[pa.RecordBatch], most_bytes: int = 2 << 20) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, text bytes) of some texts at a time, a line end after each."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_buffer()
            if text is not None and text.size:
                held.setdefault(lang, []).append(text)
                size += text.size
            if size >= most_bytes:
                yield from ((k, np.frombuffer(b"\n".join(v), np.uint8)) for k, v in held.items())
                held, size = {}, 0
    yield from ((k, np.frombuffer(b"\n".join(v), np.uint8)) for k, v in held.items())


def _source(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, id, word, f) of all words; counted a task first, so a frequent word is one row a task."""
    schema = pa.schema([("lang", pa.string()), ("id", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _texts_by_lang(batches):
            found = occurrences(text)[0].dictionary_encode()
            words = found.dictionary.to_pylist()
            n = np.bincount(found.indices.to_numpy(), minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array([word_id(lang, w) for w in words], pa.int64()), pa.array(words, pa.binary()), pa.array(n, pa.int64())], schema=schema)

    return docs.mapInArrow(count, "lang string, id long, word binary, n long").groupBy("lang", "id", "word").agg(F.sum("n").alias("f"))


# --- filters of frequent groups ---------------------------------------------------------


def _places(ids: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = _mixed(ids.view(np.uint64))
    return h % np.uint64(bits), (h >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(bits)


def frequent_filter(ids: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """Bitmap in which every id of ``ids`` has set its two bits.

    Its size is fixed, so it can go to every task.  A task sends the 64-bit words that it
    sets, which are united by word before they reach the driver: at most ``bits`` / 64 rows.
    """
    schema = pa.schema([("at", pa.int64()), ("bits", pa.int64())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = [p.astype(np.int64) for batch in batches for p in _places(batch.column(0).to_numpy(zero_copy_only=False), bits)]
        places = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(places >> 6, prepend=-1))
        words = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first).view(np.int64) if len(first) else places
        at = places[first] >> 6
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i:i + 100_000]), pa.array(words[i:i + 100_000])], schema=schema)

    found = ids.mapInArrow(mark, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return words


def _passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    ok = np.ones(len(ids), bool)
    for place in _places(ids, len(words) * 64):
        ok &= (words[(place >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (place & np.uint64(63))) & np.uint64(1) == 1
    return ok


# --- occurrence relations ---------------------------------------------------------------

RELATION = pa.schema([("piece", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("id", pa.list_(pa.int64()))])
RELATION_DDL = "piece array<int>, place array<int>, id array<long>"


def _block(piece: np.ndarray, place: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """A block of the relation as rows of some hundred occurrences, cut between pieces."""
    new = np.flatnonzero(np.diff(piece)) + 1
    cuts = np.unique(new[np.searchsorted(new, np.arange(200, len(piece), 200)).clip(max=max(0, len(new) - 1))]) if len(new) else new
    ends = pa.array(np.concatenate([[0], cuts, [len(piece)]]).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((piece, pa.int32()), (place, pa.int32()), (ids, pa.int64()))], schema=RELATION)


def word_relation(docs: DataFrame, frequent) -> DataFrame:
    """The sorted relation of the occurrences of frequent words: rows of (piece, place, id) of whole pieces."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _texts_by_lang(batches):
            words, piece, place = occurrences(text)
            found = words.dictionary_encode()
            ids = np.array([word_id(lang, w) for w in found.dictionary.to_pylist()], np.int64)
            keep = _passes(frequent.value, ids)[found.indices.to_numpy()] if len(ids) else np.zeros(0, bool)
            if keep.any():
                yield _block(piece[keep], place[keep], ids[found.indices.to_numpy()[keep]])

    return docs.mapInArrow(rows, RELATION_DDL)


def _neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(piece, place, left, right, row) of occurrences at adjacent places of one piece; ``row`` is where in the batch.

    The merge join of the relation with itself: it is sorted by piece and place, so a
    partner, if there is one, is the next entry.
    """
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in batch.columns]
    row = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(0).offsets.to_numpy()))
    piece, place, ids = flat
    fits = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1]) & (place[1:] == place[:-1] + 1)
    return piece[:-1][fits], place[:-1][fits], ids[:-1][fits], ids[1:][fits], row[:-1][fits]


def pair_counts(relation: DataFrame) -> DataFrame:
    """(left, right, f) of the joined relation; counted in parts of a task, then a task, then all."""
    schema = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])

    def counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        left, right = (np.concatenate(c) for c in zip(*parts, strict=True))
        _, first, n = np.unique(joined_id(left, right), return_index=True, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(left[first]), pa.array(right[first]), pa.array(n, pa.int64())], schema=schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            _, _, left, right, _ = _neighbours(batch)
            parts.append((left, right))
            held += len(left)
            if held >= COUNT_PAIRS:
                yield counted(parts)
                parts, held = [], 0
        if held:
            yield counted(parts)

    return relation.mapInArrow(count, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("f"))


def extended(relation: DataFrame, frequent) -> DataFrame:
    """The relation of the next length, of groups that may be frequent, in the same order and rows.

    Piece numbers begin again in other rows, so rows are not joined to longer ones.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            piece, place, left, right, row = _neighbours(batch)
            ids = joined_id(left, right)
            keep = _passes(frequent.value, ids)
            if keep.any():
                sizes = np.bincount(row[keep])
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x[keep], t)) for x, t in ((piece, pa.int32()), (place, pa.int32()), (ids, pa.int64()))], schema=RELATION)

    return relation.mapInArrow(rows, RELATION_DDL)


def _joined_id(left: str, right: str) -> Column:
    """``joined_id`` by its Python form, on few rows: the frequent groups."""
    @F.pandas_udf("long")
    def of(a, b):
        import pandas as pd
        return pd.Series(joined_id(np.ascontiguousarray(a.to_numpy(np.int64)), np.ascontiguousarray(b.to_numpy(np.int64))))
    return of(left, right)


# --- collocations -----------------------------------------------------------------------


def score_of(a: str, left: str, right: str) -> Column:
    """floor(2000000 * a / (left + right)), exactly."""
    return F.expr(f"CAST(CAST(2000000 AS DECIMAL(7,0)) * CAST({a} AS DECIMAL(19,0)) div (CAST({left} AS DECIMAL(19,0)) + CAST({right} AS DECIMAL(19,0))) AS BIGINT)")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, share: int = 80, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Candidates are the phrases of 2 to ``longest`` words that occur ``least`` times within
    pieces, overlaps included.  A candidate's score is the lowest over its cuts in two, of
    the first cut among equals; candidates that lie in a longer one with ``share`` per cent
    of their count are dropped.  A null lang is ``und``, a null text empty; repeated rows
    count each; ties in score go by count, then by phrase in byte order; an empty table, or
    one without frequent phrases, gives no rows.  Other columns are not used.

    1. Words are counted, and the occurrences of frequent ones written as a relation
       sorted by piece and place.
    2. The relation is merge-joined with itself at adjacent places, and the pairs are
       counted: of two phrases of k words that overlap in all but one, the phrase of k + 1
       words, which is frequent only if both are.
    3. The pairs of frequent groups are written as the relation of the next length, and so
       on.  That semi-join is by a bitmap of fixed size, which may let others pass; they
       are counted again at the next length and dropped by their count there.

    Ids are 64-bit hashes of language and word, and of the ids joined; words are counted by
    themselves, phrases by the ids of their two parts, and only frequent parts come to be
    ids, so two frequent groups of one language would have to meet.  No relation is
    shuffled; counts are, after two rounds of partial sums.
    """
    spark = docs.sparkSession
    source = _source(docs, lang, text)
    with arrow_rows(spark, BATCH_ROWS):
        words = stored(word_counts(source), "word-counts")
        totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        level = words.where(F.col("f") >= least).select(
            "lang", "id", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"))
        relation, found = None, []
        for length in range(2, longest + 1):
            frequent = spark.sparkContext.broadcast(frequent_filter(level.select("id")))
            relation = stored(word_relation(source, frequent) if relation is None else extended(relation, frequent), f"occurrences-{length - 1}")
            pairs = pair_counts(relation).where(F.col("f") >= least)
            a = level.select(F.col("lang"), F.col("id").alias("left"), F.col("phrase").alias("a_phrase"), F.col("f").alias("fa"), F.col("heads").alias("a_heads"))
            b = level.select(F.col("id").alias("right"), F.col("last"), F.col("tails").alias("b_tails"), F.col("f").alias("fb"))
            # heads: counts of the first 1, 2 ... words, tails: of the last 1, 2 ... words
            level = stored(pairs.join(a, "left").join(b, "right").select(
                "lang", _joined_id("left", "right").alias("id"), F.concat_ws(" ", "a_phrase", "last").alias("phrase"), "last", "f",
                F.concat("a_heads", F.array("f")).alias("heads"), F.concat("b_tails", F.array("f")).alias("tails"), "left", "right"), f"phrases-{length}")
            found.append(level)
    candidates = None
    for i, rows in enumerate(found):
        length = i + 2
        cuts = F.transform(F.sequence(F.lit(1), F.lit(length - 1)), lambda k: F.struct(F.get("heads", k - 1).alias("l"), F.get("tails", F.lit(length - 1) - k).alias("r")))
        scored = rows.select("lang", "id", "phrase", F.col("f").alias("a"), F.posexplode(cuts).alias("k", "c")).select(
            "*", score_of("a", "c.l", "c.r").alias("score")).groupBy("lang", "id", "phrase", "a").agg(F.min(F.struct("score", "k", F.col("c.l").alias("l"), F.col("c.r").alias("r"))).alias("s"))
        if i + 1 < len(found):
            # what holds a phrase and has most occurrences is one word longer
            longer = found[i + 1].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("within"))
            scored = scored.join(longer, "id", "left").where(F.expr(f"within IS NULL OR CAST(100 AS DECIMAL(3,0)) * CAST(within AS DECIMAL(19,0)) < CAST({share} AS DECIMAL(3,0)) * CAST(a AS DECIMAL(19,0))"))
        scored = scored.select("lang", "phrase", "a", "s.l", "s.r", "s.score")
        candidates = scored if candidates is None else candidates.unionByName(scored)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return candidates.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top).join(F.broadcast(totals), "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score")
