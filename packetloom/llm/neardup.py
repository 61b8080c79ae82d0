"""MinHash near-duplicates with odd sketches as the filter before whole sets are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import stored

BANDS, BAND_ROWS = 30, 4
SAMPLES, SKETCH_BITS = BANDS * BAND_ROWS, 512
# of nodes in buckets that hold several components: half as many samples as bits part similarities best
FINE_SAMPLES, FINE_BITS = 2048, 4096
_SPACE_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_RNG = np.random.default_rng(20_240_101)
_DRAWN = [(_RNG.integers(1 << 32, 1 << 63, 1024, dtype=np.uint64), _RNG.integers(0, 1 << 63, 1024, dtype=np.uint64)) for _ in range(FINE_SAMPLES // 1024)]
_MULTIPLY = np.concatenate([m for m, _ in _DRAWN]) * np.uint64(2) + np.uint64(1)
_ADD = np.concatenate([a for _, a in _DRAWN])


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``size`` words, of all words where there are fewer.

    Words are runs without ASCII white space, A-Z lower-cased.
    """
    words = text.translate(_SPACE_FOLD).split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    runs = np.full(len(words) - size + 1, size, np.uint64)
    for i in range(size):
        runs = _mixed(runs * np.uint64(0xD6E8FEB86659FD93) + each[i:len(words) - size + 1 + i])
    return np.unique(runs)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def minhash(hashes: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """Smallest value of the set under each of the hash functions."""
    best, part = None, max(32, 130_000 // samples)  # small enough for the cache
    for i in range(0, len(hashes), part):
        low = (hashes[i:i + part] * _MULTIPLY[:samples, None] + _ADD[:samples, None]).min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, with the band's number mixed in."""
    key = np.arange(BANDS, dtype=np.uint64)
    for column in samples.reshape(BANDS, BAND_ROWS).T:
        key = _mixed(key ^ _mixed(column))
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap: every (function, sample) flips one bit."""
    bit = _mixed(samples + np.arange(len(samples), dtype=np.uint64) * np.uint64(0x1000193)) % np.uint64(bits)
    odd = np.bincount(bit.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sketch_limit(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, deviations: float = 6.0) -> int:
    """Most bits in which the sketches of two sets of at least that similarity differ, but for one pair in a billion.

    Of the samples 1 - similarity differ, with the deviation of a binomial; each differing
    one flips two bits, and flips that meet cancel out, which adds a deviation of its own.
    """
    flips = 2 * samples * (1 - similarity)
    single = (1 - 2 / bits) ** flips
    of_samples = 2 * single * (samples * similarity * (1 - similarity)) ** 0.5
    of_meetings = max(0.0, bits / 4 * (1 - single ** 2) - flips * single ** 2)
    return int(bits / 2 * (1 - single) + deviations * (of_samples ** 2 + of_meetings) ** 0.5)


SIGNED = pa.schema([("doc", pa.int64()), ("node", pa.binary()), ("n_shingles", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
SETS = pa.schema([("node", pa.binary()), ("hashes", pa.binary())])


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc, node, n_shingles, bands, sketch) of (doc, text); ``node`` is a 128-bit digest of the shingle set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = shingles(text.as_py(), size)
                node = xxhash.xxh3_128_digest(hashes.tobytes())
                if len(hashes):
                    samples = minhash(hashes)
                    rows.append((doc, node, len(hashes), band_keys(samples), odd_sketch(samples)))
                else:
                    rows.append((doc, node, 0, None, None))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in SIGNED]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SIGNED, strict=True)], schema=SIGNED)

    return docs.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(sign, "doc long, node binary, n_shingles long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(node, hashes) of (doc, text): the whole sets, eight bytes a shingle, sorted."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t.as_py(), size).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, hashes), pa.binary()), pa.array(hashes, pa.binary())], schema=SETS)

    return docs.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(sets, "node binary, hashes binary")


def fine_sketches(docs: DataFrame, size: int) -> DataFrame:
    """(node, fine) of (doc, text): the large odd sketches."""
    schema = pa.schema([("node", pa.binary()), ("fine", pa.list_(pa.int64()))])

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()),
                pa.array([odd_sketch(minhash(h, FINE_SAMPLES), FINE_BITS) if len(h) else None for h in sets], pa.list_(pa.int64()))], schema=schema)

    return docs.select("doc", F.col("text").cast("binary").alias("text")).mapInArrow(sketches, "node binary, fine array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough: 100 * common >= per_cent * all."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, known = [], {}
            for a, x, y in zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"), strict=True):
                if a not in known:
                    known = {a: np.frombuffer(x.as_py(), np.uint64)}
                left, right = known[a], np.frombuffer(y.as_py(), np.uint64)
                at = np.searchsorted(left, right)
                common = int((left[np.minimum(at, len(left) - 1)] == right).sum()) if len(left) else 0
                keep.append(100 * common >= per_cent * (len(left) + len(right) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return joined.select("a", "b", "x", "y").mapInArrow(compare, "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node that each of ``nodes`` reaches by ``links`` (a, b).

    Alternating star contraction: every node hangs its larger neighbours, then its smaller
    ones, on the smallest node it sees.  Rows per round do not exceed the links twice, the
    rounds grow with the logarithm of the longest chain; each round is written to the
    shared folder.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = stored(small.where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).distinct(), "links")
        left = after.join(after.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        done = left.isEmpty() and after.groupBy("u").count().where("count > 1").isEmpty()
        edges = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("_low")), "node", "left").select(
        "node", F.coalesce("_low", "node").alias("component"))


def _bits_apart(a: str, b: str) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _sizes_fit(per_cent: int) -> Column:
    return 100 * F.least("na", "nb") >= per_cent * F.greatest("na", "nb")


def _side(rows: DataFrame, name: str, sketch: str, *more: str) -> DataFrame:
    return rows.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n{name}"), F.col(sketch).alias(f"s{name}"), *[F.col(c).alias(f"{c}_{name}") for c in more])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, per_cent: int = 75) -> DataFrame:
    """One row a row of ``docs``: key, n_shingles, component_id (smallest key reachable), kept (is that key).

    Documents are linked whose sets of ``size``-word shingles have 100 * common >=
    ``per_cent`` * all, compared as whole sets; texts without words are linked with none.  ``per_cent`` is 75 at least.
    Repeated rows each have their row, rows of one key and different texts are different
    documents of that key, rows without a key are left out.  Other columns are not used.

    1. Documents with equal sets are one node from here on.
    2. Bands of MinHash samples put similar nodes into common buckets: at a similarity of
       0.75 a pair misses all of them once in ninety thousand times.  Each member is paired
       with three leaders of its bucket (the node that shares buckets with most others, the
       smallest and the largest), never members with each other, so a bucket with a
       third of all documents gives no more than thrice as many pairs as it has members.
    3. Odd sketches and sizes rule pairs out, whole sets confirm the rest, links make
       components.
    4. In a bucket that still holds several components, and only there, members of
       different components may be similar although neither is to a leader.  Their
       large sketches are compared within the join, and only pairs that pass leave it.
    """
    if per_cent < 75:
        raise ValueError("per_cent under 75: the bands would miss more pairs than stated")
    docs = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(text, F.lit("")).alias("text")).where(F.col("doc").isNotNull())
    signatures = stored(signed(docs, size), "signatures")
    heads = stored(signatures.where("n_shingles > 0").groupBy("node").agg(
        F.min("doc").alias("first"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]), "nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        used = heads.join(nodes.distinct(), "node", "left_semi")
        return docs.join(used.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi")

    def compared(pairs: DataFrame) -> DataFrame:
        return confirmed(pairs, shingle_sets(texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node"))), size), per_cent)

    members = heads.select("node", F.posexplode("bands").alias("band", "bucket"))
    crowd = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = stored(members.join(crowd, "bucket"), "buckets")
    # the node that meets most others is the likeliest to be what they were copied from
    central = shared.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = shared.join(central, "node").groupBy("bucket").agg(
        F.max(F.struct("met", "node")).alias("most"), F.min("node").alias("least"), F.max("node").alias("last")).select(
        "bucket", F.explode(F.array_distinct(F.array("most.node", "least", "last"))).alias("leader"))
    pairs = shared.join(leaders, "bucket").where("node != leader").select(
        F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    sifted = stored(pairs.join(_side(heads, "a", "sketch"), "a").join(_side(heads, "b", "sketch"), "b").where(
        _sizes_fit(per_cent) & (_bits_apart("sa", "sb") <= sketch_limit(per_cent / 100))).select("a", "b"), "pairs")
    links = stored(compared(sifted), "confirmed")
    settled = stored(components(heads, links), "components")
    # what the leaders of a bucket did not tie together
    placed = shared.drop("n").join(settled, "node")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("bucket")
    rest = stored(placed.join(mixed, "bucket"), "open-buckets")
    fine = fine_sketches(texts_of(rest.select("node")), size).dropDuplicates(["node"])
    rest = rest.join(heads.select("node", "n_shingles", "bands").join(fine, "node"), "node").withColumn("earlier", F.slice("bands", F.lit(1), F.col("band")))
    # a pair leaves the first bucket that it shares only
    across = stored(_side(rest, "a", "fine", "bucket", "component", "earlier").join(
        _side(rest, "b", "fine", "bucket", "component", "earlier"),
        (F.col("bucket_a") == F.col("bucket_b")) & (F.col("component_a") < F.col("component_b")) & _sizes_fit(per_cent)
        & (_bits_apart("sa", "sb") <= sketch_limit(per_cent / 100, FINE_SAMPLES, FINE_BITS)) & ~F.arrays_overlap("earlier_a", "earlier_b")).select("a", "b"), "more-pairs")
    if not across.isEmpty():
        settled = components(heads, links.unionByName(compared(across)))
    named = heads.select("node", "first").join(settled, "node")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    ids = named.join(lowest, "component").select("node", "component_id")
    return signatures.select("doc", "node", "n_shingles").join(ids, "node", "left").select(
        F.col("doc").alias(key), "n_shingles", F.coalesce("component_id", "doc").alias("component_id"), (F.col("doc") == F.coalesce("component_id", "doc")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest key; all columns as before, rows without a key stay.

    Rows of one key and different texts are judged apart: each goes only if its own text is
    in a group that a smaller key stands for.  Of the rows of the smallest key all stay.
    """
    # a text is named by a key that no other text has
    named = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    texts = named.groupBy("id", "digest").agg(F.first("text").alias("text"))
    several = texts.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    if several.isEmpty():
        gone = near_duplicates(docs, key, text, **options).where("NOT kept").select(key).distinct()
        return docs.join(gone, key, "left_anti").select(*docs.columns)
    ordered = stored(texts.withColumn("number", F.dense_rank().over(Window.partitionBy("id").orderBy("digest"))), "texts-of-keys")
    most = ordered.agg(F.max("number")).first()[0]
    numbered = ordered.select((F.col("id").cast("long") * most + F.col("number") - 1).alias("doc"), "text")
    judged = near_duplicates(numbered, "doc", "text", **options).where(F.floor(F.col("component_id") / most) != F.floor(F.col("doc") / most))
    gone = ordered.join(judged, F.col("doc") == F.col("id").cast("long") * most + F.col("number") - 1).select("id", "digest")
    return docs.alias("d").join(gone.alias("g"), (F.col(f"d.{key}") == F.col("g.id")) & F.sha2(F.col(f"d.{text}"), 256).eqNullSafe(F.col("g.digest")), "left_anti").select(*docs.columns)
