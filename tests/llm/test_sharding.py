"""Shards against a brute-force minimax partition."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest

from packetloom.llm import queries, sharding


def least_capacity(sizes, shards):
    """By dynamic programming over all contiguous partitions."""
    ends = [0]
    for s in sizes:
        ends.append(ends[-1] + s)
    best = ends[:]
    for _ in range(shards - 1):
        best = [min(max(best[i], ends[j] - ends[i]) for i in range(j + 1)) for j in range(len(ends))]
    return best[-1]


def groups_of(rows):
    """(text, bytes) in order, without those above an even share, whose number comes too."""
    found, first = Counter(), {}
    for i, t in rows:
        t = t or ""
        found[t] += len(t.encode()) + 1
        first.setdefault(t, []).append(i)
    own, left, rest = set(), 16, sum(found.values())
    for t, b in sorted(found.items(), key=lambda x: -x[1])[:15]:
        if left > 1 and b * left > rest:
            own.add(t)
            left, rest = left - 1, rest - b
    key = lambda t: (min(first[t]) if None not in first[t] else -2 ** 63)
    return [(t, found[t]) for t in sorted(found, key=key) if t not in own], left


def check(rows, got):
    assert Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows) == Counter((r.doc_id, r.size, r.text_crc32) for r in got)
    slots, shards, bytes_of = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        bytes_of[r.shard] += r.size
        shards[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    groups, left = groups_of(rows)
    if groups:
        assert max(bytes_of[s] for s in range(left)) == least_capacity([b for _, b in groups], left)
        where = [next(iter(shards[zlib.crc32(t.encode()), len(t.encode()) + 1])) for t, _ in groups]
        assert where == sorted(where)


def test_query_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.QUERIES["op12_minimax_shards"](spark, sf_dir).collect())


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(7, "one")] * 40, [(i, f"t{i}") for i in range(15)],
    [(None, None), (None, ""), (1, "é日本"), (1, "é日本"), (1, "other"), (2, "x" * 200_000), (3, None), *((i, "same " * 9) for i in range(10, 60)), *((i, f"text {i} " * (i % 7)) for i in range(60, 200))]])
def test_edge_rows(spark, tables, rows):
    folder = tables(documents=([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, shard int, digest string"))
    check(rows, queries.QUERIES["op12_minimax_shards"](spark, folder).collect())


@pytest.mark.parametrize("bins", [20, 64, 5000])
def test_capacity_at_every_resolution(spark, bins):
    rng = random.Random(bins)
    for sizes in ([rng.randint(1, 900) for _ in range(300)], [1] * 100 + [50] + [1] * 77, [10 ** 12 + rng.randint(0, 5) for _ in range(33)]):
        ends = [0]
        for s in sizes:
            ends.append(ends[-1] + s)
        cuts = sharding.cut_points(spark.createDataFrame([(e,) for e in ends[1:]], "end long"), max(sizes), ends[-1], 5, bins)
        assert cuts[-1] == ends[-1] and set(cuts) <= set(ends)
        assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) == least_capacity(sizes, 5)
