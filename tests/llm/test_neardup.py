"""Components against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from packetloom.llm import neardup, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    rows = [(d, shingles(t)) for d, t in rows if d is not None]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, (_, a) in enumerate(rows):
        for j in range(i):
            b = rows[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)], low[root(i)] == d) for i, (d, s) in enumerate(rows))


def copies():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(5, 150))]
        for _ in range(rng.randint(1, 12)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
    chain = [word() for _ in range(60)]
    for _ in range(25):  # each is close to the next only
        rows.append(" ".join(chain))
        chain = chain[3:] + [word() for _ in range(3)]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("rows", [copies(), [], [(5, None)], [
    (1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tB"), (6, "a b c"), (7, "same text here for us"), (7, "same text here for us"), (8, "SAME text here for us"),
    (9, "two texts of one id"), (9, "a b"), (None, "a b"), (10, "w " * 60_000), (11, "w w w w w"), (12, "long " + "é ü " * 30_000), (13, "long " + "é ü " * 30_001)]])
def test_against_brute_force(spark, tables, rows):
    folder = tables(documents=([(d, t, 1, "b") for d, t in rows], "doc_id bigint, text string, node int, doc string"))
    assert sorted(tuple(r) for r in queries.QUERIES["op3_near_duplicates"](spark, folder).collect()) == brute(rows)


def test_one_group_of_many(spark):
    """Hundreds of near copies of one text, not all close to its smallest."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(400):
        own = list(base)
        for _ in range(rng.randint(0, 3)):
            own[rng.randrange(80)] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert sorted(tuple(r) for r in got) == brute(rows)


def test_components(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 101), (200, 200)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 103, 200]], "node int")
    got = dict(neardup.components(nodes, spark.createDataFrame(links, "a int, b int")).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 103: 100, 102: 102, 200: 200}


def test_odd_sketches_follow_the_similarity():
    rng = np.random.default_rng(1)
    apart = []
    for common in (300, 257, 200, 0):
        a = rng.integers(0, 1 << 63, 600 - common, dtype=np.uint64)
        s, t = (neardup.odd_sketch(neardup.minhash(x)) for x in (a[:300], a[300 - common:]))
        apart.append(sum(int(v).bit_count() for v in (s ^ t).view(np.uint64)))
    assert apart == sorted(apart) and apart[0] == 0 and apart[1] < neardup.sketch_limit(0.75) < apart[3]


def test_large_sketches_rule_out_seven_tenths():
    """Half of the pairs at 0.67 leave the join of open buckets at most, and none at 0.75 stays in it."""
    rng = np.random.default_rng(2)
    limit, passed = neardup.sketch_limit(0.75, neardup.FINE_SAMPLES, neardup.FINE_BITS), {}
    for per_cent in (67, 75):
        common = 400 * per_cent // 100
        pairs = [rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(40)]
        own = (400 - common) // 2
        sketches = [[neardup.odd_sketch(neardup.minhash(x, neardup.FINE_SAMPLES), neardup.FINE_BITS) for x in (a[own:], a[:400 - own])] for a in pairs]
        passed[per_cent] = sum(sum(int(v).bit_count() for v in (s ^ t).view(np.uint64)) <= limit for s, t in sketches)
    assert passed[67] <= 20 and passed[75] == 40


def test_kept_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (2, "a b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, "n")], "doc_id int, text string, kept string")
    assert sorted(map(str, neardup.drop_near_duplicates(df).collect())) == sorted(map(str, df.where("doc_id IS NULL OR doc_id != 2").collect()))


def test_bands_that_would_miss_pairs_are_refused(spark):
    with pytest.raises(ValueError):
        neardup.near_duplicates(spark.createDataFrame([(1, "a b c d e f")], "doc_id int, text string"), per_cent=50)


def test_texts_of_one_key_are_judged_apart(spark):
    rows = [(1, "a b c d e f g h"), (1, "completely other words that make a text of its own"), (0, "a b c d e f g h"), (None, "a b c d e f g h"), (2, None)]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [rows[1], rows[2], rows[3], rows[4]]))
