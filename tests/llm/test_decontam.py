"""Wu-Manber hits against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from packetloom.llm import decontam, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                got = windows.get(tuple(w[i:i + k]))
                if got:
                    hit |= set(range(i, i + k))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def random_tables():
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("abAé") + rng.choice(["", "1", "-"]) for _ in range(n))
    return [(i, text(rng.randint(0, 80))) for i in range(300)], [(i, text(rng.randint(0, 14))) for i in range(40)]


@pytest.mark.parametrize("docs,items", [
    random_tables(), ([], [(1, "a b")]), ([(1, "a b c"), (2, None)], []),
    ([(None, "x y"), (1, ""), (1, "x y z"), (1, "x y z"), (2, "q " * 90_000 + "one two")], [(None, "x y"), (7, "One, two!"), (7, "one two"), (10, "one two"), (8, None), (9, "?!")])])
def test_against_brute_force(spark, tables, docs, items):
    folder = tables(documents=([(d, t, 1, "s") for d, t in docs], "doc_id bigint, text string, hits int, spans string"),
                    benchmark=([(i, t, "e") for i, t in items], "item_id bigint, text string, hits string"))
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op9_decontamination"](spark, folder).collect()) == brute(docs, items)


def test_blocks_give_the_same(spark):
    docs, items = random_tables()
    d, b = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    assert sorted(map(str, decontam.find_passages(d, b).collect())) == sorted(map(str, decontam.find_passages(d, b, block_chars=60).collect()))
    assert decontam.drop_contaminated(d, b).columns == d.columns
