"""Collocations against plain Python."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from packetloom.llm import collocations, queries


def want(rows, least=30, share=80, top=2000):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, *words[i:i + k]) for i in range(len(words) - k + 1))
    candidates = [p for p, c in f.items() if c >= least and len(p) > 2]
    out = []
    for lang, *p in candidates:
        a = f[lang, *p]
        score, k = min((2_000_000 * a // (f[lang, *p[:k]] + f[lang, *p[k:]]), k) for k in range(1, len(p)))
        inside = any(q[0] == lang and len(q) > len(p) + 1 and any(list(q[1 + i:1 + i + len(p)]) == p for i in range(len(q) - len(p))) and 100 * f[q] >= share * a for q in candidates)
        if not inside:
            out.append((lang, -score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]], n[lang]))
    out.sort()
    ranks = Counter()
    result = []
    for lang, score, a, phrase, left, right, total in out:
        ranks[lang] += 1
        if ranks[lang] <= top:
            result.append((lang, ranks[lang], phrase.decode(), -a, left, right, total, -score))
    return result


def texts(rng, count):
    common = [f"w{i}" for i in range(6)] + ["É", "né", "Zulu", "日本"]
    fixed = ["the quick brown fox", "red\tGREEN  blue", "a a a a a", "in spite of", "\x00odd\x85word here"]
    for _ in range(count):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choice(common) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(0, 30))]
        yield "".join(p + rng.choice([". ", ", ", " ", "\n", "\x0b", "!?", ":"]) for p in parts)


def test_against_plain_python(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["en", "en", None, "und", "", "fr"]), t) for t in texts(rng, 900)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"))
    expected = want(rows)
    assert len(expected) > 100
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    few = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=60, share=50, top=20)
    assert sorted(map(tuple, few.collect())) == sorted(want(rows, 60, 50, 20))


@pytest.mark.parametrize("rows", [[], [(None, None), ("en", "")], [("en", "one two three")], [("en", "same words here, " * 31)] * 2, [(None, "x " * 50_000)], [("en", "again and again! "), ("en", "again and again! ")] * 20])
def test_edge_rows(spark, tables, rows):
    folder = tables(documents=([(lang, t, 1, 2) for lang, t in rows], "lang string, text string, id int, phrase int"))
    assert sorted(map(tuple, queries.QUERIES["op13_collocations"](spark, folder).collect())) == sorted(want(rows))


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("en", t) for t in texts(rng, 60)]
    whole = collocations.frequent_filter
    monkeypatch.setattr(collocations, "frequent_filter", lambda ids: whole(ids, 64))
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, text string"), least=5)
    assert sorted(map(tuple, got.collect())) == sorted(want(rows, 5))


def test_rows_of_relation_stay_apart(spark):
    """Piece numbers begin again in the next row; what ends one row is no neighbour of what begins the next."""
    import numpy as np

    relation = spark.createDataFrame([([0, 0], [0, 1], [11, 12]), ([0, 0, 0], [1, 2, 3], [13, 14, 15])], collocations.RELATION_DDL).coalesce(1)
    every = spark.sparkContext.broadcast(np.full(16, -1, np.int64))
    longer = collocations.extended(relation, every)
    assert sorted((r.piece, r.place) for r in longer.collect()) == [([0], [0]), ([0, 0], [1, 2])]
    assert [r.f for r in collocations.pair_counts(longer).collect()] == [1]


def test_python_gets_bounded_batches(spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, kept = spark.conf.get(name), collocations.stored
    monkeypatch.setattr(collocations, "stored", lambda df, n: seen.append(int(spark.conf.get(name))) or kept(df, n))
    collocations.collocations(spark.createDataFrame([("a b " * 40, "en")], "text string, lang string")).collect()
    assert len(seen) == 7 and max(seen) <= 1000 and spark.conf.get(name) == before
