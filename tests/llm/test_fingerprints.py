"""Sketches and successors against plain Python."""

from __future__ import annotations

import hashlib
import re

import pytest
import xxhash

from packetloom.llm import fingerprints, queries


def shingle(words):
    seed = 42
    for w in words:
        seed = xxhash.xxh64(w.encode(), seed=seed).intdigest()
    return seed >> 16


def sketch(text, limit=2 ** 47):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text.lower()) if w]
    hashes = {shingle(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {shingle([" ".join(words)])} if words else set()
    return sorted(h for h in hashes if h < limit) or sorted(hashes)[:1]


def near(a, b):
    a, b = sorted((set(a), set(b)), key=len)
    return len(a & b) / len(a) if a else float(not b)


def check(rows, got):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (-2 ** 63 if r[0] is None else r[0], r[1]))
    want = []
    for n, (i, text) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        s, e = sketch(text), sketch(edited)
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:012x}" for h in s), "".join(f"{h:012x}" for h in e),
                     near(s, e), near(s, sketch(after))))
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:7]) for r in got)


def test_query_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.QUERIES["op1_fingerprints"](spark, sf_dir).collect())


@pytest.mark.parametrize("rows", [
    [], [(5, "only one text here for sure")],
    [(None, "no id"), (1, None), (1, ""), (1, ""), (3, "a b"), (3, "a b"), (900, "x " * 30_000), (901, "é\x00日本 " * 7), (-4, " \n\t ")]])
def test_edge_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS next", "2 AS sketch").write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, queries.QUERIES["op1_fingerprints"](spark, str(tmp_path)).collect())


def test_sketches_merge(spark):
    df = spark.createDataFrame([("a b c d e f g h " * 3, "q r s t u v w " * 9), ("one two", "three four"), ("", "x y z")], "a string, b string")
    a, b = fingerprints.sketch(df.a), fingerprints.sketch(df.b)
    for r in df.select(fingerprints.merge(a, b).alias("m"), a.alias("a"), b.alias("b")).collect():
        assert r.m == (sorted(h for h in {*r.a, *r.b} if h < 2 ** 47) or sorted({*r.a, *r.b})[:1])


def test_columns_with_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a", 7, 8), (2, "b", 9, 10)], "_order int, text string, _copy int, _last int")
    got = {tuple(r)[:4]: r.next.text for r in fingerprints.with_next(df, "_order", ["text", "_copy"]).collect()}
    assert got == {(1, "a", 7, 8): "b", (2, "b", 9, 10): "a"}
