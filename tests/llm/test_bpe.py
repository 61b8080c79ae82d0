"""Ids and decoded texts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from packetloom.llm import bpe, queries

LIBRARY = Tokenizer.from_file(queries.tokenizer_path())


def want(rows):
    out = []
    for doc, text in rows:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((doc, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False))))
    return sorted(map(repr, out))


def odd_texts():
    rng = random.Random(2)
    letters = "abcdeé ’'sSTt<|>/w 12日ΣÅİ\n\t\x1c -_!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["a" * k + "b" * (k % 7) for k in range(1, 60)] + ["=" * k for k in range(1, 90)] + ["".join(rng.choice("anois") for _ in range(30)) for _ in range(500)]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [[], odd_texts(), [
    (None, "null id"), (1, None), (1, ""), (2, " \n "), (3, "twice"), (3, "twice"), (4, "<|endoftext|> foo<|startoftext|>bar"), (5, "a</w>b </w>"), (6, "x" * 5000), (7, "word " * 50_000), (8, "ΑΣ don't I'LL")]])
def test_query_equals_library(spark, tables, rows):
    folder = tables(documents=([(d, t, 1, "n") for d, t in rows], "doc_id bigint, text string, ids int, decoded string"))
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op4_bpe"](spark, folder).collect()) == want(rows)


def test_query_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op4_bpe"](spark, sf_dir).collect()) == want(rows)


def test_small_caches_give_the_same(spark):
    import json
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    texts = [t for _, t in odd_texts()]
    small, large = bpe.WordBpe(spec, cache_words=50), bpe.WordBpe(spec)
    assert small.encode(texts).to_pylist() == large.encode(texts).to_pylist()


def test_decode_of_null_and_sliced_ids(spark):
    df = spark.createDataFrame([(1, [320, 1125]), (2, None), (3, [])], "k int, ids array<int>")
    got = {r.k: r.decoded for r in bpe.decode(df, queries.tokenizer_path()).where("k > 0").collect()}
    assert got == {1: LIBRARY.decode([320, 1125], skip_special_tokens=False), 2: "", 3: ""}
