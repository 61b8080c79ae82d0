"""Alignments against plain Python over both libraries."""

from __future__ import annotations

import hashlib
import random
from bisect import bisect_right
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import alignment, queries
from packetloom.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))


def one(tokenizers, text):
    """(a tokens, b tokens, links, groups) by sets of offsets."""
    a, b = tokenizers
    if not text:
        return [], [], [], ""
    letters = alignment._byte_letters()
    of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in of_a]
    bytes_b = []
    for i in of_b:
        p = b.id_to_piece(i)
        bytes_b.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return [], [], [], ""

    def ends(ids, pieces):
        at, out = 0, {}
        for i, p in zip(ids, pieces, strict=True):
            at += len(p)
            out[at] = i
        return out
    ea, eb = ends(of_a, bytes_a), ends(of_b, bytes_b)
    both = sorted(ea.keys() & eb.keys())

    def cut(e):
        places = sorted(e)
        return [",".join(str(e[x]) for x in places[bisect_right(places, low):bisect_right(places, high)]) for low, high in zip([0, *both], both, strict=False)]
    return of_a, of_b, [(ea[x], eb[x]) for x in both], ";".join(f"{x}|{y}" for x, y in zip(cut(ea), cut(eb), strict=True))


def check(tokenizers, rows, got):
    found = [(i, *one(tokenizers, t)) for i, t in rows]
    counts = Counter(x for f in found for x in f[3])
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(top.get(b, 0), n)
    want = [(i, len(a), len(b), len(links), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(groups.encode()).hexdigest() if groups else "") for i, a, b, links, groups in found]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    return found


def test_query_on_documents(spark, sf_dir, tokenizers):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = check(tokenizers, rows, queries.QUERIES["op11_token_alignment"](spark, sf_dir).collect())
    assert sum(bool(f[3]) for f in found) > len(rows) / 2


@pytest.mark.parametrize("rows", [[], [
    (None, "no id"), (1, None), (1, ""), (2, " "), (3, "a  b\t\n c "), (4, "<|endoftext|> <s></s><unk> <0x41>"), (5, "é日本▁x"), (5, "plain"), (5, "plain"),
    (6, "\x00nul\x00"), (7, "long words and more " * 8000), (8, "😀" * 50), (9, "x" * 3000), (10, "one more word\n" * 16_000)]])
def test_edge_rows(spark, tables, tokenizers, rows):
    folder = tables(documents=([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, links int, n_a string"))
    check(tokenizers, rows, queries.QUERIES["op11_token_alignment"](spark, folder).collect())


@pytest.mark.parametrize("block", [1, 7, 256])
def test_galloping(monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK", block)
    rng = random.Random(4)
    for _ in range(300):
        a, b = (sorted(rng.sample(range(1, 400), rng.randint(0, rng.choice([3, 60, 300])))) for _ in range(2))
        both = sorted(set(a) & set(b))
        i, j = alignment.common_ends(np.array(a, np.int64), np.array(b, np.int64))
        assert (i.tolist(), j.tolist()) == ([a.index(x) for x in both], [b.index(x) for x in both])


def test_groups_are_kept_on_demand(spark, tokenizers):
    df = spark.createDataFrame([("k", "Tokenization of unusual words")], "name string, body string")
    row = alignment.align(df, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), "body", "name", keep_groups=True)[0].first()
    assert row.name == "k" and row.groups == one(tokenizers, "Tokenization of unusual words")[3]
