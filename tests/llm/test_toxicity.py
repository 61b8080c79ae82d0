"""Held-out accuracy, and rows the classifier cannot learn from."""

from __future__ import annotations

import random
from zlib import crc32

import pytest

from packetloom.llm import queries, toxicity

BAD = ["zaprok", "vermult", "grontz", "klidde"]


def corpus(n):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(2, 7)))
    docs, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randint(5, 120))], i % 4 == 0
        for _ in range(rng.randint(1, 4) if toxic else 0):
            # some toxic words share their beginning only
            words[rng.randrange(len(words))] = rng.choice([rng.choice(BAD), "qux" + word()])
        docs.append((i, " ".join(words), rng.choice(["en", "de"])))
        labels.append((i, int(toxic)))
    return docs, labels


def held(i):
    return crc32(str(i).encode()) % 3 == 1


def test_held_out_accuracy(spark, tables):
    docs, labels = corpus(1500)
    odd = [(None, "a zaprok", "en"), (9001, None, None), (9002, "", "en"), (9003, "zaprok " * 40_000, "xx"), (9004, "zaprok", "en"), (9004, "zaprok", "en")]
    folder = tables(documents=([(*r, 1, 0.5) for r in docs + odd], "doc_id bigint, text string, lang string, toxic int, score double"),
                    labels=([*labels, (None, 1), (9001, None), (77_777, 1)], "doc_id bigint, toxic int"))
    got = queries.QUERIES["op10_toxicity"](spark, folder).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) for r in got)
    toxic = dict(labels)
    tested = [r for r in got if r.held_out and r.doc_id in toxic]
    caught = sum(r.predicted and toxic[r.doc_id] for r in tested)
    assert caught >= 0.85 * sum(toxic[r.doc_id] for r in tested)
    assert caught >= 0.9 * sum(r.predicted for r in tested)
    by = {r.doc_id: r.score for r in got}
    assert min(by[9003], by[9004]) > 0.9 > by[9002] == by[9001]


def test_held_out_labels_do_not_matter(spark):
    docs, labels = corpus(300)
    d = spark.createDataFrame(docs, "doc_id int, text string, lang string")
    turned = [(i, 1 - y if held(i) else y) for i, y in labels]
    models = [toxicity.train(d, spark.createDataFrame(x, "doc_id int, toxic int")) for x in (labels, turned)]
    assert (models[0].out == models[1].out).all() and models[0].thresholds == models[1].thresholds


@pytest.mark.parametrize("labels", [[], [(1, 0), (2, 0)], [(1, 1)]])
def test_too_few_labels(spark, labels):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id int, toxic int"))
    assert len({r.score for r in toxicity.scored(d, model).collect()}) == 1
    assert toxicity.scored(d.limit(0), model).count() == 0


def test_all_labelled_rows_are_learnt_from(spark):
    """A word that only rows late in the order of hashes hold is learnt, over several shards, whatever the partitions."""
    docs = spark.range(9000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'zaprok vermult' ELSE 'ein wort' END AS text")
    ranked = docs.where("doc_id % 2 = 0 AND crc32(cast(cast(doc_id AS string) AS binary)) % 3 != 1").selectExpr("doc_id", "row_number() OVER (ORDER BY xxhash64(doc_id), doc_id) AS r")
    docs = docs.join(ranked, "doc_id", "left").selectExpr("doc_id", "CASE WHEN r > 2000 THEN 'vrunsel noch' ELSE text END AS text").cache()
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 = 0 AS int) AS toxic")
    models = [toxicity.train(docs.repartition(n), labels, shard_rows=1500) for n in (1, 5)]
    assert models[0].place[crc32(b"vrunsel") % toxicity.BUCKETS] > 0
    assert (models[0].embed == models[1].embed).all() and (models[0].dense() == models[1].dense()).all()
    asked = spark.createDataFrame([(1, "das vrunsel dort"), (2, "ein wort")], "doc_id int, text string")
    low, high = sorted(toxicity.scored(asked, models[0]).collect(), key=lambda r: -r.doc_id)
    assert low.score < 0.3 < 0.7 < high.score
    docs.unpersist()
