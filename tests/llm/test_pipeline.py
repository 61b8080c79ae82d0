"""The stages in order, each on what the one before kept."""

from __future__ import annotations

import random

import corpus_pipeline
from packetloom.llm.common import table
from tests.llm.test_linededup import prose
from tests.llm.test_neardup import brute
from tests.llm.test_toxicity import corpus

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def stages(spark, folder):
    docs, kept = table(spark, folder, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        kept.append({r.doc_id: r for r in docs.collect()})
    return kept


def test_planted_cases(spark, tables):
    rng = random.Random(21)
    noise, labels = corpus(900)
    rows = [(i, t, lang) for i, t, lang in noise]
    passage, item = "".join(prose(rng, 14)), "".join(prose(rng, 3)).replace("\n", " ")
    clean = ["".join(prose(rng, 30)) for _ in range(8)]
    rows += [(2000 + i, t, "en") for i, t in enumerate(clean)]
    rows += [(3000, clean[0], "en"), (3001, clean[1].replace(" ", "  ", 3), "en")]  # copies
    rows += [(4000 + i, "".join(prose(rng, 25)) + passage + "".join(prose(rng, 25)), "en") for i in range(3)]
    rows += [(5000, "".join(prose(rng, 20)) + item + "".join(prose(rng, 20)), "en"), (6000, None, "en"), (6001, "", None)]
    folder = tables(documents=([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], SCHEMA),
                    labels=(labels, "doc_id bigint, toxic int"), benchmark=([(1, item), (2, None)], "item_id bigint, text string"))
    toxic, lines, near, free, final = stages(spark, folder)
    is_toxic = dict(labels)
    left = [i for i in toxic if i < 1000]
    assert sum(is_toxic[i] for i in left) < 0.15 * sum(is_toxic.values()) and sum(not is_toxic[i] for i in left) > 0.97 * sum(not y for y in is_toxic.values())
    before = {i: t for i, t, _ in rows}
    assert all(lines[i].text == before[i] for i in (*range(2000, 2008), 3000, 3001, 4000, 5000, 6000, 6001))
    assert all(len(lines[i].text) < len(before[i]) - len(passage) / 2 and lines[i].n_chars == len(lines[i].text) for i in (4001, 4002))
    want = {d for d, _, _, kept in brute([(r.doc_id, r.text) for r in lines.values()]) if kept}
    assert set(near) == want and 3000 not in near and 3001 not in near and 2000 in near
    assert set(near) - set(free) == {5000}
    assert set(final) == set(free) and final[6000].n_tokens == 0 and all(final[i].n_tokens > 50 for i in range(2000, 2008))


def test_columns_and_empty_table(spark, tables):
    folder = tables(documents=([], SCHEMA), labels=([], "doc_id bigint, toxic int"), benchmark=([], "item_id bigint, text string"))
    docs = table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        assert after.count() == 0
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_equals_the_stages(spark, sf_dir):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(stages(spark, sf_dir)[-1])
