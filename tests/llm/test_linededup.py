"""Repeated passages go, first occurrences and everything else stay."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from packetloom.llm import linededup, queries
from packetloom.llm.common import stored


def prose(rng, sentences):
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 8)))
    return [" ".join(word() for _ in range(rng.randint(4, 9))).capitalize() + rng.choice([". ", ", ", ".\n"]) for _ in range(sentences)]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id int, text string")
    return {r.doc_id: r for r in linededup.dedup_lines(df, **options).collect()}


def test_shared_passages(spark):
    rng = random.Random(8)
    passages = [prose(rng, 14) for _ in range(6)]
    rows, hosts = [], {}
    for i in range(60):
        body = prose(rng, 40)
        if i % 2:
            p = passages[i % 6]
            at = rng.randint(0, 40)
            # the passage begins in the middle of a line, after words of its host
            rows.append((i, "".join(body[:at]) + "and then " + "".join(p) + "".join(body[at:])))
            hosts.setdefault(i % 6, []).append(i)
        else:
            rows.append((i, "".join(body)))
    got = run(spark, rows)
    before = dict(rows)
    for i in range(0, 60, 2):
        assert got[i].text == before[i] and got[i].n_removed == 0
    for p, ids in hosts.items():
        text = "".join(passages[p])
        assert got[ids[0]].text == before[ids[0]]
        for i in ids[1:]:
            assert not got[i].is_copy
            gone = len(before[i]) - len(got[i].text)
            assert 0.5 * len(text) < gone <= len(text) + 10, (i, gone, len(text))
    assert all(set(linededup_units(r.text)) <= set(linededup_units(before[i])) | {""} for i, r in got.items())


def linededup_units(text):
    import re
    return re.split(r"(?<=\n)|(?<=[.!?,;:] )", text)


def test_copies_are_left_to_another_stage(spark):
    rng = random.Random(9)
    text = "".join(prose(rng, 30))
    rows = [(1, text), (2, text), (3, text.replace("a", "A", 1)), (4, "".join(prose(rng, 30)))]
    got = run(spark, rows)
    assert {i: r.is_copy for i, r in got.items()} == {1: False, 2: True, 3: True, 4: False}
    assert all(got[i].text == t for i, t in rows)
    bare = run(spark, rows, copy_share=None)
    assert bare[1].text == text and bare[2].text == "" and len(bare[3].text) < len(text) / 4
    kept = linededup.without_repeats(spark.createDataFrame(rows, "doc_id int, text string"), copy_share=None)
    assert {r.doc_id for r in kept.collect()} >= {1, 4} and 2 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("rows", [[], [(None, None), (1, None), (2, ""), (3, "\n\n"), (4, "one line"), (4, "one line"), (5, "a b c d e f g h i, j k l.\n" * 5000), (6, ", . ! ")]])
def test_edge_rows(spark, tables, rows):
    folder = tables(documents=([(d, t, 1) for d, t in rows], "doc_id bigint, text string, n_removed int"))
    got = queries.QUERIES["op2_line_dedup"](spark, folder).collect()
    assert len(got) == len(rows)
    short = {r.doc_id: r.text for r in got if r.doc_id != 5}
    assert short == {d: t for d, t in rows if d != 5}


def test_repeats_within_one_document(spark):
    rng = random.Random(10)
    passage, rest = prose(rng, 20), prose(rng, 20)
    got = run(spark, [(1, "".join(passage + rest + passage)), (2, "".join(prose(rng, 5)))])
    whole = "".join(passage + rest + passage)
    assert got[1].text.startswith("".join(passage + rest)) and len(whole) - len(got[1].text) > 0.4 * len("".join(passage))


def test_repeated_rows_are_one_document(spark):
    rng = random.Random(12)
    text = "".join(prose(rng, 20))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id int, text string")
    assert [r.text for r in linededup.dedup_lines(df).collect()] == [text, text]


def test_a_new_start_moves_no_border(spark):
    rng = random.Random(13)
    body = prose(rng, 60)
    df = spark.createDataFrame([(1, "".join(body)), (2, "".join(prose(rng, 7) + body))], "doc_id int, text string")
    u = linededup.units(df.text)
    got = {r.doc_id: r for r in df.select("doc_id", u.alias("u"), linededup.chunks(u, 3).alias("c")).collect()}
    texts = lambda r: ["".join(r.u[c.start:c.end + 1]) for c in r.c]
    assert "".join(texts(got[1])) == "".join(body)
    assert texts(got[1])[2:] == texts(got[2])[-len(texts(got[1])) + 2:]


def test_every_short_passage_is_found(spark):
    rng = random.Random(14)
    rows, planted = [], {}
    for i in range(40):
        passage = prose(rng, 9)
        while not 51 <= len("".join(passage).split()) <= 60:
            passage = prose(rng, 9)
        # the passage stands on its own or begins and ends within lines of its host
        inner = "and then " * (i % 2) + "".join(passage) + "so on " * (i % 2)
        planted[i + 100] = "".join(passage[1:])
        rows += [(i, "".join(prose(rng, 20)) + inner + "".join(prose(rng, 20))), (i + 100, "".join(prose(rng, 20)) + inner[9 * (i % 2):] + "".join(prose(rng, 20)))]
    got, before = run(spark, rows), dict(rows)
    for i, text in planted.items():
        assert text in before[i] and text not in got[i].text and len(before[i]) - len(got[i].text) >= len(text)
        assert got[i - 100].text == before[i - 100]


def test_overlapping_runs_leave_the_first_whole(spark):
    line = "one two three four five, "
    got = run(spark, [(1, line * 9)])
    assert got[1].text == line * 2


def test_only_near_duplicates_are_left_whole(spark):
    rng = random.Random(15)
    passage, filler = "".join(prose(rng, 10)), "one and the same line again,\n" * 40
    rows = [(1, "".join(prose(rng, 6)) + passage), (2, "".join(prose(rng, 6)) + passage),  # 0.6 of the words, a Jaccard of 0.45
            (3, filler + "".join(prose(rng, 8))), (4, filler + "".join(prose(rng, 8)))]  # most lines, few different ones
    got, before = run(spark, rows), dict(rows)
    assert not any(r.is_copy for r in got.values())
    assert passage not in got[2].text and got[1].text == before[1]
    assert "again" not in got[4].text and got[3].text.count("again") == 2
    copy = before[1] + "".join(prose(rng, 1))
    got = run(spark, [*rows[:2], (5, copy)])
    assert got[5].is_copy and got[5].text == copy


@pytest.mark.parametrize("between", ["\n", "\t", " ", "\u00a0", "\u3000"])
def test_passages_without_blanks_or_marks(spark, between):
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(4, 8)))
    passage = between.join(word() for _ in range(60))
    rows = [(i, "".join(prose(rng, 12)) + f"{word()}{between}" * i + passage + f"{between}{word()}" * i + ".\n" + "".join(prose(rng, 12))) for i in (1, 2)]
    got, before = run(spark, rows), dict(rows)
    assert got[1].text == before[1] and not got[2].is_copy
    left = [w for w in passage.split(between) if w in got[2].text]
    assert len(left) <= 24 and len(before[2]) - len(got[2].text) <= len(passage) + 1


def test_one_word_over_and_over(spark):
    rng = random.Random(17)
    rows = [(i, "".join(prose(rng, 12)) + "start " * i + f"{w} " * (60 + 7 * i) + "".join(prose(rng, 12))) for i, w in ((1, "filler"), (2, "filler"), (3, "stuff"), (4, "stuff"))]
    got = run(spark, rows)
    assert all(got[i].text.count(w) <= 34 for i, w in ((1, "filler"), (2, "filler"), (3, "stuff"), (4, "stuff")))
    assert got[1].text.count("filler") >= 8 and got[3].text.count("stuff") >= 8


def test_units_join_to_the_text(spark):
    rng = random.Random(18)
    texts = ["", " \n ", "a " * 50, "\t x\ty " * 30, "".join(prose(rng, 9)) * 2, "日本語 " * 40, "w" * 5000, " ".join(prose(rng, 1)[0].replace(",", "").replace(".", "") for _ in range(9))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", linededup.units(df.text).alias("u")).collect():
        assert "".join(r.u) == r.text and all(len(x.split()) <= 16 for x in r.u)


def test_written_steps_leave_no_shuffle_files(spark):
    files = lambda: set(map(str, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split()))
    before, name = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(name, None)
    counts = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # they go beside the next step
        if not (left := {f for f in files() - before if "shuffle_" in f}):
            break
        time.sleep(0.1)
    assert not left and counts.count() == 7 and spark.conf.get(name, None) == setting


def test_texts_are_cut_twice_at_most_before_the_last_join(spark, monkeypatch):
    steps = {}

    def planned(df, name):
        steps[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return stored(df, name)
    monkeypatch.setattr(linededup, "stored", planned)
    run(spark, [(1, "".join(prose(random.Random(19), 20)))] * 2)
    assert steps["repeated-chunks"].count("(?<=\\n)") == steps["line-chunks"].count("(?<=\\n)") == 1
