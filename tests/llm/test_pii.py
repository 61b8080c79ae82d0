"""Pseudonyms: valid, linked, one to one, and nothing else touched."""

from __future__ import annotations

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from packetloom.llm import pii, queries


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_formats_stay_and_values_link(spark):
    rows = [
        (1, "Card 4111 1111 1111 1111, again 4111-1111-1111-1111."), (2, "4111111111111111"), (3, "not 4111111111111112 a card"),
        (4, "call +1 (988) 555-2485 or 988-555-2485 now"), (5, "from 70.123.182.155 and 300.1.1.1"), (6, "on 1999-02-28 not 1999-02-30"),
        (7, "am 28.02.1999 or 02/28/1999"), (8, "ssn 078-05-1120, never 666-12-3456"), (9, "mail bo.t.42@mail8.example.com, end"),
        (None, None), (10, ""), (11, "1234 plain 56"), (11, "1234 plain 56"), (12, "x" * 200_000 + " 4111111111111111"), (13, "é 1999-02-28 日本 1999-02-28")]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("pii", F.lit(1)).withColumn("kind", F.lit("k"))
    got = [r for r in pii.pseudonymize(df, "k1").collect()]
    by = {r.doc_id: r.text for r in got}
    kinds = {r.doc_id: [p.kind for p in r.pii] for r in got}
    assert kinds == {1: ["card"] * 2, 2: ["card"], 3: [], 4: ["phone"] * 2, 5: ["ip"], 6: ["date"], 7: ["date"] * 2, 8: ["ssn"], 9: ["email"], None: [], 10: [], 11: [], 12: ["card"], 13: ["date"] * 2}
    a, b = re.fullmatch(r"Card (\d{4} \d{4} \d{4} \d{4}), again (\d{4}-\d{4}-\d{4}-\d{4})\.", by[1]).groups()
    assert a.replace(" ", "") == b.replace("-", "") == by[2] != "4111111111111111" and luhn(a) and by[2][0] == "4"
    assert by[12] == "x" * 200_000 + " " + by[2]
    assert by[3] == rows[2][1] and by[11] == "1234 plain 56" and by[None] is None and by[10] == ""
    x, y = re.fullmatch(r"call \+1 \(([2-9]\d\d)\) ([2-9]\d\d-\d{4}) or ([2-9]\d\d-[2-9]\d\d-\d{4}) now", by[4]).group(1, 3)
    assert y.startswith(x)
    assert by[5].endswith(" and 300.1.1.1") and by[5] != rows[4][1]
    day = re.fullmatch(r"on (\d{4}-\d\d-\d\d) not 1999-02-30", by[6])[1]
    d = dt.date.fromisoformat(day)
    assert by[7] == f"am {d:%d.%m.%Y} or {d:%m/%d/%Y}" and by[13] == f"é {day} 日本 {day}"
    assert by[8].endswith(", never 666-12-3456") and by[8] != rows[7][1]
    assert by[9].startswith("mail u") and by[9].endswith("@mail8.example.com, end")
    other = {r.doc_id: r.text for r in pii.pseudonymize(df, "k2").collect()}
    assert other[2] != by[2] and luhn(other[2])


@pytest.mark.parametrize("left,right", [(7, 10), (1, 5), (30, 30)])
def test_permutation(spark, left, right):
    df = spark.range(left * right).select(pii.feistel(F.floor(F.col("id") / right), F.col("id") % right, F.lit(left), F.lit(right), "key", F.lit("t")).alias("h"))
    got = sorted((r.h.l, r.h.r) for r in df.collect())
    assert got == [(a, b) for a in range(left) for b in range(right)]


def test_query_leaves_other_text_alone(spark, sf_dir):
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = re.compile(pii.ANY)
    changed = 0
    for r in queries.QUERIES["op8_pii"](spark, sf_dir).collect():
        assert found.split(before[r.doc_id]) == found.split(r.text)
        changed += before[r.doc_id] != r.text
        assert (before[r.doc_id] != r.text) == (r.n_found > 0)
    assert changed > 5


def test_phones_of_all_codes_and_forms(spark):
    rows = [(1, "+1 (017) 555-1234"), (2, "(136) 055-1234"), (3, "017-555-1234"), (4, "+15551234567"), (5, "5551234567"), (6, "555.123.4567"), (7, "(555)1234567"), (8, "+44 20 7946 0958"),
            (9, "+442079460958"), (10, "+49 (0)30/123456"), (11, "+353 1 234 5678"), (12, "988 155 2485"), (13, "id 1700000000 and 11345678901"), (14, "+1500000 people")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    digits = lambda t: re.sub(r"\D", "", t)
    for i, t in rows:
        assert re.sub(r"\d", "0", got[i].text) == re.sub(r"\d", "0", t)
        assert (got[i].text == t) == (i > 12) and [p.kind for p in got[i].pii] == ["phone"] * (i <= 12), (t, got[i])
    assert digits(got[1].text) == "1" + digits(got[3].text) and digits(got[3].text)[0] in "01"
    assert {digits(got[i].text)[-10:] for i in (4, 5, 6, 7)} == {digits(got[5].text)} and digits(got[8].text) == digits(got[9].text)
    assert got[9].text.startswith("+44") and got[11].text.startswith("+353") and digits(got[12].text)[3] in "01" and digits(got[12].text)[0] not in "01"


def test_phones_stay_apart(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "format_string('%03d-%03d-%04d', id * 7 % 1000, id * 13 % 1000, id) AS text")
    assert len({r.text for r in pii.pseudonymize(df, "k").collect()}) == 3000


def test_times_and_ranges(spark):
    rows = [(1, "2021-03-04T10:00", 1), (2, "2021-03-04-2021-03-05", 2), (3, "10.0.0.1-10.0.0.19", 2), (4, "28.02.1999-01.03.1999", 2), (5, "02/28/1999-03/01/1999, 10.0.0.100-10.0.0.200.", 4), (6, "2021-03-04Tx", 0), (7, "x-2021-03-04", 0)]
    got = pii.pseudonymize(spark.createDataFrame(rows, "doc_id int, text string, n int"), "k").collect()
    for r in got:
        assert len(r.pii) == r.n and (r.text == {i: t for i, t, _ in rows}[r.doc_id]) == (r.n == 0), r
        assert len(re.findall(pii.ANY, r.text)) == r.n


def test_long_host_names_do_not_end_the_search(spark):
    rows = [("see x@" + "b." * 100_000 + "co",), ("write to " + "a." * 50_000 + "b@c.org now",), ("1 " * 100_000 + "2024-01-02",), ("me@" + "sub." * 100 + "example.com",)]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "text string"), "k").collect()]
    assert got[0] == rows[0][0] and not got[3].startswith("me@") and got[3].endswith("example.com")


def test_a_column_of_the_same_name_stays(spark):
    row = pii.pseudonymize(spark.createDataFrame([("a@b.org", 3, 4)], "text string, matches int, _found int"), "k").first()
    assert (row.matches, row._found, len(row.pii)) == (3, 4, 1)
