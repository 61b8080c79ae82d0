"""License evidence against plain Python."""

from __future__ import annotations

import re

from packetloom.llm import licenses, queries

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    starts, labels = [], set()
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += at
        labels |= {label} if at else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def check(rows, got):
    assert sorted(map(repr, ((i, *base(t)) for i, t in rows))) == sorted(repr(tuple(r)[:6]) for r in got)
    for r in got:
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))


def test_query_on_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(rows, queries.QUERIES["op6_licenses"](spark, sf_dir).collect())


def test_edge_rows(spark, tmp_path):
    mit = licenses.TEMPLATES[3][1]
    bent = mit.split()
    bent[20:22] = ["one", "two", "three"]
    rows = [(None, "MIT  License, mit-license"), (1, None), (1, ""), (2, "license"), (3, "The MIT LICENSE"), (3, "The MIT LICENSE"), (3, "apache license"),
            (4, "a " * 50_000 + "GNU General Public License " * 300), (5, "é mit\x00license ✓apache license"), (6, "xx " + mit + " yy " + mit), (7, " ".join(bent)),
            (8, "general public"), (9, "mit mit license license")]
    spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS template").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_licenses"](spark, str(tmp_path)).drop("template").collect()
    check(rows, [r for r in got])
    labels = {r.doc_id: r.labels for r in got}
    assert labels[6] == "mit" and labels[7] == "mit" and labels[8] == ""


def test_places_of_templates(spark):
    df = spark.createDataFrame([(1, "x y " + licenses.TEMPLATES[3][1] + " z")], "doc_id int, text string")
    places = [r for r in licenses.spans(df, licenses.template_table(spark)).collect() if r.template == len(licenses.PHRASES) + 3]
    assert [(r.first_word, r.last_word, r.score) for r in places] == [(2, 1 + len(licenses.TEMPLATES[3][1].split()), 1.0)]


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op6_licenses"](spark, str(tmp_path)).collect() == []


def chain(votes):
    best = {}
    for t, a in sorted(votes):
        best[t, a] = 1 + max((n for (u, b), n in best.items() if u < t and b < a), default=0)
    return max(best.values(), default=0)


def by_alignment(text, coverage=0.7, drift=3):
    """(labels, score) by plain loops over all diagonals of all templates."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))
    labels, best = set(base(text)[4].split(",")) - {""}, 1.0 if base(text)[1] else 0.0
    for label, template in licenses.TEMPLATES:
        t = template.split()
        lines = {}
        for i in range(len(t) - 1):
            for j in range(len(words) - 1):
                if words[j:j + 2] == t[i:i + 2]:
                    lines.setdefault(j - i, set()).add((i, j))
        lines = {d: v for d, v in lines.items() if len(v) >= min(2, len(t) - 1)}
        for d in lines:
            score = chain(set().union(*(lines.get(e, set()) for e in range(d - drift, d + drift + 1)))) / (len(t) - 1)
            if score >= coverage:
                labels.add(label)
                best = max(best, score)
    return ",".join(sorted(labels)), best


def test_labels_and_scores_by_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    for _, template in licenses.TEMPLATES:
        words = template.split()
        for k in range(0, len(words), 7):
            rows.append((10_000 + len(rows), " ".join(words[:k] + ["extra"] * (k % 5) + words[k + k % 3:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.labels, round(r.score, 6)) for r in licenses.scan(df).collect()}
    assert got == {i: (by_alignment(t)[0], round(by_alignment(t)[1], 6)) for i, t in rows}


def test_repeated_words_are_no_license(spark):
    df = spark.createDataFrame([(1, "the software " * 60), (2, "the license " * 60), (3, "software and the " * 500)], "id int, body string")
    assert [(r.labels, r.score) for r in licenses.scan(df, text="body", key="id").collect()] == [("", 0.0)] * 3


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "the mit license", 5, 6, 7)], "doc_id int, text string, _base int, row int, body int")
    assert licenses.scan(df).select("_base", "row", "body", "labels").first()[:] == (5, 6, 7, "mit")
