"""Rules against plain matching."""

from __future__ import annotations

import random

import pytest

from packetloom.llm import queries, urls

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged(page, url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:end].translate(UPPER), rest[end:]
        path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return page, host, path, best[2] if best else None, best[3] if best else "allow"


EDGE = [(1, None), (2, ""), (3, "no scheme"), (4, "http://com"), (5, "http://com/"), (6, "http://xcom/"), (7, "HTTP://WWW.Example.COM/en/a?b#c"), (7, "HTTP://WWW.Example.COM/en/a?b#c"),
        (None, "http://net/es/"), (8, "a://b://net/es/"), (9, "http://a..net/fr/x"), (10, "http://net./es/"), (11, "http://net?/es/"), (12, "http://" + "a." * 20_000 + "com/x"),
        (13, "http://example.com/en/" + "y" * 100_000), (14, "://"), (15, "http://example.com:80/en/"), (16, "http://É.net/es/ß")]


@pytest.mark.parametrize("rows", [EDGE, []])
def test_query(spark, tables, rows):
    folder = tables(pages=([(p, u, "k", 1) for p, u in rows], "page_id bigint, url string, key string, host int"))
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op5_url_filter"](spark, folder).collect()) == sorted(repr(judged(p, u, RULES)) for p, u in rows)


def test_many_nested_rules(spark):
    rng = random.Random(3)
    host = lambda n: ".".join(rng.choice("abc") for _ in range(n))
    path = lambda n: "/" + "".join(rng.choice("xy/") for _ in range(n)) if n else ""
    rules = {(host(rng.randint(1, 3)), path(rng.randint(0, 3))): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(v, h, p) for (h, p), v in rules.items()]
    pages = [(i, f"http://{host(rng.randint(1, 5))}{path(rng.randint(0, 6))}") for i in range(1500)]
    got = urls.judge(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert sorted(tuple(r) for r in got.select("page_id", "host", "path", "verdict").collect()) == sorted((*judged(p, u, rules)[:3], judged(p, u, rules)[4]) for p, u in pages)


def test_no_rules(spark):
    none = spark.createDataFrame([], "verdict string, host string, path string")
    got = urls.judge(spark.createDataFrame([(1, "http://a/b")], "page_id int, url string"), none, default="block").collect()
    assert [tuple(r)[2:] for r in got] == [("a", "/b", None, "block")]


def test_other_columns_of_any_name_stay(spark):
    rules = spark.sql(queries.URL_RULES)
    pages = spark.createDataFrame([("http://a.net/es/x", 5, 6)], "url string, found int, _best int")
    row = urls.judge(pages, rules).first()
    assert (row.found, row._best, row.rule, row.verdict) == (5, 6, "net/es/", "block")
