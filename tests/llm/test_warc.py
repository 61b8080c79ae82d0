"""Archives: round trips, revisits and damage."""

from __future__ import annotations

import hashlib
import io
import struct

import pytest
import zstandard

from packetloom.llm import queries, warc

ROWS = [(1, "http://a/", "x" * 1500), (2, None, "x" * 1500), (2, "http://b/", "x" * 1500), (9, "http://c/", "x" * 1500), (None, "u", "x" * 1500),
        (3, "a b\nc", "x" * 999), (4, "v", "x" * 999), (5, "w", None), (6, "w", ""), (7, "z", "é" * 600), (8, "z", "é" * 600), (10, "big", "long é " * 300_000),
        (None, "n", "y" * 2000), (None, "m", "y" * 2000)]


def want(rows):
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "").encode() == body and p is not None), default=None)
        again = len(body) >= 1000 and top is not None and (page is None or page < top)
        out.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("rows", [ROWS, []])
def test_edge_rows(spark, tmp_path, rows):
    spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS payload").write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op7_warc"](spark, str(tmp_path)).collect()) == want(rows)


def test_payloads_come_back_from_many_archives(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"{i} page " * (i % 50 + 1)) for i in range(3000)]
    warc.write_archives(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(2), f"file://{tmp_path}", roll_bytes=8000)
    got = warc.read_archives(spark, f"file://{tmp_path}").collect()
    assert len({r.path for r in got}) > 4
    assert {(r.target_uri, bytes(r.payload).decode()) for r in got} == {(u, h) for _, u, h in rows}


def archive(records, packed=True):
    dictionary = b"WARC/1.1 Content-Length sha1 some words"
    body = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
    one = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    return struct.pack("<II", warc.SKIPPABLE_DICTIONARY, len(body)) + body + b"".join(map(one.compress, records))


def test_damage_is_told(spark, tmp_path):
    good = warc.record_bytes("urn:page:1", "response", "http://a", b"hello", hashlib.sha1(b"hello").hexdigest(), None)
    assert [warc.parse_record(r)["payload"] for _, r in warc.read_frames(io.BytesIO(archive([good, good], packed=False)))] == [b"hello"] * 2
    bad = [good[:-1], good.replace(b"hello", b"hullo"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"WARC Date"), b"", good + b"x"]
    for raw in bad:
        with pytest.raises(warc.BadRecord):
            warc.parse_record(raw)
    (tmp_path / "a.warc.zst").write_bytes(archive([good, *bad, good]))
    (tmp_path / "b.warc.zst").write_bytes(archive([good, good])[:-5])
    (tmp_path / "c.warc.zst").write_bytes(zstandard.compress(good))
    rows = warc.read_archives(spark, f"file://{tmp_path}", strict=False).collect()
    told = {}
    for r in rows:
        told.setdefault(r.path[-10], []).append(r.error is None)
    assert told == {"a": [True] + [False] * len(bad) + [True], "b": [True, False], "c": [False]}
    with pytest.raises(Exception, match="BadRecord"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()
