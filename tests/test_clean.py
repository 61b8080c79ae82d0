"""Readers and cleaning on hand-written rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from packetloom.operators import clean, features
from packetloom.schemas import PACKETS
from packetloom.sources import packets as store

CSV = """packet_number,timestamp,source_ip,destination_ip,protocol,transport_layer,packet_length,source_port,destination_port,ttl,tcp_flags,network_layer,app_layer_hint,ip_version,is_tcp,is_udp,is_icmp,packet_size_category,source_ip_frequency,destination_ip_frequency,hour_of_day,is_private_src,is_private_dst
1,2026-01-05T10:00:00+00:00,192.168.1.1,8.8.8.8,UNKNOWN,,1010,,,64,,IPV4,,4,0,0,0,large,1,1,10,1,0
2,2026-01-05T10:00:01+00:00,192.168.1.2,8.8.4.4,ICMP,ICMP,466,,,64,,IPV4,,4,0,0,1,medium,1,1,10,1,0
3,broken,192.168.1.3,1.1.1.1,ICMP,ICMP,1442,,,64,,IPV4,,4,0,0,1,large,1,1,,1,0
"""


def test_csv_reader(spark, tmp_path):
    (tmp_path / "packets.csv").write_text(CSV)
    rows = store.read_csv(spark, str(tmp_path))
    assert rows.columns == [f.name for f in PACKETS]
    first, _, third = rows.orderBy("packet_number").collect()
    assert (first.packet_length, first.src_port, first.packet_size_category) == (1010, None, "large")
    assert first.timestamp.replace(tzinfo=None) and third.timestamp is None
    assert rows.agg(F.sum("packet_length")).first()[0] == 2918


def test_missing_and_empty_input_are_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        store.read_csv(spark, str(tmp_path / "absent"))
    (tmp_path / "empty.csv").write_text(CSV.splitlines()[0] + "\n")
    with pytest.raises(ValueError, match="no packets"):
        store.read_csv(spark, str(tmp_path / "empty.csv"), must_have_rows=True)
    with pytest.raises(ValueError, match="unknown source"):
        store.load_packets(spark, "x", "ftp")


def test_capture_clean_bounds(spark):
    rows = spark.createDataFrame(
        [(1, " tcp ", "NaN", "-5", "None"), (2, None, "None", "70000", "1.2.3.4"), (3, "Udp", "udp", "nan", None), (4, "x", None, "12.9", "a"), (4, "x", None, "12.9", "a")],
        "packet_number long, protocol string, transport_layer string, packet_length string, src_ip string")
    got = clean.clean_capture(rows, F.lit("2024-01-01").cast("timestamp")).orderBy("packet_number").collect()
    assert [(r.protocol, r.transport_layer, r.packet_length, r.src_ip) for r in got] == [
        ("TCP", None, 0, None), ("UNKNOWN", None, 65535, "1.2.3.4"), ("UDP", "UDP", 0, None), ("X", None, 12, "a")]


def test_malformed_is_anchored(spark):
    names = ["_ws.malformed", "MALFORMED (x)", "not malformed", " tcp", None]
    rows = spark.createDataFrame([(n,) for n in names], "protocol string").coalesce(1)
    got = [r[0] for r in rows.select(clean.normalised_protocol(F.col("protocol"))).collect()]
    assert got == ["MALFORMED", "MALFORMED", "NOT MALFORMED", "TCP", "UNKNOWN"]


def test_null_address_has_frequency_zero(spark):
    rows = spark.createDataFrame([("a",), ("a",), (None,), (None,), (None,)], "src_ip string")
    got = features.with_frequency(rows, ("src_ip", "n")).orderBy("n").collect()
    assert [(r.src_ip, r.n) for r in got] == [(None, 0)] * 3 + [("a", 2)] * 2


def test_numbering_follows_file_order(spark, tmp_path):
    for i, name in enumerate(("a", "b", "c")):
        lines = [f'{{"sniff_timestamp": "{1_700_000_000 + i * 10 + k}", "ip_src": "10.0.{i}.{k}", "ip_dst": "10.9.9.9"}}' for k in range(i * 2 + 1)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
    rows = store.to_records(store.number_rows(store.read_dissected(spark, str(tmp_path))), F.lit("2024-01-01").cast("timestamp"))
    got = [(r.packet_number, r.src_ip) for r in rows.orderBy("packet_number").collect()]
    assert [n for n, _ in got] == list(range(1, 10))
    assert [ip for _, ip in got] == [f"10.0.{i}.{k}" for i in range(3) for k in range(i * 2 + 1)]


def test_dissected_layers(spark, tmp_path):
    (tmp_path / "x.json").write_text("\n".join([
        '{"sniff_timestamp": "1700000000.5", "length": "60", "ipv6_src": "fe80::1", "ipv6_dst": "fe80::2", "ipv6_hlim": "9", "has_icmpv6": true}',
        '{"sniff_timestamp": "bad", "arp_src": "10.0.0.1", "arp_dst": "10.0.0.2", "captured_length": "42", "highest_layer": "arp"}',
        '{"ip_src": "1.1.1.1", "ip_dst": "2.2.2.2", "ip_ttl": "x", "tcp_srcport": "5000", "tcp_dstport": "443", "tcp_flags": "0x00000018"}']))
    rows = store.to_records(store.number_rows(store.read_dissected(spark, str(tmp_path))), F.lit("2024-06-01").cast("timestamp"))
    a, b, c = rows.orderBy("packet_number").collect()
    assert (a.network_layer, a.ip_version, a.ttl, a.transport_layer, a.protocol) == ("IPv6", 6, 9, "ICMPv6", "ICMPV6")
    assert (b.network_layer, b.packet_length, b.protocol, b.ip_version) == ("ARP", 42, "ARP", None)
    assert b.timestamp == dt.datetime(2024, 6, 1)
    assert (c.ttl, c.tcp_flags, c.protocol, c.app_layer_hint) == (None, "0x18", "HTTPS", "HTTPS")


def test_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f'{{"sniff_timestamp": "{1_700_000_000 + k}", "ip_src": "10.0.0.1", "length": "{k}"}}' for k in range(3000)]
    (tmp_path / "x.json").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("128MB", "20KB", "7KB"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = store.number_rows(store.read_dissected(spark, str(tmp_path)))
            assert rows.filter("packet_number != cast(length AS int) + 1").count() == 0 and rows.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_split_without_a_count_is_an_error(spark):
    rows = spark.createDataFrame([("f", 0, 5), ("f", 9, 6)], "_file string, _block long, _id long")
    table = spark.createDataFrame([("f", 0, 0, 5)], "_file string, _block long, _offset long, _first long")
    with pytest.raises(Exception, match="without a count"):
        store.numbered_by(rows, table).collect()


def test_a_session_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "packet_number long, timestamp timestamp"
    store.append_table(spark.createDataFrame([(1, day(1)), (2, day(2)), (3, None)], schema), path, "1")
    store.append_table(spark.createDataFrame([(9, day(1))], schema), path, "001")
    store.append_table(spark.createDataFrame([(4, day(2))], schema), path, "1")
    assert sorted((r.session_id, r.packet_number) for r in store.read_table(spark, path).collect()) == [("001", 9), ("1", 4)]
