"""Scalar functions against the Python standard library and hand-written values."""

from __future__ import annotations

import datetime as dt
import ipaddress
import random

from pyspark.sql import functions as F

from packetloom.functions import flags, ip, ports, text


def addresses():
    rng = random.Random(7)
    fixed = ["::", "::1", "fe80::1", "fe80::1%eth0", "ff02::1", "fc00::", "fdff::1", "2001:db8::8", "2001:db7::8",
             "2001::1", "2001:1::1", "2001:1::2", "2001:1::3", "2001:3::9", "2001:4:112::1", "2001:20::5", "2001:30::5",
             "2001:1ff::", "2001:200::", "64:ff9b:1::5", "64:ff9b::5", "100::1", "100:0:0:1::", "2002::1", "3fff:fff::1",
             "3fff:1000::", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "::ffff:127.0.0.1", "::ffff:224.0.0.1", "1:2:3:4:5:6:7:8",
             "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1::2::3", ":1::2", "1::2:", ":::", "12345::", "g::1",
             "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4", "0:0:1::", "::1.2.3.4", "::1.2.3", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4",
             "192.0.0.9", "192.0.0.10", "192.0.0.11", "192.0.0.170", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0",
             "198.17.0.1", "198.18.0.1", "198.19.1.1", "198.20.0.0", "240.0.0.1", "239.1.1.1", "255.255.255.255", "0.0.0.0",
             "0.1.2.3", "01.2.3.4", "1.2.3", "1.2.3.4.5", "256.1.1.1", "", "abc", None, "100.64.0.1", "9.255.255.255", "10.0.0.0"]
    v4 = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(200)]
    v6 = []
    for _ in range(200):
        groups = [format(rng.choice([0, 0, rng.randrange(65536)]), "x") for _ in range(8)]
        v6.append(str(ipaddress.ip_address(":".join(groups))) if rng.random() < 0.5 else ":".join(groups))
    return fixed + v4 + v6


def parse(value):
    try:
        return ipaddress.ip_address(value)
    except ValueError:
        return None


def kind(a):
    if a is None:
        return "unknown"
    for name in ("loopback", "multicast", "link_local", "unspecified", "private"):
        if getattr(a, f"is_{name}"):
            return name
    return "public"


def subnet(value, bits):
    try:
        return str(ipaddress.ip_network(f"{value}/{bits}", strict=False))
    except ValueError:
        return None


def test_addresses_match_the_standard_library(spark):
    values = addresses()
    df = spark.createDataFrame([(v,) for v in values], "ip string").coalesce(1)
    c = F.col("ip")
    rows = df.select(c, ip.is_valid_ip(c), ip.is_private_ip(c), ip.classify_ip(c),
                     ip.extract_subnet(c), ip.extract_subnet(c, 30), ip.extract_subnet(c, 64)).collect()
    for value, valid, private, cls, net24, net30, net64 in rows:
        a = parse(value)
        assert valid == (a is not None), value
        assert private == bool(a and (a.is_private or a.is_loopback)), value
        assert cls == kind(a), value
        if value and "%" not in value:
            assert net24 == subnet(value, 24), value
            assert net30 == subnet(value, 30), value
            assert net64 == subnet(value, 64), value


def test_two_decimals_round_like_printf(spark):
    values = [2.675, 1.125, 1.375, 0.125, 0.999, 1023.995, 5.005, -1.125, 0.0, 1e12 + 0.005]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = [r[0] for r in df.select(text.fixed2(F.col("x"))).collect()]
    assert got == [f"{v:.2f}" for v in values]


def test_units(spark):
    df = spark.createDataFrame([(1536,), (1023,), (1024 ** 5,), (1024 ** 6,), (-2048,)], "n bigint")
    assert [r[0] for r in df.select(text.format_bytes(F.col("n"))).collect()] == \
        ["1.50 KB", "1023.00 B", "1.00 PB", "1024.00 PB", "-2.00 KB"]
    df = spark.createDataFrame([(999,), (1500,), (2_000_000_000,)], "n bigint")
    assert [r[0] for r in df.select(text.format_bps(F.col("n"))).collect()] == ["999.00 bps", "1.50 Kbps", "2.00 Gbps"]


def strict(value):
    try:
        return int(str(value), 0)
    except ValueError:
        return 0


def test_strict_flags_are_python_literals(spark):
    values = ["0x2", "0X12", "0b10010", "0o22", "2", "010", "00", "S", "2.0", "", "-3", "0xZZ", "18"]
    df = spark.createDataFrame([(v,) for v in values], "s string")
    assert [r[0] for r in df.select(flags.strict_flags(F.col("s"))).collect()] == [strict(v) for v in values]
    assert spark.sql("SELECT cast(NULL AS string) s").select(flags.strict_flags(F.col("s"))).first()[0] == 0


def test_named_flags(spark):
    values = ["S", "SA", "syn ack", "SFP", "FA xx", "0x12", "17", None, "None", "nan", "", "ECE CWR", "0xzz"]
    df = spark.createDataFrame([(v,) for v in values], "s string").coalesce(1)
    tolerant = [r[0] for r in df.select(flags.tolerant_flags(F.col("s"))).collect()]
    assert tolerant == [2, 18, 18, 11, 17, 18, 17, 0, 0, 0, 0, 192, 0]
    feature = [r[0] for r in df.select(flags.feature_flags(F.col("s"))).collect()]
    assert feature == [2, 0, 18, 0, 0, 18, 17, 0, 0, 0, 0, 0, 0]


def test_flag_names_round_trip(spark):
    df = spark.range(256)
    names = flags.decode_tcp_flags(F.col("id"))
    assert df.filter(flags.encode_tcp_flags(names) != F.col("id")).count() == 0
    assert df.filter("id = 18").select(names).first()[0] == ["SYN", "ACK"]


def test_port_hint_order_and_fallbacks(spark):
    rows = spark.createDataFrame([
        ("DATA", "TCP", 53, 443), ("frame", "TCP", 1, 8443), ("tls", "TCP", 1, 2), (None, "udp", 1, 2), (None, None, None, None)],
        "layer string, transport string, sp int, dp int").coalesce(1)
    got = [r[0] for r in rows.select(ports.determine_protocol(F.col("layer"), F.col("transport"), F.col("sp"), F.col("dp"))).collect()]
    assert got == ["DNS", "HTTPS", "TLS", "UDP", "UNKNOWN"]
    hint = ports.determine_app_hint(F.lit(1), F.lit(2), F.lit("ssh"))
    assert spark.range(1).select(hint).first()[0] == "SSH"


def test_time_text(spark):
    df = spark.createDataFrame([("2024-01-02T23:30:00+05:30",), ("2024-01-02T23:30:00Z",), ("never",), (None,)], "s string").coalesce(1)
    assert [r[0] for r in df.select(text.local_hour(F.col("s"))).collect()] == [23, 23, None, None]
    assert [r[0] for r in df.select(text.format_timestamp(F.col("s"))).collect()] == \
        ["2024-01-02 18:00:00", "2024-01-02 23:30:00", "never", None]
    fallback = F.lit("2024-06-01 00:00:00").cast("timestamp")
    epochs = spark.createDataFrame([("1704067200.123456",), ("x",)], "s string").coalesce(1)
    got = [r[0] for r in epochs.select(text.epoch_to_timestamp(F.col("s"), fallback).cast("timestamp_ntz")).collect()]
    assert got == [dt.datetime(2024, 1, 1, 0, 0, 0, 123456), dt.datetime(2024, 6, 1)]


def test_interval_text():
    assert [text.interval_seconds(f) for f in ("1s", "5min", "2 h", "T", "3hr", "??", "4week")] == [1, 300, 7200, 60, 10800, 60, 4]
