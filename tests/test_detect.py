"""Rules at their thresholds, on small literal captures."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from packetloom.operators.detect import bruteforce, ddos, portscan, run, synflood
from packetloom.operators.detect.common import Thresholds

START = dt.datetime(2024, 1, 1)
SCHEMA = ("packet_number long, timestamp timestamp, src_ip string, dst_ip string, protocol string, packet_length int, "
          "src_port int, dst_port int, tcp_flags string")


def capture(spark, rows):
    """rows: (seconds, src, dst, protocol, length, dst_port, flags)."""
    return spark.createDataFrame([(i, START + dt.timedelta(seconds=s), a, b, p, n, 1000, port, f)
                                  for i, (s, a, b, p, n, port, f) in enumerate(rows)], SCHEMA)


def kinds(alerts):
    return {r.attack_type: r for r in alerts.collect()}


def test_packet_flood_needs_more_than_the_limit(spark):
    at = capture(spark, [(i / 10, "a", "v", "TCP", 10, 1, None) for i in range(11)])  # 11 packets in 1 s
    assert "DDoS-VolumeFlood" not in kinds(ddos.detect(at, Thresholds(ddos_packets_per_second=11)))
    hit = kinds(ddos.detect(at, Thresholds(ddos_packets_per_second=10)))["DDoS-VolumeFlood"]
    assert (hit.source_ip, hit.destination_ip, hit.severity) == ("a", "v", "LOW")
    assert hit.confidence == pytest.approx(0.515)


def test_bandwidth_flood_severity(spark):
    rows = capture(spark, [(0, "a", "v", "TCP", 500, 1, None), (1, "b", "v", "TCP", 500, 1, None)])
    hit = kinds(ddos.detect(rows, Thresholds(ddos_bytes_per_second=200)))["DDoS-BandwidthFlood"]
    assert (hit.severity, hit.source_ip, hit.confidence) == ("CRITICAL", "MULTIPLE", 0.8)


def test_growth_by_midpoint_and_median(spark):
    rows = capture(spark, [(0, "a", "v", "TCP", 1, 1, None)] + [(9 + i / 10, "a", "v", "TCP", 1, 1, None) for i in range(11)])
    assert ddos.growth_rate(rows, "midpoint").first()[0] == 10.0
    assert ddos.growth_rate(rows, "median").first()[0] == 0.0
    found = kinds(ddos.detect(rows, Thresholds(ddos_packets_per_second=1, ddos_growth="midpoint")))
    assert found["DDoS-RapidGrowth"].severity == "MEDIUM"
    assert "DDoS-RapidGrowth" not in kinds(ddos.detect(rows, Thresholds(ddos_packets_per_second=1)))


def test_median_split_counts_ties(spark):
    rows = capture(spark, [(s, "a", "v", "TCP", 1, 1, None) for s in (0, 1, 1, 1, 2)])
    assert ddos.growth_rate(rows, "median").first()[0] == pytest.approx((1 - 4) / 4)


def test_icmp_flood_is_named(spark):
    rows = capture(spark, [(i / 10, "a", "v", "ICMPv6" if i % 4 else "TCP", 1, None, None) for i in range(41)])
    assert "DDoS-ICMPFlood" not in kinds(ddos.detect(rows, Thresholds(ddos_packets_per_second=10)))  # share 30/41
    rows = capture(spark, [(i / 10, "a", "v", "ICMPv6" if i % 5 else "TCP", 1, None, None) for i in range(41)])
    assert kinds(ddos.detect(rows, Thresholds(ddos_packets_per_second=10)))["DDoS-ICMPFlood"].severity == "HIGH"


def test_syn_rules_need_five_tcp_packets(spark):
    rows = [(i, "a", "v", "TCP", 40, 80, "0x2") for i in range(4)]
    assert not kinds(synflood.detect(capture(spark, rows)))
    found = kinds(synflood.detect(capture(spark, [*rows, (5, "a", "v", "TCP", 40, 80, "S")])))
    assert set(found) == {"SYNFlood-Dominance"}
    assert (found["SYNFlood-Dominance"].source_ip, found["SYNFlood-Dominance"].severity) == ("", "MEDIUM")


def test_no_flags_column_means_all_syn(spark):
    rows = capture(spark, [(i, "a", "v", "TCP", 40, 80, None) for i in range(12)]).drop("tcp_flags")
    assert {"SYNFlood-Dominance", "SYNFlood-LowACK"} <= set(kinds(synflood.detect(rows)))


def test_scan_sweep_and_stealth(spark):
    scan = [(i, "scanner", "v", "TCP", 40, 100 + i, "0x2") for i in range(20)]
    sweep = [(i, "sweeper", f"h{i:02}", "TCP", 400, 445, None) for i in range(20)]
    quiet = [(i, "quiet", "v", "TCP", 40, 1 + i, None) for i in range(19)]
    found = kinds(portscan.detect(capture(spark, scan + sweep + quiet)))
    assert set(found) == {"PortScan-Horizontal", "PortScan-Vertical", "PortScan-SYNStealth"}
    horizontal = found["PortScan-Horizontal"]
    assert (horizontal.source_ip, horizontal.severity, horizontal.confidence) == ("scanner", "LOW", 0.6)
    assert horizontal.evidence["scan_type"] == "SEQUENTIAL"
    assert horizontal.evidence["sampled_ports"] == ",".join(str(100 + i) for i in range(20))
    assert found["PortScan-Vertical"].destination_ip == "MULTIPLE"


def test_scan_pattern(spark):
    rows = spark.createDataFrame([([1, 2, 3, 4],), ([1, 50, 60, 4000],), ([5, 9],), ([],)], "p array<int>").coalesce(1)
    assert [r[0] for r in rows.select(portscan.scan_pattern(F.col("p"))).collect()] == ["SEQUENTIAL", "RANDOM", "HORIZONTAL", "HORIZONTAL"]


def test_bruteforce_thresholds_and_shadowed_rule(spark):
    rows = capture(spark, [(i / 10, "a", "v", "TCP", 60, 22, None) for i in range(10)] + [(i / 10, "a", "v", "TCP", 60, 23, None) for i in range(9)])
    found = kinds(bruteforce.detect(rows))
    assert set(found) == {"BruteForce-SSH"}
    assert (found["BruteForce-SSH"].severity, found["BruteForce-SSH"].confidence) == ("LOW", 0.64)
    found = kinds(bruteforce.detect(rows, Thresholds(bruteforce_failed_attempts=50, bruteforce_rapid_min_attempts=10)))
    assert found["BruteForce-RapidReconnect"].dst_port == 22


def test_spray(spark):
    rows = capture(spark, [(i, "a", f"h{i % 5}", "TCP", 60, 22, None) for i in range(10)])
    hit = kinds(bruteforce.detect(rows))["BruteForce-CredentialSpray"]
    assert (hit.destination_ip, hit.severity, hit.confidence, hit.evidence["services_targeted"]) == ("MULTIPLE", "HIGH", 0.6, "ssh")


def test_run_keeps_first_per_key_and_isolates_failures(spark):
    rows = capture(spark, [(i / 10, "a", f"h{i % 2}", "TCP", 60, 22, None) for i in range(24)])

    def broken(df, limits):
        raise RuntimeError("no")

    detectors = (*run.DETECTORS, ("Broken", 1, broken))
    failed = []
    everything = run.run_detection(rows, detectors=detectors, dedup=False, failed=failed)
    assert failed == ["Broken"]
    assert everything.filter("attack_type = 'BruteForce-SSH'").count() == 2
    kept = run.run_detection(rows, detectors=detectors, failed=[]).filter("attack_type = 'BruteForce-SSH'").collect()
    assert [r.destination_ip for r in kept] == ["h0"]
    with pytest.raises(RuntimeError):
        run.run_detection(rows, detectors=detectors)
    assert run.run_detection(rows, disabled=[bruteforce.NAME]).filter("detector_name = 'Brute Force Detector'").count() == 0


def test_alert_invariants(spark, sf_dir):
    from packetloom.sources import fixtures
    alerts = run.all_alerts(fixtures.packets(spark, sf_dir, "burst"), Thresholds(
        ddos_packets_per_second=5, portscan_unique_ports=5, bruteforce_failed_attempts=3, synflood_syn_per_second=5.0))
    bad = alerts.filter(~F.col("severity").isin("LOW", "MEDIUM", "HIGH", "CRITICAL") | ~F.col("confidence").between(0, 1)
                        | F.col("alert_id").isNull() | F.col("recommendation").isNull() | (F.size("evidence") == 0))
    assert alerts.count() > 0 and bad.count() == 0


def test_order_and_partitions_do_not_matter(spark, sf_dir):
    from packetloom.sources import fixtures
    packets = fixtures.packets(spark, sf_dir, "burst")
    shuffled = packets.repartition(7, F.xxhash64("packet_number"))
    limits = Thresholds(ddos_packets_per_second=300, bruteforce_failed_attempts=3)
    columns = ["attack_type", "severity", "confidence", "source_ip", "destination_ip", "alert_id"]
    a, b = (sorted(map(tuple, run.run_detection(p, limits).select(*columns).collect())) for p in (packets, shuffled))
    assert a == b


def test_packets_are_scanned_once_for_all_rules(spark, tmp_path, sf_dir):
    from packetloom.operators.detect.common import folded
    from packetloom.sources import fixtures
    path = str(tmp_path / "packets")
    fixtures.packets(spark, sf_dir, "burst").write.parquet(path)
    packets = spark.read.parquet(path)
    once = folded(packets)._jdf.queryExecution().executedPlan().toString()
    after = run.run_detection(packets)._jdf.queryExecution().executedPlan().toString()
    assert once.count("FileScan parquet") == 1 and once.count("Exchange hashpartitioning") == 1 and "FileScan" not in after
    limits = Thresholds(ddos_packets_per_second=300, bruteforce_failed_attempts=3, ddos_growth="midpoint")
    apart = [d(packets, limits) for _, _, d in run.DETECTORS]
    names = ["attack_type", "severity", "confidence", "source_ip", "alert_id"]
    want = sorted(tuple(r) for a in apart for r in a.select(*names).collect())
    assert want == sorted(tuple(r) for r in run.all_alerts(packets, limits).select(*names).collect())
