"""Queries over readers, ingest and writers: each writes, reads back and compares."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions.ports import HINT_PORTS
from packetloom.operators.features import engineer
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_basic import _HINT_SQL
from packetloom.plans.queries_features import E_SQL
from packetloom.plans.queries_models import scratch
from packetloom.schemas import PACKETS
from packetloom.sources import alerts as alert_store
from packetloom.sources import fixtures
from packetloom.sources import packets as store

COLUMNS = [f.name for f in PACKETS]
ALL = ", ".join(COLUMNS)

# A dissector export derived from events: IPv4, IPv6 and ARP packets, TCP, UDP, ICMP and none.
_DISSECTED = """
  CASE WHEN event_id % 67 = 0 THEN 'x' ELSE concat(cast(1704067200 + event_id * 3 AS {t}), '.250000') END AS sniff_timestamp,
  CASE WHEN event_id % 71 = 0 THEN NULL ELSE cast(cast(40 + floor(value * 10) AS int) AS {t}) END AS length, '64' AS captured_length,
  CASE WHEN event_id % 10 < 7 THEN concat('192.168.1.', cast(user_id % 50 + 1 AS {t})) END AS ip_src,
  CASE WHEN event_id % 10 < 7 THEN concat('8.8.', cast(user_id % 50 AS {t}), '.4') END AS ip_dst,
  CASE WHEN event_id % 10 < 7 THEN cast(user_id % 200 AS {t}) END AS ip_ttl,
  CASE WHEN event_id % 10 IN (7, 8) THEN concat('fe80::', cast(user_id % 50 + 1 AS {t})) END AS ipv6_src,
  CASE WHEN event_id % 10 IN (7, 8) THEN '2606:4700::1111' END AS ipv6_dst, CASE WHEN event_id % 10 IN (7, 8) THEN '64' END AS ipv6_hlim,
  CASE WHEN event_id % 20 = 9 THEN '10.0.0.1' END AS arp_src, CASE WHEN event_id % 20 = 9 THEN '10.0.0.2' END AS arp_dst,
  CASE WHEN event_type IN ('purchase', 'click') THEN cast(1024 + event_id % 5000 AS {t}) END AS tcp_srcport,
  CASE WHEN event_type IN ('purchase', 'click') THEN cast(event_id % 500 AS {t}) END AS tcp_dstport,
  CASE WHEN event_type = 'purchase' THEN '0x00000012' WHEN event_type = 'click' THEN '10' END AS tcp_flags,
  CASE WHEN event_type = 'view' THEN '5353' END AS udp_srcport, CASE WHEN event_type = 'view' THEN cast(event_id % 100 AS {t}) END AS udp_dstport,
  event_type = 'signup' AS has_icmp, event_id % 2 = 0 AS has_icmpv6,
  CASE event_id % 3 WHEN 0 THEN 'DATA' WHEN 1 THEN 'tls' END AS highest_layer
"""


def export_dissected(spark, d) -> str:
    """Write the export as several JSON files in packet order."""
    fixtures.use_utc(spark)
    path = scratch(spark, "dissected")
    events = spark.read.parquet(f"{d}/events.parquet")
    events.selectExpr("event_id AS _o", *fixtures.select_list(_DISSECTED.format(t="string"))) \
        .repartitionByRange(3, "_o").sortWithinPartitions("_o").drop("_o").write.json(path)
    return path


_INGEST_TIME = "2024-06-01 00:00:00"
RECORDS_SQL = f"""d AS (SELECT event_id, {_DISSECTED.format(t='varchar')} FROM events),
  d2 AS (SELECT event_id + 1 AS packet_number, CASE WHEN sniff_timestamp = 'x' THEN TIMESTAMP '{_INGEST_TIME}' ELSE make_timestamp(CAST(TRY_CAST(sniff_timestamp AS DECIMAL(20, 6)) * 1000000 AS BIGINT)) END AS timestamp,
    coalesce(ip_src, ipv6_src, arp_src) AS src_ip, coalesce(ip_dst, ipv6_dst, arp_dst) AS dst_ip,
    CASE WHEN tcp_srcport IS NOT NULL THEN 'TCP' WHEN udp_srcport IS NOT NULL THEN 'UDP' WHEN has_icmp THEN 'ICMP' WHEN has_icmpv6 THEN 'ICMPv6' END AS transport_layer,
    coalesce(length::INT, captured_length::INT) AS packet_length, coalesce(tcp_srcport, udp_srcport)::INT AS src_port, coalesce(tcp_dstport, udp_dstport)::INT AS dst_port,
    coalesce(ip_ttl, ipv6_hlim)::INT AS ttl, CASE tcp_flags WHEN '10' THEN '0x10' WHEN '0x00000012' THEN '0x12' END AS tcp_flags,
    CASE WHEN ip_src IS NOT NULL THEN 'IPv4' WHEN ipv6_src IS NOT NULL THEN 'IPv6' WHEN arp_src IS NOT NULL THEN 'ARP' END AS network_layer,
    CASE WHEN ip_src IS NOT NULL THEN 4 WHEN ipv6_src IS NOT NULL THEN 6 END AS ip_version, highest_layer FROM d),
  d3 AS (SELECT *, CASE WHEN upper(highest_layer) NOT IN ('DATA', 'FRAME') THEN upper(highest_layer) {_HINT_SQL} ELSE coalesce(upper(transport_layer), 'UNKNOWN') END AS protocol FROM d2),
  rec AS (SELECT packet_number, timestamp, src_ip, dst_ip, protocol, transport_layer, packet_length, src_port, dst_port, ttl, tcp_flags, network_layer,
    CASE {_HINT_SQL} WHEN protocol IN ({', '.join(repr(n) for n, _ in HINT_PORTS)}) THEN protocol END AS app_layer_hint, ip_version FROM d3)"""


@register("a1_packet_csv", over("p", f"WITH {E_SQL} SELECT {ALL} FROM e"))
def _(spark, d):
    path = scratch(spark, "csv")
    store.export_csv(engineer(fixtures.packets(spark, d)), path)
    return store.read_csv(spark, path, must_have_rows=True)


@register("a3_dissected_ingest", f"WITH {RECORDS_SQL} SELECT * FROM rec")
def _(spark, d):
    rows = store.number_rows(store.read_dissected(spark, export_dissected(spark, d)))
    return store.to_records(rows, F.lit(_INGEST_TIME).cast("timestamp"))


@register("a3_skip_non_ip", f"WITH {RECORDS_SQL} SELECT packet_number, src_ip, dst_ip FROM rec WHERE src_ip IS NOT NULL AND dst_ip IS NOT NULL")
def _(spark, d):
    rows = store.number_rows(store.read_dissected(spark, export_dissected(spark, d)))
    return store.to_records(rows, F.lit(_INGEST_TIME).cast("timestamp"), skip_non_ip=True).select("packet_number", "src_ip", "dst_ip")


@register("a5_table_append", over("p", "SELECT packet_number, timestamp, src_ip, CASE WHEN packet_number % 2 = 0 THEN 'even' ELSE 'odd' END AS session_id, CAST(timestamp AS DATE) AS event_date FROM p"))
def _(spark, d):
    path = scratch(spark, "table")
    for name, test in (("even", "packet_number % 2 = 0"), ("odd", "packet_number % 2 = 1")):
        store.append_table(fixtures.packets(spark, d).filter(test), path, name)
    return store.load_packets(spark, path, "table").select("packet_number", "timestamp", "src_ip", "session_id", "event_date")


@register("a5_repeated_append", over("p", "SELECT packet_number, session_id, CAST(timestamp AS DATE) AS event_date FROM p WHERE session_id <> 'session-3' OR packet_number % 2 = 0"))
def _(spark, d):
    """All sessions, then everything once more, then one session again with half of its packets."""
    path = scratch(spark, "table")
    rows = fixtures.packets(spark, d)
    for part in (rows, rows, rows.filter("session_id = 'session-3' AND packet_number % 2 = 0")):
        store.append_table(part, path)
    return store.read_table(spark, path).select("packet_number", "session_id", "event_date")


@register("a6_csv_export", over("p", "SELECT packet_number, src_ip AS source_ip, dst_port AS destination_port, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS timestamp FROM p"))
def _(spark, d):
    path = scratch(spark, "csv")
    store.export_csv(fixtures.packets(spark, d), path)
    text = spark.read.option("header", True).csv(path)
    return text.select(F.col("packet_number").cast("long"), "source_ip", F.col("destination_port").cast("int"), "timestamp")


@register("a7_alert_append", over("a", """SELECT alert_id, timestamp, attack_type AS alert_type, severity, source_ip AS src_ip, destination_ip AS dst_ip, dst_port, CAST(NULL AS VARCHAR) AS protocol,
    coalesce(description, concat(attack_type, ' detected by ', detector_name)) AS description, concat('{"seq":"', CAST(seq AS VARCHAR), '"}') AS raw_evidence, detector_name, confidence, session_id FROM a"""))
def _(spark, d):
    path = scratch(spark, "alerts")
    rows = fixtures.alerts(spark, d).withColumn("evidence", F.create_map(F.lit("seq"), F.col("seq").cast("string")))
    alert_store.append_alerts(rows, path)
    return alert_store.read_alerts(spark, path).drop("is_acknowledged", "acknowledged_at")


@register("a8_ingest_run", f"""WITH {RECORDS_SQL} SELECT count(*) AS total_packets, round(avg(packet_length), 2) AS avg_packet_size, max(packet_length) AS max_packet_size, min(packet_length) AS min_packet_size,
    count(src_ip) AS packets_with_ip, count(*) - count(src_ip) AS packets_without_ip, min(timestamp) AS capture_start, max(timestamp) AS capture_end,
    count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips FROM rec""")
def _(spark, d):
    root = scratch(spark, "ingest")
    summary = store.run_ingest(spark, export_dissected(spark, d), f"{root}/table", "run-1", F.lit(_INGEST_TIME).cast("timestamp"), f"{root}/csv")
    return summary.drop("protocol_distribution", "transport_layer_distribution", "top_src_ips", "top_dst_ips")


def _top_sql(side: str) -> str:
    return f"(SELECT 'top_{side}_ips' AS list, {side}_ip AS name, count(*) AS packets FROM rec WHERE {side}_ip IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"


@register("a8_ingest_lists", f"""WITH {RECORDS_SQL} SELECT 'protocol_distribution' AS list, protocol AS name, count(*) AS packets FROM rec GROUP BY 2
    UNION ALL SELECT 'transport_layer_distribution', upper(transport_layer), count(*) FROM rec WHERE transport_layer IS NOT NULL GROUP BY 2 UNION ALL {_top_sql('src')} UNION ALL {_top_sql('dst')}""")
def _(spark, d):
    root = scratch(spark, "ingest")
    export = export_dissected(spark, d)
    for _ in range(2):  # a repeated run leaves the same table
        summary = store.run_ingest(spark, export, f"{root}/table", "run-1", F.lit(_INGEST_TIME).cast("timestamp"))
    summary = summary.select("protocol_distribution", "transport_layer_distribution", "top_src_ips", "top_dst_ips").persist()
    parts = [summary.select(F.lit(c).alias("list"), F.explode(c).alias("x")).select("list", F.col("x")["ip" if c.startswith("top") else "category"].alias("name"), "x.packets") for c in summary.columns]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("l2_table_retention", over("p", "SELECT packet_number, timestamp FROM p ORDER BY timestamp DESC, packet_number DESC LIMIT 1234"))
def _(spark, d):
    root = scratch(spark, "retention")
    store.append_table(fixtures.packets(spark, d), f"{root}/all")
    kept = store.keep_newest(spark, f"{root}/all", f"{root}/kept", 1234)
    rows = kept if kept is not None else store.read_table(spark, f"{root}/all")
    return rows.select("packet_number", "timestamp")
