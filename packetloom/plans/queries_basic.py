"""Queries over scans, cleaning, scalar functions, traffic, time series and protocols."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import flags, ip, ports, text
from packetloom.operators import browse, clean, protocols, timeseries, traffic
from packetloom.operators.alerts import acknowledge_state
from packetloom.plans.catalogue import over, register
from packetloom.sources import fixtures

NORM = ("CASE WHEN regexp_matches(trim(coalesce({c}, 'UNKNOWN')), '(?i)^(_WS[.])?MALFORMED') THEN 'MALFORMED' "
        "ELSE upper(trim(coalesce({c}, 'UNKNOWN'))) END")
NORM_P = NORM.format(c="protocol")
SHORT = ["packet_number", "timestamp", "src_ip", "dst_ip", "protocol", "packet_length"]
SHORT_SQL = ", ".join(SHORT)


def P(spark, d):
    return fixtures.packets(spark, d)


def B(spark, d):
    return fixtures.packets(spark, d, "burst")


# ---- scans, cleaning, paging -------------------------------------------------

@register("a2_newest_packets", over("p", f"""
    SELECT {SHORT_SQL} FROM p ORDER BY timestamp DESC, packet_number DESC LIMIT 500"""))
def _(spark, d):
    return browse.newest(P(spark, d), 500).select(*SHORT)


@register("a4_base_projection", over("p", """
    SELECT packet_number, timestamp, src_ip, dst_ip, protocol, transport_layer, packet_length, src_port, dst_port,
           CAST(NULL AS INT) AS ttl, tcp_flags, network_layer, app_layer_hint, ip_version FROM p"""))
def _(spark, d):
    return clean.project_base(P(spark, d).drop("ttl"))


@register("b1_alias_names", over("r", """
    SELECT source_ip AS src_ip, count(*) AS packets, count(DISTINCT destination_ip) AS targets FROM r GROUP BY 1"""))
def _(spark, d):
    rows = clean.rename_aliases(fixtures.raw_packets(spark, d))
    pairs = rows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("src_ip").agg(F.sum("n").alias("packets"), F.count("dst_ip").alias("targets"))


@register("b2_type_coercion", over("r", """
    SELECT packet_number, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp,
           CAST(TRY_CAST(packet_length AS DOUBLE) AS INT) AS packet_length,
           TRY_CAST(destination_port AS INT) AS dst_port, TRY_CAST(ttl AS INT) AS ttl
    FROM r WHERE TRY_CAST(packet_length AS DOUBLE) IS NOT NULL"""))
def _(spark, d):
    rows = clean.coerce_types(clean.rename_aliases(fixtures.raw_packets(spark, d)))
    return rows.select("packet_number", "timestamp", "packet_length", "dst_port", "ttl")


@register("b3_drop_duplicates", over("r", "SELECT DISTINCT * FROM r"))
def _(spark, d):
    return clean.drop_exact_duplicates(fixtures.raw_packets(spark, d))


@register("b4_capture_clean", over("r", """
    SELECT packet_number, coalesce(try_strptime(timestamp, '%Y-%m-%d %H:%M:%S'), TIMESTAMP '2024-06-01 00:00:00') AS timestamp,
           nullif(source_ip, 'None') AS src_ip, nullif(destination_ip, 'None') AS dst_ip,
           trim(upper(coalesce(protocol, 'UNKNOWN'))) AS protocol,
           CASE WHEN trim(upper(transport_layer)) NOT IN ('NAN', 'NONE') THEN trim(upper(transport_layer)) END AS transport_layer,
           CASE WHEN trim(upper(network_layer)) NOT IN ('NAN', 'NONE') THEN trim(upper(network_layer)) END AS network_layer,
           CAST(greatest(0, least(65535, coalesce(TRY_CAST(packet_length AS INT), 0))) AS INT) AS packet_length,
           TRY_CAST(source_port AS INT) AS src_port, TRY_CAST(destination_port AS INT) AS dst_port, TRY_CAST(ttl AS INT) AS ttl
    FROM (SELECT DISTINCT * FROM r)"""))
def _(spark, d):
    raw = clean.rename_aliases(fixtures.raw_packets(spark, d))
    return clean.clean_capture(raw, F.lit("2024-06-01 00:00:00").cast("timestamp"))


@register("b5_bandwidth_rows", over("r", """
    SELECT packet_number, try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, TRY_CAST(packet_length AS INT) AS packet_length
    FROM r WHERE TRY_CAST(packet_length AS INT) IS NOT NULL AND try_strptime(timestamp, '%Y-%m-%d %H:%M:%S') IS NOT NULL"""))
def _(spark, d):
    rows = clean.prepare_bandwidth(clean.rename_aliases(fixtures.raw_packets(spark, d)))
    return rows.select("packet_number", "timestamp", "packet_length")


@register("b6_protocol_names", over("r", f"""
    SELECT packet_number, {NORM_P} AS protocol, {NORM.format(c="transport_layer")} AS transport_layer
    FROM r WHERE TRY_CAST(packet_length AS INT) IS NOT NULL"""))
def _(spark, d):
    rows = clean.normalise_protocols(fixtures.raw_packets(spark, d))
    return rows.select("packet_number", "protocol", "transport_layer")


@register("b7_recent_traffic", over("p", f"""
    SELECT {SHORT_SQL}, label FROM p WHERE protocol = 'UDP' AND label = 'PortScan'
    ORDER BY timestamp DESC, packet_number DESC LIMIT 20 OFFSET 10"""))
def _(spark, d):
    return browse.recent_traffic(P(spark, d), 20, 10, protocol="UDP", label="PortScan").select(*SHORT, "label")


@register("b8_browser_page", over("p", f"""
    WITH f AS (SELECT * FROM p WHERE regexp_matches(src_ip, '(?i)168\\.1\\.1') AND regexp_matches(dst_ip, '(?i)0\\.1')
               AND protocol = 'TCP' AND packet_length BETWEEN 100 AND 900)
    SELECT {SHORT_SQL}, (SELECT count(*) FROM f) AS total FROM f
    ORDER BY timestamp DESC, packet_number DESC LIMIT 15 OFFSET 15"""))
def _(spark, d):
    page, total = browse.packets_page(P(spark, d), 2, 15, src_ip=r"168\.1\.1", dst_ip=r"0\.1",
                                      protocol="TCP", min_length=100, max_length=900)
    return page.select(*SHORT).crossJoin(F.broadcast(total))


@register("b9_alert_query", over("a", """
    SELECT alert_id, timestamp, attack_type, severity, source_ip FROM a
    WHERE severity = 'HIGH' AND attack_type = 'BruteForce-SSH' AND NOT (seq % 2 = 0)
    ORDER BY timestamp DESC, alert_id DESC LIMIT 50"""))
def _(spark, d):
    alerts = fixtures.alerts(spark, d)
    acks = alerts.filter("seq % 2 = 0").select("alert_id", F.col("timestamp").alias("ack_time"))
    state = acknowledge_state(alerts, acks)
    return browse.alert_query(state, 50, "HIGH", "BruteForce-SSH", True) \
        .select("alert_id", "timestamp", "attack_type", "severity", "source_ip")


@register("b10_row_counts", over("p a", """
    SELECT (SELECT count(*) FROM p) AS packets, count(*) AS alerts,
           count(*) FILTER (WHERE seq % 5 <> 0) AS unacknowledged_alerts FROM a"""))
def _(spark, d):
    alerts = fixtures.alerts(spark, d)
    acks = alerts.filter("seq % 5 = 0").select("alert_id", F.col("timestamp").alias("ack_time"))
    return browse.status_counts(P(spark, d), acknowledge_state(alerts, acks))


# ---- scalar functions ---------------------------------------------------------
# Inputs are made from event ids so that every branch is met.

_IP_TEXT = ("CASE event_id % 12 WHEN 0 THEN concat('127.0.', cast(event_id % 256 AS {t}), '.1') "
            "WHEN 1 THEN concat('169.254.', cast(event_id % 256 AS {t}), '.9') WHEN 2 THEN '0.0.0.0' "
            "WHEN 3 THEN concat(cast(224 + event_id % 16 AS {t}), '.0.0.5') WHEN 4 THEN concat('010.1.2.', cast(event_id % 256 AS {t})) "
            "WHEN 5 THEN concat('10.1.', cast(event_id % 300 AS {t}), '.7') WHEN 6 THEN 'none' WHEN 7 THEN concat('192.168.3.', cast(event_id % 256 AS {t})) "
            "WHEN 8 THEN concat('172.', cast(event_id % 64 AS {t}), '.0.1') WHEN 9 THEN concat('192.0.0.', cast(event_id % 16 AS {t})) "
            "WHEN 10 THEN NULL ELSE concat(cast((event_id * 37) % 256 AS {t}), '.', cast((event_id * 11) % 256 AS {t}), '.', cast(event_id % 256 AS {t}), '.', cast((event_id * 3) % 256 AS {t})) END")
_OCT = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"regexp_full_match(ip, '{_OCT}\.{_OCT}\.{_OCT}\.{_OCT}')"
_NUM = ("CASE WHEN " + _V4 + " THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 "
        "+ split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END")
_IPS_SQL = f"""WITH i AS (SELECT event_id, {_IP_TEXT.format(t='varchar')} AS ip FROM events),
    n AS (SELECT event_id, ip, {_NUM} AS v FROM i)"""


def _net(cidr: str) -> str:
    base, bits = cidr.split("/")
    return (f"(v >> {32 - int(bits)}) = (" + " + ".join(
        f"{octet}::BIGINT * {256 ** (3 - k)}" for k, octet in enumerate(base.split("."))) + f") >> {32 - int(bits)}")


_PRIV = "(" + " OR ".join(_net(c) for c in (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")) + \
    ") AND v NOT IN (192::BIGINT * 16777216 + 9, 192::BIGINT * 16777216 + 10)"


def _events(spark, d):
    fixtures.use_utc(spark)
    return spark.read.parquet(f"{d}/events.parquet")


def _ips(spark, d):
    return _events(spark, d).selectExpr("event_id", f"{_IP_TEXT.format(t='string')} AS ip")


@register("c1_is_private_ip", f"{_IPS_SQL} SELECT event_id, ip, coalesce({_PRIV}, false) AS is_private FROM n")
def _(spark, d):
    return _ips(spark, d).withColumn("is_private", ip.is_private_ip(F.col("ip")))


@register("c2_classify_ip", f"""{_IPS_SQL} SELECT event_id, CASE WHEN v IS NULL THEN 'unknown'
    WHEN v >> 24 = 127 THEN 'loopback' WHEN v >> 28 = 14 THEN 'multicast' WHEN v >> 16 = 43518 THEN 'link_local'
    WHEN v = 0 THEN 'unspecified' WHEN {_PRIV} THEN 'private' ELSE 'public' END AS kind FROM n""")
def _(spark, d):
    return _ips(spark, d).select("event_id", ip.classify_ip(F.col("ip")).alias("kind"))


@register("c3_is_valid_ip", f"{_IPS_SQL} SELECT event_id, v IS NOT NULL AS valid FROM n")
def _(spark, d):
    return _ips(spark, d).select("event_id", ip.is_valid_ip(F.col("ip")).alias("valid"))


@register("c4_extract_subnet", f"""{_IPS_SQL} SELECT event_id,
    CASE WHEN v IS NOT NULL THEN concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.', split_part(ip, '.', 3), '.0/24') END AS subnet24,
    CASE WHEN v IS NOT NULL THEN concat(split_part(ip, '.', 1), '.', split_part(ip, '.', 2), '.',
         CAST(split_part(ip, '.', 3)::INT // 16 * 16 AS VARCHAR), '.0/20') END AS subnet20 FROM n""")
def _(spark, d):
    return _ips(spark, d).select("event_id", ip.extract_subnet(F.col("ip")).alias("subnet24"),
                                 ip.extract_subnet(F.col("ip"), 20).alias("subnet20"))


_SIZES = "cast(CASE WHEN event_id % 2 = 0 THEN (event_id % 20000) * (event_id % 20000) * (event_id % 20000) * (event_id % 20000) ELSE (event_id % 400) * 128 - 512 END AS bigint)"


def _unit_sql(step: str, units: tuple[str, ...]) -> str:
    cases = " ".join(f"WHEN abs(x) < {step}^{k + 1} THEN printf('%.2f {u}', x / {step}^{k})"
                     for k, u in enumerate(units[:-1]))
    return f"CASE {cases} ELSE printf('%.2f {units[-1]}', x / {step}^{len(units) - 1}) END"


@register("c5_format_bytes", f"""SELECT event_id, {_unit_sql('1024.0::DOUBLE', ('B', 'KB', 'MB', 'GB', 'TB', 'PB'))} AS shown
    FROM (SELECT event_id, {_SIZES}::DOUBLE AS x FROM events)""")
def _(spark, d):
    return _events(spark, d).select("event_id", text.format_bytes(F.expr(_SIZES)).alias("shown"))


@register("c6_format_bps", f"""SELECT event_id, {_unit_sql('1000.0::DOUBLE', ('bps', 'Kbps', 'Mbps', 'Gbps', 'Tbps', 'Pbps'))} AS shown
    FROM (SELECT event_id, {_SIZES}::DOUBLE AS x FROM events)""")
def _(spark, d):
    return _events(spark, d).select("event_id", text.format_bps(F.expr(_SIZES)).alias("shown"))


_SERVICE_VALUES = ", ".join(f"({k}, '{v}')" for k, v in ports.SERVICES.items())


@register("c7_port_to_service", f"""WITH s(port, service) AS (VALUES {_SERVICE_VALUES})
    SELECT event_id, coalesce(s.service, 'unknown') AS service FROM events LEFT JOIN s ON s.port = event_id % 9000""")
def _(spark, d):
    return _events(spark, d).select("event_id", ports.port_to_service(F.expr("event_id % 9000")).alias("service"))


@register("c8_is_privileged_port", """SELECT event_id, (event_id * 7) % 70000 - 100 <= 1023 AND (event_id * 7) % 70000 - 100 >= 0 AS privileged FROM events""")
def _(spark, d):
    return _events(spark, d).select("event_id", ports.is_privileged_port(F.expr("event_id * 7 % 70000 - 100")).alias("privileged"))


@register("c9_is_ephemeral_port", """SELECT event_id, (event_id * 7) % 70000 >= 49152 AND (event_id * 7) % 70000 <= 65535 AS ephemeral FROM events""")
def _(spark, d):
    return _events(spark, d).select("event_id", ports.is_ephemeral_port(F.expr("event_id * 7 % 70000")).alias("ephemeral"))


@register("c10_protocol_name", """SELECT event_id, CASE event_id % 140 WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' WHEN 41 THEN 'IPv6'
    WHEN 58 THEN 'ICMPv6' WHEN 89 THEN 'OSPF' WHEN 132 THEN 'SCTP' ELSE concat('PROTO_', CAST(event_id % 140 AS VARCHAR)) END AS name FROM events""")
def _(spark, d):
    return _events(spark, d).select("event_id", ports.protocol_num_to_name(F.expr("event_id % 140")).alias("name"))


_BITS = (("FIN", 1), ("SYN", 2), ("RST", 4), ("PSH", 8), ("ACK", 16), ("URG", 32), ("ECE", 64), ("CWR", 128))
_DECODED = "concat_ws('+', " + ", ".join(f"CASE WHEN (event_id % 256) & {b} <> 0 THEN '{n}' END" for n, b in _BITS) + ")"


@register("c11_decode_flags", f"SELECT event_id, {_DECODED} AS names FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", F.array_join(flags.decode_tcp_flags(F.expr("event_id % 256")), "+").alias("names"))


@register("c12_encode_flags", "SELECT event_id, CAST(event_id % 256 AS INT) AS mask FROM events")
def _(spark, d):
    names = flags.decode_tcp_flags(F.expr("event_id % 256"))
    mixed = F.concat(F.transform(names, F.lower), names, F.array(F.lit("nonsense")))
    return _events(spark, d).select("event_id", flags.encode_tcp_flags(mixed).alias("mask"))


_FLAG_TEXT = ("CASE event_id % 14 WHEN 0 THEN concat('0x', lower(hex(event_id % 256))) WHEN 1 THEN cast(event_id % 64 AS {t}) "
              "WHEN 2 THEN 'S' WHEN 3 THEN 'SA' WHEN 4 THEN 'SYN ACK' WHEN 5 THEN '0b10010' WHEN 6 THEN '0o22' WHEN 7 THEN '010' "
              "WHEN 8 THEN NULL WHEN 9 THEN '2.0' WHEN 10 THEN 'sfp' WHEN 11 THEN 'nan' WHEN 12 THEN 'FA xx' ELSE '0X12' END")
_FLAGS_SQL = f"WITH f AS (SELECT event_id, {_FLAG_TEXT.format(t='varchar').replace('hex(event_id % 256)', 'to_hex(event_id % 256)')} AS s FROM events)"
_HEX = "list_reduce(list_transform(string_split(lower(s[3:]), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda acc, x: acc * 16 + x)"


def _radix(base: int) -> str:
    return _HEX.replace("* 16", f"* {base}")


def _flag_rows(spark, d):
    return _events(spark, d).selectExpr("event_id", f"{_FLAG_TEXT.format(t='string')} AS s")


@register("c13_strict_flags", f"""{_FLAGS_SQL} SELECT event_id, CAST(CASE WHEN regexp_full_match(s, '0[xX][0-9a-fA-F]+') THEN {_HEX}
    WHEN regexp_full_match(s, '0[bB][01]+') THEN {_radix(2)} WHEN regexp_full_match(s, '0[oO][0-7]+') THEN {_radix(8)}
    WHEN regexp_full_match(s, '[1-9][0-9]*|0+') THEN TRY_CAST(s AS BIGINT) ELSE 0 END AS BIGINT) AS mask FROM f""")
def _(spark, d):
    return _flag_rows(spark, d).select("event_id", flags.strict_flags(F.col("s")).alias("mask"))


@register("c14_tolerant_flags", f"""{_FLAGS_SQL} SELECT event_id, CAST(CASE WHEN s IS NULL OR s = 'nan' THEN 0 WHEN regexp_full_match(s, '0[xX][0-9a-fA-F]+') THEN {_HEX}
    WHEN regexp_full_match(s, '[0-9]+') THEN TRY_CAST(s AS BIGINT) WHEN s = 'S' THEN 2 WHEN s IN ('SA', 'SYN ACK') THEN 18 WHEN s = 'sfp' THEN 11
    WHEN s = 'FA xx' THEN 17 ELSE 0 END AS BIGINT) AS mask FROM f""")
def _(spark, d):
    return _flag_rows(spark, d).select("event_id", flags.tolerant_flags(F.col("s")).alias("mask"))


@register("c15_feature_flags", f"""{_FLAGS_SQL} SELECT event_id, CAST(CASE WHEN s IS NULL OR s = 'nan' THEN 0 WHEN regexp_full_match(s, '0[xX][0-9a-fA-F]+') THEN {_HEX}
    WHEN regexp_full_match(s, '[0-9]+') THEN TRY_CAST(s AS BIGINT) WHEN s = 'S' THEN 2 WHEN s = 'SYN ACK' THEN 18 ELSE 0 END AS BIGINT) AS mask FROM f""")
def _(spark, d):
    return _flag_rows(spark, d).select("event_id", flags.feature_flags(F.col("s")).alias("mask"))


_SIZE_SQL = "CASE WHEN packet_length < 200 THEN 'small' WHEN packet_length <= 1000 THEN 'medium' ELSE 'large' END"


@register("c16_size_class", over("p", f"SELECT packet_number, {_SIZE_SQL} AS size_class FROM p"))
def _(spark, d):
    return P(spark, d).select("packet_number", text.size_class(F.col("packet_length")).alias("size_class"))


@register("c17_hour_of_day", """SELECT event_id, CASE WHEN event_id % 53 <> 0 THEN CAST(hour(ts) AS INT) END AS hour_of_day FROM events""")
def _(spark, d):
    stamp = F.expr("CASE WHEN event_id % 53 = 0 THEN 'soon' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'+05:30'\") END")
    return _events(spark, d).select("event_id", text.local_hour(stamp).alias("hour_of_day"))


_HINT_SQL = " ".join(
    f"WHEN src_port IN ({', '.join(map(str, ps))}) OR dst_port IN ({', '.join(map(str, ps))}) THEN '{n}'"
    for n, ps in (("DNS", (53,)), ("HTTPS", (443, 8443)), ("HTTP", (80, 8080, 8000)), ("SSH", (22,)),
                  ("FTP", (20, 21)), ("SMTP", (25, 465, 587))))
_LAYER = "CASE packet_number % 4 WHEN 0 THEN 'DATA' WHEN 1 THEN 'frame' WHEN 2 THEN lower(app_layer_hint) ELSE NULL END"


@register("c18_protocol_derivation", over("p", f"""
    SELECT packet_number, CASE WHEN upper({_LAYER}) NOT IN ('DATA', 'FRAME') THEN upper({_LAYER}) {_HINT_SQL}
    ELSE coalesce(transport_layer, 'UNKNOWN') END AS derived FROM p"""))
def _(spark, d):
    return P(spark, d).select("packet_number", ports.determine_protocol(
        F.expr(_LAYER), F.col("transport_layer"), F.col("src_port"), F.col("dst_port")).alias("derived"))


@register("c19_app_hint", over("p", f"""
    SELECT packet_number, CASE {_HINT_SQL} WHEN protocol IN ('DNS', 'HTTPS', 'HTTP', 'SSH', 'FTP', 'SMTP') THEN protocol END AS hint FROM p"""))
def _(spark, d):
    return P(spark, d).select("packet_number", ports.determine_app_hint(
        F.col("src_port"), F.col("dst_port"), F.col("protocol")).alias("hint"))


@register("c20_epoch_time", """SELECT event_id, CASE WHEN event_id % 59 = 0 THEN TIMESTAMP '2024-06-01 00:00:00'
    ELSE make_timestamp(1704067200000000 + event_id * 1234567) END AS ts FROM events""")
def _(spark, d):
    stamp = F.expr("CASE WHEN event_id % 59 = 0 THEN 'x' ELSE cast(cast(1704067200000000 + event_id * 1234567 AS decimal(28,6)) / 1000000 AS string) END")
    return _events(spark, d).select("event_id", text.epoch_to_timestamp(
        stamp, F.lit("2024-06-01 00:00:00").cast("timestamp")).alias("ts"))


@register("c21_format_time", """SELECT event_id, CASE WHEN event_id % 61 = 0 THEN 'bad time' ELSE strftime(ts, '%d/%m/%Y %H:%M:%S') END AS shown FROM events""")
def _(spark, d):
    stamp = F.expr("CASE WHEN event_id % 61 = 0 THEN 'bad time' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") END")
    return _events(spark, d).select("event_id", text.format_timestamp(stamp, "dd/MM/yyyy HH:mm:ss").alias("shown"))


# ---- traffic --------------------------------------------------------------------

_DUR = "(epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6"
_BASIC_SQL = f"""SELECT count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
    round({_DUR}, 4) AS capture_duration_seconds, round(count(*) / ({_DUR}), 4) AS packets_per_second,
    round(sum(packet_length) / ({_DUR}), 4) AS bytes_per_second, min(timestamp) AS capture_start, max(timestamp) AS capture_end"""


@register("d1_basic_stats", over("b", f"{_BASIC_SQL} FROM b"))
def _(spark, d):
    return traffic.basic_stats(B(spark, d))


_TALK_SQL = """t AS (SELECT 'src' AS side, src_ip AS ip, count(*) AS packets FROM {t} GROUP BY 2
    UNION ALL SELECT 'dst', dst_ip, count(*) FROM {t} GROUP BY 2),
    k AS (SELECT side, CAST(row_number() OVER (PARTITION BY side ORDER BY packets DESC, ip) AS INT) AS rank, ip, packets FROM t)"""


@register("d2_ip_statistics", over("p", f"""WITH {_TALK_SQL.format(t='p')} SELECT side, rank, ip, packets,
    (SELECT count(*) FROM t WHERE side = 'src') AS unique_src_ips, (SELECT count(*) FROM t WHERE side = 'dst') AS unique_dst_ips FROM k WHERE rank <= 10"""))
def _(spark, d):
    return traffic.top_talkers(P(spark, d)).crossJoin(traffic.host_cardinality(P(spark, d)))


_PACKET_STATS_SQL = """round(avg(packet_length), 2) AS avg_packet_size, min(packet_length) AS min_packet_size, max(packet_length) AS max_packet_size,
    round(quantile_cont(packet_length, 0.5), 2) AS median_packet_size, round(stddev_samp(packet_length), 2) AS std_packet_size"""


@register("d3_packet_statistics", over("p", f"SELECT {_PACKET_STATS_SQL} FROM p"))
def _(spark, d):
    return traffic.packet_statistics(P(spark, d))


def _pairs(column: str, *fields: str):
    """Nested list to text, e.g. ``a=1,b=2``."""
    return F.array_join(F.transform(F.col(column), lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), ",")


def _tops_sql(side: str) -> str:
    return f"(SELECT string_agg(concat(ip, '=', packets), ',' ORDER BY rank) FROM k WHERE side = '{side}' AND rank <= 10) AS top_{side}_ips"


@register("d4_traffic_summary", over("p", f"""WITH {_TALK_SQL.format(t='p')}, c AS (SELECT protocol, count(*) AS packets FROM p GROUP BY 1)
    {_BASIC_SQL}, {_PACKET_STATS_SQL}, (SELECT count(*) FROM t WHERE side = 'src') AS unique_src_ips, (SELECT count(*) FROM t WHERE side = 'dst') AS unique_dst_ips,
    {_tops_sql('src')}, {_tops_sql('dst')}, (SELECT string_agg(concat(protocol, '=', packets), ',' ORDER BY protocol) FROM c) AS protocol_counts,
    date_diff('minute', time_bucket(INTERVAL 1 MINUTE, min(timestamp)), time_bucket(INTERVAL 1 MINUTE, max(timestamp))) + 1 AS minutes FROM p"""))
def _(spark, d):
    s = traffic.traffic_summary(P(spark, d))
    return s.withColumns({"top_src_ips": _pairs("top_src_ips", "ip", "packets"), "top_dst_ips": _pairs("top_dst_ips", "ip", "packets"),
                          "protocol_counts": _pairs("protocol_counts", "protocol", "packets"),
                          "minutes": F.size("minute_series").cast("long")}).drop("minute_series")


@register("d5_top_sources", over("p", "SELECT src_ip AS category, count(*) AS packets FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7"))
def _(spark, d):
    return traffic.top_categories(P(spark, d), "src_ip", 7)


@register("d6_category_distribution", over("p", f"""SELECT 'size' AS metric, {_SIZE_SQL} AS category, count(*) AS packets FROM p GROUP BY 2
    UNION ALL SELECT 'protocol', protocol, count(*) FROM p GROUP BY 2
    UNION ALL SELECT 'transport', transport_layer, count(*) FROM p WHERE transport_layer IS NOT NULL GROUP BY 2"""))
def _(spark, d):
    rows = P(spark, d).withColumn("packet_size_category", text.size_class(F.col("packet_length")))
    parts = [traffic.category_counts(rows, c).select(F.lit(m).alias("metric"), "category", "packets")
             for m, c in (("size", "packet_size_category"), ("protocol", "protocol"), ("transport", "transport_layer"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("d7_ingest_summary", over("p", f"""WITH {_TALK_SQL.format(t='p')}, c AS (SELECT protocol, count(*) AS packets FROM p GROUP BY 1),
    x AS (SELECT transport_layer, count(*) AS packets FROM p WHERE transport_layer IS NOT NULL GROUP BY 1)
    SELECT count(*) AS total_packets, round(avg(packet_length), 2) AS avg_packet_size, max(packet_length) AS max_packet_size, min(packet_length) AS min_packet_size,
    count(src_ip) AS packets_with_ip, count(*) - count(src_ip) AS packets_without_ip, min(timestamp) AS capture_start, max(timestamp) AS capture_end,
    (SELECT count(*) FROM t WHERE side = 'src') AS unique_src_ips, (SELECT count(*) FROM t WHERE side = 'dst') AS unique_dst_ips, {_tops_sql('src')}, {_tops_sql('dst')},
    (SELECT string_agg(concat(protocol, '=', packets), ',' ORDER BY protocol) FROM c) AS protocol_distribution,
    (SELECT string_agg(concat(transport_layer, '=', packets), ',' ORDER BY transport_layer) FROM x) AS transport_layer_distribution FROM p"""))
def _(spark, d):
    s = traffic.ingest_summary(P(spark, d))
    return s.withColumns({"top_src_ips": _pairs("top_src_ips", "ip", "packets"), "top_dst_ips": _pairs("top_dst_ips", "ip", "packets"),
                          "protocol_distribution": _pairs("protocol_distribution", "category", "packets"),
                          "transport_layer_distribution": _pairs("transport_layer_distribution", "category", "packets")})


@register("d8_length_histogram", over("p", """WITH s AS (SELECT min(packet_length) AS lo, (max(packet_length) - min(packet_length)) / 50.0::DOUBLE AS w FROM p)
    SELECT CAST(least(49, floor((packet_length - lo) / w)) AS INT) AS bin, round(lo + CAST(least(49, floor((packet_length - lo) / w)) AS INT) * w, 4) AS bin_start,
    count(*) AS packets FROM p, s GROUP BY 1, 2"""))
def _(spark, d):
    return traffic.length_histogram(P(spark, d))


# ---- time series -----------------------------------------------------------------

_FILL = """WITH c AS (SELECT time_bucket(INTERVAL 1 MINUTE, timestamp) AS minute, count(*) AS packets, CAST(sum(packet_length) AS BIGINT) AS bytes
    FROM {src} GROUP BY 1), m AS (SELECT unnest(generate_series((SELECT min(minute) FROM c), (SELECT max(minute) FROM c), INTERVAL 1 MINUTE)) AS minute)"""


@register("e1_minute_timeline", over("p", _FILL.format(src="p") + """ SELECT m.minute, coalesce(c.packets, 0) AS packets, coalesce(c.bytes, 0) AS bytes
    FROM m LEFT JOIN c ON m.minute = c.minute"""))
def _(spark, d):
    return timeseries.minute_timeline(P(spark, d))


def _interval_sql(table: str, unit: str, seconds: int) -> str:
    return f"""SELECT time_bucket(INTERVAL {unit}, timestamp, TIMESTAMP '2024-01-01') AS interval_start, CAST(sum(packet_length) AS BIGINT) AS bytes, count(*) AS packets,
    round(CAST(sum(packet_length) AS DOUBLE) / {seconds}, 4) AS bytes_per_second, round(CAST(count(*) AS DOUBLE) / {seconds}, 4) AS packets_per_second FROM {table} GROUP BY 1"""


@register("e2_interval_5min", over("p", _interval_sql("p", "5 MINUTE", 300)))
def _(spark, d):
    return timeseries.traffic_timeline(P(spark, d), "5min")


@register("e2_interval_7min_from_midnight", over("p", _interval_sql("p", "7 MINUTE", 420)))
def _(spark, d):
    return timeseries.traffic_timeline(P(spark, d), "7 T")


@register("e3_throughput", over("b", _interval_sql("b", "1 SECOND", 1)))
def _(spark, d):
    return timeseries.throughput(B(spark, d))


@register("e4_peak_periods", over("p", f"SELECT * FROM ({_interval_sql('p', '1 HOUR', 3600)}) ORDER BY bytes DESC, interval_start LIMIT 10"))
def _(spark, d):
    return timeseries.peak_periods(P(spark, d), "1h", 10)


_BW_SQL = f"""SELECT CAST(sum(packet_length) AS BIGINT) AS total_bytes, count(*) AS total_packets, round({_DUR}, 4) AS capture_duration_seconds,
    round(sum(packet_length) / ({_DUR}), 4) AS avg_bytes_per_second, (SELECT CAST(max(bytes) AS DOUBLE) FROM s) AS peak_bytes_per_second,
    round(count(*) / ({_DUR}), 4) AS avg_packets_per_second, (SELECT CAST(max(packets) AS DOUBLE) FROM s) AS peak_packets_per_second,
    least(100.0::DOUBLE, round((SELECT max(bytes) FROM s)::DOUBLE / 125000000.0::DOUBLE * 100, 4)) AS bandwidth_utilisation_pct,
    min(timestamp) AS capture_start, max(timestamp) AS capture_end FROM b"""
_SEC_B = "s AS (SELECT date_trunc('second', timestamp) AS t, sum(packet_length) AS bytes, count(*) AS packets FROM b GROUP BY 1)"


@register("e5_bandwidth_metrics", over("b", f"WITH {_SEC_B} {_BW_SQL}"))
def _(spark, d):
    return timeseries.bandwidth_metrics(B(spark, d))


@register("e6_bandwidth_report", over("p", f"""WITH sec AS ({_interval_sql('p', '1 SECOND', 1)}), mi AS ({_interval_sql('p', '1 MINUTE', 60)})
    SELECT 'second' AS section, * FROM sec UNION ALL SELECT 'minute', * FROM mi
    UNION ALL (SELECT 'peak', * FROM mi ORDER BY bytes DESC, interval_start LIMIT 10)
    UNION ALL SELECT 'total', min(timestamp), CAST(sum(packet_length) AS BIGINT), count(*), round(sum(packet_length) / ({_DUR}), 4), round(count(*) / ({_DUR}), 4) FROM p"""))
def _(spark, d):
    return timeseries.bandwidth_report(P(spark, d))


@register("e7_rate_series", over("p", f"SELECT interval_start, packets_per_second AS value FROM ({_interval_sql('p', '1 MINUTE', 60)})"))
def _(spark, d):
    return timeseries.rate_series(P(spark, d), "packets_per_minute")


@register("e8_bytes_by_protocol", over("p", "SELECT protocol, CAST(sum(packet_length) AS BIGINT) AS bytes FROM p GROUP BY 1"))
def _(spark, d):
    return timeseries.bytes_by_protocol(P(spark, d))


@register("e9_protocol_timeline", over("p", _FILL.format(src="(SELECT * FROM p WHERE protocol = '_WS.MALFORMED')")
          + " SELECT m.minute, coalesce(c.packets, 0) AS packets FROM m LEFT JOIN c ON m.minute = c.minute"))
def _(spark, d):
    return timeseries.protocol_timeline(clean.normalise_protocols(P(spark, d)), "malformed")


# ---- protocols --------------------------------------------------------------------

_DIST = "SELECT {c} AS category, count(*) AS packets FROM {t} GROUP BY 1"


@register("f1_protocol_distribution", over("p", _DIST.format(c=NORM_P, t="p")))
def _(spark, d):
    return protocols.protocol_distribution(P(spark, d))


@register("f2_transport_distribution", over("p", _DIST.format(c=NORM.format(c="transport_layer"), t="p")))
def _(spark, d):
    return protocols.transport_distribution(P(spark, d))


@register("f2_transport_from_protocol", over("p", f"SELECT {NORM_P} AS category, count(*) AS packets FROM p WHERE {NORM_P} IN ('TCP', 'UDP', 'ICMP', 'ARP') GROUP BY 1"))
def _(spark, d):
    return protocols.transport_distribution(P(spark, d).drop("transport_layer"))


@register("f3_application_distribution", over("p", _DIST.format(c="coalesce(app_layer_hint, 'OTHER')", t="p")))
def _(spark, d):
    return protocols.application_distribution(P(spark, d))


_PORT_CASE = "CASE dst_port " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in ports.PORT_PROTOCOLS.items()) + " ELSE 'OTHER' END"


@register("f3_application_by_port", over("p", _DIST.format(c=_PORT_CASE, t="p")))
def _(spark, d):
    return protocols.application_distribution(P(spark, d).drop("app_layer_hint"))


_F4 = f"""WITH g AS (SELECT {NORM_P} AS protocol, count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS byte_count, avg(packet_length) AS mean_size FROM p GROUP BY 1)"""


@register("f4_protocol_report", over("p", f"""{_F4} SELECT protocol, packet_count, byte_count,
    round(packet_count::DOUBLE / (SELECT sum(packet_count) FROM g)::DOUBLE * 100, 2) AS percentage, round(byte_count::DOUBLE / (SELECT sum(byte_count) FROM g)::DOUBLE * 100, 2) AS byte_percentage,
    round(mean_size, 2) AS avg_packet_size, CAST(row_number() OVER (ORDER BY packet_count DESC, protocol) AS INT) AS rank FROM g"""))
def _(spark, d):
    return protocols.protocol_report(P(spark, d))


_SHARE_SQL = ", ".join(
    f"round(sum(CASE WHEN protocol IN ({', '.join(repr(n) for n in names)}) THEN packet_count ELSE 0 END)::DOUBLE / sum(packet_count)::DOUBLE * 100, 2) AS {col}"
    for col, names in protocols.NAMED_SHARES.items())


@register("f4_named_shares", over("p", f"{_F4} SELECT CAST(sum(packet_count) AS BIGINT) AS total_packets, count(*) AS total_protocols, {_SHARE_SQL} FROM g"))
def _(spark, d):
    return protocols.protocol_shares(P(spark, d))


@register("f5_distribution_chart", over("p", _DIST.format(c=_PORT_CASE, t="p") + " ORDER BY 2 DESC, 1 LIMIT 3"))
def _(spark, d):
    return protocols.distribution_chart(P(spark, d).drop("app_layer_hint"), "application_layer", 3)


@register("f6_protocol_profile", over("p", """SELECT protocol, count(*) AS packet_count, CAST(sum(packet_length) AS BIGINT) AS byte_count,
    round(count(*)::DOUBLE / (SELECT count(*) FROM p) * 100, 2) AS percentage, round(avg(packet_length), 2) AS avg_packet_size,
    count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_port) AS unique_dst_ports FROM p GROUP BY 1"""))
def _(spark, d):
    return protocols.protocol_profile(P(spark, d))


@register("f7_protocol_baseline", over("p", "SELECT protocol, round(count(*)::DOUBLE / (SELECT count(*) FROM p) * 100, 2) AS percentage FROM p GROUP BY 1"))
def _(spark, d):
    return protocols.protocol_baseline(P(spark, d))


@register("f8_protocol_drift", over("p", """WITH mid AS (SELECT min(epoch_us(timestamp)) + (max(epoch_us(timestamp)) - min(epoch_us(timestamp))) // 2 AS t FROM p),
    cur AS (SELECT p.* FROM p, mid WHERE epoch_us(timestamp) > t), base AS (SELECT p.* FROM p, mid WHERE epoch_us(timestamp) <= t),
    c AS (SELECT protocol, round(count(*)::DOUBLE / (SELECT count(*) FROM cur) * 100, 2) AS percentage FROM cur GROUP BY 1),
    e AS (SELECT protocol, round(count(*)::DOUBLE / (SELECT count(*) FROM base) * 100, 2) AS percentage FROM base GROUP BY 1)
    SELECT c.protocol, c.percentage, coalesce(e.percentage, 0.0)::DOUBLE AS baseline_pct, round(abs(c.percentage - coalesce(e.percentage, 0)), 2) AS delta_pct,
    printf('share moved from %.1f%% to %.1f%%', coalesce(e.percentage, 0)::DOUBLE, c.percentage) AS reason
    FROM c LEFT JOIN e ON c.protocol = e.protocol WHERE abs(c.percentage - coalesce(e.percentage, 0)) > 0.001"""))
def _(spark, d):
    packets = P(spark, d).withColumn("_t", F.unix_micros("timestamp"))
    middle = packets.agg((F.min("_t") + F.expr("(max(_t) - min(_t)) div 2")).alias("_middle"))
    halves = packets.crossJoin(F.broadcast(middle))
    return protocols.protocol_drift(halves.filter("_t > _middle"), protocols.protocol_baseline(halves.filter("_t <= _middle")), points=0.001)
