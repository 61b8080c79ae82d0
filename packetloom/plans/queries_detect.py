"""Queries over the detectors and the combined run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.ports import SERVICES
from packetloom.operators.detect import bruteforce, ddos, portscan, run, synflood
from packetloom.operators.detect.common import Thresholds
from packetloom.plans.catalogue import over, register
from packetloom.sources import fixtures

SHOWN = ["attack_type", "severity", "confidence", "source_ip", "destination_ip", "timestamp", "dst_port", "detector_name"]


def P(spark, d):
    return fixtures.packets(spark, d)


def B(spark, d):
    return fixtures.packets(spark, d, "burst")


def shown(alerts: DataFrame, kind: str | None = None) -> DataFrame:
    rows = alerts if kind is None else alerts.filter(F.col("attack_type").startswith(kind))
    return rows.select(*SHOWN)


# The flag texts of the views, spelled out.
SYN_SQL, ACK_SQL = "tcp_flags IN ('0x2', '0x12')", "tcp_flags IN ('0x12', '0x10', '0x18')"


def ddos_sql(table: str) -> str:
    return f"""dt AS (SELECT dst_ip, count(*) AS n FROM {table} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    w AS (SELECT count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
      (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration_seconds, max(timestamp) AS last_seen,
      count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips,
      (SELECT dst_ip FROM dt) AS top_dst_ip, (SELECT n FROM dt) AS top_dst_count, round((SELECT n FROM dt)::DOUBLE / count(*), 4) AS top_dst_fraction,
      count(*) FILTER (WHERE upper(protocol) = 'TCP') AS tcp_count, count(*) FILTER (WHERE upper(protocol) = 'UDP') AS udp_count,
      count(*) FILTER (WHERE upper(protocol) LIKE 'ICMP%') AS icmp_count,
      count(*) FILTER (WHERE {SYN_SQL}) AS syn_count, count(*) FILTER (WHERE {ACK_SQL}) AS ack_count,
      count(*) FILTER (WHERE timestamp <= (SELECT quantile_disc(timestamp, 0.5) FROM {table})) AS fh,
      count(*) FILTER (WHERE epoch_us(timestamp) <= (SELECT (epoch_us(min(timestamp)) + epoch_us(max(timestamp)))::DOUBLE / 2 FROM {table})) AS mid_first
      FROM {table}),
    v AS (SELECT *, total_packets / duration_seconds AS pps, total_bytes / duration_seconds AS bps,
      round((total_packets - 2 * fh)::DOUBLE / fh, 4) AS growth_rate, round((total_packets - 2 * mid_first)::DOUBLE / mid_first, 4) AS mid_growth FROM w)"""


def grade_sql(x: str, c: float, h: float, m: float) -> str:
    return f"CASE WHEN {x} >= {c} THEN 'CRITICAL' WHEN {x} >= {h} THEN 'HIGH' WHEN {x} >= {m} THEN 'MEDIUM' ELSE 'LOW' END"


def alert_sql(kind: str, severity: str, confidence: str, source: str, target: str, detector: str, port: str = "NULL", time: str = "last_seen") -> str:
    return (f"SELECT {kind} AS attack_type, {severity} AS severity, round(({confidence})::DOUBLE, 3) AS confidence, {source} AS source_ip, "
            f"{target} AS destination_ip, {time} AS timestamp, CAST({port} AS INT) AS dst_port, '{detector}' AS detector_name")


# ---- floods -------------------------------------------------------------------------

@register("j1_ddos_window", over("b", f"""WITH {ddos_sql('b')} SELECT total_packets, total_bytes, round(duration_seconds, 4) AS duration_seconds,
    round(pps, 4) AS packets_per_second, round(bps, 4) AS bytes_per_second, growth_rate, unique_src_ips, unique_dst_ips, top_dst_ip, top_dst_count,
    top_dst_fraction, tcp_count, udp_count, icmp_count, syn_count, ack_count FROM v"""))
def _(spark, d):
    packets = B(spark, d)
    w = ddos.window_profile(packets).crossJoin(ddos.growth_rate(packets))
    return w.select("total_packets", "total_bytes", F.round("duration_seconds", 4).alias("duration_seconds"),
                    F.round("packets_per_second", 4).alias("packets_per_second"), F.round("bytes_per_second", 4).alias("bytes_per_second"),
                    "growth_rate", "unique_src_ips", "unique_dst_ips", "top_dst_ip", "top_dst_count", "top_dst_fraction",
                    "tcp_count", "udp_count", "icmp_count", "syn_count", "ack_count")


_MULTI = "CASE WHEN unique_src_ips > 1 THEN 'MULTIPLE' ELSE 'x' END"
_BONUS = "CASE WHEN unique_src_ips > 10 THEN least(0.99, {x} + 0.05) ELSE {x} END"


def _pps_sql(limit: int) -> str:
    ratio = f"(round(pps, 2) / {limit})"
    return alert_sql("'DDoS-VolumeFlood'", grade_sql(f"pps / {limit}", 5, 2, 1.5),
                     _BONUS.format(x=f"least(0.95, 0.5 + 0.3 * least({ratio} - 1, 2) / 2)"), _MULTI, "top_dst_ip", ddos.NAME) + f" FROM v WHERE pps > {limit}"


def _bps_sql(limit: int) -> str:
    return alert_sql("'DDoS-BandwidthFlood'", grade_sql(f"bps / {limit}", 5, 2, 1.5),
                     f"least(0.95, 0.5 + 0.3 * least(round(bps, 2) / {limit} - 1, 2) / 2)", _MULTI, "top_dst_ip", ddos.NAME) + f" FROM v WHERE bps > {limit}"


@register("j2_ddos_packet_flood", over("b", f"WITH {ddos_sql('b')} {_pps_sql(1000)}"))
def _(spark, d):
    return shown(ddos.detect(B(spark, d)), "DDoS-VolumeFlood")


@register("j3_ddos_bandwidth_flood", over("b", f"WITH {ddos_sql('b')} {_bps_sql(500000)}"))
def _(spark, d):
    return shown(ddos.detect(B(spark, d), Thresholds(ddos_bytes_per_second=500_000)), "DDoS-BandwidthFlood")


_TO_ONE = "CASE WHEN src_port % 5 <> 0 THEN '10.0.0.1' ELSE dst_ip END"


@register("j4_ddos_distributed", over("b", f"""WITH x AS (SELECT * REPLACE ({_TO_ONE} AS dst_ip) FROM b), {ddos_sql('x')}
    {alert_sql("'DDoS-Distributed'", "'HIGH'", _BONUS.format(x="least(0.98, 0.6 + 0.15 * least(unique_src_ips / 50.0, 3) + 0.15 * round(top_dst_fraction, 3))"), "'MULTIPLE'", "top_dst_ip", ddos.NAME)}
    FROM v WHERE unique_src_ips >= 50 AND top_dst_fraction >= 0.7"""))
def _(spark, d):
    return shown(ddos.detect(B(spark, d).withColumn("dst_ip", F.expr(_TO_ONE))), "DDoS-Distributed")


_RISING = "CAST(round(pow(CAST(packet_number AS double), 0.3333) * 200) AS bigint)"


@register("j5_ddos_rapid_growth", over("b", f"""WITH x AS (SELECT * REPLACE (epoch_ms(1704067200000 + {_RISING}) AS timestamp) FROM b), {ddos_sql('x')}
    {alert_sql("'DDoS-RapidGrowth'", "'MEDIUM'", _BONUS.format(x="least(0.9, 0.55 + 0.1 * least(round(mid_growth, 3), 5))"), _MULTI, "top_dst_ip", ddos.NAME)}
    FROM v WHERE mid_growth > 2 AND pps > 500"""))
def _(spark, d):
    rows = B(spark, d).withColumn("timestamp", F.expr(f"timestamp_millis(1704067200000 + {_RISING})"))
    return shown(ddos.detect(rows, Thresholds(ddos_growth="midpoint")), "DDoS-RapidGrowth")


_MOSTLY_UDP = "CASE WHEN src_port % 10 < 8 THEN 'UDP' ELSE protocol END"


@register("j6_ddos_protocol_flood", over("b", f"""WITH x AS (SELECT * REPLACE ({_MOSTLY_UDP} AS protocol) FROM b), {ddos_sql('x')}
    {alert_sql("CASE WHEN udp_count >= icmp_count THEN 'DDoS-UDPFlood' ELSE 'DDoS-ICMPFlood' END", "'HIGH'",
               "least(0.92, 0.55 + 0.35 * round(greatest(udp_count, icmp_count)::DOUBLE / total_packets, 3))", _MULTI, "top_dst_ip", ddos.NAME)}
    FROM v WHERE greatest(udp_count, icmp_count)::DOUBLE / total_packets >= 0.75 AND pps >= 300"""))
def _(spark, d):
    return shown(ddos.detect(B(spark, d).withColumn("protocol", F.expr(_MOSTLY_UDP))), "DDoS-UDPFlood")


@register("j7_ddos_alerts", over("b", f"WITH {ddos_sql('b')} {_pps_sql(300)} UNION ALL {_bps_sql(100000)}"))
def _(spark, d):
    return shown(ddos.detect(B(spark, d), Thresholds(ddos_packets_per_second=300, ddos_bytes_per_second=100_000)))


def syn_sql(table: str) -> str:
    return f"""st AS (SELECT dst_ip, count(*) AS n FROM {table} WHERE protocol = 'TCP' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
    sw AS (SELECT count(*) AS total_packets, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration_seconds, max(timestamp) AS last_seen,
      count(*) FILTER (WHERE protocol = 'TCP') AS total_tcp_packets, count(DISTINCT src_ip) FILTER (WHERE protocol = 'TCP') AS unique_src_ips,
      count(*) FILTER (WHERE protocol = 'TCP' AND {SYN_SQL}) AS syn_count, count(*) FILTER (WHERE protocol = 'TCP' AND {ACK_SQL}) AS ack_count,
      count(*) FILTER (WHERE protocol = 'TCP' AND tcp_flags = '0x12') AS syn_ack_count, CAST(0 AS BIGINT) AS rst_count, CAST(0 AS BIGINT) AS fin_count,
      (SELECT dst_ip FROM st) AS top_dst_ip, (SELECT n FROM st) AS top_dst_count FROM {table}),
    s AS (SELECT *, syn_count / duration_seconds AS sps, ack_count / duration_seconds AS aps, syn_count::DOUBLE / (syn_count + ack_count) AS ratio,
      syn_count::DOUBLE / total_tcp_packets AS share, greatest(0, syn_count - ack_count) AS half_open FROM sw)"""


@register("j8_syn_window", over("b", f"""WITH {syn_sql('b')} SELECT total_packets, total_tcp_packets, syn_count, ack_count, syn_ack_count, rst_count, fin_count,
    unique_src_ips, top_dst_ip, top_dst_count, round(sps, 4) AS syn_per_second, round(aps, 4) AS ack_per_second, round(ratio, 4) AS syn_ack_ratio,
    round(share, 4) AS syn_fraction_of_tcp, half_open AS half_open_estimate, round(top_dst_count::DOUBLE / total_tcp_packets, 4) AS top_dst_fraction FROM s"""))
def _(spark, d):
    w = synflood.window_profile(B(spark, d))
    rounded = {n: F.round(n, 4) for n in ("syn_per_second", "ack_per_second", "syn_ack_ratio", "syn_fraction_of_tcp")}
    return w.withColumns(rounded).drop("first_seen", "last_seen", "first_packet", "duration_seconds")


_SRC_SYN = "CASE WHEN unique_src_ips > 1 THEN 'MULTIPLE' ELSE '' END"


def _syn_rule(kind: str, grade: str, confidence: str, where: str) -> str:
    return alert_sql(f"'SYNFlood-{kind}'", grade_sql(grade, 3, 2, 1.3), confidence, _SRC_SYN, "top_dst_ip", synflood.NAME) + f" FROM s WHERE {where}"


def _dominance(t: float) -> str:
    return _syn_rule("Dominance", f"share / {t}", f"least(0.97, 0.55 + 0.35 * (greatest(0, round(share, 3) - {t}) / (1 - {t}::DOUBLE + 1e-9)))", f"share >= {t}")


def _low_ack(t: float) -> str:
    base = f"least(0.98, 0.6 + 0.35 * (greatest(0, round(ratio, 3) - {t}) / (1 - {t}::DOUBLE + 1e-9)))"
    return _syn_rule("LowACK", f"ratio / {t}", f"CASE WHEN half_open > 100 THEN least(0.99, {base} + 0.04) ELSE {base} END", f"ratio >= {t} AND syn_count >= 10")


def _high_rate(t: float) -> str:
    return _syn_rule("HighRate", f"sps / {t}", f"least(0.97, 0.55 + 0.3 * least(round(sps, 2) / {t} - 1, 4) / 4)", f"sps >= {t}")


def _half_open(t: int) -> str:
    return _syn_rule("HalfOpen", f"half_open / {t}.0", f"least(0.95, 0.6 + 0.25 * least(half_open / {t}.0 - 1, 4) / 4)", f"half_open >= {t} AND ratio >= 0.6")


_ALL_SYN = "CASE WHEN protocol = 'TCP' THEN '0x2' ELSE tcp_flags END"
_X = f"x AS (SELECT * REPLACE ({_ALL_SYN} AS tcp_flags) FROM b)"


def _all_syn(spark, d):
    return B(spark, d).withColumn("tcp_flags", F.expr(_ALL_SYN))


@register("j9_syn_dominance", over("b", f"WITH {syn_sql('b')} {_dominance(0.5)}"))
def _(spark, d):
    return shown(synflood.detect(B(spark, d), Thresholds(synflood_syn_dominance=0.5)), "SYNFlood-Dominance")


@register("j10_syn_low_ack", over("b", f"WITH {_X}, {syn_sql('x')} {_low_ack(0.85)}"))
def _(spark, d):
    return shown(synflood.detect(_all_syn(spark, d)), "SYNFlood-LowACK")


@register("j11_syn_high_rate", over("b", f"WITH {syn_sql('b')} {_high_rate(100.0)}"))
def _(spark, d):
    return shown(synflood.detect(B(spark, d), Thresholds(synflood_syn_per_second=100.0)), "SYNFlood-HighRate")


@register("j12_syn_half_open", over("b", f"WITH {_X}, {syn_sql('x')} {_half_open(100)}"))
def _(spark, d):
    return shown(synflood.detect(_all_syn(spark, d)), "SYNFlood-HalfOpen")


@register("j13_syn_alerts", over("b", f"""WITH {_X}, {syn_sql('x')} {_dominance(0.7)} UNION ALL {_low_ack(0.85)}
    UNION ALL {_high_rate(200.0)} UNION ALL {_half_open(1000)}"""))
def _(spark, d):
    return shown(synflood.detect(_all_syn(spark, d), Thresholds(synflood_syn_per_second=200.0, synflood_half_open_limit=1000)))


# ---- scans --------------------------------------------------------------------------------

def scan_sql(table: str) -> str:
    return f"""ps AS (SELECT DISTINCT src_ip, dst_port FROM {table}), gp AS (SELECT src_ip, dst_port - lag(dst_port) OVER (PARTITION BY src_ip ORDER BY dst_port) AS gap FROM ps),
    gv AS (SELECT src_ip, count(*) AS np, var_pop(gap) AS gap_var FROM gp GROUP BY 1),
    sp AS (SELECT src_ip, count(*) AS total_packets, count(DISTINCT dst_port) AS unique_ports, count(DISTINCT dst_ip) AS unique_hosts, min(dst_ip) AS primary_target,
      avg(packet_length) AS avg_packet_size, min(timestamp) AS first_seen, max(timestamp) AS last_seen, min(packet_number) AS first_packet,
      (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration_seconds,
      count(*) FILTER (WHERE {SYN_SQL}) AS syn_count, count(*) FILTER (WHERE {ACK_SQL}) AS ack_count, CAST(0 AS BIGINT) AS rst_count, CAST(0 AS BIGINT) AS fin_count
      FROM {table} GROUP BY 1),
    sc AS (SELECT sp.*, CASE WHEN unique_ports < 3 THEN 'HORIZONTAL' WHEN gap_var < 100 THEN 'SEQUENTIAL' ELSE 'RANDOM' END AS scan_pattern,
      syn_count::DOUBLE / greatest(syn_count + ack_count, 1) AS ratio FROM sp JOIN gv ON sp.src_ip = gv.src_ip)"""


@register("j14_scan_profile", over("p", f"""WITH {scan_sql('p')} SELECT src_ip, total_packets, unique_ports, unique_hosts, primary_target,
    round(avg_packet_size, 4) AS avg_packet_size, first_seen, last_seen, duration_seconds, round(CASE WHEN duration_seconds > 0 THEN unique_ports / duration_seconds ELSE 0 END, 6) AS ports_per_second,
    syn_count, ack_count, rst_count, fin_count FROM sc"""))
def _(spark, d):
    return portscan.source_profile(P(spark, d)).select(
        "src_ip", "total_packets", "unique_ports", "unique_hosts", "primary_target", F.round("avg_packet_size", 4).alias("avg_packet_size"),
        "first_seen", "last_seen", "duration_seconds", F.round("ports_per_second", 6).alias("ports_per_second"),
        "syn_count", "ack_count", "rst_count", "fin_count")


_SCAN_BASE = "least(0.97, 0.55 + 0.25 * least(unique_ports / 20.0 - 1, 4) / 4)"
_SCAN_CONF = f"CASE WHEN round(avg_packet_size, 1) < 80 THEN least(0.99, {_SCAN_BASE} + 0.05) ELSE {_SCAN_BASE} END"
_HORIZONTAL = alert_sql("'PortScan-Horizontal'", grade_sql("unique_ports / 20.0", 5, 3, 1.5), _SCAN_CONF, "src_ip", "primary_target", portscan.NAME) + \
    " FROM sc WHERE total_packets >= 3 AND unique_ports >= 20"
_VERTICAL = alert_sql("'PortScan-Vertical'", grade_sql("unique_hosts / 20.0", 5, 3, 1.5), "least(0.95, 0.55 + 0.25 * least(unique_hosts / 20.0 - 1, 4) / 4)",
                      "src_ip", "'MULTIPLE'", portscan.NAME) + " FROM sc WHERE total_packets >= 3 AND unique_ports < 20 AND unique_hosts >= 20 AND unique_ports <= 5"
_STEALTH = alert_sql("'PortScan-SYNStealth'", "'HIGH'", "least(0.98, 0.65 + 0.3 * (greatest(0, round(ratio, 3) - 0.85) / (1 - 0.85::DOUBLE + 1e-9)))",
                     "src_ip", "primary_target", portscan.NAME) + " FROM sc WHERE total_packets >= 3 AND syn_count + ack_count >= 5 AND ratio >= 0.85 AND unique_ports >= 5"


@register("j15_port_scan", over("p", f"WITH {scan_sql('p')} {_HORIZONTAL}"))
def _(spark, d):
    return shown(portscan.detect(P(spark, d)), "PortScan-Horizontal")


@register("j15_sampled_ports", over("p", f"""WITH {scan_sql('p')} SELECT sc.src_ip AS source_ip,
    (SELECT string_agg(dst_port, ',' ORDER BY dst_port) FROM (SELECT dst_port FROM ps WHERE ps.src_ip = sc.src_ip ORDER BY dst_port LIMIT 20)) AS sampled_ports
    FROM sc WHERE total_packets >= 3 AND unique_ports >= 20"""))
def _(spark, d):
    return portscan.detect(P(spark, d)).filter("attack_type = 'PortScan-Horizontal'").select("source_ip", F.col("evidence")["sampled_ports"].alias("sampled_ports"))


@register("j16_host_sweep", over("p", f"WITH {scan_sql('p')} {_VERTICAL}"))
def _(spark, d):
    return shown(portscan.detect(P(spark, d)), "PortScan-Vertical")


@register("j17_syn_stealth", over("p", f"WITH {scan_sql('p')} {_STEALTH}"))
def _(spark, d):
    return shown(portscan.detect(P(spark, d)), "PortScan-SYNStealth")


@register("j18_scan_pattern", over("p", f"WITH {scan_sql('p')} SELECT src_ip, scan_pattern FROM sc"))
def _(spark, d):
    return portscan.source_profile(P(spark, d)).select("src_ip", "scan_pattern")


@register("j19_scan_alerts", over("p", f"WITH {scan_sql('p')} {_HORIZONTAL} UNION ALL {_VERTICAL} UNION ALL {_STEALTH}"))
def _(spark, d):
    return shown(portscan.detect(P(spark, d)))


# ---- login guessing --------------------------------------------------------------------------

_AUTH = "dst_port IN (21, 22, 23, 25, 80, 110, 143, 389, 443, 445, 465, 587, 993, 995, 3306, 3389, 5432, 5900, 6379, 8080, 8443)"
_SERVICE = "CASE dst_port " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SERVICES.items()) + " ELSE 'unknown' END"


def brute_sql(table: str) -> str:
    return f"""bf AS (SELECT src_ip, dst_ip, dst_port, {_SERVICE} AS service, count(*) AS attempts, avg(packet_length) AS avg_packet_size, min(timestamp) AS first_seen,
      max(timestamp) AS last_seen, min(packet_number) AS first_packet, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS duration_seconds,
      count(*) FILTER (WHERE {SYN_SQL}) AS syn_count, count(*) FILTER (WHERE {ACK_SQL}) AS ack_count FROM {table} WHERE {_AUTH} GROUP BY 1, 2, 3, 4),
    br AS (SELECT *, CASE WHEN duration_seconds > 0 THEN attempts / duration_seconds ELSE 0 END AS rate FROM bf)"""


@register("j20_auth_traffic", over("p", f"SELECT packet_number, dst_port FROM p WHERE {_AUTH}"))
def _(spark, d):
    return bruteforce.auth_traffic(P(spark, d)).select("packet_number", "dst_port")


@register("j21_service_profile", over("p", f"""WITH {brute_sql('p')} SELECT src_ip, dst_ip, dst_port, attempts, round(avg_packet_size, 4) AS avg_packet_size, first_seen, last_seen,
    duration_seconds, round(rate, 6) AS attempts_per_second, syn_count, ack_count, service FROM br"""))
def _(spark, d):
    rows = bruteforce.service_profile(bruteforce.auth_traffic(P(spark, d)))
    return rows.withColumns({"avg_packet_size": F.round("avg_packet_size", 4), "attempts_per_second": F.round("attempts_per_second", 6)}).drop("first_packet")


def _service_rule(need: int) -> str:
    base = f"least(0.97, 0.6 + 0.25 * least(attempts / {need}.0 - 1, 5) / 5)"
    fast = f"CASE WHEN round(rate, 3) >= 5 THEN least(0.99, {base} + 0.04) ELSE {base} END"
    return alert_sql("concat('BruteForce-', upper(service))", grade_sql(f"attempts / {need}.0", 10, 5, 2),
                     f"CASE WHEN round(duration_seconds, 2) >= 30 THEN least(0.99, {fast} + 0.03) ELSE {fast} END",
                     "src_ip", "dst_ip", bruteforce.NAME, "dst_port") + f" FROM br WHERE attempts >= {need}"


_SPRAY = alert_sql("'BruteForce-CredentialSpray'", "'HIGH'", "least(0.95, 0.6 + 0.25 * least(targets / 5.0 - 1, 3) / 3)", "src_ip", "'MULTIPLE'", bruteforce.NAME) + \
    " FROM (SELECT src_ip, sum(attempts) AS total, count(*) AS targets, max(last_seen) AS last_seen FROM br GROUP BY 1) WHERE total >= {need} AND targets >= 5"


def _rapid(need: int, least: int, rate: float) -> str:
    return alert_sql("'BruteForce-RapidReconnect'", "'MEDIUM'", f"least(0.94, 0.6 + 0.25 * least(round(rate, 3) / {rate} - 1, 4) / 4)", "src_ip", "dst_ip",
                     bruteforce.NAME, "dst_port") + f" FROM br WHERE attempts < {need} AND rate >= {rate} AND attempts >= {least}"


@register("j22_service_bruteforce", over("p", f"WITH {brute_sql('p')} {_service_rule(10)}"))
def _(spark, d):
    found = bruteforce.detect(P(spark, d))
    return shown(found.filter("dst_port IS NOT NULL AND attack_type <> 'BruteForce-RapidReconnect'"))


@register("j23_credential_spray", over("p", f"WITH {brute_sql('p')} {_SPRAY.format(need=10)}"))
def _(spark, d):
    return shown(bruteforce.detect(P(spark, d)), "BruteForce-CredentialSpray")


@register("j24_rapid_reconnect", over("b", f"WITH {brute_sql('b')} {_rapid(12, 5, 2.0)}"))
def _(spark, d):
    limits = Thresholds(bruteforce_failed_attempts=12, bruteforce_rapid_min_attempts=5)
    return shown(bruteforce.detect(B(spark, d), limits), "BruteForce-RapidReconnect")


@register("j25_bruteforce_alerts", over("b", f"WITH {brute_sql('b')} {_service_rule(12)} UNION ALL {_SPRAY.format(need=12)} UNION ALL {_rapid(12, 5, 2.0)}"))
def _(spark, d):
    return shown(bruteforce.detect(B(spark, d), Thresholds(bruteforce_failed_attempts=12, bruteforce_rapid_min_attempts=5)))


# ---- combined run ---------------------------------------------------------------------------------

_LOW = Thresholds(ddos_packets_per_second=300, bruteforce_failed_attempts=10, synflood_syn_per_second=100.0, synflood_syn_dominance=0.5)


def _ranked(sql: str, priority: int, first: str) -> str:
    """Add the run order columns to an alert SELECT."""
    return sql.replace("SELECT ", f"SELECT {priority} AS priority, {first} AS first_packet, ", 1)


def run_sql(table: str) -> str:
    parts = [_ranked(_pps_sql(300), 10, "0"), _ranked(_dominance(0.5), 15, "0"), _ranked(_high_rate(100.0), 15, "0"),
             _ranked(_HORIZONTAL, 20, "first_packet"), _ranked(_VERTICAL, 20, "first_packet"), _ranked(_STEALTH, 20, "first_packet"),
             _ranked(_service_rule(10), 30, "first_packet"), _ranked(_SPRAY.format(need=10), 30, "0")]
    return f"{ddos_sql(table)}, {syn_sql(table)}, {scan_sql(table)}, {brute_sql(table)}, al AS ({' UNION ALL '.join(parts)})"


@register("k1_detection_run", over("b", f"""WITH {run_sql('b')} SELECT {', '.join(SHOWN)}, priority FROM al"""))
def _(spark, d):
    return run.run_detection(B(spark, d), _LOW, dedup=False).select(*SHOWN, "priority")


@register("k2_run_cooldown", over("b", f"""WITH {run_sql('b')}, rk AS (SELECT *, row_number() OVER (PARTITION BY source_ip, attack_type
    ORDER BY priority, first_packet, destination_ip, coalesce(dst_port, -1)) AS rn FROM al) SELECT {', '.join(SHOWN)}, priority FROM rk WHERE rn = 1"""))
def _(spark, d):
    return run.run_detection(B(spark, d), _LOW).select(*SHOWN, "priority")
