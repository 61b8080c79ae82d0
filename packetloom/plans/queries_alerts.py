"""Queries over alert management, sessions, retention and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import alerts as al
from packetloom.operators import health, sessions
from packetloom.operators.detect.run import DETECTORS
from packetloom.operators.profile import network_profile
from packetloom.operators.selection import top_rows
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_basic import _DUR, _TALK_SQL
from packetloom.plans.queries_score import _SCORE, _STATUS, components_sql, FRAMES
from packetloom.sources import fixtures

RANK = "CASE {c} WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 ELSE 0 END"
FAMILY = "CASE WHEN attack_type LIKE 'DDoS%' THEN 'DDoS' WHEN attack_type LIKE 'PortScan%' THEN 'PortScan' WHEN attack_type LIKE 'BruteForce%' THEN 'BruteForce' WHEN attack_type LIKE 'SYNFlood%' THEN 'SYNFlood' ELSE 'Other' END"
LEVEL = "CASE WHEN upper(severity) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(severity) ELSE 'LOW' END"


def A(spark, d):
    return fixtures.alerts(spark, d)


def P(spark, d):
    return fixtures.packets(spark, d)


def _cooldown_sql(seconds: int) -> str:
    return over("a", f"""WITH RECURSIVE u AS (SELECT source_ip, attack_type, epoch_us(timestamp) AS t, min(alert_id) AS alert_id FROM a GROUP BY 1, 2, 3),
    k AS (SELECT source_ip, attack_type, min(t) AS t FROM u GROUP BY 1, 2
      UNION ALL SELECT k.source_ip, k.attack_type, (SELECT min(u.t) FROM u WHERE u.source_ip = k.source_ip AND u.attack_type = k.attack_type AND u.t >= k.t + {seconds * 1_000_000}) AS t
      FROM k WHERE k.t IS NOT NULL)
    SELECT u.alert_id, u.source_ip, u.attack_type, make_timestamp(u.t) AS timestamp FROM u JOIN k ON u.source_ip = k.source_ip AND u.attack_type = k.attack_type AND u.t = k.t""") \
        .replace("WITH a AS", "WITH RECURSIVE a AS", 1).replace("), RECURSIVE u AS", "), u AS", 1)


for _name, _seconds, _limit in (("k2_cooldown_6h", 21_600, 1_000), ("k2_cooldown_5min", 300, 1_000), ("k2_cooldown_busy_keys", 3_600, 50)):
    @register(_name, _cooldown_sql(_seconds))
    def _(spark, d, seconds=_seconds, limit=_limit):
        return al.cooldown(A(spark, d), seconds, light_limit=limit).select("alert_id", "source_ip", "attack_type", "timestamp")


@register("k2_cooldown_off", over("a", "SELECT alert_id FROM a"))
def _(spark, d):
    return al.cooldown(A(spark, d), 0).select("alert_id")


@register("k3_highest_severity", over("a", f"SELECT coalesce(arg_max(severity, {RANK.format(c='severity')}), 'NONE') AS highest_severity FROM a"))
def _(spark, d):
    return al.highest_severity(A(spark, d))


_LISTED = ", ".join(f"('{n}', {p})" for n, p, _ in DETECTORS)


@register("k4_detector_yield", over("a", f"""WITH d(detector_name, priority) AS (VALUES {_LISTED}, ('Idle Detector', 99))
    SELECT d.detector_name, d.priority, d.priority <> 99 AS enabled, count(a.alert_id) AS alert_count FROM d LEFT JOIN a ON a.detector_name = d.detector_name GROUP BY 1, 2"""))
def _(spark, d):
    return al.detector_yield(A(spark, d), [(n, p, True) for n, p, _ in DETECTORS] + [("Idle Detector", 99, False)])


@register("k5_alerts_by_type", over("a", "SELECT alert_id, attack_type FROM a WHERE attack_type LIKE 'BruteForce%'"))
def _(spark, d):
    return al.by_type(A(spark, d), "BruteForce").select("alert_id", "attack_type")


@register("k6_alerts_by_severity", over("a", "SELECT alert_id, severity FROM a WHERE severity IN ('HIGH', 'CRITICAL')"))
def _(spark, d):
    return al.at_or_above(A(spark, d), "high").select("alert_id", "severity")


@register("k7_attack_counts", over("a", f"""SELECT v.family, count(a.alert_id) AS alerts FROM (VALUES ('DDoS'), ('PortScan'), ('BruteForce'), ('SYNFlood'), ('Other')) v(family)
    LEFT JOIN a ON {FAMILY} = v.family GROUP BY 1"""))
def _(spark, d):
    return al.attack_counts(A(spark, d))


@register("k8_severity_distribution", over("a", f"""SELECT v.severity, count(a.alert_id) AS alerts FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(severity)
    LEFT JOIN a ON {LEVEL.replace('severity', 'a.severity')} = v.severity GROUP BY 1"""))
def _(spark, d):
    return al.severity_distribution(A(spark, d))


@register("k9_attack_timeline", over("a", """WITH c AS (SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS t, count(*) AS n FROM a GROUP BY 1),
    m AS (SELECT unnest(generate_series((SELECT min(t) FROM c), (SELECT max(t) FROM c), INTERVAL 5 MINUTE)) AS t)
    SELECT m.t AS interval_start, coalesce(n, 0) AS alerts FROM m LEFT JOIN c ON m.t = c.t"""))
def _(spark, d):
    return al.attack_timeline(A(spark, d), "5min")


@register("k10_alert_trend", over("a", "SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS interval_start, count(*) AS alerts FROM a GROUP BY 1"))
def _(spark, d):
    return al.alert_trend(A(spark, d))


@register("k11_alert_table", over("a", """SELECT concat(substr(alert_id, 1, 8), '…') AS short_id, timestamp, attack_type, severity, printf('%.0f%%', confidence * 100) AS confidence,
    source_ip, destination_ip, detector_name, substr(coalesce(description, ''), 1, 120) AS description FROM a"""))
def _(spark, d):
    return al.alert_table(A(spark, d))


def _top_sql(c: str, name: str) -> str:
    return (f"(SELECT string_agg(concat(ip, '=', n), ',' ORDER BY n DESC, ip) FROM (SELECT {c} AS ip, count(*) AS n FROM a WHERE {c} NOT IN ('MULTIPLE', 'UNKNOWN', '') "
            f"GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) AS {name}")


@register("k12_alert_summary", over("a", f"""SELECT count(*) AS total_alerts,
    {', '.join(f"count(*) FILTER (WHERE {FAMILY} = '{f}') AS family_{f.lower()}" for f in ('DDoS', 'PortScan', 'BruteForce', 'SYNFlood', 'Other'))},
    {', '.join(f"count(*) FILTER (WHERE {LEVEL} = '{s}') AS severity_{s.lower()}" for s in ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))},
    arg_max(severity, {RANK.format(c='severity')}) AS highest_severity, round(avg(confidence), 3) AS avg_confidence, {_top_sql('source_ip', 'top_sources')}, {_top_sql('destination_ip', 'top_targets')},
    (SELECT string_agg(concat(detector_name, '=', n), ',' ORDER BY detector_name) FROM (SELECT detector_name, count(*) AS n FROM a GROUP BY 1)) AS detector_counts FROM a"""))
def _(spark, d):
    def text(column, *fields):
        return F.array_join(F.transform(F.col(column), lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), ",")
    return al.alert_summary(A(spark, d)).withColumns({
        "top_sources": text("top_sources", "ip", "alerts"), "top_targets": text("top_targets", "ip", "alerts"),
        "detector_counts": text("detector_counts", "detector_name", "alerts")})


@register("k13_alert_retention", over("a", "SELECT alert_id, seq FROM a ORDER BY seq DESC LIMIT 2500"))
def _(spark, d):
    return al.keep_latest(A(spark, d), 2500).select("alert_id", "seq")


@register("k14_threat_level", over("a", f"""SELECT source_ip, CASE max({RANK.format(c='upper(severity)')}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' ELSE 'LOW' END AS threat_level
    FROM a GROUP BY 1"""))
def _(spark, d):
    return al.threat_level(A(spark, d), "source_ip")


@register("k15_acknowledge_state", over("a", """WITH e AS (SELECT alert_id, timestamp + INTERVAL 2 HOUR AS t FROM a WHERE severity = 'HIGH' UNION ALL SELECT alert_id, timestamp + INTERVAL 1 HOUR FROM a WHERE attack_type LIKE 'DDoS%')
    SELECT a.alert_id, min(e.t) IS NOT NULL AS is_acknowledged, min(e.t) AS acknowledged_at FROM a LEFT JOIN e ON e.alert_id = a.alert_id GROUP BY 1"""))
def _(spark, d):
    alerts = A(spark, d)
    late = alerts.filter("severity = 'HIGH'").select("alert_id", F.expr("timestamp + INTERVAL 2 HOUR").alias("ack_time"))
    early = alerts.filter("attack_type LIKE 'DDoS%'").select("alert_id", F.expr("timestamp + INTERVAL 1 HOUR").alias("ack_time"))
    return al.acknowledge_state(alerts, late.unionByName(early)).select("alert_id", "is_acknowledged", "acknowledged_at")


# ---- sessions, retention, reports ---------------------------------------------------

@register("l1_session_totals", over("p a", """WITH c AS (SELECT session_id, count(*) AS n FROM a GROUP BY 1) SELECT p.session_id, count(*) AS total_packets, CAST(sum(packet_length) AS BIGINT) AS total_bytes,
    any_value(coalesce(c.n, 0)) AS total_alerts, min(timestamp) AS start_time, max(timestamp) AS end_time FROM p LEFT JOIN c ON c.session_id = p.session_id GROUP BY 1"""))
def _(spark, d):
    return sessions.session_totals(P(spark, d), A(spark, d))


@register("l2_retention", over("b", "SELECT packet_number, timestamp FROM b ORDER BY timestamp DESC, packet_number DESC LIMIT 3333"))
def _(spark, d):
    rows = fixtures.packets(spark, d, "burst").withColumn("t", F.unix_micros("timestamp"))
    return top_rows(rows, ["t", "packet_number"], 3333).select("packet_number", "timestamp")


@register("l3_traffic_export", over("p", f"""WITH {_TALK_SQL.format(t='p')}, z AS (SELECT count(*)::DOUBLE AS total_packets, sum(packet_length)::DOUBLE AS total_bytes, round({_DUR}, 4)::DOUBLE AS capture_duration_seconds,
    round(count(*) / ({_DUR}), 4)::DOUBLE AS packets_per_second, round(sum(packet_length) / ({_DUR}), 4)::DOUBLE AS bytes_per_second,
    (SELECT count(*) FROM t WHERE side = 'src')::DOUBLE AS unique_src_ips, (SELECT count(*) FROM t WHERE side = 'dst')::DOUBLE AS unique_dst_ips FROM p)
    SELECT * FROM (UNPIVOT z ON COLUMNS(*) INTO NAME metric VALUE value) UNION ALL SELECT concat('top_', side, '_ip:', ip), packets::DOUBLE FROM k WHERE rank <= 10"""))
def _(spark, d):
    return sessions.traffic_export(P(spark, d))


@register("l4_executive_summary", over("p a", f"""WITH {FRAMES.format(t='p')}, {components_sql()}, {_SCORE}, c AS (SELECT count(*) AS total_alerts, count(*) FILTER (WHERE upper(severity) = 'CRITICAL') AS critical_alerts,
    count(*) FILTER (WHERE upper(severity) = 'HIGH') AS high_alerts, count(*) FILTER (WHERE upper(severity) = 'MEDIUM') AS medium_alerts, count(*) FILTER (WHERE upper(severity) = 'LOW') AS low_alerts FROM a)
    SELECT c.*, CASE WHEN critical_alerts > 0 THEN 'CRITICAL' WHEN high_alerts > 0 THEN 'HIGH' WHEN total_alerts > 0 THEN 'MEDIUM' ELSE 'LOW' END AS overall_threat_level,
    total_packets, CAST(total_bytes AS BIGINT) AS total_bytes, round(dur, 4) AS capture_duration_s, unique_src_ips, unique_dst_ips, round(raw, 2) AS health_score, {_STATUS} AS health_status FROM c, mt, sc"""))
def _(spark, d):
    packets = P(spark, d)
    profile = network_profile(packets)
    return sessions.executive_summary(packets, A(spark, d), health.health_report(profile.metrics, profile.per_second))
