"""Queries over health, quality and bottleneck operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.operators import bottlenecks as bn
from packetloom.operators import health, quality
from packetloom.operators.profile import network_profile
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_basic import NORM_P
from packetloom.sources import fixtures

# One set of SQL frames for all scores; {t} is the packet view.
FRAMES = """n AS (SELECT * REPLACE (""" + NORM_P + """ AS protocol) FROM {t}),
 sec AS (SELECT date_trunc('second', timestamp) AS s, CAST(sum(packet_length) AS BIGINT) AS bytes, count(*) AS packets FROM n GROUP BY 1),
 mi AS (SELECT date_trunc('minute', s) AS m, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(packets) AS BIGINT) AS packets FROM sec GROUP BY 1),
 pr AS (SELECT protocol, count(*) AS packet_count, sum(packet_length) AS byte_count FROM n GROUP BY 1),
 so AS (SELECT src_ip, count(*) AS packets FROM n WHERE src_ip IS NOT NULL GROUP BY 1),
 tot AS (SELECT count(*) AS total_packets, sum(packet_length) AS total_bytes, max(timestamp) AS capture_end,
   (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur, avg(packet_length) AS mean_length, round(avg(packet_length), 2) AS avg_packet_size,
   round(stddev_samp(packet_length), 2) AS std_packet_size, count(ttl) AS ttl_count, stddev_samp(ttl) AS ttl_std,
   count(DISTINCT src_ip) AS unique_src_ips, count(DISTINCT dst_ip) AS unique_dst_ips FROM n),
 mt AS (SELECT tot.*, round(total_bytes / dur, 4)::DOUBLE AS avg_bps, round(total_packets / dur, 4)::DOUBLE AS avg_pps,
   (SELECT max(bytes) FROM sec)::DOUBLE AS peak_bps, (SELECT max(packets) FROM sec)::DOUBLE AS peak_pps,
   (SELECT count(*) FROM mi) AS minute_count, coalesce((SELECT stddev_samp(bytes) / avg(bytes) FROM mi), 0) AS cv,
   (SELECT count(*) FROM pr) AS protocol_count, (SELECT -sum(packet_count::DOUBLE / total_packets * log2(packet_count::DOUBLE / total_packets)) FROM pr) AS entropy,
   round((SELECT coalesce(sum(packet_count), 0) FROM pr WHERE protocol = 'MALFORMED')::DOUBLE / total_packets * 100, 2) AS malformed_pct,
   (SELECT src_ip FROM so ORDER BY packets DESC, src_ip LIMIT 1) AS top_src_ip, (SELECT max(packets) FROM so) AS top_src_count,
   (SELECT sum(packets) FROM (SELECT packets FROM so ORDER BY packets DESC LIMIT 3)) AS top3_src_count FROM tot)"""


def _lin(x: str, a: float, b: float) -> str:
    return f"(({x} - {a}) / ({b}::DOUBLE - {a} + 1e-9))"


def _clamp(x: str) -> str:
    return f"round(least(100.0, greatest(0.0, {x}))::DOUBLE, 2)"


def _three(x: str, w: float, h: float, c: float, base: int, gain: int, high: int, worst: int) -> tuple[str, str]:
    return (_clamp(f"CASE WHEN {x} >= {c} THEN {worst} WHEN {x} >= {h} THEN {high} * (1 - {_lin(x, h, c)}) WHEN {x} >= {w} THEN {base} + {gain} * (1 - {_lin(x, w, h)}) "
                   f"ELSE 80 + 20 * (1 - {x} / ({w} + 1e-9)) END"),
            f"CASE WHEN {x} >= {c} THEN 'CRITICAL' WHEN {x} >= {h} THEN 'HIGH' WHEN {x} >= {w} THEN 'WARN' ELSE 'OK' END")


def _two(x: str, w: float, c: float) -> tuple[str, str]:
    return (_clamp(f"CASE WHEN {x} >= {c} THEN 10 WHEN {x} >= {w} THEN 40 * (1 - {_lin(x, w, c)}) ELSE 80 + 20 * (1 - {x} / ({w} + 1e-9)) END"),
            f"CASE WHEN {x} >= {c} THEN 'CRITICAL' WHEN {x} >= {w} THEN 'WARN' ELSE 'OK' END")


def components_sql(link: str = "125000000.0::DOUBLE", pps: tuple = (50000, 100000, 500000), cv: tuple = (1.5, 3.0)) -> str:
    use, bad, top = f"(avg_bps / {link})", "(malformed_pct / 100)", "(top_src_count::DOUBLE / total_packets)"
    s1, t1 = _three(use, 0.60, 0.80, 0.95, 40, 40, 40, 10)
    s2, t2 = _three("avg_pps", *pps, 60, 20, 40, 10)
    s3, t3 = _three(bad, 0.05, 0.15, 0.30, 55, 25, 20, 5)
    s4 = f"round((CASE WHEN entropy >= 2.5 THEN 95 WHEN entropy >= 1.0 THEN 50 + 45 * {_lin('entropy', 1.0, 2.5)} ELSE greatest(10, 50 * entropy / (1 + 1e-9)) END)::DOUBLE, 2)"
    s5, t5 = _two(top, 0.60, 0.85)
    s6, t6 = _two("cv", *cv)
    rows = [
        ("Bandwidth Utilisation", s1, 0.25, f"round({use} * 100, 4)", 60, t1), ("Packet Rate", s2, 0.15, "round(avg_pps, 2)", pps[0], t2),
        ("Malformed Packets", s3, 0.20, "round(malformed_pct, 4)", 5, t3),
        ("Protocol Diversity", s4, 0.15, "round(entropy, 4)", 1, "CASE WHEN entropy >= 1 THEN 'OK' ELSE 'WARN' END"),
        ("Host Concentration", s5, 0.10, f"round({top} * 100, 4)", 60, t5),
        ("Traffic Stability", f"CASE WHEN minute_count < 2 THEN 70.0 ELSE {s6} END", 0.15, "CASE WHEN minute_count < 2 THEN 0 ELSE round(cv, 4) END", cv[0],
         f"CASE WHEN minute_count < 2 THEN 'OK' ELSE {t6} END")]
    return "hc AS (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS component, ({s})::DOUBLE AS score, {w}::DOUBLE AS weight, ({m})::DOUBLE AS metric_value, {t}::DOUBLE AS threshold, {st} AS status FROM mt"
        for i, (n, s, w, m, t, st) in enumerate(rows)) + ")"


def _frames(t: str) -> str:
    return FRAMES.format(t=t)


# Limits under which the burst view leaves the OK band.
TIGHT = health.HealthLimits(link_bits_per_second=10e6, packet_rate=(500.0, 1_000.0, 3_000.0), stability=(0.5, 1.0))
TIGHT_SQL = components_sql("1250000.0::DOUBLE", (500, 1000, 3000), (0.5, 1.0))


def burst(spark, d):
    return network_profile(fixtures.packets(spark, d, "burst"))


def real(spark, d):
    return network_profile(fixtures.packets(spark, d))


def _component(name: str, label: str) -> None:
    @register(f"{name}_tight_limits", over("b", f"WITH {_frames('b')}, {TIGHT_SQL} SELECT * FROM hc WHERE component = '{label}'"))
    def _(spark, d):
        return health.components(burst(spark, d).metrics, TIGHT).filter(F.col("component") == label)

    @register(name, over("p", f"WITH {_frames('p')}, {components_sql()} SELECT * FROM hc WHERE component = '{label}'"))
    def _(spark, d):
        return health.components(real(spark, d).metrics).filter(F.col("component") == label)


for _name, _label in (("g1_bandwidth_component", "Bandwidth Utilisation"), ("g2_packet_rate_component", "Packet Rate"),
                      ("g3_malformed_component", "Malformed Packets"), ("g4_diversity_component", "Protocol Diversity"),
                      ("g5_host_component", "Host Concentration"), ("g6_stability_component", "Traffic Stability")):
    _component(_name, _label)

_GROWTH = """gr AS (SELECT CASE WHEN count(*) < 2 THEN 0 ELSE round((sum(packets) FILTER (WHERE pos > n // 2) - sum(packets) FILTER (WHERE pos <= n // 2))::DOUBLE
    / sum(packets) FILTER (WHERE pos <= n // 2), 4) END AS g FROM (SELECT packets, row_number() OVER (ORDER BY s) AS pos, count(*) OVER () AS n FROM sec))"""
_STATUS = "CASE WHEN raw >= 90 THEN 'Excellent' WHEN raw >= 75 THEN 'Good' WHEN raw >= 55 THEN 'Moderate' WHEN raw >= 35 THEN 'Poor' ELSE 'Critical' END"
_LABEL = "CASE WHEN scv >= 3 THEN 'Highly Unstable' WHEN scv >= 1.5 THEN 'Unstable' WHEN scv >= 0.5 THEN 'Moderate' ELSE 'Stable' END"
_SCORE = "sc AS (SELECT least(100, greatest(0, sum(score * weight))) AS raw, max(metric_value) FILTER (WHERE component = 'Traffic Stability') AS scv, count(*) FILTER (WHERE status <> 'OK') AS issue_count FROM hc)"


def _report_sql(t: str, comp: str, link: str) -> str:
    return f"""WITH {_frames(t)}, {comp}, {_GROWTH}, {_SCORE} SELECT round(raw, 2) AS health_score, {_STATUS} AS health_status, round(least(avg_bps / {link} * 100, 100), 4) AS bandwidth_utilisation_pct,
    avg_pps AS avg_packets_per_second, avg_bps AS avg_bytes_per_second, avg_packet_size, malformed_pct, round(entropy, 4) AS protocol_diversity_entropy, unique_src_ips AS unique_hosts,
    {_LABEL} AS traffic_stability, (SELECT g FROM gr)::DOUBLE AS packet_growth_rate, issue_count, capture_end AS computed_for FROM mt, sc"""


@register("g7_health_report", over("p", _report_sql("p", components_sql(), "125000000.0::DOUBLE")))
def _(spark, d):
    p = real(spark, d)
    return health.health_report(p.metrics, p.per_second)


@register("g7_health_report_tight_limits", over("b", _report_sql("b", TIGHT_SQL, "1250000.0::DOUBLE")))
def _(spark, d):
    p = burst(spark, d)
    return health.health_report(p.metrics, p.per_second, TIGHT)


@register("g8_growth_rate", over("p", f"WITH {_frames('p')}, {_GROWTH} SELECT g::DOUBLE AS packet_growth_rate FROM gr"))
def _(spark, d):
    return health.growth_rate(real(spark, d).per_second)


@register("g9_stability_label", over("p", f"WITH {_frames('p')} SELECT {_LABEL.replace('scv', 'cv')} AS traffic_stability, round(cv, 4) AS cv FROM mt"))
def _(spark, d):
    return real(spark, d).metrics.select(health.stability_label(F.col("minute_cv")).alias("traffic_stability"), F.round("minute_cv", 4).alias("cv"))


@register("g10_issues", over("b", f"""WITH {_frames('b')}, {TIGHT_SQL} SELECT component, status,
    concat('[', status, '] ', component, printf(': %.2f', metric_value)) AS message FROM hc WHERE status <> 'OK'"""))
def _(spark, d):
    return health.issues(health.components(burst(spark, d).metrics, TIGHT)).drop("recommendation")


@register("g11_component_table", over("p", f"WITH {_frames('p')}, {components_sql()} SELECT component, round(score, 1) AS score, status, weight, round(metric_value, 4) AS metric_value FROM hc"))
def _(spark, d):
    return health.component_table(health.components(real(spark, d).metrics))


@register("g12_health_alert", over("b", f"""WITH {_frames('b')}, {TIGHT_SQL}, {_SCORE}, st AS (SELECT raw, {_STATUS} AS status FROM sc)
    SELECT 'NetworkHealth' AS attack_type, CASE status WHEN 'Moderate' THEN 'LOW' WHEN 'Poor' THEN 'HIGH' ELSE 'CRITICAL' END AS severity, 'N/A' AS source_ip, 'N/A' AS destination_ip,
    (SELECT capture_end FROM mt) AS timestamp, concat(printf('Health score %.1f is ', round(raw, 2)), status) AS description FROM st WHERE status NOT IN ('Excellent', 'Good')"""))
def _(spark, d):
    p = burst(spark, d)
    return health.health_alert(health.health_report(p.metrics, p.per_second, TIGHT))


# ---- quality -----------------------------------------------------------------------

def _level(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'Excellent' WHEN {x} >= 75 THEN 'Good' WHEN {x} >= 55 THEN 'Fair' ELSE 'Poor' END"


def quality_sql(link: str = "125000000.0::DOUBLE") -> str:
    use = f"(avg_bps / {link})"
    ttl = f"(CASE WHEN ttl_std >= 60 THEN 20 WHEN ttl_std >= 20 THEN 60 - 40 * {_lin('ttl_std', 20, 60)} ELSE least(100, 80 + 20 * (1 - ttl_std / (20 + 1e-9))) END)"
    lat = f"CASE WHEN ttl_count >= 2 THEN {ttl} WHEN mean_length > 1200 THEN 50 WHEN mean_length > 800 THEN 70 ELSE 85 END"
    lat_level = (f"CASE WHEN ttl_count >= 2 THEN CASE WHEN ttl_std >= 60 THEN 'Poor' WHEN ttl_std >= 20 THEN 'Fair' WHEN {ttl} < 90 THEN 'Good' ELSE 'Excellent' END "
                 "WHEN mean_length > 1200 THEN 'Fair' ELSE 'Good' END")
    cong = (f"(0.6 * (CASE WHEN {use} >= 0.9 THEN 5 WHEN {use} >= 0.5 THEN 60 * (1 - {_lin(use, 0.5, 0.9)}) ELSE least(100, 100 * (1 - {use} / (0.5 + 1e-9)) + 40) END) "
            "+ 0.4 * greatest(10, 100 - (least(20, peak_bps / avg_bps) - 1) * 10))")
    deliv = "(0.6 * least(100, greatest(0, 100 * (1 - malformed_pct / 100 * 5))) + 0.4 * least(100, greatest(10, 100 - std_packet_size / avg_packet_size * 30)))"
    ratio = "(least(unique_src_ips, unique_dst_ips)::DOUBLE / greatest(unique_src_ips, unique_dst_ips))"
    bal = f"(0.5 * (50 + 50 * {ratio}) + 0.5 * (40 + 60 * entropy / log2(protocol_count)))"
    stab = "(CASE WHEN minute_count < 2 THEN 70 ELSE least(100, greatest(10, 100 - cv * 25)) END)"
    rows = [
        ("Estimated Latency Score", lat, 0.20, "CASE WHEN ttl_count >= 2 THEN 'ttl_standard_deviation' ELSE 'avg_packet_size_fallback' END",
         "CASE WHEN ttl_count >= 2 THEN round(ttl_std, 4) ELSE round(mean_length, 2) END", lat_level),
        ("Estimated Congestion Score", cong, 0.25, "'bw_util_and_burst_ratio'", f"round({use} * 100, 4)", _level(cong)),
        ("Packet Delivery Efficiency", deliv, 0.25, "'malformed_pct_and_size_cv'", "round(malformed_pct, 4)", _level(deliv)),
        ("Traffic Balance Score", bal, 0.15, "'ip_symmetry_and_protocol_entropy'", f"round({ratio}, 4)", _level(bal)),
        ("Network Stability Score", stab, 0.15, "'per_minute_bytes_cv'", "CASE WHEN minute_count < 2 THEN 0 ELSE round(cv, 4) END",
         f"CASE WHEN minute_count < 2 THEN 'Good' ELSE {_level(stab)} END")]
    return "qd AS (" + " UNION ALL ".join(
        f"SELECT {i} AS position, '{n}' AS dimension, {_clamp(s)} AS score, {w}::DOUBLE AS weight, {m} AS proxy_metric, ({v})::DOUBLE AS proxy_value, {q} AS quality FROM mt"
        for i, (n, s, w, m, v, q) in enumerate(rows)) + ")"


SLOW = quality.QualityLimits(link_bits_per_second=12e6)
SLOW_SQL = quality_sql("1500000.0::DOUBLE")


def _dimension(name: str, label: str) -> None:
    @register(f"{name}_slow_link", over("b", f"WITH {_frames('b')}, {SLOW_SQL} SELECT * FROM qd WHERE dimension = '{label}'"))
    def _(spark, d):
        return quality.dimensions(burst(spark, d).metrics, SLOW).filter(F.col("dimension") == label)

    @register(name, over("p", f"WITH {_frames('p')}, {quality_sql()} SELECT * FROM qd WHERE dimension = '{label}'"))
    def _(spark, d):
        return quality.dimensions(real(spark, d).metrics).filter(F.col("dimension") == label)


for _name, _label in (("h1_latency_proxy", "Estimated Latency Score"), ("h2_congestion", "Estimated Congestion Score"),
                      ("h3_delivery", "Packet Delivery Efficiency"), ("h4_balance", "Traffic Balance Score"), ("h5_stability", "Network Stability Score")):
    _dimension(_name, _label)


@register("h1_latency_without_ttl", over("p", f"""WITH x AS (SELECT * REPLACE (CAST(NULL AS INT) AS ttl) FROM p), {_frames('x')}, {quality_sql()}
    SELECT * FROM qd WHERE dimension = 'Estimated Latency Score'"""))
def _(spark, d):
    rows = fixtures.packets(spark, d).withColumn("ttl", F.lit(None).cast("int"))
    return quality.dimensions(network_profile(rows).metrics).filter("position = 0")


@register("h6_quality_report", over("p", f"""WITH {_frames('p')}, {quality_sql()}, q AS (SELECT sum(score * weight) AS i, count(*) FILTER (WHERE quality IN ('Fair', 'Poor')) AS note_count FROM qd)
    SELECT round(i, 2) AS quality_index, {_level('i')} AS quality_level, note_count FROM q"""))
def _(spark, d):
    return quality.quality_report(real(spark, d).metrics)


@register("h7_quality_notes", over("p", f"""WITH {_frames('p')}, {quality_sql()} SELECT dimension, quality, concat(dimension, ' is ', quality, printf(' (score=%.0f)', score)) AS note
    FROM qd WHERE quality IN ('Fair', 'Poor')"""))
def _(spark, d):
    return quality.notes(quality.dimensions(real(spark, d).metrics))


@register("h7_dimension_table", over("b", f"WITH {_frames('b')}, {quality_sql()} SELECT dimension, round(score, 1) AS score, quality, weight, proxy_metric, round(proxy_value, 4) AS proxy_value FROM qd"))
def _(spark, d):
    return quality.dimensions(burst(spark, d).metrics).select("dimension", F.round("score", 1).alias("score"), "quality", "weight", "proxy_metric", F.round("proxy_value", 4).alias("proxy_value"))


# ---- bottlenecks ---------------------------------------------------------------------

EVENT = ["check_name", "severity", "metric_name", "metric_value", "threshold_value", "affected_ip"]


def event_sql(check: str, severity: str, metric: str, value: str, threshold: str, source: str, host: str = "NULL") -> str:
    return (f"SELECT '{check}' AS check_name, {severity} AS severity, {metric} AS metric_name, round(({value})::DOUBLE, 4) AS metric_value, "
            f"round(({threshold})::DOUBLE, 4) AS threshold_value, CAST({host} AS VARCHAR) AS affected_ip FROM {source}")


def shown(events):
    return events.select("check_name", "severity", "metric_name", F.round("metric_value", 4).alias("metric_value"),
                         F.round("threshold_value", 4).alias("threshold_value"), "affected_ip")


def saturation_sql(link: float) -> str:
    return event_sql("bandwidth_avg", f"CASE WHEN avg_bps / {link} >= 0.9 THEN 'CRITICAL' ELSE 'MEDIUM' END", "'avg_bytes_per_second'", "avg_bps",
                     f"CASE WHEN avg_bps / {link} >= 0.9 THEN {link * 0.9} ELSE {link * 0.6} END", f"mt WHERE avg_bps / {link} >= 0.6") + " UNION ALL " + \
        event_sql("bandwidth_peak", "'HIGH'", "'peak_bytes_per_second'", "peak_bps", str(link * 0.9), f"mt WHERE peak_bps / {link} >= 0.9")


def rate_sql(w: float, c: float) -> str:
    return event_sql("pps_avg", f"CASE WHEN avg_pps >= {c} THEN 'CRITICAL' ELSE 'MEDIUM' END", "'avg_packets_per_second'", "avg_pps",
                     f"CASE WHEN avg_pps >= {c} THEN {c} ELSE {w} END", f"mt WHERE avg_pps >= {w}")


ZSCORE_SQL = event_sql("pps_spike_zscore", "'HIGH'", "'packets_per_second'", "packets", "m + 3 * sd",
                       "(SELECT packets, m, sd FROM sec, (SELECT avg(packets) AS m, stddev_samp(packets) AS sd, count(*) AS c FROM sec) WHERE c >= 3 AND sd > 0 AND abs((packets - m) / sd) >= 3 ORDER BY s LIMIT 1)")
IQR_SQL = event_sql("pps_spike_iqr", "'MEDIUM'", "'packets_per_second'", "mx", "q3 + 1.5 * (q3 - q1)",
                    "(SELECT max(packets) AS mx, quantile_cont(packets, 0.25) AS q1, quantile_cont(packets, 0.75) AS q3, count(*) AS c FROM sec) WHERE c >= 4 AND mx > q3 + 1.5 * (q3 - q1)")


def dominance_sql(limit: float) -> str:
    x = "packet_count::DOUBLE / (SELECT total_packets FROM mt)"
    return event_sql("protocol_dominance", f"CASE WHEN {x} >= 0.95 THEN 'CRITICAL' ELSE 'HIGH' END", "concat('protocol_', protocol, '_fraction')", f"round({x} * 100, 2)", str(limit * 100), f"pr WHERE {x} >= {limit}")


MALFORMED_SQL = event_sql("malformed_packets", "CASE WHEN malformed_pct >= 30 THEN 'CRITICAL' WHEN malformed_pct >= 15 THEN 'HIGH' ELSE 'MEDIUM' END", "'malformed_pct'", "malformed_pct",
                          "CASE WHEN malformed_pct >= 15 THEN 15 ELSE 5 END", "mt WHERE malformed_pct >= 5")


def concentration_sql(limit: float) -> str:
    x, y = "top_src_count::DOUBLE / total_packets", "top3_src_count::DOUBLE / total_packets"
    return event_sql("host_top_talker", f"CASE WHEN {x} >= 0.85 THEN 'CRITICAL' ELSE 'HIGH' END", "'top_talker_fraction'", f"round({x} * 100, 2)", str(limit * 100), f"mt WHERE {x} >= {limit}", "top_src_ip") + \
        " UNION ALL " + event_sql("host_concentration_top3", "'MEDIUM'", "'top3_concentration_fraction'", f"round({y} * 100, 2)", "90", f"mt WHERE unique_src_ips >= 3 AND {y} >= 0.9")


def size_sql(mult: float) -> str:
    f = f"""(SELECT count(*) AS c, max(up) AS up, max(lo) AS lo, count(*) FILTER (WHERE packet_length > up) * 100.0::DOUBLE / count(*) AS ov, count(*) FILTER (WHERE packet_length < lo) * 100.0::DOUBLE / count(*) AS un
      FROM n, (SELECT q3 + {mult} * (q3 - q1) AS up, greatest(0, q1 - {mult} * (q3 - q1)) AS lo FROM (SELECT quantile_cont(packet_length, 0.25) AS q1, quantile_cont(packet_length, 0.75) AS q3 FROM n)))"""
    return event_sql("oversized_packets", "CASE WHEN ov >= 15 THEN 'HIGH' ELSE 'MEDIUM' END", "'oversized_packet_pct'", "round(ov, 2)", "up", f"{f} WHERE c >= 4 AND ov >= 5") + " UNION ALL " + \
        event_sql("undersized_packets", "'LOW'", "'undersized_packet_pct'", "round(un, 2)", "lo", f"{f} WHERE c >= 4 AND un >= 10")


QUEUE_SQL = event_sql("queue_growth", "CASE WHEN x >= 0.7 THEN 'HIGH' ELSE 'MEDIUM' END", "'queue_growth_fraction'", "round(x * 100, 2)", "CASE WHEN x >= 0.7 THEN 70 ELSE 50 END",
                      """(SELECT count(*) FILTER (WHERE bytes < b1 AND b1 < b2)::DOUBLE / nullif(count(*), 0) AS x FROM (SELECT bytes, lead(bytes, 1) OVER (ORDER BY m) AS b1, lead(bytes, 2) OVER (ORDER BY m) AS b2,
                      row_number() OVER (ORDER BY m) AS pos, count(*) OVER () AS c FROM mi) WHERE c >= 4 AND pos <= c - 3) WHERE x >= 0.5""")

NARROW = bn.BottleneckLimits(link_bits_per_second=8e6, packet_rate=(500.0, 1_500.0), dominance=0.15, concentration=0.02, size_iqr=0.1)
NARROW_SQL = " UNION ALL ".join([saturation_sql(1e6), rate_sql(500, 1500), ZSCORE_SQL, IQR_SQL, dominance_sql(0.15), MALFORMED_SQL, concentration_sql(0.02), size_sql(0.1), QUEUE_SQL])


@register("i1_bandwidth_saturation", over("b", f"WITH {_frames('b')} {saturation_sql(1e6)}"))
def _(spark, d):
    return shown(bn.bandwidth_saturation(burst(spark, d).metrics, NARROW))


@register("i2_packet_rate_level", over("b", f"WITH {_frames('b')} {rate_sql(500, 1500)}"))
def _(spark, d):
    return shown(bn.packet_rate_level(burst(spark, d).metrics, NARROW))


@register("i3_zscore_spike", over("p", f"WITH {_frames('p')} {ZSCORE_SQL}"))
def _(spark, d):
    return shown(bn.zscore_spike(real(spark, d).per_second))


@register("i4_iqr_spike", over("p", f"WITH {_frames('p')} {IQR_SQL}"))
def _(spark, d):
    return shown(bn.iqr_spike(real(spark, d).per_second))


@register("i5_protocol_dominance", over("p", f"WITH {_frames('p')} {dominance_sql(0.2)}"))
def _(spark, d):
    return shown(bn.protocol_dominance(real(spark, d).protocols, bn.BottleneckLimits(dominance=0.2)))


@register("i6_malformed_rate", over("p", f"WITH {_frames('p')} {MALFORMED_SQL}"))
def _(spark, d):
    return shown(bn.malformed_rate(real(spark, d).metrics))


@register("i7_host_concentration", over("p", f"WITH {_frames('p')} {concentration_sql(0.02)}"))
def _(spark, d):
    return shown(bn.host_concentration(real(spark, d).metrics, NARROW))


@register("i8_size_anomaly", over("p", f"WITH {_frames('p')} {size_sql(0.1)}"))
def _(spark, d):
    return shown(bn.size_anomaly(real(spark, d).lengths, NARROW))


_SWELL = "CAST(least(65535, floor(packet_number / 2) + 40) AS int)"
_GLIDE = {"spark": "timestamp_millis(1704067200000 + packet_number * 1000)", "duck": "epoch_ms(1704067200000 + packet_number * 1000)"}


@register("i9_queue_growth", over("p", f"WITH x AS (SELECT * REPLACE ({_SWELL} AS packet_length, {_GLIDE['duck']} AS timestamp) FROM p), {_frames('x')} {QUEUE_SQL}"))
def _(spark, d):
    rows = fixtures.packets(spark, d).withColumns({"packet_length": F.expr(_SWELL), "timestamp": F.expr(_GLIDE["spark"])})
    return shown(bn.queue_growth(network_profile(rows).per_minute))


_MAXSEV = "CASE max(CASE severity WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 WHEN 'CRITICAL' THEN 4 END) WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' WHEN 4 THEN 'CRITICAL' ELSE 'NONE' END"
_EV = f"ev AS ({NARROW_SQL})"


@register("i10_bottleneck_report", over("b", f"""WITH {_frames('b')}, {_EV} SELECT count(*) AS event_count, {_MAXSEV} AS max_severity, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count,
    count(*) FILTER (WHERE severity = 'HIGH') AS high_count, CAST(10 AS INT) AS total_checks FROM ev"""))
def _(spark, d):
    profile = burst(spark, d)
    return bn.bottleneck_report(bn.all_events(profile, NARROW), profile.metrics)


@register("i10_report_without_sources", over("b", f"""WITH n AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS src_ip) FROM b) SELECT CAST(count(DISTINCT src_ip) + 9 AS INT) AS total_checks FROM n"""))
def _(spark, d):
    nameless = fixtures.packets(spark, d, "burst").withColumn("src_ip", F.lit(None).cast("string"))
    profile = network_profile(nameless)
    return bn.bottleneck_report(bn.all_events(profile, NARROW), profile.metrics).select("total_checks")


@register("i11_event_table", over("b", f"WITH {_frames('b')}, {_EV} SELECT check_name, severity FROM ev WHERE severity = 'HIGH'"))
def _(spark, d):
    return bn.filter_events(bn.all_events(burst(spark, d), NARROW), severity="HIGH").select("check_name", "severity")


@register("i12_severity_counts", over("b", f"""WITH {_frames('b')}, {_EV} SELECT v.severity, count(ev.severity) AS events FROM (VALUES ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) v(severity)
    LEFT JOIN ev ON ev.severity = v.severity GROUP BY 1"""))
def _(spark, d):
    return bn.severity_counts(bn.all_events(burst(spark, d), NARROW))


@register("i13_check_matrix", over("b", f"WITH {_frames('b')}, {_EV} SELECT check_name, count(*) AS events, {_MAXSEV} AS max_severity FROM ev GROUP BY 1"))
def _(spark, d):
    return bn.check_matrix(bn.all_events(burst(spark, d), NARROW))


@register("i14_escalated_alerts", over("b", f"""WITH {_frames('b')}, {_EV} SELECT concat('Bottleneck:', check_name) AS attack_type, severity, coalesce(affected_ip, 'N/A') AS source_ip, 'N/A' AS destination_ip
    FROM ev WHERE severity IN ('HIGH', 'CRITICAL')"""))
def _(spark, d):
    return bn.escalate(bn.all_events(burst(spark, d), NARROW)).drop("description")
