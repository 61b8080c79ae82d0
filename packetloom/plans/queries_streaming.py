"""Streaming operators run over all data present and compared with the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.detect.common import Thresholds
from packetloom.plans.catalogue import over, register
from packetloom.plans.queries_alerts import _cooldown_sql
from packetloom.plans.queries_detect import (
    _AUTH, _LOW, _SERVICE, ACK_SQL, SYN_SQL, grade_sql, run_sql)
from packetloom.plans.queries_models import scratch
from packetloom.sources import fixtures
from packetloom.streaming import bandwidth, cooldown, job, rules, sinks


def stream(spark, d, columns: str, flavour: str = "real") -> DataFrame:
    """The packet or alert view over a stream of the event file."""
    fixtures.use_utc(spark)
    events = spark.read.parquet(f"{d}/events.parquet")
    live = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return fixtures.derive(live, columns, flavour)


def packets(spark, d, flavour: str = "burst") -> DataFrame:
    return stream(spark, d, "packets", flavour)


_P1 = """w AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS window_start, session_id AS interface, CAST(sum(packet_length) AS BIGINT) AS bytes, count(*) AS packets FROM p GROUP BY 1, 2),
  w2 AS (SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, interface, bytes, packets, round(bytes / 3600.0::DOUBLE, 4) AS bytes_per_second, round(least(bytes / 3600.0::DOUBLE / 997 * 100, 100), 4) AS utilisation_pct FROM w)"""


def _windows(spark, d) -> DataFrame:
    live = bandwidth.bandwidth_windows(packets(spark, d, "real"), "1 hour", interface="session_id", link_bps=7_976)
    rows = sinks.run_now(live, scratch(spark, "p1"), "update")
    return sinks.latest(rows, ["window_start", "interface"])


@register("p1_live_bandwidth", over("p", f"WITH {_P1} SELECT * FROM w2"))
def _(spark, d):
    return _windows(spark, d).withColumn("bytes_per_second", F.round("bytes_per_second", 4))


@register("p2_recent_rates", over("p", f"""WITH {_P1}, r AS (SELECT * FROM w2 ORDER BY window_start DESC, interface LIMIT 48) SELECT round(avg(bytes / 3600.0::DOUBLE), 4) AS average_bps,
    (SELECT round(max(bytes) / 3600.0::DOUBLE, 4) FROM w2) AS peak_bps FROM r"""))
def _(spark, d):
    return bandwidth.recent_rates(_windows(spark, d), 48).select("average_bps", F.round("peak_bps", 4).alias("peak_bps"))


# Only windows that the watermark has closed are judged: those ending before
# the newest packet time less the delay.
_CLOSED = "ws + INTERVAL {w} <= (SELECT max(timestamp) FROM {t}) - INTERVAL {w}"
LIVE = Thresholds(ddos_packets_per_second=300, ddos_bytes_per_second=500_000, synflood_syn_dominance=0.5, synflood_syn_per_second=100.0)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("window_start", "attack_type", "severity", "confidence", "source_ip", "destination_ip")


_WIN_DDOS = f"""v AS (SELECT time_bucket(INTERVAL 1 SECOND, timestamp) AS ws, count(*) AS n, sum(packet_length) AS byt, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur,
  count(DISTINCT src_ip) AS srcs FROM b GROUP BY 1), tt AS (SELECT ws, dst_ip FROM (SELECT time_bucket(INTERVAL 1 SECOND, timestamp) AS ws, dst_ip, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 SECOND, timestamp)
  ORDER BY count(*) DESC, dst_ip) AS r FROM b GROUP BY 1, 2) WHERE r = 1), x AS (SELECT v.*, n / dur AS pps, byt / dur AS bps, tt.dst_ip AS top FROM v JOIN tt ON v.ws = tt.ws WHERE {_CLOSED.format(w='1 SECOND', t='b').replace('ws +', 'v.ws +')})"""


@register("p3_streaming_ddos", over("b", f"""WITH {_WIN_DDOS} SELECT ws AS window_start, 'DDoS-VolumeFlood' AS attack_type, {grade_sql('pps / 300', 5, 2, 1.5)} AS severity,
    round((CASE WHEN srcs > 10 THEN least(0.99, least(0.95, 0.5 + 0.3 * least(round(pps, 2) / 300 - 1, 2) / 2) + 0.05) ELSE least(0.95, 0.5 + 0.3 * least(round(pps, 2) / 300 - 1, 2) / 2) END)::DOUBLE, 3) AS confidence, 'MULTIPLE' AS source_ip, top AS destination_ip FROM x WHERE pps > 300
    UNION ALL SELECT ws, 'DDoS-BandwidthFlood', {grade_sql('bps / 500000', 5, 2, 1.5)}, round(least(0.95, 0.5 + 0.3 * least(round(bps, 2) / 500000 - 1, 2) / 2)::DOUBLE, 3), 'MULTIPLE', top FROM x WHERE bps > 500000"""))
def _(spark, d):
    return _shown(sinks.run_now(rules.ddos_alerts(packets(spark, d), LIVE, "1 second", "1 second"), scratch(spark, "p3")))


_WIN_SYN = f"""v AS (SELECT time_bucket(INTERVAL 1 SECOND, timestamp) AS ws, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur, count(*) FILTER (WHERE protocol = 'TCP') AS tcp,
  count(DISTINCT src_ip) FILTER (WHERE protocol = 'TCP') AS srcs, count(*) FILTER (WHERE protocol = 'TCP' AND {SYN_SQL}) AS syn, count(*) FILTER (WHERE protocol = 'TCP' AND {ACK_SQL}) AS ack FROM b GROUP BY 1),
  tt AS (SELECT ws, dst_ip FROM (SELECT time_bucket(INTERVAL 1 SECOND, timestamp) AS ws, dst_ip, row_number() OVER (PARTITION BY time_bucket(INTERVAL 1 SECOND, timestamp) ORDER BY count(*) DESC, dst_ip) AS r
  FROM b WHERE protocol = 'TCP' GROUP BY 1, 2) WHERE r = 1), x AS (SELECT v.*, syn::DOUBLE / tcp AS share, syn / dur AS sps, tt.dst_ip AS top FROM v JOIN tt ON v.ws = tt.ws WHERE {_CLOSED.format(w='1 SECOND', t='b').replace('ws +', 'v.ws +')})"""


@register("p3_streaming_synflood", over("b", f"""WITH {_WIN_SYN} SELECT ws AS window_start, 'SYNFlood-Dominance' AS attack_type, {grade_sql('share / 0.5', 3, 2, 1.3)} AS severity,
    round(least(0.97, 0.55 + 0.35 * ((round(share, 3) - 0.5) / (0.5 + 1e-9)))::DOUBLE, 3) AS confidence, 'MULTIPLE' AS source_ip, top AS destination_ip FROM x WHERE tcp >= 5 AND share >= 0.5
    UNION ALL SELECT ws, 'SYNFlood-HighRate', {grade_sql('sps / 100.0', 3, 2, 1.3)}, round(least(0.97, 0.55 + 0.3 * least(round(sps, 2) / 100.0 - 1, 4) / 4)::DOUBLE, 3), 'MULTIPLE', top FROM x WHERE tcp >= 5 AND sps >= 100"""))
def _(spark, d):
    return _shown(sinks.run_now(rules.synflood_alerts(packets(spark, d), LIVE, "1 second", "1 second"), scratch(spark, "p3s")))


@register("p4_streaming_portscan", over("p", f"""WITH g AS (SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS ws, src_ip, count(*) AS n, count(DISTINCT dst_port) AS np, count(DISTINCT dst_ip) AS nh, min(dst_ip) AS tgt, avg(packet_length) AS sz,
    count(*) FILTER (WHERE {SYN_SQL}) AS syn, count(*) FILTER (WHERE {ACK_SQL}) AS ack FROM p GROUP BY 1, 2), x AS (SELECT * FROM g WHERE n >= 3 AND {_CLOSED.format(w='1 DAY', t='p')})
    SELECT ws AS window_start, 'PortScan-Horizontal' AS attack_type, {grade_sql('np / 4.0', 5, 3, 1.5)} AS severity, round((CASE WHEN round(sz, 1) < 80 THEN least(0.99, least(0.97, 0.55 + 0.25 * least(np / 4.0 - 1, 4) / 4) + 0.05)
      ELSE least(0.97, 0.55 + 0.25 * least(np / 4.0 - 1, 4) / 4) END)::DOUBLE, 3) AS confidence, src_ip AS source_ip, tgt AS destination_ip FROM x WHERE np >= 4
    UNION ALL SELECT ws, 'PortScan-Vertical', {grade_sql('nh / 4.0', 5, 3, 1.5)}, round(least(0.95, 0.55 + 0.25 * least(nh / 4.0 - 1, 4) / 4)::DOUBLE, 3), src_ip, 'MULTIPLE' FROM x WHERE np < 4 AND nh >= 4 AND np <= 5
    UNION ALL SELECT ws, 'PortScan-SYNStealth', 'HIGH', round(least(0.98, 0.65 + 0.3 * (greatest(0, round(syn::DOUBLE / (syn + ack), 3) - 0.85) / (1 - 0.85::DOUBLE + 1e-9)))::DOUBLE, 3), src_ip, tgt FROM x
      WHERE syn + ack >= 5 AND syn::DOUBLE / nullif(syn + ack, 0) >= 0.85 AND np >= 5"""))
def _(spark, d):
    limits = Thresholds(portscan_unique_ports=4)
    return _shown(sinks.run_now(rules.portscan_alerts(packets(spark, d, "real"), limits, "1 day", delay="1 day"), scratch(spark, "p4")))


_WIN_BF = f"""g AS (SELECT time_bucket(INTERVAL 1 DAY, timestamp) AS ws, src_ip, dst_ip, dst_port, {_SERVICE} AS service, count(*) AS n, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS dur FROM p WHERE {_AUTH} GROUP BY 1, 2, 3, 4, 5),
  x AS (SELECT * FROM g WHERE {_CLOSED.format(w='1 DAY', t='p')})"""


@register("p4_streaming_bruteforce", over("p", f"""WITH {_WIN_BF} SELECT ws AS window_start, concat('BruteForce-', upper(service)) AS attack_type, {grade_sql('n / 2.0', 10, 5, 2)} AS severity,
    round((CASE WHEN round(dur, 2) >= 30 THEN least(0.99, least(0.97, 0.6 + 0.25 * least(n / 2.0 - 1, 5) / 5) + 0.03) ELSE least(0.97, 0.6 + 0.25 * least(n / 2.0 - 1, 5) / 5) END)::DOUBLE, 3) AS confidence,
    src_ip AS source_ip, dst_ip AS destination_ip FROM x WHERE n >= 2"""))
def _(spark, d):
    limits = Thresholds(bruteforce_failed_attempts=2)
    return _shown(sinks.run_now(rules.bruteforce_alerts(packets(spark, d, "real"), limits, "1 day", delay="1 day"), scratch(spark, "p4b")))


@register("p4_streaming_spray", over("p", f"""WITH {_WIN_BF} SELECT ws AS window_start, 'BruteForce-CredentialSpray' AS attack_type, 'HIGH' AS severity, round(least(0.95, 0.6 + 0.25 * least(count(*) / 5.0 - 1, 3) / 3)::DOUBLE, 3) AS confidence,
    src_ip AS source_ip, 'MULTIPLE' AS destination_ip FROM x GROUP BY ws, src_ip HAVING sum(n) >= 2 AND count(*) >= 5"""))
def _(spark, d):
    limits = Thresholds(bruteforce_failed_attempts=2)
    return _shown(sinks.run_now(rules.spray_alerts(packets(spark, d, "real"), limits, "1 day", delay="1 day"), scratch(spark, "p4s")))


FILE_ROWS = 100_000


@register("p5_streaming_cooldown", _cooldown_sql(21_600))
def _(spark, d):
    live = stream(spark, d, "alerts").select("alert_id", "source_ip", "attack_type", "timestamp")
    return sinks.run_now(cooldown.cooldown(live, 21_600), scratch(spark, "p5")).drop("batch_id")


@register("p5_settled_batches", _cooldown_sql(21_600).rsplit("SELECT u.alert_id", 1)[0] + """SELECT u.alert_id, u.source_ip, u.attack_type, make_timestamp(u.t) AS timestamp
    FROM u JOIN k ON u.source_ip = k.source_ip AND u.attack_type = k.attack_type AND u.t = k.t WHERE make_timestamp(u.t) <= (SELECT max(timestamp) FROM a) - INTERVAL 2 DAY
    UNION ALL SELECT concat(alert_id, '-timeless'), source_ip, attack_type, NULL FROM a WHERE seq % 40 = 0""")
def _(spark, d):
    """Six batches with alerts up to a day and a half out of order, and some without a time."""
    fixtures.use_utc(spark)
    alerts = fixtures.alerts(spark, d).select("seq", "alert_id", "source_ip", "attack_type", "timestamp")
    timeless = alerts.filter("seq % 40 = 0").select("seq", F.concat("alert_id", F.lit("-timeless")).alias("alert_id"), "source_ip", "attack_type", F.lit(None).cast("timestamp").alias("timestamp"))
    first, last = alerts.agg(F.min("timestamp").cast("double"), F.max("timestamp").cast("double")).first()
    arrival = F.coalesce(F.col("timestamp").cast("double"), F.lit(first)) + F.pmod(F.xxhash64("alert_id"), F.lit(129_600))
    batch = F.least(F.lit(5), F.floor((arrival - first) / F.lit((last - first + 1) / 6))).cast("int")
    folder, dealt = scratch(spark, "p5-batches"), scratch(spark, "p5-dealt")
    alerts.unionByName(timeless).drop("seq").withColumn("batch", batch).write.partitionBy("batch").parquet(dealt)
    dealt = spark.read.schema(alerts.drop("seq").schema.add("batch", "integer")).parquet(dealt)
    sizes = {r["batch"]: r["n"] for r in dealt.groupBy("batch").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(1, min(sizes.get(i, 0) for i in range(6)) // FILE_ROWS)  # so many rows that no file is empty
    for i in range(6):  # as many files each batch, in order of writing
        dealt.filter(F.col("batch") == i).drop("batch").repartition(files).write.parquet(f"{folder}/b{i}")
    schema = alerts.drop("seq").schema
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/b*")
    return sinks.run_now(cooldown.settled_cooldown(live, 21_600, "2 days"), scratch(spark, "p5s")).drop("batch_id")


@register("p6_continuous_detection", over("b", f"""WITH {run_sql('b')}, rk AS (SELECT *, row_number() OVER (PARTITION BY source_ip, attack_type ORDER BY priority, first_packet, destination_ip, coalesce(dst_port, -1)) AS rn FROM al)
    SELECT attack_type AS alert_type, severity, confidence, source_ip AS src_ip, destination_ip AS dst_ip, timestamp, dst_port, detector_name FROM rk WHERE rn = 1"""))
def _(spark, d):
    root = scratch(spark, "p6")
    live = packets(spark, d)
    job.start_detection(live, root, _LOW, every=None, ingest_time=F.lit("2024-06-01").cast("timestamp")).awaitTermination()
    return spark.read.parquet(f"{root}/alerts").select("alert_type", "severity", "confidence", "src_ip", "dst_ip", "timestamp", "dst_port", "detector_name")
