"""Packet and alert tables derived from the driver's ``events`` table.

The same text, with three engine-specific words filled in, defines each view in
Spark and in the SQL used to check it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import use_utc

_PACKET_COLUMNS = """
  event_id + 1 AS packet_number, {ts} AS timestamp,
  concat('192.168.1.', cast(user_id % 50 + 1 AS {text})) AS src_ip,
  CASE WHEN user_id % 50 = 7 THEN '10.0.0.1'
       ELSE concat('10.0.0.', cast((event_id * 7) % 20 + 1 AS {text})) END AS dst_ip,
  CASE WHEN user_id % 50 = 7 THEN 'TCP' ELSE CASE event_type WHEN 'error' THEN '_WS.MALFORMED'
       WHEN 'click' THEN 'UDP' WHEN 'view' THEN 'DNS' WHEN 'signup' THEN 'icmp' ELSE 'TCP' END END AS protocol,
  CASE WHEN user_id % 50 = 7 OR event_type = 'purchase' THEN 'TCP' WHEN event_type IN ('click', 'view') THEN 'UDP'
       WHEN event_type = 'signup' THEN 'ICMP' END AS transport_layer,
  cast(least(65535, 40 + floor(value * 10)) AS int) AS packet_length,
  cast(1024 + (event_id * 13) % 60000 AS int) AS src_port,
  cast(CASE WHEN user_id % 50 = 7 THEN 1000 + event_id % 997
       ELSE CASE event_id % 5 WHEN 0 THEN 22 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 53 ELSE 3389 END END AS int) AS dst_port,
  cast(32 + (user_id * 13) % 97 AS int) AS ttl,
  CASE WHEN user_id % 50 = 7 THEN '0x2' WHEN event_type = 'purchase' THEN
       CASE event_id % 4 WHEN 0 THEN '0x2' WHEN 1 THEN '0x12' WHEN 2 THEN '0x10' ELSE '0x18' END END AS tcp_flags,
  'IPv4' AS network_layer,
  CASE WHEN event_type = 'view' THEN 'DNS' WHEN event_id % 5 = 0 THEN 'SSH' END AS app_layer_hint,
  4 AS ip_version,
  concat('session-', cast(user_id % 7 AS {text})) AS session_id,
  CASE WHEN event_id % 11 = 0 THEN 'PortScan' WHEN event_id % 3 = 0 THEN 'BENIGN' END AS label
"""

_ALERT_COLUMNS = """
  concat('alert-', cast(event_id AS {text})) AS alert_id, event_id AS seq,
  CASE event_id % 11 WHEN 0 THEN 'DDoS-VolumeFlood' WHEN 1 THEN 'DDoS-UDPFlood' WHEN 2 THEN 'PortScan-Horizontal'
       WHEN 3 THEN 'PortScan-SYNStealth' WHEN 4 THEN 'BruteForce-SSH' WHEN 5 THEN 'BruteForce-CredentialSpray'
       WHEN 6 THEN 'SYNFlood-LowACK' WHEN 7 THEN 'NetworkHealth' WHEN 8 THEN 'ML-PortScan'
       ELSE 'BruteForce-HTTP' END AS attack_type,
  CASE WHEN event_id % 101 = 5 THEN 'CRITICAL' WHEN event_id % 13 = 4 THEN 'HIGH' WHEN event_id % 3 = 1 THEN 'MEDIUM'
       WHEN event_id % 17 = 2 THEN 'info' ELSE 'LOW' END AS severity,
  cast((event_id * 37) % 983 AS double) / 1000 AS confidence,
  CASE WHEN event_id % 9 = 0 THEN 'MULTIPLE' WHEN event_id % 23 = 0 THEN '' WHEN event_id % 4 <> 0 THEN '192.168.1.8'
       ELSE concat('192.168.1.', cast(user_id % 50 + 1 AS {text})) END AS source_ip,
  CASE WHEN event_id % 7 = 0 THEN 'UNKNOWN'
       ELSE concat('10.0.0.', cast((event_id * 7) % 20 + 1 AS {text})) END AS destination_ip,
  {ts} AS timestamp,
  CASE event_id % 4 WHEN 0 THEN 'DDoS Detector' WHEN 1 THEN 'Port Scan Detector'
       WHEN 2 THEN 'Brute Force Detector' ELSE 'SYN Flood Detector' END AS detector_name,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE concat(props, ' ', event_type, ' ', props, ' ', props, ' ', props, ' ', props) END AS description,
  cast(event_id % 5 * 20 + 22 AS int) AS dst_port,
  concat('session-', cast(user_id % 7 AS {text})) AS session_id
"""

# Text as a capture export might hold it: unreadable numbers, odd case, blanks,
# and one row in fifty written twice.
_RAW_COLUMNS = """
  event_id + 1 AS packet_number,
  CASE WHEN event_id % 97 = 0 THEN 'not a time' ELSE {iso} END AS timestamp,
  CASE WHEN event_id % 41 = 0 THEN 'None' ELSE concat('192.168.1.', cast(user_id % 50 + 1 AS {text})) END AS source_ip,
  concat('10.0.0.', cast((event_id * 7) % 20 + 1 AS {text})) AS destination_ip,
  CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_type = 'error' THEN '_ws.malformed: short'
       WHEN event_type = 'click' THEN ' udp ' WHEN event_type = 'view' THEN 'Dns'
       WHEN event_type = 'signup' THEN 'packet malformed' ELSE 'tcp' END AS protocol,
  CASE WHEN event_id % 6 = 0 THEN 'nan' WHEN event_type = 'click' THEN 'udp' WHEN event_type = 'signup' THEN NULL ELSE ' Tcp' END AS transport_layer,
  CASE WHEN event_id % 89 = 0 THEN 'n/a' WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 79 = 0 THEN '70000'
       WHEN event_id % 73 = 0 THEN '-5' ELSE cast(cast(40 + floor(value * 10) AS int) AS {text}) END AS packet_length,
  cast(1024 + (event_id * 13) % 60000 AS {text}) AS source_port,
  CASE WHEN event_id % 29 = 0 THEN 'x' ELSE cast(event_id % 9000 AS {text}) END AS destination_port,
  CASE WHEN event_id % 37 = 0 THEN '' ELSE cast(32 + (user_id * 13) % 97 AS {text}) END AS ttl,
  CASE WHEN event_id % 2 = 0 THEN 'None' ELSE 'IPv4' END AS network_layer
"""

_REAL = {"spark": "cast(ts AS timestamp)", "duckdb": "ts"}
_BURST = {"spark": "timestamp_millis(1704067200000 + event_id div 2)",
          "duckdb": "epoch_ms(1704067200000 + event_id // 2)"}
_ISO = {"spark": "date_format(ts, \"yyyy-MM-dd HH:mm:ss\")",
        "duckdb": "strftime(ts, '%Y-%m-%d %H:%M:%S')"}
_TEXT = {"spark": "string", "duckdb": "varchar"}


def _fill(columns: str, engine: str, flavour: str = "real") -> str:
    ts = (_REAL if flavour == "real" else _BURST)[engine]
    return columns.format(ts=ts, text=_TEXT[engine], iso=_ISO[engine])


def derive(events: DataFrame, table: str, flavour: str = "real") -> DataFrame:
    """``packets``, ``alerts`` or ``raw`` over an ``events`` frame, which may be a stream."""
    columns = {"packets": _PACKET_COLUMNS, "alerts": _ALERT_COLUMNS, "raw": _RAW_COLUMNS}[table]
    return events.selectExpr(*select_list(_fill(columns, "spark", flavour)))


def select_list(text: str) -> list[str]:
    """Cut a select list at its top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def _view(spark: SparkSession, sf_dir: str, table: str, flavour: str = "real") -> DataFrame:
    use_utc(spark)
    return derive(spark.read.parquet(f"{sf_dir}/events.parquet"), table, flavour)


def packets(spark: SparkSession, sf_dir: str, flavour: str = "real") -> DataFrame:
    """Packet view: ``real`` keeps event times, ``burst`` packs two packets per millisecond."""
    return _view(spark, sf_dir, "packets", flavour)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "alerts")


def raw_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _view(spark, sf_dir, "raw")
    return rows.unionByName(rows.filter(F.col("packet_number") % 50 == 0))


def packets_sql(flavour: str = "real") -> str:
    return f"SELECT {_fill(_PACKET_COLUMNS, 'duckdb', flavour)} FROM events"


def alerts_sql() -> str:
    return f"SELECT {_fill(_ALERT_COLUMNS, 'duckdb')} FROM events"


def raw_sql() -> str:
    body = f"SELECT {_fill(_RAW_COLUMNS, 'duckdb')} FROM events"
    return f"SELECT * FROM ({body}) UNION ALL SELECT * FROM ({body}) WHERE packet_number % 50 = 0"
