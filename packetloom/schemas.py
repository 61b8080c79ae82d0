"""Fixed table layouts.  One naming dialect (``src_ip`` ...) everywhere inside."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _TS, _B = (T.StringType(), T.IntegerType(), T.LongType(),
                           T.DoubleType(), T.TimestampType(), T.BooleanType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


PACKET_BASE = _struct(
    ("packet_number", _L), ("timestamp", _TS), ("src_ip", _S), ("dst_ip", _S),
    ("protocol", _S), ("transport_layer", _S), ("packet_length", _I),
    ("src_port", _I), ("dst_port", _I), ("ttl", _I), ("tcp_flags", _S),
    ("network_layer", _S), ("app_layer_hint", _S), ("ip_version", _I),
)

PACKET_ENGINEERED = _struct(
    ("is_tcp", _I), ("is_udp", _I), ("is_icmp", _I), ("packet_size_category", _S),
    ("src_ip_frequency", _L), ("dst_ip_frequency", _L), ("hour_of_day", _I),
    ("is_private_src", _I), ("is_private_dst", _I),
)

PACKETS = T.StructType(PACKET_BASE.fields + PACKET_ENGINEERED.fields)

# Nullable columns of the older packet layout, kept in the same table.
PACKET_LEGACY = _struct(
    ("payload_size", _I), ("window_size", _I), ("icmp_type", _I), ("dns_query", _S),
    ("http_method", _S), ("http_host", _S), ("label", _S), ("anomaly_score", _D),
)

# CSV exports use the long names; this is the only place that knows them.
CSV_ALIASES = {
    "source_ip": "src_ip", "destination_ip": "dst_ip",
    "source_port": "src_port", "destination_port": "dst_port",
    "source_ip_frequency": "src_ip_frequency",
    "destination_ip_frequency": "dst_ip_frequency",
}

ALERTS = T.StructType([
    T.StructField("alert_id", _S), T.StructField("attack_type", _S),
    T.StructField("severity", _S), T.StructField("confidence", _D),
    T.StructField("source_ip", _S), T.StructField("destination_ip", _S),
    T.StructField("timestamp", _TS),
    T.StructField("evidence", T.MapType(_S, _S)),
    T.StructField("recommendation", _S), T.StructField("detector_name", _S),
    T.StructField("dst_port", _I), T.StructField("protocol", _S),
    T.StructField("description", _S),
])

STORED_ALERTS = _struct(
    ("alert_id", _S), ("timestamp", _TS), ("alert_type", _S), ("severity", _S),
    ("src_ip", _S), ("dst_ip", _S), ("dst_port", _I), ("protocol", _S),
    ("description", _S), ("raw_evidence", _S), ("detector_name", _S),
    ("confidence", _D), ("session_id", _S),
)

BOTTLENECK_EVENTS = _struct(
    ("check_name", _S), ("severity", _S), ("description", _S), ("recommendation", _S),
    ("metric_name", _S), ("metric_value", _D), ("threshold_value", _D), ("affected_ip", _S),
)

DISSECTED = _struct(
    ("sniff_timestamp", _S), ("length", _S), ("captured_length", _S),
    ("ip_src", _S), ("ip_dst", _S), ("ip_ttl", _S),
    ("ipv6_src", _S), ("ipv6_dst", _S), ("ipv6_hlim", _S),
    ("arp_src", _S), ("arp_dst", _S),
    ("tcp_srcport", _S), ("tcp_dstport", _S), ("tcp_flags", _S),
    ("udp_srcport", _S), ("udp_dstport", _S),
    ("has_icmp", _B), ("has_icmpv6", _B), ("highest_layer", _S),
)

# Severity ranks, highest last.
SEVERITIES = ("LOW", "MEDIUM", "HIGH", "CRITICAL")
