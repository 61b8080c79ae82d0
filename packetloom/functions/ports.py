"""Port and protocol lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Application names by destination port.
PORT_PROTOCOLS = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS",
    67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP",
    161: "SNMP", 162: "SNMP", 443: "HTTPS", 445: "SMB", 3306: "MYSQL", 3389: "RDP",
    5432: "POSTGRESQL", 8080: "HTTP-ALT", 8443: "HTTPS-ALT",
}

# IANA service names (tcp) for the ports the rules look at.  A
# host's own services file is not consulted, so results do not vary by machine.
SERVICES = {
    20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 53: "domain",
    67: "bootps", 68: "bootpc", 69: "tftp", 80: "http", 110: "pop3", 111: "sunrpc",
    123: "ntp", 135: "epmap", 139: "netbios-ssn", 143: "imap2", 161: "snmp",
    162: "snmp-trap", 179: "bgp", 389: "ldap", 443: "https", 445: "microsoft-ds",
    465: "submissions", 514: "shell", 587: "submission", 636: "ldaps", 873: "rsync",
    993: "imaps", 995: "pop3s", 1433: "ms-sql-s", 1521: "ncube-lm", 3306: "mysql",
    3389: "ms-wbt-server", 5432: "postgresql", 5900: "rfb", 6379: "redis",
    8080: "http-alt", 8443: "pcsync-https",
}

# IP protocol numbers.
IP_PROTOCOLS = {1: "ICMP", 6: "TCP", 17: "UDP", 41: "IPv6", 58: "ICMPv6", 89: "OSPF", 132: "SCTP"}

# Ports with a login.
AUTH_PORTS = (21, 22, 23, 25, 80, 110, 143, 389, 443, 445, 465, 587, 993, 995,
              3306, 3389, 5432, 5900, 6379, 8080, 8443)

# Application guess by port, tried in this order on either side.
HINT_PORTS = (
    ("DNS", (53,)), ("HTTPS", (443, 8443)), ("HTTP", (80, 8080, 8000)),
    ("SSH", (22,)), ("FTP", (20, 21)), ("SMTP", (25, 465, 587)),
)


def lookup(key: Column, table: dict) -> Column:
    """Value of ``key`` in a small fixed table, null when absent."""
    literal = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.element_at(literal, key)


def port_to_service(port: Column) -> Column:
    return F.coalesce(lookup(port.cast("int"), SERVICES), F.lit("unknown"))


def port_to_application(port: Column) -> Column:
    return F.coalesce(lookup(port.cast("int"), PORT_PROTOCOLS), F.lit("OTHER"))


def is_privileged_port(port: Column) -> Column:
    return F.coalesce(port.between(0, 1023), F.lit(False))


def is_ephemeral_port(port: Column) -> Column:
    return F.coalesce(port.between(49152, 65535), F.lit(False))


def protocol_num_to_name(number: Column) -> Column:
    return F.coalesce(lookup(number.cast("int"), IP_PROTOCOLS),
                      F.concat(F.lit("PROTO_"), number.cast("string")))


def hint_by_port(src_port: Column, dst_port: Column) -> Column:
    """First application whose ports hold either side, else null."""
    result = None
    for name, ports in HINT_PORTS:
        hit = F.coalesce(src_port.isin(*ports), F.lit(False)) | \
            F.coalesce(dst_port.isin(*ports), F.lit(False))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result


def determine_protocol(highest_layer: Column, transport: Column,
                       src_port: Column, dst_port: Column) -> Column:
    """Dissector's top layer, else port guess, else transport, else UNKNOWN."""
    layer = F.upper(F.trim(highest_layer))
    usable = layer.isNotNull() & ~layer.isin("", "DATA", "FRAME")
    return F.coalesce(F.when(usable, layer), hint_by_port(src_port, dst_port),
                      F.nullif(F.upper(transport), F.lit("")), F.lit("UNKNOWN"))


def determine_app_hint(src_port: Column, dst_port: Column, protocol: Column) -> Column:
    """Port guess, else the protocol when it is one of the guessable names."""
    upper = F.upper(protocol)
    return F.coalesce(hint_by_port(src_port, dst_port),
                      F.when(upper.isin(*[name for name, _ in HINT_PORTS]), upper))
