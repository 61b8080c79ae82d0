"""IP address expressions.

Everything is string work inside the JVM.  IPv4, the hot path, is one or two
pattern tests in generated code; IPv6 text is first spelled out as 32 hex digits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"

# IANA special-purpose ranges that count as private, as patterns.
# 0/8, 10/8, 127/8, 169.254/16, 172.16/12, 192.0.0/24 without .9 and .10,
# 192.0.2/24, 192.168/16, 198.18/15, 198.51.100/24, 203.0.113/24, 240/4
PRIVATE_V4 = (
    r"^(?:0|10|127|24[0-9]|25[0-5])\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.|"
    r"^192\.0\.0\.(?!9$|10$)|^192\.0\.2\.|^192\.168\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.")

# The same for IPv6 written as 32 hex digits: ::1, ::, 64:ff9b:1::/48, 100::/64,
# 2001::/23 without its public holes, 2001:db8::/32, 2002::/16, fc00::/7, fe80::/10
PRIVATE_V6 = (
    r"^0{31}[01]$|^0064ff9b0001|^01000{12}|"
    r"^2001(?!00010{23}[12]$|0003|00040112|002|003)0[01]|"
    r"^20010db8|^2002|^f[cd]|^fe[89ab]")

_V6_SHAPE = "^(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"
_TAIL = r"[0-9]+(?:\.[0-9]+){3}$"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ipv4(ip: Column) -> Column:
    return F.coalesce(ip.rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_long(ip: Column) -> Column:
    """Address as a bigint, null when the text is not an IPv4 literal."""
    octets = F.split(ip, r"\.")
    value = reduce(lambda acc, i: acc * 256 + octets[i].cast("long"), range(1, 4),
                   octets[0].cast("long"))
    return F.when(is_ipv4(ip), value)


def long_to_ipv4(value: Column) -> Column:
    return F.concat_ws(".", *[
        F.shiftright(value, shift).bitwiseAND(255).cast("string") for shift in (24, 16, 8, 0)])


def _hex_from_groups(text: Column) -> Column:
    """32 hex digits of lower-case IPv6 text without an IPv4 tail, else null."""
    edge = F.when(text.startswith("::"), 1).otherwise(0) + F.when(text.endswith("::"), 1).otherwise(0)
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))

    def spell_zeros(missing: Column) -> Column:
        filled = F.replace(text, F.lit("::"), F.concat(F.repeat(F.lit(":0"), missing), F.lit(":")))
        filled = F.regexp_replace(filled, F.when(text.startswith("::"), "^:").otherwise("^(?!)"), F.lit(""))
        filled = F.regexp_replace(filled, F.when(text.endswith("::"), ":$").otherwise("^(?!)"), F.lit(""))
        return F.when((missing >= 1) & ~text.rlike("::.*::|:::"), filled)

    full = F.when(text.contains("::"), _let(8 - (colons - edge), spell_zeros)).otherwise(text)
    return _let(full, lambda spelled: F.when(spelled.rlike(_V6_SHAPE), _let(
        F.split(spelled, ":"), lambda parts: F.concat(*[F.lpad(parts[i], 4, "0") for i in range(8)]))))


def _v4_tail_to_groups(text: Column) -> Column:
    return F.when(text.contains("."), _let(
        F.lpad(F.lower(F.hex(ipv4_to_long(F.regexp_extract(text, f"({_TAIL})", 1)))), 8, "0"),
        lambda digits: F.concat(F.regexp_replace(text, _TAIL, ""), F.substring(digits, 1, 4),
                                F.lit(":"), F.substring(digits, 5, 4)))).otherwise(text)


def ipv6_to_hex(ip: Column) -> Column:
    """An IPv6 literal as 32 hex digits, null when it is not one."""
    text = F.lower(F.regexp_replace(ip, r"%[^%]+$", ""))
    return F.when(ip.contains(":"), _let(_let(text, _v4_tail_to_groups), _hex_from_groups))


def _is_mapped(digits: Column) -> Column:
    return digits.startswith("0" * 20 + "ffff")


def _mapped_v4(digits: Column) -> Column:
    """The IPv4 text inside ``::ffff:a.b.c.d`` given as hex digits."""
    return long_to_ipv4(F.conv(F.substring(digits, 25, 8), 16, 10).cast("long"))


def is_valid_ip(ip: Column) -> Column:
    return is_ipv4(ip) | F.coalesce(ipv6_to_hex(ip).isNotNull(), F.lit(False))


def _private_hex(digits: Column) -> Column:
    return F.coalesce(F.when(_is_mapped(digits), _mapped_v4(digits).rlike(PRIVATE_V4))
                      .otherwise(digits.rlike(PRIVATE_V6)), F.lit(False))


def is_private_ip(ip: Column) -> Column:
    """Private or loopback; null and malformed text give false."""
    return F.when(is_ipv4(ip), ip.rlike(PRIVATE_V4)) \
        .when(ip.contains(":"), _let(ipv6_to_hex(ip), _private_hex)) \
        .otherwise(F.lit(False))


def _v4_class(ip: Column) -> Column:
    return F.when(ip.startswith("127."), "loopback") \
        .when(ip.rlike(r"^(?:22[4-9]|23[0-9])\."), "multicast") \
        .when(ip.startswith("169.254."), "link_local") \
        .when(ip == "0.0.0.0", "unspecified") \
        .when(ip.rlike(PRIVATE_V4), "private") \
        .otherwise("public")


def _v6_class(digits: Column) -> Column:
    return F.when(digits.isNull(), "unknown") \
        .when(digits.startswith("0" * 20 + "ffff7f"), "loopback") \
        .when(_is_mapped(digits), F.when(_private_hex(digits), "private").otherwise("public")) \
        .when(digits.rlike("^0{31}1$"), "loopback") \
        .when(digits.startswith("ff"), "multicast") \
        .when(digits.rlike("^fe[89ab]"), "link_local") \
        .when(digits.rlike("^0{32}$"), "unspecified") \
        .when(digits.rlike(PRIVATE_V6), "private") \
        .otherwise("public")


def classify_ip(ip: Column) -> Column:
    """loopback, multicast, link_local, unspecified, private, public or unknown."""
    return F.when(is_ipv4(ip), _v4_class(ip)) \
        .when(ip.contains(":"), _let(ipv6_to_hex(ip), _v6_class)) \
        .otherwise(F.lit("unknown"))


def extract_subnet(ip: Column, prefix_len: int = 24) -> Column:
    """Network of ``ip/prefix_len`` as CIDR text; null for malformed text or prefix."""
    v4 = F.lit(None).cast("string")
    if 0 <= prefix_len <= 32:
        mask = (0xFFFFFFFF << (32 - prefix_len)) & 0xFFFFFFFF
        v4 = F.concat(long_to_ipv4(ipv4_to_long(ip).bitwiseAND(F.lit(mask).cast("long"))),
                      F.lit(f"/{prefix_len}"))
    v6 = F.lit(None).cast("string")
    if 0 <= prefix_len <= 128:
        v6 = _let(ipv6_to_hex(ip), lambda digits: F.when(digits.isNotNull(), F.concat(
            _let(_masked(digits, prefix_len), hex_to_ipv6), F.lit(f"/{prefix_len}"))))
    return F.when(is_ipv4(ip), v4).when(ip.contains(":"), v6)


def _masked(digits: Column, prefix_len: int) -> Column:
    """Hex digits with everything after the first ``prefix_len`` bits zero."""
    whole, part = divmod(prefix_len, 4)
    pieces = [F.substring(digits, 1, whole)] if whole else []
    if part:
        mask = (0xF << (4 - part)) & 0xF
        nibble = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("long")
        pieces.append(F.lower(F.hex(nibble.bitwiseAND(F.lit(mask).cast("long")))))
    head = F.concat(*pieces) if pieces else F.lit("")
    return F.rpad(head, 32, "0")


def hex_to_ipv6(digits: Column) -> Column:
    """Compressed text of 32 hex digits: the first longest run of zero groups is squeezed."""
    groups = [F.regexp_replace(F.substring(digits, 4 * i + 1, 4), "^0{1,3}", "") for i in range(8)]
    full = F.concat(F.lit(":"), F.concat_ws(":", *groups), F.lit(":"))

    def squeeze(text: Column) -> Column:
        result = text
        for run in range(2, 9):
            zeros = ":" + "0:" * run
            squeezed = F.concat(F.substring_index(text, zeros, 1), F.lit("::"),
                                F.substring(text, F.instr(text, zeros) + len(zeros), F.lit(64)))
            result = F.when(text.contains(zeros), squeezed).otherwise(result)
        return F.regexp_replace(F.regexp_replace(result, "^:(?!:)", ""), "(?<!:):$", "")

    return _let(full, squeeze)
