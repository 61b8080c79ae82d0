"""TCP flag expressions: bitmask names and the three text parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP header flag bits.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32, "ECE": 64, "CWR": 128}
FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16

# Short names and pairs as printed by packet tools.
SHORT_NAMES = {"F": 1, "S": 2, "R": 4, "P": 8, "A": 16, "U": 32}
TOLERANT_NAMES = {**FLAG_BITS, **SHORT_NAMES, "E": 64, "C": 128,
                  "SA": 18, "FA": 17, "RA": 20, "PA": 24}
FEATURE_NAMES = {**SHORT_NAMES, **{k: v for k, v in FLAG_BITS.items() if v < 64}}


def _map_literal(pairs: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def decode_tcp_flags(mask: Column) -> Column:
    """Names of the set bits, lowest bit first."""
    return F.filter(
        F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in FLAG_BITS.items()]),
        lambda name: name.isNotNull())


def encode_tcp_flags(names: Column) -> Column:
    """Bitmask of an array of names; case does not matter, unknown names add nothing."""
    table = _map_literal(FLAG_BITS)
    return F.aggregate(
        names, F.lit(0),
        lambda acc, name: acc.bitwiseOR(F.coalesce(F.element_at(table, F.upper(name)), F.lit(0))))


def strict_flags(text: Column) -> Column:
    """Value of an integer literal (0x, 0o, 0b prefix or plain decimal), else 0.

    A plain decimal may not have leading zeros; anything unreadable counts as
    no flag set, which is what the volumetric, scan and login rules expect.
    """
    s = F.trim(text)
    body = F.substring(s, 3, 64)
    value = (
        F.when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(body, 16, 10).try_cast("bigint"))
        .when(s.rlike("^0[oO][0-7]+$"), F.conv(body, 8, 10).try_cast("bigint"))
        .when(s.rlike("^0[bB][01]+$"), F.conv(body, 2, 10).try_cast("bigint"))
        .when(s.rlike("^([+-]?[1-9][0-9]*|[+-]?0+)$"), s.try_cast("bigint"))
    )
    return F.coalesce(value, F.lit(0).cast("bigint"))


def _or_all(items: Column, table: Column) -> Column:
    return F.aggregate(
        items, F.lit(0),
        lambda acc, item: acc.bitwiseOR(F.coalesce(F.element_at(table, item), F.lit(0))))


def _numeric_or_null(s: Column) -> Column:
    return F.when(s.rlike("^0[xX][0-9a-fA-F]+$"),
                  F.conv(F.substring(s, 3, 64), 16, 10).try_cast("bigint")) \
        .when(s.rlike("^[+-]?[0-9]+$"), s.try_cast("bigint"))


def tolerant_flags(text: Column) -> Column:
    """Hex, decimal or named flags; names are split at blanks, else read letter by letter."""
    s = F.trim(text)
    upper = F.upper(s)
    table = _map_literal(TOLERANT_NAMES)
    by_word = _or_all(F.split(upper, r"\s+"), table)
    by_letter = _or_all(F.split(upper, ""), table)
    named = F.when(by_word != 0, by_word).otherwise(by_letter)
    value = F.when(s.isin("", "None", "nan"), F.lit(0)) \
        .otherwise(F.coalesce(_numeric_or_null(s), named))
    return F.coalesce(value, F.lit(0)).cast("bigint")


def feature_flags(text: Column) -> Column:
    """Parser of the feature builder: six names, no pairs, no letter pass."""
    s = F.trim(text)
    named = _or_all(F.split(F.upper(s), r"\s+"), _map_literal(FEATURE_NAMES))
    value = F.when(s.isin("", "None", "nan", "NaN"), F.lit(0)) \
        .otherwise(F.coalesce(_numeric_or_null(s), named))
    return F.coalesce(value, F.lit(0)).cast("bigint")


def has_bit(mask: Column, bit: int) -> Column:
    return mask.bitwiseAND(bit) != 0


def hex_text(flags: Column) -> Column:
    """Dissector flag text, always read as hex, to ``0x`` text without padding.

    Text that is not hex stays as it is.
    """
    digits = F.regexp_replace(F.trim(flags), "^0[xX]", "")
    number = F.when(digits.rlike("^[0-9a-fA-F]+$"), F.conv(digits, 16, 10).try_cast("bigint"))
    return F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex(number))), flags)
