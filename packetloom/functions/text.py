"""Formatting, size classes and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names, smallest first.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")
RATE_UNITS = ("bps", "Kbps", "Mbps", "Gbps", "Tbps", "Pbps")


def fixed2(value: Column) -> Column:
    """Two decimals, ties of the exact binary value to even, as printf does.

    ``format_string`` rounds the shortest decimal text of a double instead, so
    2.675 (stored slightly lower) would come out one cent too high.  Here the
    fraction is scaled by a power of two, which is exact, and split in integers.
    """
    one = 1 << 55
    size = F.abs(value.cast("double"))
    whole = F.floor(size)
    cents = ((size - whole) * F.lit(float(one))).cast("bigint") * 100
    low = F.shiftright(cents, 55)
    rest = cents - low * one
    up = (rest > one // 2) | ((rest == one // 2) & (low % 2 == 1))
    rounded = low + F.when(up, 1).otherwise(0)
    carry = F.when(rounded == 100, 1).otherwise(0)
    return F.concat(F.when(value < 0, "-").otherwise(""), (whole + carry).cast("string"), F.lit("."),
                    F.lpad((rounded % 100).cast("string"), 2, "0"))


def _scaled(value: Column, step: float, units: tuple[str, ...]) -> Column:
    number = value.cast("double")
    power = F.lit(len(units) - 1)
    for k in reversed(range(len(units) - 1)):
        power = F.when(F.abs(number) < step ** (k + 1), k).otherwise(power)
    names = F.array(*[F.lit(u) for u in units])
    scale = F.array(*[F.lit(step ** k) for k in range(len(units))])
    return F.concat(fixed2(number / F.get(scale, power)), F.lit(" "), F.get(names, power))


def format_bytes(value: Column) -> Column:
    return _scaled(value, 1024.0, BYTE_UNITS)


def format_bps(value: Column) -> Column:
    return _scaled(value, 1000.0, RATE_UNITS)


def size_class(length: Column) -> Column:
    """Under 200 small, to 1000 medium, above large."""
    return F.when(length < 200, "small").when(length <= 1000, "medium").otherwise("large")


def parse_time(text: Column) -> Column:
    """ISO text to a UTC timestamp, null when unreadable."""
    return F.try_to_timestamp(text)


def local_hour(text: Column) -> Column:
    """Hour as written, i.e. in the offset the text carries; null when unreadable."""
    wall = F.regexp_replace(text, r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    return F.when(parse_time(text).isNotNull(), F.hour(F.try_to_timestamp(wall)))


def epoch_to_timestamp(text: Column, fallback: Column) -> Column:
    """Epoch seconds as text to UTC; ``fallback`` (the ingest time) when unreadable.

    The text goes through a decimal so that microseconds are not lost.
    """
    micros = (text.try_cast("decimal(28,9)") * 1000000).cast("bigint")
    return F.coalesce(F.timestamp_micros(micros), fallback)


def format_timestamp(text: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text in another pattern; unreadable input comes back unchanged."""
    return F.coalesce(F.date_format(parse_time(text), pattern), text)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def interval_seconds(freq: str) -> int:
    """Seconds of ``<n><unit>``; unknown text means one minute, an unknown unit one second."""
    import re

    seconds = {"s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "hr": 3600}
    match = re.match(r"^(\d+)?\s*([a-zA-Z]+)$", freq.strip())
    if not match:
        return 60
    return int(match.group(1) or 1) * seconds.get(match.group(2).lower(), 1)
