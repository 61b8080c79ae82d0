"""Format-preserving pseudonyms: validated numbers and dates go through a keyed Feistel permutation of their own format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import bind, fresh, text_or_empty

ROUNDS = 8
# 400 years are 146 097 = 189 * 773 days, so dates from here on split evenly into two halves.
FIRST_DAY, DAY_LEFT, DAY_RIGHT = "1800-01-01", 189, 773

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    # a host name has 253 characters at most, so 127 labels; the bound also keeps the search flat
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+){0,125}\\.[A-Za-z]{2,}",
    "ip": f"(?:{_OCTET}\\.){{3}}{_OCTET}",
    "date": "[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    # ten digits in phone form, as one run if they begin with 2 to 9, and + with any country's number
    "phone": "(?:\\+?1[ .-]?)?(?:\\([0-9]{3}\\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})|1?[2-9][0-9]{9}|\\+[1-9](?:[ .()/-]{0,2}[0-9]){7,14}",
    "card": "[0-9](?:[ -]?[0-9]){12,18}",
}
# borders keep the search linear: no value begins or ends inside a longer run; dates and
# addresses may also be followed by a hyphen, begin after one of their kind, and a date end at a time
_BEFORE, _AFTER = "(?<![A-Za-z0-9._%+@-])", "(?![A-Za-z0-9@]|[.-][0-9])"
_AFTERS = {"ip": "(?![A-Za-z0-9@]|[.][0-9])", "date": "(?![A-SU-Za-z0-9@]|T(?![0-9])|[.][0-9])"}
_RANGE = {"ip": "(?:(?<=[.][0-9]-)|(?<=[.][0-9]{2}-)|(?<=[.][0-9]{3}-))",
          "date": "(?:(?<=[0-9]{4}-[0-9]{2}-[0-9]{2}-)|(?<=[0-9]{2}[.][0-9]{2}[.][0-9]{4}-)|(?<=[0-9]{2}/[0-9]{2}/[0-9]{4}-))"}
ANY = "|".join([_BEFORE + "(?:" + "|".join(f"(?:{p}){_AFTERS.get(k, _AFTER)}" for k, p in PATTERNS.items()) + ")",
                *[f"{_RANGE[k]}(?:{PATTERNS[k]}){_AFTERS[k]}" for k in _RANGE]])


def _round(key: str, tag: Column, number: Column, half: Column, size: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), tag, number, half), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: Column) -> Column:
    """(l, r): a keyed permutation of all pairs below the two sizes.

    Each round adds a keyed hash of one half to the other, modulo its size, which is undone
    by subtracting; so no two values get the same pseudonym and none leaves the range.
    """
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(halves: Column, number: Column) -> Column:
        return F.when(number % 2 == 0, F.struct(((halves["l"] + _round(key, tag, number, halves["r"], left_size)) % left_size).alias("l"), halves["r"].alias("r"))).otherwise(
            F.struct(halves["l"].alias("l"), ((halves["r"] + _round(key, tag, number, halves["l"], right_size)) % right_size).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _part(d: Column, at, size) -> Column:
    return F.substring(d, F.lit(at) if isinstance(at, int) else at, F.lit(size) if isinstance(size, int) else size)


def _padded(value: Column, width) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0") if isinstance(width, Column) else "0")


def _refilled(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order, everything between them as it was."""
    filled = F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(acc["out"], _part(digits, acc["at"], 1)).alias("out"), (acc["at"] + 1).alias("at"))).otherwise(
        F.struct(F.concat(acc["out"], c).alias("out"), acc["at"].alias("at"))))
    return filled["out"]


def luhn_sum(d: Column) -> Column:
    """Sum of the digits, every second from the right doubled."""
    def add(acc: Column, i: Column) -> Column:
        return bind(_part(d, F.length(d) - i + 1, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: acc + F.when(x > 9, x - 9).otherwise(x))
    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(d: Column, key: str) -> Column:
    """The first digit stays, the last is the check digit of the rest."""
    n = F.length(d) - 2
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")
    halves = feistel(_part(d, 2, u), _part(d, u + 2, n - u), size(u), size(n - u), key, F.concat(F.lit("card"), F.length(d)))
    body = bind(halves, lambda h: F.concat(_part(d, 1, 1), _padded(h["l"], u), _padded(h["r"], n - u)))
    return bind(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))


def _phone(m: Column, d: Column, key: str) -> Column:
    """Three sets of ten digits, each permuted in itself: valid North American codes (both begin with 2 to 9), small area codes, small exchange codes.

    A leading 1 stays.  Of other countries' numbers the country code stays and the rest is
    permuted among those of its length.
    """
    local = F.substring(d, -10, 10)
    area, rest = _part(local, 1, 3).cast("int"), _part(local, 4, 7).cast("int")

    def made(area_from: int, rest_from: int, areas: int, rests: int, tag: str) -> Column:
        halves = feistel(area - area_from, rest - rest_from, F.lit(areas), F.lit(rests), key, F.lit(tag))
        return bind(halves, lambda h: F.concat(_part(d, F.lit(1), F.length(d) - 10), _padded(h["l"] + area_from, 3), _padded(h["r"] + rest_from, 7)))
    return F.when(m.startswith("+") & ~d.rlike("^1[0-9]{10}$"), _abroad(d, key)).when(area < 200, made(0, 0, 200, 10_000_000, "phone-area")).when(
        rest < 2_000_000, made(200, 0, 800, 2_000_000, "phone-exchange")).otherwise(made(200, 2_000_000, 800, 8_000_000, "phone"))


_COUNTRY = "^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _abroad(d: Column, key: str) -> Column:
    size = lambda k: F.pow(F.lit(10.0), k).cast("bigint")

    def of(code: Column) -> Column:
        n, at = F.length(d) - F.length(code), F.length(code) + 1
        u = F.floor(n / 2).cast("int")
        halves = feistel(_part(d, at, u), _part(d, at + u, n - u), size(u), size(n - u), key, F.concat_ws("-", F.lit("phone"), code, n.cast("string")))
        return bind(halves, lambda h: F.concat(code, _padded(h["l"], u), _padded(h["r"], n - u)))
    return bind(F.regexp_extract(d, _COUNTRY, 0), of)


def _ssn(d: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001; null for others."""
    area, group, serial = _part(d, 1, 3).cast("int"), _part(d, 4, 2).cast("int"), _part(d, 6, 4).cast("int")
    halves = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    made = bind(halves, lambda h: F.concat(_padded(h["l"] + F.when(h["l"] >= 665, 2).otherwise(1), 3), _padded(F.floor(h["r"] / 9999) + 1, 2), _padded(h["r"] % 9999 + 1, 4)))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), made)


def _ip(m: Column, key: str) -> Column:
    return bind(F.split(m, "\\."), lambda o: bind(
        feistel(F.get(o, 0).cast("int") * 256 + F.get(o, 1).cast("int"), F.get(o, 2).cast("int") * 256 + F.get(o, 3).cast("int"), F.lit(65536), F.lit(65536), key, F.lit("ip")),
        lambda h: F.concat_ws(".", *[F.floor(h[c] / 256 if high else h[c] % 256).cast("string") for c in "lr" for high in (True, False)])))


def _date(m: Column, key: str) -> Column:
    """A day of the same 400 years in the same form; null where there is no such day."""
    iso, dots = m.rlike("^[0-9]{4}-"), m.contains(".")
    day = F.when(iso, m).when(dots, F.concat_ws("-", _part(m, 7, 4), _part(m, 4, 2), _part(m, 1, 2))).otherwise(F.concat_ws("-", _part(m, 7, 4), _part(m, 1, 2), _part(m, 4, 2)))
    index = F.datediff(day.try_cast("date"), F.lit(FIRST_DAY).cast("date"))

    def made(i: Column) -> Column:
        halves = feistel(F.floor(i / DAY_RIGHT), i % DAY_RIGHT, F.lit(DAY_LEFT), F.lit(DAY_RIGHT), key, F.lit("date"))
        return bind(halves, lambda h: bind(F.date_add(F.lit(FIRST_DAY).cast("date"), (h["l"] * DAY_RIGHT + h["r"]).cast("int")).cast("string"), lambda s: F.when(iso, s).when(
            dots, F.concat_ws(".", _part(s, 9, 2), _part(s, 6, 2), _part(s, 1, 4))).otherwise(F.concat_ws("/", _part(s, 6, 2), _part(s, 9, 2), _part(s, 1, 4)))))
    return bind(index, lambda i: F.when(i.between(0, DAY_LEFT * DAY_RIGHT - 1), made(i)))


def _email(m: Column, key: str) -> Column:
    """The name before the at sign becomes a keyed one, the domain stays."""
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), F.regexp_extract(m, "@.*$", 0))


def pseudonym(m: Column, key: str) -> Column:
    """(kind, value) of a match; both null where it is not valid in any format."""
    d = _digits(m)
    full = lambda kind: m.rlike("^(?:" + PATTERNS[kind] + ")$")
    options = [("email", full("email"), _email(m, key)), ("ip", full("ip"), _ip(m, key)), ("date", full("date"), _date(m, key)),
               ("ssn", full("ssn"), bind(d, lambda x: _refilled(m, _ssn(x, key)))), ("phone", full("phone"), bind(d, lambda x: _refilled(m, _phone(m, x, key)))),
               ("card", full("card") & bind(d, lambda x: luhn_sum(x) % 10 == 0), bind(d, lambda x: _refilled(m, _card(x, key))))]
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("value"))
    for kind, fits, value in reversed(options):
        out = F.when(fits, _named(kind, value)).otherwise(out)
    return out


def _named(kind: str, value: Column) -> Column:
    return bind(value, lambda v: F.struct(F.when(v.isNotNull(), kind).alias("kind"), v.alias("value")))


def pseudonymize(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``pii``: the array of (kind, value) put in, in order.

    Numbers that pass their own check (Luhn for cards, valid ranges for social security
    numbers and addresses, existing days for dates) are permuted within their format by
    ``key``, and so are phone numbers: any ten digits in phone form, ten digits from 2 on or
    after +1 as one run, and + with 8 to 15 digits.  Digits in other numbers, and
    invalid ones, stay.  Equal values get
    equal pseudonyms in all documents however their digits are grouped, and different
    values different ones, but for names of e-mail addresses, which become keyed 48-bit
    hashes.  Dates outside 1800 to 2199 and social security areas from 900 stay.  A null text stays null with no findings.  Row by row, without
    a shuffle; other columns stay, one named ``pii`` is replaced.
    """
    whole = text_or_empty(text)
    matches, named = fresh(docs, "matches", "named")
    found = F.when(whole.rlike("[0-9@]"), F.regexp_extract_all(whole, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn(matches, found).withColumn(named, F.transform(matches, lambda m: pseudonym(m, key)))
    put = F.concat(F.transform(F.arrays_zip(F.col(named).getField("value").alias("v"), F.col(matches).alias("m")), lambda x: F.coalesce(x["v"], x["m"])), F.array(F.lit("")))
    rebuilt = F.array_join(F.flatten(F.zip_with(F.split(F.col(text), ANY), put, lambda gap, new: F.array(gap, new))), "")
    return marked.withColumn(text, F.when(F.size(matches) > 0, rebuilt).otherwise(F.col(text))).withColumn(
        "pii", F.filter(named, lambda p: p["kind"].isNotNull())).select(*[c for c in docs.columns if c != "pii"], "pii")
