"""Format-preserving pseudonyms by keyed Feistel networks, in DataFrame functions only.

Numbers and dates that pass validation are permuted within their format: a card
number stays a card number with a right check digit, a date a date. The
permutation depends on the key and the value alone, so equal values stay linked
across documents and different values stay different. Each half of a value is
shifted by a keyed hash of the other half, eight times, modulo the size of its
own range; every range is a product, so nothing has to be walked or drawn again.

Dates are permuted among those of their class: days 1 to 9, 10 to 12, 13 to 28
or 29 to 31 of the months January to September or October to December. So a
date keeps its length in every writing, a month-first date stays one that can
only be read so, and one date has one pseudonym in all writings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, text_or_empty

ROUNDS = 8
#: The default key of the registered query; callers pass their own.
DEMO_KEY = "demonstration key"

#: Candidates by kind, in the order in which they are tried at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,2}[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9])",
}
KINDS = tuple(PATTERNS)
ANY = "|".join(PATTERNS.values())
#: Dates of these years can be permuted.
FIRST_YEAR, YEARS = 1800, 400
#: Bands of days and months that keep their width in writing: the first one, and how many.
DAY_BANDS, MONTH_BANDS = ((1, 9), (10, 3), (13, 16)), ((1, 9), (10, 3))


def _keyed(key: str, *parts: Column) -> Column:
    """A 60-bit number from the key and the parts."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, key: str, tweak: Column) -> Column:
    """struct<a, b>: a permutation of range(size_a) x range(size_b) under the key and tweak."""

    def turn(x: Column, i: Column) -> Column:
        first = F.when(i % 2 == 0, F.pmod(x["a"] + _keyed(key, tweak, i, x["b"]) % size_a, size_a)).otherwise(x["a"])
        second = F.when(i % 2 == 1, F.pmod(x["b"] + _keyed(key, tweak, i, x["a"]) % size_b, size_b)).otherwise(x["b"])
        return F.struct(first.alias("a"), second.alias("b"))

    begin = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[_big(10**i) for i in range(10)]), n + 1)


def _digits(n: Column, width: Column | int) -> Column:
    return F.lpad(n.cast("string"), width if isinstance(width, Column) else F.lit(width), F.lit("0"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Digits from the right, every second one doubled; doubled_from 1 doubles the last one itself."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(n + 1 - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == doubled_from % 2, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _numbers(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _day(m: Column) -> Column:
    """The date that m writes: year first, else day first if that is a date, else month first."""
    part = lambda i: F.regexp_extract(m, r"^([0-9]+)[./-]([0-9]+)[./-]([0-9]+)$", i)
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))
    return F.when(m.rlike("^[0-9]{4}-"), iso).otherwise(
        F.coalesce(
            F.try_to_timestamp(F.concat_ws("-", part(3), F.lpad(part(2), 2, "0"), F.lpad(part(1), 2, "0")), F.lit("yyyy-MM-dd")),
            F.try_to_timestamp(F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")), F.lit("yyyy-MM-dd")),
        )
    ).cast("date")


def _late_days(first_month: int, n_months: int) -> list[str]:
    """The days 29 to 31 of these months that all years have, as MM-dd."""
    return [f"{m:02}-{d}" for m in range(first_month, first_month + n_months) for d in range(29, 1 + (30 if m in (4, 6, 9, 11) else 28 if m == 2 else 31))]


_LEAP = [y for y in range(FIRST_YEAR, FIRST_YEAR + YEARS) if y % 4 == 0 and (y % 100 or y % 400 == 0)]


def _factors(n: int) -> tuple[int, int]:
    """n as a product of two numbers, as near to each other as may be."""
    a = max(x for x in range(1, int(n**0.5) + 1) if n % x == 0)
    return a, n // a


def permuted_date(day: Column, net: Callable[..., Column]) -> Column:
    """The date (as yyyy-MM-dd) that stands for a date of the years that can be permuted."""
    year, month, d = (f(day).cast("bigint") for f in (F.year, F.month, F.dayofmonth))
    year = year - FIRST_YEAR
    two = lambda n: F.lpad(n.cast("bigint").cast("string"), 2, "0")
    written = lambda y, rest: F.concat_ws("-", (y + FIRST_YEAR).cast("bigint").cast("string"), rest)

    def within(index: Column, size: int, tweak: str, write: Callable[[Column], Column]) -> Column:
        a, b = _factors(size)
        mixed = net(F.floor(index / b), index % b, _big(a), _big(b), F.lit(tweak))
        return _let(mixed, lambda r: _let(r["a"] * b + r["b"], write))

    def regular(m0: int, nm: int, d0: int, nd: int) -> Column:
        index = (year * nm + month - m0) * nd + d - d0
        return within(index, YEARS * nm * nd, f"{m0}:{d0}", lambda x: written(F.floor(x / (nm * nd)), F.concat_ws("-", two(F.floor(x / nd) % nm + m0), two(x % nd + d0))))

    def late(m0: int, nm: int) -> Column:
        slots = _late_days(m0, nm)
        leap = _LEAP if m0 <= 2 else []
        every = F.array(*[F.lit(x) for x in slots])
        most = YEARS * len(slots)
        index = year * len(slots) + F.array_position(every, F.date_format(day, "MM-dd")) - 1
        write = lambda x: written(F.floor(x / len(slots)), F.element_at(every, (x % len(slots) + 1).cast("int")))
        if not leap:
            return within(index, most, f"{m0}:29", write)
        years = F.array(*[F.lit(y - FIRST_YEAR).cast("bigint") for y in leap])
        index = F.when((month == 2), most + F.array_position(years, year) - 1).otherwise(index)
        either = lambda x: F.when(x < most, write(x)).otherwise(written(F.element_at(years, F.greatest(x - most + 1, F.lit(1)).cast("int")), F.lit("02-29")))
        return within(index, most + len(leap), f"{m0}:29", either)

    out = None
    for m0, nm in MONTH_BANDS:
        in_month = month.between(m0, m0 + nm - 1)
        for d0, nd in DAY_BANDS:
            here, value = in_month & d.between(d0, d0 + nd - 1), regular(m0, nm, d0, nd)
            out = F.when(here, value) if out is None else out.when(here, value)
        out = out.when(in_month, late(m0, nm))
    return out


def kind_of(m: Column) -> Column:
    """The kind of a candidate that passes validation, else null."""
    anchored = lambda k: m.rlike("^(?:" + PATTERNS[k].replace(r"\2", r"\1") + ")$")
    ssn = (~m.rlike("^(?:000|666|9)")) & (~m.rlike("^[0-9]{3}-00")) & (~m.rlike("0000$"))
    return (
        F.when(m.contains("@"), F.lit("email"))
        .when(anchored("ip"), F.when(F.forall(F.split(m, r"\."), lambda o: (o.cast("int") < 256) & ~o.rlike("^0[0-9]")), F.lit("ip")))
        .when(anchored("date"), F.when(F.year(_day(m)).between(FIRST_YEAR, FIRST_YEAR + YEARS - 1), F.lit("date")))
        .when(anchored("phone"), F.lit("phone"))
        .when(anchored("ssn"), F.when(ssn, F.lit("ssn")))
        .when(luhn_sum(_numbers(m), 0) % 10 == 0, F.lit("card"))
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """What stands for the validated value m of a kind.

    Numbers and dates are permuted within their format. A mail address keeps its
    domain; its local part, of any length, becomes 80 bits of a keyed hash, which
    links equal addresses but is no permutation.
    """
    net = lambda a, b, size_a, size_b, tweak=None: feistel(a, b, size_a, size_b, key, kind if tweak is None else F.concat_ws(":", kind, tweak))

    email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), m), 256), 1, 20), F.lit("@"), F.substring_index(m, "@", -1))

    octet = lambda i: F.element_at(F.split(m, r"\."), i).cast("bigint")
    ip = _let(
        net(octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), _big(65536), _big(65536)),
        lambda r: F.concat_ws(".", *[x.cast("bigint").cast("string") for x in (F.floor(r["a"] / 256), r["a"] % 256, F.floor(r["b"] / 256), r["b"] % 256)]),
    )

    def write_date(new: Column) -> Column:
        sep = F.regexp_extract(m, "^[0-9]+([./-])", 1)
        one, two = (F.element_at(F.split(m, "[./-]"), i) for i in (1, 2))
        y, mo, d = (F.element_at(F.split(new, "-"), i) for i in (1, 2, 3))
        day_first = F.try_to_timestamp(F.concat_ws("-", F.regexp_extract(m, "[0-9]+$", 0), F.lpad(two, 2, "0"), F.lpad(one, 2, "0")), F.lit("yyyy-MM-dd")).isNotNull()
        narrow = lambda field, like: F.when(F.length(like) == 1, field.cast("int").cast("string")).otherwise(field)
        first, second = F.when(day_first, d).otherwise(mo), F.when(day_first, mo).otherwise(d)
        return F.when(sep == "-", new).otherwise(F.concat(narrow(first, one), sep, narrow(second, two), sep, y))

    date = _let(_day(m), lambda day: _let(permuted_date(day, net), write_date))

    ten = F.substring(_numbers(m), -10, 10)

    def write_phone(r: Column) -> Column:
        new = F.concat(_digits(r["a"], 5), _digits(r["b"], 5))
        group = lambda i: F.regexp_extract(m, r"^(.*?)([0-9]{3})([^0-9]*)([0-9]{3})([^0-9]*)([0-9]{4})$", i)
        return F.concat(group(1), F.substring(new, 1, 3), group(3), F.substring(new, 4, 3), group(5), F.substring(new, 7, 4))

    phone = _let(net(F.substring(ten, 1, 5), F.substring(ten, 6, 5), _big(10**5), _big(10**5)), write_phone)

    # areas 1 to 899 without 666; groups 1 to 99; serials 1 to 9999
    area = F.substring(m, 1, 3).cast("bigint")
    area = F.when(area > 666, area - 2).otherwise(area - 1)
    rest = (F.substring(m, 5, 2).cast("bigint") - 1) * 9999 + F.substring(m, 8, 4).cast("bigint") - 1

    def write_ssn(r: Column) -> Column:
        new = F.when(r["a"] >= 665, r["a"] + 2).otherwise(r["a"] + 1)
        return F.concat_ws("-", _digits(new, 3), _digits((F.floor(r["b"] / 9999) + 1).cast("bigint"), 2), _digits(r["b"] % 9999 + 1, 4))

    ssn = _let(net(area, rest, _big(898), _big(99 * 9999)), write_ssn)

    def card_of(s: Column) -> Column:
        middle = F.length(s) - 2
        u = F.floor(middle / 2).cast("int")
        v = middle - u

        def write(r: Column) -> Column:
            payload = F.concat(F.substring(s, 1, 1), _digits(r["a"], u), _digits(r["b"], v))
            whole = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
            gap = F.regexp_extract(m, "^[0-9]{4}([ -])", 1)
            return F.when(gap == "", whole).otherwise(F.regexp_replace(whole, F.lit("([0-9]{4})(?=[0-9])"), F.concat(F.lit("$1"), gap)))

        return _let(net(s.substr(F.lit(2), u), s.substr(u + 2, v), _ten(u), _ten(v), F.concat(F.length(s).cast("string"), F.substring(s, 1, 1))), write)

    card = _let(_numbers(m), card_of)

    out = m
    for name, new in (("email", email), ("ip", ip), ("date", date), ("phone", phone), ("ssn", ssn), ("card", card)):
        out = F.when(kind == name, new).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", report: str = "pii") -> DataFrame:
    """docs with text_col rewritten and a column `report`: array<struct<kind, value>> of what was replaced.

    A null text stays null; its report is empty. Candidates that fail validation stay
    as they are. Values found twice in a text are replaced twice; candidates that
    overlap are taken from the left, the first listed kind of those at one place.
    Repeated rows each get the same text, a very long text is rewritten in the row
    that holds it, an empty table gives no rows. A column of docs with the name of
    the report gives way to it.
    """
    pii = "array<struct<kind:string,value:string>>"
    text = text_or_empty(text_col)
    found = F.when(text.rlike(ANY), F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("value")))).otherwise(F.array().cast(pii))
    marked = docs.drop(report).withColumn(report, found)
    some = F.exists(F.col(f"`{report}`"), lambda x: x["kind"].isNotNull())
    new = F.transform(F.col(f"`{report}`"), lambda x: F.when(x["kind"].isNull(), x["value"]).otherwise(pseudonym(x["value"], x["kind"], key)))
    mended = F.array_join(F.flatten(F.zip_with(F.split(text, ANY, -1), new, lambda piece, x: F.array(piece, F.coalesce(x, F.lit(""))))), "")
    out = marked.withColumn(text_col, F.when(some, mended).otherwise(F.col(text_col)))
    return out.withColumn(report, F.filter(F.col(f"`{report}`"), lambda x: x["kind"].isNotNull()))


def op2_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), DEMO_KEY)
    count = lambda kind: F.size(F.filter("pii", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", "text", *[count(k) for k in KINDS], F.size("pii").cast("long").alias("n_pii"))
