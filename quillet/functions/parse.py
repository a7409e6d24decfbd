"""Strict parsers: a text Column to (ok, value), without Spark's lenient casts."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.options import SPACE_CLASS, WHITESPACE


class Parsed(NamedTuple):
    """Whether the text could be parsed, and the value (null is legal where the parser allows it)."""

    ok: Column
    value: Column

    def otherwise(self, other: Parsed) -> Parsed:
        """A chain: the other parser where this one fails."""
        return Parsed(self.ok | other.ok, F.when(self.ok, self.value).otherwise(other.value))


Parser = Callable[[Column], Parsed]
_SPACES = SPACE_CLASS
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^(nan|-nan|[+-]?infinity)$"
#: Ranges and Spark types of the integers.
INTEGERS = {
    "byte": (0, 255, "smallint"), "sbyte": (-128, 127, "tinyint"), "short": (-(2**15), 2**15 - 1, "smallint"), "ushort": (0, 2**16 - 1, "int"),
    "int": (-(2**31), 2**31 - 1, "int"), "uint": (0, 2**32 - 1, "bigint"), "long": (-(2**63), 2**63 - 1, "bigint"), "ulong": (0, 2**64 - 1, "decimal(20,0)"),
    "nint": (-(2**63), 2**63 - 1, "bigint"), "nuint": (0, 2**64 - 1, "decimal(20,0)"),
}
_UNSIGNED = {"ushort", "uint", "ulong", "nuint"}
_OFFSET, _TIME = r"(Z|[+-][0-9]{2}([0-9]{2})?)", r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
#: Date-time shapes that are read (a documented subset of what is culturally possible): a regular expression that tells them apart, and the pattern.
#: Without an offset they are UTC, whatever the session's zone.
DATETIME_PATTERNS = (
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_TIME}{_OFFSET}$", "yyyy-MM-dd HH:mm:ssX"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_TIME}$", "yyyy-MM-dd HH:mm:ss"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}{_OFFSET}$", "yyyy-MM-dd'T'HH:mm:ssX"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}\.[0-9]{{3}}{_OFFSET}$", "yyyy-MM-dd'T'HH:mm:ss.SSSX"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}\.[0-9]{{6}}{_OFFSET}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSX"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}\.[0-9]{{3}}$", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T{_TIME}\.[0-9]{{6}}$", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    (rf"^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} {_TIME}\.[0-9]{{6}}$", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}$", "yyyy-MM-dd HH:mm"),
    (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4} [0-9]{1,2}:[0-9]{2}:[0-9]{2}$", "M/d/yyyy H:mm:ss"),
    (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$", "M/d/yyyy"),
)


def _string(v: Column) -> Parsed:
    return Parsed(v.isNotNull(), v)


def _bool(v: Column) -> Parsed:
    t = F.lower(F.btrim(v, F.lit(WHITESPACE)))
    return Parsed(t.isin("true", "false"), t == "true")


def _char(v: Column) -> Parsed:
    # one UTF-16 unit: a character outside the basic plane is two
    return Parsed((F.char_length(v) == 1) & (F.octet_length(v) < 4), v)


def _integer(kind: str) -> Parser:
    low, high, spark_type = INTEGERS[kind]

    wide = "bigint" if high < 2**63 else "decimal(38,0)"

    def parse(v: Column) -> Parsed:
        n = v.try_cast(wide)
        ok = v.rlike("^[0-9]+$" if kind in _UNSIGNED else "^[+-]?[0-9]+$") & n.isNotNull()
        if (low, high) != (-(2**63), 2**63 - 1):
            ok = ok & n.between(F.lit(str(low)).cast(wide), F.lit(str(high)).cast(wide))
        return Parsed(F.coalesce(ok, F.lit(False)), F.when(ok, n).try_cast(spark_type))

    return parse


def _floating(spark_type: str) -> Parser:
    def parse(v: Column) -> Parsed:
        special = F.when(F.lower(v).contains("nan"), float("nan")).when(v.startswith("-"), float("-inf")).otherwise(float("inf"))
        ok = v.rlike(_NUMBER) | v.rlike(_SPECIAL)
        return Parsed(F.coalesce(ok, F.lit(False)), F.when(v.rlike(_NUMBER), v.try_cast(spark_type)).when(v.rlike(_SPECIAL), special.cast(spark_type)))

    return parse


def _decimal(spark_type: str) -> Parser:
    def parse(v: Column) -> Parsed:
        n = F.when(v.rlike(_NUMBER), v).try_cast(spark_type)
        return Parsed(n.isNotNull(), n)

    return parse


def _datetime(v: Column) -> Parsed:
    # one regular expression chooses the pattern: only that one is tried
    t = None
    for shape, pattern in DATETIME_PATTERNS:
        zoned = pattern.endswith("X")
        found = F.try_to_timestamp(v if zoned else F.concat(v, F.lit("Z")), F.lit(pattern if zoned else f"{pattern}X"))
        t = F.when(v.rlike(shape), found) if t is None else t.when(v.rlike(shape), found)
    return Parsed(t.isNotNull(), t)


def _timespan(v: Column) -> Parsed:
    shape = rf"^{_SPACES}*(-?)(?:([0-9]{{1,8}})\.)?([0-9]{{1,2}}):([0-9]{{1,2}})(?::([0-9]{{1,2}})(?:\.([0-9]{{1,7}}))?)?{_SPACES}*$"
    days = rf"^{_SPACES}*-?([0-9]{{1,8}}){_SPACES}*$"
    # all groups by one match; what an end of line leaves behind it stands after the last comma
    groups = F.split(F.regexp_replace(v, shape, "$1,$2,$3,$4,$5,$6,"), ",")
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    part = lambda i: number(F.get(groups, F.lit(i - 1)))
    fraction = F.rpad(F.substring(F.get(groups, F.lit(5)), 1, 6), 6, "0").try_cast("int")
    seconds = (part(5) + F.coalesce(fraction, F.lit(0)) / 1000000).cast("decimal(18,6)")
    full = v.rlike(shape) & (part(3) < 24) & (part(4) < 60) & (part(5) < 60)
    size = F.when(full, F.make_dt_interval(part(2), part(3), part(4), seconds)).when(v.rlike(days), F.make_dt_interval(number(F.regexp_extract(v, days, 1))))
    return Parsed(size.isNotNull(), F.when(v.rlike(rf"^{_SPACES}*-"), size * -1).otherwise(size))


def _guid(v: Column) -> Parsed:
    t = F.btrim(v, F.lit(WHITESPACE))
    h = "[0-9A-Fa-f]"
    d = f"{h}{{8}}-{h}{{4}}-{h}{{4}}-{h}{{4}}-{h}{{12}}"
    x = rf"^\{{0x{h}{{1,8}},0x{h}{{1,4}},0x{h}{{1,4}},\{{(?:0x{h}{{1,2}},){{7}}0x{h}{{1,2}}\}}\}}$"
    padded = F.transform(F.regexp_extract_all(t, F.lit(f"0x({h}+)"), 1), lambda p, i: F.lpad(p, F.when(i == 0, 8).when(i < 3, 4).otherwise(2), F.lit("0")))
    plain = t.rlike(rf"^({h}{{32}}|{d}|\{{{d}\}}|\({d}\))$")
    digits = F.lower(F.when(plain, F.regexp_replace(t, "[^0-9A-Fa-f]", "")).when(t.rlike(x), F.array_join(padded, "")))
    value = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return Parsed(value.isNotNull(), value)


def _version(v: Column) -> Parsed:
    p = F.split(v, r"\.")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(4)]
    fits = reduce(lambda a, b: a & b, (F.get(p, F.lit(i)).isNull() | n[i].isNotNull() for i in range(4)))
    ok = F.coalesce(v.rlike(r"^[0-9]+(\.[0-9]+){1,3}$") & fits, F.lit(False))
    return Parsed(ok, F.when(ok, F.struct(*(x.alias(k) for x, k in zip(n, ("major", "minor", "build", "revision"), strict=True)))))


def _index(v: Column) -> Parsed:
    n = _integer("int")(F.regexp_replace(v, r"^\^", ""))
    ok = n.ok & (n.value >= 0)
    return Parsed(F.coalesce(ok, F.lit(False)), F.when(ok, F.struct(n.value.alias("value"), v.startswith("^").alias("from_end"))))


def _range(v: Column) -> Parsed:
    shape = r"^([^.]*)\.\.(.*)$"
    start, end = F.regexp_extract(v, shape, 1), F.regexp_extract(v, shape, 2)
    a, b = _index(start), _index(end)
    whole = lambda end: F.struct(F.lit(0).alias("value"), F.lit(end).alias("from_end"))
    ok = v.rlike(shape) & ((start == "") | a.ok) & ((end == "") | b.ok)
    return Parsed(F.coalesce(ok, F.lit(False)), F.when(ok, F.struct(F.when(start == "", whole(False)).otherwise(a.value).alias("start"), F.when(end == "", whole(True)).otherwise(b.value).alias("end"))))


PARSERS: dict[str, Parser] = {
    "string": _string, "uri": _string, "bool": _bool, "char": _char, "float": _floating("float"), "double": _floating("double"), "decimal": _decimal("decimal(38,18)"),
    "datetime": _datetime, "datetimeoffset": _datetime, "timespan": _timespan, "guid": _guid, "version": _version, "index": _index, "range": _range,
} | {k: _integer(k) for k in INTEGERS}


def parser_of(kind: str) -> Parser | None:
    """The parser of a kind; ``decimal(38,s)`` says how many of the digits follow the point (28 digits before it need s to be 10 or less)."""
    return _decimal(kind) if re.fullmatch(r"decimal\([0-9]+, ?[0-9]+\)", kind) else PARSERS.get(kind)


def enum(names: Mapping[str, int] | list[str]) -> Parser:
    """Names in any case; numbers are refused."""

    def parse(v: Column) -> Parsed:
        table = F.create_map(*(F.lit(x) for n in names for x in (n.lower(), n)))
        found = F.try_element_at(table, F.lower(v))
        return Parsed(found.isNotNull(), found)

    return parse


def flags(values: Mapping[str, int]) -> Parser:
    """A comma list of names, or-ed; empty text is 0."""

    def parse(v: Column) -> Parsed:
        table = F.create_map(*(x for n, i in values.items() for x in (F.lit(n.lower()), F.lit(i).cast("long"))))
        bits = F.transform(F.split(F.lower(v), ","), lambda n: F.try_element_at(table, F.btrim(n, F.lit(WHITESPACE))))
        total = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
        return Parsed((v == "") | total.isNotNull(), F.when(v == "", F.lit(0).cast("long")).otherwise(total))

    return parse


def nullable(parser: Parser) -> Parser:
    """Empty text is null; whatever else fails still fails."""

    def parse(v: Column) -> Parsed:
        p = parser(v)
        return Parsed((v == "") | p.ok, F.when(v != "", p.value))

    return parse


def chain(*parsers: Parser) -> Parser:
    """The first parser that succeeds."""
    return lambda v: reduce(lambda a, b: a.otherwise(b), (p(v) for p in parsers))


#: The order in which a cell's type is looked for.
TYPE_LADDER = ("bool", "datetime", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "double", "char")


def type_code(v: Column) -> Column:
    """The first type of the ladder that the text parses as; ``string`` if none, ``empty`` for an absent cell."""
    out = F.when(v.isNull(), "empty")
    for kind in TYPE_LADDER:
        out = out.when(PARSERS[kind](v).ok, kind)
    return out.otherwise("string")
