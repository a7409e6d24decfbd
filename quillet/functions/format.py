"""Formatters (value to text) and the encoding of text into cells."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.options import Options

Formatter = Callable[[Column], Column]


def _digits(n: int) -> Formatter:
    """n significant digits, exactly: no built-in function gives them, so values go to Python in Arrow batches."""

    def format_(v: Column) -> Column:
        @F.arrow_udf("string")
        def run(values: pa.Array) -> pa.Array:
            def text(x: float) -> str:
                if x != x or x in (float("inf"), float("-inf")):
                    return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
                return re.sub(r"e([+-])0*(\d{2,})$", r"E\1\2", f"{x:.{n}g}")

            return pa.array([None if x is None else text(x) for x in values.to_pylist()], pa.string())

        return run(v)

    return format_


def _timespan(v: Column) -> Column:
    size = F.when(v < F.expr("interval '0' second"), v * -1).otherwise(v)
    part = lambda p: F.extract(F.lit(p), size)
    micros = (part("SECOND") * 1000000).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    days = F.when(part("DAY") > 0, F.concat(part("DAY").cast("string"), F.lit("."))).otherwise("")
    fraction = F.when(micros % 1000000 > 0, F.concat(F.lit("."), F.lpad((micros % 1000000).cast("string"), 6, "0"), F.lit("0"))).otherwise("")
    sign = F.when(v < F.expr("interval '0' second"), "-").otherwise("")
    seconds = F.floor(micros / 1000000)
    return F.when(v.isNotNull(), F.concat(sign, days, two(part("HOUR")), F.lit(":"), two(part("MINUTE")), F.lit(":"), two(seconds), fraction))


def _plain(v: Column) -> Column:
    return v.cast("string")


def _decimal(v: Column) -> Column:
    """Without an exponent and without the zeros that a fixed scale adds."""
    text = F.regexp_replace(v.cast("string"), r"^-?0E-?\d+$", "0")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _datetime(v: Column) -> Column:
    """In UTC, whatever the session's zone: the time without a zone that lies as long after the epoch (one without a zone is taken as it is)."""
    micros = F.unix_micros(v.cast("timestamp"))
    day = 86_400_000_000
    since = F.make_dt_interval(F.floor(micros / day).cast("int"), F.lit(0), F.lit(0), (F.pmod(micros, F.lit(day)).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    wall = F.when(F.typeof(v) == "timestamp_ntz", v.cast("timestamp_ntz")).otherwise(F.lit("1970-01-01").cast("timestamp_ntz") + since)
    return F.concat(F.substring_index(wall.cast("string"), ".", 1), F.lit("Z"))


def _index(v: Column) -> Column:
    return F.concat(F.when(v["from_end"], "^").otherwise(""), v["value"].cast("string"))


FORMATTERS: dict[str, Formatter] = {k: _plain for k in ("string", "uri", "char", "guid", "byte", "sbyte", "short", "ushort", "int", "uint", "long", "ulong", "nint", "nuint")} | {
    "bool": lambda v: F.when(v, "True").when(~v, "False"),
    "float": _digits(9), "double": _digits(17), "decimal": _decimal,
    "datetime": _datetime, "datetimeoffset": _datetime,
    "timespan": _timespan,
    "version": lambda v: F.concat_ws(".", v["major"].cast("string"), v["minor"].cast("string"), v["build"].cast("string"), v["revision"].cast("string")),
    "index": _index, "range": lambda v: F.concat(_index(v["start"]), F.lit(".."), _index(v["end"])),
}


def formatter_of(kind: str) -> Formatter | None:
    return FORMATTERS.get("decimal" if kind.startswith("decimal(") else kind)


def enum(names: list[str]) -> Formatter:
    """A defined name, or an error."""
    return lambda v: F.when(v.isNull() | v.isin(*names), v).otherwise(F.raise_error(F.concat(F.lit("not a defined name: "), v)))


def flags(values: Mapping[str, int]) -> Formatter:
    """The one name of the whole value, else the names whose bits make it up, by value; bits without a name are an error."""

    def format_(v: Column) -> Column:
        exact = reduce(lambda c, x: c.when(v == x[1], x[0]), values.items(), F.when(v.isNull(), F.lit(None).cast("string")))
        single = sorted((i, n) for n, i in values.items() if i and not i & (i - 1))
        parts = F.concat_ws(", ", *(F.when(v.bitwiseAND(F.lit(i)) == i, n) for i, n in single))
        known = F.lit(sum(i for i, _ in single))
        return exact.when(v.bitwiseAND(known) == v, parts).otherwise(F.raise_error(F.lit("bits without a name")))

    return format_


def chain(*formatters: Formatter) -> Formatter:
    """The first formatter that gives a text."""
    return lambda v: F.coalesce(*(f(v) for f in formatters))


# --- cells -------------------------------------------------------------------------------------------------


def needs_encoding(v: Column, o: Options) -> Column:
    """Whether the text holds a row-ending character, the quote, the comment character or the whole separator."""
    special = "".join(re.escape(c) for c in ("\r", "\n", o.quote, o.comment) if c)
    return v.rlike(f"[{special}]") | v.contains(F.lit(o.separator))


def encode_cell(v: Column, o: Options, quote_empty: bool = False) -> Column:
    """The text as a cell: null as nothing, quoted where it has to be, an error where the dialect has no way to.

    An empty text is nothing, too, unless ``quote_empty``: quoted, it is no absent value where it ends the data.
    """
    empty = F.coalesce(v == "", F.lit(False))
    v = F.coalesce(v, F.lit(""))
    needs = needs_encoding(v, o) | empty if quote_empty else needs_encoding(v, o)
    if o.quote is None:
        # fixed messages, here and below
        message = "Tried to write a value which requires escaping, but no way to escape a value is configured: "
        return F.when(needs, F.raise_error(F.concat(F.lit(message), v))).otherwise(v)
    if o.escape is None:
        message = "Tried to write a value which requires escaping the quote in an escaped value, but no way to escape inside an escaped value is configured: "
        quoted = F.when(v.contains(F.lit(o.quote)), F.raise_error(F.concat(F.lit(message), v))).otherwise(v)
    else:
        quoted = F.replace(v, F.lit(o.quote), F.lit(o.escape + o.quote))
        if o.escape != o.quote:
            # the escape character itself too, else the text would not come back
            quoted = F.replace(F.replace(v, F.lit(o.escape), F.lit(o.escape * 2)), F.lit(o.quote), F.lit(o.escape + o.quote))
            needs = needs | v.startswith(F.lit(o.quote))
    return F.when(needs, F.concat(F.lit(o.quote), quoted, F.lit(o.quote))).otherwise(v)
