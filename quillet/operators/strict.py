"""A small table-driven reader: the independent check of ``tokenize``, and the one that knows what is wrong where.

It walks a text once. States are rows of a table, character classes its columns; a cell is (next state, action). Spark runs it in
Arrow batches, on the texts that ``tokenize`` refuses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillet.options import WHITESPACE, Options


class Malformed(ValueError):
    """The text breaks the dialect."""


def detect(text: str, o: Options) -> str:
    inside, i = False, 0
    while i < len(text):
        c = text[i]
        if inside and c == o.escape and o.escape != o.quote:
            i += 1
        elif c == o.quote:
            inside = not inside
        elif not inside and c == "\n":
            return "LF"
        elif not inside and c == "\r":
            return "CRLF" if text[i + 1 : i + 2] == "\n" else "CR"
        i += 1
    return "CRLF"


START, EMPTY, PLAIN, QUOTED, ESCAPED, CLOSED, TRAILING, COMMENT = range(8)
#: Fixed messages.
_BAD = {
    "quote": "Encountered '{c}', starting an escaped value, when already in a value",
    "escape": "Encountered '{c}' in an escape sequence, which is invalid",
    "end": "Encountered '{c}' when expecting the end of a record or value",
    "record": "Encountered '{c}' when expecting end of record",
}


def table(o: Options, ending: str) -> dict[tuple[int, str], tuple[int, str]]:
    """(state, class) -> (state, action). Actions: + keep the character, - skip it, v value ends, r record ends, c comment ends, ! and what is wrong."""
    own, other = {"LF": ("lf", "cr"), "CR": ("cr", "lf"), "CRLF": ("eol", "lf")}[ending]
    t: dict[tuple[int, str], tuple[int, str]] = {}

    def row(state: int, default: tuple[int, str], **cells: tuple[int, str]) -> None:
        for c in ("quote", "escape", "sep", "eol", "lf", "cr", "comment", "space", "char"):
            t[state, c] = cells.get(c, default)

    keep, bad_end = (PLAIN, "+"), (START, "!end")
    lone = {"cr": (START, "!record")} if ending == "CRLF" else {}
    space = (START, "-") if o.trim_before else keep
    row(START, keep, quote=(QUOTED, "-"), sep=(EMPTY, "v"), comment=(COMMENT, "-"), space=space, **{other: bad_end, **lone, own: (START, "r")})
    row(EMPTY, keep, quote=(QUOTED, "-"), sep=(EMPTY, "v"), space=(EMPTY, "-") if o.trim_before else keep, **{**lone, own: (START, "r")})
    row(PLAIN, keep, quote=(START, "!quote"), sep=(EMPTY, "v"), **{**lone, own: (START, "r")})
    row(QUOTED, (QUOTED, "+"), quote=(CLOSED, "-"), escape=(ESCAPED, "-"))
    row(ESCAPED, (START, "!escape"), quote=(QUOTED, "+"), escape=(QUOTED, "+"))
    after = (TRAILING, "-") if o.trim_after else bad_end
    row(TRAILING, bad_end, sep=(EMPTY, "v"), space=after, **{**lone, own: (START, "r")})
    row(CLOSED, bad_end, sep=(EMPTY, "v"), space=after, **{**lone, own: (START, "r")})
    if o.escape == o.quote and o.quote is not None:
        for c in ("lf", "cr", "eol", "comment", "space", "char"):
            if t[CLOSED, c] == bad_end:
                t[CLOSED, c] = (START, "!escape")
        t[CLOSED, "quote"] = (QUOTED, "+")
    row(COMMENT, (COMMENT, "+"), **{own: (START, "c")})
    return t


def _plain_runs(o: Options) -> dict[int, re.Pattern[str]]:
    """What a value, or a quoted one, goes on with whatever follows: no character that begins a quote, an escape, a separator or a row ending."""
    stops = {QUOTED: [o.quote, o.escape], PLAIN: [o.quote, o.escape, o.separator[0], "\r", "\n", o.comment, *(WHITESPACE if o.trims else ())]}
    return {state: re.compile(f"[^{''.join(re.escape(c) for c in own if c)}]*", re.DOTALL) if any(own) else re.compile(".*", re.DOTALL) for state, own in stops.items()}


def read(text: str, o: Options, ending: str | None = None) -> list[tuple[str, list[str] | None, str | None]]:
    """(kind, values, comment) of every record; raises ``Malformed``."""
    ending = ending or (detect(text, o) if o.read_ending == "DETECT" else o.read_ending)
    t, state, i = table(o, ending), START, 0
    out: list = []
    row: list[str] = []
    part: list[str] = []
    quoted = False

    def value() -> str:
        v = "".join(part)
        v = v.lstrip(WHITESPACE) if o.trim_leading_in else v
        return v.rstrip(WHITESPACE) if o.trim_trailing_in or (o.trim_after and not quoted) else v

    runs = _plain_runs(o)
    while i < len(text):
        # plain characters are kept in these states, all that follow each other at once
        if state in (PLAIN, QUOTED) and (end := runs[state].match(text, i).end()) > i:
            part.append(text[i:end])
            i = end
            continue
        c, size = text[i], 1
        if c == o.quote:
            kind = "quote"
        elif c == o.escape:
            kind = "escape"
        elif text.startswith(o.separator, i):
            kind, size = "sep", len(o.separator)
        elif ending == "CRLF" and text.startswith("\r\n", i):
            kind, size = "eol", 2
        else:
            kind = {"\r": "cr", "\n": "lf", o.comment: "comment"}.get(c) or ("space" if o.trims and c in WHITESPACE else "char")
        if kind == "escape" and state not in (QUOTED, ESCAPED):
            kind = "char"
        if state in (QUOTED, COMMENT, ESCAPED) and kind in ("sep", "eol") and t[state, kind][1] == "+":
            size = 1  # nothing but characters in here
        state, act = t[state, kind]
        if act == "+":
            part.append(text[i : i + size])
        elif act == "v":
            row.append(value())
            part, quoted = [], False
        elif act == "r":
            if part:
                row.append(value())
            out.append(("row", row, None))
            row, part, quoted = [], [], False
        elif act == "c":
            out.append(("comment", None, "".join(part)))
            part = []
        elif act[0] == "!":
            raise Malformed(_BAD[act[1:]].format(c=c))
        if state == QUOTED:
            quoted = True
        i += size
    if state in (QUOTED, ESCAPED):
        raise Malformed("Data ended unexpectedly")  # a fixed message
    if state == COMMENT:
        out.append(("comment", None, "".join(part)))
    elif state != START:
        if part or (state == CLOSED and o.quote == o.escape):
            row.append(value())
        out.append(("row", row, None))
    return out


def read_strict(texts: DataFrame, o: Options, text: str = "text", key: str = "source") -> DataFrame:
    """(key, position, kind, values, comment, error): all records of each text, or one row that says what is wrong.

    What the expressions cover is read by them; only a text that they refuse is walked through, for what is wrong in it. A null text is empty.
    """
    from quillet.operators.tokenize import well_formed
    from quillet.sources.reader import read_records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(k, i, *r, None) for i, r in enumerate(read(t, o))]
                except Malformed as e:
                    rows.append((k, 0, "error", None, None, str(e)))
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "position", "kind", "values", "comment", "error"])

    named = texts.select(F.col(key).cast("string").alias("source"), F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "^\ufeff", "").alias("text"))
    # refused texts count as empty here, which have no records: Spark may look for records before it filters
    fits = named.withColumn("text", F.when(well_formed(F.col("text"), o), F.col("text")).otherwise(""))
    good = read_records(fits, o).withColumn("error", F.lit(None).cast("string"))
    schema = "source string, position int, kind string, values array<string>, comment string, error string"
    bad = named.where(~well_formed(F.col("text"), o)).mapInArrow(run, schema)
    return good.unionByName(bad).withColumnRenamed("source", key)
