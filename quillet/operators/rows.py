"""Access to untyped rows: a row is an array of text cells, its header an array of names. Positions start at 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillet.functions.parse import Parser, type_code
from quillet.schema import Schema


def at(row: Column, index: int) -> Column:
    """The cell at a position: absent cells are null, positions beyond the row's width are an error."""
    return F.when((F.lit(index) >= 0) & (F.lit(index) < F.size(row)), F.get(row, F.lit(index))).otherwise(F.raise_error(F.concat(F.lit(f"expected index to be between 0 and the row's width, was {index}; width "), F.size(row).cast("string"))))


def from_end(row: Column, n: int) -> Column:
    """The n-th cell from the end, 1 being the last."""
    return F.when((F.lit(n) >= 1) & (F.lit(n) <= F.size(row)), F.try_element_at(row, F.lit(-n))).otherwise(F.raise_error(F.lit(f"no cell {n} from the end")))


def named(row: Column, header: Column, name: str) -> Column:
    """The cell under a name; a name that the header lacks is an error."""
    place = F.array_position(header, F.lit(name))
    return F.when(place > 0, F.get(row, (place - 1).cast("int"))).otherwise(F.raise_error(F.lit(f"no column named {name}")))


def identified(row: Column, header: Column | None, index: int, name: str | None = None) -> Column:
    """By name where both have names, else by position."""
    return named(row, header, name) if header is not None and name is not None else at(row, index)


def part(row: Column, start: int, stop: int | None = None) -> Column:
    """row[start:stop]; negative bounds count from the end; bounds outside the row are an error."""
    size = F.size(row)
    a = F.lit(start) if start >= 0 else size + start
    b = size if stop is None else F.lit(stop) if stop >= 0 else size + stop
    return F.when((a >= 0) & (b <= size) & (a <= b), F.slice(row, a + 1, b - a)).otherwise(F.raise_error(F.lit(f"range {start}..{stop} is outside the row")))


def convert(cell: Column, parser: Parser, name: str = "cell") -> Column:
    """A cell as a value: absent cells are null, text that can't be parsed is an error."""
    p = parser(cell)
    return F.when(cell.isNull(), None).when(p.ok, p.value).otherwise(F.raise_error(F.concat(F.lit('Failed to parse "'), cell, F.lit(f'" for {name}'))))


def code(cell: Column) -> Column:
    return type_code(cell)


def to_struct(row: Column, schema: Schema, header: Column | None = None, by_width: bool = False) -> Column:
    """A row as a struct: by the names of a header, else by position (a tuple).

    A row as wide as the schema is taken by position even with a header where ``by_width`` says so, as a constructor of that many parameters would.
    """
    made = lambda cell: F.struct(*(convert(cell(i, f), f.get_parser(), f.name).alias(f.name) for i, f in enumerate(schema.fields)))
    by_position, by_name = lambda i, f: at(row, i), lambda i, f: named(row, header, f.name)
    if header is None:
        return made(by_position)
    return F.when(F.size(row) == len(schema.fields), made(by_position)).otherwise(made(by_name)) if by_width else made(by_name)


def to_list(row: Column, parser: Parser) -> Column:
    """Every cell, parsed."""
    return F.transform(row, lambda c: convert(c, parser))


def first_converter(*converters: Column) -> Column:
    """A chain of row converters: the first that gives a value."""
    return F.coalesce(*converters)
