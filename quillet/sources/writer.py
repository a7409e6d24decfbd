"""DataFrames to delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions.format import FORMATTERS, encode_cell
from quillet.options import DEFAULT, DYNAMIC_DEFAULT, ENDINGS, Options, OptionsError
from quillet.schema import SPARK_KINDS, Field, Schema


def cell(f: Field, o: Options) -> Column:
    """A field's cell: empty if it is not to be written, null, or a default that is not emitted."""
    value = f.getter() if f.getter else F.col(f"`{f.column or f.name}`")
    text = encode_cell(f.get_formatter()(value), o, f.quote_empty)
    if not f.emit_default:
        zero = {"string": "", "char": "\0", "bool": False}.get(f.kind, 0) if f.zero is None and not f.nullable and f.kind not in ("datetime", "datetimeoffset", "guid", "timespan", "enum") else f.zero
        text = F.when(value.isNull() if zero is None else value.eqNullSafe(F.lit(zero)), "").otherwise(text)
    if f.should_write is not None:
        text = F.when(f.should_write(), text).otherwise("")
    return text


def line(schema: Schema, o: Options = DEFAULT) -> Column:
    """A row as a line, without its ending."""
    return F.concat_ws(o.separator, *(cell(f, o) for f in schema.fields))


def header_line(names: list[str], o: Options = DEFAULT) -> str:
    """Names as a line: quoted where they hold a row ending's character, the quote, the comment character or the separator."""
    out = []
    for n in names:
        if any(c in n for c in ("\r", "\n", o.quote, o.comment, o.separator) if c):
            if o.quote is None or (o.escape is None and o.quote in n):
                raise OptionsError(f"no way to escape the header {n!r}")
            n = f"{o.quote}{n.replace(o.quote, (o.escape or '') + o.quote)}{o.quote}"
        out.append(n)
    return o.separator.join(out)


def comment_lines(text: Column, o: Options) -> Column:
    """array<string>: a comment's lines, each behind the comment character; an empty comment is one line."""
    if o.comment is None:
        raise OptionsError("no comment character is configured, cannot write a comment line")
    ending = ENDINGS[o.write_ending]
    parts = F.split(text, {"\n": "\\n", "\r": "\\r", "\r\n": "\\r\\n"}[ending], -1)
    n = F.size(parts)
    # an ending at the very end begins no further line
    parts = F.when((n > 1) & (F.element_at(parts, -1) == ""), F.slice(parts, F.lit(1), n - 1)).otherwise(parts)
    return F.transform(parts, lambda p: F.concat(F.lit(o.comment), p))


def lines(df: DataFrame, schema: Schema, o: Options = DEFAULT) -> DataFrame:
    """``df`` with the rows' lines in ``line``."""
    return df.withColumn("line", line(schema, o))


def write(df: DataFrame, schema: Schema, path: str, o: Options = DEFAULT, header: str | None = None) -> None:
    """UTF-8 text files with the dialect's row ending after every line; nothing is shuffled, nothing leaves the JVM.

    With a header, each file that has rows starts with it, so that each can be read by itself. ``header="FIRST"`` writes it once, as a file before
    all others: the files in their order are then one text.
    """
    rows = df.select(line(schema, o).alias("value"))
    _with_header(rows, header_line(schema.names, o), header or o.write_header).write.text(path, lineSep=ENDINGS[o.write_ending])


def _with_header(rows: DataFrame, first: str, policy: str) -> DataFrame:
    if policy == "NEVER":
        return rows
    if policy == "FIRST":
        return rows.sparkSession.range(0, 1, 1, 1).select(F.lit(first).alias("value")).union(rows)
    # a partition's first row: the low bits of its number are 0
    begins = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
    return rows.select(F.explode(F.when(begins, F.array(F.lit(first), "value")).otherwise(F.array("value"))).alias("value"))


def _text(head: list[Column], lines: Column, o: Options) -> Column:
    ending = ENDINGS[o.write_ending]
    text = F.array_join(F.concat(*head, lines) if head else lines, ending)
    return F.concat(text, F.lit(ending)) if o.write_trailing_ending == "ALWAYS" else text


def _comments(texts: tuple[str, ...], o: Options) -> list[Column]:
    return [comment_lines(F.lit(t), o) for t in texts]


def to_text(df: DataFrame, schema: Schema, order: list[str], o: Options = DEFAULT, group: list[str] | None = None, comments: tuple[str, ...] = (), before: tuple[str, ...] = ()) -> DataFrame:
    """One text per group (or one in all): header, row endings between records, and at the end if the dialect says so.

    ``comments`` follow the header, ``before`` come before it. For texts that fit a row; ``write`` is for the rest.
    """
    keys = group or []
    rows = df.select(*keys, F.struct(*order, line(schema, o).alias("line")).alias("r"))
    gathered = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("r"))
    header = [F.array(F.lit(header_line(schema.names, o)))] if o.write_header == "ALWAYS" else []
    return gathered.select(*keys, _text([*_comments(before, o), *header, *_comments(comments, o)], F.transform("r", lambda r: r["line"]), o).alias("text"))


def to_bytes(texts: DataFrame, encoding: str, mark: bool = False, text: str = "text", into: str = "bytes") -> DataFrame:
    """``texts`` with ``text`` encoded in ``into``; with ``mark``, behind a byte order mark."""
    value = F.concat(F.lit("\ufeff"), text) if mark else F.col(text)
    return texts.withColumn(into, F.encode(value, encoding))


def count_written(df: DataFrame) -> DataFrame:
    """How many rows writing them all would write."""
    return df.agg(F.count(F.lit(1)).alias("rows_written"))


def dynamic_line(cells: Column, header: Column, columns: list[str], o: Options = DYNAMIC_DEFAULT) -> Column:
    """Untyped rows as lines in the order of ``columns``: each row's cells are found by its own header; a missing one is empty, too many are an error."""
    place = lambda n: (F.array_position(header, F.lit(n)) - 1).cast("int")
    ordered = F.concat_ws(o.separator, *(encode_cell(F.when(F.array_contains(header, n), F.get(cells, place(n))), o) for n in columns))
    return F.when(F.size(cells) > len(columns), F.raise_error(F.lit("Too many cells returned"))).otherwise(ordered)


def free_line(cells: Column, o: Options = DYNAMIC_DEFAULT) -> Column:
    """Untyped rows of any width, as they are."""
    return F.array_join(F.transform(cells, lambda c: encode_cell(c, o)), o.separator)


def cells_of(df: DataFrame, column: str) -> tuple[Column, Column]:
    """(names, cells as text) of a column that holds rows without a schema of their own.

    A map gives its keys and values, a struct its members (those whose type has no formatter are left out), an array of (name, value) structs its
    elements.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, T.MapType):
        return F.map_keys(column), F.transform(F.map_values(column), lambda v: v.cast("string"))
    if isinstance(kind, T.StructType):
        kinds = [(f.name, SPARK_KINDS[type(f.dataType)]) for f in kind.fields if type(f.dataType) in SPARK_KINDS]
        return F.array(*(F.lit(n) for n, _ in kinds)), F.array(*(FORMATTERS[k](F.col(column)[n]) for n, k in kinds))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) and len(kind.elementType) == 2:
        name, value = kind.elementType.names
        return F.transform(column, lambda c: c[name]), F.transform(column, lambda c: c[value].cast("string"))
    raise OptionsError(f"no cells in {column}: {kind.simpleString()}")


def dynamic_to_text(df: DataFrame, column: str, order: list[str], o: Options = DYNAMIC_DEFAULT, group: list[str] | None = None, comments: tuple[str, ...] = (), before: tuple[str, ...] = ()) -> DataFrame:
    """One text per group of rows without a schema (see ``cells_of``), by ``order``.

    The first row of a text says which columns it has, and all others are put in that order: what they lack is empty, and more cells than columns
    are an error. Without a header, rows are written as they are, each as wide as it is. Comments in ``before`` come before the header.
    """
    keys = group or []
    names, cells = cells_of(df, column)
    rows = df.select(*keys, F.struct(*order, names.alias("names"), cells.alias("cells")).alias("r"))
    rows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("r")).alias("r")).withColumn("columns", F.get("r", F.lit(0))["names"])
    if o.write_header == "NEVER":
        return rows.select(*keys, _text([*_comments(before, o), *_comments(comments, o)], F.transform("r", lambda r: free_line(r["cells"], o)), o).alias("text"))

    def one(r: Column) -> Column:
        cell = lambda c: F.when(F.array_contains(r["names"], c), F.get(r["cells"], (F.array_position(r["names"], c) - 1).cast("int")))
        made = F.array_join(F.transform("columns", lambda c: encode_cell(cell(c), o)), o.separator)
        # a fixed message
        return F.when(F.size(r["cells"]) > F.size("columns"), F.raise_error(F.lit("Too many cells returned"))).otherwise(made)

    header = F.array(F.array_join(F.transform("columns", lambda c: encode_cell(c, o)), o.separator))
    return rows.select(*keys, _text([*_comments(before, o), header, *_comments(comments, o)], F.transform("r", one), o).alias("text"))
