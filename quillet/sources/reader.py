"""Delimited text to DataFrames: typed by a schema, untyped by a header, with or without comments.

A text is taken apart step by step, each a projection of its own: its records as they stand, then (one row each) their values as they stand,
then the values. What holds for a whole text (its ending, where each field stands in the header) is found once, before its records part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from quillet.operators.tokenize import by_ending, checked_records, comment_text, ending_of, found_records, is_comment, is_header, raw_values, value_of, values
from quillet.options import DEFAULT, DYNAMIC_DEFAULT, ENDINGS, Options, OptionsError
from quillet.schema import Schema

_BOM = "\ufeff"
_SPLITS = "source string, split long, open boolean, opens boolean, first long, last long, whole boolean"


# --- sources: one row per text, (source, text)


def from_files(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """A row for each file, for files that fit one (``from_large_files`` is for the others).

    Without an encoding, a byte order mark tells it (UTF-8, UTF-16 or UTF-32, either order), and it is UTF-8 if there is none. The mark is dropped.
    """
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source"), decoded(F.col("content"), encoding).alias("text"))


def decoded(content: Column, encoding: str | None = None) -> Column:
    """Bytes as text without their byte order mark, which tells the encoding unless that is given."""
    if encoding is not None:
        text = F.decode(content, encoding)
    else:
        mark = F.hex(F.substring(content, 1, 4))
        text = F.when(mark.isin("0000FEFF", "FFFE0000"), F.decode(content, "UTF-32")).when(mark.startswith("FEFF") | mark.startswith("FFFE"), F.decode(content, "UTF-16")).otherwise(F.decode(content, "UTF-8"))
    return F.regexp_replace(text, f"^{_BOM}", "")


def from_texts(spark: SparkSession, *texts: str) -> DataFrame:
    """The texts, in order (their numbers as ``source``)."""
    return spark.createDataFrame([(str(i), t.removeprefix(_BOM)) for i, t in enumerate(texts)], "source string, text string")


def from_bytes(df: DataFrame, column: str, encoding: str | None, source: str) -> DataFrame:
    return df.select(F.col(source).cast("string").alias("source"), decoded(F.col(column), encoding).alias("text"))


def from_column(df: DataFrame, column: str, source: str) -> DataFrame:
    return df.select(F.col(source).cast("string").alias("source"), F.col(column).alias("text"))


def from_large_files(spark: SparkSession, path: str | list[str], o: Options) -> DataFrame:
    """(source, record, text, ended): the records of UTF-8 files of any size, split as Spark splits them.

    A split's lines are counted where they are read (at once, as for the listing of files), and only its sums are brought together. An odd number of quotes before a line says that it starts inside
    a quoted value and belongs to the record before it; records are put together and numbered where their lines are read again, and no line is
    shuffled but those of records that cross from split to split. The row ending is to be given: LF, CR or CRLF. ``ended`` is whether a row ending
    follows the record (unknown, and true, in files whose bytes are no valid UTF-8).
    """
    lines, splits = _large_lines(spark, path, o)
    return _large_records(spark, lines, splits, o)


def _large_lines(spark: SparkSession, path: str | list[str], o: Options) -> tuple[DataFrame, list[Row]]:
    """The lines of the files' splits, and what ``_split_sums`` says of each split."""
    if o.read_ending == "DETECT":
        raise OptionsError("large files are split at row endings: say which")
    _check_stitching(o)
    lines = spark.read.option("lineSep", _cut(o)).text(path).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("split"), F.col("_metadata.file_size").alias("size"), F.col("value").alias("line"),
    )
    # the lines and their breaks are all of the file, but for the 3 bytes of a mark, which Spark has dropped
    lines = lines.withColumn("bytes", F.octet_length("line") + 1)
    lines = lines.withColumn("line", F.when(F.col("split") == 0, F.regexp_replace("line", f"^{_BOM}", "")).otherwise(F.col("line")))
    return lines, _split_sums(lines, o.quote).collect()


def _large_records(spark: SparkSession, lines: DataFrame, splits: list[Row], o: Options) -> DataFrame:
    """(source, record, text, ended) of the splits."""
    stitched = lambda some: _stitched(lines, spark.createDataFrame(some, _SPLITS), o.quote, _cut(o))
    rows = stitched(splits)
    # no records cross without quoted line breaks
    if crossed := [s for s in splits if s["open"] or s["opens"]]:
        parts = stitched(crossed).where("edge").groupBy("source", "record").agg(F.sort_array(F.collect_list(F.struct("split", "text"))).alias("parts"), F.first("ended").alias("ended"))
        rows = rows.where("not edge").select("source", "record", "text", "ended").union(parts.select("source", "record", F.array_join("parts.text", _cut(o)), "ended"))
    # the split takes the line break, of which CRLF leaves a part
    if o.read_ending == "CRLF":
        rows = rows.withColumn("text", F.when(F.col("ended"), F.regexp_replace("text", r"\r\z", "")).otherwise(F.col("text")))
    return rows.select("source", "record", "text", "ended")


def _cut(o: Options) -> str:
    """What Spark cuts lines at: CRLF leaves its first half with the line."""
    return "\r" if o.read_ending == "CR" else "\n"


def _check_stitching(o: Options) -> None:
    if o.quote is not None and o.quote != o.escape:
        raise OptionsError("stitching needs a quote that escapes itself")
    if o.comment is not None and o.quote is not None:
        raise OptionsError("lines of a dialect with both quotes and comments can't be told apart by counting")


def _opens(line: pa.Array, quote: str | None, open: bool) -> tuple[np.ndarray, bool]:
    """Whether each of consecutive lines starts inside a quoted value, and whether the next one will."""
    if quote is None:
        return np.zeros(len(line), bool), False
    ends = (np.cumsum(pc.count_substring(line, quote).to_numpy(zero_copy_only=False)) + open) % 2 == 1
    return np.concatenate(([open], ends[:-1])), bool(ends[-1])


def _split_sums(lines: DataFrame, quote: str | None) -> DataFrame:
    """A row for each split that has lines: source, split, whether its first line and the next split's are open, the first record that starts in it, the file's last, whether the file ends in a break."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], list] = {}
        for b in batches:
            for key, size, c in _runs(b):
                # if the split's first line starts outside quotes: whether the next one's does, how many lines do, and how many there are
                own = sums.setdefault(key, [size, 0, False, 0, 0])
                inside, own[2] = _opens(c.column("line"), quote, own[2])
                own[1] += pc.sum(c.column("bytes")).as_py()
                own[3] += int(np.count_nonzero(~inside))
                own[4] += len(c)
        rows = [(*key, *own) for key, own in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), *(pa.int64(),) * 3, pa.bool_(), *(pa.int64(),) * 2))], ["source", "split", "size", "bytes", "odd", "starts", "lines"])

    found = lines.mapInArrow(run, "source string, split long, size long, bytes long, odd boolean, starts long, lines long")
    file = Window.partitionBy("source")
    upto = file.orderBy("split")
    found = found.withColumn("opens", F.sum(F.col("odd").cast("long")).over(upto) % 2 == 1)
    found = found.withColumn("open", F.col("opens") != F.col("odd"))
    # in a split that starts inside quotes, those lines start records that else would not
    found = found.withColumn("starts", F.when(F.col("open"), F.col("lines") - F.col("starts")).otherwise(F.col("starts")))
    first = F.sum("starts").over(upto) - F.col("starts")
    return found.select("source", "split", "open", "opens", first.alias("first"), (F.sum("starts").over(file) - 1).alias("last"), (F.max("size").over(file) - F.sum("bytes").over(file)).isin(0, 3).alias("whole"))


def _stitched(lines: DataFrame, splits: DataFrame, quote: str | None, cut: str) -> DataFrame:
    """(source, split, record, text, ended, edge): the records of each split; edge if it holds a part of one only."""
    # a few numbers for each split
    known = lines.select("source", "split", "line").join(F.broadcast(splits), ["source", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, at, parts = None, None, []

        def rows(texts: pa.Array, first: int, edges: np.ndarray) -> pa.RecordBatch:
            record = first + np.arange(len(texts))
            ended = (record < at["last"]) | at["whole"]
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key[0]), len(texts)), pa.repeat(pa.scalar(key[1]), len(texts)), pa.array(record), texts, pa.array(ended), pa.array(edges)], ["source", "split", "record", "text", "ended", "edge"])

        def rest(more: bool) -> pa.RecordBatch:
            """The record whose lines are held: a part if it started before the split or (``more``) goes on after it."""
            return rows(pa.array([cut.join(parts)]), at["record"], np.array([at["headless"] or more]))

        for b in batches:
            for k, _, c in _runs(b):
                if k != key:
                    if parts:
                        yield rest(at["opens"])
                    top = {n: c.column(n)[0].as_py() for n in ("open", "opens", "first", "last", "whole")}
                    # the record that is held, and whether a part of it stands before the split
                    key, parts, at = k, [], {**top, "record": top["first"] - 1, "headless": top["open"], "now": top["open"]}
                line = c.column("line")
                inside, at["now"] = _opens(line, quote, at["now"])
                start = np.flatnonzero(~inside)
                parts += line.slice(0, start[0] if len(start) else len(line)).to_pylist()
                if not len(start):
                    continue
                if parts:
                    yield rest(False)
                at["headless"] = False
                # whole records, and the last one, which may go on
                n = len(start) - 1
                if n:
                    own = line.slice(start[0], start[-1] - start[0])
                    if len(own) > n:
                        own = pc.binary_join(pa.ListArray.from_arrays(pa.array((start - start[0]).astype(np.int32)), own), cut)
                    yield rows(own, at["record"] + 1, np.zeros(n, bool))
                at["record"] += len(start)
                parts = line.slice(start[-1]).to_pylist()
        if parts:
            yield rest(at["opens"])

    return known.mapInArrow(run, "source string, split long, record long, text string, ended boolean, edge boolean")


def _runs(b: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int | None, pa.RecordBatch]]:
    """A batch in pieces of one split each: its file and start, the file's size, and the piece."""
    if not len(b):
        return
    split = b.column("split").to_numpy()
    source = b.column("source")
    changed = (split[1:] != split[:-1]) | pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(b)]
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        yield (source[i].as_py(), int(split[i])), b.column("size")[i].as_py() if "size" in b.schema.names else None, b.slice(i, j - i)


def split_large_text(lines: DataFrame, o: Options, source: str = "source", position: str = "position", line: str = "line", within: str | None = None) -> DataFrame:
    """Records of texts too large for one row, from their physical lines: (source, record, text).

    The parity of the quotes before a line tells whether it starts inside a quoted value, so lines are stitched by a running
    sum (exact where quote and escape are the same and the text is well formed). Sums are taken over ranges of lines first (``within``: a column that
    names them in order; else by position), so that no task holds a text: only the ranges' totals, a few numbers each, meet in a window.
    """
    if o.quote is None or o.quote != o.escape:
        if o.quote is not None:
            raise OptionsError("stitching needs a quote that escapes itself")
        quotes = F.lit(0)
    else:
        quotes = F.char_length(line) - F.char_length(F.replace(F.col(line), F.lit(o.quote), F.lit("")))
    if o.comment is not None and o.quote is not None:
        raise OptionsError("lines of a dialect with both quotes and comments can't be told apart by counting")
    step = 100_000
    rows = lines.select(source, position, line, quotes.alias("q"), (F.col(within) if within else F.floor(F.col(position) / step)).alias("range"))

    totals = rows.groupBy(source, "range").agg(F.sum("q").alias("total"))
    before = totals.select(source, "range", (F.sum("total").over(Window.partitionBy(source).orderBy("range")) - F.col("total")).alias("before"))
    inner = Window.partitionBy(source, "range").orderBy(position)
    inside = rows.join(before, [source, "range"]).withColumn("open", (F.col("before") + F.sum("q").over(inner) - F.col("q")) % 2 == 1)
    # a record's number: the starts up to here, again by ranges
    starts = inside.withColumn("start", F.when(F.col("open"), 0).otherwise(1))
    totals = starts.groupBy(source, "range").agg(F.sum("start").alias("total"))
    before = totals.select(source, "range", (F.sum("total").over(Window.partitionBy(source).orderBy("range")) - F.col("total")).alias("first"))
    numbered = starts.join(before, [source, "range"]).withColumn("record", F.col("first") + F.sum("start").over(inner) - 1)
    joined = numbered.groupBy(source, "record").agg(F.sort_array(F.collect_list(F.struct("range", F.col(position).alias("p"), F.col(line).alias("l")))).alias("parts"))
    # what the lines were cut at: CRLF leaves its first half with the line
    cut = "\r" if o.read_ending == "CR" else "\n"
    return joined.select(source, "record", F.array_join(F.col("parts.l"), cut).alias("text"))


# --- readers


def _texts(texts: DataFrame, o: Options) -> DataFrame:
    """source, ending, and the records (rows and comments) of each text as they stand."""
    known = texts.select("source", "text", by_ending(lambda e: e, ending_of(F.col("text"), o)).alias("ending"))
    found = known.select("source", "ending", "text", found_records(F.col("text"), o, _ending(o)).alias("found"))
    return found.select("source", "ending", checked_records(F.col("found"), F.col("text"), o).alias("records"))


def _ending(o: Options) -> str | Column:
    return o.read_ending if o.read_ending != "DETECT" else F.col("ending")


def _only_rows(texts: DataFrame, o: Options) -> DataFrame:
    rows = _texts(texts, o)
    return rows if o.comment is None else rows.withColumn("records", F.filter("records", lambda r: ~is_comment(r, o)))


def _with_head(rows: DataFrame, o: Options) -> DataFrame:
    """The values of the first record in ``head``, null if there is none."""
    rows = rows.withColumn("head", raw_values(F.try_element_at("records", F.lit(1)), o, _ending(o)))
    return rows.withColumn("head", values(F.col("head"), o))


def read_records(texts: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """(source, position, kind, values, comment): every record and comment, in order."""
    rows = _texts(texts, o).select("source", "ending", F.posexplode("records").alias("position", "record"))
    rows = rows.select("source", "position", is_comment(F.col("record"), o).alias("note"), "record", "ending", raw_values(F.col("record"), o, _ending(o)).alias("raws"))
    note = F.when(F.col("note"), comment_text(F.col("record"), o, _ending(o))) if o.comment is not None else F.lit(None).cast("string")
    return rows.select("source", "position", F.when(F.col("note"), "comment").otherwise("row").alias("kind"), F.when(~F.col("note"), values(F.col("raws"), o)).alias("values"), note.alias("comment"))


def read_with_comments(texts: DataFrame, o: Options = DEFAULT) -> DataFrame:
    """(source, position, kind, row_number, values, comment): rows and comments as they come; comments have no row number."""
    if o.comment is None:
        return read_records(texts, o).select("source", "position", "kind", F.col("position").alias("row_number"), "values", "comment")
    # texts of the same source, or of none, are numbered apart
    rows = read_records(texts.select(F.struct("source", F.monotonically_increasing_id().alias("text")).alias("source"), "text"), o)
    before = F.count(F.when(F.col("kind") == "row", 1)).over(Window.partitionBy("source").orderBy("position"))
    return rows.select("source.source", "position", "kind", F.when(F.col("kind") == "row", before - 1).cast("int").alias("row_number"), "values", "comment")


def _places(header: Column, schema: Schema) -> Column:
    """Where in a header each field stands, -1 where it doesn't; the last of equal names counts."""
    backwards = F.reverse(header)
    at = (F.array_position(backwards, F.lit(f.name)) for f in schema.fields)
    return F.array(*(F.when(p > 0, F.size(header) - p).otherwise(-1).cast("int") for p in at))


def read_static(texts: DataFrame, schema: Schema, o: Options = DEFAULT, on_error: str = "raise") -> DataFrame:
    """Typed rows: source, row_number (data rows from 0) and the schema's fields.

    With a header, fields are found by name (exact case; the last of equal names counts) and unknown columns ignored; without one, by position. An
    absent value leaves the field's default (``provider``: or a default row's). A text that can't be parsed, a required value that is missing or empty, a null
    that a field's contract forbids and, where the dialect says so, an extra column are errors; ``on_error="report"`` gives null and lists them in ``errors`` instead.
    """
    rows = _only_rows(texts, o)
    if o.read_header == "NEVER":
        data = rows.select("source", "ending", F.lit(None).cast("array<int>").alias("places"), F.lit(len(schema.fields)).alias("width"), F.posexplode("records").alias("row_number", "record"))
        return _typed(data, schema, o, on_error, headed=False)
    rows = _with_head(rows, o).withColumn("headed", F.when(F.col("head").isNotNull(), is_header(F.col("head"), schema.names, o)).otherwise(False))
    names = F.array(*map(F.lit, schema.names))
    rows = rows.select("source", "ending", F.when(F.col("headed"), F.col("head")).otherwise(names).alias("head"), F.when(F.col("headed"), F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0)))).otherwise(F.col("records")).alias("records"))
    data = rows.select("source", "ending", _places(F.col("head"), schema).alias("places"), F.size("head").alias("width"), F.posexplode("records").alias("row_number", "record"))
    return _typed(data, schema, o, on_error, headed=True)


def read_static_large(spark: SparkSession, path: str | list[str], schema: Schema, o: Options, on_error: str = "raise") -> DataFrame:
    """``read_static`` for files of any size: no task sees more than a split of one. The row ending is to be given; no comments where values are quoted."""
    lines, splits = _large_lines(spark, path, o)

    def checked(some: list[Row], which: str = "true") -> DataFrame:
        rows = _large_records(spark, lines, some, o).where(which)
        # as it stands in the file, and malformed where it is more or less than one record
        record = F.when(F.col("ended"), F.concat("text", F.lit(ENDINGS[o.read_ending]))).otherwise(F.col("text"))
        rows = rows.where(F.col("ended") | (F.col("text") != "")).select("source", F.lit(o.read_ending).alias("ending"), "record", record.alias("text"))
        rows = rows.withColumn("one", found_records(F.col("text"), o, o.read_ending))
        rows = rows.select("source", "ending", "record", F.when((F.size("one") == 1) & (F.get("one", F.lit(0)) == F.col("text")), F.col("text")).otherwise(F.raise_error(F.lit("malformed delimited text"))).alias("text"))
        return rows if o.comment is None else rows.where(~is_comment(F.col("text"), o))

    rows = checked(splits)
    n = len(schema.fields)
    if o.read_header == "NEVER":
        data = rows.select("source", "ending", F.lit(None).cast("array<int>").alias("places"), F.lit(n).alias("width"), F.col("record").alias("row_number"), F.col("text").alias("record"))
        return _typed(data, schema, o, on_error, headed=False)
    # each file's first row: without comments it is the first record, of which no part is where more records than that have started before
    if o.comment is None:
        top = checked([x for x in splits if x["first"] <= 1], "record = 0")
    else:
        top = rows.join(F.broadcast(rows.groupBy("source").agg(F.min("record").alias("record"))), ["source", "record"])
    top = top.select("source", F.col("record").alias("first"), values(raw_values(F.col("text"), o, o.read_ending), o).alias("head"))
    top = top.withColumn("headed", is_header(F.col("head"), schema.names, o)).withColumn("head", F.when(F.col("headed"), F.col("head")).otherwise(F.array(*map(F.lit, schema.names))))
    top = top.select("source", "first", "headed", _places(F.col("head"), schema).alias("places"), F.size("head").alias("width"))
    # some numbers for each file
    data = rows.join(F.broadcast(top), "source").where(~F.col("headed") | (F.col("record") > F.col("first")))
    number = F.col("record") - F.when(F.col("headed"), F.col("first") + 1).otherwise(F.lit(0))
    return _typed(data.select("source", "ending", "places", "width", number.alias("row_number"), F.col("text").alias("record")), schema, o, on_error, headed=True)


def _typed(data: DataFrame, schema: Schema, o: Options, on_error: str, headed: bool) -> DataFrame:
    """Records (source, ending, places, width, row_number, record) as typed rows."""
    keep = ["source", "row_number", "places", "width"]
    data = data.select(*keep, raw_values(F.col("record"), o, _ending(o)).alias("raws"))
    place = [F.get("places", F.lit(i)) if headed else F.lit(i) for i in range(len(schema.fields))]
    raw = [F.when(p >= 0, F.get("raws", p)) if headed else F.get("raws", p) for p in place]
    extra = F.when(F.size("raws") > F.col("width"), value_of(F.get("raws", F.col("width")), o))
    # each value made once, then parsed once
    made = [value_of(r, o).alias(f"__cell{i}") for i, r in enumerate(raw)]
    data = data.select("source", "row_number", *(["places"] if headed else []), *made, *([extra.alias("__extra")] if o.extra_columns == "THROW" else []))
    cells = [F.col(f"__cell{i}") for i in range(len(schema.fields))]
    parsed = [f.get_parser()(c) for f, c in zip(schema.fields, cells, strict=True)]
    steps = [x.alias(f"__{n}{i}") for i, p in enumerate(parsed) for n, x in (("ok", F.coalesce(p.ok, F.lit(False))), ("value", p.value))]
    data = data.select("*", *steps)
    outputs, errors = [], []
    for i, (f, cell) in enumerate(zip(schema.fields, cells, strict=True)):
        ok, value = F.col(f"__ok{i}"), F.col(f"__value{i}")
        # fixed messages
        error = F.when(cell.isNotNull() & ~ok, F.concat(F.lit('Failed to parse "'), cell, F.lit(f'" for column {f.name}')))
        if f.required:
            missing = F.when(F.get("places", F.lit(i)) < 0, F.lit(f"Required column [{f.name}] was not found in header row")) if headed else F
            error = missing.when(cell.isNull() | (cell == ""), F.lit(f"Column [{f.name}] is required, but was not found in row")).otherwise(error)
        start = f.start(schema)
        value = F.when(cell.isNull(), start).when(ok, value)
        if f.never_null:
            error = F.coalesce(error, F.when(value.isNull(), F.lit(f"Column [{f.name}] does not allow null values")))
        outputs.append((F.when(error.isNotNull(), F.raise_error(error)).otherwise(value) if on_error == "raise" else F.when(error.isNull(), value)).alias(f.name))
        errors.append(error)
    if o.extra_columns == "THROW":
        message = F.concat(F.lit("Extra column was encountered on row "), F.col("row_number").cast("string"), F.lit('; column contents were "'), F.col("__extra"), F.lit('"'))
        error = F.when(F.col("__extra").isNotNull(), message)
        if on_error == "raise":
            outputs[0] = F.when(error.isNotNull(), F.raise_error(error)).otherwise(outputs[0]).alias(schema.names[0])
        errors.append(error)
    report = [F.array_compact(F.array(*errors)).alias("errors")] if on_error != "raise" else []
    return data.select("source", "row_number", *outputs, *report)


def read_dynamic(texts: DataFrame, o: Options = DYNAMIC_DEFAULT) -> DataFrame:
    """Untyped rows: source, row_number, header (null without one) and cells, as wide as the header or the first row.

    Short rows are filled with nulls. Cells beyond the width stay, go or are an error, as the dialect says. Equal names in a header are an error.
    """
    if o.read_header == "DETECT":
        raise OptionsError("untyped rows have no names of their own to detect a header by")
    rows = _with_head(_only_rows(texts, o), o)
    record = F.posexplode("records" if o.read_header == "NEVER" else F.slice("records", F.lit(2), F.greatest(F.size("records") - 1, F.lit(0)))).alias("row_number", "record")
    head = F.lit(None).cast("array<string>")
    if o.read_header == "ALWAYS":
        head = F.when(F.size(F.array_distinct("head")) < F.size("head"), F.raise_error(F.lit("Two or more members with same name"))).otherwise(F.col("head"))
    rows = rows.select("source", "ending", head.alias("header"), F.size("head").alias("width"), record)
    rows = rows.select("source", "row_number", "header", "width", raw_values(F.col("record"), o, _ending(o)).alias("raws"))
    rows = rows.select("source", "row_number", "header", "width", values(F.col("raws"), o).alias("cells"))
    n, width = F.size("cells"), F.col("width")
    filled = F.concat("cells", F.array_repeat(F.lit(None).cast("string"), F.greatest(width - n, F.lit(0))))
    if o.extra_columns == "IGNORE":
        filled = F.slice(filled, F.lit(1), width)
    elif o.extra_columns == "THROW":
        filled = F.when(n > width, F.raise_error(F.concat(F.lit("Extra column was encountered on row "), F.col("row_number").cast("string")))).otherwise(filled)
    return rows.select("source", "row_number", "header", filled.alias("cells"))


# --- ways to take the rows


def read_all(df: DataFrame) -> list[Row]:
    """All rows of a single text, in order."""
    return _in_order(df).collect()


def read_into(df: DataFrame, add: Callable[[Row], object]) -> int:
    """Hands the rows on one by one; how many there were."""
    n = 0
    for r in enumerate_rows(df):
        add(r)
        n += 1
    return n


def enumerate_rows(df: DataFrame) -> Iterator[Row]:
    """Rows in order, a partition at a time."""
    return _in_order(df).toLocalIterator()


def _in_order(df: DataFrame) -> DataFrame:
    """By source, numbers among them as numbers, then by row."""
    return df.orderBy(F.col("source").try_cast("long").asc_nulls_last(), "source", "row_number")
