"""Registered queries of sources, sinks and schemas: what is written somewhere is read again and has to be the table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillet import streaming
from quillet.functions import format as fmt
from quillet.functions import parse
from quillet.operators import rows as R
from quillet.operators.tokenize import records
from quillet.options import DEFAULT, DYNAMIC_DEFAULT
from quillet.plans import Dynamic, Static
from quillet.queries import LF, NATION, ORDERS, query, table
from quillet.schema import Field, Schema
from quillet.sources import reader, writer
from quillet.sources.scratch import shared_folder

LINES = Schema.of(l_orderkey="long", l_partkey="long", l_linenumber="int", l_quantity="double", l_returnflag="string", l_shipdate="datetime")
_LINES = "l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, epoch_us(l_shipdate) AS shipped"
PAGES = Schema.of(page_id="long", url="string?", html="string?")


def _lines(df):
    return df.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("shipped"))


# --- files ---------------------------------------------------------------------------------------------------


@query(f"SELECT {_LINES} FROM lineitem")
def files_large(spark, sf):
    """A table written as text files and read back split by split."""
    plan = Static(LINES, DEFAULT.but(read_ending="LF", write_ending="LF"))
    where = shared_folder(spark, "lineitem")
    plan.write(table(spark, sf, "lineitem"), where)
    return _lines(plan.read_large_files(spark, where))


@query("SELECT page_id, nullif(url, '') AS url, nullif(html, '') AS html FROM pages")
def files_large_quoted(spark, sf):
    """Quoted line breaks across lines and splits, CRLF records, one header before all files."""
    plan = Static(PAGES, DEFAULT.but(read_ending="CRLF", write_ending="CRLF", read_header="NEVER", write_header="NEVER"))
    where = shared_folder(spark, "pages")
    plan.write(table(spark, sf, "pages"), where)
    return plan.read_large_files(spark, where).drop("source", "row_number")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) AS ordered FROM orders")
def files_whole(spark, sf):
    """Files that fit a row, each with its header; the encoding is given, though a mark would tell it."""
    plan, where = Static(ORDERS), shared_folder(spark, "orders")
    plan.write(table(spark, sf, "orders"), where)
    read = plan.read_files(spark, where, "UTF-8")
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.unix_micros("o_orderdate").alias("ordered"))


@query("SELECT page_id, html AS text FROM pages")
def bytes_encodings(spark, sf):
    """Texts as bytes in one of five encodings, told apart by their byte order marks."""
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"))
    kinds = ("UTF-8", "UTF-16LE", "UTF-16BE", "UTF-16", "UTF-8")
    made = None
    for i, kind in enumerate(kinds):
        own = pages.where(F.col("page_id") % len(kinds) == i)
        # what has no byte order in its name writes its mark by itself
        part = writer.to_bytes(own, kind, mark=i < 3)
        made = part if made is None else made.union(part)
    return reader.from_bytes(made, "bytes", None, "page_id").select(F.col("source").cast("long").alias("page_id"), "text")


@query("SELECT n_nationkey, n_name FROM nation")
def taken_in_order(spark, sf):
    """All rows of a text, taken by the driver one after the other, as a list and into a list."""
    texts = writer.to_text(table(spark, sf, "nation"), NATION, ["n_nationkey"]).select(F.lit("0").alias("source"), "text")
    read, into = reader.read_static(texts, NATION), []
    reader.read_into(read, into.append)
    rows = reader.read_all(read)
    if rows != into or rows != list(reader.enumerate_rows(read)) or [r.row_number for r in rows] != list(range(len(rows))):
        raise AssertionError("rows differ by the way they are taken")
    return spark.createDataFrame([(r.n_nationkey, r.n_name) for r in rows], "n_nationkey int, n_name string")


# --- streams -------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, epoch_us(o_orderdate) AS ordered FROM orders")
def stream_static(spark, sf):
    """Files read and written as a stream, and the written ones read again."""
    plan = Static(ORDERS, DEFAULT.but(read_ending="LF", write_ending="LF"))
    first, second, notes = (shared_folder(spark, n) for n in ("in", "out", "notes"))
    plan.write(table(spark, sf, "orders"), first)
    streaming.write_stream(streaming.read_static_stream(spark, first, ORDERS, plan.options), ORDERS, second, notes, plan.options).awaitTermination()
    read = plan.read_large_files(spark, f"{second}/batch=*")
    return read.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", F.unix_micros("o_orderdate").alias("ordered"))


@query("SELECT c_custkey, c_name FROM customer")
def stream_dynamic(spark, sf):
    first, second, notes = (shared_folder(spark, n) for n in ("in", "out", "notes"))
    Static(Schema.of(c_custkey="long", c_name="string")).write(table(spark, sf, "customer"), first)
    rows = streaming.read_dynamic_stream(spark, first)
    rows.writeStream.format("parquet").option("checkpointLocation", notes).trigger(availableNow=True).start(second).awaitTermination()
    read = spark.read.schema(rows.schema).parquet(second)
    return read.select(R.named(F.col("cells"), F.col("header"), "c_custkey").cast("long").alias("c_custkey"), R.named(F.col("cells"), F.col("header"), "c_name").alias("c_name"))


# --- dialects ------------------------------------------------------------------------------------------------


def _back(spark, sf, o, change=lambda t: t):
    """Every document written under a dialect, two a text, and read again."""
    schema = Schema.of(doc_id="long", text="string?")
    docs = table(spark, sf, "documents").select("doc_id", change(F.col("text")).alias("text"), F.floor(F.col("doc_id") / 2).alias("part"))
    texts = writer.to_text(docs, schema, ["doc_id"], o, ["part"])
    return reader.read_static(reader.from_column(texts, "text", "part"), schema, o).select("doc_id", "text")


@query("SELECT doc_id, nullif(replace(text, ' ', chr(92)), '') AS text FROM documents")
def escape_character(spark, sf):
    """A quote that is escaped by another character, which the texts are full of."""
    return _back(spark, sf, DEFAULT.but(escape="\\"), lambda t: F.replace(t, F.lit(" "), F.lit("\\")))


@query("SELECT doc_id, nullif(replace(text, ' ', chr(13)), '') AS text FROM documents")
def lone_returns(spark, sf):
    """CR inside values of a CRLF dialect: only inside quotes, and never the end of a record."""
    return _back(spark, sf, DEFAULT.but(read_ending="CRLF"), lambda t: F.replace(t, F.lit(" "), F.lit("\r")))


@query("SELECT doc_id, nullif(replace(text, ' ', chr(13) || chr(10)), '') AS text FROM documents")
def endings_in_quotes(spark, sf):
    """The ending is found outside quotes, whatever stands inside them."""
    return _back(spark, sf, DEFAULT.but(write_ending="CR"), lambda t: F.replace(t, F.lit(" "), F.lit("\r\n")))


@query("SELECT doc_id, source AS after_quote FROM documents")
def after_closing_quote(spark, sf):
    """White space between a closing quote and the separator, where the dialect skips it."""
    docs = table(spark, sf, "documents")
    text = F.concat(F.lit('"a""b"  ,\t"'), F.col("source"), F.lit('"\t,x'))
    got = F.element_at(records(text, LF.but(trim_before=True, trim_after=True)), 1)["values"]
    return docs.select("doc_id", F.get(got, F.lit(1)).alias("after_quote"))


@query("SELECT part, 'n_nationkey,\"n,\"\"name\"\"\"' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM (SELECT *, n_regionkey AS part FROM nation) GROUP BY part")
def header_name_escapes(spark, sf):
    schema = Schema((Field("n_nationkey", "int"), Field('n,"name"', column="n_name")))
    return writer.to_text(table(spark, sf, "nation").withColumn("part", F.col("n_regionkey")), schema, ["n_nationkey"], DEFAULT.but(write_ending="LF"), ["part"])


@query("SELECT n_regionkey, '#before' || chr(10) || '#it' || chr(10) || 'n_nationkey,n_name,n_regionkey' || chr(10) || '#after' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || n_regionkey, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def comments_around_header(spark, sf):
    o = DEFAULT.but(comment="#", write_ending="LF")
    return writer.to_text(table(spark, sf, "nation"), NATION, ["n_nationkey"], o, ["n_regionkey"], comments=("after",), before=("before\nit",))


# --- rows without a schema -----------------------------------------------------------------------------------


@query("SELECT c_nationkey, 'c_custkey,c_name,c_mktsegment' || chr(10) || string_agg(c_custkey || ',' || c_name || ',' || CASE WHEN c_custkey % 5 = 0 AND c_custkey <> f THEN '' ELSE c_mktsegment END, chr(10) ORDER BY c_custkey) AS text FROM (SELECT *, min(c_custkey) OVER (PARTITION BY c_nationkey) AS f FROM customer) GROUP BY c_nationkey")
def dynamic_write_maps(spark, sf):
    """Maps as rows: the first of a text names the columns; the keys of the others come in another order, some lack one."""
    key, name, segment = F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")
    first = F.col("c_custkey") == F.min("c_custkey").over(Window.partitionBy("c_nationkey"))
    names = [F.lit(n) for n in ("c_custkey", "c_name", "c_mktsegment")]
    whole = F.create_map(names[0], key, names[1], name, names[2], segment)
    turned = F.create_map(names[2], segment, names[0], key, names[1], name)
    short = F.create_map(names[1], name, names[0], key)
    row = F.when(first, whole).when(F.col("c_custkey") % 5 == 0, short).otherwise(turned)
    rows = table(spark, sf, "customer").select("c_nationkey", "c_custkey", row.alias("row"))
    return Dynamic(DYNAMIC_DEFAULT.but(write_ending="LF")).to_text(rows, "row", ["c_custkey"], ["c_nationkey"])


@query("SELECT n_regionkey, 'n_nationkey,n_name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def dynamic_write_structs(spark, sf):
    """Structs as rows: a member without a formatter is left out."""
    rows = table(spark, sf, "nation").select("n_regionkey", "n_nationkey", F.struct("n_nationkey", "n_name", F.array("n_regionkey").alias("none")).alias("row"))
    return Dynamic(DYNAMIC_DEFAULT.but(write_ending="LF")).to_text(rows, "row", ["n_nationkey"], ["n_regionkey"])


@query("SELECT o_custkey % 100 AS part, string_agg(o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE ',' || o_orderstatus END, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY part")
def dynamic_write_ragged(spark, sf):
    """(name, value) cells, as many as a row has, without a header."""
    cell = lambda n: F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value"))
    cells = F.when(F.col("o_orderkey") % 2 == 0, F.array(cell("o_orderkey"))).otherwise(F.array(cell("o_orderkey"), cell("o_orderstatus")))
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 100).alias("part"), "o_orderkey", cells.alias("row"))
    return Dynamic(DYNAMIC_DEFAULT.but(write_ending="LF", write_header="NEVER")).to_text(rows, "row", ["o_orderkey"], ["part"])


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE n_nationkey::VARCHAR END AS name FROM nation")
def by_width_else_by_name(spark, sf):
    """Rows as wide as the schema are taken by position, others by name."""
    nation = table(spark, sf, "nation")
    key, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    row = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("x"), key, name)).otherwise(F.array(key, key))
    header = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("none"), F.lit("k"), F.lit("v"))).otherwise(F.array(F.lit("v"), F.lit("k")))
    made = R.to_struct(row, Schema.of(k="int", v="string"), header, by_width=True)
    return nation.select("n_nationkey", made["v"].alias("name"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'pair' WHEN 1 THEN 'single' ELSE 'none' END AS made FROM customer")
def converter_chain(spark, sf):
    """The first converter that gives a value."""
    cells = F.array_repeat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, 2).when(F.col("c_custkey") % 3 == 1, 1).otherwise(0))
    pair, single = F.when(F.size(cells) == 2, "pair"), F.when(F.size(cells) == 1, "single")
    return table(spark, sf, "customer").select("c_custkey", R.first_converter(pair, single, F.lit("none")).alias("made"))


# --- schemas -------------------------------------------------------------------------------------------------


@dataclasses.dataclass
class NationRecord:
    n_nationkey: int
    n_name: str
    note: str = "none"


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name, 'none' AS note FROM nation")
def record_class(spark, sf):
    """A dataclass: members without a default are required, the others may be absent."""
    texts = writer.to_text(table(spark, sf, "nation"), NATION, ["n_nationkey"], group=["n_regionkey"])
    return reader.read_static(reader.from_column(texts, "text", "n_regionkey"), Schema.from_dataclass(NationRecord)).drop("source", "row_number")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'first' END AS status, 7 AS number FROM orders")
def default_row(spark, sf):
    """Rows start from a default row: the first provider that gives one."""
    o = LF.but(read_header="ALWAYS")
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("o_orderkey,status\n"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(","), "o_orderstatus")).otherwise("")).alias("text"))
    none = F.lit(None).cast("struct<o_orderkey:bigint,status:string,number:int>")
    start = F.struct(F.lit(0).cast("long").alias("o_orderkey"), F.lit("first").alias("status"), F.lit(7).alias("number"))
    schema = Schema.of(o_orderkey="long", status="string", number="int").starting_from(lambda: none, lambda: start)
    return reader.read_static(reader.from_column(rows, "text", "o_orderkey"), schema, o).drop("source", "row_number")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS n_errors FROM orders")
def null_contract(spark, sf):
    """A null where the contract forbids it is an error, though it can be parsed."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat(F.col("o_orderkey").cast("string"), F.lit(","), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise("1"), F.lit(",x")).alias("text"))
    schema = Schema((Field("o_orderkey", "long"), Field("n", "int", nullable=True, never_null=True), Field("x")))
    read = reader.read_static(reader.from_column(rows, "text", "o_orderkey"), schema, LF, on_error="report")
    return read.select("o_orderkey", F.size("errors").alias("n_errors"))


@query("SELECT o_orderkey, o_custkey * 2 AS twice FROM orders")
def reset_before_set(spark, sf):
    """An absent member is what its reset gives."""
    rows = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(",", "o_orderkey", "o_custkey").alias("text"))
    schema = Schema((Field("o_orderkey", "long"), Field("o_custkey", "long"), Field("twice", "long", reset=lambda: F.col("__value1") * 2)))
    return reader.read_static(reader.from_column(rows, "text", "o_orderkey"), schema, LF).select("o_orderkey", "twice")


@query("SELECT o_orderkey, o_orderkey || ',' || (o_custkey + 1) || ',' || lower(o_orderstatus) AS line FROM orders")
def getters(spark, sf):
    schema = Schema((Field("key", "long", column="o_orderkey"), Field("next", "long", getter=lambda: F.col("o_custkey") + 1), Field("status", getter=lambda: F.lower("o_orderstatus"))))
    return table(spark, sf, "orders").select("o_orderkey", writer.line(schema, LF).alias("line"))


@query("SELECT n_nationkey, '+' || n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def overridden_field(spark, sf):
    """A schema with one field changed, as a subclass's hook would."""
    schema = NATION.override("n_nationkey", formatter=lambda v: F.concat(F.lit("+"), v.cast("string")))
    return table(spark, sf, "nation").select("n_nationkey", writer.line(schema, LF).alias("line"))


# --- value types ---------------------------------------------------------------------------------------------


def _parsed(spark, sf, name, key, text, kind):
    p = parse.parser_of(kind)(F.col("t"))
    return table(spark, sf, name).select(key, text.alias("t")).select(key, p.ok.alias("ok"), p.value.alias("value"))


@query("SELECT l_orderkey, l_linenumber, round(l_discount::FLOAT, 4) AS value FROM lineitem")
def parse_float(spark, sf):
    p = parse.PARSERS["float"](F.col("t"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("+"), F.col("l_discount").cast("string"), F.lit("e0")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", F.round(p.value, 4).alias("value"))


@query("SELECT o_orderkey, epoch_us(o_orderdate) - 5400000000 AS at FROM orders")
def parse_datetimeoffset(spark, sf):
    """With an offset of an hour and a half."""
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("+0130"))
    read = _parsed(spark, sf, "orders", "o_orderkey", text, "datetimeoffset")
    return read.select("o_orderkey", F.unix_micros("value").alias("at"))


@query("SELECT page_id, url AS value FROM pages")
def parse_uri(spark, sf):
    return _parsed(spark, sf, "pages", "page_id", F.col("url"), "uri").select("page_id", "value")


@query("SELECT o_orderkey, -o_orderkey AS signed, o_orderkey % 2 = 0 AS fits FROM orders")
def parse_native_integers(spark, sf):
    """Signed ones of 64 bits, and unsigned ones, which no sign fits."""
    key = F.col("o_orderkey")
    signed = parse.PARSERS["nint"](F.concat(F.lit("-"), key.cast("string")))
    unsigned = parse.PARSERS["nuint"](F.concat(F.when(key % 2 == 0, "").otherwise("-"), key.cast("string")))
    return table(spark, sf, "orders").select("o_orderkey", signed.value.alias("signed"), unsigned.ok.alias("fits"))


@query("SELECT o_orderkey, (o_orderkey + 1) || '000000000000000000000.5' AS text FROM orders")
def decimals_of_many_digits(spark, sf):
    p = parse.parser_of("decimal(38,1)")(F.concat((F.col("o_orderkey") + 1).cast("string"), F.lit("000000000000000000000.50")))
    return table(spark, sf, "orders").select("o_orderkey", fmt.FORMATTERS["decimal"](p.value).alias("text"))


@query("SELECT event_id, printf('%.17g', value) AS text FROM events")
def format_double_text(spark, sf):
    """All seventeen digits."""
    return table(spark, sf, "events").select("event_id", fmt.FORMATTERS["double"](F.col("value")).alias("text"))
