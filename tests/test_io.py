"""Files, bytes, streams, contracts and schemas: texts of our own, and what has to come of them."""

import dataclasses
import datetime
import decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillet import streaming
from quillet.functions import format as fmt
from quillet.functions import parse
from quillet.options import DEFAULT, DYNAMIC_DEFAULT, OptionsError
from quillet.plans import Dynamic, Static
from quillet.schema import Field, ManualSchema, Schema, SchemaError
from quillet.sources import reader, writer

PAIR = Schema.of(name="string", n="int?")


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("source", "row_number").select(*columns).collect()]


def whole(df, column="text"):
    return [r[0] for r in df.select(column).collect()]


@pytest.mark.parametrize("mark, encoding", [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\x00\x00\xfe\xff", "utf-32-be"), (b"", "utf-8")])
def test_files_tell_their_encoding(spark, tmp_path, mark, encoding):
    (tmp_path / "a.txt").write_bytes(mark + "name,n\r\nzoë,1\r\nłą,".encode(encoding))
    assert rows(Static(PAIR).read_files(spark, str(tmp_path)), "name", "n") == [("zoë", 1), ("łą", None)]


def test_given_encoding_and_bytes(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("name,n\nzoë,1".encode("latin-1"))
    assert rows(Static(PAIR).read_files(spark, str(tmp_path), "ISO-8859-1"), "name") == [("zoë",)]
    df = writer.to_bytes(spark.createDataFrame([("x", "zoë")], "source string, text string"), "UTF-16BE", mark=True)
    assert bytes(df.first()["bytes"]) == b"\xfe\xff" + "zoë".encode("utf-16-be")
    assert reader.from_bytes(df, "bytes", None, "source").first().text == "zoë"


def test_texts_keep_their_order(spark):
    texts = ["﻿name,n\nr0,0", *(f"r{i},{i}" for i in range(1, 12))]
    read = Static(PAIR).read_texts(spark, *texts)
    into = []
    assert [r.n for r in reader.read_all(read)] == list(range(12)) and reader.read_into(read, into.append) == 12
    assert [r.name for r in reader.enumerate_rows(read)] == [r.name for r in into] == [f"r{i}" for i in range(12)]
    # one by one, as far as they are wanted
    assert next(iter(reader.enumerate_rows(read))).name == "r0"


LARGE = ["plain", "with, comma", 'with "quotes"', "two\nlines", "", "three\r\nmore\n\nlines", "ü" * 50]


@pytest.mark.parametrize("ending", ["LF", "CR", "CRLF"])
@pytest.mark.parametrize("trailing", [True, False])
@pytest.mark.parametrize("header", ["ALWAYS", "NEVER"])
def test_large_files(spark, tmp_path, ending, trailing, header):
    o = DEFAULT.but(read_ending=ending, write_ending=ending, read_header=header)
    eol = {"LF": "\n", "CR": "\r", "CRLF": "\r\n"}[ending]
    schema, want = Schema.of(n="int", text="string?"), []
    for k in range(2):
        values = [(i, LARGE[i % len(LARGE)]) for i in range(300 + k)]
        lines = [f'{i},"{t.replace(chr(34), chr(34) * 2)}"' for i, t in values]
        text = eol.join((["n,text"] if header == "ALWAYS" else []) + lines) + (eol if trailing else "")
        (tmp_path / f"{k}.txt").write_bytes(("﻿" * (k == 0) + text).encode())
        # quoted and empty: absent before an ending, null at the end of the data too
        want += [(i, t or None) for i, t in values]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = rows(Static(schema, o).read_large_files(spark, str(tmp_path)), "n", "text", "row_number")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x[:2] for x in got] == want and [x[2] for x in got] == [*range(300), *range(301)]


def test_large_files_of_other_shapes(spark, tmp_path):
    o = DEFAULT.but(read_ending="LF", quote=None, escape=None, comment="#")
    (tmp_path / "a.txt").write_text('#no row\nname,n\na"b,1\n#"none\n,\nc,2')
    assert rows(Static(PAIR, o).read_large_files(spark, str(tmp_path)), "name", "n") == [('a"b', 1), ("", None), ("c", 2)]
    with pytest.raises(OptionsError):
        Static(PAIR).read_large_files(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text('name,n\na"b,1')
    with pytest.raises(PySparkException, match="malformed"):
        Static(PAIR, DEFAULT.but(read_ending="LF")).read_large_files(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("header, want", [("ALWAYS", {"name,n"}), ("NEVER", set()), ("FIRST", {"name,n"})])
def test_written_files(spark, tmp_path, header, want):
    df = spark.range(10).select(F.concat(F.lit("x,"), "id").alias("name"), F.col("id").cast("int").alias("n")).repartition(3)
    Static(PAIR, DEFAULT.but(write_ending="LF")).write(df, f"{tmp_path}/out", header)
    files = [p.read_text().splitlines() for p in sorted((tmp_path / "out").glob("part-*"))]
    heads = [f[0] for f in files if f and f[0] == "name,n"]
    assert set(heads) == want and len(heads) == {"ALWAYS": len([f for f in files if f]), "NEVER": 0, "FIRST": 1}[header]
    assert sorted(x for f in files for x in f if x != "name,n") == sorted(f'"x,{i}",{i}' for i in range(10))
    if header == "FIRST":
        assert files[0] == ["name,n"]


def test_streams(spark, tmp_path):
    o = DEFAULT.but(write_ending="LF")
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text(f'name,n\n"a,{i}",{i}')
    query = streaming.write_stream(streaming.read_static_stream(spark, f"{tmp_path}/in", PAIR), PAIR, f"{tmp_path}/out", f"{tmp_path}/notes", o)
    query.awaitTermination()
    got = {x for p in (tmp_path / "out").glob("batch=*/part-*") for x in p.read_text().splitlines()}
    assert got == {"name,n", *(f'"a,{i}",{i}' for i in range(3))}
    # nothing is left to do
    streaming.write_stream(streaming.read_static_stream(spark, f"{tmp_path}/in", PAIR), PAIR, f"{tmp_path}/out", f"{tmp_path}/notes", o).awaitTermination()
    assert len(list((tmp_path / "out").glob("batch=*"))) == 1
    rows_ = streaming.read_dynamic_stream(spark, f"{tmp_path}/in").writeStream.format("memory").queryName("untyped").trigger(availableNow=True).start()
    rows_.awaitTermination()
    assert sorted(r.cells[1] for r in spark.table("untyped").collect()) == ["0", "1", "2"]
    stopped = streaming.write_stream(streaming.read_static_stream(spark, f"{tmp_path}/in", PAIR), PAIR, f"{tmp_path}/more", f"{tmp_path}/notes2", o, once=False)
    stopped.stop()
    assert not stopped.isActive


def test_golden_texts(spark):
    df = spark.createDataFrame([("hi,there", 1, None), ('say"so', 2, 3), ("a\r\nb", 3, 4)], "a string, b int, c int")
    schema = Schema.of(a="string", b="int", c="int?")
    assert whole(writer.to_text(df, schema, ["b"], DEFAULT.but(write_header="NEVER"))) == ['"hi,there",1,\r\n"say""so",2,3\r\n"a\r\nb",3,4']
    for ending, eol in (("LF", "\n"), ("CR", "\r"), ("CRLF", "\r\n")):
        assert whole(writer.to_text(df.limit(0).union(df.where("b = 2")), Schema.of(b="int"), ["b"], DEFAULT.but(write_ending=ending, write_trailing_ending="ALWAYS"))) == [f"b{eol}2{eol}"]
    long = DEFAULT.but(separator="<->")
    two = spark.createDataFrame([(1, "x<->y"), (2, "<"), (3, "->")], "n int, t string")
    text = whole(writer.to_text(two, Schema.of(n="int", t="string"), ["n"], long))[0]
    assert text == 'n<->t\r\n1<->"x<->y"\r\n2<-><\r\n3<->->'
    assert rows(Static(Schema.of(n="int", t="string"), long).read_texts(spark, text), "n", "t") == [(1, "x<->y"), (2, "<"), (3, "->")]
    numbers = spark.createDataFrame([(0.12,), (123456789.0123,), (-999999.88888,), (float("nan"),)], "v double")
    assert whole(numbers.select(fmt.FORMATTERS["double"](F.col("v")).alias("t")), "t") == ["0.12", "123456789.0123", "-999999.88887999998", "NaN"]
    assert whole(numbers.select(fmt.FORMATTERS["float"](F.col("v").cast("float")).alias("t")), "t") == ["0.119999997", "123456792", "-999999.875", "NaN"]


def test_what_cannot_be_written(spark):
    df = spark.createDataFrame([("a\tb",)], "a string")
    for o, message in ((DEFAULT.but(separator="\t", quote=None, escape=None), "no way to escape a value"), (DEFAULT.but(escape=None), "no way to escape inside")):
        with pytest.raises(PySparkException, match=message):
            writer.lines(df.select(F.concat("a", F.lit('",')).alias("a")), Schema.of(a="string"), o).collect()
    with pytest.raises(OptionsError):
        writer.header_line(['a"'], DEFAULT.but(escape=None))
    with pytest.raises(OptionsError):
        writer.comment_lines(F.lit("x"), DEFAULT)
    assert writer.header_line(['a,"', "b\r", "c"]) == '"a,""","b\r",c'


def test_rows_without_a_schema(spark):
    o = DYNAMIC_DEFAULT.but(write_ending="LF", comment="#")
    df = spark.createDataFrame([(1, {"a": "1", "b": "x,y"}), (2, {"b": "2", "a": "3"}), (3, {"b": "4"})], "i int, row map<string,string>")
    assert whole(Dynamic(o).to_text(df, "row", ["i"], before=("hello world",))) == ['#hello world\na,b\n1,"x,y"\n3,2\n,4']
    assert whole(Dynamic(o.but(write_header="NEVER")).to_text(df, "row", ["i"])) == ['1,"x,y"\n3,2\n4']
    with pytest.raises(PySparkException, match="Too many cells"):
        Dynamic(o).to_text(df.withColumn("i", -F.col("i")), "row", ["i"]).collect()
    with pytest.raises(OptionsError):
        writer.cells_of(spark.range(1), "id")
    with pytest.raises(OptionsError):
        Dynamic(DEFAULT)
    # both ways give the header's names
    read = Dynamic(o).read_texts(spark, "#note\na,b\n1,2\n3")
    assert [(r.header, r.cells) for r in read.collect()] == [(["a", "b"], ["1", "2"]), (["a", "b"], ["3", None])]
    with pytest.raises(PySparkException, match="same name"):
        Dynamic(o).read_texts(spark, "a,a\n1,2").collect()


def test_required_contracts_and_default_rows(spark):
    need = Schema((Field("a", "int", required=True), Field("b")))
    with pytest.raises(PySparkException, match="was not found in header row"):
        Static(need).read_texts(spark, "b,c\n1,2").collect()
    with pytest.raises(PySparkException, match="was not found in row"):
        Static(need).read_texts(spark, "b,a\n1").collect()
    never = Schema((Field("a", "int", nullable=True, never_null=True), Field("b", never_null=True)))
    for text in ("a,b\n,x", "a,b\n1"):
        with pytest.raises(PySparkException, match="does not allow null"):
            Static(never).read_texts(spark, text).collect()
    chained = Schema.of(a="int", b="string").starting_from(lambda: F.lit(None).cast("struct<a:int,b:string>"), lambda: F.struct(F.lit(9).alias("a"), F.lit("q").alias("b")))
    assert rows(Static(chained).read_texts(spark, "b\nx\ny"), "a", "b") == [(9, "x"), (9, "y")]
    reset = Schema((Field("a", "int"), Field("b", reset=lambda: F.lit("reset"))))
    assert rows(Static(reset).read_texts(spark, "a\n1"), "a", "b") == [(1, "reset")]


@dataclasses.dataclass
class Base:
    a: int


@dataclasses.dataclass
class Derived(Base):
    b: str = "none"
    c: datetime.datetime | None = None
    d: float = dataclasses.field(default=0.0, metadata={"order": 1, "name": "first"})
    e: int = dataclasses.field(default=0, metadata={"ignore": True})


def test_schemas(spark):
    s = Schema.from_dataclass(Derived)
    assert s.names == ["first", "a", "b", "c"] and s["a"].required and not s["b"].required
    assert rows(Static(s).read_texts(spark, "a,first\n1,2.5"), "first", "a", "b", "c") == [(2.5, 1, "none", None)]
    with pytest.raises(SchemaError):
        Schema(())
    with pytest.raises(SchemaError):
        Schema.of(a="int").override("a", kind="nothing") and Static(Schema.of(a="nothing"))
    with pytest.raises(SchemaError):
        ManualSchema().build("unknown")
    assert ManualSchema(fallback=lambda n: Schema.of(x="int")).build("unknown").names == ["x"]
    with pytest.raises(SchemaError):
        Schema((Field("a"), Field("a")))
    assert Schema.tuple_of("int", "string").names == ["Item1", "Item2"]
    for provider in (PAIR, lambda: PAIR):
        assert rows(Static(options=DEFAULT.but(schema_provider=provider)).read_texts(spark, "name,n\nx,1"), "name", "n") == [("x", 1)]
    with pytest.raises(OptionsError):
        Static()
    with pytest.raises(SchemaError):
        Schema.of(a="int").surrogate(Schema.of(a="string"))


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kathmandu", "UTC"])
def test_times_are_utc_in_any_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2020-01-01 00:00:00Z", "2020-03-08 02:30:00Z", "1969-12-31 23:59:59Z", "2020-11-01 05:30:00Z", "0001-01-01 00:00:00Z", "9999-12-31 23:59:59Z"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        p = parse.PARSERS["datetime"](F.col("t"))
        assert [r[0] for r in df.select(fmt.FORMATTERS["datetime"](p.value)).collect()] == texts
        cases = {"2020-01-01": 1577836800, "2020-01-01 12:30": 1577881800, "1/2/2020": 1577923200, "1/2/2020 3:04:05": 1577934245, "2020-01-01T00:00:00+01": 1577833200, "2020-01-01T00:00:00.250": 1577836800.25, "2020-01-01 00:00:00": 1577836800, "2020-13-01": None, "x": None}
        df = spark.createDataFrame([(t,) for t in cases], "t string")
        assert {r.t: r.v for r in df.select("t", (F.unix_micros(p.value) / 1e6).alias("v")).collect()} == cases
        assert {r.t for r in df.where(p.ok).collect()} == {t for t, v in cases.items() if v is not None}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_decimals_of_any_size(spark):
    for kind, text, want in (("decimal(38,2)", "79228162514264337593543950335", "79228162514264337593543950335.00"), ("decimal(38,18)", "1.000000000000000001", "1.000000000000000001"), ("decimal(38,6)", "1000000000000000000000.5", "1000000000000000000000.500000")):
        got = rows(Static(Schema.of(a=kind)).read_texts(spark, f"a\n{text}"), "a")
        assert got == [(decimal.Decimal(want),)]
        df = spark.createDataFrame(got, f"a {kind}")
        assert whole(writer.to_text(df, Schema.of(a=kind), ["a"])) == [f"a\r\n{text}"]


def test_malformed_texts_name_what_is_wrong(spark):
    from quillet.operators.strict import read_strict

    df = spark.createDataFrame([("1", "a,b\nc"), ("2", 'a,"b'), ("3", 'x"y'), ("4", None), ("5", "﻿z")], "source string, text string")
    got = {(r.source, r.position): (r["values"], r.error) for r in read_strict(df, DEFAULT.but(read_ending="LF")).collect()}
    assert got[("1", 0)] == (["a", "b"], None) and got[("1", 1)] == (["c"], None) and got[("5", 0)] == (["z"], None)
    assert "unexpectedly" in got[("2", 0)][1] and "already in a value" in got[("3", 0)][1] and ("4", 0) not in got
