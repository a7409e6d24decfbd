"""The expressions against the table-driven reader, on golden texts and on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from quillet.operators import strict
from quillet.operators.tokenize import detect_ending, records, well_formed
from quillet.options import Options, OptionsError

DIALECTS = {
    "default": Options(),
    "lf": Options(read_ending="LF"),
    "cr": Options(read_ending="CR"),
    "crlf": Options(read_ending="CRLF"),
    "backslash": Options(escape="\\", read_ending="LF"),
    "no_escape": Options(escape=None, read_ending="LF"),
    "no_quote": Options(quote=None, escape=None, read_ending="LF"),
    "comments": Options(comment="#", read_ending="LF"),
    "comments_crlf": Options(comment="#", read_ending="CRLF"),
    "multi": Options(separator="#*#", read_ending="LF"),
    "trim": Options(trim_leading_in=True, trim_trailing_in=True, trim_before=True, trim_after=True, read_ending="LF"),
    "trim_between": Options(trim_before=True, trim_after=True, read_ending="CRLF", comment="#"),
    "trim_in": Options(trim_leading_in=True, trim_trailing_in=True, read_ending="LF"),
}


def native(spark, texts, o):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    ok = {r.i: r.ok for r in df.select("i", well_formed(F.col("t"), o).alias("ok")).collect()}
    good = df.where(well_formed(F.col("t"), o))
    got = {r.i: [(x.kind, list(x["values"]) if x["values"] is not None else None, x.comment) for x in r.r] for r in good.select("i", records(F.col("t"), o).alias("r")).collect()}
    return [got.get(i) if ok[i] else None for i in range(len(texts))]


def expected(text, o):
    try:
        return strict.read(text, o)
    except strict.Malformed:
        return None


@pytest.mark.parametrize("name", DIALECTS)
def test_random_texts(spark, name):
    o, rng = DIALECTS[name], random.Random(name)
    pieces = ["a", "b", ",", '"', '""', "\n", "\r", "\r\n", " ", "\t", "#", "\\", "#*#", '"x,y"', '"p\nq"', " ", "", ",,"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    for text, got in zip(texts, native(spark, texts, o), strict=True):
        assert got == expected(text, o), (name, text)


CASES = [
    ("a,", [["a"]]), (",a", [["", "a"]]), ('a,"",b', [["a", "", "b"]]), ("a\n\nb", [["a"], [], ["b"]]), ('1,x"y', None), ('"x"y', None), ('1,"x', None),
    ("a\rb\nc", [["a\rb"], ["c"]]), ('a,""\nb', [["a"], ["b"]]), ('a,""', [["a", ""]]), ("", []), ("\n", [[]]), ("a,,\n", [["a", ""]]), ('"a""b"', [['a"b']]),
]


def test_absent_and_empty(spark):
    o = Options(read_ending="LF")
    got = native(spark, [t for t, _ in CASES], o)
    assert [None if g is None else [v for _, v, _ in g] for g in got] == [w for _, w in CASES]


def test_endings(spark):
    cases = [("foo", "CRLF"), ('"foo\rbar"\r\n', "CRLF"), ('"foo\r\nbar"\n', "LF"), ('"foo\nbar"\r', "CR"), ("a\nb\r\n", "LF"), ("\r", "CR")]
    df = spark.createDataFrame([(t,) for t, _ in cases], "t string")
    assert [r[0] for r in df.select(detect_ending(F.col("t"), Options())).collect()] == [e for _, e in cases]
    assert [strict.detect(t, Options()) for t, _ in cases] == [e for _, e in cases]
    o = Options(separator="###")
    text = 'a##b###c#d###"one###two"###"three###"\r'
    assert spark.createDataFrame([(text,)], "t string").select(detect_ending(F.col("t"), o)).first()[0] == "CR"


def test_long_quoted_value(spark):
    text = 'a,"' + "x,\n" * 400_000 + '"\nb,c'
    got = native(spark, [text], Options(read_ending="LF"))[0]
    assert [len(v) for _, v, _ in got] == [2, 2] and len(got[0][1][1]) == 1_200_000


def test_strict_messages():
    o = Options(read_ending="LF")
    for text, message in (('1,x"y', "starting an escaped value"), ('"x', "Data ended unexpectedly"), ('"x"y', "escape sequence")):
        with pytest.raises(strict.Malformed, match=message):
            strict.read(text, o)
    with pytest.raises(strict.Malformed, match="end of record"):
        strict.read("a\rb", Options(read_ending="CRLF"))


@pytest.mark.parametrize("bad", [{"separator": ""}, {"separator": '"'}, {"comment": '"'}, {"quote": None}, {"trim_after": True, "separator": "\t"}, {"read_header": "MAYBE"}, {"read_buffer_hint": -1}, {"comment": ","}])
def test_validation(bad):
    with pytest.raises(OptionsError):
        Options(**bad)
