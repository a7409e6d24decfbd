"""How the work of a query grows: what is read, matched and shuffled."""

import time

import pytest
from pyspark.sql import functions as F

from quillet.functions import parse
from quillet.operators import strict
from quillet.options import DEFAULT
from quillet.plans import Static
from quillet.queries import queries
from quillet.schema import Schema

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_and_values_are_matched_once(spark):
    assert plan(queries()["parse_timespan"](spark, SF)).count("regexp_extract_all(") == 2


@pytest.mark.parametrize(
    "text, micros",
    [
        ("1:2", 3_720_000_000), (" -1.02:03:04.5\n", -93_784_500_000), ("0:0:0.1234567", 123_456), ("0:0:0.000001", 1), ("7", 7 * 86_400_000_000), ("-7 ", -7 * 86_400_000_000), ("99999999.23:59:59", 8_639_999_999_999_000_000),
        ("24:00", None), ("0:60", None), ("0:0:60", None), ("1,2,3,4,5,6", None), ("1:2,3", None), ("", None), ("--1", None), ("123456789", None), ("1:2:3.12345678", None), ("+1:2", None),
    ],
)
def test_timespans(spark, text, micros):
    p = parse.PARSERS["timespan"](F.col("t"))
    got = spark.createDataFrame([(text,)], "t string").select(p.ok, F.unix_micros(F.timestamp_seconds(F.lit(0)) + p.value)).first()
    assert tuple(got) == (micros is not None, micros)


def test_large_files_shuffle_no_lines(spark, tmp_path):
    plan = Static(Schema.of(n="int", text="string"), DEFAULT.but(read_ending="LF", write_ending="LF"))
    plan.write(spark.range(1000).select(F.col("id").cast("int").alias("n"), F.lit("x").alias("text")), f"{tmp_path}/a")
    read = plan.read_large_files(spark, f"{tmp_path}/a")
    assert "hashpartitioning" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 1000


@pytest.mark.parametrize("size", ["400", "100000"])
def test_records_across_splits(spark, tmp_path, size):
    """Values of many lines, over several splits, in the header too."""
    schema, o = Schema.of(**{"n\nm" + "\n" * 70: "int", "text": "string"}), DEFAULT.but(read_ending="LF", write_ending="LF")
    want = [(i, "\n".join("ab﻿"[: i % 4] for _ in range(i % 50)) + '"x') for i in range(60)]
    df = spark.createDataFrame(want, ["n\nm" + "\n" * 70, "text"]).coalesce(1)
    Static(schema, o).write(df, f"{tmp_path}/a")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        got = Static(schema, o).read_large_files(spark, f"{tmp_path}/a").orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [x[1] for x in got] == list(range(60)) and [tuple(x[2:]) for x in got] == want


def test_unclosed_texts_are_not_walked_by_characters():
    text = '"' + "a value that never ends, " * 40_000
    began = time.process_time()
    with pytest.raises(strict.Malformed, match="ended unexpectedly"):
        strict.read(text, DEFAULT.but(read_ending="LF"))
    assert time.process_time() - began < 0.1
