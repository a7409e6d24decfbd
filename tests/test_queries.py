"""Registered queries against their SQL, on texts that are empty, null or odd."""

import duckdb
import pytest

from quillet.options import DEFAULT
from quillet.queries import oracle_sql, queries
from quillet.sources.reader import read_with_comments

TEXTS = ["plain", "", None, '""', '"', ",", "#", "#note", "\n", "\r\n", " ", 'a "b",\nc', "", "\ufeff", "x,", "\U0001f600"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    docs = [(150 + i, t, ("en", "", None, 'd"e')[i % 4]) for i, t in enumerate(TEXTS * 6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, "http://a.b/", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize("name", ["strict_read", "malformed_diagnosis", "stitched_records", "roundtrip_quoted", "comments_interleaved"])
def test_empty_null_and_odd_texts(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    by = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in queries()[name](spark, folder).collect()), key=by) == sorted(con.execute(oracle_sql()[name]).fetchall(), key=by)


def test_texts_of_one_source_are_numbered_apart(spark):
    texts = spark.createDataFrame([("a", "#x\n1\n2"), ("a", "1\n#x\n2"), (None, "1"), (None, "1\n2")], "source string, text string")
    rows = read_with_comments(texts, DEFAULT.but(comment="#", read_ending="LF")).where("kind = 'row'").collect()
    assert sorted((r.source or "", r["values"][0], r.row_number) for r in rows) == sorted([("a", "1", 0), ("a", "2", 1)] * 2 + [("", "1", 0)] * 2 + [("", "2", 1)])
