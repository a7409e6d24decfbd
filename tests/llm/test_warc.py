"""Round trips through written archives, and lookups in their index."""

import gzip
import hashlib
import random

import pytest

from quillet.llm import warc
from quillet.llm.warc import archive_and_read_back, capture_key, lookup, url_key, write_archive


def pages():
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 9}.example.org/p/{rng.randrange(30)}?q={i % 4}", "<p>" + "x" * rng.choice([0, 10, 96, 97, 200]) + str(rng.randrange(3))) for i in range(120)]
    return [*rows, (200, None, None), (201, "http://www.a.com", ""), (202, "not a url", "é" * 60), (203, "http://[bad/", "é" * 60), (204, "HTTP://B.com:8080/ä b", "y" * 100_000), (205, "", "y" * 100_000), (-3, "http://z.org", "é" * 60)]


def brute(rows):
    first = {}
    for i, _, html in rows:
        first[html or ""] = min(first.get(html or "", i), i)
    out = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first[html] != i
        out[i] = (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html] if again else None)
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(4)


def found(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


@pytest.mark.parametrize("block", [500, 3])
def test_all_pages_come_back(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    back = archive_and_read_back(frame(spark, pages()))
    assert back.count() == len(pages()) and found(back) == brute(pages())


def test_index_finds_one_url_s_captures_and_nothing_else(spark, tmp_path):
    rows = pages()
    archive = write_archive(frame(spark, rows), f"file://{tmp_path}/a")
    url = rows[5][1]
    keys = spark.createDataFrame([(url_key(url) + " ",), (capture_key("http://nowhere.test/", 1),), (capture_key(*reversed(rows[124][:2])),)], "capture_key string")
    got = {r.page_id: r.payload for r in lookup(archive, keys, payloads=True).collect()}
    want = {i for i, u, _ in rows if u and url_key(u) == url_key(url)} | {204}
    assert set(got) == want
    assert bytes(got[204]) == b"y" * 100_000


def test_archives_are_gzip_members_of_warc_records(spark, tmp_path):
    write_archive(frame(spark, pages()), f"file://{tmp_path}/a")
    files = [p for p in tmp_path.rglob("*.warc.gz")]
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in files)
    assert raw.startswith(b"WARC/1.") and raw.count(b"WARC-Type: ") >= len(pages())


def test_url_keys_sort_by_host():
    assert url_key("http://www.a.com/x?q") == "com,a)/x?q" and url_key(None) == "-"


def test_empty_table_null_ids_and_repeated_rows(spark):
    assert archive_and_read_back(frame(spark, [])).count() == 0
    text = "z" * 300
    got = archive_and_read_back(frame(spark, [(None, "u", text), (7, "u", text), (7, "u", text), (9, "u", text)])).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 7), (7, "response", 0), (7, "response", 0), (9, "revisit", 7)]


def test_one_payload_on_many_pages(spark):
    hot, rows = "x" * 500, []
    rows = [(i, f"http://h{i % 50}.org/{i}", hot if i % 3 else f"own {i} " * 30) for i in range(10_000)] + [(None, None, hot), (20_000, "http://e.org/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: (r.record_type, r.refers_to) for r in archive_and_read_back(df).collect()}
    assert len(got) == len(rows) and got[1] == ("response", None) and got[None] == ("revisit", 1) and got[20_000] == ("response", None)
    assert all(got[i] == (("revisit", 1) if i % 3 and i != 1 else ("response", None)) for i in range(10_000))
