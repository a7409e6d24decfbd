"""WARC archives with a two-level capture index.

``write_archive`` writes one gzip member per record from the executors into a shared folder, then sorts the captures by
their reversed-host URL key into compressed blocks. Each range of keys is a shard: a block file and its sparse directory (the
first key of each block). The list of shards, at most ``MAX_SHARDS`` rows, is all that the driver holds. ``lookup``
binary-searches shard, directory, block and line before it reads a record's byte range.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, shared_dir, stage, tidy, utf8

#: Captures in a block of the index; shards of the index at most.
BLOCK, MAX_SHARDS = 500, 4096
#: Payloads from this size on are deduplicated.
MIN_DEDUP_BYTES = 100
_DATE = "2000-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = re.compile(r"urn:page:(-?\d+|-)")


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query: ``http://www.a.com/x?q`` -> ``com,a)/x?q``; null -> ``-``."""
    if url is None:
        return "-"
    text = quote(url.strip(), safe="/?#=&:%,;@!$()*+~'[]|^{}<>\\\"", encoding="utf-8")
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text
    if not host:
        return text
    labels = [x for x in host.split(".") if x]
    labels = labels[1:] if len(labels) > 2 and labels[0] == "www" else labels
    return ",".join(reversed(labels)) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_key(url: str | None, page_id: int | None) -> str:
    """URL key and page id, in an order in which bytes sort as (key, id)."""
    return f"{url_key(url)} {'-' if page_id is None else f'{page_id + 2**63:020d}'}"


def _keys(pages: DataFrame) -> DataFrame:
    @tidy
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, i) for u, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], ["capture_key"])

    return pages.select(F.col("url").cast("string"), F.col("page_id").cast("long")).mapInArrow(keys, "capture_key string").distinct()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed; a revisit holds the HTTP head only."""
    name = lambda i: f"<urn:page:{'-' if i is None else i}>"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {_DATE}"]
    fields += [f"WARC-Target-URI: {quote(url, safe=chr(37) + '/?#=&:,;@!$()*+~')}"] if url is not None else []
    fields += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if refers_to is not None else []
    return "\r\n".join([*fields, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of a record: the length and digest of a response's payload are taken from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if fields["WARC-Type"] == "response":
        if len(payload) != length or hashlib.sha256(payload).hexdigest() != said:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    number = lambda k: None if k not in fields or (x := _RECORD.search(fields[k])[1]) == "-" else int(x)
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload": payload if fields["WARC-Type"] == "response" else None, "payload_bytes": length, "payload_digest": said, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To")}


@dataclass
class Archive:
    """A written archive: its folder and the shards of its index, as (first capture key, block file, directory file)."""

    root: str
    shards: list[tuple[str, str, str]]


def _open(root: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri(root)


def write_archive(pages: DataFrame, root: str | None = None) -> Archive:
    """Write ``pages`` (page_id, url, html) as WARC files under ``root`` and index them.

    Of rows with equal payloads of at least ``MIN_DEDUP_BYTES`` bytes, that with the smallest page_id is the response and the
    others are revisits of it; rows that repeat its page_id are responses too. Null html is an empty payload. A null
    page_id never is the one referred to; such rows are responses unless another row holds their payload. A null url gets
    the key ``-``. Other columns are not read. Files that a lost task left are in no index and so are never read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    root = root or f"{shared_dir(spark)}/quillet-warc-{uuid.uuid4().hex}"
    fs, base = _open(root)
    fs.create_dir(base, recursive=True)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    large = pages.select(F.col("page_id").cast("long"), F.sha2(html, 256).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= MIN_DEDUP_BYTES)
    copies = stage(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"), "copies")
    # the html is not brought together by what it holds: references are found on ids and digests, and go to their page
    revisits = pages.select(F.col("page_id").cast("long"), F.sha2(html, 256).alias("digest")).join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    named = lambda p: (F.coalesce(p, F.lit(0)).alias("id"), p.isNull().alias("nameless"))
    revisits = revisits.select(*named(F.col("page_id")), "digest", "first").distinct()
    rows = rows.select("*", *named(F.col("page_id"))).join(revisits, ["id", "nameless", "digest"], "left").select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            made = []
            for i, url, text, digest, to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or fs.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record(i, url, text.encode(), digest, to), 3, mtime=0)
                out.write(data)
                made.append((capture_key(url, i), name, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["capture_key", "file", "offset", "length"])
        if out:
            out.close()

    captures = stage(rows.mapInArrow(write, "capture_key string, file string, offset long, length long"), "captures")

    @tidy
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(root)
        name, out, at, lines, directory = uuid.uuid4().hex, None, 0, [], []

        def close_block() -> None:
            nonlocal at, lines
            data = zlib.compress("\n".join("\t".join(x) for x in lines).encode(), 6)
            out.write(data)
            directory.append((lines[0][0], at, len(data)))
            at, lines = at + len(data), []

        for b in batches:
            out = out or fs.open_output_stream(f"{base}/{name}.cdx", compression=None)
            for k, f, o, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append((k, f, str(o), str(n)))
                if len(lines) >= BLOCK:
                    close_block()
        if lines:
            close_block()
        if out:
            out.close()
        if directory:
            with fs.open_output_stream(f"{base}/{name}.dir", compression=None) as d:
                d.write(zlib.compress(json.dumps(directory).encode()))
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([f"{name}.cdx"]), pa.array([f"{name}.dir"])], ["first", "blocks", "directory"])

    n = min(MAX_SHARDS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    shards = captures.repartitionByRange(n, "capture_key", "file", "offset").sortWithinPartitions("capture_key", "file", "offset").mapInArrow(blocks, "first string, blocks string, directory string")
    return Archive(root, sorted((r.first, r.blocks, r.directory) for r in shards.collect()))


class Index:
    """A worker's view of an archive: directories, the latest blocks and open files are kept."""

    def __init__(self, archive: Archive):
        self.fs, self.base = _open(archive.root)
        self.shards, self.firsts = archive.shards, [s[0].encode() for s in archive.shards]
        self.directories, self.blocks, self.files = OrderedDict(), OrderedDict(), OrderedDict()

    def _kept(self, where: OrderedDict, key, make, most: int):
        if key not in where:
            where[key] = make()
            if len(where) > most:
                where.popitem(last=False)
        where.move_to_end(key)
        return where[key]

    def read(self, name: str, at: int, n: int) -> bytes:
        return self._kept(self.files, name, lambda: self.fs.open_input_file(f"{self.base}/{name}"), 64).read_at(n, at)

    def directory(self, shard: int) -> list:
        def load() -> list:
            with self.fs.open_input_file(f"{self.base}/{self.shards[shard][2]}") as f:
                return [(k.encode(), o, n) for k, o, n in json.loads(zlib.decompress(f.read()))]

        return self._kept(self.directories, shard, load, 16)

    def block(self, shard: int, entry: tuple) -> list:
        load = lambda: [x.split(b"\t") for x in zlib.decompress(self.read(self.shards[shard][1], *entry[1:])).split(b"\n")]
        return self._kept(self.blocks, (shard, entry[1]), load, 16)

    def find(self, prefix: str) -> Iterator[tuple[str, int, int]]:
        """Places of all captures whose key starts with ``prefix``: binary searches down to the first, then onwards."""
        p = prefix.encode()
        shard = max(0, bisect.bisect_left(self.firsts, p) - 1)
        for s in range(shard, len(self.shards)):
            if s > shard and self.firsts[s] > p and not self.firsts[s].startswith(p):
                return
            directory = self.directory(s)
            start = max(0, bisect.bisect_left(directory, p, key=lambda x: x[0]) - 1)
            for entry in directory[start:]:
                if entry[0] > p and not entry[0].startswith(p):
                    return
                lines = self.block(s, entry)
                for k, f, o, n in lines[bisect.bisect_left(lines, p, key=lambda x: x[0]) :]:
                    if not k.startswith(p):
                        return
                    yield f.decode(), int(o), int(n)


def lookup(archive: Archive, keys: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the captures whose key starts with a ``capture_key`` of ``keys`` (full keys, or ``url_key(url) + ' '``).

    Returns page_id, url, payload_bytes, payload_digest, record_type and refers_to; with ``payloads`` the bytes too
    (null for revisits). Keys that match nothing give no row. Sorted keys share directories, blocks and open files.
    """
    spark = keys.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(archive)
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for b in batches:
            found = [parse(gzip.decompress(index.read(*place))) for k in utf8(b.column(0)).to_pylist() for place in index.find(k)]
            for i in range(0, len(found), 200) if payloads else [0]:
                part = found[i : i + 200] if payloads else found
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in part], t) for c, t in kinds.items()], list(kinds))

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keys.select("capture_key").repartitionByRange(n, "capture_key").sortWithinPartitions("capture_key").mapInArrow(read, schema)


def archive_and_read_back(pages: DataFrame, root: str | None = None) -> DataFrame:
    """Write and index ``pages``, then look every capture up again (see ``write_archive`` for what each case gives)."""
    return lookup(write_archive(pages, root), _keys(pages))
