"""Staging, Arrow access and vectorised hashing that the operators share."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python, and bytes of its texts that are worked on at a time: both bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 400, 1 << 18
#: Where a row holds megabytes: bytes of rows in an Arrow batch, and bytes (compressed) of rows that Parquet's writer and reader hold at once.
WIDE_BYTES = 8 << 20
#: Rows of keys that are broadcast at most (some 40 MB as a hash table).
SMALL = 1_000_000


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int | None = None) -> None:
    """Cap the session's Arrow batches at ``rows`` rows, and at ``size`` bytes or one row (lower settings stay)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    set_ = re.fullmatch(r"(\d+)([kmg]?)b?", str(spark.conf.get(key, None)).lower())
    if size and not (set_ and int(set_[1]) << 10 * "_kmg".index(set_[2] or "_") <= size):
        spark.conf.set(key, str(size))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillet-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def stage(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``wide``: rows hold megabytes. Parquet's writer else looks at its size after a hundred rows only, and a task's rows are written, and read again, all at once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillet-{name}-{uuid.uuid4().hex}"
    # nothing else reads this query's shuffles: let Spark delete their files when it ends
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    try:
        groups = {"parquet.page.size.row.check.min": 1, "parquet.block.size": WIDE_BYTES} if wide else {}
        df.write.options(compression="zstd", **groups).parquet(path)
    finally:
        spark.conf.set(cleanup, before)
    back = spark.read.schema(df.schema).parquet(path)
    back.staged_at = path
    return back


def if_small(keys: DataFrame) -> DataFrame:
    """Rows of a few numbers, written before: marked for broadcast if they are ``SMALL`` at most, so that what they are joined to stays where it is."""
    return F.broadcast(keys) if keys.count() <= SMALL else keys


def discard(df: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- memory of Python workers ---------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], object]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # not this C library
        return lambda _: None


def tidy(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """For functions that run in Python workers: what a task has freed goes back to the system, as workers outlive their tasks."""

    @functools.wraps(f)
    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        _trim()(0)

    return run


# --- Arrow ---------------------------------------------------------------------------------------


def utf8(column: pa.Array) -> pa.Array:
    """Strings with null as empty, 64-bit offsets."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def flat_bytes(column: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, each followed by ``end``, and the n + 1 offsets."""
    texts = utf8(column).cast(pa.large_binary())
    if end:
        texts = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(end, pa.large_binary()))
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(column: pa.Array, most: int = BATCH_BYTES) -> list[tuple[int, int]]:
    """(first row, number of rows) of consecutive pieces of a column of texts of at most ``most`` bytes, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    out, at = [], 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        out.append((at, end - at))
        at = end
    return out


def by_bytes(batches: Iterator[pa.RecordBatch], column: int | str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of a bounded number of bytes of texts; an empty batch stays."""
    for b in batches:
        for at, n in cuts(b.column(column), most) or [(0, 0)]:
            yield b.slice(at, n)


def columns_by_bytes(columns: Iterator[pa.Array], most: int = BATCH_BYTES) -> Iterator[pa.Array]:
    for c in columns:
        for at, n in cuts(c, most) or [(0, 0)]:
            yield c.slice(at, n)


def gathered(columns: Iterator[pa.Array], least: int) -> Iterator[pa.Array]:
    """Columns of texts put together until they have ``least`` bytes, for work that is shared by equal words."""
    held, size = [], 0
    for c in columns:
        held.append(c)
        size += pc.sum(pc.binary_length(c)).as_py() or 0
        if size >= least:
            yield pa.concat_arrays(held)
            held, size = [], 0
    if held:
        yield pa.concat_arrays(held)


def binaries(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, pa.binary())


# --- hashes --------------------------------------------------------------------------------------

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)  # odd: a unit modulo 2**64
_BASE_INVERSE = _U(pow(int(_BASE), -1, 2**64))
#: Bytes hashed at a time.
_SPAN = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least 0 to n (sizes are rounded up, to be reused)."""
    return _powers(max(_SPAN, 1 << int(n - 1).bit_length()) if n > 1 else _SPAN)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """c with c[j] - c[i] = hash of data[i:j] times base**i."""
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data))[0][: len(data)], out=c[1:])
    return c


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; spans ascend and do not overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _SPAN, "right")))
        base = starts[i]
        c = prefix_hash(data[base : ends[j - 1]])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((c[e] - c[s]) * powers(len(c))[1][s] + (e - s).astype(np.uint64) * _STEP)
        i = j
    return out


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; starts ascend, and ranges may overlap."""
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + _SPAN, "right")))
        base = starts[i]
        c = prefix_hash(data[base : ends[i:j].max()])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((c[e] - c[s]) * powers(len(c))[1][s] + (e - s).astype(np.uint64) * _STEP)
        i = j
    return out


class Words:
    """Words of a batch of texts.

    ``table`` maps a byte to what it counts as, 0 where it separates words. Every text has to end in a
    separator (``flat_bytes(column, b"\\n")``), so that no word runs on into the next text.
    """

    def __init__(self, column: pa.Array, table: np.ndarray):
        raw, offsets = flat_bytes(column, b"\n")
        self.data = table[raw]
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = self.data != 0
        edges = np.flatnonzero(np.diff(inside))
        self.starts, self.ends = edges[::2], edges[1::2]
        #: first[d] to first[d + 1] are the words of text d
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (of the first word) and hashes of all runs of n words inside one text."""
        if len(self.hashes) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, sequence_hash(self.hashes, at, n)


def sequence_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position."""
    h = np.full(len(at), n * int(_STEP) % 2**64, np.uint64)
    for k in range(n):
        h = mix(h * _BASE + hashes[at + k])
    return h


def lower_table(separators: bytes) -> np.ndarray:
    """Byte table for ``Words``: A-Z to lower case, the given bytes separate."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = 0
    return table


#: Separators are white space only.
BY_SPACE = lower_table(b"\x20\x09\x0a\x0b\x0c\x0d")
# NUL is part of a word: it counts as a byte that UTF-8 never holds, as 0 separates
BY_SPACE[0] = 0xFF
#: Words are letters, digits and whatever is not ASCII.
BY_ALNUM = lower_table(bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
