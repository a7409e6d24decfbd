"""Repeated byte strings by prefix doubling over content-chosen positions.

A suffix array of all bytes would move many times the corpus. Here the positions that are ranked are *anchors*: those whose
``GRAM`` bytes hash lowest in some run of ``RUN`` grams. Two equal strings have the same anchors wherever the runs around
those lie inside them, so each ``length``-byte string is looked at from one place only, its first inner anchor, of which there is one in
64 bytes or so. An anchor's first rank names the bytes that all strings of it share (270 for 400). Then, round by round, Spark sorts pairs of a
rank and a name for the bytes that lie between the last reach and the next, further one, and what is given a new rank by it is ranked again:

* a rank that is alone is dropped: none of its strings is repeated;
* where all that the strings of a rank cover is there twice, they all are, and it is done;
* what is between the two goes on, its strings in parts of a quarter (``ROUNDS``), whose common bytes reach further: 369, 393, and at last all 400,
  past which there is nothing left to rank.

A rank is a 64-bit hash of its pair, so that what decides in the end has been told apart in every round. No group is ever gathered:
groups are counted with partial sums, and what is found is joined back.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, discard, flat_bytes, if_small, mix, powers, prefix_hash, range_hashes, stage, tidy, utf8

_U = np.uint64
GRAM = 16
#: Strings of an anchor that share a rank, in each round after the first (which takes all of them).
ROUNDS = (32, 8, 1)
#: Bytes that are searched for anchors at a time, and those looked at beyond them inside a longer text.
_REGION = 1 << 20


class Reach:
    """Distances that follow from the length of the strings: an anchor p serves strings that start near to far bytes before it."""

    def __init__(self, length: int):
        if length < 4 * GRAM:
            raise ValueError(f"strings of {4 * GRAM} bytes at least")
        self.length, self.run = length, (length - GRAM) // 3
        self.near, self.far = self.run - 1, length - self.run - GRAM + 1


def _lowest(data: np.ndarray, run: int) -> tuple[np.ndarray, int]:
    """For each run of grams, the position of its lowest hash (the last such), and the number of runs."""
    n = len(data) - GRAM + 1
    c = prefix_hash(data)
    g = mix((c[GRAM:] - c[:-GRAM]) * powers(len(c))[1][:n])
    high = _U(0xFFFFFFFF00000000)
    runs = n - run + 1
    key = np.full(-(-n // run) * run, ~_U(0), np.uint64)
    key[:n] = (g & high) | (_U(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    blocks = key.reshape(-1, run)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(after[:runs], before[run - 1 : run - 1 + runs])
    return (_U(0xFFFFFFFF) - (low & _U(0xFFFFFFFF))).astype(np.int64), runs


def _regions(offsets: np.ndarray, overlap: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, and of these from, to counted) covering all texts: many short ones together, a long one in pieces."""
    d, n = 0, len(offsets) - 1
    while d < n:
        e = max(d + 1, int(np.searchsorted(offsets, offsets[d] + _REGION, "right")) - 1)
        a, b = int(offsets[d]), int(offsets[e])
        if b - a <= 2 * _REGION:
            yield a, b, a, b
        else:
            for c in range(a, b, _REGION):
                yield max(a, c - overlap), min(b, c + _REGION + overlap), c, min(b, c + _REGION)
        d = e


def anchors(data: np.ndarray, offsets: np.ndarray, r: Reach) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, position in it, low, high, narrow hash, wide hash) of anchors; the strings served start low to high bytes before."""
    for a, b, core_a, core_b in _regions(offsets, 4 * r.length):
        if b - a < r.length:
            continue
        part = data[a:b]
        low, runs = _lowest(part, r.run)
        ok = np.ones(runs, bool)
        for end in offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]:
            ok[max(0, end - a - r.run - GRAM + 2) : end - a] = False
        low = low[ok]
        if not len(low):
            continue
        p = low[np.append(True, low[1:] != low[:-1])] + a
        doc = np.searchsorted(offsets, p, "right") - 1
        start, end = offsets[doc], offsets[doc + 1]
        gap = np.full(len(p), r.length, np.int64)
        gap[1:] = np.where(doc[1:] == doc[:-1], p[1:] - p[:-1], r.length)
        lo = np.maximum(r.near, p + r.length - end)
        hi = np.minimum(np.minimum(r.near - 1 + gap, r.far), p - start)
        keep = (lo <= hi) & (p >= core_a) & (p < core_b)
        p, doc, start, lo, hi = p[keep], doc[keep], start[keep], lo[keep], hi[keep]
        if not len(p):
            continue
        narrow = range_hashes(data, p - r.near, p + r.length - r.far)
        order = np.argsort(p - hi, kind="stable")
        wide = np.empty(len(p), np.uint64)
        wide[order] = range_hashes(data, (p - hi)[order], (p - lo + r.length)[order])
        yield doc, p - start, lo, hi, narrow, mix(wide + (lo * 4096 + hi).astype(np.uint64))


def _rank(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        h = mix(h * _U(0x9E3779B97F4A7C15) + x.astype(np.uint64))
    return h


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _short(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.int32))


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Texts under the two numbers that name a row here: its key, and a 64-bit hash of the text in case rows share a key (null: 0)."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(value).alias("sum"), value.alias("text"))


def _anchor_rows(texts: DataFrame, r: Reach, ranks_only: bool) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", _REGION):
            data, offsets = flat_bytes(b.column("text"))
            ids, sums = b.column("id").to_numpy(), b.column("sum").to_numpy()
            for doc, pos, lo, hi, narrow, wide in anchors(data, offsets, r):
                if ranks_only:
                    yield pa.RecordBatch.from_arrays([_long(narrow)], ["k1"])
                else:
                    yield pa.RecordBatch.from_arrays([_long(narrow), _long(wide), _long(ids[doc]), _long(sums[doc]), _long(pos), _short(lo), _short(hi)], ["k1", "k2", "id", "sum", "pos", "lo", "hi"])

    return texts.mapInArrow(run, "k1 long" if ranks_only else "k1 long, k2 long, id long, sum long, pos long, lo int, hi int")


def _per_text(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each text, with arrays of the columns (bounded by the text's own length)."""
    names = [c for c in columns]
    got = rows.groupBy("id", "sum").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
    return got.select("id", "sum", *(F.col(f"rows.{c}").alias(c) for c in names))


def _lists(b: pa.RecordBatch, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and values of list columns, flattened."""
    first = b.column(names[0])
    rows = np.repeat(np.arange(len(b)), np.diff(first.offsets.to_numpy()))
    out = []
    for n in names:
        c = b.column(n)
        o = c.offsets.to_numpy()
        out.append(c.values.to_numpy(zero_copy_only=False)[o[0] : o[-1]])
    return rows, out


def _ranked(subset: DataFrame, chosen: DataFrame, r: Reach, strings: int) -> DataFrame:
    """The chosen rows' strings, ``strings`` to a rank: pairs of the new rank (the old one and the bytes that these strings share) and of what they cover."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", _REGION):
            data, offsets = flat_bytes(b.column("text"))
            doc, (pos, lo, hi, k1, asks) = _lists(b, "pos", "lo", "hi", "k1", "asks")
            first, last = (lo - r.near) // strings, (hi - r.near) // strings
            many = last - first + 1
            i = np.repeat(np.arange(len(pos)), many)
            j = first[i] + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            start, end = r.near + strings * j, r.near + strings * (j + 1) - 1
            at, low, high = offsets[doc[i]] + pos[i], np.maximum(lo[i], start), np.minimum(hi[i], end)
            # what any string of the whole part holds, whichever of them this anchor serves
            shared_from, shared_to = at - start, at - np.minimum(r.far, end) + r.length
            names = []
            for s, e in ((shared_from, shared_to), (at - high, at - low + r.length)):
                h, order = np.empty(len(s), np.uint64), np.argsort(s, kind="stable")
                h[order] = range_hashes(data, s[order], e[order])
                names.append(h)
            rank = _rank(k1[i], j, names[0])
            ids, sums = b.column("id").to_numpy()[doc[i]], b.column("sum").to_numpy()[doc[i]]
            yield pa.RecordBatch.from_arrays([_long(rank), _long(_rank(rank, names[1], low, high)), _long(ids), _long(sums), _long(pos[i]), _short(low), _short(high), pa.array(asks[i].astype(bool))], ["k1", "k2", "id", "sum", "pos", "lo", "hi", "asks"])

    rows = subset.join(_per_text(chosen, "pos", "lo", "hi", "k1", "asks"), ["id", "sum"])
    return rows.mapInArrow(run, "k1 long, k2 long, id long, sum long, pos long, lo int, hi int, asks boolean")


def _counted(rows: DataFrame) -> DataFrame:
    """Pairs of ranks with their number, and one row that stands for them all."""
    return rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "sum", "pos", "lo", "hi")).alias("row"), F.max("asks").alias("asks"))


def _undecided(counted: DataFrame) -> DataFrame:
    """Rows whose cover is alone but whose core is not, and one row for every other cover of the same core."""
    alone = (F.col("n") == 1) & F.col("asks")
    cores = counted.groupBy("k1").agg(F.max(alone).alias("open"), F.count(F.lit(1)).alias("covers")).where("open and covers > 1").select("k1")
    return counted.join(cores, "k1").select("k1", "row.*", alone.alias("asks"))


def _spans(rows: DataFrame, counted: DataFrame, r: Reach) -> DataFrame:
    """What the rows cover whose cover is there twice."""
    twice = counted.where("n > 1 and asks").select("k1", "k2")
    return rows.where("asks").join(twice, ["k1", "k2"]).select("id", "sum", (F.col("pos") - F.col("hi")).alias("start"), (F.col("pos") - F.col("lo") + r.length).alias("end"))


def repeated_spans(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sum, spans) of the texts that hold a ``length``-byte string found elsewhere; see ``remove_repeats``. Spans are sorted, not merged."""
    r = Reach(length)
    texts = _texts(docs, key, text)
    long_texts = texts.where(F.octet_length("text") >= length)
    first = stage(_anchor_rows(long_texts, r, True).groupBy("k1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1"), "ranks")
    rows = stage(_anchor_rows(long_texts, r, False).join(first, "k1").withColumn("asks", F.lit(True)), "anchors")
    counted = stage(_counted(rows), "counted")
    spans = [stage(_spans(rows, counted, r), "spans")]
    chosen = stage(_undecided(counted), "undecided")
    for done in (first, rows, counted):
        discard(done)
    subset = stage(long_texts.join(if_small(stage(chosen.select("id", "sum").distinct(), "names")), ["id", "sum"], "left_semi").dropDuplicates(["id", "sum"]), "texts")

    for strings in ROUNDS:
        ranked = stage(_ranked(subset, chosen, r, strings), "ranked")
        twice = stage(ranked.groupBy("k1").agg(F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")).where("n > 1 and asks").select("k1"), "twice")
        rows = stage(ranked.join(twice, "k1"), "rows")
        counted = stage(_counted(rows), "counted")
        spans.append(stage(_spans(rows, counted, r), "spans"))
        if strings > 1:
            chosen = stage(_undecided(counted), "undecided")
        for done in (ranked, twice, rows, counted):
            discard(done)
    found = functools.reduce(DataFrame.union, spans).distinct()
    return found.groupBy("id", "sum").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 400, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_bytes, spans (merged byte ranges that lie in a ``length``-byte string that also starts anywhere else) and kept (the remaining bytes).

    Strings are judged on the input, the same text included; matches never cross texts. Null text is empty. Rows keep their
    number: repeated rows are repeats of each other, and rows that share a key are told apart by their text. Other
    columns are not read; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    spans = stage(repeated_spans(docs, length, key, text), "found")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("sum"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", _REGION):
            texts, out_spans, kept = utf8(b.column("text")).cast(pa.large_binary()).to_pylist(), [], []
            for t, s in zip(texts, b.column("spans").to_pylist(), strict=True):
                done: list[list[int]] = []
                for x in s or ():
                    if done and x["start"] <= done[-1][1]:
                        done[-1][1] = max(done[-1][1], x["end"])
                    else:
                        done.append([x["start"], x["end"]])
                edges = [0, *(x for d in done for x in d), len(t)]
                kept.append(b"".join(t[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                out_spans.append([{"start": x, "end": y} for x, y in done])
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array(out_spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["key", "n_bytes", "spans", "kept"])

    joined = rows.join(spans, ["id", "sum"], "left").select("key", "text", "spans")
    return joined.mapInArrow(cut, f"key {kind}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary").withColumnRenamed("key", key)
