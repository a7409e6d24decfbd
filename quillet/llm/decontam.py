"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item gives windows of ``WINDOW`` consecutive words (one shorter window for a shorter item). A window's
shingles are ordered by how often the corpus holds them, rarest first; as a window has to occur whole, its prefix is its one
rarest shingle, and a document that lacks it cannot hold the window. A prefix shingle found in a document fixes where the
window would have to lie (positional bound) and that it has to fit there (length bound); what is left is verified word by word.

Up to ``BLOCK`` windows are broadcast, and the documents are not shuffled. More of them are taken block by block, so that what is
broadcast is bounded whatever the benchmark's size: each block's hits are written, and joined to the documents in the end.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BY_ALNUM, Words, bounded_batches, by_bytes, columns_by_bytes, sequence_hash, stage, tidy

WINDOW, SHINGLE = 13, 5
#: Windows that are broadcast at a time.
BLOCK = 100_000
_FILTER_BITS = 22
_FOUND = "struct<n_words:bigint,spans:array<struct<start:int,end:int>>,items:array<string>>"


def _windows(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (words, n, item) of all windows; words are joined by spaces."""

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            w, rows = Words(b.column(1), BY_ALNUM), []
            words = [w.data[s:e].tobytes() for s, e in zip(w.starts, w.ends, strict=True)]
            for d, name in enumerate(b.column(0).to_pylist()):
                own = words[w.first[d] : w.first[d + 1]]
                n = min(WINDOW, len(own))
                rows += [(b" ".join(own[i : i + n]), n, name) for i in range(len(own) - n + 1)] if n else []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int32(), pa.string()))], ["words", "n", "item"])

    return items.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).mapInArrow(cut, "words binary, n int, item string").distinct()


class Block:
    """Windows with the hashes of their shingles."""

    def __init__(self, rows: list):
        by_words: dict[tuple[bytes, int], set] = defaultdict(set)
        for r in rows:
            by_words[bytes(r.words), r.n].add(r.item)
        self.words = [k[0] for k in by_words]
        self.n = np.array([k[1] for k in by_words], np.int64)
        self.items = [sorted(x for x in v if x is not None) for v in by_words.values()]
        w = Words(pa.array(self.words, pa.binary()), BY_ALNUM)
        self.hash = np.zeros(len(self.n), np.uint64)
        #: (length of a shingle) -> hashes, and for each the window and the shingle's place in it
        self.shingles: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(self.n):
            own = np.flatnonzero(self.n == n)
            self.hash[own] = sequence_hash(w.hashes, w.first[own], int(n))
        for k in np.unique(np.minimum(self.n, SHINGLE)):
            at, h = w.shingles(int(k))
            keep = np.minimum(self.n, SHINGLE)[w.doc[at]] == k
            self.shingles[int(k)] = h[keep], w.doc[at][keep], (at - w.first[w.doc[at]])[keep]


class Filter:
    """Sorted hashes behind a bitmap that most other hashes fail."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.seen = np.zeros(1 << _FILTER_BITS, bool)
        self.seen[self.hashes & np.uint64((1 << _FILTER_BITS) - 1)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h are known, and their places among the sorted hashes."""
        at = np.flatnonzero(self.seen[h & np.uint64((1 << _FILTER_BITS) - 1)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        ok = self.hashes[place] == h[at]
        return at[ok], place[ok]


def _rarity(docs: DataFrame, text: str, shared) -> dict[int, dict[int, int]]:
    """How often the documents hold each of the block's shingles: partial sums in each partition, then one small sum."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = {k: Filter(v[0]) for k, v in shared.value.shingles.items()}
        sums = {k: np.zeros(len(f.hashes), np.int64) for k, f in filters.items()}
        for b in by_bytes(batches, 0):
            w = Words(b.column(0), BY_ALNUM)
            for k, f in filters.items():
                _, place = f.find(w.shingles(k)[1])
                sums[k] += np.bincount(place, minlength=len(f.hashes))
        for k, f in filters.items():
            has = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), k, np.int32)), pa.array(f.hashes[has].view(np.int64)), pa.array(sums[k][has])], ["k", "h", "n"])

    found: dict[int, dict[int, int]] = defaultdict(dict)
    for r in docs.select(F.col(text).alias("text")).mapInArrow(count, "k int, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n")).collect():
        found[r.k][r.h & (2**64 - 1)] = r.n
    return found


class Prefixes:
    """A block's rarest shingles, ready for lookups."""

    def __init__(self, block: Block, rarity: dict[int, dict[int, int]]):
        self.words, self.n, self.hash, self.items, self.by_k = block.words, block.n, block.hash, block.items, {}
        for k, (h, window, place) in block.shingles.items():
            often = np.array([rarity[k].get(int(x), 0) for x in h], np.int64)
            order = np.lexsort((h, often, window))
            rarest = order[np.unique(window[order], return_index=True)[1]]
            rarest = rarest[np.argsort(h[rarest], kind="stable")]
            # a window whose rarest shingle is nowhere in the corpus is nowhere either
            rarest = rarest[often[rarest] > 0]
            self.by_k[k] = h[rarest], window[rarest], place[rarest]

    def matches(self, w: Words, filters: dict[int, Filter]) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur in the texts and the words they start at."""
        windows, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, (h, window, place) in self.by_k.items():
            if not len(h):
                continue
            at, found = w.shingles(k)
            i, j = filters[k].find(found)
            first = np.searchsorted(h, filters[k].hashes[j], "left")
            many = np.searchsorted(h, filters[k].hashes[j], "right") - first
            entry = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            pos, doc = np.repeat(at[i], many), np.repeat(w.doc[at[i]], many)
            start, win = pos - place[entry], window[entry]
            fits = (start >= w.first[doc]) & (start + self.n[win] <= w.first[doc + 1])
            start, win = start[fits], win[fits]
            for n in np.unique(self.n[win]):
                own = np.flatnonzero(self.n[win] == n)
                own = own[sequence_hash(w.hashes, start[own], int(n)) == self.hash[win[own]]]
                same = [x for x in own if b" ".join(w.data[s:e].tobytes() for s, e in zip(w.starts[start[x] : start[x] + n], w.ends[start[x] : start[x] + n], strict=True)) == self.words[win[x]]]
                windows.append(win[same])
                starts.append(start[same])
        return np.concatenate(windows), np.concatenate(starts)


def _finder(shared) -> Column:
    @F.arrow_udf(_FOUND)
    @tidy
    def find(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        prefixes = shared.value
        filters = {k: Filter(v[0]) for k, v in prefixes.by_k.items() if len(v[0])}
        for column in columns_by_bytes(texts):
            w = Words(column, BY_ALNUM)
            windows, starts = prefixes.matches(w, filters)
            marks = np.zeros(len(w.starts) + 1, np.int64)
            np.add.at(marks, starts, 1)
            np.add.at(marks, starts + prefixes.n[windows], -1)
            hit = np.zeros(len(w.starts) + 2, np.int8)
            hit[1:-1] = np.cumsum(marks[:-1]) > 0
            items = defaultdict(set)
            for d, win in zip(w.doc[starts], windows, strict=True):
                items[d].update(prefixes.items[win])
            out = []
            for d in range(len(column)):
                a, b = w.first[d], w.first[d + 1]
                spans = []
                if d in items or (len(starts) and hit[a + 1 : b + 1].any()):
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[a + 1 : b + 1], [0]))))
                    spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2], strict=True)]
                out.append({"n_words": int(b - a), "spans": spans, "items": sorted(items.get(d, ()))})
            yield pa.array(out, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))]))

    return find


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch joined."""

    @F.arrow_udf("array<struct<start:int,end:int>>")
    @tidy
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            out = []
            for found in column.to_pylist():
                own: list[dict] = []
                for s in found:
                    if own and s["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(s)
                out.append(own)
            yield pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return run(spans)


def _by_blocks(docs: DataFrame, windows: DataFrame, text: str, into: str) -> DataFrame:
    """For windows beyond ``BLOCK``: block after block is looked up and its hits are written; only one is ever broadcast.

    A hit names its window; the items that hold the window are joined to it by Spark, however many they are.
    """
    sc = docs.sparkSession.sparkContext
    row = f"{into}__row"
    docs = stage(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    one = stage(windows.select("words", "n").distinct().withColumn("window", F.monotonically_increasing_id()), "numbers")
    blocks, hits = -(-one.count() // BLOCK), None
    for b in range(blocks):
        rows = one.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).withColumn("item", F.col("window").cast("string")).collect()
        block = Block(rows)
        shared = sc.broadcast(block)
        prefixes = sc.broadcast(Prefixes(block, _rarity(docs, text, shared)))
        found = docs.select(F.col(row).alias("row"), _finder(prefixes)(F.col(text)).alias("found")).where(F.size("found.items") > 0)
        found = stage(found.select("row", "found.spans", "found.items"), "hits")
        for x in (shared, prefixes):
            x.destroy()
        hits = found if hits is None else hits.union(found)
    held = one.join(windows, ["words", "n"]).select(F.col("window").cast("string").alias("window"), "item")
    items = hits.select("row", F.explode("items").alias("window")).join(held, "window").where("item is not null").select("row", "item").distinct()
    items = items.groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items"))
    spans = hits.select("row", F.explode("spans").alias("s")).distinct().groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("s"))
    found = stage(spans.join(items, "row", "left").select("row", _merged(F.col("s")).alias("spans"), "items"), "found")
    # nothing to look up: the number of words only
    words = _finder(sc.broadcast(Prefixes(Block([]), {})))(F.col(text))["n_words"]
    lists = ("array<struct<start:int,end:int>>", "array<string>")
    parts = [F.coalesce(F.col(f"__{c}"), F.array().cast(t)).alias(c) for c, t in zip(("spans", "items"), lists, strict=True)]
    joined = docs.withColumn("__n_words", words).join(found.toDF("__row", "__spans", "__items"), F.col(row) == F.col("__row"), "left")
    return joined.withColumn(into, F.struct(F.col("__n_words").alias("n_words"), *parts)).drop(row, "__n_words", "__row", "__spans", "__items")


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", into: str = "contamination") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, spans (word positions, end exclusive, merged) and items (ids as strings, sorted).

    Null text has no words; an item without words has no window; a null item id marks words but is not listed; equal
    windows of several items name them all; rows are kept as they come. Either table may be empty.
    """
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    windows = stage(_windows(benchmark, item, item_text), "windows")
    if windows.count() > BLOCK:
        return _by_blocks(docs, windows, text, into)
    block = Block(windows.collect())
    shared = sc.broadcast(block)
    prefixes = Prefixes(block, _rarity(docs, text, shared))
    shared.destroy()
    return docs.withColumn(into, _finder(sc.broadcast(prefixes))(F.col(text)))


def summary(found: Column) -> dict[str, Column]:
    """Counts and digest of a ``find_contamination`` struct; a document is contaminated when at least a twentieth of its words is hit."""
    n_hit = F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return {
        "n_words": found["n_words"], "n_hit": n_hit, "n_items": F.size(found["items"]).cast("long"),
        "items_sha256": F.sha2(F.array_join(found["items"], ","), 256), "contaminated": (n_hit > 0) & (n_hit * 20 >= found["n_words"]),
    }
