"""Token counts by a map-side two-tier lookup.

A SentencePiece model whose pieces never hold a space after another character encodes each run of
"spaces and the word after them" (a pre-token) on its own, so a text's count is the sum over its pre-tokens.
Tier one is a broadcast hash table, two arrays, of the lengths of frequent pre-tokens; tier two, in each Python worker, is a
bounded cache in front of the library. Pre-tokens are never shuffled: what leaves a partition is a summary of
at most ``SUMMARY`` candidates, from which the table (at most ``TABLE`` entries of at most ``WORD`` bytes) is made.
Both tiers know a pre-token by its 64-bit hash. The table only saves time; counts do not depend on it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, flat_bytes, span_hashes, tidy, utf8

#: Entries of the broadcast table, candidates a partition reports, bytes of a word that is kept anywhere.
TABLE, SUMMARY, WORD = 20_000, 2_000, 64
#: Entries of a worker's cache; it is emptied when full.
CACHE = 200_000


class PreTokens:
    """The pre-tokens of a batch of texts: places in its bytes, 64-bit hashes, and the text each belongs to."""

    def __init__(self, texts: pa.Array):
        spaced = pc.replace_substring(utf8(texts), "▁", " ")
        led = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), spaced, pa.scalar(" ", pa.large_string()))
        self.data, offsets = flat_bytes(pc.if_else(pc.equal(pc.binary_length(spaced), 0), spaced, led))
        space = self.data == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        self.starts = np.flatnonzero(begins)
        self.ends = np.append(self.starts[1:], len(self.data))[: len(self.starts)]
        self.doc = np.searchsorted(offsets, self.starts, "right") - 1
        # 0 marks a free slot
        self.hashes = np.maximum(span_hashes(self.data, self.starts, self.ends), np.uint64(1))

    def words(self, at: np.ndarray) -> list[str]:
        data = self.data.tobytes()
        return [data[a:b].decode() for a, b in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


class Lengths:
    """Hash table of pre-tokens' lengths: open addressing over two arrays."""

    def __init__(self, words: list[str], lengths: list[int]):
        data, offsets = flat_bytes(pa.array(words, pa.string()))
        hashes = np.maximum(span_hashes(data, offsets[:-1], offsets[1:]), np.uint64(1))
        bits = max(4, (2 * len(words)).bit_length())
        self.shift, self.mask, self.reach = np.uint64(64 - bits), (1 << bits) - 1, 1
        self.keys, self.lengths = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)
        for h, n in zip(hashes, lengths, strict=True):
            slot, steps = int(h >> self.shift), 1
            while self.keys[slot] and self.keys[slot] != h:
                slot, steps = (slot + 1) & self.mask, steps + 1
            self.keys[slot], self.lengths[slot], self.reach = h, n, max(self.reach, steps)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The length of each, 0 where it isn't known."""
        out, slot, rest = np.zeros(len(h), np.int64), (h >> self.shift).astype(np.int64), np.arange(len(h))
        for k in range(self.reach):
            at = (slot[rest] + k) & self.mask
            here = self.keys[at] == h[rest]
            out[rest[here]] = self.lengths[at[here]]
            rest = rest[~here & (self.keys[at] != 0)]
        return out


class PieceCounter:
    """Counts under one model (the bytes of its file)."""

    def __init__(self, model: bytes, frequent: Lengths | None = None):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.frequent, self.cache = frequent or Lengths([], []), {}
        bad = [i for i in range(self.sp.get_piece_size()) if "▁" in self.sp.id_to_piece(i).lstrip("▁")]
        if bad or not self.sp.encode("a b", out_type=str)[0].startswith("▁"):
            raise ValueError("this model's pieces cross spaces, or it adds no leading space: pre-tokens would not be independent")

    def lengths(self, words: list[str]) -> list[int]:
        """Tokens of each pre-token; the model puts back the leading space that is cut here, but not before nothing: a last space is a piece."""
        return [len(x) if w != " " else 1 for w, x in zip(words, self.sp.encode([w[1:] for w in words], num_threads=1), strict=True)] if words else []

    def count(self, texts: pa.Array) -> np.ndarray:
        t = PreTokens(texts)
        n = self.frequent.find(t.hashes)
        rest = np.flatnonzero(n == 0)
        h, first, back = np.unique(t.hashes[rest], return_index=True, return_inverse=True)
        keys, cache = h.tolist(), self.cache
        known = np.array([cache.get(k, 0) for k in keys], np.int64)
        new = np.flatnonzero(known == 0)
        known[new] = self.lengths(t.words(rest[first[new]]))
        n[rest] = known[back]
        if len(cache) + len(new) > CACHE:
            cache.clear()
        cache.update((keys[i], int(known[i])) for i in new[:CACHE].tolist())
        return np.bincount(t.doc, n, len(texts)).astype(np.int64)


#: This worker's counter, kept from task to task, and what it was made from.
_kept: dict[str, PieceCounter] = {}


def _counter(name: str, model: bytes, frequent: Lengths) -> PieceCounter:
    if name not in _kept:
        _kept.clear()
        _kept[name] = PieceCounter(model, frequent)
    return _kept[name]


def frequent_words(docs: DataFrame, text: str = "text") -> list[str]:
    """The corpus' frequent pre-tokens, over all documents.

    Each partition counts its pre-tokens, halving its counters whenever they become too many, and reports its
    most frequent; the reports are added up and the largest sums kept. At most ``TABLE`` rows reach the driver.
    """

    @tidy
    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in by_bytes(batches, 0):
            t = PreTokens(batch.column(0))
            _, first, n = np.unique(t.hashes, return_index=True, return_counts=True)
            often = np.flatnonzero((n > 1) & (t.ends[first] - t.starts[first] <= WORD))
            seen.update(dict(zip(t.words(first[often]), n[often].tolist(), strict=True)))
            if len(seen) > 20 * SUMMARY:
                seen = Counter({w: n - least for w, n in seen.items() if n > least}) if (least := sorted(seen.values())[-10 * SUMMARY]) else seen
        top = seen.most_common(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    best = docs.select(F.col(text).alias("text")).mapInArrow(summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in best.orderBy(F.desc("n"), "word").limit(TABLE).collect()]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """Per row: ``key``, n_bytes (UTF-8), n_tokens as the library counts them, over_limit (n_tokens > ``limit``).

    Rows are kept as they come: repeated rows give repeated results, null text counts as empty (0 bytes, 0 tokens),
    a null key stays null. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(model, "rb") as f:
        proto = f.read()
    words = frequent_words(docs, text)
    name = hashlib.sha256(proto + "\n".join(words).encode()).hexdigest()
    shared = spark.sparkContext.broadcast((name, proto, Lengths(words, PieceCounter(proto).lengths(words))))
    kind = docs.schema[key].dataType

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(*shared.value)
        for batch in by_bytes(batches, 1):
            n = pa.array(counter.count(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(utf8(batch.column(1))).cast(pa.int64()), n, pc.greater(n, limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
