"""Cross-entropy difference: how much better a target language model predicts a document than a background model.

Both are bigram models over one shared vocabulary, smoothed alike: the background is counted over all documents, the
target over those that are marked. All words and all bigrams keep their own counts, whatever the size of the corpus: words and
word pairs are told apart by 64-bit hashes, nothing is cut, and no two share a place. A token's loss is -log P(word | word
before); a document's score is the mean over its tokens of the target's loss less the background's: the lower, the more like the target.

The documents are dealt into chunks of bounded size. A chunk counts its own words and bigrams and asks for those of the corpus, each
of its distinct ones once: packed by ranges of the hash (buckets), the requests of all chunks meet in Spark's shuffle, are summed and
answered in the order they came in, and the answers meet their chunk again, where the losses are. A frequent word is asked for
once by a chunk, so no word's occurrences are ever gathered; buckets grow in number with the corpus, not in size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BY_SPACE, WIDE_BYTES, Words, bounded_batches, by_bytes, stage, tidy

#: Weight of the unigram model in the bigrams, and what is added to every unigram count.
MU, ADD = 10.0, 0.5
#: Bytes of texts in a chunk (or one text), and words and bigrams that meet in a bucket, about. No result depends on them.
CHUNK_BYTES, BUCKET = 4 << 20, 3_000_000
_U = np.uint64
_CHUNK = "chunk long, keys array<{}>, texts array<string>, targets array<boolean>, n long, n_target long"


class Entries:
    """A chunk's distinct words (even hashes) and bigrams (odd ones), sorted, and which of them each token is and ends."""

    def __init__(self, texts: pa.Array):
        self.w = w = Words(texts, BY_SPACE)
        self.second, pairs = w.shingles(2)
        self.second += 1  # the tokens that have one before them in their text
        both = np.concatenate((w.hashes & ~_U(1), pairs | _U(1)))
        self.hashes, back = np.unique(both, return_inverse=True)
        self.word, self.pair = back[: len(w.hashes)], back[len(w.hashes) :]

    def counts(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often the chunk holds each entry, and how often its target texts do."""
        own, m = target[self.w.doc], len(self.hashes)
        n = np.bincount(self.word, minlength=m) + np.bincount(self.pair, minlength=m)
        return n, np.bincount(self.word[own], minlength=m) + np.bincount(self.pair[own[self.second]], minlength=m)


@dataclass
class Size:
    """Tokens of the background and the target, and distinct words of the corpus."""

    tokens: tuple[int, int]
    vocabulary: int

    def p(self, k: int, n: np.ndarray) -> np.ndarray:
        return (n + ADD) / (self.tokens[k] + ADD * (self.vocabulary + 1))


def _bounds(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where in sorted hashes the buckets, equal ranges of the hash, begin and the last ends."""
    edges = (np.arange(buckets, dtype=np.uint64) << _U(32)) // _U(buckets) << _U(32)
    return np.append(np.searchsorted(hashes, edges), len(hashes))


def _packed(x: np.ndarray) -> bytes:
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(t).max)
    return x.astype(kind).tobytes()


def _unpacked(x: bytes, n: int) -> np.ndarray:
    return np.frombuffer(x, f"u{len(x) // n}") if n else np.zeros(0, np.uint8)


def _chunks(docs: DataFrame, kind: str) -> DataFrame:
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for i, b in enumerate(by_bytes(batches, 1, CHUNK_BYTES)):
            if not b.num_rows:
                continue
            words, target = np.diff(Words(b.column(1), BY_SPACE).first), np.asarray(b.column(2).to_pylist(), bool)
            whole = lambda c: pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), c)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([first + i]), *(whole(c) for c in b.columns), pa.array([int(words.sum())]), pa.array([int(words[target].sum())])], ["chunk", "keys", "texts", "targets", "n", "n_target"])

    return docs.mapInArrow(pack, _CHUNK.format(kind))


def _read(b: pa.RecordBatch, i: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
    keys, texts, targets = (b.column(c)[i].values for c in ("keys", "texts", "targets"))
    return keys, texts, np.asarray(targets.to_pylist(), bool)


def _requests(chunks: DataFrame, buckets: int) -> DataFrame:
    @tidy
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, chunk in enumerate(b.column("chunk").to_pylist()):
                _, texts, target = _read(b, i)
                e = Entries(texts)
                n, n_target = e.counts(target)
                at = _bounds(e.hashes, buckets)
                used = np.flatnonzero(np.diff(at))
                part = [slice(at[k], at[k + 1]) for k in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array(np.full(len(used), chunk)), pa.array([e.hashes[p].tobytes() for p in part], pa.binary()), *(pa.array([_packed(x[p]) for p in part], pa.binary()) for x in (n, n_target))],
                    ["bucket", "chunk", "hashes", "n", "n_target"],
                )

    return chunks.select("chunk", "keys", "texts", "targets").mapInArrow(ask, "bucket long, chunk long, hashes binary, n binary, n_target binary")


def _replies(requests: DataFrame) -> DataFrame:
    """Each request's counts over all chunks, in its order; the first of a bucket's replies also has the bucket's number of words."""

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        ends = np.cumsum([len(h) // 8 for _, h, _, _ in rows])
        hashes, back = np.unique(np.frombuffer(b"".join(h for _, h, _, _ in rows), np.uint64), return_inverse=True)
        sums = []
        for c in (2, 3):
            each = np.concatenate([_unpacked(r[c], len(r[1]) // 8) for r in rows])
            sums.append(np.split(np.bincount(back, each, len(hashes)).astype(np.uint64)[back], ends[:-1]))
        words = int((hashes & _U(1) == 0).sum())
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int64()), *(pa.array([_packed(x) for x in s], pa.binary()) for s in sums), pa.array([words] + [0] * (len(rows) - 1), pa.int64())],
            ["chunk", "bucket", "n", "n_target", "words"],
        )

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and rows:
                    yield answer(now, rows)
                    rows = []
                now = bucket
                rows.append(tuple(row))
        if rows:
            yield answer(now, rows)

    dealt = requests.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return dealt.mapInArrow(run, "chunk long, bucket long, n binary, n_target binary, words long")


def _scores(chunks: DataFrame, replies: DataFrame, buckets: int, size: Size, kind: str) -> DataFrame:
    def score(keys: pa.Array, e: Entries, n: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
        w, losses = e.w, []
        for k in (0, 1):
            chance = size.p(k, n[k][e.word])
            before = n[k][e.word[e.second - 1]]
            chance[e.second] = (n[k][e.pair] + MU * chance[e.second]) / (before + MU)
            losses.append(np.bincount(w.doc, -np.log(chance), len(keys)).astype(np.float64))
        return pa.RecordBatch.from_arrays([keys, pa.array(np.diff(w.first)), *map(pa.array, losses)], ["key", "n", "l0", "l1"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = e = n = at = None
        for b in batches:
            for i, bucket in enumerate(b.column("bucket").to_pylist()):
                if bucket < 0:  # a chunk comes before its replies
                    if e:
                        yield score(keys, e, n)
                    keys, texts, _ = _read(b, i)
                    e = Entries(texts)
                    n, at = tuple(np.zeros(len(e.hashes)) for _ in (0, 1)), _bounds(e.hashes, buckets)
                else:
                    part = slice(at[bucket], at[bucket + 1])
                    for k, c in enumerate(("n", "n_target")):
                        n[k][part] = _unpacked(b.column(c)[i].as_py(), part.stop - part.start)
        if e:
            yield score(keys, e, n)

    texts = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "keys", "texts", "targets")
    both = texts.unionByName(replies.select("chunk", "bucket", "n", "n_target"), allowMissingColumns=True)
    return both.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, f"key {kind}, n long, l0 double, l1 double")


def score_documents(docs: DataFrame, target: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key``, n_tokens, target_loss, background_loss (means over its tokens) and score (their difference).

    Words are parted by white space, A-Z in lower case. ``target`` is a boolean column of ``docs`` (null: false). Null and wordless texts have
    no tokens and null losses. Rows are kept as they come, and repeated rows count as often as they are there.
    """
    spark = docs.sparkSession
    bounded_batches(spark, size=WIDE_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(target, F.lit(False)).alias("target"))
    # written once: both passes must see the same chunks
    chunks = stage(_chunks(named, kind), "chunks", wide=True)
    total = chunks.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "n_target"))).first()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total.n // BUCKET))
    replies = stage(_replies(_requests(chunks, buckets)), "replies")
    size = Size((total.n, total.n_target), replies.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    sums = _scores(chunks, replies, buckets, size, kind)
    mean = [F.when(F.col("n") > 0, F.col(c) / F.col("n")) for c in ("l1", "l0")]
    return sums.select(F.col("key").alias(key), F.col("n").alias("n_tokens"), mean[0].alias("target_loss"), mean[1].alias("background_loss"), (mean[0] - mean[1]).alias("score"))
