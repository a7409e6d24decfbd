"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from all labelled training rows, summed in the partitions first. The weights are learned by
follow-the-regularised-leader with an elastic net (its L1 part leaves most weights at zero) on a sample of at most about
``TRAIN_ROWS`` rows of each language; a further ``CALIBRATION_ROWS`` rows of each set the temperature of the softmax.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_bytes, columns_by_bytes, stage, tidy, utf8

#: Bounds of the samples: rows of each language, in expectation, for the weights and for the temperature.
TRAIN_ROWS, CALIBRATION_ROWS = 800, 300
#: Orders of the n-grams and places that they are hashed to.
ORDERS, FEATURES = (1, 2, 3), 1 << 16
#: Learning rate, its offset, L1 and L2 of the elastic net; passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.3, 1.0, 0.05, 0.01, 2
UNDETERMINED = "und"
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


class Grams:
    """n-grams of a batch of texts, in lower case; whatever is no letter counts as a space, and grams of spaces only are left out."""

    def __init__(self, texts: list[str]):
        padded = [f" {t.lower()} " for t in texts]
        self.texts = len(texts)
        codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        self.doc = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
        self.letters = np.bincount(self.doc[letter], minlength=len(texts))
        self.codes, self.letter = np.where(letter, codes, np.uint32(32)), letter

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each order, the grams' texts and features."""
        for n in ORDERS:
            size = len(self.codes) - n + 1
            if size <= 0:
                continue
            h, some = np.full(size, n * 0x27D4EB2F % 2**32, np.uint32), np.zeros(size, bool)
            for k in range(n):
                h = (h ^ self.codes[k : k + size]) * _MULTIPLIERS[k]
                h ^= h >> np.uint32(15)
                some |= self.letter[k : k + size]
            some &= self.doc[:size] == self.doc[n - 1 :]
            yield self.doc[:size][some], (h[some] & np.uint32(FEATURES - 1)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages
    temperature: float = 1.0

    @functools.cached_property
    def table(self) -> np.ndarray:
        return np.ascontiguousarray((self.weights * self.idf[:, None]).T)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logits before the temperature, and which texts have a letter."""
        grams = Grams(texts)
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for doc, f in grams.features():
            n += np.bincount(doc, minlength=len(texts))
            for k, row in enumerate(self.table):
                sums[:, k] += np.bincount(doc, row[f], minlength=len(texts))
        return sums / np.sqrt(np.maximum(n, 1))[:, None], grams.letters > 0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _frequencies(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequency of every feature over all rows, and the number of rows."""

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, n = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, bool), 0
        for b in by_bytes(batches, 0):
            grams = Grams(utf8(b.column(0)).to_pylist())
            n += grams.texts
            parts = [(f, np.searchsorted(doc, np.arange(grams.texts + 1))) for doc, f in grams.features()]
            for d in range(grams.texts):
                for f, first in parts:
                    seen[f[first[d] : first[d + 1]]] = True
                has = np.flatnonzero(seen)
                df[has] += 1
                seen[has] = False
        has = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(has, -1).astype(np.int32)), pa.array(np.append(df[has], n))], ["f", "n"])

    out, total = np.zeros(FEATURES, np.int64), 0
    for r in rows.select("text").mapInArrow(count, "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        if r.f < 0:
            total = r.n
        else:
            out[r.f] = r.n
    return out, total


def _examples(text: str, rng: np.random.Generator) -> list[str]:
    """A training text, and two short pieces of it so that short texts are learned as well."""
    words, out = text.split(), [text]
    for _ in range(2):
        if len(words) > 8:
            at, n = int(rng.integers(0, len(words) - 6)), int(rng.integers(1, 7))
            out.append(" ".join(words[at : at + n]))
    return out


def train(texts: list[str], labels: list[int], classes: int, idf: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights by follow-the-regularised-leader, a coordinate's rate falling with its squared gradients."""
    rng = np.random.default_rng(seed)
    z, n = np.zeros((FEATURES, classes)), np.zeros((FEATURES, classes))

    def weights(f: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[f]) <= L1, 0.0, -(z[f] - np.sign(z[f]) * L1) / ((BETA + np.sqrt(n[f])) / ALPHA + L2))

    examples = []
    for text, label in zip(texts, labels, strict=True):
        grams = Grams(_examples(text, rng))
        parts = list(grams.features())
        for d in range(grams.texts):
            f, count = np.unique(np.concatenate([f[doc == d] for doc, f in parts]), return_counts=True)
            if len(f):
                examples.append((f, count * idf[f] / np.sqrt(count.sum()), label))
    for _ in range(PASSES):
        for i in rng.permutation(len(examples)):
            f, x, label = examples[i]
            w = weights(f)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            z[f] += g - (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / ALPHA * w
            n[f] += g * g
    return weights(np.arange(FEATURES))


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature with the least log loss, by golden-section search over its logarithm."""

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def held_out(key: Column) -> Column:
    """Rows that are kept for tests: the CRC-32 of the key as text is 2 modulo 4 (a null key is not)."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from the rows of ``docs`` that have a text and a language and are not held out (nor without a key)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES, 0)))
    df, total = _frequencies(rows)
    idf = np.log((1 + total) / (1 + df)) + 1
    # a row's place in [0, 1) decides about it, whatever the partitions
    place = F.pmod(F.xxhash64("key"), F.lit(1_000_003)) / 1_000_003
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, 1.0 / counts[k])))[F.col("lang")]
    sample = stage(rows.select("text", "lang", "key", place.alias("place"), share.alias("share")).where(F.col("place") < (TRAIN_ROWS + CALIBRATION_ROWS) * F.col("share")), "langid")
    # a language with fewer rows than the bounds is split in the same proportion
    in_train = F.col("place") < F.least(F.lit(TRAIN_ROWS) * F.col("share"), F.lit(TRAIN_ROWS / (TRAIN_ROWS + CALIBRATION_ROWS)))
    number = {k: i for i, k in enumerate(languages)}

    @tidy
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for b in batches:
            texts += b.column(0).to_pylist()
            labels += [number[x] for x in b.column(1).to_pylist()]
        w = train(texts, labels, len(languages), idf) if texts else np.zeros((FEATURES, len(languages)))
        has = np.flatnonzero((w != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(w[has].tolist(), pa.list_(pa.float64()))], ["f", "w"])

    weights = np.zeros((FEATURES, len(languages)))
    # the sample's size is bounded, and the learner goes through it in order: one task
    ordered = sample.where(in_train).select("text", "lang", "key").coalesce(1).sortWithinPartitions("key", "text", "lang")
    for r in ordered.mapInArrow(learn, "f int, w array<double>").collect():
        weights[r.f] = r.w
    model = LanguageModel(languages, idf, weights)
    shared = spark.sparkContext.broadcast(model)

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            logits, ok = shared.value.logits(utf8(b.column(0)).to_pylist())
            labels = np.array([number[x] for x in b.column(1).to_pylist()], np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(labels[ok]), pa.array(logits[ok].tolist(), pa.list_(pa.float64()))], ["label", "logits"])

    got = sample.where(~in_train).select("text", "lang").mapInArrow(score, "label int, logits array<double>").collect()
    if got:
        model.temperature = _temperature(np.array([r.logits for r in got]), np.array([r.label for r in got]))
    return model


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang (``und`` for a null text or one without a letter) and score (0 to 1, calibrated; 0 with ``und``).

    Equal scores go to the language that sorts first. A model that has seen no labelled row answers ``und`` throughout.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    @tidy
    def predict(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for column in columns_by_bytes(columns):
            logits, ok = model.logits(utf8(column).to_pylist())
            if model.languages:
                p = _softmax(logits / model.temperature)
                best, score = np.where(ok, p.argmax(axis=1), -1), np.where(ok, p.max(axis=1), 0.0)
            else:
                best, score = np.full(len(column), -1), np.zeros(len(column))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score, pa.float64())], ["lang", "score"])

    return docs.withColumn(into, predict(F.col(text)))
