"""Near-duplicate vectors by randomised-rotation binary codes.

Each vector is rotated by a random orthogonal matrix and stored once more in a packed form: the signs (its binary code), a correction factor, and
its components in steps of 8 bits. Pairs meet in buckets of equal sign groups of further rotations, the more bits a group the more vectors there
are, and so many groups that a pair at the threshold misses them all with a probability of at most ``MISS``. Buckets hold packed forms only. Inside one,
pairs whose codes differ in too many bits go first; for the rest the code of one and the steps of the other give an unbiased estimate of their inner product, <code, y> /
<code, x>, the second factor being the stored one. Its error for a pair at the threshold has a known deviation; pairs whose estimate lies further below the
threshold than ``BOUND`` deviations (and the rounding of the steps) are dropped. Only vectors that are left in a pair meet once more, as they are, and are compared exactly
in double precision.

Equal vectors are one class with a weight. Large buckets are cut into blocks that meet in pairs; of a block only counts and links to
its groups' smallest ids are emitted, never its pairs.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, mix, stage, tidy
from .components import connected_components

#: Probability that a pair at the threshold is in no bucket; deviations of an estimate's error that are allowed for; rows of a block.
MISS, BOUND, BLOCK = 0.002, 6.0, 512


@functools.lru_cache(maxsize=16)
def rotations(dim: int, bits: int) -> np.ndarray:
    """Columns of random orthogonal matrices, ``bits`` in all."""
    rng = np.random.default_rng([dim, 0x5EED])
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-bits // dim))], axis=1)[:, :bits]


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a sign group and number of groups for so many vectors."""
    bits = min(60, max(10, math.ceil(math.log2(max(rows, 2))) + 4))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-hit))


def sign_groups(x: np.ndarray, bits: int, groups: int) -> np.ndarray:
    """Keys of every vector's sign groups."""
    signs = (x @ rotations(x.shape[1], bits * groups) > 0).reshape(len(x), groups, bits)
    return (signs * (np.int64(1) << np.arange(bits, dtype=np.int64))).sum(axis=2)


def _unit(values: list) -> np.ndarray:
    x = np.array(values, np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Packed(NamedTuple):
    """Packed forms of vectors: signs (64 to a word), correction factors, 8-bit steps, and the size of a step."""

    signs: np.ndarray
    factor: np.ndarray
    steps: np.ndarray
    size: np.ndarray


def pack(x: np.ndarray) -> Packed:
    """Of rows of length 1."""
    n, dim = x.shape
    turned = x @ rotations(dim, dim)
    bits = np.zeros((n, -(-dim // 64) * 64), np.uint8)
    bits[:, :dim] = turned > 0
    size = np.maximum(np.abs(turned).max(axis=1), 1e-300) / 127
    return Packed(np.packbits(bits, axis=1).view(np.uint64), np.abs(turned).sum(axis=1) / math.sqrt(dim), np.rint(turned / size[:, None]).astype(np.int8), size)


def open_pairs(a: Packed, b: Packed, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that may have a cosine of the threshold or more: all others are below it by more than the bounds allow for."""
    dim = a.steps.shape[1]
    part = math.acos(threshold) / math.pi  # of the bits differ at the threshold
    most = dim * part + BOUND * math.sqrt(dim * part * (1 - part))
    differ = np.zeros((len(a.size), len(b.size)), np.uint16)
    for k in range(a.signs.shape[1]):
        differ += np.bitwise_count(a.signs[:, k, None] ^ b.signs[None, :, k])
    i, j = np.nonzero(differ <= most)
    signs = np.unpackbits(a.signs.view(np.uint8).reshape(len(a.size), -1), axis=1)[:, :dim].astype(np.float32) * 2 - 1
    steps = b.steps.astype(np.float32)
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 1 << 14):
        x, y = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
        factor = a.factor[x]
        estimate = np.einsum("ij,ij->i", signs[x], steps[y]) * b.size[y] / math.sqrt(dim) / factor
        deviation = math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(dim - 1, 1))
        rounding = math.sqrt(dim) * b.size[y] / 2 / factor
        keep[k : k + (1 << 14)] = estimate >= threshold - BOUND * deviation - rounding - 1e-6
    return i[keep], j[keep]


def close_pairs(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of rows of length 1 with a cosine of the threshold or more."""
    return np.nonzero(x @ y.T >= threshold)


def _joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n places (in the order of their ids) the first place that the pairs lead to."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _meet(a: tuple, b: tuple | None, group: int, bits: int, groups: int, threshold: float) -> tuple[np.ndarray, ...]:
    """(id, links, to): what one block's, or two blocks', pairs add in sign group ``group``; pairs that met in an earlier one aren't counted again."""
    ids, weight, x = a if b is None else (np.concatenate(p) for p in zip(a, b, strict=True))
    if b is None:
        i, j = close_pairs(x, x, threshold)
        i, j = i[i < j], j[i < j]
    else:
        i, j = close_pairs(a[2], b[2], threshold)
        j = j + len(a[0])
    if not len(i):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = sign_groups(x, bits, groups)
    new = np.ones(len(i), bool)
    for g in range(group):
        new &= keys[i, g] != keys[j, g]
    i, j = i[new], j[new]
    links = np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    to = ids[order][_joined(len(ids), place[i], place[j])][place]
    has = np.flatnonzero(links)
    return ids[has], links[has], to[has]


def link_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """Per row: ``key``, n_links (other rows with a cosine of ``threshold`` or more), component_id (smallest key that links lead to) and kept (key = component_id).

    Null, empty and zero vectors, and those with a null or non-finite component, are linked with nothing, and so are
    rows with a null key (whose component_id is null and which aren't kept). Vectors of different lengths are never
    linked. Rows keep their number; equal rows are links of each other. Other columns are not read.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    fits = F.coalesce(F.col("key").isNotNull() & (F.size("x") > 0) & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    # equal but for the length's sign of zero: Spark groups 0.0 and -0.0 together
    classes = stage(rows.where(fits).groupBy("x").agg(F.min("key").alias("id"), F.count(F.lit(1)).alias("weight")), "vectors")
    bits, groups = plan(classes.count(), threshold)

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims = b.column(0).to_numpy(), np.array([len(x) for x in b.column(1).to_pylist()])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                keys = mix((sign_groups(_unit(b.column(1).take(pa.array(own)).to_pylist()), bits, groups) + np.int64(dim) * 0x9E3779B1).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[own], groups)), pa.array(np.tile(np.arange(groups, dtype=np.int32), len(own))), pa.array(keys.ravel())], ["id", "sign_group", "bucket"])

    dealt = stage(classes.select("id", "x").mapInArrow(deal, "id long, sign_group int, bucket long"), "dealt")
    shared = stage(dealt.groupBy("sign_group", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = dealt.join(shared, ["sign_group", "bucket"]).withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # a row goes to all pairs of blocks that hold its own
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    paired = placed.select("id", "sign_group", "bucket", "own", other.alias("other")).select("id", "sign_group", "bucket", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
    keys = ["sign_group", "bucket", "a", "b"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims = b.column(0).to_numpy(), np.array([len(x) for x in b.column(1).to_pylist()])
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                p = pack(_unit(b.column(1).take(pa.array(own)).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(ids[own]), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (p.signs, p.steps)), pa.array(p.factor), pa.array(p.size)], ["id", "signs", "steps", "factor", "size"])

    codes = stage(classes.select("id", "x").mapInArrow(tidy(packed), "id long, signs binary, steps binary, factor double, size double"), "codes")

    def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
        """(sign group, bucket, both blocks) and its rows' other columns."""
        now, kept = None, []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i, where in enumerate(zip(*columns[:4], strict=True)):
                if where != now:
                    if len(kept) > 1:
                        yield now, kept
                    now, kept = where, []
                kept.append([c[i] for c in columns[4:]])
        if len(kept) > 1:
            yield now, kept

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, bucket, a, b), rows in blocks_of(batches):
            sides = [[r for r in rows if r[0] == k] for k in ((a,) if a == b else (a, b))]
            forms = [Packed(np.array([np.frombuffer(r[2], np.uint64) for r in s]), np.array([r[4] for r in s]), np.array([np.frombuffer(r[3], np.int8) for r in s]), np.array([r[5] for r in s])) for s in sides if s]
            if len(forms) < len(sides):
                continue
            i, j = open_pairs(forms[0], forms[-1], threshold)
            if a == b:
                i, j = i[i != j], j[i != j]
            ids = [np.array([r[1] for r in s], np.int64) for s in sides]
            left = np.unique(np.concatenate((ids[0][i], ids[-1][j])))
            if len(left):
                n = len(left)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, group, np.int32)), pa.array(np.full(n, bucket, np.int64)), pa.array(np.full(n, a, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(left)], [*keys, "id"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, _, a, b), rows in blocks_of(batches):
            part = lambda which: (lambda r: (np.array([x[1] for x in r], np.int64), np.array([x[2] for x in r], np.int64), _unit([x[3] for x in r]) if r else np.zeros((0, len(rows[0][3])))))([x for x in rows if x[0] == which])  # noqa: B023, E731
            found = _meet(part(a), None if a == b else part(b), group, bits, groups, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["id", "links", "to"])

    together = lambda df: df.repartition(*keys).sortWithinPartitions(*keys)
    forms = paired.join(codes, "id").select(*keys, "own", "id", "signs", "steps", "factor", "size")
    left = stage(together(forms).mapInArrow(tidy(estimate), "sign_group int, bucket long, a int, b int, id long"), "open")
    whole = left.join(classes, "id").join(shared.select("sign_group", "bucket", blocks.alias("blocks")), ["sign_group", "bucket"])
    whole = whole.select(*keys, F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own"), "id", "weight", "x")
    found = stage(together(whole).mapInArrow(tidy(compare), "id long, links long, to long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")).distinct())
    named = classes.join(links, "id", "left").join(parts, F.col("id") == F.col("node"), "left")
    named = stage(named.select("x", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")), "named")
    linked = rows.where(fits).join(named, "x").select("key", "n_links", "component_id")
    alone = rows.where(~fits).select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    return linked.union(alone).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
