"""Jaccard self-join of word n-gram sets: rare-first prefix filtering with length, positional and suffix filters.

1. Documents with equal sets form a class, represented by its smallest key.
2. Screen. A set of n can only be linked if at least ``threshold`` percent of its shingles also occur in another
   document. Shingles go to buckets as 32 bits beside the bucket's number (an equal pair of different shingles only keeps
   a document that need not be kept); those that repeat within a batch are counted there and sent once.
3. The classes that are left order their shingles by document frequency, rarest first, and put the prefix of each
   set (n - ceil(threshold * n) + 1 shingles) in an inverted list.
4. First every set of a list is compared to the list's hub (its smallest key), which joins most sets of a dense group without its
   pairs. Lists that still hold several of the components so found get more hubs turn by turn, ``HUB_GROWTH`` times as many each time, until
   nearly all were hubs. At last, within lists that hold several components even then, every pair of different components is compared: length,
   positional and suffix filters first (the last by parities of the members in cells, as the sets' difference is at least theirs), then
   the exact overlap, once per pair.

So no link between different components is lost, and no group's pairs are emitted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BY_SPACE, SMALL, Words, bounded_batches, by_bytes, discard, if_small, mix, sequence_hash, stage, tidy
from .components import connected_components

_U = np.uint64
_MARK = np.iinfo(np.int64).min
#: Sets compared to one copy of a hub's set; ranges of hashes that the suffix filter counts.
HUB_ROWS, RANGES = 512, 64
#: Shingles that meet in a bucket of the screen, about, and bytes of texts that are dealt to the buckets together.
BUCKET, DEALT_BYTES = 4_000_000, 4 << 20
#: Hubs of a list in the first turn after its own hub, and how many times as many there are in each further turn.
HUB_GROWTH = 8
#: Bits that hold the parities of a set's members in so many cells: two sets differ in at least as many members as bits.
PARITIES = 1024
_SALT = _U(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, n: int, table: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every text's distinct n-word shingles, sorted; a text of fewer words gives its whole sequence as one."""
    w = Words(texts, table)
    at, h = w.shingles(n)
    docs, hashes, words = [w.doc[at]], [h], np.diff(w.first)
    for k in range(1, n):
        short = np.flatnonzero(words == k)
        docs.append(short)
        hashes.append(sequence_hash(w.hashes, w.first[short], k))
    d, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def _digests(d: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, the order of its members aside."""
    first, out = np.searchsorted(d, np.arange(rows + 1)), []
    for salt in (_U(0x5851F42D4C957F2D), _U(0x14057B7EF767814F)):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ salt), out=c[1:])
        out.append(mix(c[first[1:]] - c[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def _sizes_and_digests(docs: DataFrame, n: int, table: np.ndarray) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            d, h = shingle_sets(b.column(1), n, table)
            d1, d2 = _digests(d, h, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.bincount(d, minlength=len(b)).astype(np.int64)), pa.array(d1), pa.array(d2)], ["key", "n", "d1", "d2"])

    return docs.mapInArrow(run, "key long, n long, d1 long, d2 long")


def _shared_shingles(docs: DataFrame, n: int, table: np.ndarray, buckets: int, parts: int) -> DataFrame:
    """(key, shared): how many of a document's shingles other documents hold as well."""

    @tidy
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, b in enumerate(by_bytes(batches, 1, DEALT_BYTES)):
            keys = b.column(0).to_numpy(zero_copy_only=False)
            d, h = shingle_sets(b.column(1), n, table)
            order = np.argsort(h, kind="stable")
            h, d = h[order], d[order]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            run = np.diff(np.append(first, len(h)))
            here = np.bincount(d[np.repeat(run > 1, run)], minlength=len(keys))
            h, owner = h[first], np.where(run > 1, _MARK, keys[d[first]]) if len(h) else np.zeros(0, np.int64)
            bucket = (h % _U(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            tokens, owner = (h >> _U(32)).astype(np.uint32)[order], owner[order]
            used = np.flatnonzero(np.diff(ends))
            some = np.flatnonzero(here)
            to = [int(x) for x in used] + [i % buckets]
            yield pa.RecordBatch.from_arrays([
                pa.array(to, pa.int32()), pa.array([False] * len(used) + [True]),
                _binary([*(tokens[ends[x] : ends[x + 1]] for x in used), here[some].astype(np.uint32)]), _binary([*(owner[ends[x] : ends[x + 1]] for x in used), keys[some]]),
            ], ["bucket", "counted", "tokens", "owners"])

    def send(keys: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
        """Counts, packed for the partitions that sum them."""
        to = (mix(keys.view(np.uint64)) % _U(parts)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        keys, many = keys[order], many[order].astype(np.int64)
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        used = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(_binary([x[ends[i] : ends[i + 1]] for i in used]) for x in (keys, many))], ["to", "keys", "many"])

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, here = None, [], _Sums()

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                tokens, owners = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.argsort(tokens, kind="stable")
                tokens, owners = tokens[order], owners[order]
                same = tokens[1:] == tokens[:-1]
                twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
                yield send(*np.unique(owners[twice & (owners != _MARK)], return_counts=True))
                held.clear()

        for b in batches:
            for bucket, counted, tokens, owners in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now:
                    yield from done()
                    now = bucket
                tokens, owners = np.frombuffer(tokens, np.uint32), np.frombuffer(owners, np.int64)
                if counted:
                    here.add(owners, tokens)
                else:
                    held.append((tokens, owners))
        yield from done()
        yield send(*here.get())

    @tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = _Sums()
        for b in batches:
            for keys, many in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sums.add(np.frombuffer(keys, np.int64), np.frombuffer(many, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in sums.get()], ["key", "shared"])

    dealt = docs.where("key is not null").mapInArrow(deal, "bucket int, counted boolean, tokens binary, owners binary")
    # bucket after bucket: one is in memory at a time
    counted = dealt.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int")).sortWithinPartitions("bucket").mapInArrow(count, "to int, keys binary, many binary")
    return counted.repartitionById(parts, F.col("to")).mapInArrow(total, "key long, shared long")


class _Sums:
    """Sums by key of packed counts; what is held grows with the number of keys only."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.known = 0, 0

    def add(self, keys: np.ndarray, many: np.ndarray) -> None:
        self.parts.append((keys, many))
        self.held += len(keys)
        if self.held > max(1_000_000, 2 * self.known):
            self.parts = [self.get()]
            self.held = self.known = len(self.parts[0][0])

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, back = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(back, np.concatenate([m for _, m in self.parts]), len(keys)).astype(np.int64)


def _sets(docs: DataFrame, n: int, table: np.ndarray) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 1):
            d, h = shingle_sets(b.column(1), n, table)
            first = np.searchsorted(d, np.arange(len(b) + 1))
            own = [h[i:j] for i, j in zip(first[:-1], first[1:], strict=True)]
            marks = [np.packbits((np.bincount((mix(x ^ _SALT) >> _U(54)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64) for x in own]
            digest = pa.array(_digests(d, h, len(b))[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first)), digest, _binary(own), pa.array([m.tolist() for m in marks], pa.list_(pa.int64()))], ["key", "n", "d", "members", "parities"])

    return docs.mapInArrow(run, "key long, n long, d long, members binary, parities array<long>")


def _members(sets: DataFrame) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n, d = (b.column(i).to_numpy() for i in range(3))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(x, n)) for x in (key, n, d)), pa.array(np.frombuffer(b"".join(b.column(3).to_pylist()), np.int64))], ["key", "n", "d", "token"])

    return sets.select("key", "n", "d", "members").mapInArrow(run, "key long, n long, d long, token long")


def overlap_reaches(a: np.ndarray, b: np.ndarray, threshold: int) -> bool:
    """Whether 100 * |a and b| >= threshold * |a or b| for sorted arrays of distinct hashes."""
    # |a and b| has to be at least this
    need = -(-threshold * (len(a) + len(b)) // (100 + threshold))
    if min(len(a), len(b)) < need:
        return False
    # suffix filter: no range of hashes shares more than the fewer of its members
    edges = np.arange(1, RANGES, dtype=np.uint64) * _U(2**64 // RANGES)
    count = [np.diff(np.concatenate(([0], np.searchsorted(x, edges), [len(x)]))) for x in (a, b)]
    if np.minimum(*count).sum() < need:
        return False
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum()) >= need


def _verify(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. Each b's set goes to the set of its a, of which there is a copy for every ``HUB_ROWS`` of them."""
    copies = if_small(stage(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("copies")), "copies"))
    # sets stay where they are while the pairs that choose among them are few
    dealt = pairs.join(copies, "a")
    dealt = F.broadcast(dealt) if pairs.count() <= SMALL else dealt
    left = copies.join(sets, F.col("a") == F.col("key")).select("a", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(None).cast("long").alias("b"), "members")
    right = dealt.join(sets, F.col("b") == F.col("key")).select("a", F.pmod(F.xxhash64("b"), F.col("copies")).cast("int").alias("copy"), "b", "members")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = own = None
        for batch in batches:
            found = []
            for a, copy, b, members in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(members, np.uint64)
                if b is None:
                    hub, own = (a, copy), [*own, x] if hub == (a, copy) else [x]
                elif hub == (a, copy) and any(overlap_reaches(o, x, threshold) for o in own):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return left.union(right).repartition("a", "copy").sortWithinPartitions("a", "copy", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def _joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b), both written before: only the components that the links join are looked at."""
    if links.isEmpty():
        return parts
    ends = links
    for x in "ab":
        root = parts.select(F.col("node").alias(x), F.col("component").alias("root"))
        ends = ends.join(if_small(root), x, "left").withColumn(x, F.coalesce("root", x)).drop("root")
    roots = stage(connected_components(ends), "roots")
    moved = parts.join(if_small(roots.select(F.col("node").alias("component"), F.col("component").alias("root"))), "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return stage(moved.union(roots.join(if_small(parts.select("node")), "node", "left_anti")), "parts")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: int = 75, table: np.ndarray = BY_SPACE) -> DataFrame:
    """Per row: ``key``, n_shingles (size of its set) and component_id (the smallest key that links lead to, its own included).

    Two documents are linked when 100 * |intersection| >= threshold * |union| of their sets of n-word shingles. Null and
    wordless texts have empty sets, linked with nothing. Rows keep their number; rows that share a key are one node,
    linked by the text of any of them. A null key is linked to nothing but equal sets, whose smallest key it gets
    (null if there is none). Other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    rows = stage(_sizes_and_digests(docs, n, table), "sizes")
    classes = stage(rows.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("key").alias("key")), "classes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shared = stage(_shared_shingles(docs, n, table, max(parts, -(-total // BUCKET)), parts), "shared")
    maybe = stage(classes.join(shared, "key").where(F.col("shared") * 100 >= F.col("n") * threshold).select("key").distinct(), "screened")
    discard(shared)
    sets = stage(_sets(docs.join(if_small(maybe), "key", "left_semi"), n, table).where("n > 0").dropDuplicates(["key", "n", "d"]), "sets")
    members = _members(sets)
    often = stage(members.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    ordered = members.join(often, "token").groupBy("key", "n", "d").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # the shingles that no other set has come first of all, and are in no other list
    alone = F.greatest(F.col("n") - F.size("t"), F.lit(0))
    prefix = F.col("n") - F.ceil(F.col("n") * threshold / 100) + 1
    lists = ordered.select("key", "n", "d", alone.alias("alone"), F.posexplode(F.slice("t", F.lit(1), F.greatest(prefix - alone, F.lit(0)).cast("int"))).alias("i", "t"))
    lists = stage(lists.select(F.col("t.token").alias("token"), "key", "n", "d", (F.col("alone") + F.col("i")).alias("pos")), "lists")

    long_enough = lambda x, y: (F.col(x) * 100 >= F.col(y) * threshold) & (F.col(y) * 100 >= F.col(x) * threshold)
    hubs = lists.groupBy("token").agg(F.min_by(F.struct("key", "n"), "key").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").select("token", F.col("hub.key").alias("a"), F.col("hub.n").alias("na"))
    first = lists.join(hubs, "token").where((F.col("key") != F.col("a")) & long_enough("n", "na")).select("a", F.col("key").alias("b")).distinct()
    parts = stage(connected_components(stage(_verify(stage(first, "pairs"), sets, threshold), "links")), "parts")

    # 100 * overlap >= threshold * union, as far as lengths and places can tell
    def may_match(na: str, pa_: str, qa: str, nb: str, pb: str, qb: str) -> Column:
        # suffix filter on the parities, position by position of the list: similar sets differ in few members
        apart = functools.reduce(lambda x, y: x + y, (F.bit_count(F.get(qa, F.lit(i)).bitwiseXOR(F.get(qb, F.lit(i)))) for i in range(PARITIES // 64)))
        near = apart * (100 + threshold) <= (F.col(na) + F.col(nb)) * (100 - threshold)
        # what lies before and after a shared shingle bounds the overlap from that list alone
        place = F.least(pa_, pb) + F.least(F.col(na) - F.col(pa_), F.col(nb) - F.col(pb))
        return long_enough(na, nb) & (place * (100 + threshold) >= (F.col(na) + F.col(nb)) * threshold) & near

    def mixed_of(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """The rows of lists that hold several components, with their own and the list's largest one and the list's size."""
        named = rows.join(if_small(parts), F.col("key") == F.col("node"), "left").withColumn("part", F.coalesce("component", "key")).drop("node", "component")
        by_part = named.groupBy("token", "part").agg(F.count(F.lit(1)).alias("many"))
        largest = by_part.groupBy("token").agg(F.max_by("part", F.struct("many", "part")).alias("largest"), F.sum("many").alias("size"), F.count(F.lit(1)).alias("parts"))
        return named.join(if_small(stage(largest.where("parts > 1").select("token", "largest", "size"), "largest")), "token")

    mixed = stage(mixed_of(lists, parts).join(sets.select("key", "n", "d", "parities"), ["key", "n", "d"]), "mixed")
    # more hubs each time, out of all components: once a share of a list's rows were hubs, the links between its components that are left are about
    # as many as its rows over that share, so a turn, and the pairs at last, find rows in proportion to the lists, not to the square of a group
    hubs = HUB_GROWTH
    while (mixed.agg(F.max("size")).first()[0] or 0) > hubs:
        # the same sets in all lists of a size, so that few different pairs are looked at
        drawn = F.pmod(F.xxhash64("key", F.lit(hubs)), F.lit(1 << 31)) * F.col("size") < hubs * (1 << 31)
        own = mixed.where((F.col("size") > hubs) & drawn).select("token", *(F.col(c).alias(f"hub_{c}") for c in ("key", "n", "pos", "parities", "part")))
        met = mixed.join(own, "token").where((F.col("part") != F.col("hub_part")) & may_match("n", "pos", "parities", "hub_n", "hub_pos", "hub_parities"))
        found = stage(_verify(stage(met.select(F.col("hub_key").alias("a"), F.col("key").alias("b")).distinct(), "pairs"), sets, threshold), "links")
        if not found.isEmpty():
            parts = _joined(parts, found)
            mixed = stage(mixed_of(mixed.drop("part", "largest", "size"), parts), "mixed")
        hubs *= HUB_GROWTH

    # what is still apart: each set outside the largest component meets all sets of the others
    x = mixed.where("part <> largest").select("token", F.col("key").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("part").alias("part_a"), F.col("parities").alias("qa"))
    y = mixed.select("token", F.col("key").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("part").alias("part_b"), F.col("parities").alias("qb"), "largest")
    other = (F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("largest")) | (F.col("a") < F.col("b")))
    met = x.join(y, "token").where(other & may_match("na", "pa", "qa", "nb", "pb", "qb"))
    # the pair's shared prefix shingles and what may still follow the last of them bound its overlap; that a list
    # may show a pair in one order here and in the other there is evened out first
    pair = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.struct("na", "nb", "pa", "pb")).otherwise(F.struct(F.col("nb").alias("na"), F.col("na").alias("nb"), F.col("pb").alias("pa"), F.col("pa").alias("pb"))).alias("p"))
    pair = pair.groupBy("a", "b", "p.na", "p.nb").agg(F.count(F.lit(1)).alias("c"), F.max("p.pa").alias("pa"), F.max("p.pb").alias("pb"))
    bound = F.col("c") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    second = pair.where(bound * (100 + threshold) >= (F.col("na") + F.col("nb")) * threshold).select("a", "b").distinct()
    groups = _joined(parts, stage(_verify(stage(second, "pairs"), sets, threshold), "links"))

    named = stage(classes.join(if_small(groups), F.col("key") == F.col("node"), "left").select("d1", "d2", "n", F.coalesce("component", "key").alias("component_id")), "groups")
    found = rows.join(named, ["d1", "d2", "n"], "left")
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))
