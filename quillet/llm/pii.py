"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers. They are the seeds: the two words before a seed are a
lexical pattern. Patterns with enough different seeds are looked up in the corpus again, with whatever follows them: seeds,
other strings of a like shape, or neither. Spark scores this graph in rounds, patterns by what they precede and unseen strings by the
patterns before them; patterns that end above ``CONFIDENCE`` mark the unseen strings after them. Base spans always stay.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BY_SPACE, Words, bounded_batches, by_bytes, columns_by_bytes, flat_bytes, stage, tidy, utf8
from .decontam import Filter

KINDS = ("email", "ip", "card", "phone")
#: Different seeds that a pattern needs, the score it has to end with, rounds of scoring.
MIN_SEEDS, CONFIDENCE, ROUNDS = 8, 0.9, 4
#: Patterns that are broadcast at a time; all are looked up, block by block.
BLOCK = 20_000
_SPAN = "struct<kind:string,start:bigint,end:bigint,base:boolean>"

_EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match always starts where a run of digits does: if it fails there, it also fails further inside the run.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SPACE = re.compile(r"\s*")
#: Shapes, looser than the base patterns, that an unseen string after a pattern may have.
_SHAPES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}+ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,})*", re.I),
    "ip": re.compile(r"[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}|[0-9]{1,3}(?:[.-][0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9]){11,18}(?![0-9])"),
    "phone": re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9])"),
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches by kind, then start (code points, end exclusive)."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class _Places:
    """Words of a batch, and code points for byte offsets."""

    def __init__(self, column: pa.Array):
        self.w = Words(column, BY_SPACE)
        self.at, self.pattern = self.w.shingles(2)
        raw, offsets = flat_bytes(column, b"\n")
        # code points before each byte, counted by the bytes that begin one
        self.points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        self.first = self.points[offsets]

    def followers(self, known: Filter, texts: list[str]) -> Iterator[tuple[int, int, int]]:
        """(text, hash of a known pattern, code point at which what follows it starts), in order."""
        at = known.find(self.pattern)[0]
        words = self.at[at] + 1
        docs = self.w.doc[words]
        ends = self.points[self.w.ends[words]] - self.first[docs]
        for d, h, end in zip(docs.tolist(), self.pattern[at].view(np.int64).tolist(), ends.tolist(), strict=True):
            yield d, h, _SPACE.match(texts[d], end).end()


def _before(text: str, start: int) -> str | None:
    """The two words before a place, if nothing but white space parts the place from them."""
    if not start or not text[start - 1].isspace():
        return None
    words = text[_reach(text, start) : start].split()
    return " ".join(words) if len(words) == 2 else None


def _reach(text: str, start: int) -> int:
    """A place before the two words that end at ``start``, or the start of the text: found backwards, word by word."""
    for _ in range(2):
        while start and text[start - 1].isspace():
            start -= 1
        while start and not text[start - 1].isspace():
            start -= 1
    return start


def _pattern_hashes(pairs: list[str]) -> np.ndarray:
    """The hashes that ``Words.shingles(2)`` gives these pairs of words."""
    return Words(pa.array(pairs, pa.string()), BY_SPACE).shingles(2)[1] if pairs else np.zeros(0, np.uint64)


def _seed_patterns(docs: DataFrame, text: str) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, 0):
            pairs, kinds, seeds = [], [], []
            for t in utf8(b.column(0)).to_pylist():
                for kind, start, end in base_spans(t):
                    pair = _before(t, start)
                    if pair:
                        pairs.append(pair)
                        kinds.append(kind)
                        seeds.append(t[start:end])
            hashes = _pattern_hashes(pairs)
            if len(hashes) != len(pairs):  # a word that Python splits and the byte table doesn't: take them one by one
                one = [_pattern_hashes([p]) for p in pairs]
                keep = [i for i, h in enumerate(one) if len(h) == 1]
                hashes, kinds, seeds = np.array([one[i][0] for i in keep], np.uint64), [kinds[i] for i in keep], [seeds[i] for i in keep]
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(hashes.view(np.int64)), pa.array(seeds, pa.string())], ["kind", "pattern", "seed"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, pattern long, seed string")


def _edges(docs: DataFrame, text: str, shared) -> DataFrame:
    """(kind, pattern, instance, seed, n): what follows the patterns; a null instance is a string of no such shape."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: dict[int, list[str]] = {}
        for kind, h in shared.value:
            kinds.setdefault(h, []).append(kind)
        known = Filter(np.array(sorted(kinds), np.int64).view(np.uint64))
        for b in by_bytes(batches, 0):
            column = utf8(b.column(0))
            texts = column.to_pylist()
            seen: Counter = Counter()
            own: dict[int, dict] = {}
            for d, h, start in _Places(column).followers(known, texts):
                t = texts[d]
                base = own.get(d)
                if base is None:
                    base = own[d] = {(k, s): e for k, s, e in base_spans(t)}
                for kind in kinds[h]:
                    end = base.get((kind, start))
                    m = None if end else _SHAPES[kind].match(t, start)
                    seen[kind, h, t[start:end] if end else m[0] if m else None, bool(end)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))] + [pa.array(list(seen.values()), pa.int64())], ["kind", "pattern", "instance", "seed", "n"])

    found = docs.select(F.col(text).alias("text")).mapInArrow(run, "kind string, pattern long, instance string, seed boolean, n long")
    return found.groupBy("kind", "pattern", "instance", "seed").agg(F.sum("n").alias("n"))


def learn_patterns(docs: DataFrame, text: str = "text") -> list[tuple[str, int]]:
    """(kind, pattern) of the patterns to trust, all that qualify: none if no two words come before enough different seeds."""
    seeds = _seed_patterns(docs, text).distinct().groupBy("kind", "pattern").agg(F.count(F.lit(1)).alias("seeds")).where(F.col("seeds") >= MIN_SEEDS)
    seeds = stage(seeds.select("kind", "pattern"), "candidates")
    blocks = -(-seeds.count() // BLOCK)
    if not blocks:
        return []
    # a pattern's edges all come from its own block
    edges = None
    for k in range(blocks):
        candidates = [(r.kind, r.pattern) for r in seeds.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == k).collect()]
        if candidates:
            shared = docs.sparkSession.sparkContext.broadcast(candidates)
            found = stage(_edges(docs, text, shared), "contexts")
            shared.unpersist()
            edges = found if edges is None else edges.union(found)
    start = F.when(F.col("seed"), 1.0).otherwise(0.0)
    weighed = lambda x: F.sum(F.col("n") * F.coalesce(x, F.lit(0.0))) / F.sum("n")
    scores = edges.groupBy("kind", "pattern").agg(weighed(start).alias("score"))
    for _ in range(ROUNDS):
        scores = stage(scores, "scores")
        unseen = edges.where("not seed and instance is not null").join(scores, ["kind", "pattern"])
        instances = unseen.groupBy("kind", "instance").agg(weighed(F.col("score")).alias("trust"))
        joined = edges.join(instances, ["kind", "instance"], "left")
        scores = joined.groupBy("kind", "pattern").agg(weighed(F.when(F.col("seed"), 1.0).otherwise(F.col("trust"))).alias("score"))
    return [(r.kind, r.pattern) for r in scores.where(F.col("score") >= CONFIDENCE).orderBy("kind", "pattern").collect()]


def find_pii(docs: DataFrame, patterns: list[tuple[str, int]] | None = None, text: str = "text", into: str = "pii", redacted: str | None = None) -> DataFrame:
    """``docs`` with an array column ``into`` of structs kind, start, end (code points, end exclusive), base: base spans and those the patterns add.

    Spans are ordered by kind (email, ip, card, phone), then start; added ones overlap no other span. ``patterns`` are learned from ``docs``
    unless given. Null and empty texts have no spans. Rows are kept as they come. With ``redacted``, a column of that name (``text`` itself, if it is
    the same) holds the text with each span, overlapping ones together, replaced by its kind in square brackets; null stays null.
    """
    sc = docs.sparkSession.sparkContext
    bounded_batches(docs.sparkSession)
    patterns = learn_patterns(docs, text) if patterns is None else patterns
    blocks = [sc.broadcast(patterns[i : i + BLOCK]) for i in range(0, len(patterns), BLOCK)]

    def search(shared) -> Callable[[pa.Array, list[str]], list[list[tuple]]]:
        """What has a pattern's shape after a pattern of this block, whether or not it overlaps other spans."""
        kinds: dict[int, list[str]] = {}
        for kind, h in shared.value:
            kinds.setdefault(h, []).append(kind)
        known = Filter(np.array(sorted(kinds), np.int64).view(np.uint64))

        def find(column: pa.Array, texts: list[str]) -> list[list[tuple]]:
            found = [[] for _ in texts]
            for d, h, start in _Places(column).followers(known, texts):
                for kind in kinds[h]:
                    m = _SHAPES[kind].match(texts[d], start)
                    if m:
                        found[d].append((start, kind, m.end()))
            return found

        return find

    def after(shared) -> Column:
        @F.arrow_udf("array<struct<start:bigint,kind:string,end:bigint>>")
        @tidy
        def find(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            run = search(shared)
            for column in columns_by_bytes(columns):
                column = utf8(column)
                found = run(column, column.to_pylist())
                rows = [[{"start": a, "kind": k, "end": b} for a, k, b in s] for s in found]
                yield pa.array(rows, pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])))

        return find(F.col(text))

    def finish(column: pa.Array, texts: list[str], added: list[list[tuple]]) -> pa.Array:
        found = [_together(base_spans(t), more) for t, more in zip(texts, added, strict=True)]
        spans = _spans(found)
        if redacted is None:
            return spans
        new = [None if null else _redacted(t, s) for null, t, s in zip(column.is_null().to_pylist(), texts, found, strict=True)]
        return pa.StructArray.from_arrays([spans, pa.array(new, pa.string())], ["spans", "text"])

    result = f"array<{_SPAN}>" if redacted is None else f"struct<spans:array<{_SPAN}>,text:string>"

    @F.arrow_udf(result)
    @tidy
    def at_once(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = search(blocks[0]) if blocks else None
        for column in columns_by_bytes(columns):
            texts = utf8(column).to_pylist()
            yield finish(column, texts, run(utf8(column), texts) if run else [[] for _ in texts])

    @F.arrow_udf(result)
    @tidy
    def join(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for column, *others in columns:
            added = [[(s["start"], s["kind"], s["end"]) for some in row for s in some] for row in zip(*(x.to_pylist() for x in others), strict=True)]
            yield finish(column, utf8(column).to_pylist(), added)

    made = at_once(F.col(text)) if len(blocks) < 2 else join(F.col(text), *map(after, blocks))
    if redacted is None:
        return docs.withColumn(into, made)
    own = f"{into}__made"
    return docs.withColumn(own, made).withColumns({into: F.col(own)["spans"], redacted: F.col(own)["text"]}).drop(own)


def _together(base: list[tuple[str, int, int]], added: list[tuple[int, str, int]]) -> list[tuple]:
    """Base spans, and of the added ones, in the order of the text, those that overlap none that is there; by kind, then start."""
    found = [(*s, True) for s in base]
    if added:
        # where base spans lie, merged: they may overlap each other
        taken: list[list[int]] = []
        for a, b in sorted((a, b) for _, a, b in base):
            if taken and a < taken[-1][1]:
                taken[-1][1] = max(b, taken[-1][1])
            else:
                taken.append([a, b])
        at = done = 0
        for start, kind, end in sorted(set(added)):
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if start >= done and (at == len(taken) or end <= taken[at][0]):
                found.append((kind, start, end, False))
                done = end
    return sorted(found, key=lambda x: (KINDS.index(x[0]), x[1]))


def _redacted(text: str, spans: list[tuple]) -> str:
    parts, at = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _spans(found: list[list[tuple]]) -> pa.Array:
    out = [[{"kind": k, "start": a, "end": b, "base": base} for k, a, b, base in s] for s in found]
    return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
