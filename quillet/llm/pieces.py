"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together, one end position at a time. Hashes of all substrings probe the sorted keys of the
pieces; for each end the best candidate is taken over all lengths at once, and its length is stored as a backpointer.

With a unigram model a path's score is the sum of its pieces' scores. With a BPE model an edge is open only if the piece may
follow the one before it: if the merges of the two, joined, end at this very pair. A sequence all of whose neighbours are such
pairs is what the merges give, and it is the only one, so the open path to each position is unique and the ids are the library's.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, columns_by_bytes, gathered, mix, tidy, utf8

_U = np.uint64
_STEP, _BASE = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_SPACE = "▁"
_WORD = re.compile(f"{_SPACE}+[^{_SPACE}]*")
#: Slots of the tables of piece keys' low bits and of known pairs; words in a worker's cache, emptied when full; the longest of them.
_KEY_BITS, _PAIR_BITS, CACHE, CACHED_CHARS = 20, 20, 100_000, 64
#: Cells (words times length) that are searched together; bytes of texts whose words are.
_CELLS, _TEXTS = 100_000, 1 << 20


class PieceModel:
    """A model file's pieces, as arrays; made on the driver and broadcast."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = proto.pieces[0].__class__
        if any(p.type == kinds.USER_DEFINED for p in proto.pieces) or proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.add_dummy_prefix:
            raise ValueError("models with user-defined pieces or a normaliser of their own are not supported")
        self.bpe = proto.trainer_spec.model_type == 2
        self.size = len(proto.pieces)
        self.normal = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.byte_ids = np.zeros(256, np.int32)
        self.surface = []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.surface.append(bytes([int(p.piece[3:5], 16)]))
            else:
                self.surface.append(p.piece.replace(_SPACE, " ").encode() if p.type == kinds.NORMAL else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else b"")
        if any(_SPACE in p.lstrip(_SPACE) for p in self.normal):
            raise ValueError("this model's pieces cross spaces")
        self.score = np.array([p.score for p in proto.pieces])
        self.longest = max(map(len, self.normal))
        self.runs = {len(p) for p in self.normal if set(p) == {_SPACE}}
        self._ranks_and_splits()
        self._keys()

    def _ranks_and_splits(self) -> None:
        """Ranks (0 merges first) and the last merge of every piece; pieces that merging never makes are dropped."""
        self.rank = np.full(self.size + 1, -1, np.int64)
        self.left, self.right = np.full(self.size + 1, -1, np.int64), np.full(self.size + 1, -1, np.int64)
        if not self.bpe:
            return
        words = {p: i for p, i in self.normal.items() if not (len(p) > 1 and set(p) == {_SPACE})}
        if len({self.score[i] for p, i in words.items() if len(p) > 1}) < sum(len(p) > 1 for p in words):
            raise ValueError("two pieces have the same score: the order of their merges is not defined by it")
        for r, (p, i) in enumerate(sorted(((p, i) for p, i in words.items() if len(p) > 1), key=lambda x: -self.score[x[1]])):
            self.rank[i] = r
        for p, i in list(words.items()):
            symbols, last = list(p), None
            while len(symbols) > 1:
                made = [(self.rank[words[a + b]], k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in words]
                if not made:
                    break
                k = min(made)[1]
                last = symbols[k], symbols[k + 1]
                symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            if len(symbols) > 1 or any(x not in words for x in last or ()):
                del words[p]
            elif last:
                self.left[i], self.right[i] = words[last[0]], words[last[1]]
        self.normal_words = words

    def _keys(self) -> None:
        pieces = self.normal_words if self.bpe else {p: i for p, i in self.normal.items() if p}
        self.raw, self.length = np.zeros(self.size + 1, np.uint64), np.zeros(self.size + 1, np.int64)
        power = _powers(self.longest + 1)[0]
        for p, i in pieces.items():
            codes = np.frombuffer(p.encode("utf-32-le"), np.uint32)
            self.raw[i], self.length[i] = (mix(codes.astype(np.uint64) + _U(1)) * power[: len(codes)]).sum(), len(codes)
        ids = np.array(sorted(pieces.values()), np.int64)
        keys = mix(self.raw[ids] + self.length[ids].astype(np.uint64) * _STEP)
        slot = (keys & _U((1 << _KEY_BITS) - 1)).view(np.int64)
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        self.keys, self.ids = keys[order], ids[order].astype(np.int32)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same key")
        self.maybe, self.place = np.zeros(1 << _KEY_BITS, bool), np.zeros(1 << _KEY_BITS, np.int32)
        self.maybe[slot] = True
        self.place[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]  # of several keys of a slot the first
        self.most = int(np.bincount(slot).max())

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Piece of each key, or -1."""
        out = np.full(keys.shape, -1, np.int32)
        flat = keys.ravel()
        slot = (flat & _U((1 << _KEY_BITS) - 1)).view(np.int64)
        at = np.flatnonzero(self.maybe[slot])
        k, place, last = flat[at], self.place[slot[at]], len(self.keys) - 1
        for _ in range(self.most):
            ok = self.keys[place] == k
            out.ravel()[at[ok]] = self.ids[place[ok]]
            rest = np.flatnonzero(~ok)
            if not len(rest):
                break
            at, k, place = at[rest], k[rest], np.minimum(place[rest] + 1, last)
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of piece a and piece b, joined, ends at a and b.

        From the end backwards, the later of the merges that made the two symbols at the border is undone. The border would have
        been crossed if the symbols there form a piece that merges before the one just undone (at equal ranks, before it from the left).
        """
        a, b = a.copy(), b.copy()
        out, live, limit = np.ones(len(a), bool), np.arange(len(a)), np.full(len(a), 1 << 40)
        power = _powers(self.longest + 1)[0]
        while len(live):
            x, y = a[live], b[live]
            n = self.length[x] + self.length[y]
            joined = self.find(mix(self.raw[x] + self.raw[y] * power[np.minimum(self.length[x], self.longest)] + n.astype(np.uint64) * _STEP))
            crossed = (joined >= 0) & (self.rank[joined] < limit[live])
            out[live[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            undo_x = rx > ry
            ended = crossed | (np.maximum(rx, ry) < 0)
            limit[live] = np.where(undo_x, rx, ry + 1)
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_x, y, self.left[y])
            live = live[~ended]
        return out

    def spaces(self, n: int) -> list[int]:
        """A run of spaces: its pieces all have one score, so the leftmost pair that forms a piece merges first.

        What is left of the pair looked at is a stack, what is right of it is single spaces: each is pushed or merged once.
        """
        made: list[int] = []
        for _ in range(n):
            made.append(1)
            while len(made) > 1 and made[-2] + made[-1] in self.runs:
                top = made.pop()
                made[-1] += top
        return [self.normal[_SPACE * k] for k in made]


@functools.lru_cache(maxsize=64)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _U(pow(int(_BASE), -1, 2**64))):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Encoder:
    """A worker's encoder: a model, a table of known pairs and a cache of words."""

    def __init__(self, model: PieceModel):
        self.m, self.cache = model, {}
        self.pair_key, self.pair_ok = np.zeros(1 << _PAIR_BITS, np.uint64), np.zeros(1 << _PAIR_BITS, bool)
        self.outside = model.size  # stands for a character that no piece holds: its rank and length are those of none

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether b may follow a, by way of a direct-mapped table of pairs that were looked at before."""
        out = (a == self.outside) | (b == self.outside)
        rest = np.flatnonzero(~out)
        a, b = a[rest], b[rest]
        key = (a.astype(np.uint64) << _U(32)) | b.astype(np.uint64) | _U(1 << 63)
        slot = (mix(key) >> _U(64 - _PAIR_BITS)).astype(np.int64)
        new = np.flatnonzero(self.pair_key[slot] != key)
        ok = self.pair_ok[slot]
        if len(new):
            _, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[first]
            found = self.m.compatible(a[one], b[one])
            ok[new] = found[back]
            self.pair_key[slot[one]], self.pair_ok[slot[one]] = key[one], found
            # two pairs of one slot: the key that stands there was written last, and so must the answer be
            lost = self.pair_key[slot[one]] != key[one]
            if lost.any():
                self.pair_key[slot[one[lost]]] = 0
        out[rest] = ok
        return out

    def _search(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words that all have the same length (``outside`` for characters without a piece), and how many each has."""
        m, n, rows = self.m, len(words[0]), len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(rows, n)
        power, inverse = _powers(n)
        prefix = np.zeros((rows, n + 1), np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + _U(1)) * power[:n], axis=1, out=prefix[:, 1:])
        most = min(n, m.longest)
        #: piece of each length (less 1), word and place
        found = np.full((most, rows, n), -1, np.int32)
        for k in range(1, most + 1):
            found[k - 1, :, : n + 1 - k] = m.find(mix((prefix[:, k:] - prefix[:, : n + 1 - k]) * inverse[: n + 1 - k] + _U(k * int(_STEP) % 2**64)))
        found[0][found[0] < 0] = self.outside
        score = np.append(m.score, m.score[m.ids].min() - 10)
        best, last, back = np.full((n + 1, rows), -np.inf), np.full((n + 1, rows), -1, np.int32), np.zeros((n + 1, rows), np.int8 if m.longest < 128 else np.int64)
        best[0] = 0
        for end in range(1, n + 1):
            before = end - 1 - np.arange(min(end, most))  # where candidates of each length start
            piece = found[np.arange(len(before)), :, before]
            k, row = np.nonzero((piece >= 0) & np.isfinite(best[before]))
            start, own = before[k], piece[k, row]
            if m.bpe:
                inside = np.flatnonzero(start > 0)
                ok = np.ones(len(k), bool)
                ok[inside] = self._follows(last[start[inside], row[inside]], own[inside])
                # the shortest first, should there be several: it is written last
                k, row, own = k[ok][::-1], row[ok][::-1], own[ok][::-1]
                best[end, row], last[end, row], back[end, row] = 0, own, k + 1
            else:
                value = np.full(piece.shape, -np.inf)
                value[k, row] = best[start, row] + score[own]
                top, each = value.argmax(axis=0), np.arange(rows)
                best[end], last[end], back[end] = value[top, each], piece[top, each], top + 1
        if not np.isfinite(best[n]).all():
            raise ValueError("a word has no segmentation")
        out, at, row = [], np.full(rows, n), np.arange(rows)
        while (at > 0).any():
            out.append(np.where(at > 0, last[at, row], -1))
            at = np.maximum(at - back[at, row], 0)
        steps = np.array(out)[::-1].T  # rows x steps, -1 where a row had ended
        return steps[steps >= 0], (steps >= 0).sum(axis=1)

    def _with_bytes(self, words: list[str], pieces: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has: characters without a piece give their bytes."""
        bad = pieces == self.outside
        if not bad.any():
            return pieces, count
        size = np.where(bad, 1, self.m.length[pieces])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)[(np.cumsum(size) - size)[bad]]
        codes, back = np.unique(codes, return_inverse=True)
        own = [self.m.byte_ids[list(chr(c).encode("utf-8", "replace"))] for c in codes]
        size[:] = 1
        size[bad] = np.array([len(x) for x in own])[back]
        out = np.repeat(pieces, size)
        out[np.repeat(bad, size)] = np.concatenate([own[c] for c in back])
        return out, np.add.reduceat(size, np.cumsum(count) - count)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids, as bytes, of words that start with one space."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        out: dict[str, bytes] = {}
        for n, own in by_length.items():
            step = max(1, _CELLS // n)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                pieces, count = self._with_bytes(part, *self._search(part))
                data, end = pieces.astype("<i4").tobytes(), np.cumsum(count)
                at = (4 * np.append(0, end)).tolist()
                out.update(zip(part, [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cache = self.cache
        split = [_WORD.findall(_SPACE + t.replace(" ", _SPACE)) if t else [] for t in texts]
        misses = set().union(*split).difference(cache)
        spaced = [w for w in misses if w.startswith(_SPACE * 2)]
        misses.difference_update(spaced)
        bare = {w: _SPACE + w.lstrip(_SPACE) for w in spaced}
        new = self._words(list(misses.union(w for w in bare.values() if w not in cache)))
        for w, rest in bare.items():
            ids, extra = cache.get(rest) or new[rest], len(w) - len(rest)
            lone = int(np.frombuffer(ids[:4], "<i4")[0] == self.m.normal[_SPACE])  # then it is part of the run
            new[w] = np.array(self.m.spaces(extra + lone), "<i4").tobytes() + ids[4 * lone :]
        full = len(cache) + len(new) > CACHE
        cache.update(new)
        out = [b"".join(map(cache.__getitem__, words)) for words in split]
        if full:
            cache.clear()
            cache.update(new)
        for w in [w for w in new if len(w) > CACHED_CHARS]:
            del cache[w]
        return out


class Decoder:
    def __init__(self, model: PieceModel):
        self.blob = np.frombuffer(b"".join(model.surface), np.uint8)
        self.size = np.array([len(s) for s in model.surface])
        self.start = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        """Texts of ids[first[i]:first[i + 1]]."""
        size = self.size[ids]
        end = np.cumsum(size)
        data = self.blob[np.repeat(self.start[ids] - end + size, size) + np.arange(size.sum())].tobytes()
        at = np.append(0, end)[first]
        texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [t[t[:1] == b" " :].decode("utf-8", "replace") for t in texts]


def encode(docs: DataFrame, model: str, text: str = "text", into: str = "ids", check: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in ``into`` (array<int>), without begin, end or other special tokens.

    Null and empty texts have no ids; strings that look like special tokens are ordinary text; characters without a piece
    become the ids of their UTF-8 bytes. Rows are kept as they come. With ``check``, a boolean column of that name says whether
    the ids decode to the text.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model))
    kept = f"{into}__kept"

    def ids_of(encoder: Encoder, column: pa.Array) -> tuple[pa.Array, list[str]]:
        texts = utf8(column).to_pylist()
        ids = encoder.encode(texts)
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"))), texts

    @F.arrow_udf("array<int>")
    @tidy
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(shared.value)
        for column in columns_by_bytes(gathered(columns, _TEXTS), 2 * _TEXTS):
            yield ids_of(encoder, column)[0]

    @F.arrow_udf("struct<ids:array<int>,same:boolean>")
    @tidy
    def run_and_check(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, decode = Encoder(shared.value), Decoder(shared.value).decode
        for column in columns_by_bytes(gathered(columns, _TEXTS), 2 * _TEXTS):
            ids, texts = ids_of(encoder, column)
            back = decode(ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64))
            yield pa.StructArray.from_arrays([ids, pa.array([a == b for a, b in zip(back, texts, strict=True)], pa.bool_())], ["ids", "same"])

    if check is None:
        return docs.withColumn(into, run(F.col(text)))
    return docs.withColumn(kept, run_and_check(F.col(text))).withColumns({into: F.col(kept)["ids"], check: F.col(kept)["same"]}).drop(kept)


def decoder(docs: DataFrame, model: str) -> Column:
    """A function of array<int> columns: the text of the ids (null and empty: empty); bytes that are not UTF-8 become U+FFFD."""
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel(model))

    @F.arrow_udf("string")
    @tidy
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = Decoder(shared.value).decode
        for column in columns:
            column = column.fill_null([]) if column.null_count else column
            first, values = column.offsets.to_numpy().astype(np.int64), column.values.to_numpy(zero_copy_only=False)
            at, texts = 0, []
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(first, first[at] + _CELLS, "right")) - 1)
                texts += decode(values[first[at] : first[end]], first[at : end + 1] - first[at])
                at = end
            yield pa.array(texts, pa.string())

    return run
