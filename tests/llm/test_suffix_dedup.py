"""Repeated byte strings against a table of all of them."""

import random
import zlib
from collections import Counter

import pytest

from quillet.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    """[(key, n_bytes, spans, kept)] in the order of the rows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (key, _), t in zip(rows, texts, strict=True):
        hit = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = [True] * length
        spans, kept = [], bytearray()
        for i, h in enumerate(hit):
            if h and (i == 0 or not hit[i - 1]):
                spans.append([i, i])
            if h:
                spans[-1][1] = i + 1
            else:
                kept.append(t[i])
        out.append((key, len(t), [tuple(s) for s in spans], bytes(kept)))
    return out


def run(df, length):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in remove_repeats(df, length).collect()]


def same(got, want):
    assert sorted(got, key=repr) == sorted(want, key=repr)


def prose(rng, n):
    return " ".join(f"{rng.choice(['ä', 'b', 'ccc', 'жи'])}{rng.randrange(10**6)}" for _ in range(n))[:n]


def corpus(seed, length):
    """Passages of about the length, shared within and between texts."""
    rng = random.Random(seed)
    passages = [prose(rng, length + d) for d in (-60, -1, 0, 1, 40, 3 * length)]
    rows = [(i, prose(rng, rng.randrange(0, 3 * length)) + "".join(rng.choice(passages) + prose(rng, rng.randrange(0, length)) for _ in range(rng.randrange(0, 4)))) for i in range(40)]
    return rows + [(100, None), (101, ""), (102, "z" * (length - 1)), (103, "z" * (length + 1)), (104, "ab" * length), (105, passages[2]), (105, passages[2]), (106, "q" * (5 * length))]


@pytest.mark.parametrize(("seed", "length"), [(0, 400), (1, 400), (2, 100)])
def test_table_of_all_strings(make, seed, length):
    rows = corpus(seed, length)
    same(run(make(rows), length), brute(rows, length))


def test_exact_length(make):
    rng = random.Random(9)
    passage = prose(rng, 800).encode()[:400].decode("utf-8", "ignore")
    passage += "x" * (400 - len(passage.encode()))
    rows = [(1, "1" + passage + "2"), (2, "3" + passage + "4"), (3, "5" + passage[:-1] + "6")]
    want = brute(rows, 400)
    assert want[0][2] == [(1, 401)] and want[2][2] == []
    same(run(make(rows), 400), want)


def test_one_very_common_passage(make):
    rng = random.Random(3)
    passage = prose(rng, 500)
    rows = [(i, prose(rng, 50) + passage + prose(rng, 50)) for i in range(300)]
    same(run(make(rows), 400), brute(rows, 400))


def test_long_text_and_null_keys(make):
    rng = random.Random(8)
    long = prose(rng, 300_000)
    rows = [(1, long + long[1000:1600]), (None, long[5000:5700]), (None, "short"), (None, None)]
    same(run(make(rows), 400), brute(rows, 400))


def test_empty_table(make):
    assert remove_repeats(make([])).count() == 0


def test_texts_of_one_crc32_under_one_key_stay_apart(make):
    rng = random.Random(9)
    bodies = ["".join(rng.choice("abcdefgh ") for _ in range(450)) for _ in "ab"]
    start = [zlib.crc32(b.encode()) for b in bodies]
    ends = ["".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(200_000)]
    seen = {zlib.crc32(x.encode(), start[0]): x for x in ends}
    i, j = next((seen[c], x) for x in ends if (c := zlib.crc32(x.encode(), start[1])) in seen)
    one, other = f"{bodies[0]}{i}", f"{bodies[1]}{j}"
    assert zlib.crc32(one.encode()) == zlib.crc32(other.encode())
    got = [bytes(r.kept) for r in remove_repeats(make([(None, one), (None, other), (7, "zz" + bodies[0])])).collect()]
    assert sorted(got) == sorted([i.encode(), other.encode(), b"zz"])
