"""Windows of benchmark items in documents, against a plain search."""

import random
import re

from pyspark.sql import functions as F

from quillet.llm import decontam
from quillet.llm.decontam import find_contamination, summary

from .conftest import words


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for name, text in items:
        w = split(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = {}
    for key, text in docs:
        w, hit, names = split(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    names |= found
        out[key] = (len(w), len(hit), sorted(str(x) for x in names if x is not None), bool(hit) and 20 * len(hit) >= len(w))
    return out


def run(spark, make, docs, items):
    bench = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, contamination string")
    found = find_contamination(make(docs), bench).select("doc_id", "contamination")
    found = found.select("doc_id", F.col("contamination.items").alias("items"), *(c.alias(k) for k, c in summary(F.col("contamination")).items()))
    return {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found.collect()}


def cases(seed):
    rng = random.Random(seed)
    items = [(i, words(rng, rng.choice([1, 2, 4, 8, 12, 13, 14, 30]), 60)) for i in range(25)]
    items += [(100, items[-1][1]), (101, ""), (102, None), (103, "?!"), (104, "same " * 20), (None, words(rng, 15))]
    docs = []
    for i in range(40):
        parts = [words(rng, rng.randrange(0, 60), 60)]
        for _ in range(rng.randrange(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            parts += [", ".join(w[rng.randrange(0, 3) :]).upper(), words(rng, rng.randrange(0, 120))]
        docs.append((i, " ".join(parts)))
    return [*docs, (90, None), (91, ""), (92, "same " * 30), (93, "same " * 12), (94, "Ünïted " * 5), (95, words(rng, 30_000, 5_000) + " " + (items[0][1] or ""))], items


def test_plain_search(spark, make):
    for seed in range(2):
        docs, items = cases(seed)
        assert run(spark, make, docs, items) == brute(docs, items)


def test_many_blocks(spark, make, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK", 40)
    docs, items = cases(7)
    assert run(spark, make, docs, items) == brute(docs, items)


def test_empty_tables_and_repeated_rows(spark, make):
    docs, items = cases(1)
    assert run(spark, make, docs[:5], []) == brute(docs[:5], [])
    assert run(spark, make, [], items) == {}
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert find_contamination(make([(1, "a"), (1, "a"), (None, "a")]), bench).count() == 3


def test_contaminated_from_a_twentieth_on(spark, make):
    item = " ".join(f"q{i}" for i in range(13))
    rows = [(1, item + " x" * (260 - 13)), (2, item + " x" * (261 - 13))]
    got = run(spark, make, rows, [(1, item)])
    assert got[1] == (260, 13, ["1"], True) and got[2] == (261, 13, ["1"], False)
