"""The join against all pairs of small corpora."""

import itertools
import random
import re

import pytest

from quillet.llm import components as components_module
from quillet.llm import ngram_join
from quillet.llm.components import connected_components
from quillet.llm.ngram_join import jaccard_components

from .conftest import components, words


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute(rows, threshold=75):
    sets = {k: shingles(t) for k, t in rows}
    keys = sorted(sets)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    found = components(keys, links)
    return {k: (len(sets[k]), found[k]) for k in keys}


def run(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, **more).collect()}


def corpus(seed, bases=12, copies=9):
    """Texts with copies at various distances, some chained, and a passage that many share."""
    rng, rows = random.Random(seed), []
    common = words(rng, 40)
    for _ in range(bases):
        text = words(rng, rng.choice([3, 5, 6, 12, 40, 150, 400])).split()
        if rng.random() < 0.5:
            text += common.split()
        for _ in range(rng.randrange(1, copies)):
            rows.append(" ".join(text))
            if rng.random() < 0.6:  # the next copy is near this one, not near the first
                for _ in range(rng.randrange(1, 4)):
                    text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("threshold", [75, 50])
def test_all_pairs(make, seed, threshold):
    rows = corpus(seed)
    assert run(make(rows), threshold=threshold) == brute(rows, threshold)


def test_exactly_at_the_threshold(make):
    # 7 shingles each, 6 shared: 6 / 8 = 0.75
    rows = [(1, " ".join(f"a{i}" for i in range(11))), (2, " ".join([*(f"a{i}" for i in range(10)), "z"])), (3, " ".join([*(f"a{i}" for i in range(9)), "y", "z"]))]
    assert run(make(rows)) == brute(rows)
    assert run(make(rows))[2] == (7, 1)


def test_nulls_empty_short_and_long_texts(make):
    long = words(random.Random(5), 60_000)
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, long), (8, long + " more"), (9, "É é É é É"), (10, "é é é é é")]
    got = run(make(rows))
    assert got == brute(rows)
    assert got[1] == (0, 1) and got[5][1] == 4 and got[8][1] == 7


def test_repeated_rows_and_null_keys(make):
    text = words(random.Random(1), 20)
    found = sorted(map(tuple, jaccard_components(make([(5, text), (5, text), (None, text), (None, "a b c"), (7, None)])).collect()), key=str)
    assert found == sorted([(5, 16, 5), (5, 16, 5), (None, 16, 5), (None, 1, None), (7, 0, 7)], key=str)


def test_empty_table(make):
    assert jaccard_components(make([])).count() == 0


def test_large_group_of_copies_and_of_near_copies(make):
    rng = random.Random(3)
    same, near = words(rng, 50), words(rng, 200).split()
    rows = [(i, same) for i in range(400)] + [(1000 + i, " ".join([*near, f"q{i}"])) for i in range(300)]
    got = run(make(rows))
    assert {got[i][1] for i in range(400)} == {0} and {got[1000 + i][1] for i in range(300)} == {1000}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_nul_is_part_of_a_word(make):
    assert run(make([(1, "a\x00b c d e f"), (2, "a b c d e f")])) == {1: (1, 1), 2: (2, 2)}


def test_pairs_of_a_group_near_the_threshold_grow_with_its_rows(make, monkeypatch):
    # most are linked to a few of the group only, so that a handful of hubs leaves them apart
    rng, rows = random.Random(0), []
    base = words(rng, 150, 10**6).split()
    for i in range(800):
        text = list(base)
        for j in rng.sample(range(15), 3) if i % 25 else [7]:
            text[10 * j + rng.randrange(1, 9)] = f"x{rng.randrange(10**9)}"
        rows.append(((i * 7919 + 1) % 801 if i % 25 else 2000 + i, " ".join(text)))
    sizes, stage = [], ngram_join.stage

    def count(df, name):
        back = stage(df, name)
        if name == "pairs":
            sizes.append(back.count())
        return back

    monkeypatch.setattr(ngram_join, "stage", count)
    assert run(make(rows)) == brute(rows)
    assert sum(sizes) < 12 * len(rows), sizes


@pytest.fixture
def stages(monkeypatch):
    """Names of what is written, in order."""
    names = []
    for module in (ngram_join, components_module):
        monkeypatch.setattr(module, "stage", lambda df, name, stage=module.stage: names.append(name) or stage(df, name))
    return names


def test_stars_take_no_round(spark, stages):
    edges = [(hub, hub + i) for hub in range(0, 3000, 100) for i in range(1, 40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 100 * 100 for a, b in edges for i in (a, b)}
    assert stages == ["edges", "least"]


def test_turns_that_link_nothing_leave_the_components_alone(make, stages):
    # passages that a third of the texts hold each, so that lists are long, and no two texts are similar
    rng = random.Random(4)
    passages = [words(rng, 25, 10**6) for _ in range(12)]
    rows = [(i, " ".join(x)) for i, x in enumerate(rng.sample([*itertools.combinations(passages, 4)], 120))]
    text = words(rng, 60, 10**6)
    rows += [(200, text), (201, text + " more")]
    assert run(make(rows)) == brute(rows)
    assert stages.count("links") > 2 and stages.count("edges") == 1, stages
