"""Links of vectors against all cosines."""

import math

import numpy as np
import pytest

from quillet.llm import vector_dedup
from quillet.llm.vector_dedup import close_pairs, link_vectors, open_pairs, pack

from .conftest import components


def brute(rows, threshold=0.95):
    ok = {k: np.array(v, float) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    keys, links = sorted(ok), []
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold:
                links.append((a, b))
    found = components([k for k, _ in rows], links)
    return {k: (sum(k in p for p in links), found[k], k == found[k]) for k, _ in rows}


def run(spark, rows):
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<double>, id int").repartition(3)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(df).collect()}


def vectors(seed, n=120, dim=32):
    """Random directions and perturbed copies; none within rounding of the threshold."""
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        x = rng.standard_normal(dim)
        for _ in range(rng.integers(1, 5)):
            rows.append(x * rng.uniform(0.1, 9))
            x = x + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.2])
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(rows)), rows, strict=True)]


def test_all_cosines(spark):
    rows = vectors(1)
    want, got = brute(rows), run(spark, rows)
    total = sum(v[0] for v in want.values())
    assert sum(v[0] for v in got.values()) >= 0.99 * total and all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)


def test_blocks_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.standard_normal(24)
    rows = [(i, (x + 0.01 * rng.standard_normal(24)).tolist()) for i in range(90)]
    assert run(spark, rows) == {k: (89, 0, k == 0) for k, _ in rows}


@pytest.mark.parametrize("dim", [3, 48, 64, 130])
def test_estimates_never_decide_against_a_close_pair(dim):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, dim))
    y = x + 0.33 * rng.standard_normal(x.shape) * rng.uniform(0.8, 1.2, (300, 1))
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    want = {(i, j) for i, j in zip(*np.nonzero(x @ y.T >= 0.95), strict=True)}
    left = set(zip(*open_pairs(pack(x), pack(y), 0.95), strict=True))
    assert want and want <= left and set(zip(*close_pairs(x, y, 0.95), strict=True)) == want
    # and they do decide: of pairs far from the threshold hardly one is left
    assert dim < 10 or len(left - want) < 0.02 * 300 * 300


def test_estimates_are_unbiased():
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 2000, 64))
    y = x + rng.uniform(0, 2, (2000, 1)) * y
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    a, b = pack(x), pack(y)
    signs = np.unpackbits(a.signs.view(np.uint8).reshape(2000, -1), axis=1)[:, :64] * 2.0 - 1
    error = (signs * b.steps).sum(axis=1) * b.size / 8 / a.factor - (x * y).sum(axis=1)
    assert abs(error.mean()) < 0.01 and error.std() < 0.12


def test_thousands_of_planted_pairs_and_a_hot_group(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((2500, 64))
    near = base + 0.28 * rng.standard_normal(base.shape) * rng.uniform(0.5, 1.2, (2500, 1))
    hot = rng.standard_normal(64) + 0.1 * rng.standard_normal((1200, 64))
    x = np.concatenate((base, near, hot))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    n = np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))
    got = run(spark, [(k, v.tolist()) for k, v in enumerate(x)])
    have = np.array([got[k][0] for k in range(len(x))])
    planted = slice(0, 5000)
    assert n[planted].sum() > 2000 and (have <= n).all()
    assert have[planted].sum() >= 0.99 * n[planted].sum() and have[5000:].sum() >= 0.99 * n[5000:].sum()
    assert {got[k][1] for k in range(5000, len(x))} == {5000}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 1.0]), (8, [2.0, 2.0]), (9, [1.0, 1.0]), (10, [-1.0, -1.0]), (11, [1.0, 1.0, 0.0])]
    got = run(spark, rows)
    assert got == brute(rows) and got[9] == (2, 7, False) and got[10] == (0, 10, True)


def test_repeated_rows_null_keys_empty_table(spark):
    schema = "vec_id long, embedding array<float>"
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0])]
    got = sorted(map(tuple, link_vectors(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, False)], key=str)
    assert link_vectors(spark.createDataFrame([], schema)).count() == 0


@pytest.mark.parametrize("scale", [1e-150, 1e150])
def test_lengths_do_not_matter(spark, scale):
    assert run(spark, [(1, [scale, scale]), (2, [1.0, 1.001])]) == {1: (1, 1, True), 2: (1, 1, False)}
