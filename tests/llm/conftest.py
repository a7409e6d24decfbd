import random

import pytest

#: Columns that documents may bring along, named like those that operators use inside.
EXTRA = ("key", "n", "token", "part", "ids", "spans", "id", "sum", "a", "b", "component_id", "node")


@pytest.fixture(scope="session")
def make(spark):
    """DataFrame of (doc_id, text) rows with clashing extra columns."""

    def build(rows, parts=3, **types):
        schema = f"doc_id {types.get('doc_id', 'long')}, text {types.get('text', 'string')}, " + ", ".join(f"`{c}` string" for c in EXTRA)
        return spark.createDataFrame([(*r, *("x" if i % 2 else None for i in range(len(EXTRA)))) for r in rows], schema).repartition(parts)

    return build


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def components(nodes, links):
    """node -> smallest node that links lead to."""
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {x: root(x) for x in nodes}
