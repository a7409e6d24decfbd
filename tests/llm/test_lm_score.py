"""Scores against models counted plainly."""

import math
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillet.llm import lm_score
from quillet.llm.lm_score import ADD, MU, score_documents


def split(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def brute(rows):
    uni, bi = [Counter(), Counter()], [Counter(), Counter()]
    vocabulary = {w for _, t, _ in rows for w in split(t)}
    for _, text, good in rows:
        w = split(text)
        for k in range(1 + bool(good)):
            uni[k].update(w)
            bi[k].update(zip(w, w[1:], strict=False))
    out = {}
    for key, text, _ in rows:
        w = split(text)
        loss = [0.0, 0.0]
        for k in (0, 1):
            total = sum(uni[k].values()) + ADD * (len(vocabulary) + 1)
            for i, x in enumerate(w):
                p = (uni[k][x] + ADD) / total
                if i:
                    p = (bi[k][w[i - 1], x] + MU * p) / (uni[k][w[i - 1]] + MU)
                loss[k] -= math.log(p)
        out[key] = (len(w), *((loss[1] / len(w), loss[0] / len(w), (loss[1] - loss[0]) / len(w)) if w else (None,) * 3))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, good boolean, target string").repartition(3)
    return {r.doc_id: (r.n_tokens, r.target_loss, r.background_loss, r.score) for r in score_documents(df, F.col("good")).collect()}


def corpus():
    rng, rows = random.Random(1), []
    for i in range(60):
        low = 0 if i % 3 else 8
        rows.append((i, " ".join(f"W{rng.randrange(low, low + 16)}" for _ in range(rng.randrange(1, 80))), i % 3 == 0 if i % 5 else None))
    return [*rows, (100, None, True), (101, "", True), (102, " \t", None), (103, "only", False), (104, "w1 w2 " * 30_000, None)]


def test_plain_models(spark):
    rows = corpus()
    check(spark, rows)


def test_the_target_scores_lower(spark):
    got = run(spark, corpus())
    mean = lambda keys: sum(got[k][3] for k in keys) / len(keys)
    assert mean([k for k in range(60) if k % 3 == 0]) < mean([k for k in range(60) if k % 3]) - 0.1


def test_no_target_empty_table_repeated_rows(spark):
    assert run(spark, []) == {}
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "c", False)]
    got = run(spark, rows)
    assert got[1][0] == 3 and math.isfinite(got[1][3]) and got[None][0] == 1


def check(spark, rows):
    got, want = run(spark, rows), brute(rows)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == want[k] if want[k][1] is None else got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9), k


def test_more_words_than_any_fixed_vocabulary(spark):
    rng, rows = random.Random(2), []
    for i in range(300):  # 60,000 words that occur once or twice: no cut of the vocabulary knows them all
        rows.append((i, " ".join(f"w{(i * 200 + k) % 60_000} {'the' if rng.random() < 0.1 else f'v{rng.randrange(50)}'}" for k in range(201)), i % 4 == 0))
    check(spark, rows)


@pytest.mark.parametrize("chunk, bucket", [(1, 1), (300, 50), (5_000, 3_000_000)])
def test_no_result_depends_on_the_size_of_chunks_and_buckets(spark, monkeypatch, chunk, bucket):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(lm_score, "BUCKET", bucket)
    rows = [r for r in corpus() if r[0] != 104] + [(200 + i, "the most common line of all " * 3, i % 2 == 0) for i in range(200)]
    check(spark, rows)


def test_chunks_are_written_and_read_a_few_at_a_time(spark, monkeypatch):
    staged, stage = {}, lm_score.stage

    def kept(df, name, **how):
        staged[name] = stage(df, name, **how)
        return staged[name]

    monkeypatch.setattr(lm_score, "stage", kept)
    # one task's rows: 24 texts of 1 MB that hardly compress
    texts = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(62_000)), lambda i: F.hex(F.xxhash64("id", i))), " ")
    found = score_documents(spark.range(0, 24, 1, 1).select(F.col("id").alias("doc_id"), texts.alias("text")), F.col("doc_id") % 2 == 0)
    assert [r.n_tokens for r in found.collect()] == [62_000] * 24
    (file,) = {f.removeprefix("file://") for f in staged["chunks"].inputFiles()}
    groups = pq.ParquetFile(file).metadata
    sizes = [sum(g.column(k).total_compressed_size for k in range(g.num_columns)) for g in map(groups.row_group, range(groups.num_row_groups))]
    assert sum(sizes) > 12e6 and max(sizes) < 10e6
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20
