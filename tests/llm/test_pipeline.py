"""The corpus pipeline on a small table, stage by stage, against plainer code."""

import random
import re

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from quillet.llm.langid import UNDETERMINED, fit, identify

from .conftest import words
from .test_decontam import brute as contamination
from .test_ngram_join import brute as groups
from .test_pii import plain

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LABEL = {"aa": "ba ko mi", "bb": "sch ei ung"}


def documents():
    rng, rows = random.Random(11), []
    for i in range(120):
        lang = rng.choice(["aa", "bb"])
        body = " ".join(rng.choice(LABEL[lang].split()) + str(rng.randrange(10**4)) + rng.choice(LABEL[lang].split()) for _ in range(rng.randrange(1, 80)))
        if rng.random() < 0.3:
            body += f" write to user{i}@host{i % 5}.org or 10.0.{i}.1 ."
        rows.append((i, body, lang))
    for i in range(30):  # exact and near copies
        k, body, lang = rows[rng.randrange(120)]
        rows.append((200 + i, body + (f" extra{i}" if i % 2 else ""), lang))
    rows += [(300, None, "aa"), (301, "", None), (302, "1234 !!", "bb"), (303, ITEM + " " + rows[3][1], "aa"), (304, "ba ko mi " * 3000, None)]
    return [(k, t, x, "s", len(t or "")) for k, t, x in rows]


ITEM = words(random.Random(5), 20)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(documents(), SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


def stages(spark, docs, where):
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(spark.createDataFrame((d := f(spark, out[-1], where)).collect(), d.schema))
    return out


def test_stages_against_plainer_code(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    made = stages(spark, docs, folder)
    assert all(d.columns == docs.columns for d in made[:-1])
    rows = [{r.doc_id: r.text for r in d.collect()} for d in made]
    # 1: what the model is sure of
    found = {r.doc_id: r.p for r in identify(docs, fit(docs), into="p").collect()}
    assert set(rows[1]) == {k for k, p in found.items() if p["lang"] != UNDETERMINED and p["score"] >= corpus_pipeline.MIN_SCORE}
    assert 300 not in rows[1] and 302 not in rows[1] and len(rows[1]) > 100
    # 2: one of each group
    assert set(rows[2]) == {k for k, (_, c) in groups(list(rows[1].items())).items() if c == k} and len(rows[2]) < len(rows[1])
    # 3: no benchmark passages
    assert set(rows[3]) == {k for k, x in contamination(list(rows[2].items()), [(1, ITEM), (2, "")]).items() if not x[3]} and 303 not in rows[3]
    # 4: personal data is gone, everything else stays
    for k, text in rows[4].items():
        want = rows[3][k]
        for kind, a, b in sorted(plain(want), key=lambda s: -s[1]):
            want = want[:a] + f"[{kind.upper()}]" + want[b:]
        assert re.sub(r"\[[A-Z]+\]", "", text) == re.sub(r"\[[A-Z]+\]", "", want)
    # 5: the library's ids
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in made[5].collect():
        assert list(r.ids) == sp.encode(r.text) and r.n_ids == len(r.ids) and r.n_chars == len(r.text)
    # all of it in one go
    assert sorted((r.doc_id, r.text) for r in corpus_pipeline.run(spark, folder).collect()) == sorted(rows[5].items())


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_null_and_repeated_ids(spark, folder):
    text, other = documents()[3][1], "quite another text, of different words than the first one has"
    rows = [(None, text, "aa", "s", 1), (None, text, "aa", "s", 1), (5, text, "aa", "s", 1), (5, text, "aa", "s", 1), (5, other, "aa", "s", 1), (None, "no number but some words of its own", None, None, None), (7, None, None, None, None)]
    kept = corpus_pipeline.ngram_join(spark, spark.createDataFrame(rows, SCHEMA), folder).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(5, text), (5, other), (0, rows[5][1]), (7, "")])


def test_columns_of_clashing_names(spark, folder):
    extra = "ids string, n_ids string, round_trip string, key string, component_id string, node string, language string, row string, a map<string,string>"
    docs = spark.createDataFrame([(*r, *"abcdefgh", {"x": "y"}) for r in documents()[:40]], f"doc_id long, text string, lang string, source string, {extra}".replace("source string,", "source string, n_chars int,"))
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, folder)
        rows = out.collect()
        assert rows and (name == "pieces" or out.columns == docs.columns)
    assert sorted(out.columns) == sorted(docs.columns) and all(isinstance(r.n_ids, int) for r in rows)
