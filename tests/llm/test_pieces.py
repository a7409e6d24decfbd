"""Ids, counts and decoding against the library."""

import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillet.llm.pieces import Decoder, Encoder, PieceModel, decoder, encode
from quillet.llm.token_count import Lengths, PieceCounter, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "a", " a", "a ", "a  b", "Hello world, this is a test.", "naïve café ĳ ﬁ Å ½", "日本語のテキスト と 漢字", "жизнь и смерть", "🙂🙃 \U0001f468‍\U0001f469", "<s> </s> <unk> <pad> [MASK] <0x41>",
    "tab\tnewline\nret\r\n", "▁ already ▁▁marked▁", " non breaking", "\x00\x01\x02", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0123456789" * 30, "https://example.org/a?b=c&d=%20", "é combining", "﻿bom", "#$%^&*()_+{}|",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


def test_ids_and_counts_of_many_texts(spark, make, library):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice([t for t in TEXTS if t]) for _ in range(rng.randrange(1, 8))) for _ in range(60)] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(50)) for _ in range(60)]
    texts += ["x" * 20_000, "the quick brown fox " * 5_000]
    df = make(list(enumerate(texts)))
    want = [library.encode(t or "") for t in texts]
    got = {r.doc_id: (list(r.out), r.back) for r in encode(df, MODEL, into="out").select("doc_id", "out", decoder(df, MODEL)(F.col("out")).alias("back")).collect()}
    assert [got[i][0] for i in range(len(texts))] == want
    assert [got[i][1] for i in range(len(texts))] == [library.decode(x) for x in want]
    same = {r.doc_id: r.same for r in encode(df, MODEL, check="same").select("doc_id", "same").collect()}
    assert same == {i: library.decode(w) == (t or "") for i, (t, w) in enumerate(zip(texts, want, strict=True))}
    counts = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, MODEL).collect()}
    assert counts == {i: (len((t or "").encode()), len(w), len(w) > 4096) for i, (t, w) in enumerate(zip(texts, want, strict=True))}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=8))
def test_any_text(texts):
    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), _model()
    want = [library.encode(t) for t in texts]
    got = Encoder(model).encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == want
    ids = np.array([i for w in want for i in w], np.int64)
    first = np.cumsum([0, *map(len, want)])
    assert Decoder(model).decode(ids, first) == [library.decode(w) for w in want]
    assert PieceCounter(open(MODEL, "rb").read()).count(pa.array(texts, pa.string())).tolist() == [len(w) for w in want]


def _model(kept=[]):  # noqa: B006
    if not kept:
        kept.append(PieceModel(MODEL))
    return kept[0]


def test_empty_and_repeated_rows(make):
    assert encode(make([]), MODEL, into="out").count() == 0 and count_tokens(make([]), MODEL).count() == 0
    rows = count_tokens(make([(1, "a b"), (1, "a b"), (None, "a b")]), MODEL).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 2), (1, 2), (1, 2)]


def test_counts_do_not_depend_on_the_table(library):
    texts = ["some words and some more words", "other words", ""]
    want, proto = [len(library.encode(t)) for t in texts], open(MODEL, "rb").read()
    plain, helped = PieceCounter(proto), PieceCounter(proto, Lengths([" some", " words", "  "], [1, 1, 1]))
    assert plain.count(pa.array(texts)).tolist() == helped.count(pa.array(texts)).tolist() == want
    assert not {" some", " words"} & set(helped.cache) and len(helped.cache) < len(plain.cache)


def test_a_megabyte_of_spaces(library, model):
    texts = [" " * 1_000_000 + "x", "a" + " " * 300_001, " " * 65_537]
    want = [library.encode(t) for t in texts]
    assert [np.frombuffer(x, "<i4").tolist() for x in Encoder(model).encode(texts)] == want
    assert PieceCounter(open(MODEL, "rb").read()).count(pa.array(texts)).tolist() == [len(w) for w in want]


def test_words_are_not_worked_on_one_by_one(library, model):
    # most with a character that has no piece, half of them in two texts
    rng = random.Random(4)
    words = ["".join(chr(rng.randrange(97, 123)) for _ in range(rng.randrange(1, 12))) + chr(rng.randrange(0x3400, 0x4D00)) * rng.randrange(3) for _ in range(20_000)]
    texts = [" ".join(words), " ".join(words[::-2])]
    encoder, calls = Encoder(model), [0]
    encoder.encode(["a warm one"])

    def count(frame, event, arg):
        calls[0] += event == "call"

    sys.setprofile(count)
    try:
        found = encoder.encode(texts)
    finally:
        sys.setprofile(None)
    want = [library.encode(t) for t in texts]
    assert [np.frombuffer(x, "<i4").tolist() for x in found] == want
    assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == want  # from the cache
    # calls of functions grow with the lengths that there are, not with the words
    assert calls[0] < len(set(words)), calls


def test_long_words_are_not_kept(library, model):
    texts, encoder = ["ab" * 40 + " cd 日" + "x" * 70, "ab" * 40 + "  cd"], Encoder(model)
    for _ in range(2):
        assert [np.frombuffer(x, "<i4").tolist() for x in encoder.encode(texts)] == [library.encode(t) for t in texts]
        assert encoder.cache and max(map(len, encoder.cache)) <= 64


def test_every_key_of_a_shared_slot_is_found(model):
    ids = np.flatnonzero(model.length)
    keys = model.keys[np.argsort(model.ids)]
    assert model.find(keys).tolist() == np.sort(model.ids).tolist() == ids.tolist()
    assert (model.find(keys ^ np.uint64(1 << 40)) == -1).all()
