import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breezeline.llm import pieces
from tests.llm.odd import documents, no_documents, rows

with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as _f:
    MODEL = _f.read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
WORK = pieces.Pieces(MODEL).encoder()


def library_ids(text):
    return [LIBRARY.bos_id(), *LIBRARY.encode(text), LIBRARY.eos_id()]


def check(text):
    packed = WORK.encode(text)
    ids = np.frombuffer(packed, "<u4").tolist()
    assert ids == library_ids(text)
    assert WORK.decode(packed) == LIBRARY.decode(ids)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    check(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aet hino.\n\t▁ThAé%漢", max_size=80))
def test_texts_of_common_pieces(text):
    check(text)


def test_piece_strings_and_long_runs():
    dice = random.Random(2)
    names = [WORK.p.names[i].replace(pieces.SPACE, " ") for i in WORK.p.plain]
    for _ in range(1500):
        check("".join(dice.choice(names) for _ in range(dice.randrange(1, 12))))
    for text in ("a" * 3000, " " * 1001 + "x", "x" + " " * 777, "漢字" * 700, "\0", "<s></s><unk><0x0A>", "ab\n" * 500):
        check(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=15))
def test_decoding_any_ids(ids):
    assert WORK.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


def test_backtracking_is_merging():
    dice = random.Random(9)
    for _ in range(500):
        text = pieces.SPACE + "".join(dice.choice("abcdehinorst") for _ in range(dice.randrange(1, 40)))
        assert WORK.backtrack(text) == WORK.merge(text)


def test_full_caches_are_emptied(monkeypatch):
    monkeypatch.setattr(pieces, "_MOST_CACHED", 5)
    own = pieces.Pieces(MODEL).encoder()
    for text in ("one two three four five six seven", "the thing and another thing", "x  y   z\nq"):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library_ids(text)


def test_odd_documents(spark):
    encoded = pieces.encode(documents(spark), MODEL, F.col("doc_id"), F.col("text").alias("had"), least_cut=2000)
    got = pieces.decode(encoded, MODEL, F.col("doc_id"), F.col("had"), F.col("ids")).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library_ids(r.had or "") and r.decoded == LIBRARY.decode(ids) == (r.had or "")


def test_one_pass_gives_the_same(spark):
    docs = documents(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    got = pieces.encode_and_decode(docs, MODEL, F.col("doc_id"), F.col("text").alias("had"), least_cut=2000).collect()
    assert len(got) == len(rows())
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == library_ids(r.had or "") and r.decoded == LIBRARY.decode(ids)
    assert pieces.encode_and_decode(no_documents(spark), MODEL, F.col("doc_id")).count() == 0


def test_no_documents(spark):
    encoded = pieces.encode(no_documents(spark), MODEL, F.col("doc_id"))
    assert pieces.decode(encoded, MODEL, F.col("doc_id")).count() == 0


def test_other_models_are_refused():
    with pytest.raises(Exception):
        pieces.Pieces(b"no model")
