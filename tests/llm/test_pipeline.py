"""All stages over odd documents: what each must drop, keep and give back."""

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from breezeline.llm import language, line_dedup, simhash
from tests.llm.odd import documents, no_documents


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    documents(spark).write.parquet(str(root / "documents.parquet"))
    return str(root)


def test_every_stage_keeps_what_it_must(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.materialise(stage(spark, docs, folder))
        assert after.columns == docs.columns
        seen[name] = (docs, after)
        docs = after

    before, known = seen["known language"]
    assert not {400, 401, 402, 403} & {r["doc_id"] for r in known.collect()}  # no letters
    scores = language.predictor(spark, language.fit(before.filter(~language.held_out("doc_id", 4, 2))))
    want = before.select("doc_id", scores(before["text"]).alias("p")).where("p.lang_pred <> 'und' AND p.score >= 0.5")
    assert sorted(str(r["doc_id"]) for r in known.collect()) == sorted(str(r["doc_id"]) for r in want.collect())

    before, lines = seen["repeated lines"]
    assert before.count() == lines.count()  # lines go, documents stay
    kept = {(r["doc_id"], bytes(str(r["kept"]), "utf-8")) for r in line_dedup.drop_repeated_lines(before).collect()}
    assert {(r["doc_id"], (r["text"] or "").encode()) for r in lines.collect()} <= kept | {(r["doc_id"], b"") for r in lines.collect()}

    before, near = seen["near copies"]
    groups = simhash.near_duplicates(before, shingle_words=3, max_bits=2).select("component_id").distinct().count()
    assert near.count() == groups

    before, mixed = seen["source mix"]
    ids = [r["doc_id"] for r in before.collect()]
    taken = [r["doc_id"] for r in mixed.collect()]
    assert set(taken) <= set(ids) and all(taken.count(i) <= 3 * ids.count(i) for i in set(taken))

    reader = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {}
    for r in mixed.collect():
        texts.setdefault(r["doc_id"], []).append(reader.encode(r["text"] or "", add_bos=True, add_eos=True))
    out = corpus_pipeline.STAGES[-1][1](spark, mixed, folder).collect()
    assert len(out) == len(taken)
    for r in out:
        ids = [int.from_bytes(bytes(r["ids"][i : i + 4]), "little") for i in range(0, len(r["ids"]), 4)]
        assert ids in texts[r["doc_id"]] and r["n_tokens"] == len(ids)


def test_no_documents(spark, tmp_path):
    no_documents(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
