import random

import numpy as np
import pytest

from breezeline.llm import suffix_dedup
from tests.llm.odd import documents, no_documents, rows


def brute(docs, least):
    """(n_bytes, n_removed, n_spans, kept) by (id, bytes): texts in order of id and hash part, each once."""
    seen, out = {}, {}
    for at, (key, data) in enumerate(docs):
        gone = np.zeros(len(data) + 1, int)
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w in seen:
                gone[i] += 1
                gone[i + least] -= 1
            seen.setdefault(w, at)
        covered = np.cumsum(gone)[:-1] > 0
        spans = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out[key] = (len(data), int(covered.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~covered]))
    return out


def test_repeated_windows_match_a_set_of_windows():
    dice = random.Random(3)
    for _ in range(150):
        least = dice.choice([3, 5, 9])
        pieces = [bytes(dice.choice(b"abc") for _ in range(dice.randrange(least, 30))) for _ in range(dice.randrange(1, 9))]
        pieces += [dice.choice(pieces)[dice.randrange(3) :] + b"zab" for _ in range(3)]
        pieces = [p for p in pieces if len(p) >= least]
        want, seen = [], set()
        for p in pieces:
            for i in range(len(p) + 1):
                w = p[i : i + least]
                whole = i + least <= len(p)
                want.append(whole and w in seen)
                if whole:
                    seen.add(w)
        assert suffix_dedup.repeated_windows(pieces, least).tolist() == want


def test_pieces_cover_every_window_once_and_equal_windows_share_an_anchor():
    dice = random.Random(4)
    name = {}
    shared = bytes(dice.randrange(97, 101) for _ in range(400))
    for i in range(40):
        data = bytes(dice.randrange(97, 101) for _ in range(i * 7)) + shared[i : 400 - i]
        anchors, starts, spans = suffix_dedup.cut(data, 50, 24)
        if len(data) < 50:
            assert not len(starts)
            continue
        assert starts[0] == 0 and spans.sum() == len(data) - 49 and (starts[1:] == (starts + spans)[:-1]).all()
        for a, s, n in zip(anchors, starts, spans):
            for at in range(s, s + n):
                assert name.setdefault(data[at : at + 50], a) == a


@pytest.mark.parametrize("many", [40, 2])
def test_odd_documents_match_brute_force(spark, many):
    # many = 2 sends nearly every shared anchor the way of single windows
    got = suffix_dedup.remove_repeats(documents(spark), least=40, anchor=16, many=many, block_bytes=4096).collect()
    assert len(got) == len(rows())
    frame = documents(spark).selectExpr(
        "coalesce(doc_id, 9223372036854775807) AS id", "coalesce(text, '') AS text",
        "xxhash64(cast(coalesce(text, '') AS binary)) AS mark",
    ).distinct().orderBy("id", "mark").collect()
    want = brute([((None if r.id == 2**63 - 1 else r.id, r.text.encode()), r.text.encode()) for r in frame], 40)
    texts = {}
    for r in rows():
        texts.setdefault(r[0], []).append((r[1] or "").encode())
    for doc_id, own in texts.items():
        mine = sorted((g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got if g.doc_id == doc_id)
        assert mine == sorted(want[doc_id, t] for t in own)


def test_no_documents(spark):
    assert suffix_dedup.remove_repeats(no_documents(spark)).count() == 0


def test_many_texts_under_null_ids(spark):
    dice = random.Random(8)
    shared = ["".join(dice.choice("abcdefgh") for _ in range(60)) for _ in range(40)]
    texts = ["".join(dice.choice("abcdefghij") for _ in range(dice.randrange(20, 60))) for _ in range(10_000)]
    texts = [t + dice.choice(shared) if i % 5 == 0 else t for i, t in enumerate(texts)]
    frame = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(4)
    order = frame.selectExpr("text", "xxhash64(cast(text AS binary)) AS mark").distinct().orderBy("mark").collect()
    want = brute([(r.text, r.text.encode()) for r in order], 40)
    got = suffix_dedup.remove_repeats(frame, least=40, anchor=16).collect()
    assert sorted((g.n_bytes, g.n_removed, g.n_spans, bytes(g.kept)) for g in got) == sorted(want[t] for t in texts)
    assert sum(g.n_removed > 0 for g in got) > 1500
