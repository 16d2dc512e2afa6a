import random
import re

import numpy as np
import pytest
import xxhash

from breezeline.llm import simhash
from breezeline.llm.components import components
from tests.llm.odd import documents, no_documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(marks, bits):
    """Smallest id reachable from each (id, fingerprint)."""
    nodes = sorted(set(marks))
    root = dict.fromkeys(nodes)
    for n in nodes:
        if root[n] is not None:
            continue
        root[n], todo = n[0], [n]
        while todo:
            a = todo.pop()
            for b in nodes:
                if root[b] is None and (a[1] ^ b[1]).bit_count() <= bits:
                    root[b] = n[0]
                    todo.append(b)
    return root


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4])
def test_every_near_pair_shares_a_key(bits):
    keys = simhash.index_keys(bits)
    dice = random.Random(bits)
    for _ in range(300):
        spoiled = {dice.randrange(8) for _ in range(bits)}
        assert any(not spoiled & set(k) for k in keys)


def test_links_in_a_list_match_all_pairs():
    dice = np.random.default_rng(1)
    base = dice.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in dice.integers(0, 63, (80, 2))]))
    a, b = simhash.near_links(fps, 2)
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 2}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("bucket_rows", [4096, 1])
def test_odd_documents(spark, bucket_rows):
    # bucket_rows = 1 deals every list again by finer keys
    got = simhash.near_duplicates(documents(spark), bucket_rows=bucket_rows).collect()
    top = 2**63 - 1
    marks = [(top if i is None else i, brute_fingerprint(t)) for i, t, _, _ in rows()]
    want = brute_components(marks, 2)
    assert len(got) == len(marks)
    for r in got:
        own = (top if r.doc_id is None else r.doc_id, int(r.fingerprint, 16))
        assert own in want and (r.component_id if r.component_id is not None else top) == want[own]
    by_id = {r.doc_id: r for r in got}
    assert by_id[400].fingerprint == "0" * 16 and by_id[401].component_id == by_id[402].component_id == 400


def test_one_row_of_each_group_stays(spark):
    marks = [(2**63 - 1 if i is None else i, brute_fingerprint(t)) for i, t, _, _ in rows()]
    want = sorted(set(brute_components(marks, 2).values()))
    docs = documents(spark)
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in got.collect()) == want


def test_no_documents(spark):
    assert simhash.near_duplicates(no_documents(spark)).count() == 0
    assert simhash.drop_near_duplicates(no_documents(spark)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    dice = random.Random(3)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 300)] + [(7, 7), (None, 5)]
    links += [(400 + dice.randrange(50), 400 + dice.randrange(50)) for _ in range(30)]
    dice.shuffle(links)
    near = {}
    for a, b in links:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        if n in want:
            continue
        todo = [n]
        want[n] = n
        while todo:
            for b in near[todo.pop()]:
                if b not in want:
                    want[b] = n
                    todo.append(b)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    full = {r.node: r.root for r in got} | {r.root: r.root for r in got}
    assert full == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
