"""Exact top-k and embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from breezeline.llm import embedding_dedup, topk

KINDS = "vec_id long, embedding array<float>, label int, score long, rank int, node long, v int"


def vectors(seed=1):
    dice = np.random.default_rng(seed)
    out = [(i, dice.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(220)]
    centre = dice.normal(size=16)
    out += [(300 + i, (centre + dice.normal(size=16) * 0.03).astype(np.float32).tolist(), 1) for i in range(60)]
    out += [(400 + i, out[5][1], out[5][2]) for i in range(6)]  # copies
    out += [(450, out[5][1], 9), (451, out[5][1], None), (50, out[0][1], 0), (50, out[0][1], 0)]
    out += [(460, None, 1), (461, [1.0] * 15 + [None], 1), (462, [float("nan")] * 16, 1), (463, [float("inf")] + [0.0] * 15, 1)]
    out += [(464, [0.0] * 16, 1), (465, [0.0] * 16, 1), (466, [1.0, 2.0], 1), (467, [2.0, 4.0], 1), (None, out[7][1], out[7][2])]
    out += [(None, out[8][1], out[8][2]), (468, [], 1), (500, [x * 3e30 for x in out[9][1]], out[9][2]), (501, [1e-30] * 16, 2)]
    return out


def table(spark, data):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in data], KINDS).repartition(3)


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute_top(data, asks, k):
    """A result per query row: queries that share an id are answered each."""
    whole = [(2**63 - 1 if i is None else i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in data if finite(v)]
    out = []
    for q, v in whole:
        if asks(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in whole if c != q and len(w) == len(v))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block_rows, query_rows, resolve", [(8192, 2048, 256), (60, 3, 4)])
def test_top_k(spark, block_rows, query_rows, resolve):
    data = [r for r in vectors() if r[0] != 500]  # 500 does not fit 64 bits
    data += [(600 + i, [v, *[1.0] * 15], 1) for i, v in enumerate((6e5, 7e5, 8e5))]
    data += [(None, r[1], 1) for r in data[:50]] * 4 + [(77, data[77][1], 1)] * 200
    whole = topk.whole_vectors(table(spark, data))
    got = topk.top_k(whole, whole.filter("vec_id % 50 = 0"), 5, block_rows, query_rows, resolve)
    want = brute_top(data, lambda q: q % 50 == 0, 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((q, n, None if c == 2**63 - 1 else c, s) for q, n, c, s in want), key=str)


def test_scores_are_exact_or_an_error(spark):
    data = [(1, [6e5, 1.0], 1), (2, [7e5, 1.0], 1), (3, [8e5, 1.0], 1)]
    whole = topk.whole_vectors(table(spark, data))
    got = topk.top_k(whole, whole.filter("vec_id = 1")).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3, 153600000 * 204800000 + 65536), (1, 2, 2, 153600000 * 179200000 + 65536)]
    many = np.array([[2**40, -(2**40)], [3, 5]])
    assert topk.exact_scores(many, np.array([2**30, 2**30 - 1])).tolist() == [2**40, 3 * 2**30 + 5 * (2**30 - 1)]
    with pytest.raises(OverflowError):
        topk.exact_scores(many, np.array([2**30, -(2**30)]))
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.whole_vectors(table(spark, [(1, [3e30], 1)])).collect()


def test_a_hot_id_fills_no_block(spark):
    seen = []
    rows = table(spark, [(None, [float(i % 7), 1.0], 1) for i in range(3000)] + [(i, [1.0, 2.0], 1) for i in range(20)])
    whole = topk.whole_vectors(rows)
    real = topk.materialise
    topk.materialise = lambda df: seen.append(real(df)) or seen[-1]
    try:
        top = topk.top_k(whole, whole.filter("vec_id = 0"), 5, block_rows=300)
    finally:
        topk.materialise = real
    assert top.count() == 5
    blocks = seen[0].select(F.pmod(F.xxhash64(F.lit(1), F.monotonically_increasing_id()), F.lit(11)).alias("b")).groupBy("b").count()
    assert blocks.agg({"count": "max"}).first()[0] < 600


def test_lists_are_left_early_when_the_best_stand_out():
    dice = np.random.default_rng(3)
    values = dice.integers(-9, 10, (4000, 8))
    query = np.full(8, 5)
    values[[17, 99, 1234]] = 90
    order = np.argsort(-values, axis=0, kind="stable").T.copy()
    ranked = np.take_along_axis(values.T, order, 1).astype(float)
    rows, depth = topk.block_top(query[None], values, order, ranked, 3, 10)
    assert {17, 99, 1234} <= set(rows[0].tolist()) and len(rows[0]) <= 10 and depth[0] < 1
    for seed in range(30):
        n = 300 + seed % 2
        values = np.random.default_rng(seed).integers(-3, 4, (n, 5))
        queries = np.random.default_rng(seed + 99).integers(-2, 3, (9, 5))
        order = np.argsort(-values, axis=0, kind="stable").T.copy()
        ranked = np.take_along_axis(values.T, order, 1).astype(float)
        for query, rows in zip(queries, topk.block_top(queries, values, order, ranked, 7, 8)[0]):
            scores = values @ query
            assert set(np.flatnonzero(scores >= np.sort(scores)[-7])) <= set(rows.tolist())


def test_few_rows_and_none(spark):
    two = topk.whole_vectors(table(spark, vectors()[:2]))
    assert [tuple(r)[:3] for r in topk.top_k(two, two, 5).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    none = topk.whole_vectors(table(spark, vectors()[:2]).limit(0))
    assert topk.top_k(none, none).count() == 0
    small = [r for r in vectors() if r[0] != 500]
    assert topk.search_own(table(spark, small), F.col("vec_id") < 0).count() == 0


def brute_links(data, least):
    n = len(data)
    links = np.zeros((n, n), bool)
    units = []
    for _, v, label in data:
        good = finite(v) and label is not None and any(v)
        x = np.array(v, np.float64) if good else None
        units.append(None if x is None else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    for i in range(n):
        for j in range(n):
            if i != j and data[i][2] == data[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]):
                links[i, j] = units[i] @ units[j] >= least
    ids = [2**63 - 1 if r[0] is None else r[0] for r in data]
    root = list(ids)
    while True:
        new = [min([root[i], *(root[j] for j in np.flatnonzero(links[i]))]) for i in range(n)]
        if new == root:
            return links.sum(1), ids, root
        root = new


@pytest.mark.parametrize("chunk_rows", [512, 7])
def test_near_vectors(spark, chunk_rows):
    data = vectors()
    counts, ids, root = brute_links(data, 0.98)
    got = embedding_dedup.near_duplicates(table(spark, data), chunk_rows=chunk_rows).collect()
    top = 2**63 - 1
    assert sorted((r.vec_id if r.vec_id is not None else top, r.n_links, r.component_id if r.component_id is not None else top) for r in got) == sorted(
        zip(ids, counts.tolist(), root)
    )
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert counts.max() > 50


def test_recall_at_the_bound(spark):
    dice = np.random.default_rng(8)
    data = []
    for i in range(0, 3000, 2):
        a = dice.normal(size=64)
        a /= np.linalg.norm(a)
        b = dice.normal(size=64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        data += [(i, a.tolist(), 0), (i + 1, (0.981 * a + math.sqrt(1 - 0.981**2) * b).tolist(), 0)]
    got = embedding_dedup.near_duplicates(table(spark, data)).agg(F.sum("n_links")).first()[0]
    assert got >= 0.98 * 3000


def test_no_vectors(spark):
    assert embedding_dedup.near_duplicates(table(spark, vectors()[:1]).limit(0)).count() == 0
