"""Exact top-k inner products by reading sorted lists only, with lower and upper score bounds.

Vectors are cut into blocks. In a block every dimension has its list of rows sorted by value, and the lists are read
in step from both ends. What was read of a row is part of its score; each value not yet met lies between the two ends
read so far, which bounds the score below and above. A query's reading stops when few enough rows can still be among
its k best, and the scores of those are then resolved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from breezeline.llm.common import id_in, id_out, ship
from breezeline.session import materialise

ship(__name__)


def whole_vectors(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<long>): floor(scale * x) of every component. Null vectors, and those with null or non-finite
    components, are left out. A whole component beyond 64 bits is an error, since no long can stand for it."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    beyond = F.raise_error(F.lit("a whole component does not fit 64 bits")).cast("long")
    scaled = lambda x: x.cast("double") * scale
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(beyond)
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, finite)
    return vectors.filter(good).select(id_in(id_col).alias("vec_id"), F.transform(vector_col, whole).alias("v"))


def block_top(queries: np.ndarray, values: np.ndarray, order: np.ndarray, ranked: np.ndarray, k: int, resolve: int):
    """For each query the row numbers of a block among which its k best are, and how much of the lists was read.

    ``order[d]`` lists the rows by falling value in dimension d, ``ranked[d]`` these values. Queries are taken together,
    so that a list entry is read once for all of them; each leaves when at most ``resolve`` rows can still qualify."""
    n, dims = values.shape
    out = [np.arange(n)] * len(queries)
    depth = np.zeros(len(queries))
    if n <= resolve or not dims:
        return out, depth
    alive = np.arange(len(queries))
    weights = queries.T.astype(np.float64)  # a column per query
    slack = 1e-9 * (np.abs(weights) * np.abs(ranked).max(1)[:, None]).sum(0) + 1e-9
    read = np.zeros((n, len(queries)))
    unseen = np.ones((n, dims))
    done = 0
    for part in (0.0625, 0.125, 0.25, 0.375, 0.45, 0.5):
        stop = n // 2 if part < 0.5 else -(-n // 2)
        stop = min(stop, max(done, int(n * part))) if part < 0.5 else stop
        for d in range(dims):
            for lo, hi in ((done, stop), (max(stop, n - stop), n - done)):
                rows = order[d, lo:hi]
                read[rows] += ranked[d, lo:hi, None] * weights[d]
                unseen[rows, d] = 0
        done = stop
        if part < 0.5:
            # values not met lie between the two ends
            top, low = ranked[:, min(done, n - 1), None] * weights, ranked[:, n - 1 - min(done, n - 1), None] * weights
            upper = read + unseen @ np.maximum(top, low)
            lower = read + unseen @ np.minimum(top, low)
        else:
            upper = lower = read
        bar = np.partition(lower, n - k, axis=0)[n - k]
        open_ = upper >= bar - slack
        few = (open_.sum(0) <= resolve) | (part == 0.5)
        for column in np.flatnonzero(few):
            out[alive[column]] = np.flatnonzero(open_[:, column])
            depth[alive[column]] = 2 * part
        alive, weights, slack, read = alive[~few], weights[:, ~few], slack[~few], np.ascontiguousarray(read[:, ~few])
        if not len(alive):
            break
    return out, depth


def exact_scores(values: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products of rows and a query: in 64 bits where no sum can leave them, else in Python's integers."""
    if not values.size:
        return np.zeros(len(values), np.int64)
    most = max(int(values.max()), -int(values.min())) * max(int(query.max()), -int(query.min())) * len(query)
    if most < 2**63:
        return values @ query
    scores = values.astype(object) @ query.astype(object)
    if any(abs(s) >= 2**63 for s in scores):
        raise OverflowError("a score does not fit 64 bits")
    return scores.astype(np.int64)


def _best_of_blocks(k: int, resolve: int):
    """Each query's k best rows of one block; a frame holds the block's rows and the queries asked of it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame["asks"].to_numpy()
        rows, queries = frame[~asked], frame[asked]
        out: list[tuple] = []
        if len(rows) and len(queries):
            # vectors of unequal length meet only those of their own length
            for size in {len(v) for v in queries["v"]}:
                own = rows[rows["v"].map(len) == size].sort_values(["vec_id", "row"], kind="stable")
                if not len(own):
                    continue
                values = np.stack(own["v"].to_list()) if size else np.zeros((len(own), 0), np.int64)
                ids = own["vec_id"].to_numpy()
                order = np.argsort(-values, axis=0, kind="stable").T.copy()
                ranked = np.take_along_axis(values.T, order, 1).astype(np.float64)
                mine = queries[queries["v"].map(len) == size]
                names, asks = mine["vec_id"].to_numpy(), np.stack(mine["v"].to_list()) if size else np.zeros((len(mine), 0), np.int64)
                places = mine["row"].to_numpy()
                # room for the rows of a query's own id, which take no part
                extra = int(np.unique(ids[np.isin(ids, names)], return_counts=True)[1].max(initial=0))
                for start in range(0, len(names), 64):
                    some = asks[start : start + 64]
                    near, _ = block_top(some, values, order, ranked, min(len(ids), k + extra), max(resolve, k + extra))
                    for query_id, ask, q, rows_ in zip(names[start : start + 64].tolist(), places[start:].tolist(), some, near):
                        rows_ = rows_[ids[rows_] != query_id]
                        scores = exact_scores(values[rows_], q)
                        best = np.lexsort((ids[rows_], -scores))[:k]
                        out.extend((ask, query_id, ids[rows_[b]], int(scores[b])) for b in best)
        return pd.DataFrame(out, columns=["ask", "query_id", "vec_id", "score"]).astype("int64")

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    block_rows: int = 8192,
    query_rows: int = 2048,
    resolve: int = 256,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product, ties to the smaller vec_id.

    Both frames have (vec_id, v array<long>). Rows and queries are dealt into blocks of about the given sizes; each
    pair of blocks is one group, so a group is bounded whatever the number of rows, and gives back k rows per query
    that are merged by a second, limited ranking. A query's own rows (same vec_id) take no part; fewer other rows than
    k give fewer results. Repeated rows count as often as they come, repeated queries are answered as often; vectors
    of other lengths than the query's take no part; an empty table gives no rows. Rows are dealt by their place in the
    table, so a repeated or null id fills no block. Scores are exact; one beyond 64 bits is an error."""
    # numbered by file and place, which a task that runs again finds unchanged
    rows = materialise(vectors).withColumn("row", F.monotonically_increasing_id())
    asks = materialise(queries).withColumn("row", F.monotonically_increasing_id())
    blocks = max(1, -(-rows.count() // block_rows))
    shares = max(1, -(-asks.count() // query_rows))
    deal = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    told = ["vec_id", "row", "v"]
    spread = rows.select(*told, F.lit(False).alias("asks"), deal(blocks, 1).alias("block"), every(shares).alias("share"))
    asked = asks.select(*told, F.lit(True).alias("asks"), deal(shares, 2).alias("share"), every(blocks).alias("block"))
    met = spread.unionByName(asked)
    best = met.groupBy("block", "share").applyInPandas(
        _best_of_blocks(k, resolve), "ask long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("ask").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(id_out("query_id").alias("query_id"), "rank", id_out("vec_id").alias("vec_id"), "score")


def search_own(vectors: DataFrame, asks: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """top_k of a table's own rows for those of its rows that ``asks`` picks by vec_id."""
    whole = materialise(whole_vectors(vectors, scale))
    return top_k(whole, whole.filter(asks), k)
