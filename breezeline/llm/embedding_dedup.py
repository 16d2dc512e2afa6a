"""Embedding near-duplicates: Euclidean p-stable hashing in several tables, then exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.llm.common import NULL_ID, group_bounds, id_in, id_out, local_roots, ship, spread, whole_groups
from breezeline.llm.components import components
from breezeline.session import materialise

ship(__name__)


def collision(distance: float, width: float) -> float:
    """Chance that one quantised projection of two points at a distance is equal."""
    c = width / distance
    normal = 0.5 * math.erfc(c / math.sqrt(2))
    return 1 - 2 * normal - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def tables_needed(least_cosine: float, projections: int, width: float, recall: float) -> int:
    """Tables after which a pair just at the bound is met in one with the given chance; closer pairs are surer."""
    distance = math.sqrt(max(1e-9, 2 - 2 * least_cosine))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - collision(distance, width) ** projections)))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow on the way."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _buckets(tables: int, projections: int, width: float, seed: int):
    """Bucket keys of every vector, one per table, as little-endian 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            keys: list[bytes] = [b""] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in set(sizes.tolist()):
                rows = np.flatnonzero(sizes == size)
                points = unit(np.array([vectors[r] for r in rows], np.float64))
                dice = np.random.default_rng([seed, size])
                lines = dice.standard_normal((size, tables * projections))
                shift = dice.random(tables * projections) * width
                cells = np.floor((points @ lines + shift) / width).astype(np.int64).astype(np.uint64)
                mix = np.full((len(rows), tables), size, np.uint64)
                for p in range(projections):
                    mix ^= cells[:, p::projections]
                    mix *= np.uint64(0x9E3779B97F4A7C15)
                    mix ^= mix >> np.uint64(29)
                for r, own in zip(rows.tolist(), mix):
                    keys[r] = own.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(keys, pa.binary())],
                names=["node", "label", "v", "keys"],
            )

    return run


def _checked(least_cosine: float):
    """Links found in each group of bucket members: weighted counts per vector, and a forest of the links.

    A pair is checked in the first table in which it meets only, so a link is counted once."""
    group = ["part", "label", "key", "lo", "hi"]

    def links(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        points = unit(np.array(rows["v"].to_list(), np.float64))
        keys = np.array([np.frombuffer(k, "<u8") for k in rows["keys"]])
        part = int(rows["part"].iloc[0])
        lo, hi = int(rows["lo"].iloc[0]), int(rows["hi"].iloc[0])
        chunk = rows["chunk"].to_numpy()
        left = np.flatnonzero(chunk == lo)
        right = left if lo == hi else np.flatnonzero(chunk == hi)
        near = points[left] @ points[right].T >= least_cosine - 1e-9
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        if lo == hi:
            a, b = a[a < b], b[a < b]
        exact = np.einsum("ij,ij->i", points[a], points[b]) >= least_cosine
        a, b = a[exact], b[exact]
        first = ~(keys[a, :part] == keys[b, :part]).any(1)
        return a[first], b[first]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, group):
            bounds = group_bounds(frame, group)
            out = []
            for start, stop in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if stop - start < 2:
                    continue
                rows = frame.iloc[start:stop]
                if len({len(v) for v in rows["v"]}) > 1:
                    sizes = rows["v"].map(len)
                    parts = [rows[sizes == s] for s in sorted(set(sizes))]
                else:
                    parts = [rows]
                for part in parts:
                    a, b = links(part)
                    if not len(a):
                        continue
                    n, nodes, weight = len(part), part["node"].to_numpy(), part["weight"].to_numpy()
                    count = np.zeros(n, np.int64)
                    np.add.at(count, a, weight[b])
                    np.add.at(count, b, weight[a])
                    met = np.flatnonzero(count)
                    root = local_roots(n, a, b)
                    out.append(pd.DataFrame({"node": nodes[met], "links": count[met], "root": nodes[root[met]]}))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def near_duplicates(
    vectors: DataFrame,
    least_cosine: float = 0.98,
    projections: int = 10,
    width: float = 1.2,
    recall: float = 0.995,
    chunk_rows: int = 512,
    seed: int = 17,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id (smallest vec_id reachable by links, itself included),
    kept (vec_id is component_id).

    Rows of equal label link at a cosine of ``least_cosine`` or more. Equal vectors of a label are one node with a
    weight, so copies never meet as pairs. Normalised vectors are hashed into as many tables as a pair just at the
    bound needs for ``recall`` (closer pairs are met almost surely); a table's key is ``projections`` quantised random
    projections. Buckets of one vector are dropped before any vector is shuffled; larger ones are dealt out in pairs
    of chunks of ``chunk_rows``, so no task holds a bucket. Every pair met is checked by its exact cosine once, in
    the first table in which it meets; counts and a forest of the links leave the task, pairs do not.

    Vectors that are null, all zero, or hold null or non-finite components, and rows without a label, link with
    nothing. Repeated rows are different vectors. A null id sorts last; vectors of different lengths never link."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col(vector_col)
    good = v.isNotNull() & F.col(label_col).isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    named = vectors.select(
        id_in(id_col).alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.cast("array<double>").alias("v"),
        F.coalesce(good, F.lit(False)).alias("good"),
    ).withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64(F.lit(1), "label", "v")})
    rows = materialise(named)
    same = rows.filter("good").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("v").alias("v")
    )
    # a node's number is its 64-bit hash; both hashes name it outside of the link table
    tables = tables_needed(least_cosine, projections, width, recall)
    classes = materialise(same.withColumn("node", F.col("h1")))
    hashed = classes.select("node", "label", "v").mapInArrow(
        _buckets(tables, projections, width, seed), "node long, label string, v array<double>, keys binary"
    )
    keyed = materialise(hashed.select("node", "label", "keys"))
    spots = F.sequence(F.lit(0), F.lit(tables - 1))
    posted = keyed.select("node", "label", "keys", F.explode(spots).alias("part")).select(
        "node", "label", "part", F.substring("keys", F.col("part") * 8 + 1, F.lit(8)).alias("key")
    )
    sizes = posted.groupBy("part", "label", "key").agg(F.count("*").alias("size")).filter("size > 1")
    chunks = F.ceil(F.col("size") / chunk_rows).cast("int")
    shared = posted.join(sizes, ["part", "label", "key"]).select(
        "part", "label", "key", "node", chunks.alias("chunks"),
        F.pmod(F.xxhash64(F.lit(5), "node"), chunks).cast("int").alias("chunk"),
    )
    full = classes.join(keyed.select("node", "keys"), "node").select("node", "weight", "v", "keys")
    met = shared.join(full, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = met.select("*", other.alias("other")).select(
        "part", "label", "key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
        "chunk", "node", "weight", "v", "keys",
    )
    order = ["part", "label", "key", "lo", "hi"]
    sorted_ = spread(dealt, *order).sortWithinPartitions(*order, "node")
    found = materialise(sorted_.mapInPandas(_checked(least_cosine), "node long, links long, root long"))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = classes.join(groups, "node", "left").select("node", "h1", "h2", "weight", "least", F.coalesce("root", "node").alias("root"))
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.join(low, "root").join(counts, "node", "left").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    out = rows.select("vec_id", "h1", "h2", "good").join(told.withColumn("good", F.lit(True)), ["h1", "h2", "good"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        id_out("vec_id").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != NULL_ID, component).alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
