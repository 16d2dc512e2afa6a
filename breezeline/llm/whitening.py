"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its triangular factor.

Sums and scatter are gathered by Spark in two passes over the distinct vectors; only they, one number per pair of
dimensions, reach the driver. The factorisation is of that small matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.llm.common import id_in, id_out, ship, spread
from breezeline.session import materialise

ship(__name__)

OUT = (
    "vec_id long, component int, n long, deviation long, deviation_digits string, whitened double, explained double, "
    "identity_error double"
)


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """A factor L of as many columns as the matrix has rank, with matrix = L L^T. Its rows, taken in the order of the
    pivots (each time the largest diagonal entry left), are triangular."""
    rest, columns = np.array(matrix, dtype=float), []
    size = len(rest)
    floor = size * np.finfo(float).eps * max(0.0, *np.diag(rest)) if size else 0.0
    left = np.ones(size, bool)
    for _ in range(size):
        pivot = int(np.argmax(np.where(left, np.diag(rest), -np.inf)))
        top = rest[pivot, pivot]
        if not top > floor:
            break
        column = np.where(left, rest[:, pivot], 0.0) / np.sqrt(top)
        rest -= np.outer(column, column)
        left[pivot] = False
        columns.append(column)
    return np.stack(columns, 1) if columns else np.zeros((size, 0))


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (as columns) of L L^T: the columns of L are rotated in pairs until
    all are orthogonal; squared norms are the eigenvalues, normalised columns the vectors. A round rotates disjoint
    pairs together, and the rounds of a sweep meet every pair once."""
    g = np.array(factor, dtype=float)
    rank = g.shape[1]
    seats = list(range(rank)) + [-1] * (rank % 2)
    half = len(seats) // 2
    for _ in range(sweeps):
        moved = False
        for _ in range(len(seats) - 1):
            pairs = [(a, b) for a, b in zip(seats[:half], seats[: half - 1 : -1]) if a >= 0 and b >= 0]
            seats = [seats[0], seats[-1], *seats[1:-1]]
            if not pairs:
                continue
            p, q = (np.array(x, int) for x in zip(*pairs))
            alpha, beta, gamma = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            turn = np.abs(gamma) > 2 * np.finfo(float).eps * np.sqrt(alpha * beta)
            if not turn.any():
                continue
            moved = True
            p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
            zeta = (beta - alpha) / (2 * gamma)
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * g[:, p] - s * g[:, q], s * g[:, p] + c * g[:, q]
        if not moved:
            break
    norms = np.sqrt((g**2).sum(0))
    order = np.argsort(-norms, kind="stable")
    return norms[order] ** 2, g[:, order] / norms[order]


def whole_components(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x array<long>) of every usable vector: floor(scale * component). A whole component beyond 64 bits
    is an error, since no long can stand for it."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col(vector_col).isNotNull() & F.forall(vector_col, finite)
    scaled = lambda x: x.cast("double") * scale
    beyond = F.raise_error(F.lit("a whole component does not fit 64 bits")).cast("long")
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**63, F.floor(scaled(x))).otherwise(beyond)
    return vectors.filter(good).select(id_in(id_col).alias("vec_id"), F.transform(vector_col, whole).alias("x"))


def _numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits where all fits, else in Python's integers."""
    most = n * max(int(x.max(initial=0)), -int(x.min(initial=0))) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["x"].to_list()).astype(np.int64)


def _sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Exact sums of a task, by dimension, as digits; dimension -1 has the number of vectors."""
    total, n = None, 0
    for frame in frames:
        if frame.empty:
            continue
        x = _stacked(frame)
        part = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
        total, n = part if total is None else total + part, n + len(x)
    if n:
        digits = [str(n), *map(str, total)]
        yield pd.DataFrame({"dim": np.arange(-1, len(digits) - 1), "total": digits})


def _scatter(n: int, sums: list[int]):
    """Scatter of a task's centred vectors, a row per dimension."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(sums), len(sums)))
        seen = False
        for frame in frames:
            if frame.empty:
                continue
            centred = _numerators(_stacked(frame), n, sums).astype(float) / n
            total += centred.T @ centred
            seen = True
        if seen:
            yield pd.DataFrame({"dim": np.arange(len(sums)), "part": list(total)})

    return run


def _added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the rows of each dimension, added as they come."""
    total: dict[int, np.ndarray] = {}
    for frame in frames:
        for dim, part in zip(frame["dim"].tolist(), frame["part"]):
            total[dim] = total[dim] + part if dim in total else np.array(part)
    if total:
        yield pd.DataFrame({"dim": list(total), "part": list(total.values())})


def _projected(n: int, sums: list[int], scaled: np.ndarray):
    """Deviation and whitened values of every vector."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            tops = _numerators(_stacked(frame), n, sums)
            most = max(int(tops.max(initial=0)), -int(tops.min(initial=0)))
            if tops.dtype != object and most * most * len(sums) >= 2**63:
                tops = tops.astype(object)
            digits = [str(d) for d in (tops * tops).sum(1)]
            values = (tops.astype(float) / n) @ scaled
            out = {"deviation_digits": digits, "values": list(values)}
            yield pd.DataFrame({**({"vec_id": frame["vec_id"]} if "vec_id" in frame else {}), **out})

    return run


def whiten(
    vectors: DataFrame,
    components: int = 4,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per usable vector and component: vec_id, component (from 1, by falling eigenvalue), n (distinct
    vectors), deviation (sum over dimensions of (n * x - S)^2, null where it does not fit a long), deviation_digits
    (the same, always exact), whitened, explained (share of the trace), identity_error (largest absolute entry of the
    whitened covariance less the identity, measured over the distinct vectors).

    Vectors that are null or hold null or non-finite components are left out; a null id stays null; repeated rows give
    repeated rows but count once in the fit. A vector shorter than the longest counts as zero beyond its end. There
    are at most as many components as the covariance has rank, so one distinct vector, or an empty table, gives no
    rows. Of equal eigenvalues any orthonormal vectors are right; the largest entry of a component is positive.

    The driver holds the scatter, so memory there follows the square of the vectors' width, not their number."""
    spark = vectors.sparkSession
    usable = whole_components(vectors, scale, id_col, vector_col)
    width = usable.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return spark.createDataFrame([], OUT)
    whole = usable.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("x"))))
    fit = materialise(whole.select("x").distinct())
    parts = fit.mapInPandas(_sums, "dim int, total string")
    totals = parts.groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    told = {dim: int(total) for dim, total in totals.collect()}
    n, sums = told[-1], [told[dim] for dim in range(width)]
    rows = fit.mapInPandas(_scatter(n, sums), "dim int, part array<double>")
    scatter = np.zeros((width, width))
    for dim, part in spread(rows, "dim").mapInPandas(_added, "dim int, part array<double>").collect():
        scatter[dim] = part
    covariance = (scatter + scatter.T) / (2 * n)
    values, units = jacobi_columns(pivoted_cholesky(covariance))
    kept = min(components, len(values))
    if not kept:
        return spark.createDataFrame([], OUT)
    units = units[:, :kept] * np.where(units[np.abs(units).argmax(0), range(units.shape[1])] < 0, -1.0, 1.0)[:kept]
    scaled = units / np.sqrt(values[:kept])
    shares = [float(v / np.trace(covariance)) for v in values[:kept]]
    told_of = "deviation_digits string, values array<double>"
    fitted = fit.mapInPandas(_projected(n, sums, scaled), told_of)
    pairs = [(i, j) for i in range(kept) for j in range(i, kept)]
    measured = fitted.agg(*[F.covar_pop(F.col("values")[i], F.col("values")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(measured[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    done = whole.mapInPandas(_projected(n, sums, scaled), f"vec_id long, {told_of}")
    each = done.select("vec_id", "deviation_digits", F.posexplode("values").alias("at", "whitened"))
    return each.select(
        id_out("vec_id").alias("vec_id"),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.expr("try_cast(deviation_digits AS bigint)").alias("deviation"),
        "deviation_digits",
        "whitened",
        F.element_at(F.array(*map(F.lit, shares)), F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
