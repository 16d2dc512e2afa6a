"""Mixing sources to target weights with hash-threshold histograms: no sort, no per-document list anywhere."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.session import materialise

_BITS = 12  # hash bits read per histogram
MOST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def capped_targets(sizes: Mapping, weights: Mapping, most: float = 3.0) -> dict:
    """Share the total of ``sizes`` by weight; a target stops at ``most`` times its source's size and the excess is
    shared by weight among the others until none is above."""
    left, open_, out = float(sum(sizes.values())), dict(weights), {}
    while open_:
        whole = float(sum(open_.values()))
        over = [s for s, w in open_.items() if left * w / whole > most * sizes[s]]
        if not over:
            out |= {s: left * w / whole for s, w in open_.items()}
            break
        for s in over:
            out[s] = most * sizes[s]
            del open_[s]
        left = float(sum(sizes.values())) - sum(out.values())
    return out


def cycled_weights(sources, cycle=(5, 2, 1)) -> dict:
    """Weights dealt in turn to the sources by code point, null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass"))
    ordered += [None] * (None in sources)
    return {s: cycle[i % len(cycle)] for i, s in enumerate(ordered)}


def _prefix(depth: int) -> Column:
    """The top bits of the hash after ``depth`` histograms, as an unsigned number."""
    return F.shiftrightunsigned(F.col("hash"), 64 - _BITS * depth)


_CELL = "struct<cell: bigint, n: bigint, first: bigint, last: bigint>"


def mix(
    docs: DataFrame,
    weights=cycled_weights,
    most_repeats: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words the mix takes), copies (times the row is taken).

    ``weights`` maps the list of sources to their weights. Every row of a source is taken floor(target / size of the
    source) times, and those whose hash is below the source's threshold once more. To find the threshold, sizes are
    summed by (source, top 12 hash bits); the bucket in which the sum passes the rest of the target is the only one
    that is cut again, by its next 12 bits, until it holds one hash; the boundary hash is taken if that comes nearer.
    What passes the driver is one row per source, of at most 100,000 sources (checked; a mix is set by weights per
    source). A target is met within one hash's words.

    The hash is of id and text, so reruns agree and rows equal in both stand or fall together. Null and empty texts
    have size 0, null sources are one source. An empty table gives no rows. Extra columns are not carried."""
    narrow = _narrow(docs, id_col, text_col, source_col)
    return _with_copies(narrow, _thresholds(narrow, weights, most_repeats)).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def mixed_documents(docs: DataFrame, weights=cycled_weights, most_repeats: int = 3) -> DataFrame:
    """The mix itself: each row with all its columns, as many times as it is taken (0 to ``most_repeats``)."""
    limits = _thresholds(_narrow(docs, "doc_id", "text", "source"), weights, most_repeats)
    rows = docs.select(
        F.col("source").cast("string").alias("source"), F.xxhash64("doc_id", "text").alias("hash"), F.struct("*").alias("row")
    )
    taken = _with_copies(rows, limits).filter("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")


def _narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.xxhash64(F.col(id_col), F.col(text_col)).alias("hash"),
            word_count(F.col(text_col).cast("string")).alias("size"),
        )
    )


def _with_copies(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with (source, hash) and how often each is taken: a filter by threshold, nothing is sorted or shuffled."""
    order = lambda c: F.col(c).bitwiseXOR(F.lit(-(2**63)))  # noqa: E731  unsigned order as signed order
    once = F.when(F.col("edge").isNull(), F.col("inclusive")).otherwise(
        (order("hash") < order("edge")) | ((F.col("hash") == F.col("edge")) & F.col("inclusive"))
    )
    joined = rows.alias("d").join(limits.alias("c"), F.col("d.source").eqNullSafe(F.col("c.source")))
    return joined.withColumn("copies", F.col("full") + once.cast("int"))


def _thresholds(narrow: DataFrame, weights, most_repeats: int) -> DataFrame:
    """Per source: size, target, full repeats and the hash threshold of the repeat beyond them."""
    spark = narrow.sparkSession
    sums = narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(sums) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; group them first")
    sizes = {r.source: r.n for r in sums}
    targets = capped_targets(sizes, weights(list(sizes)), float(most_repeats))
    plan = {}  # source -> size, target, full repeats, words still wanted, boundary prefix, hash limit
    wanted = {}
    for s, n in sizes.items():
        full = min(most_repeats, int(targets[s] // n)) if n else 0
        plan[s] = [n, targets[s], full, None]
        if n and full < most_repeats:
            wanted[s] = (targets[s] - full * n, None)
    depth = 0
    while wanted:
        depth += 1
        rows = [(s, float(rest), prefix) for s, (rest, prefix) in wanted.items()]
        ask = F.broadcast(spark.createDataFrame(rows, "source string, rest double, prefix long"))
        match = F.col("d.source").eqNullSafe(F.col("a.source"))
        if depth > 1:
            match &= _prefix(depth - 1) == F.col("a.prefix")
        inside = narrow.alias("d").join(ask.alias("a"), match).select("d.source", "d.hash", "d.size", "a.rest")
        top = _prefix(depth) if _BITS * depth < 64 else F.col("hash")
        cells = inside.groupBy("source", "rest", top.alias("cell")).agg(
            F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last")
        )
        # at most 4096 cells per source; unsigned order of the prefix
        place = F.lpad(F.hex("cell"), 16, "0")
        ordered = F.sort_array(F.collect_list(F.struct(place.alias("place"), "cell", "n", "first", "last")))
        lists = cells.groupBy("source", "rest").agg(ordered.alias("c"))
        # running sum; keep the first cell that reaches the rest
        state = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(None).cast(_CELL).alias("hit"))

        def step(acc, x):
            reached = acc["hit"].isNull() & (acc["sum"] + x["n"] > F.col("rest"))
            return F.struct(
                F.when(acc["hit"].isNotNull() | reached, acc["sum"]).otherwise(acc["sum"] + x["n"]).alias("sum"),
                F.when(reached, F.struct(x["cell"].alias("cell"), x["n"].alias("n"), x["first"].alias("first"), x["last"].alias("last")))
                .otherwise(acc["hit"]).alias("hit"),
            )

        found = lists.select("source", "rest", F.aggregate("c", state, step).alias("r"))
        later = {}
        for r in found.collect():
            hit = r.r.hit
            if hit is None:
                plan[r.source][3] = "all"
            elif hit.first == hit.last:
                below = r.rest - r.r.sum
                plan[r.source][3] = (hit.first, 2 * below >= hit.n)
            else:
                later[r.source] = (r.rest - r.r.sum, hit.cell)
        wanted = later
    rows = []
    for s, (n, target, full, limit) in plan.items():
        edge, inclusive = limit if isinstance(limit, tuple) else (None, limit == "all")
        rows.append((s, n, float(target), full, edge, bool(inclusive)))
    kinds = "source string, source_size long, target double, full int, edge long, inclusive boolean"
    return F.broadcast(spark.createDataFrame(rows, kinds))
