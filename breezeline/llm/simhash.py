"""SimHash near-duplicates: fingerprints, and a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.llm.common import (
    NULL_ID,
    group_bounds,
    id_in,
    id_out,
    local_roots,
    ship,
    spread,
    whole_groups,
)
from breezeline.llm.components import components
from breezeline.session import materialise

ship(__name__)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: bytes | None, shingle_words: int) -> int:
    """64-bit SimHash of a text's word shingles as a signed long; zero for a text without words."""
    words = (text or b"").translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    k = min(shingle_words, n)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    one = xxhash.xxh64_intdigest
    h = np.fromiter(
        (one(joined[a:b], 42) for a, b in zip(starts[: n - k + 1].tolist(), ends[k - 1 :].tolist())),
        np.uint64,
        n - k + 1,
    )
    votes = np.zeros(64, np.int64)
    for part in range(0, len(h), 1 << 16):
        octets = h[part : part + (1 << 16)].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row. Words are split at ASCII white space and A-Z lower-cased; a text of fewer words
    than a shingle is one shingle; null, empty or blank texts have fingerprint 0. Whole texts are read."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle_words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    narrow = docs.select(id_in(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("t"))
    return narrow.mapInArrow(marks, "doc_id long, fp long")


def index_keys(max_bits: int) -> list[tuple[int, ...]]:
    """Sets of byte positions such that two fingerprints at most ``max_bits`` apart agree on one set at least.

    The eight positions are cut into max_bits + 2 blocks; at most max_bits blocks differ, so some two blocks agree."""
    if not 0 <= max_bits <= 6:
        raise ValueError("max_bits must be from 0 to 6")
    blocks = [tuple(int(p) for p in x) for x in np.array_split(np.arange(8), max_bits + 2)]
    return [x + y for x, y in combinations(blocks, 2)]


def near_links(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of near fingerprints: tally equal positional bytes, keep pairs with the guaranteed count, verify."""
    found_a, found_b = [], []
    octets = fps.view(np.uint8).reshape(-1, 8)
    step = max(1, (1 << 20) // max(1, len(fps)))
    for lo in range(0, len(fps), step):
        hi = min(lo + step, len(fps))
        shared = np.zeros((hi - lo, len(fps) - lo), np.uint8)
        for p in range(8):
            shared += octets[lo:hi, p, None] == octets[None, lo:, p]
        a, b = np.nonzero(shared >= 8 - max_bits)
        a, b = a[b > a] + lo, b[b > a] + lo
        near = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        found_a.append(a[near])
        found_b.append(b[near])
    return np.concatenate(found_a), np.concatenate(found_b)


def _bucket_links(max_bits: int):
    """Links inside each bucket, as a forest: every fingerprint to the first one of its local group."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, ["part", "key"]):
            fps = frame["fp"].to_numpy().astype(np.int64).view(np.uint64)
            bounds = group_bounds(frame, ["part", "key"])
            out_a, out_b = [], []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                own = fps[lo:hi]
                if hi - lo == 2:
                    near = int(own[0] ^ own[1]).bit_count() <= max_bits
                    root = np.array([0, 0 if near else 1])
                else:
                    a, b = near_links(own, max_bits)
                    root = local_roots(hi - lo, a, b)
                moved = np.flatnonzero(root != np.arange(hi - lo))
                out_a.append(own[moved])
                out_b.append(own[root[moved]])
            yield pd.DataFrame(
                {"a": np.concatenate(out_a).view(np.int64), "b": np.concatenate(out_b).view(np.int64)}
            )

    return run


def _octet(p: int):
    return F.shiftrightunsigned(F.col("fp"), 8 * p).bitwiseAND(F.lit(255))


def _key(positions: tuple[int, ...]):
    key = F.lit(0).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_octet(p))
    return key


def _postings(rows: DataFrame, sets: list[tuple[int, ...]], keep: list[str]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("part"), _key(s).alias("key")) for i, s in enumerate(sets)])
    return rows.select("fp", *keep, F.explode(each).alias("p")).select("fp", *keep, "p.part", "p.key")


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 3,
    max_bits: int = 2,
    bucket_rows: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links
    of at most ``max_bits`` differing bits, itself included).

    Equal fingerprints are one node from the start, so copies never form pairs. Distinct fingerprints are posted under
    sets of byte positions (for 2 bits six sets of four bytes: a near pair must agree on one). Within a posting list
    the shared positional bytes are tallied per pair, pairs below 8 - max_bits are dropped and the rest verified; a
    list gives back a forest, not its pairs. A list above ``bucket_rows`` is dealt again by two more of its free bytes,
    which such a pair must also share for up to 2 bits of difference; it then holds at most 65,536 fingerprints. (Above
    2 bits the keys are shorter and lists are not dealt again.)

    Null, empty and blank texts have fingerprint 0 and link like any other. Repeated rows give repeated results. Null
    ids count as one id that sorts last and come back as null. Extra columns are not carried; join by doc_id."""
    marked = materialise(fingerprints(docs, shingle_words, id_col, text_col))
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    sets = index_keys(max_bits)
    posted = _postings(nodes, sets, [])
    sizes = posted.groupBy("part", "key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialise(posted.join(sizes, ["part", "key"]))
    small = shared.filter(F.col("size") <= bucket_rows).select("part", "key", "fp")
    if max_bits <= 2:
        finer, base = [], []
        for i, s in enumerate(sets):
            free = [p for p in range(8) if p not in s]
            # free bytes hold every difference: all but max_bits of them agree
            take = max(0, len(free) - max_bits)
            wide = [s + c for c in combinations(free, take)]
            base.append((i, len(finer), len(wide)))
            finer += wide
        large = shared.filter(F.col("size") > bucket_rows).select("part", "fp")
        again = None
        for i, first, many in base:
            own = _postings(large.filter(F.col("part") == i), finer[first : first + many], [])
            own = own.select((F.col("part") + F.lit(len(sets) + first)).alias("part"), "key", "fp")
            again = own if again is None else again.unionAll(own)
        small = small.unionAll(again)
    else:
        small = shared.select("part", "key", "fp")
    links = spread(small, "part", "key").sortWithinPartitions("part", "key", "fp")
    found = links.mapInPandas(_bucket_links(max_bits), "a long, b long")
    groups = components(found).withColumnRenamed("node", "fp")
    rooted = nodes.join(groups, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        id_out("doc_id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        id_out("component_id").alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2) -> DataFrame:
    """All columns of one row of each group, that with the smallest doc_id. Of rows that share this id, the one with
    the lowest text hash stays (rows equal in id and text: any one of them)."""
    groups = near_duplicates(docs, shingle_words, max_bits)
    heads = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("_head")
    )
    rows = docs.select(id_in("doc_id").alias("_head"), F.struct("*").alias("_row"), F.xxhash64("text").alias("_mark"))
    kept = rows.join(heads.distinct(), "_head", "left_semi")
    return kept.groupBy("_head").agg(F.min_by("_row", "_mark").alias("_row")).select("_row.*")
