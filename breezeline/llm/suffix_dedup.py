"""Exact removal of repeated byte strings by bounded interval expansion on a Burrows-Wheeler transform.

A corpus has no single suffix array here. Every window of ``least`` bytes is named by the smallest hash of its inner
strings of ``anchor`` bytes, so equal windows have equal names wherever they stand, and neighbouring windows mostly
share one: a document falls into pieces, runs of windows with one anchor. Pieces meet by anchor. Equal pieces are one;
different pieces of one anchor are laid into blocks of text, and in each block breadth-first backward extension on the
transform finds which windows are equal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breezeline.llm.common import id_in, id_out, ship, spread
from breezeline.session import materialise

ship(__name__)

_START_BITS = 40  # of a place: the start; the bits above it hold part of a second hash of the text
_CHUNK = 1 << 23  # windows looked at together; positions then fit the low 24 bits of a key
_EVEN = np.uint64(0x9E3779B97F4A7C15)


# Common prefixes of one block.


def _ranks(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    own = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], own[1:] != own[:-1]]))
    return rank


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix numbers of a text of whole numbers below 512, ordered by ``depth`` symbols at least (ties in any order)."""
    n = len(text)
    key, width = np.zeros(n, np.int64), 7
    for at in range(width):
        key[: n - at] |= text[at:] << 9 * (width - 1 - at)
    order = np.argsort(key)
    rank = _ranks(key, order)
    while width < depth:
        after = np.full(n, -1, np.int64)
        after[: max(0, n - width)] = rank[width:]
        key = (rank << 32) + after + 1
        order = np.argsort(key)
        rank, width = _ranks(key, order), width * 2
    return order


def prefix_starts(text: np.ndarray, order: np.ndarray, least: int) -> np.ndarray:
    """Whether a suffix, in suffix order, shares fewer than ``least`` symbols with the one before it.

    The intervals of all strings of length 0, 1, 2, ... are extended backwards by every symbol before them. Where the
    interval of a longer string ends at a place with no common-prefix value yet, that value is the length reached, and
    the interval is taken to the next round; values so come by increasing size, and after round ``least`` - 1 the
    places without one have longer common prefixes."""
    n = len(text)
    before = text[order - 1]  # the transform; the symbol before the first is the last
    step = np.empty(n, np.int64)
    step[np.argsort(before.astype(np.int16), kind="stable")] = np.arange(n)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.array([0]), np.array([n])
    owner = np.full(n, -1, np.int64)
    for _ in range(least):
        sizes = high - low
        if not len(sizes):
            break
        inside = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        place = step[inside]
        # extensions of an interval by one symbol are neighbours among the places
        owner[place] = np.repeat(np.arange(len(low)), sizes) * 512 + before[inside]
        touched = np.sort(place) if len(place) * 16 < n else np.flatnonzero(owner >= 0)
        names = owner[touched]
        owner[touched] = -1
        first = np.concatenate([[True], (names[1:] != names[:-1]) | (touched[1:] != touched[:-1] + 1)])
        at = np.flatnonzero(first)
        new_low = touched[at]
        new_high = touched[np.append(at[1:], len(touched)) - 1] + 1
        open_ = ~known[new_high]
        low, high = new_low[open_], new_high[open_]
        known[high] = True
    return known[:n]


def repeated_windows(pieces: list[bytes], least: int) -> np.ndarray:
    """For a list of pieces in text order: which windows of their concatenation also start earlier in it.

    The result has one flag per symbol of the pieces joined by a separator each; windows never hold a separator."""
    sizes = np.array([len(p) for p in pieces])
    text = np.zeros(int(sizes.sum() + len(pieces)), np.int64)
    ends = np.cumsum(sizes + 1)
    body = np.ones(len(text), bool)
    body[ends - 1] = False
    text[body] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + 1
    order = sorted_suffixes(text, least)
    group = np.empty(len(text), np.int64)
    group[order] = np.cumsum(prefix_starts(text, order, least)) - 1
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(text))
    starts = np.flatnonzero(left >= least)
    first = np.full(len(text), len(text), np.int64)
    np.minimum.at(first, group[starts], starts)
    out = np.zeros(len(text), bool)
    out[starts] = starts > first[group[starts]]
    return out


# Pieces of documents.


def cut(data: bytes, least: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of every piece of a text."""
    parts = []
    windows = len(data) - least + 1
    for lo in range(0, windows, _CHUNK):
        hi = min(windows, lo + _CHUNK)
        own = np.frombuffer(data, np.uint8)[lo : hi + least - 1]
        grams = len(own) - anchor + 1
        eight = np.ndarray((len(own) - 7,), "<u8", own.tobytes(), strides=(1,))
        h = np.full(grams, anchor, np.uint64)
        for at in [*range(0, anchor - 7, 8), *([anchor - 8] if anchor % 8 else [])]:
            h ^= eight[at : at + grams]
            h *= _EVEN
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        key = (h & ~np.uint64(0xFFFFFF)) | np.arange(grams, dtype=np.uint64)
        span, width = least - anchor + 1, 1
        low = key
        while width * 2 <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
        where = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
        parts.append((h[where[first]].view(np.int64), first + lo, np.diff(np.append(first, hi - lo))))
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pieces(least: int, anchor: int, heavy, flush: int = 1_000_000):
    """Pieces of each task's documents, equal ones of a task told apart from the first (``again``) before they travel.

    Pieces of heavy anchors, which very many different pieces share, are cut into single windows, each its own
    anchor, so that such an anchor has no group of its own."""
    names = ["anchor", "content", "id", "mark", "place", "span", "again"]

    def rows(kept: list[tuple]) -> Iterator[pa.RecordBatch]:
        anchors, contents, ids, marks, places, spans = (np.concatenate(x) for x in zip(*kept))
        order = np.lexsort((places, marks, ids, contents, anchors))
        anchors, contents, ids, marks, places, spans = (x[order] for x in (anchors, contents, ids, marks, places, spans))
        again = np.concatenate([[False], (anchors[1:] == anchors[:-1]) & (contents[1:] == contents[:-1])])
        again[1:] &= (ids[1:] != ids[:-1]) | (marks[1:] != marks[:-1]) | (places[1:] != places[:-1])
        alone = (contents.view(np.uint64) + ids.view(np.uint64) * _EVEN) ^ (places.view(np.uint64) * _EVEN)
        anchors = np.where(again, alone.view(np.int64), anchors)
        for lo in range(0, len(anchors), 1 << 17):
            part = [pa.array(x[lo : lo + (1 << 17)]) for x in (anchors, contents, ids, marks, places, spans.astype(np.int32), again)]
            yield pa.RecordBatch.from_arrays(part, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        count = 0
        hashed, known = xxhash.xxh3_64_intdigest, heavy.value if heavy is not None else np.empty(0, np.int64)
        for batch in batches:
            for doc, mark, head, cell in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = cell.as_py()
                if len(data) < least:
                    continue
                anchors, starts, spans = cut(data, least, anchor)
                if len(known):
                    anchors, starts, spans = _unfolded(data, anchors, starts, spans, known, least)
                ends = (starts + spans + (least - 1)).tolist()
                contents = np.fromiter(
                    (hashed(data[a:b], 1) for a, b in zip(starts.tolist(), ends)), np.uint64, len(starts)
                )
                kept.append((anchors, contents.view(np.int64), *(np.full(len(starts), x) for x in (doc, mark)), starts + head, spans))
                count += len(starts)
                if count >= flush:
                    yield from rows(kept)
                    kept, count = [], 0
        if kept:
            yield from rows(kept)

    return run


def _unfolded(data, anchors, starts, spans, known, least):
    """Pieces of known anchors as single windows, named by their whole content."""
    hot = np.isin(anchors, known)
    if not hot.any():
        return anchors, starts, spans
    each = np.concatenate([np.arange(a, a + n) for a, n in zip(starts[hot], spans[hot])])
    names = np.fromiter((xxhash.xxh3_64_intdigest(data[a : a + least]) for a in each.tolist()), np.uint64, len(each))
    return (
        np.concatenate([anchors[~hot], names.view(np.int64)]),
        np.concatenate([starts[~hot], each]),
        np.concatenate([spans[~hot], np.ones(len(each), np.int64)]),
    )


def _sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only between anchors."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        edges = np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1
        if held and held[-1][0][-1] != cols[0][0]:
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        if len(edges):
            held.append([c[: edges[-1]] for c in cols])
            yield [np.concatenate(x) for x in zip(*held)]
            held = []
        held.append([c[edges[-1] if len(edges) else 0 :] for c in cols])
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pieces sorted by anchor, content and place: those that repeat an earlier equal piece (``kind`` 0), and those
    first of their content that share an anchor with other contents (1). All others hold no repeated window."""
    for anchor, content, doc, mark, place, span, again in _sorted_groups(batches):
        same_anchor = np.concatenate([[False], anchor[1:] == anchor[:-1]])
        same = np.concatenate([[False], content[1:] == content[:-1]]) & same_anchor
        # rows equal in id and text are one document: its copies are first wherever it is
        lead = np.flatnonzero(~same)
        lead = lead[np.cumsum(~same) - 1]
        twin = same & (doc == doc[lead]) & (mark == mark[lead]) & (place == place[lead])
        repeat = (same & ~twin) | again
        group = np.cumsum(~same_anchor) - 1
        contents = np.bincount(group, weights=~same)[group]
        first = ~same & ~again & (contents > 1)
        keep = repeat | first
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[keep]) for x in (doc, mark, place, span, anchor, np.where(repeat, 0, 1).astype(np.int32))],
            names=["id", "mark", "place", "span", "anchor", "kind"],
        )


def _texts(least: int):
    """The bytes of every piece that has to be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc, mark, packed, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack.decompress(packed)
                for piece in wanted:
                    start = piece["place"] & ((1 << _START_BITS) - 1)
                    out.append((piece["anchor"], doc, mark, piece["place"], data[start : start + piece["span"] + least - 1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 5, _TEXT_KINDS)],
                names=["anchor", "id", "mark", "place", "piece"],
            )

    return run


_TEXT_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def _compared(least: int, block_bytes: int):
    """Repeated windows among pieces of equal anchors, found block by block; a block holds whole anchor groups."""

    def block(frames: list[pd.DataFrame]) -> pd.DataFrame:
        rows = pd.concat(frames, ignore_index=True)
        rows = rows.drop_duplicates(["anchor", "id", "mark", "place"]).sort_values(["id", "mark", "place"], kind="stable")
        flags = repeated_windows(rows["piece"].to_list(), least)
        change = np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))
        lo, hi = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        sizes = rows["piece"].map(len).to_numpy() + 1
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        piece = np.searchsorted(begin, lo, "right") - 1
        place = rows["place"].to_numpy()[piece] + (lo - begin[piece])
        owner = {name: rows[name].to_numpy()[piece] for name in ("id", "mark")}
        return pd.DataFrame({**owner, "place": place, "span": (hi - lo).astype(np.int32)})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for frame in _whole(frames):
            group = np.flatnonzero(np.append(frame["anchor"].to_numpy()[1:] != frame["anchor"].to_numpy()[:-1], True)) + 1
            filled = frame["piece"].map(len).cumsum().to_numpy()
            start = 0
            for stop in group.tolist():
                if size + filled[stop - 1] - (filled[start - 1] if start else 0) >= block_bytes:
                    held.append(frame.iloc[start:stop])
                    yield block(held)
                    held, size, start = [], 0, stop
            if start < len(frame):
                held.append(frame.iloc[start:])
                size += int(filled[-1] - (filled[start - 1] if start else 0))
        if held:
            yield block(held)

    def _whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            if frame.empty:
                continue
            frame = frame if last is None else pd.concat([last, frame], ignore_index=True)
            names = frame["anchor"].to_numpy()
            tail = int(np.flatnonzero(np.append(True, names[1:] != names[:-1]))[-1])
            if tail:
                yield frame.iloc[:tail].reset_index(drop=True)
            last = frame.iloc[tail:]
        if last is not None:
            yield last.reset_index(drop=True)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed before they are shuffled."""
    for batch in batches:
        pack = zstandard.ZstdCompressor(3)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array([pack.compress(t.as_py()) for t in batch.column(3)], pa.binary())],
            names=["id", "mark", "head", "packed"],
        )


def _removed(least: int):
    """Documents without their covered bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            for doc, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
                data = unpack.decompress(packed)
                change = np.zeros(len(data) + 1, np.int64)
                for r in runs or []:
                    start = r["place"] & ((1 << _START_BITS) - 1)
                    change[start] += 1
                    change[start + r["span"] + least - 1] -= 1
                gone = np.cumsum(change[:-1]) > 0
                spans = int((np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1).sum())
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes() if spans else data
                out.append((doc, len(data), len(data) - len(kept), spans, kept))
                size += len(kept)
                if size > 8 << 20:
                    yield _batch(out)
                    out, size = [], 0
            yield _batch(out)

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 4 + [pa.binary()]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    return run


def _heavy_anchors(texts: DataFrame, least: int, anchor: int, sample_rows: int, many: int):
    """Anchors that at least ``many`` different pieces of a sample share: a broadcast of a million at most (the most
    shared ones; the others only make their blocks larger)."""
    spark = texts.sparkSession
    share = min(1.0, max(sample_rows / max(1, texts.count()), 1 / 500))
    sample = texts.filter(F.pmod(F.xxhash64("id", "mark"), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = sample.mapInArrow(_pieces(least, anchor, None), _PIECE_KINDS).filter("NOT again")
    shared = found.groupBy("anchor").agg(F.count_distinct("content").alias("n")).filter(F.col("n") >= many)
    top = shared.orderBy(F.desc("n"), "anchor").limit(1_000_000).select("anchor").toPandas()
    return spark.sparkContext.broadcast(np.sort(top["anchor"].to_numpy().astype(np.int64)))


_PIECE_KINDS = "anchor long, content long, id long, mark long, place long, span int, again boolean"


def remove_repeats(
    docs: DataFrame,
    least: int = 100,
    anchor: int = 24,
    block_bytes: int = 1 << 20,
    sample_rows: int = 20_000,
    many: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (the remaining bytes).

    Texts are UTF-8 bytes. Every byte goes that is covered by a string of ``least`` bytes which also starts earlier: in
    a smaller doc_id, or in the same document at an earlier start. Strings are judged on the input, overlaps count,
    and no string crosses documents. ``anchor`` (8 to ``least``) is the length of the strings that name windows.

    An anchor that very many different pieces share (``many`` in a sample of ``sample_rows`` documents, or of one in
    500 where that is more) would be one large group; its pieces travel as single windows named by their content.
    Equal pieces of a task are one row. Only pieces that can hold a repeated window have their bytes shuffled.

    Null and empty texts have no bytes. Of rows that share a doc_id, different texts follow each other in the order of
    a hash, equal texts are one document and give the same result. Null ids sort last. An empty table gives no rows.
    Texts of one id are told apart by 86 bits of hashes. Equal pieces are known by their anchor and a 64-bit hash of
    their content, not compared byte by byte; different pieces of one anchor are compared as bytes.
    Texts may have up to 2^40 bytes. Extra columns are not carried."""
    if not 8 <= anchor <= least:
        raise ValueError("anchor must be from 8 to least")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    head = F.shiftleft(F.pmod(F.xxhash64(F.lit(1), text), F.lit(1 << 22)), _START_BITS)
    texts = docs.select(id_in(id_col).alias("id"), F.xxhash64(text).alias("mark"), head.alias("head"), text.alias("text"))
    heavy = _heavy_anchors(texts, least, anchor, sample_rows, many)
    pieces = texts.mapInArrow(_pieces(least, anchor, heavy), _PIECE_KINDS)
    met = spread(pieces, "anchor").sortWithinPartitions("anchor", "content", "id", "mark", "place")
    judged = materialise(met.mapInArrow(_judged, "id long, mark long, place long, span int, anchor long, kind int"))
    packed = texts.mapInArrow(_packed, "id long, mark long, head long, packed binary")
    own_head = F.shiftleft(F.shiftright("place", _START_BITS), _START_BITS).alias("head")
    document = ["id", "mark", "head"]
    wanted = judged.filter("kind = 1").groupBy("id", "mark", own_head).agg(F.collect_set(F.struct("anchor", "place", "span")).alias("wanted"))
    known = packed.join(wanted, document).select("id", "mark", "packed", "wanted")
    compared = known.mapInArrow(_texts(least), "anchor long, id long, mark long, place long, piece binary")
    dealt = spread(compared, "anchor").sortWithinPartitions("anchor", "id", "mark", "place")
    partly = materialise(dealt.mapInPandas(_compared(least, block_bytes), "id long, mark long, place long, span int"))
    runs = judged.filter("kind = 0").select("id", "mark", "place", "span").unionAll(partly)
    by_doc = runs.groupBy("id", "mark", own_head).agg(F.collect_set(F.struct("place", "span")).alias("runs"))
    joined = packed.join(by_doc, document, "left").select("id", "packed", "runs")
    done = joined.mapInArrow(_removed(least), "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(id_out("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
