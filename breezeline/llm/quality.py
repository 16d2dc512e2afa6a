"""Quality classifier: a linear hinge-loss model over n-gram indicators scaled by class log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm.common import sent_by_value, ship
from breezeline.session import materialise

ship(__name__)

_RECENT = 16
# byte -> class: space, lower, upper, digit, stop, other sign, part of a longer code point
_CLASS = bytes(
    32 if c in b" \t\n\r\x0b\x0c" else 97 if 97 <= c < 123 else 65 if 65 <= c < 91 else 48 if 48 <= c < 58
    else 46 if c in b".,;:'" else 120 if c >= 128 else 37 for c in range(256)
)


def features(text: str | None, bits: int) -> np.ndarray:
    """Distinct hashed n-grams of a text, ascending: byte 1- to 4-grams, and 1- to 4-grams of its words' shapes.

    A word's shape is its first, its last and its most telling sign classes, and whether it stood among the 16 words
    before; so runs of capitals, of signs and of repetition are n-grams like any other. A text without words has no
    feature."""
    data = (text or "").encode("utf-8", "surrogatepass")
    octets = np.frombuffer(data, np.uint8).astype(np.uint32)
    found = []
    gram = np.zeros(len(octets), np.uint32)
    for n in range(1, 5):
        if len(octets) < n:
            break
        gram = (gram[: len(octets) - n + 1] << 8) | octets[n - 1 :]
        found.append(_hashed(gram, n, bits))
    words = data.split()
    if words:
        shapes = np.fromiter(_shapes(words), np.uint32, len(words))
        gram = np.zeros(len(shapes), np.uint32)
        for n in range(1, 5):
            if len(shapes) < n:
                break
            gram = (gram[: len(shapes) - n + 1] << 8) | shapes[n - 1 :]
            found.append(_hashed(gram, 8 + n, bits))
    if not found:
        return np.empty(0, np.int64)
    marks = np.zeros(1 << bits, bool)
    for f in found:
        marks[f] = True
    return np.flatnonzero(marks)


def _shapes(words: list[bytes]) -> Iterator[int]:
    recent: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    order = {c: i for i, c in enumerate(b"aA0.x% ")}
    for i, word in enumerate(words):
        again = i - recent.get(word, -_RECENT - 1) <= _RECENT
        recent[word] = i
        shape = known.get(word)
        if shape is None:
            kinds = word.translate(_CLASS)
            inner = 1 if b"%" in kinds else 2 if kinds.isupper() and len(word) > 1 else 3 if b"0" in kinds else 0
            shape = known[word] = order[kinds[0]] * 32 + min(7, order[kinds[-1]]) * 4 + inner
        yield shape ^ (0x18 if again else 0)


def _hashed(gram: np.ndarray, kind: int, bits: int) -> np.ndarray:
    mixed = (gram ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0xC2B2AE35)
    return (mixed ^ (mixed >> np.uint32(16))) & np.uint32((1 << bits) - 1)


def _class_counts(bits: int):
    """How many texts of each class hold each feature, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << bits), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1)):
                y = label.as_py()
                rows[y] += 1
                counts[y, features(text.as_py(), bits)] += 1
        held = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(held, -1)), pa.array(np.append(counts[0, held], rows[0])),
             pa.array(np.append(counts[1, held], rows[1]))],
            names=["feature", "bad", "good"],
        )

    return run


def _features_of(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [features(t.as_py(), bits).astype("<u4").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.binary()), batch.column(2)], names=["label", "features", "dice"]
            )

    return run


def descend(sets: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float, rounds: int, seed: int):
    """Dual coordinate descent for the hinge loss: weights and bias of a linear model over scaled indicators.

    Every row's vector (ratios of its features, scaled to length 1, and a constant) has a dual value from 0 to
    ``cost``; one value at a time is set to its best, in a new random order each round."""
    rows = [(s, ratio[s] / max(1e-12, np.linalg.norm(ratio[s]))) for s in sets]
    norms = np.array([float(v @ v) + 1.0 for _, v in rows])
    share = np.array([cost * len(signs) / (2 * max(1, (signs == y).sum())) for y in signs])
    dual = np.zeros(len(rows))
    weights, bias = np.zeros(len(ratio)), 0.0
    dice = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in dice.permutation(len(rows)):
            at, v = rows[i]
            slope = signs[i] * (weights[at] @ v + bias) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), share[i])
            step = (new - dual[i]) * signs[i]
            if step:
                weights[at] += step * v
                bias += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3 * cost:
            break
    return weights, bias


class QualityModel:
    """Feature ratios, weights and bias, and the slope that turns margins into scores."""

    def __init__(self, bits: int, ratio: np.ndarray, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.bits, self.bias, self.slope, self.shift = bits, bias, slope, shift
        self.ratio, self.weights = ratio.astype(np.float64), (weights * ratio).astype(np.float64)

    def margin(self, at: np.ndarray) -> float:
        length = np.sqrt((self.ratio[at] ** 2).sum())
        return float(self.weights[at].sum() / max(1e-12, length) + self.bias)

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text, self.bits)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def fit(
    labelled: DataFrame,
    bits: int = 16,
    sample_rows: int = 4000,
    cost: float = 1.0,
    rounds: int = 30,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "label",
) -> QualityModel:
    """A model of the rows whose label is 0 or 1 (others are left out).

    The log-count ratios are counted over all labelled rows, on the executors, into 2^``bits`` hashed n-grams. The
    linear model is fitted on about ``sample_rows`` of them at most, half of each class where there are enough, chosen
    by a hash of id and text: that bound keeps the fit small at any size. The slope of the scores is then set on the
    same rows, so that 0.5 parts the classes. With rows of one class only, every score is that class's."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = labelled.filter(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("label"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("dice")
    )
    rows = materialise(rows)
    counted = rows.select("label", "text").mapInArrow(_class_counts(bits), "feature long, bad long, good long")
    table = counted.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).toPandas()
    seen = table[table.feature >= 0]
    per = {0: int(table.bad[table.feature < 0].sum()), 1: int(table.good[table.feature < 0].sum())}
    size = 1 << bits
    if not per[0] or not per[1]:
        sure = 20.0 if per[1] else -20.0 if per[0] else 0.0
        return QualityModel(bits, np.zeros(size), np.zeros(size), sure, 1.0, 0.0)
    bad, good = np.ones(size), np.ones(size)
    bad[seen.feature] += seen.bad
    good[seen.feature] += seen.good
    ratio = np.log(good / good.sum()) - np.log(bad / bad.sum())
    chance = {y: min(1.0, sample_rows / 2 / per[y]) for y in per}
    dice = F.pmod(F.col("dice"), F.lit(1 << 20))
    bound = F.when(F.col("label") == 1, int(chance[1] * (1 << 20))).otherwise(int(chance[0] * (1 << 20)))
    sample = rows.filter(dice < bound).mapInArrow(_features_of(bits), "label int, features binary, dice long")
    taken = sorted(sample.collect(), key=lambda r: (r.dice, r.label))
    sets = [np.frombuffer(r.features, "<u4").astype(np.int64) for r in taken]
    signs = np.array([2.0 * r.label - 1 for r in taken])
    weights, bias = descend(sets, signs, ratio, cost, rounds, seed)
    model = QualityModel(bits, ratio, weights, bias, 1.0, 0.0)
    margins = np.array([model.margin(s) for s in sets])
    model.slope, model.shift = _slope(margins, signs)
    return model


def _slope(margins: np.ndarray, signs: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope of a logistic curve through the origin's margin, by Newton steps on classes of equal weight."""
    weight = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum()))
    a, b = 1.0, 0.0
    goal = (signs > 0) * 0.98 + 0.01
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -60, 60)))
        gap, bend = weight * (p - goal), weight * p * (1 - p) + 1e-9
        h = np.array([[(bend * margins**2).sum() + 1e-6, (bend * margins).sum()], [(bend * margins).sum(), bend.sum()]])
        step = np.linalg.solve(h, np.array([(gap * margins).sum(), gap.sum()]))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return (float(a), float(b)) if a > 0 and np.isfinite(a + b) else (1.0, 0.0)


def scorer(spark: SparkSession, model: QualityModel) -> Callable[[Column], Column]:
    """A function of a text column giving its score (0 to 1, higher: label 1 likelier). Whole texts are read; null and
    empty texts are texts without features and get the score of the bias. The broadcast model has a fixed size."""
    shared = sent_by_value(spark, model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([shared().score(t) for t in part], dtype="float64")

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    udf = F.pandas_udf(run, "double")
    return lambda text: udf(text.cast("string"))


def held_out(id_col: str, folds: int = 3, fold: int = 1) -> Column:
    """Whether the row is in the fold kept from learning, by the checksum of its id (a null id is never learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def learn_and_score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", **settings) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from 0.5 on), from the labels of rows that are not held
    out. A document with several labels is learned from once per label; null labels teach nothing."""
    marked = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    # the same join at every size: labels grow with the documents
    known = labels.select("doc_id", F.col(label_col).alias("label")).filter("label IS NOT NULL").hint("merge")
    model = fit(marked.filter(~F.col("held_out")).join(known, "doc_id").select("doc_id", "text", "label"), **settings)
    score = scorer(docs.sparkSession, model)
    scored = marked.select("doc_id", "held_out", score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
