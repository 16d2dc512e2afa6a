"""Language identification by words first, backing off to ever shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from breezeline.llm.common import ship, sent_by_value
from breezeline.session import materialise

ship(__name__)

_CACHED_WORDS = 1 << 16  # words whose values a Python worker keeps at hand
_WORD = re.compile(r"[^\W\d_]+")  # letters, but also number signs such as fractions and raised digits
_EDGE = re.compile(r"[\W\d_]")
WORD = 0  # order of whole words in the count table; n-grams have their length


def _letters(words: list[str]) -> list[str]:
    """The words cut at number signs; nearly all have none."""
    if all(map(str.isalpha, words)):
        return words
    return [part for w in words for part in ("".join(c if c.isalpha() else " " for c in w).split() if not w.isalpha() else (w,))]


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return _letters(_WORD.findall(text.lower()))


def word_parts(text: str, chars: int = 1 << 16) -> Iterator[list[str]]:
    """The words of a text in lists of about ``chars`` characters, cut between words, so that a very long text is
    never a list of all its words."""
    text, start = text.lower(), 0
    while start < len(text):
        edge = _EDGE.search(text, start + chars)
        stop = edge.start() if edge else len(text)
        yield _letters(_WORD.findall(text, start, stop))
        start = stop


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word between two spaces."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _rows(counts: Counter) -> pa.RecordBatch:
    langs, kinds, grams = zip(*counts) if counts else ((), (), ())
    columns = [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(grams, pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names=["lang", "n", "gram", "c"])


def _word_counts(flush: int = 100_000):
    """Counts of the words of each task's texts; handed on whenever there are ``flush`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang = lang.as_py()
                seen: Counter = Counter()
                for part in word_parts(text.as_py()):
                    seen.update(part)
                for word, c in seen.items():
                    counts[lang, WORD, word] += c
                if len(counts) >= flush:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)

    return run


def _gram_counts(orders: int, flush: int = 100_000):
    """Counts of the n-grams of words, each word taken once with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for lang, word, c in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for n in range(1, orders + 1):
                    for gram in grams_of(word, n):
                        counts[lang, n, gram] += c
                if len(counts) >= flush:
                    yield _rows(counts)
                    counts = Counter()
        yield _rows(counts)

    return run


class LanguageModel:
    """Negative log10 relative frequencies of words and n-grams per language, and the words scored so far."""

    def __init__(self, languages: list[str], counts: list[tuple[str, int, str, int]], totals: dict, orders: int, penalty: float):
        self.languages, self.orders, self.penalty = languages, orders, penalty
        at = {lang: i for i, lang in enumerate(languages)}
        self.rows: list[dict[str, int]] = [{} for _ in range(orders + 1)]
        seen = [(at[lang], n, gram, c / totals[lang, n]) for lang, n, gram, c in counts]
        for _, n, gram, _ in seen:
            self.rows[n].setdefault(gram, len(self.rows[n]))
        self.tables = [np.full((len(r), len(languages)), penalty) for r in self.rows]
        for lang, n, gram, share in seen:
            self.tables[n][self.rows[n][gram], lang] = min(penalty, -np.log10(share))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.empty((1024, len(self.languages)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "values")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.forget()

    def word_value(self, word: str) -> np.ndarray:
        """A known word's values; else the mean over its known n-grams of the greatest length that has any."""
        row = self.rows[WORD].get(word)
        if row is not None:
            return self.tables[WORD][row]
        for n in range(self.orders, 0, -1):
            rows = [r for g in grams_of(word, n) if (r := self.rows[n].get(g)) is not None]
            if rows:
                return self.tables[n][rows].mean(0)
        return np.full(len(self.languages), self.penalty)

    def index(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            at = len(self.known)
            if at == len(self.values):
                self.values = np.concatenate([self.values, np.empty_like(self.values)])
            self.values[at] = self.word_value(word)
            self.known[word] = at
        return at

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of least mean value (ties: the first by name) and its posterior; ``und`` without letters."""
        total, n = np.zeros(len(self.languages)), 0
        for words in word_parts(text or ""):
            if len(self.known) > _CACHED_WORDS:
                self.forget()
            rows = list(map(self.index, words))  # may move self.values
            total += self.values[rows].sum(0)
            n += len(words)
        if not n or not self.languages:
            return "und", 0.0
        best = int(np.argmin(total))
        return self.languages[best], float(1 / np.exp(-np.log(10) * np.minimum(total - total[best], 300)).sum())


def fit(
    docs: DataFrame,
    sample_rows: int = 20_000,
    model_entries: int = 400_000,
    orders: int = 5,
    penalty: float = 7.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> LanguageModel:
    """A model of the labelled rows (null languages and texts are left out), of bounded size.

    Two bounds: about ``sample_rows`` rows are learned from, chosen by a hash of id and text (all of them if there are
    fewer), and about ``model_entries`` words and n-grams are kept, the same share for each language and length. The
    least count that keeps to the share is read off a histogram of counts, so nothing is sorted and ties at the edge
    fall together. Counting runs on the executors, n-grams once per distinct word; only the kept entries reach the
    driver."""
    text = F.col(text_col).cast("string")
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(F.col(id_col), text).alias("dice")
    )
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    share = min(1.0, sample_rows / max(1, labelled.count()))
    sample = labelled.filter(F.pmod(F.col("dice"), F.lit(1 << 20)) < int(share * (1 << 20)))
    kinds = "lang string, n int, gram string, c long"
    counted = sample.select("lang", "text").mapInArrow(_word_counts(), kinds)
    words = materialise(counted.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")))
    parts = words.select("lang", "gram", "c").mapInArrow(_gram_counts(orders), kinds)
    grams = materialise(words.unionByName(parts.groupBy("lang", "n", "gram").agg(F.sum("c").alias("c"))))
    totals = {(r.lang, r.n): r.t for r in grams.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}
    languages = sorted({lang for lang, _ in totals})
    room = max(1, model_entries // max(1, len(languages) * (orders + 1)))
    by_count = grams.groupBy("lang", "n", "c").agg(F.count("*").alias("many"))
    most_first = Window.partitionBy("lang", "n").orderBy(F.desc("c"))
    least = by_count.withColumn("sum", F.sum("many").over(most_first)).filter(F.col("sum") <= room)
    least = least.groupBy("lang", "n").agg(F.min("c").alias("least"))
    kept = grams.join(F.broadcast(least), ["lang", "n"]).filter("c >= least").select("lang", "n", "gram", "c")
    entries = [tuple(r) for r in kept.collect()]
    return LanguageModel(languages, entries, totals, orders, penalty)


def predictor(spark: SparkSession, model: LanguageModel) -> Callable[[Column], Column]:
    """A function of a text column giving a struct of lang_pred and score (0 to 1: the posterior of the prediction).

    Null texts and texts without letters are ``und`` with score 0. Whole texts are read; the broadcast model is
    bounded by ``model_entries`` of ``fit``."""
    shared = sent_by_value(spark, model)

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            model = shared()
            found = [model.predict(t) for t in part]
            yield pd.DataFrame(found, columns=["lang_pred", "score"])

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "lang_pred string, score double")
    return lambda text: udf(text.cast("string"))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the row is in the fold kept from learning, by the checksum of its id (a null id is never learned from)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def learn_and_predict(docs: DataFrame, folds: int = 4, fold: int = 2, **settings) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score, from a model of the rows that are not held out."""
    marked = docs.select("doc_id", "lang", "text", held_out("doc_id", folds, fold).alias("held_out"))
    guess = predictor(docs.sparkSession, fit(marked.filter(~F.col("held_out")), **settings))
    scored = marked.select("doc_id", "held_out", guess(F.col("text")).alias("p"))
    return scored.select("doc_id", "held_out", "p.lang_pred", "p.score")


def with_known_language(docs: DataFrame, least_score: float = 0.5, folds: int = 4, fold: int = 2) -> DataFrame:
    """The rows, with all columns, whose text is in one of the learned languages with a score of ``least_score`` or
    more; texts without letters go."""
    learned = docs.filter(~held_out("doc_id", folds, fold)).select("doc_id", "lang", "text")
    guess = predictor(docs.sparkSession, fit(learned))
    scored = docs.select(F.struct("*").alias("row")).select("row", guess(F.col("row.text")).alias("p"))
    return scored.filter((F.col("p.lang_pred") != "und") & (F.col("p.score") >= least_score)).select("row.*")
