"""Quality and language: held-out accuracy and odd texts."""

import random
import zlib

import numpy as np

from breezeline.llm import language, quality
from tests.llm.odd import documents, no_documents, prose, rows


def test_dual_descent_reaches_the_least_hinge_loss():
    dice = np.random.default_rng(2)
    sets = [np.flatnonzero(dice.random(30) < (0.5 + 0.2 * y)) for y in np.repeat([0, 1], 40)]
    signs = np.repeat([-1.0, 1.0], 40)
    ratio = dice.normal(1, 0.3, 30)
    w, b = quality.descend(sets, signs, ratio, 1.0, 400, 1)
    rows_ = np.zeros((80, 30))
    for i, s in enumerate(sets):
        rows_[i, s] = ratio[s] / np.linalg.norm(ratio[s])

    def loss(w, b):
        return 0.5 * (w @ w + b * b) + np.maximum(0, 1 - signs * (rows_ @ w + b)).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + dice.normal(0, 0.01, 30), b + dice.normal(0, 0.01)) > best - 1e-3


def test_features_are_indicators_of_whole_texts():
    a, b = quality.features("abc def " * 3, 14), quality.features("abc def " * 300, 14)
    assert set(a) <= set(b) or len(a) <= len(b)
    assert not len(quality.features("", 14)) and not len(quality.features(None, 14))
    long = quality.features("plain words here " * 5000 + "%%%$$$###", 14)
    assert set(quality.features("%%%$$$###", 14)[:3]) & set(long)


def labelled(spark, n=400):
    dice = random.Random(11)
    out = []
    for i in range(n):
        words = prose(dice, "en", dice.randrange(20, 80))
        bad = i % 4 == 0
        if bad and i % 8:
            words = words.upper().replace(" ", "!! ")
        elif bad:
            words = " ".join(w + dice.choice(["%%%", "$$$"]) for w in words.split())
        out.append((i, words, 0 if bad else 1))
    docs = spark.createDataFrame([(i, t) for i, t, _ in out] + [(9000, None), (9001, ""), (None, "x")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in out] + [(9000, None), (None, 1)], "doc_id long, quality int")


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.learn_and_score(docs, labels, bits=14).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    held = [i for i, r in got.items() if i is not None and i < 9000 and r.held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[9000].score == got[9001].score and got[None].held_out
    again = {r.doc_id: r.score for r in quality.learn_and_score(docs.repartition(5), labels, bits=14).collect()}
    assert all(abs(again[i] - r.score) < 1e-9 for i, r in got.items())


def test_quality_of_one_class_or_no_labels(spark):
    docs, labels = labelled(spark, 40)
    sure = quality.learn_and_score(docs, labels.filter("quality = 1"), bits=12).collect()
    assert all(r.predicted == 1 for r in sure)
    none = quality.learn_and_score(docs, labels.filter("quality = 7"), bits=12).collect()
    assert len(none) == 43 and all(r.score == 0.5 for r in none)
    assert quality.learn_and_score(docs.limit(0), labels, bits=12).count() == 0


def test_language_of_odd_documents(spark):
    docs = documents(spark)
    got = language.learn_and_predict(docs).collect()
    assert len(got) == len(rows())
    truth = {i: lang for i, _, lang, _ in rows()}
    plain = [r for r in got if r.doc_id is not None and (r.doc_id < 400 or r.doc_id == 500) and r.doc_id != 8]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in plain]) >= 0.97
    assert any(r.held_out for r in plain)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (400, 401, 402))
    assert all(0 <= r.score <= 1 for r in got)


def test_unseen_words_fall_back_to_shorter_grams():
    counts = [("en", 0, "the", 5), ("fr", 0, "le", 5), ("en", 2, "th", 9), ("fr", 2, "qu", 9), ("en", 1, "w", 3), ("fr", 1, "é", 3)]
    totals = {(lang, n): 10 for lang in ("en", "fr") for n in range(3)}
    model = language.LanguageModel(["en", "fr"], counts, totals, 2, 7.0)
    assert model.predict("the the")[0] == "en" and model.predict("QUX")[0] == "fr" and model.predict("wz")[0] == "en"
    assert model.predict("é")[0] == "fr" and model.predict("zz") == ("en", 0.5)
    assert model.predict("12 !") == ("und", 0.0)


def test_model_size_is_bounded(spark):
    marked = documents(spark).select("doc_id", "lang", "text")
    small = language.fit(marked, model_entries=240)
    assert sum(map(len, small.rows)) <= 240
    few = language.fit(marked, sample_rows=5)
    assert few.languages and sum(map(len, few.rows)) < sum(map(len, language.fit(marked).rows))


def test_language_filter_keeps_clean_documents(spark):
    docs = documents(spark)
    got = language.with_known_language(docs)
    assert got.columns == docs.columns
    # numbers, blanks and nulls go, everything with words stays
    assert {r[0] for r in rows()} - {r.doc_id for r in got.collect()} == {400, 401, 402, 403}


def test_no_documents(spark):
    assert language.learn_and_predict(no_documents(spark)).count() == 0
    assert language.with_known_language(no_documents(spark)).count() == 0


def test_number_signs_are_no_letters(spark):
    model = language.fit(spark.createDataFrame([(1, "the and of", "en"), (2, "le et la", "fr")], "doc_id long, text string, lang string"))
    for text in ("½ ² Ⅷ ③", "12 34", "_ __", "٣ ५"):
        assert language.words_of(text) == [] and model.predict(text) == ("und", 0.0)
    assert language.words_of("Ünd3x² 一二 x½y") == ["ünd", "x", "一二", "x", "y"]


def plain_predictions(taught, texts, orders=5, penalty=7.0):
    """The backoff over plain dictionaries of the whole counts."""
    counts = {}
    for text, lang in taught:
        for word in language.words_of(text):
            for n, gram in [(0, word)] + [(n, g) for n in range(1, orders + 1) for g in language.grams_of(word, n)]:
                own = counts.setdefault((lang, n), {})
                own[gram] = own.get(gram, 0) + 1
    langs = sorted({lang for lang, _ in counts})

    def value(lang, n, gram):
        own = counts.get((lang, n), {})
        return min(penalty, -np.log10(own[gram] / sum(own.values()))) if gram in own else penalty

    def word_values(word):
        if any(word in counts.get((lang, 0), {}) for lang in langs):
            return [value(lang, 0, word) for lang in langs]
        for n in range(orders, 0, -1):
            known = [g for g in language.grams_of(word, n) if any(g in counts.get((lang, n), {}) for lang in langs)]
            if known:
                return [np.mean([value(lang, n, g) for g in known]) for lang in langs]
        return [penalty] * len(langs)

    out = []
    for text in texts:
        words = language.words_of(text or "")
        total = np.sum([word_values(w) for w in words], axis=0) if words else None
        out.append(("und", 0.0) if total is None else (langs[int(np.argmin(total))], 1 / np.sum(10.0 ** (total.min() - total))))
    return out


def test_predictions_equal_plain_dictionaries(spark):
    dice = random.Random(12)
    taught = [(prose(dice, lang, dice.randrange(1, 40)), lang) for lang in ("en", "fr") for _ in range(30)]
    texts = [prose(dice, dice.choice(["en", "fr"]), dice.randrange(1, 6)) for _ in range(60)] + [None, "", "qqqq zz", "½", "the the"]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(taught)], "doc_id long, text string, lang string").repartition(3)
    model = language.fit(frame)
    for text, (lang, score) in zip(texts, plain_predictions(taught, texts)):
        got = model.predict(text)
        assert got[0] == lang and abs(got[1] - score) < 1e-9
