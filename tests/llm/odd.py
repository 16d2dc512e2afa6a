"""Documents with every oddity: nulls, empty and long texts, copies, repeated rows, clashing column names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

KINDS = (
    "doc_id long, text string, lang string, source string, n_chars int, "
    "id long, mark long, hash long, size long, fp long, label int, score double, row string, key string"
)
SYLLABLES = {"en": "the th ing and er on at re".split(), "fr": "é eux le ou qu ai ç ment".split()}


def prose(dice: random.Random, lang: str, words: int) -> str:
    part = SYLLABLES[lang]
    return " ".join("".join(dice.choice(part) for _ in range(dice.randrange(1, 5))) for _ in range(words))


def rows(seed: int = 5) -> list[tuple]:
    dice = random.Random(seed)
    out = []
    for i in range(40):
        lang = "en" if i % 3 else "fr"
        lines = [prose(dice, lang, dice.randrange(3, 25)) for _ in range(dice.randrange(1, 6))]
        out.append((i, "\n".join(lines), lang, f"s{i % 4}"))
    shared = prose(dice, "en", 40)
    out += [(100 + i, f"{prose(dice, 'en', 9)}\n{shared}\n{prose(dice, 'en', 5)}", "en", "s0") for i in range(6)]
    out += [(200 + i, out[1][1], "en", "s1") for i in range(5)]  # exact copies
    out += [(300 + i, out[2][1].replace("the", f"the{i}", 1), "en", None) for i in range(4)]  # near copies
    out += [(400, None, "en", "s1"), (401, "", None, "s2"), (402, " \t\n\r ", "fr", None), (403, "12 34 %%", None, "s3")]
    out += [(404, "One\nTWO three", None, "s3"), (405, "   the same line   \nx\nTHE SAME LINE", "en", "s0")]
    out += [(406, "the same line", "en", "s0")]
    out += [(500, prose(dice, "en", 20000), "en", "s0")]  # very long
    out += [(7, out[7][1], "en", "s3"), (7, out[7][1], "en", "s3")]  # the same row again
    out += [(8, "another text under a used id " + shared, "en", "s0")]
    out += [(None, shared + " and the rest", "en", "s2"), (None, out[9][1], "en", "s0")]
    dice.shuffle(out)
    return out


def documents(spark: SparkSession, seed: int = 5) -> DataFrame:
    full = [(*r, len(r[1] or ""), 1, 2, 3, 4, 5, 1, 0.5, "row", "key") for r in rows(seed)]
    return spark.createDataFrame(full, KINDS).repartition(3)


def no_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], KINDS)
