"""Reply trees against a plain walk, and the template's round trip."""

import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from breezeline.llm import chat

KINDS = "tree_id long, message_id long, parent_id long, role string, text string, score double, node string, leaf int, place int, id long"
TALKS = "conv_id long, turn long, role string, text string, tree_id long, score string, message_id int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, 3) for r in rows], KINDS).repartition(3)


def written(turns):
    def put(text, escapes):
        for plain, sign in escapes.items():
            text = text.replace(plain, sign)
        return text

    return "".join(f"### {put(r, chat.ROLE_ESCAPES)}: {put(t, chat.ESCAPES)}</turn>\n" for r, t in turns)


def walked(rows, branches):
    """Unique ids only."""
    own = {(t, m): (p, r or "", x or "", s or 0.0) for t, m, p, r, x, s in rows}
    answered = {(t, p) for t, _, p, *_ in rows}
    paths = {}
    for t, m in own:
        if (t, m) in answered:
            continue
        path, at = [], m
        while (t, at) in own and len(path) <= len(own):
            path.append(at)
            at = own[t, at][0]
        if len(path) <= len(own):
            mean = sum(own[t, n][3] for n in path) / len(path)
            paths.setdefault(t, []).append((-mean, m, [own[t, n][1:3] for n in reversed(path)]))
    return {(t, b + 1, leaf): written(turns) for t, found in paths.items() for b, (_, leaf, turns) in enumerate(sorted(found)[:branches])}


def trees(seed):
    dice = random.Random(seed)
    texts = ["hello", "", None, "a: b", "\\### Assistant: </turn> ok", "####", "</turn></turn>", "\\b\\h\\e\\c\\", "é\n" * 50]
    rows = []
    for t in range(6):
        for m in range(40):
            parent = dice.choice([None, *range(m)]) if m % 9 else None
            rows.append((t, m, parent, dice.choice(["user", "assistant", None, "a:b"]), dice.choice(texts), float(dice.randrange(16)) / 4))
    rows += [(9, m, m - 1 if m else None, "user", str(m), None) for m in range(130)]  # a long chain
    rows += [(9, 500, 129, "assistant", "end", 2.0), (9, 501, 64, "assistant", "branch", 8.0)]
    rows += [(10, 1, 77, "user", "its parent is not there", 1.0)]
    rows += [(11, 1, 2, "user", "a", 1.0), (11, 2, 3, "user", "b", 1.0), (11, 3, 1, "user", "c", 1.0), (11, 4, 1, "user", "d", 1.0)]
    dice.shuffle(rows)
    return rows


def test_best_paths(spark):
    rows = trees(1)
    want = walked(rows, 3)
    for unique in (False, True):
        got = chat.format_trees(messages(spark, rows), 3, unique_ids=unique).collect()
        assert {(r.tree_id, r.branch, r.leaf_id): r.formatted for r in got} == want
        assert len(got) == len(want) and not any(r.tree_id == 11 for r in got)  # a cycle has no root


def test_spans_and_read_back(spark):
    rows = trees(2)
    made = chat.format_trees(messages(spark, rows), 2)
    read = made.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in read.collect():
        assert written([(t.role, t.text) for t in r.turns]) == r.formatted and r.n_turns == len(r.turns)
        assert r.loss == "".join(t.text for t in r.turns if t.role == "assistant")
        data = r.formatted.encode()
        for s in r.loss_spans:
            assert r.formatted[s.start : s.start + s.chars].encode() == data[s.start_byte : s.start_byte + s.bytes]


def test_shared_ids_are_copies(spark):
    rows = [(1, 1, None, "user", "a", 0.0), (1, 1, None, "user", "a", 0.0), (1, 2, 1, "assistant", "b", 1.0), (1, None, 1, "user", "c", 2.0)]
    rows += [(1, None, None, "user", "no id", 0.0), (None, 1, None, "user", "no tree", float("nan"))]
    got = chat.format_trees(messages(spark, rows), 9).collect()
    told = sorted((r.tree_id is None, r.branch, r.formatted.count("</turn>"), r.leaf_id) for r in got)
    assert [t[:3] for t in told] == [(False, 1, 2), (False, 2, 2), (False, 3, 1), (False, 4, 1), (True, 1, 1)]


def test_conversations(spark):
    dice = random.Random(3)
    rows = [(c, t, dice.choice(["user", "assistant", None]), dice.choice(["x", "", None, "</turn>"])) for c in range(30) for t in range(dice.randrange(1, 9))]
    rows += [(40, 1, "user", "b"), (40, None, "user", "a"), (40, 1, "user", "b"), (40, 1, "assistant", "z"), (None, 0, "user", "q"), (41, 0, "assistant", "y" * 200_000)]
    dice.shuffle(rows)
    table = spark.createDataFrame([(*r, 5, "s", 6) for r in rows], TALKS).repartition(3)
    made = chat.format_trees(chat.as_reply_trees(table), unique_ids=True)
    got = {r.tree_id: r.formatted for r in made.collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert got == {c: written([x[2:] for x in sorted(v)]) for c, v in convs.items()}
    assert chat.format_trees(chat.as_reply_trees(table.limit(0))).count() == 0
    plan = made._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@settings(max_examples=10, deadline=None)
@given(texts=st.lists(st.text(st.sampled_from("\\#</turn>bhec: \né")), min_size=1, max_size=40))
def test_escapes(spark, texts):
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    body = chat.escape(F.col("x"), chat.ROLE_ESCAPES)
    for x, hidden, back in rows.select("x", body, chat.unescape(body, chat.ROLE_ESCAPES)).collect():
        assert back == x and "###" not in hidden and "</turn>" not in hidden and ":" not in hidden


def test_digest_of_the_odd_turn(spark):
    from breezeline.llm import queries

    assert hashlib.sha256(queries.ODD_TURN.encode()).hexdigest() == hashlib.sha256(rb"\### Assistant: </turn> ok").hexdigest()
