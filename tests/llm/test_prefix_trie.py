"""Prefix tries against a plain dictionary of prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from breezeline.llm import prefix_trie

KINDS = "conv_id long, turn long, role string, text string, key string, depth int, path string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "key", 1, "path", 2) for r in rows], KINDS).repartition(3)


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def by_turn(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in convs.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        first = c if c is None else c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(first, [])[:h] + turns[h:]
    return out


def nodes(convs):
    last = lambda c: (c is None, c or 0)
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved, out = {}, {}, []
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    for k, who in members.items():
        ends = sorted((c for c in who if len(convs[c]) == len(k)), key=last)
        told = ",".join("null" if c is None else str(c) for c in ends)
        parent = min(members[k[:-1]], key=last) if k else None
        out.append((min(who, key=last), len(k), parent, len(who), len(children[k]), leaves[k], saved[k], hashlib.sha256(told.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, hot=False):
    dice = random.Random(seed)
    texts = ["hi", "", "a\nb", "é" * 9, "x" * 5000, "\\### </turn>", None]
    rows = []
    for c in [*range(0, 260, 3), 1000, 1001, 1050, -7, -100, -103, 4999, 2**62, None]:
        if dice.random() < 0.1:
            continue
        first = ("user", "the same first turn") if hot and dice.random() < 0.7 else (dice.choice(["user", None]), dice.choice(texts))
        rows.append((c, 0, *first))
        rows += [(c, t, dice.choice(["user", "assistant", None]), dice.choice(texts)) for t in range(1, dice.randrange(1, 9))]
    for c in range(300, 340):  # exact copies of a whole conversation
        rows += [(c, t, "user", f"copy {t}") for t in range(8)]
    rows += [(500, None, "user", "first"), (500, 0, "user", "then"), (500, 0, "user", "then"), (500, 1, None, None)]
    rows += [(601, t, "user", f"long {t % 7}") for t in range(400)] + [(602, t, "user", f"long {t % 7}") for t in range(300)]
    dice.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, shard_turns", [(1, False, 1 << 18), (2, True, 1 << 18), (3, True, 20)])
def test_nodes(spark, seed, hot, shard_turns):
    rows = conversations(seed, hot)
    got = prefix_trie.rebuilt_prefix_nodes(table(spark, rows), shard_turns).collect()
    assert sorted(map(tuple, got), key=str) == nodes(rebuilt(by_turn(rows)))


def test_hot_prefixes_are_cut_deeper(spark):
    rows = [(c, t, "user", "shared" if t < 5 else f"{c} {t}") for c in range(1, 100) for t in range(8)]
    sequences = prefix_trie.as_sequences(table(spark, rows))
    dealt = prefix_trie.sharded(sequences.withColumnsRenamed({"conv_id": "least"}), 40)
    assert dealt.groupBy("group").count().agg({"count": "max"}).first()[0] == 1 and dealt.select("shard").distinct().count() > 10
    got = prefix_trie.prefix_nodes(sequences, 40).collect()
    assert sorted(map(tuple, got), key=str) == nodes(by_turn(rows))


def test_turnless_and_none(spark):
    # conversation 1 has h turns at most and no first conversation of its block: nothing is left of it
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in range(101, 200)}
    rows = [(c, t, "user", "x") for c in h for t in range(max(1, h[c]))]
    got = prefix_trie.rebuilt_prefix_nodes(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == nodes(rebuilt(by_turn(rows)))
    assert prefix_trie.rebuilt_prefix_nodes(table(spark, rows).limit(0)).count() == 0


def test_double_array_holds_every_sequence():
    dice = random.Random(6)
    for wide in (1, 3, 40, 2000):
        many = {tuple(dice.randrange(1, wide + 1) for _ in range(dice.randrange(0, 9))) for _ in range(400)}
        many = sorted(many)
        lengths = np.array([len(s) for s in many])
        flat, starts = np.array([x for s in many for x in s], np.int64), np.cumsum(lengths) - lengths
        base, check = prefix_trie.double_array(flat, starts, lengths)
        reached = prefix_trie.walk(base, check, flat, starts, lengths)
        prefixes = {s[:d] for s in many for d in range(len(s) + 1)}
        assert len({int(x) for slots in reached for x in slots}) == len(prefixes) == (check >= 0).sum() + 1
        assert len(check) <= 4 * len(prefixes) + wide + 1
