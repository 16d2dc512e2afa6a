"""Prefix trie of conversations, as double-array tries of prefix shards whose shared upper nodes are merged.

A conversation is its sequence of turn digests. Equal sequences are one row with a count. Sequences are grouped by
their first turns, as few as keep a group within an even share of all turns, and groups are dealt into shards. A shard
packs one BASE and one CHECK array over the dense ids of its turns and is traversed for the nodes below each group's
prefix, which no other shard has. The nodes of the prefixes themselves, which shards share, are merged by key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from breezeline.llm.common import NULL_ID, group_bounds, id_in, id_out, ship, shuffle_width, spread, whole_groups
from breezeline.session import materialise

ship(__name__)

NO_ENDS = hashlib.sha256(b"").hexdigest()
KEY = 32  # hexadecimal digits of SHA-256 that stand for a turn or a prefix

PACKED = (
    "kind string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, end_key string, path array<string>, below array<long>"
)


def prefix_key(turns: Column) -> Column:
    """The key of a sequence of turn digests."""
    return F.substring(F.sha2(F.array_join(turns, ""), 256), 1, KEY)


def as_sequences(conversations: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, turns (digests of role and text), sizes (code points of the texts).

    Rows go by turn, nulls first; ties by role, then by digest. Null role or text is empty. Rows without a conv_id
    are one conversation. Turns are equal when 128 bits of SHA-256 over role and text agree."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.substring(F.sha2(named, 256), 1, KEY).alias("digest"),
        F.char_length(text).cast("long").alias("size"),
    )
    rows = conversations.select(id_in("conv_id").alias("conv_id"), turn.alias("turn"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", F.col("turns.digest").alias("turns"), F.col("turns.size").alias("sizes"))


def rebuilt(sequences: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """Every conversation with its first h turns taken from the first conversation of its block of ids: h is
    crc32(conv_id) modulo ``most``. Fewer turns there give fewer, and none if it is absent. A conversation without an
    id keeps its own turns."""
    first = F.col("conv_id") - F.col("conv_id") % block
    lent = sequences.filter((F.col("conv_id") % block == 0) & (F.col("conv_id") != NULL_ID)).select(
        F.col("conv_id").alias("first_id"),
        F.slice("turns", 1, most - 1).alias("lent_turns"),
        F.slice("sizes", 1, most - 1).alias("lent_sizes"),
    )
    h = F.when(F.col("conv_id") == NULL_ID, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    own = sequences.select("*", first.alias("first_id"), h.cast("int").alias("h"))
    none = {"turns": F.array().cast("array<string>"), "sizes": F.array().cast("array<bigint>")}

    def joined(name: str) -> Column:
        left = F.slice(F.coalesce(F.col(f"lent_{name}"), none[name]), F.lit(1), F.col("h"))
        return F.when(F.col("h") == 0, F.col(name)).otherwise(
            F.concat(left, F.slice(F.col(name), F.col("h") + 1, F.greatest(F.size(name), F.lit(1))))
        )

    return own.join(lent, "first_id", "left").select("conv_id", joined("turns").alias("turns"), joined("sizes").alias("sizes"))


def _pack(parent: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and the slot of every node of a trie, for nodes 1.. given by parent and label (from 1); node 0 is
    the root, in slot 0. The child of slot s over label c is in slot BASE[s] + c, and CHECK of that slot is s.

    Parents of most children are placed first, at the lowest base at which all their slots are free; single children
    then fill the slots left, as any slot suits them."""
    nodes = len(parent)
    order = np.lexsort((label[1:], parent[1:])) + 1
    parents, starts, counts = np.unique(parent[order], return_index=True, return_counts=True)
    free = np.ones(2 * nodes + int(label.max(initial=0)) + 2, bool)
    free[0] = False
    base_of, slot = np.zeros(nodes, np.int64), np.zeros(nodes, np.int64)
    cursor = 1  # no slot below is free
    for at in np.argsort(-counts, kind="stable"):
        if counts[at] == 1:
            break
        children = order[starts[at] : starts[at] + counts[at]]
        wanted = label[children]
        step = max(16, 65536 // len(children))
        while not free[cursor]:
            cursor += 1
        low = cursor - int(wanted[0])
        while True:
            if low + step + int(wanted[-1]) >= len(free):
                free = np.concatenate([free, np.ones(len(free) + step + int(wanted[-1]), bool)])
            fits = np.ones(step, bool)
            for label_ in wanted.tolist():
                fits &= free[low + label_ : low + label_ + step]
                if not fits.any():
                    break
            if fits.any():
                low += int(fits.argmax())
                break
            low += step
        base_of[parents[at]] = low
        slot[children] = low + wanted
        free[low + wanted] = False
    single = order[starts[counts == 1]]
    if len(single):
        if free.sum() < len(single):
            free = np.concatenate([free, np.ones(len(single), bool)])
        slot[single] = np.flatnonzero(free)[: len(single)]
        base_of[parent[single]] = slot[single] - label[single]
    size = int(slot.max(initial=0)) + 1
    base, check = np.zeros(size, np.int64), np.full(size, -1, np.int64)
    base[slot] = base_of
    check[slot[1:]] = slot[parent[1:]]
    return base, check, slot


def double_array(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BASE and CHECK over all sequences of a shard; ``flat`` has their dense turn ids, from 1."""
    state = np.zeros(len(lengths), np.int64)
    parents, labels, nodes = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], 1
    wide = int(flat.max(initial=0)) + 1
    for depth in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > depth)
        pairs, which = np.unique(state[on] * wide + flat[starts[on] + depth], return_inverse=True)
        state[on] = nodes + which
        parents.append(pairs // wide)
        labels.append(pairs % wide)
        nodes += len(pairs)
    return _pack(np.concatenate(parents), np.concatenate(labels))[:2]


def walk(base: np.ndarray, check: np.ndarray, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """For each depth from 0 the slots of the sequences that reach it (in their order), by following the arrays."""
    state = np.zeros(len(lengths), np.int64)
    out = [state.copy()]
    for depth in range(int(lengths.max(initial=0))):
        on = np.flatnonzero(lengths > depth)
        slot = base[state[on]] + flat[starts[on] + depth]
        assert (slot > 0).all() and (check[slot] == state[on]).all()
        state[on] = slot
        out.append(slot)
    return out


def _shard(frame: pd.DataFrame) -> pd.DataFrame:
    """Nodes below the groups' prefixes, and one row per group with its path and what lies below it."""
    lengths = frame["turns"].map(len).to_numpy(np.int64)
    starts = np.cumsum(lengths) - lengths
    turns = np.concatenate(frame["turns"].to_list())
    sizes = np.concatenate(frame["sizes"].to_list()).astype(np.int64)
    flat = pd.factorize(turns)[0].astype(np.int64) + 1
    base, check = double_array(flat, starts, lengths)
    reached = walk(base, check, flat, starts, lengths)
    weight, least, cut = (frame[c].to_numpy(np.int64) for c in ("n", "least", "cut"))
    slots = len(check)
    n_convs, size_of, depth_of = (np.zeros(slots, np.int64) for _ in range(3))
    conv_id, end_of = np.full(slots, NULL_ID, np.int64), np.full(slots, -1, np.int64)
    shared = np.zeros(slots, bool)  # in the prefix of a group
    for depth, slot in enumerate(reached):
        on = np.flatnonzero(lengths >= depth)
        np.add.at(n_convs, slot, weight[on])
        np.minimum.at(conv_id, slot, least[on])
        depth_of[slot] = depth
        if depth:
            size_of[slot] = sizes[starts[on] + depth - 1]
        ends = lengths[on] == depth
        end_of[slot[ends]] = on[ends]
        shared[slot[cut[on] >= depth]] = True
    inner = np.flatnonzero((check >= 0) & ~shared)
    n_children = np.bincount(check[inner], minlength=slots)
    saved = np.where(shared, 0, (n_convs - 1) * size_of)
    n_leaves = np.where(shared | (n_children > 0), 0, 1)
    # from the deepest nodes up, as far as the last shared one
    for slot in reached[:0:-1]:
        own = np.unique(slot)
        own = own[~shared[own]]
        np.add.at(saved, check[own], saved[own])
        np.add.at(n_leaves, check[own], n_leaves[own])
    keys = frame["key"].to_numpy()
    nodes = pd.DataFrame({
        "kind": "node", "conv_id": conv_id[inner], "depth": depth_of[inner], "parent_conv_id": conv_id[check[inner]],
        "n_convs": n_convs[inner], "n_children": n_children[inner], "n_leaves": n_leaves[inner], "saved_tokens": saved[inner],
        "end_key": [keys[e] if e >= 0 else None for e in end_of[inner].tolist()], "path": None, "below": None,
    })
    _, rows, group = np.unique(frame["group"].to_numpy(), return_index=True, return_inverse=True)
    members, smallest = np.zeros(len(rows), np.int64), np.full(len(rows), NULL_ID, np.int64)
    np.add.at(members, group, weight)
    np.minimum.at(smallest, group, least)
    top, paths, below = np.zeros(len(rows), np.int64), [], []
    for depth in np.unique(cut[rows]).tolist():
        on = cut[rows] == depth
        top[on] = reached[depth][np.searchsorted(np.flatnonzero(lengths >= depth), rows[on])]
    for row in rows.tolist():
        digest = hashlib.sha256()
        paths.append([digest.hexdigest()[:KEY]])
        prefix = slice(starts[row], starts[row] + cut[row])
        for turn in turns[prefix].tolist():
            digest.update(turn.encode())
            paths[-1].append(digest.hexdigest()[:KEY])
        left = np.cumsum(sizes[prefix][::-1])[::-1].tolist()
        below.append([*left[:1], *left] if left else [0])
    groups = pd.DataFrame({
        "kind": "group", "conv_id": smallest, "depth": cut[rows], "parent_conv_id": 0, "n_convs": members,
        "n_children": n_children[top], "n_leaves": n_leaves[top], "saved_tokens": saved[top], "end_key": None,
        "path": paths, "below": below,
    })
    return pd.concat([nodes, groups], ignore_index=True)


def _packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in whole_groups(frames, ["shard"]):
        bounds = group_bounds(frame, ["shard"])
        for start, stop in zip(bounds, bounds[1:]):
            yield _shard(frame.iloc[start:stop])


def sharded(distinct: DataFrame, shard_turns: int) -> DataFrame:
    """Each distinct sequence with its group (key of its first ``cut`` turns) and shard.

    Groups begin with one turn. One that holds more than twice an even share is cut at twice as many turns, and so
    on; a sequence that ends before the cut is a group of its own. So the hottest first turn is dealt out too, and
    all paths of groups together are no longer than the sequences."""
    spark, weight = distinct.sparkSession, F.size("turns") + 1
    total = distinct.agg(F.sum(weight)).first()[0] or 0
    shards = max(shuffle_width(spark), -(-total // shard_turns))
    share = 2 * total // shards
    pending, depth, done = distinct, 1, None
    while True:
        cut = pending.withColumns({"cut": F.least(F.size("turns"), F.lit(depth)), "group": prefix_key(F.slice("turns", 1, depth))})
        sums = cut.groupBy("group").agg(F.sum(weight).alias("weight"), F.count("*").alias("sequences"))
        heavy = materialise(sums.filter((F.col("weight") > share) & (F.col("sequences") > 1)).select("group"))
        last = heavy.isEmpty()
        light = cut if last else cut.join(heavy, "group", "left_anti")
        done = light if done is None else done.unionByName(light)
        if last:
            return done.withColumn("shard", F.pmod(F.xxhash64("group"), F.lit(shards)))
        pending = materialise(cut.join(heavy, "group", "left_semi").select(*distinct.columns))
        depth *= 2


def _end_digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the comma-joined ids of each key, chunk by chunk."""
    key, digest = None, None
    for frame in frames:
        out = []
        for k, ids in zip(frame["key"].tolist(), frame["ids"].tolist()):
            if k != key:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["end_key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["end_key", "ends_sha256"])


def end_digests(keyed: DataFrame, bits: int = 12) -> DataFrame:
    """(end_key, ends_sha256) of the ids that have a key, in rising order. Ids of one key travel as one string per
    block of 2^bits ids, and the strings are digested one after the other, so no task holds the ids of a key."""
    digits = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: F.when(i == NULL_ID, "null").otherwise(i.cast("string")))
    chunks = keyed.groupBy("key", F.shiftright("conv_id", bits).alias("chunk")).agg(F.array_join(digits, ",").alias("ids"))
    dealt = spread(chunks, "key").sortWithinPartitions("key", "chunk")
    return dealt.mapInPandas(_end_digests, "end_key string, ends_sha256 string")


def prefix_nodes(sequences: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """One row per node of the prefix trie of (conv_id, turns, sizes): conv_id (smallest member), depth,
    parent_conv_id (that of its parent, null for the root), n_convs (members), n_children, n_leaves (childless nodes
    of its subtree, itself included), saved_tokens (over its subtree, members less one times the code points of the
    last text), ends_sha256 (digest of the ids of members that end here).

    The member without an id sorts last and is null where it is the smallest; its decimal is ``null``. No
    conversations give no nodes. A task holds one shard, about ``shard_turns`` turns, or a single longer
    conversation."""
    keyed = materialise(sequences.select("conv_id", "turns", "sizes", prefix_key(F.col("turns")).alias("key")))
    distinct = materialise(
        keyed.groupBy("key").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("turns").alias("turns"), F.first("sizes").alias("sizes")
        )
    )
    dealt = spread(sharded(distinct, shard_turns), "shard").sortWithinPartitions("shard", "key")
    packed = materialise(dealt.mapInPandas(_packed, PACKED))
    told = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]
    inner = packed.filter("kind = 'node'").select(*told)
    groups = packed.filter("kind = 'group'").select(
        "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "path", "below", F.element_at("path", -1).alias("top")
    )

    # the nodes of the prefixes: members and children first
    steps = groups.select("conv_id", "n_convs", "n_children", "path", F.posexplode("path").alias("depth", "key"))
    merged = materialise(
        steps.groupBy("key").agg(
            F.min("depth").alias("depth"),
            F.min(F.when(F.col("depth") > 0, F.col("path")[F.greatest(F.col("depth") - 1, F.lit(0))])).alias("parent_key"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum(F.when(F.col("depth") == F.size("path") - 1, F.col("n_children")).otherwise(0)).alias("own_children"),
        )
    )
    branches = merged.filter("depth > 0").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("branches"))
    n_children = F.col("own_children") + F.coalesce("branches", F.lit(0))
    grown = materialise(merged.join(branches, "key", "left").withColumn("n_children", n_children).drop("own_children", "branches"))

    # then sums over subtrees; a node's own text counts once, in the group of its smallest member
    owned = merged.groupBy("conv_id").agg(F.min("depth").alias("owned"))
    childless = grown.select(F.col("key").alias("top"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    ready = groups.join(owned, "conv_id", "left").join(childless, "top")
    deep = F.greatest("depth", "owned")
    once = F.when(F.col("owned").isNull(), 0).otherwise(F.coalesce(F.get("below", deep), F.lit(0)))
    each = ready.select("*", F.posexplode("path").alias("depth", "key")).groupBy("key").agg(
        F.sum(F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        F.sum(F.col("saved_tokens") + F.col("n_convs") * F.get("below", F.col("depth")) - once).alias("saved_tokens"),
    )
    parents = grown.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    upper = grown.join(each, "key").join(parents, "parent_key", "left").withColumnRenamed("key", "end_key")

    ended = inner.filter("end_key IS NOT NULL").unionByName(upper.withColumn("depth", F.col("depth").cast("long")).select(*told))
    digested = ended.join(end_digests(keyed.select("key", "conv_id")), "end_key", "left").drop("end_key")
    rest = inner.filter("end_key IS NULL").drop("end_key").withColumn("ends_sha256", F.lit(None).cast("string"))
    return digested.unionByName(rest).select(
        id_out("conv_id").alias("conv_id"),
        "depth",
        id_out("parent_conv_id").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def rebuilt_prefix_nodes(conversations: DataFrame, shard_turns: int = 1 << 18) -> DataFrame:
    """prefix_nodes of the rebuilt conversations."""
    return prefix_nodes(rebuilt(materialise(as_sequences(conversations))), shard_turns)
