import re
from collections import defaultdict

from breezeline.llm import mixing
from tests.llm.odd import documents, no_documents, rows


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_share_the_excess():
    sizes = {"a": 100, "b": 1, "c": 1000}
    got = mixing.capped_targets(sizes, {"a": 5, "b": 2, "c": 1})
    # a and b stop at three times their size, c gets the rest
    assert got == {"a": 300.0, "b": 3.0, "c": 798.0} and sum(got.values()) == sum(sizes.values())
    assert mixing.capped_targets({"a": 0, "b": 10}, {"a": 1, "b": 1}) == {"a": 0.0, "b": 10.0}
    assert mixing.cycled_weights(["b", None, "é", "a", "Z"]) == {"Z": 5, "a": 2, "b": 1, "é": 5, None: 2}


def test_odd_documents(spark):
    got = mixing.mix(documents(spark)).collect()
    assert len(got) == len(rows())
    sizes, largest, taken, targets = defaultdict(int), defaultdict(int), defaultdict(int), {}
    source_of = defaultdict(set)
    for i, text, _, source in rows():
        n = words(text)
        sizes[source] += n
        largest[source] = max(largest[source], n)
        source_of[i, n].add(source)
    want = mixing.capped_targets(dict(sizes), mixing.cycled_weights(list(sizes)))
    for r in got:
        assert r["size"] >= 0 and r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        mine = [s for s in source_of[r.doc_id, r["size"]] if sizes[s] == r.source_size]
        assert len(mine) == 1 and abs(want[mine[0]] - r.target) < 1e-6
        taken[mine[0]] += r.taken
        targets[mine[0]] = r.target
    # the same row three times is one hash
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 3 * largest[s]
    again = mixing.mix(documents(spark).repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_documents_come_near_their_targets(spark):
    text = "array_join(transform(sequence(1, 1 + cast(id % 17 AS int)), x -> 'w'), ' ')"
    source = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('s', id % 7) END"
    docs = spark.range(20000).selectExpr("id AS doc_id", f"{text} AS text", f"{source} AS source")
    rows_ = mixing.mix(docs).join(docs, "doc_id").groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(rows_) == 8
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 17 for r in rows_)


def test_the_mix_repeats_rows(spark):
    plan = {}
    for r in mixing.mix(documents(spark)).collect():
        plan[r.doc_id, r["size"]] = plan.get((r.doc_id, r["size"]), 0) + r.copies
    got = mixing.mixed_documents(documents(spark))
    assert got.columns == documents(spark).columns
    seen = defaultdict(int)
    for r in got.collect():
        seen[r.doc_id, words(r.text)] += 1
    assert dict(seen) == {k: n for k, n in plan.items() if n}


def test_no_documents(spark):
    assert mixing.mix(no_documents(spark)).count() == 0
    assert mixing.mixed_documents(no_documents(spark)).count() == 0


def test_thresholds_equal_a_walk_over_sorted_hashes(spark):
    text = "array_join(transform(sequence(1, 1 + cast(pmod(xxhash64(id), 40) AS int)), x -> 'w'), ' ')"
    source = "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 31 = 0 THEN NULL ELSE concat('s', id % 5) END"
    many = spark.range(3000).selectExpr("id % 2900 AS doc_id", f"{text} AS text", f"{source} AS source")
    for docs in (documents(spark), many):
        hashed = docs.selectExpr("doc_id", "text", "source", "xxhash64(doc_id, text) AS h").collect()
        sizes = defaultdict(int)
        for r in hashed:
            sizes[r.source] += words(r.text)
        targets = mixing.capped_targets(dict(sizes), mixing.cycled_weights(list(sizes)))
        copies = {}
        for s, n in sizes.items():
            full = min(3, int(targets[s] // n)) if n else 0
            rest, sums = targets[s] - full * n, defaultdict(int)
            for r in hashed:
                if r.source == s:
                    sums[r.h % 2**64] += words(r.text)
            done, open_ = 0, bool(n) and full < 3
            for h in sorted(sums):
                once = open_ and done + sums[h] <= rest
                if open_ and not once:
                    once, open_ = 2 * (rest - done) >= sums[h], False
                done += sums[h]
                copies[s, h] = full + once
        want = sorted((str(r.doc_id), words(r.text), copies[r.source, r.h % 2**64]) for r in hashed)
        assert sorted((str(r.doc_id), r["size"], r.copies) for r in mixing.mix(docs).collect()) == want
