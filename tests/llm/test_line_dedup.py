import pytest

from breezeline.llm import line_dedup
from tests.llm.odd import documents, no_documents, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOP = 2**63 - 1


def key(line):
    return line.strip(" \t\n\x0b\f\r").translate(LOWER)


def brute(least):
    owner = {}
    for i, text, _, _ in rows():
        i = TOP if i is None else i
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                owner[key(line)] = min(i, owner.get(key(line), i))
    out = []
    for i, text, _, _ in rows():
        lines = (text or "").split("\n")
        mine = TOP if i is None else i
        kept = [x for x in lines if len(key(x)) < least or owner[key(x)] == mine]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 3), (9, 2)])
def test_odd_documents(spark, batches, fanout):
    got = line_dedup.drop_repeated_lines(documents(spark), 10, batches, fanout).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(10)


def test_texts_change_and_all_columns_stay(spark):
    docs = documents(spark)
    got = line_dedup.without_repeated_lines(docs)
    assert got.dtypes == docs.dtypes
    found = got.collect()
    want = {(i, text) for i, _, _, text in brute(10)}
    assert len(found) == len(rows())
    assert {(r.doc_id, r.text or "") for r in found} == want
    assert all(r.n_chars == len(r.text or "") and r.score == 0.5 for r in found)
    assert [r.text for r in found if r.doc_id == 400] == [None]


def test_runs_are_compacted_and_removed(spark):
    def tables():
        return [t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")]

    runs = line_dedup.LineRuns(spark, fanout=2)
    for i in range(5):
        batch = spark.range(i * 10, i * 10 + 12).selectExpr("id AS h1", "-id AS h2")
        new = runs.unseen(batch)
        assert new.count() == (12 if i == 0 else 10)
        runs.add(new)
    assert [len(level) for level in runs.levels] == [1, 0, 1] and len(tables()) == 2
    runs.close()
    assert not tables()


def test_no_documents(spark):
    assert line_dedup.drop_repeated_lines(no_documents(spark)).count() == 0
    assert line_dedup.without_repeated_lines(no_documents(spark)).count() == 0


def test_no_python_on_the_executors(spark):
    plan = line_dedup.drop_repeated_lines(documents(spark))._jdf.queryExecution().toString()
    assert not [x for x in ("ArrowEval", "MapInPandas", "MapInArrow", "BatchEvalPython") if x in plan]


def batch(spark, low, high):
    return spark.range(low, high).selectExpr("id AS doc_id", "id * 7919 % 1000003 AS h1", "-id AS h2", "id AS owner")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_merging_neither_sorts_nor_shuffles_a_run(spark):
    runs = line_dedup.LineRuns(spark, fanout=3)
    try:
        for i in range(4):  # one compaction
            runs.push(runs.admit(batch(spark, i * 1000, i * 1000 + 1100)))
        assert [len(level) for level in runs.levels] == [1, 1]
        assert sorted(spark.table(n).count() for level in runs.levels for n in level) == [1000, 3100]
        incoming = runs._write(runs._dealt(batch(spark, 3900, 5000).drop("doc_id")))
        with runs.trusting_order():
            merge = plan(runs.unseen(spark.table(incoming)))
        assert merge.count("SortMergeJoin") == 2 and "Exchange" not in merge and "Sort [" not in merge
        assert runs.unseen(spark.table(incoming)).count() == 900
        files = spark.read.parquet(f"{runs.path}/{runs.levels[1][0]}").inputFiles()
        assert len(files) == len({f.rsplit("_", 1)[1] for f in files}) == runs.width
    finally:
        runs.close()


def test_a_later_session_opens_the_runs(spark):
    path = line_dedup.scratch_path(spark, "runs-test")
    first = line_dedup.LineRuns(spark, fanout=2, path=path)
    assert first.levels == []
    for i in range(3):
        first.push(first.admit(batch(spark, i * 10, i * 10 + 12)))
    state = first.levels
    first.leave()
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "7")  # the width stays that of the runs
    later = line_dedup.LineRuns(other, fanout=2, path=path)
    assert later.levels == state and later.width == 4
    name = later.admit(batch(other, 20, 40))
    assert sorted(r.owner for r in later.owners(name).collect()) == list(range(32, 40))
    later.push(name)
    assert [len(level) for level in later.levels] == [0, 0, 1]
    assert other.table(later.levels[2][0]).count() == 40
    later.close()
    fs, where = later._folder()
    assert not fs.exists(where)


def test_a_failed_job_leaves_no_tables(spark, monkeypatch):
    def fail(lines, runs):
        runs.admit(lines)
        raise ArithmeticError

    def tables():
        return {t.name for t in spark.catalog.listTables() if t.name.startswith("line_run_")}

    before = tables()
    monkeypatch.setattr(line_dedup, "batch_drops", fail)
    with pytest.raises(ArithmeticError):
        line_dedup.drop_repeated_lines(documents(spark))
    assert tables() == before
