"""Line dedup over batches: levelled sorted runs of line hashes that each new batch is merge-anti-joined with.

Only DataFrame functions are used."""

from __future__ import annotations

import json
import string
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from breezeline.llm.common import id_in, id_out, shuffle_width
from breezeline.session import materialise, scratch_path

_BLANKS = " \t\n\x0b\f\r"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows known by id and text hash, so that rows sharing an id keep their own lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(id_in(id_col).alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def long_lines(docs: DataFrame, least_chars: int) -> DataFrame:
    """(doc_id, mark, pos, h1, h2) of every line whose key is long enough; 128 bits of hash stand for the key."""
    lines = docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= least_chars).select(
        "doc_id", "mark", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
    )


@contextmanager
def _set(spark: SparkSession, **settings: str) -> Iterator[None]:
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in settings.items()}
    before = {name: spark.conf.get(name, None) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


class LineRuns:
    """Line hashes seen so far, as sorted runs in levels, in one folder that later sessions can open.

    A run is a table of (h1, h2, owner) with one sorted file per hash bucket. A batch is laid out the same way once,
    and then merges with each run without shuffling or sorting either side. ``fanout`` runs of a level are compacted
    into one run of the next, bucket by bucket without a shuffle: a task reads one bucket's sorted files one after
    another, and the writer's sort merges such stretches. So n batches leave about fanout * log(n) runs, and a hash is
    rewritten about log(n) times. A hash is in one run only.

    Each change writes a new list of the runs into the folder before it removes the files it replaces, so a job that
    is lost in between leaves the state before or after the batch; files in no list are harmless. One job at a time
    may write. ``path`` names a folder to open or begin; without it the runs are in the scratch folder. ``leave`` ends
    the session's use of the runs, ``close`` also deletes them."""

    def __init__(self, spark: SparkSession, fanout: int = 4, path: str | None = None):
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.fanout = spark, fanout
        self.path = (path or scratch_path(spark, "line-runs")).rstrip("/")
        self.width = shuffle_width(spark)
        self.levels: list[list[str]] = []
        self.tables: set[str] = set()
        self.edition = 0
        if path is not None:
            self._open()

    def _folder(self, name: str = "") -> tuple[Any, Any]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _open(self) -> None:
        fs, folder = self._folder()
        found = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        lists = sorted(name for name in found if name.startswith("runs-"))
        if not lists:
            return
        state = json.loads(self.spark.read.text(f"{self.path}/{lists[-1]}", wholetext=True).first()[0])
        self.width, self.levels, self.edition = state["width"], state["levels"], state["edition"]
        self.tables = {name for level in self.levels for name in level}
        for name in self.tables:
            place = f"{self.path}/{name}".replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} (h1 BIGINT, h2 BIGINT, owner BIGINT) USING parquet "
                f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.width} BUCKETS LOCATION '{place}'"
            )

    def _save(self) -> None:
        self.edition += 1
        state = {"width": self.width, "levels": self.levels, "edition": self.edition}
        fs, draft = self._folder(f"_{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(draft, self._folder(f"runs-{self.edition:012d}.json")[1]):
            raise RuntimeError(f"the list of runs in {self.path} cannot be written")

    def _write(self, hashes: DataFrame) -> str:
        """Rows dealt by hash, written as one sorted file per bucket."""
        name = f"line_run_{uuid.uuid4().hex}"
        self.tables.add(name)
        writer = hashes.write.bucketBy(self.width, "h1", "h2").sortBy("h1", "h2").format("parquet")
        writer.option("path", f"{self.path}/{name}").option("maxRecordsPerFile", 0).saveAsTable(name)
        return name

    def _remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.tables.discard(name)
            fs, where = self._folder(name)
            fs.delete(where, True)

    def trusting_order(self) -> AbstractContextManager[None]:
        """Queries planned inside take a run's single file per bucket for sorted, as it is."""
        return _set(self.spark, legacy__bucketedTableScan__outputOrdering="true")

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """The rows whose hash is in no run, by a merge anti-join with each."""
        for level in self.levels:
            for name in level:
                run = self.spark.table(name).select("h1", "h2").hint("merge")
                hashes = hashes.join(run, ["h1", "h2"], "left_anti")
        return hashes

    def admit(self, lines: DataFrame) -> str:
        """Write a batch's distinct new hashes, each with its smallest doc_id, as a run that is in no level yet.

        The batch is made distinct and sorted first; what merges with the runs is its table."""
        owners = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        batch = self._write(owners if shuffle_width(self.spark) == self.width else self._dealt(owners))
        if not self.levels:
            return batch
        try:
            with self.trusting_order():
                return self._write(self.unseen(self.spark.table(batch)))
        finally:
            self._remove([batch])

    def _dealt(self, hashes: DataFrame) -> DataFrame:
        return hashes.repartition(self.width, "h1", "h2")

    def _merged(self, names: list[str]) -> DataFrame:
        """The rows of several runs, bucket beside bucket. The filters, which all rows pass, make rows of the reader's
        columns and leave the columns' types: a union of columns would put the buckets one after another instead."""
        parts = [self.spark.table(name).filter("h1 IS NOT NULL OR h2 IS NOT NULL") for name in names]
        return reduce(DataFrame.unionAll, parts)

    def push(self, new: str) -> None:
        """Take a written run into the lowest level, then compact full levels."""
        old, depth = [], 0
        while True:
            if depth == len(self.levels):
                self.levels.append([])
            self.levels[depth].append(new)
            full = self.levels[depth]
            if len(full) < self.fanout:
                break
            with _set(self.spark, sources__bucketing__autoBucketedScan__enabled="false"):
                new = self._write(self._merged(full))
            self.levels[depth] = []
            old += full
            depth += 1
        self._save()
        self._remove(old)

    def add(self, hashes: DataFrame) -> None:
        """Take in distinct hashes that are in no run (as ``unseen`` gives them) as a run."""
        owner = F.col("owner").cast("long") if "owner" in hashes.columns else F.lit(None).cast("long")
        self.push(self._write(self._dealt(hashes.select("h1", "h2", owner.alias("owner")))))

    def owners(self, name: str) -> DataFrame:
        """A run's rows read as plain files, so that a join with a hot hash can still be split."""
        return self.spark.read.schema("h1 long, h2 long, owner long").parquet(f"{self.path}/{name}")

    def leave(self) -> None:
        """End this session's use; the runs stay in their folder."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.tables = [], set()

    def close(self) -> None:
        """Delete the runs and their folder."""
        self.leave()
        fs, where = self._folder()
        fs.delete(where, True)


def batch_drops(lines: DataFrame, runs: LineRuns) -> DataFrame:
    """Positions that one batch loses, (doc_id, mark, gone array); adds the batch's new hashes to the runs.

    Every document of the batch must have a larger id than those of earlier batches. The batch's hashes are made
    distinct before they meet the runs. A line goes if its hash is in a run, or if a smaller document of the batch
    has it. The positions are written out before the runs change."""
    new = runs.admit(lines)
    gone = lines.join(runs.owners(new), ["h1", "h2"], "left").filter("owner IS NULL OR owner <> doc_id")
    drops = materialise(gone.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    runs.push(new)
    return drops


def _kept_text() -> Column:
    """The lines between dropped positions, joined again: one slice per gap, so linear in the lines."""
    lines = F.split("text", "\n")
    before = F.concat(F.array(F.lit(-1)), F.col("gone"))
    after = F.concat(F.col("gone"), F.array(F.size(lines)))
    gaps = F.zip_with(before, after, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    return F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(gaps), "\n"))


def _gone(rows: DataFrame, least_chars: int, batches: int, fanout: int) -> DataFrame:
    """(doc_id, mark, gone) of the rows that lose lines, batch by batch in rising order of doc_id."""
    lines = materialise(long_lines(rows, least_chars))
    steps = [i / batches for i in range(1, batches)]
    edges = sorted({int(x) for x in lines.stat.approxQuantile("doc_id", steps, 0.01)}) if steps else []
    runs, gone = LineRuns(rows.sparkSession, fanout), None
    try:
        for low, high in zip([None, *edges], [*edges, None]):
            part = lines if low is None else lines.filter(F.col("doc_id") > low)
            part = part if high is None else part.filter(F.col("doc_id") <= high)
            drops = batch_drops(part, runs)
            gone = drops if gone is None else gone.unionAll(drops)
    finally:
        runs.close()
    return gone


def drop_repeated_lines(
    docs: DataFrame,
    least_chars: int = 10,
    batches: int = 4,
    fanout: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, n_lines, n_dropped, kept (the text without dropped lines).

    Texts are split at line feeds. Keys of at least ``least_chars`` code points lose their lines in every document
    but the smallest doc_id that has them; that document keeps all of them. The documents come in ``batches`` ranges
    of doc_id in rising order, as daily batches would.

    Null and empty texts are one empty line. Rows that share a doc_id count as one document. A null doc_id sorts
    last. An empty table gives no rows. Extra columns are not carried."""
    rows = _numbered(docs, id_col, text_col)
    kept = rows.join(_gone(rows, least_chars, batches, fanout), ["doc_id", "mark"], "left")
    return kept.select(
        id_out("doc_id").alias("doc_id"),
        F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
        _kept_text().alias("kept"),
    )


def without_repeated_lines(docs: DataFrame, least_chars: int = 10, batches: int = 4, fanout: int = 3) -> DataFrame:
    """The same rows and columns, ``text`` without its repeated lines, ``n_chars`` (if there) counted anew where the
    text has changed. A null text stays null; a text that loses all its lines becomes empty."""
    gone = _gone(_numbered(docs, "doc_id", "text"), least_chars, batches, fanout)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        id_in("doc_id").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"), F.struct("*").alias("row")
    )
    joined = rows.join(gone, ["doc_id", "mark"], "left")
    kept = F.when(F.col("gone").isNotNull(), _kept_text())
    out = joined.select("row", kept.alias("kept"))
    made = {"text": F.coalesce("kept", "row.text"), "n_chars": F.coalesce(F.char_length("kept"), "row.n_chars")}
    kinds = dict(docs.dtypes)
    return out.select(
        *[made[c].cast(kinds[c]).alias(c) if c in made else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
