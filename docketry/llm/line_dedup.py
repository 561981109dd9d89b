"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, n_docs, max_doc), bucketed and sorted by hash: for each line key that was
new in one batch of documents, how many documents of the batch hold it and the largest of their ids.
A batch is merge-anti-joined with all runs: the keys that no run has yet become its own run at level
0, and what it adds to known keys goes to the updates, which are small, for most lines never come
again. A level that has `fanout` runs is merged into one run of the next level. Runs are disjoint, so
a merge adds nothing up, and neither merges nor joins shuffle or sort a run again. Batches share no
document, so counts of a key add up over its run and its updates.

Keys are compared by two 64-bit hashes. Everything is DataFrame code.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import listed, lower_ascii, scratch, skew_join, table, tasks, without, written

BLANK = " \t\n\x0b\f\r"
RUN = "h1 long, h2 long, n_docs long, max_doc long"
STATE = "level int, path string, buckets int"


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANK)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The levels of runs and the updates below one folder, which a later session can open again.

    state-<n> below the folder tells the runs and updates after n batches. It is written last, so a
    batch that was cut off leaves nothing behind but files that no state names.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = 4):
        self.spark, self.folder, self.fanout, self.buckets = spark, folder, fanout, tasks(spark)
        self.levels: list[list[str]] = []
        self.updates: list[str] = []
        # a bucket of one sorted file needs no sort
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        done = [int(x.split("-")[1]) for x in listed(spark, folder) if x.startswith("state-") and "_SUCCESS" in listed(spark, f"{folder}/{x}")]
        self.batches = max(done, default=0)
        if self.batches:
            rows = sorted(tuple(r) for r in spark.read.schema(STATE).parquet(f"{folder}/state-{self.batches}").collect())
            self.buckets, self.updates = rows[0][2], [path for level, path, _ in rows if level < 0]
            for level, path, _ in rows:
                if level >= 0:
                    self.levels += [[] for _ in range(level + 1 - len(self.levels))]
                    self.levels[level].append(path)

    def _write(self, run: DataFrame) -> str:
        path, name = f"{self.folder}/run-{uuid.uuid4().hex}", f"docketry_{uuid.uuid4().hex}"
        rows = run.select("h1", "h2", "n_docs", "max_doc").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
        rows.option("path", path).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # the catalog's name only: the files stay, and a later session opens them in the same way
        return path

    def _read(self, path: str) -> DataFrame:
        name = f"docketry_{path.rsplit('-', 1)[1]}"
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({RUN}) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )
        return self.spark.table(name)

    def runs(self) -> list[DataFrame]:
        return [self._read(path) for level in self.levels for path in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is in no run yet: one merge with each run, without a shuffle of any."""
        return reduce(lambda left, run: left.join(run.hint("merge"), ["h1", "h2"], "left_anti"), self.runs(), rows)

    def _merged(self, paths: list[str]) -> DataFrame:
        """Disjoint sorted runs as one."""

        def two(a: DataFrame, b: DataFrame) -> DataFrame:
            rows = a.alias("a").join(b.hint("merge").alias("b"), (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2")), "full_outer")
            return rows.select(*[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("h1", "h2", "n_docs", "max_doc")])

        return reduce(two, [self._read(p) for p in paths])

    def add(self, lines: DataFrame) -> None:
        """Adds a batch of (doc_id, h1, h2), repeats allowed, and compacts the levels that are full.

        A document must not come in two batches.
        """
        held = lines.select("h1", "h2", "doc_id").distinct()
        batch = written(held.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc")), "batch")
        path = self._write(self.unseen(batch))
        if self.levels:
            again = f"{self.folder}/updates-{uuid.uuid4().hex}"
            batch.join(self._read(path).hint("merge"), ["h1", "h2"], "left_anti").write.parquet(again)
            self.updates.append(again)
        level = 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(path)
            if len(self.levels[level]) < self.fanout:
                break
            path = self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            level += 1
        self.batches += 1
        rows = [(k, p, self.buckets) for k, level in enumerate(self.levels) for p in level] + [(-1, p, self.buckets) for p in self.updates]
        self.spark.createDataFrame(rows, STATE).coalesce(1).write.parquet(f"{self.folder}/state-{self.batches}")

    def totals(self, min_docs: int = 1) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over all batches, of the keys that min_docs documents hold."""
        more = self.spark.read.schema(RUN).parquet(*self.updates) if self.updates else self.spark.createDataFrame([], RUN)
        more = more.groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("max_doc").alias("later"))
        n, last = F.col("n_docs") + F.coalesce("more", F.lit(0)), F.greatest("max_doc", "later")
        rows = [run.join(more, ["h1", "h2"], "left").select("h1", "h2", n.alias("n_docs"), last.alias("max_doc")) for run in self.runs()]
        return reduce(DataFrame.unionByName, rows or [self.spark.createDataFrame([], RUN)]).filter(F.col("n_docs") >= min_docs)

    def close(self) -> None:
        """Takes the runs' names out of the session's catalog; the files stay."""
        for path in [p for level in self.levels for p in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS docketry_{path.rsplit('-', 1)[1]}")


def hashed_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(doc_id, row_h, pos, h1, h2) of the lines with keys of min_chars code points or more."""
    one = F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    rows = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_h"), one
    )
    keyed = rows.select("doc_id", "row_h", "pos", line_key(F.col("line")).alias("key"))
    return keyed.filter(F.char_length("key") >= min_chars).select(
        "doc_id", "row_h", "pos",
        F.xxhash64("key").alias("h1"), F.xxhash64(F.concat(F.lit("\x01"), "key")).alias("h2"),
    )


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 2, fanout: int = 2) -> DataFrame:
    """docs with repeated lines taken out of text, and the columns n_lines and n_dropped (long).

    A key of min_chars code points or more that at least min_docs documents hold loses all its
    lines but those of the largest doc_id that holds it. Null text counts as empty (one empty
    line) and comes out empty. Rows with the same doc_id are one document; each row is cleaned.
    Rows with a null doc_id keep all lines. No rows give no rows. Columns of docs named n_lines
    or n_dropped are replaced; other columns stay.
    """
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch")
    lines = written(hashed_lines(docs, min_chars).select("*", batch), "lines", "batch")
    runs = LineRuns(spark, scratch(spark, "line-runs"), fanout)
    for b in range(batches):
        runs.add(lines.filter(F.col("batch") == b))
    common = written(runs.totals(min_docs).select("h1", "h2", "n_docs", "max_doc"), "common-lines")
    runs.close()
    gone = (
        skew_join(lines, common, ["h1", "h2"], "n_docs")
        .filter(F.col("doc_id") < F.col("max_doc"))
        .groupBy("doc_id", "row_h")
        .agg(F.array_sort(F.collect_set("pos")).alias("__gone"))
        .withColumnsRenamed({"doc_id": "__doc", "row_h": "__row"})
    )
    docs = without(docs, "n_lines", "n_dropped")
    same = (docs["doc_id"] == F.col("__doc")) & (F.xxhash64(docs["text"]) == F.col("__row"))
    every = lines_of(F.col("text"))
    # what stays lies between the dropped places: each line is touched once
    first, last = F.concat(F.array(F.lit(-1)), "__gone"), F.concat("__gone", F.array(F.size(every)))
    kept = F.flatten(F.zip_with(first, last, lambda a, b: F.slice(every, a + 2, b - a - 1)))
    whole = F.col("__gone").isNull()
    out = docs.join(gone, same, "left").withColumns({
        "n_lines": F.size(every).cast("long"),
        "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
        "__kept": F.when(whole, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n")),
    })
    return out.select(*[F.col("__kept").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], "n_lines", "n_dropped")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id < c.max_doc AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
