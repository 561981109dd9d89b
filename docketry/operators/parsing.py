"""Results of analyses and imported notes, from JSON."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry import schemas

ANSWER = "tenant bigint, degree bigint, case_no bigint, answer string"
ANSWERED = f"{ANSWER}, content string"
ANSWERED_ARROW = pa.schema([*[(c, pa.int64()) for c in schemas.CASE_KEY], ("answer", pa.string()), ("content", pa.string())])
#: Cases that a task asks for before it keeps their answers, at first and where answers take their time.
AT_A_TIME = 7
#: Calls in a row, of at most so many seconds each, after which twice as many cases are asked for at a time.
QUICK_CALLS, QUICK = 16, 0.25
#: Cases that are asked for at a time at most.
MOST = 10_000


def parse_analysis(df: DataFrame, column: str, schema: str = schemas.ANALYSIS) -> DataFrame:
    """df with the fields of a structured result; fields that are absent, or all of a broken text, are null."""
    return df.withColumn("__a", F.from_json(column, schema, {"mode": "PERMISSIVE"})).select("*", "__a.*").drop("__a")


def suggestions_of(parsed: DataFrame) -> DataFrame:
    """(case key, kind, name): a row for each suggestion of an analysis."""
    return parsed.select(*schemas.CASE_KEY, F.inline("suggestions"))


def check_notes(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, rejects) of JSON lines: notes need a case, a piece, an id, a text and a sender's code."""
    rows = lines.withColumn("n", F.from_json("line", schemas.NOTE, {"mode": "PERMISSIVE"}))
    needed = [F.col(f"n.{c}").isNotNull() for c in (*schemas.PIECE_KEY, "note_id", "text", "sender_code")]
    good = F.col("n").isNotNull()
    for c in needed:
        good = good & c
    good = F.coalesce(good, F.lit(False))
    return rows.filter(good).select("n.*"), rows.filter(~good).select("line")


def analyse(bundles: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], at_once: int = 7, ledger: str | None = None) -> DataFrame:
    """(case key, answer) by a user's own function, on at most 1 to 7 tasks at once: its provider is the limit, not the data.

    With a ledger, a folder that all tasks reach through pyarrow.fs, answers are kept by case and content as they come:
    a case whose bundle has not changed is not asked again, in a later run or after a task was lost. A task calls
    fn for AT_A_TIME cases and writes their answers before it goes on; for more, as long as answers come at once, so
    that files grow with the time spent, not with the cases. Cases that fn leaves out are asked again.
    """
    tasks = max(1, min(7, at_once))
    if ledger is None:
        return bundles.coalesce(tasks).mapInPandas(fn, ANSWER)
    spark, key = bundles.sparkSession, schemas.CASE_KEY
    store, folder = fs.FileSystem.from_uri(ledger.rstrip("/"))
    store.create_dir(folder)
    content = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in bundles.columns if c not in key])), 256)
    told = bundles.withColumn("__content", content)
    known = lambda: spark.read.schema(ANSWERED).parquet(ledger).dropDuplicates([*key, "content"])
    todo = told.join(known().select(*key, F.col("content").alias("__content")), [*key, "__content"], "left_anti").coalesce(tasks)

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, folder = fs.FileSystem.from_uri(ledger.rstrip("/"))
        size, quick = AT_A_TIME, 0
        for b in batches:
            k = 0
            while k < len(b):
                some = b.iloc[k : k + size]
                k, began = k + size, time.monotonic()
                answers = [a for a in fn(iter([some.drop(columns="__content")])) if len(a)]
                quick = quick + 1 if time.monotonic() - began <= QUICK else 0
                if not quick:
                    size = max(AT_A_TIME, size // 2)
                elif quick % QUICK_CALLS == 0:
                    size = min(2 * size, MOST)
                if not answers:
                    continue
                kept = pd.concat(answers).merge(some[[*key, "__content"]], on=key).rename(columns={"__content": "content"})
                rows = pa.Table.from_pandas(kept[ANSWERED_ARROW.names], schema=ANSWERED_ARROW, preserve_index=False)
                name = uuid.uuid4().hex  # Spark sees no file whose name begins with a dot: half an answer is none
                pq.write_table(rows, f"{folder}/.{name}", filesystem=store)
                store.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")
                yield pd.DataFrame({"n": [len(kept)]})

    todo.mapInPandas(asked, "n long").agg(F.sum("n")).collect()
    own = told.select(*key, F.col("__content").alias("content")).distinct()
    return known().join(own, [*key, "content"]).select(*key, "answer")


def age_bucket(cases: DataFrame, ruler: list[int], today: Column) -> DataFrame:
    """cases with age: the first threshold in days that the case's age doesn't exceed, as a label; null without arrival."""
    days = F.date_diff(today, F.col("arrival"))
    age = F.when(days.isNull(), F.lit(None))
    for limit in sorted(ruler):
        age = age.when(days <= limit, f"up to {limit}")
    return cases.withColumn("age", age.otherwise(f"over {max(ruler)}"))


def tag_outcome(rows: DataFrame) -> DataFrame:
    """rows (before, wanted, after) with outcome: placed, already had or not recorded."""
    had, has = F.array_contains("before", F.col("wanted")), F.array_contains("after", F.col("wanted"))
    return rows.withColumn("outcome", F.when(had, "already had").when(has, "placed").otherwise("not recorded"))
