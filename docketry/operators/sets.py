"""Sorts, limits and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.joins import gathered, valid_exits
from docketry.operators.select import filter_cases
from docketry.schemas import CASE_KEY


def oldest_cases(cases: DataFrame, queue: str, n: int) -> DataFrame:
    """The n cases of a queue that arrived first, then by number."""
    return filter_cases(cases, queue).orderBy(F.asc_nulls_last("arrival"), "case_no", "tenant", "degree").limit(n)


def newest_cases_cap(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """Rows of the n cases with the newest rows; the oldest cases go first."""
    newest = df.groupBy(*CASE_KEY).agg(F.max(ts).alias("__ts"))
    kept = newest.orderBy(F.desc_nulls_last("__ts"), *[F.desc(c) for c in CASE_KEY[::-1]]).limit(n).select(*CASE_KEY)
    return df.join(kept, CASE_KEY, "left_semi").select(*df.columns)


def order_timeline(timeline: DataFrame) -> DataFrame:
    return timeline.orderBy(*CASE_KEY, "ts", "kind", "id")


def scope(cases: DataFrame, queue: str | None = None, tag: str | None = None, numbers: DataFrame | None = None) -> DataFrame:
    """Keys of the cases of a queue, or with a tag, or in a list: the union of what is given."""
    parts = [filter_cases(cases, queue=queue)] if queue is not None else []
    parts += [filter_cases(cases, tag=tag)] if tag is not None else []
    parts += [cases.join(numbers.select(*CASE_KEY), CASE_KEY, "left_semi")] if numbers is not None else []
    if not parts:
        raise ValueError("give a queue, a tag or a list")
    return reduce(DataFrame.unionByName, [p.select(*CASE_KEY) for p in parts]).distinct()


def apply_tags(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """cases with their tags changed by changes (case key, add, remove), all of a case together; a tag in both is removed."""
    none = F.array().cast("array<string>")
    new = F.array_sort(F.array_except(F.array_union(F.coalesce("tags", none), F.coalesce("add", none)), F.coalesce("remove", none)))
    rows = cases.join(gathered(changes), CASE_KEY, "left")
    changed = F.col("add").isNotNull() | F.col("remove").isNotNull()
    return rows.withColumn("tags", F.when(changed, new).otherwise(F.col("tags"))).select(*cases.columns)


def tag_changes(cases: DataFrame, changes: DataFrame, run_id: str) -> DataFrame:
    """(run_id, case key, tag, outcome): what a run really changes: tags placed that weren't there, removed that were."""
    none = F.array().cast("array<string>")
    rows = cases.select(*CASE_KEY, "tags").join(gathered(changes), CASE_KEY)
    tags, add, remove = (F.coalesce(c, none) for c in ("tags", "add", "remove"))
    placed = F.transform(F.array_except(F.array_except(add, tags), remove), lambda t: F.struct(t.alias("tag"), F.lit("placed").alias("outcome")))
    gone = F.transform(F.array_intersect(remove, tags), lambda t: F.struct(t.alias("tag"), F.lit("removed").alias("outcome")))
    return rows.select(F.lit(run_id).alias("run_id"), *CASE_KEY, F.inline(F.concat(placed, gone)))


def undo_tags(cases: DataFrame, actions: DataFrame, run_id: str) -> DataFrame:
    """cases with the tags they had before a run: only what the run changed is turned back."""
    own = actions.filter(F.col("run_id") == run_id).groupBy(*CASE_KEY).agg(
        F.collect_set(F.when(F.col("outcome") == "removed", F.col("tag"))).alias("add"),
        F.collect_set(F.when(F.col("outcome") == "placed", F.col("tag"))).alias("remove"),
    )
    return apply_tags(cases, own)


def exclude_queues(cases: DataFrame, excluded: DataFrame) -> DataFrame:
    """Cases of the queues that count."""
    return cases.join(excluded.select("queue"), "queue", "left_anti")


def timeline(pieces: DataFrame, movements: DataFrame) -> DataFrame:
    """(case key, ts, kind, id, what): pieces and movements in one table, unsorted."""
    a = pieces.select(*CASE_KEY, F.col("piece_date").cast("timestamp_ntz").alias("ts"), F.lit("piece").alias("kind"), F.col("piece_id").alias("id"), F.col("title").alias("what"))
    b = movements.select(*CASE_KEY, F.col("mov_ts").alias("ts"), F.lit("movement").alias("kind"), F.col("mov_id").alias("id"), F.col("mov_type").alias("what"))
    return a.unionByName(b)


def changed_since(cases: DataFrame, visits: DataFrame) -> DataFrame:
    """Cases that moved after the tenant's last visit (tenant, last_visit)."""
    return cases.join(visits, "tenant").filter(F.col("last_mov") > F.col("last_visit")).drop("last_visit")


def move_cases(cases: DataFrame, moves: DataFrame, exits: DataFrame) -> DataFrame:
    """cases with the queue that a valid exit leads to; exits: (queue, exit, batch, to_queue).

    Of several valid moves of a case the first exit by name counts.
    """
    wanted = cases.select(*CASE_KEY, "queue").join(moves.select(*CASE_KEY, "exit"), CASE_KEY)
    valid, _ = valid_exits(wanted, exits)
    valid = valid.groupBy(*CASE_KEY, "queue").agg(F.min("exit").alias("exit"))
    leads = exits.filter("batch").groupBy("queue", "exit").agg(F.min("to_queue").alias("__to"))
    to = valid.join(leads, ["queue", "exit"]).select(*CASE_KEY, "__to")
    return cases.join(to, CASE_KEY, "left").withColumn("queue", F.coalesce("__to", "queue")).select(*cases.columns)
