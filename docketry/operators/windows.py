"""Window functions. Every order has a tie-breaker, so results don't depend on the partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.schemas import CASE_KEY


def latest(df: DataFrame, key: list[str], ts: str, tie: str) -> DataFrame:
    """The last row of each key by ts, then by tie; nulls count as earliest."""
    w = Window.partitionBy(*key).orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(tie))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def keep_recent(df: DataFrame, group: list[str], ts: str, tie: str, n: int) -> DataFrame:
    """The n most recent rows of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc_nulls_last(ts), F.desc_nulls_last(tie))
    return df.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def number_labels(entities: DataFrame, **more: Column) -> DataFrame:
    """(case key, kind, value, label, more...): [KIND_1], [KIND_2], ... inside a case, by first appearance.

    Kinds that differ by case alone share their numbers, so no two values share a label. more: further
    aggregates of a value's entities.
    """
    first = entities.groupBy(*CASE_KEY, "kind", "value").agg(F.min(F.struct("piece_id", "start")).alias("at"), *[c.alias(name) for name, c in more.items()])
    n = F.row_number().over(Window.partitionBy(*CASE_KEY, F.upper("kind")).orderBy("at", "kind", "value"))
    return first.select(*CASE_KEY, "kind", "value", F.concat(F.lit("["), F.upper("kind"), F.lit("_"), n.cast("string"), F.lit("]")).alias("label"), *more)


def compare_days_ago(daily: DataFrame, n: int, max_gap: int = 0) -> DataFrame:
    """daily (tenant, view, board, day, n) with before: the number n days earlier, or the nearest one up to max_gap days before that."""
    day = F.unix_date("day")
    w = Window.partitionBy("tenant", "view", "board").orderBy(day).rangeBetween(-n - max_gap, -n)
    return daily.withColumn("before", F.last("n", ignorenulls=True).over(w))


def pick_templates(templates: DataFrame, category: str | None, max_n: int, max_chars: int) -> DataFrame:
    """The newest templates of a category, or of each, up to a number and a total size; stops at the first that is too much."""
    rows = templates if category is None else templates.filter(F.col("category") == category)
    w = Window.partitionBy("category").orderBy(F.desc_nulls_last("template_id"))
    total = F.sum("n_chars").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"rank": F.row_number().over(w).cast("long"), "total_chars": total})
    return rows.filter((F.col("rank") <= max_n) & (F.col("total_chars") <= max_chars))


def resent_bytes(turns: DataFrame, selection: DataFrame, pieces: DataFrame) -> DataFrame:
    """(case key, turn, bytes, total): each turn sends the pieces marked up to then again; total adds up over a conversation.

    A piece counts from the first turn that marks it, once; that may be a turn without a row of its own.
    """
    first = selection.groupBy(*CASE_KEY, "piece_id").agg(F.min("turn").alias("turn"))
    marked = first.join(pieces.select(*CASE_KEY, "piece_id", "n_bytes"), [*CASE_KEY, "piece_id"])
    marked = marked.groupBy(*CASE_KEY, "turn").agg(F.sum("n_bytes").alias("added")).withColumn("own", F.lit(False))
    rows = turns.select(*CASE_KEY, "turn").distinct().withColumns({"added": F.lit(0).cast("long"), "own": F.lit(True)}).unionByName(marked)
    w = Window.partitionBy(*CASE_KEY).orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("bytes", F.sum("added").over(w)).filter("own")
    return rows.select(*CASE_KEY, "turn", "bytes", F.sum("bytes").over(w).alias("total"))
