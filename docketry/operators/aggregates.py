"""Aggregations. Counts are exact: caps and gates depend on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketry.schemas import CASE_KEY, PIECE_KEY


def queue_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("queue").agg(F.count("*").alias("n"))


def sector_rollup(cases: DataFrame) -> DataFrame:
    """(sector, queue, n, level): counts by sector and queue, by sector (level 1) and in all (level 3)."""
    return cases.rollup("sector", "queue").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def tag_names(cases: DataFrame, cap: int = 500, seen: str = "last_mov") -> DataFrame:
    """(tag, seen): distinct tag names, at most cap: the ones seen last, then by name."""
    names = cases.select(F.explode("tags").alias("tag"), F.col(seen).alias("seen")).groupBy("tag").agg(F.max("seen").alias("seen"))
    return names.orderBy(F.desc_nulls_last("seen"), "tag").limit(cap)


def daily_totals(cases: DataFrame, views: dict[str, dict[str, Column]], day: Column) -> DataFrame:
    """(tenant, view, board, day, n): of how many of a tenant's cases of the day each board's predicate holds.

    views: the boards of each view. One pass for all boards of all views.
    """
    names = [(view, board) for view, boards in views.items() for board in boards]
    counted = cases.groupBy("tenant", day.alias("day")).agg(*[F.count_if(views[v][b]).alias(f"n{k}") for k, (v, b) in enumerate(names)])
    told = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(b).alias("board"), F.col(f"n{k}").alias("n")) for k, (v, b) in enumerate(names)])
    return counted.select("tenant", "day", F.inline(told)).select("tenant", "view", "board", "day", "n")


def board_share(daily: DataFrame) -> DataFrame:
    """daily with share: the board as a percentage of its tenant's view on that day, one decimal; null for an empty view."""
    total = F.sum("n").over(Window.partitionBy("tenant", "view", "day"))
    return daily.withColumn("share", F.round(F.try_divide(F.col("n") * F.lit(100.0), total), 1))


def case_bundle(cases: DataFrame, pieces: DataFrame, movements: DataFrame) -> DataFrame:
    """One record for each case to analyse: its pieces with their text, and its movements. Notes have no way in."""
    texts = pieces.groupBy(*CASE_KEY).agg(F.array_sort(F.collect_list(F.struct("piece_id", "title", "text"))).alias("pieces"))
    moves = movements.groupBy(*CASE_KEY).agg(F.array_sort(F.collect_list(F.struct("mov_ts", "mov_type"))).alias("movements"))
    return cases.select(*CASE_KEY, "class", "queue").join(texts, CASE_KEY, "left").join(moves, CASE_KEY, "left")


def estimate_work(bundles: DataFrame, price: str = "0.0000005", max_cases: int = 10, max_cost: str = "0.50") -> DataFrame:
    """(n_cases, cost, confirm): a quarter of the characters at a price each; more than the gate's cases or cost waits for confirmation."""
    money = F.lit(price).cast("decimal(18,9)")
    rows = bundles.agg(F.count("*").alias("n_cases"), F.sum("n_chars").alias("chars"))
    cost = (F.ceil(F.coalesce("chars", F.lit(0)) / 4).cast("decimal(18,0)") * money).cast("decimal(18,6)")
    rows = rows.select("n_cases", cost.alias("cost"))
    return rows.withColumn("confirm", (F.col("n_cases") > max_cases) | (F.col("cost") > F.lit(max_cost).cast("decimal(18,6)")))


def mask_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(*PIECE_KEY, "kind").agg(F.count("*").alias("n"))


def hearing_parties(hearings: DataFrame) -> DataFrame:
    """(case key, hearing_date, hour, type, parties) from one row for each party; no document comes out."""
    people = F.array_sort(F.collect_list(F.struct("name", "qualification")))
    return hearings.groupBy(*CASE_KEY, "hearing_date", "hour", "type").agg(people.alias("parties"))


def batch_progress(items: DataFrame, results: DataFrame) -> DataFrame:
    """(batch_id, expected, done, closed): items with a result against the items of each batch; null items are never done.

    Both meet in one grouping, dealt by batch and item to a number of tasks that their small size can't lower:
    ids compress so well that millions of pairs would come to one task.
    """
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = items.select("batch_id", "item", F.lit(False).alias("__done")).unionByName(results.select("batch_id", "item", F.lit(True).alias("__done")))
    rows = rows.repartition(tasks, "batch_id", "item").groupBy("batch_id", "item").agg(F.bool_and("__done").alias("__other"), F.bool_or("__done").alias("__done"))
    known = F.col("batch_id").isNotNull() & F.col("item").isNotNull()
    rows = rows.filter("NOT __other").groupBy("batch_id").agg(F.count("*").alias("expected"), F.count_if(F.col("__done") & known).alias("done"))
    return rows.withColumn("closed", F.col("done") == F.col("expected"))


def batch_log(items: DataFrame) -> DataFrame:
    """(batch_id, submitted, n_cases) of each submission."""
    return items.groupBy("batch_id").agg(F.min("ts").alias("submitted"), F.count_distinct("item").alias("n_cases"))
