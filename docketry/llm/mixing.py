"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks of equal size. With q of the N slots of a cycle
for a source, its block i of the cycle is released at floor(i * N / q) and due at
ceil((i + 1) * N / q). In each slot the released block with the earliest deadline runs. The
schedule of one cycle repeats, so it is folded once over N slots, in one row, and joined to the
blocks of all cycles. At every slot a source that has blocks left has received its share of the
slots so far to within less than one block.

The fold goes by stretches of the square root of N slots, so that what has run is copied once a stretch.
A cycle has at most MAX_SLOTS slots; quotas that sum up to more are an error, for one row holds a cycle.

DataFrame and SQL functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, without

#: Rows that one task ranks, about; rows of a source that are ranked together, at most, unless their ids are the same.
TASK_ROWS, BUCKET_ROWS = 10_000, 2_500
#: Slots of a cycle, at most: the bound of what one row and one fold hold. Weights in smaller numbers mix in the same way.
MAX_SLOTS = 20_000
ADDED = ("block", "release", "deadline", "slot")


def root_weights(docs: DataFrame, parts: int = 1000) -> DataFrame:
    """(source, quota): slots of a cycle in proportion to the square root of a source's documents.

    One slot at least; the cycle is the sum of the quotas. A null source counts as ''.
    """
    n = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    share = F.sqrt("n") / F.sum(F.sqrt("n")).over(Window.partitionBy())
    return n.select("source", F.greatest(F.lit(1), F.round(share * parts)).cast("long").alias("quota"))


def cycle(quotas: DataFrame) -> DataFrame:
    """(source, i, quota, n_slots, release, deadline, pos) of every block of one cycle.

    quotas: (source, quota), a row for each source; the sum of the quotas bounds the result.
    """
    one = quotas.agg(F.array_sort(F.collect_list(F.struct("source", "quota"))).alias("s"), F.sum("quota").alias("n_slots"))
    due = "CAST(ceil((done[k] + 1) * n_slots / s[k].quota) AS BIGINT)"
    free = f"""array_min(transform(sequence(0, size(s) - 1), k ->
        IF(done[k] < s[k].quota AND done[k] * n_slots div s[k].quota <= t, struct({due} AS due, k AS k), NULL)))"""
    step = f"""transform(array({free.replace("done[", "acc.done[")}), e -> struct(
        transform(acc.done, (d, k) -> d + IF(k = e.k, 1L, 0L)) AS done,
        concat(acc.ran, array(coalesce(e.k, -1))) AS ran))[0]"""
    none = "CAST(array() AS ARRAY<INT>) AS ran"
    stretch = f"""aggregate(sequence(c * width, least((c + 1) * width, n_slots) - 1), struct(all.done AS done, {none}), (acc, t) -> {step})"""
    ran = F.expr(f"""flatten(aggregate(sequence(0L, (n_slots - 1) div width), struct(transform(s, x -> 0L) AS done, CAST(array() AS ARRAY<ARRAY<INT>>) AS ran),
        (all, c) -> transform(array({stretch}), x -> struct(x.done AS done, concat(all.ran, array(x.ran)) AS ran))[0]).ran)""")
    checked = F.when(F.col("n_slots") > MAX_SLOTS, F.raise_error(F.format_string(f"the quotas sum up to %d slots; a cycle has {MAX_SLOTS} at most", "n_slots"))).otherwise(F.col("n_slots"))
    one = one.withColumn("n_slots", checked.cast("long")).withColumn("width", F.ceil(F.sqrt("n_slots")))
    slots = one.filter("size(s) > 0").select("s", "n_slots", F.posexplode(ran).alias("pos", "k")).filter("k >= 0")
    i = (F.row_number().over(Window.partitionBy("k").orderBy("pos")) - 1).cast("long")
    rows = slots.select("n_slots", "pos", F.expr("s[k].source").alias("source"), F.expr("s[k].quota").alias("quota"), i.alias("i"))
    return rows.withColumns({
        "release": F.expr("i * n_slots div quota"),
        "deadline": F.expr("CAST(ceil((i + 1) * n_slots / quota) AS BIGINT)"),
    })


def ranked(docs: DataFrame, order: Column, n: int) -> DataFrame:
    """docs, n rows, with __rank: 0, 1, ... inside each __source in the order of the hex digest `order`.

    A source is cut by the first digits of the digest into buckets of BUCKET_ROWS rows at most, which
    are numbered apart; the sizes of the buckets before a bucket are added. So no task gets a whole
    source, and tasks grow in number with the rows, not in size.
    """
    levels = max(1, math.ceil(math.log(max(1, n) / BUCKET_ROWS, 16)))
    docs = docs.withColumns({"__h": order, "__bucket": F.substring(order, 1, levels)})
    dealt = docs.repartition(n // TASK_ROWS + 1, "__source", "__bucket")
    sizes = docs.groupBy("__source", "__bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("__source", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__source", "__bucket").orderBy("__h", "doc_id", "__tie"))
    return dealt.withColumn("__own", own).join(sizes, ["__source", "__bucket"]).withColumn("__rank", F.col("__before") + F.col("__own") - 1)


def mix(docs: DataFrame, quotas: DataFrame | None = None, block_docs: int = 32) -> DataFrame:
    """docs, each row once, with block, release, deadline and slot (long); reading by slot mixes.

    quotas: (source, quota), slots of a cycle for each source; by default root_weights(docs).
    Sources without a quota, or with one below 1, get one slot. block counts the blocks of a
    source from 0, in the order of md5(doc_id), or of a hash of the text where that is null. The weights hold until a source has run out; the
    slots of its further blocks stay empty. A null source counts as ''; its column stays null.
    Null ids, texts and repeated rows are kept and ranked like any other row; ties in doc_id are
    ordered by a hash of the text. Columns of docs with the added names are replaced.
    """
    docs = without(docs, *ADDED)
    names = docs.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if quotas is None:
        quotas = root_weights(docs)
    else:
        given = quotas.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.max("quota").cast("long").alias("q"))
        quotas = names.join(given, "source", "left").select("source", F.greatest(F.lit(1), F.coalesce("q", F.lit(1))).alias("quota"))
    named = docs.withColumns({"__source": F.coalesce("source", F.lit("")), "__tie": F.xxhash64("text")})
    rows = ranked(named, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("__tie").cast("string"))), docs.count())
    rows = rows.withColumn("block", (F.col("__rank") / block_docs).cast("long"))
    plan = cycle(quotas).withColumnsRenamed({c: f"__{c}" for c in ("i", "quota", "n_slots", "release", "deadline", "pos")})
    quota = plan.groupBy(F.col("source").alias("__source")).agg(F.first("__quota").alias("__q"))
    # both have at most one row for each slot of a cycle: Spark sends them where they are small
    rows = rows.join(quota, "__source").withColumn("__i", F.expr("block % __q"))
    plan = plan.withColumnRenamed("source", "__source")
    rows = rows.join(plan, ["__source", "__i"])
    begun = F.expr("block div __quota * __n_slots")
    rows = rows.withColumns({"release": begun + F.col("__release"), "deadline": begun + F.col("__deadline"), "slot": begun + F.col("__pos")})
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "source", *ADDED)


ORACLE = r"""
WITH RECURSIVE n AS (SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1),
quotas AS (
  SELECT source, greatest(1, CAST(round(sqrt(n) / (SELECT sum(sqrt(n)) FROM n) * 1000) AS BIGINT)) AS quota,
         row_number() OVER (ORDER BY source) AS k FROM n),
one AS (SELECT CAST(sum(quota) AS BIGINT) AS n_slots FROM quotas),
sched(t, k, done) AS (
  SELECT CAST(-1 AS BIGINT), CAST(NULL AS BIGINT), (SELECT list(CAST(0 AS BIGINT) ORDER BY k) FROM quotas)
  UNION ALL
  SELECT t + 1, pick, list_transform(done, lambda d, j: d + CASE WHEN j = pick THEN 1 ELSE 0 END)
  FROM (
    SELECT s.t, s.done, (
      SELECT q.k FROM quotas q, one
      WHERE s.done[q.k] < q.quota AND s.done[q.k] * n_slots // q.quota <= s.t + 1
      ORDER BY ((s.done[q.k] + 1) * n_slots + q.quota - 1) // q.quota, q.k LIMIT 1) AS pick
    FROM sched s WHERE s.t + 1 < (SELECT n_slots FROM one))),
plan AS (
  SELECT t AS pos, k, row_number() OVER (PARTITION BY k ORDER BY t) - 1 AS i FROM sched WHERE k IS NOT NULL),
ranked AS (
  SELECT doc_id, source, coalesce(source, '') AS s,
         (row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) // 32 AS block
  FROM documents)
SELECT doc_id, r.source, block,
       block // quota * n_slots + (block % quota) * n_slots // quota AS release,
       block // quota * n_slots + ((block % quota + 1) * n_slots + quota - 1) // quota AS deadline,
       block // quota * n_slots + p.pos AS slot
FROM ranked r JOIN quotas q ON r.s = q.source JOIN plan p ON p.k = q.k AND p.i = block % quota, one
"""
