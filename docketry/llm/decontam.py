"""Benchmark decontamination by winnowing.

Texts become word sequences. Of every `span` consecutive words the k-gram with the smallest hash
is kept (rightmost on ties), so two texts that share a span keep the same k-gram inside of it, at
the same offset. Kept k-grams of documents and items are joined by hash and by half of what a shared
span has beside the k-gram, on the one side or the other, so that a k-gram that many texts share is
no group of its own; each hit is extended word by word to both sides: a run of `span` equal words or more is a shared span, and all of its
words are hit. Items shorter than a span are matched whole, by a hash of all their words.

A filter of fixed size, filled with the items' hashes, drops document k-grams that no item can
hold before anything is shuffled; the join after it decides. What is sent to the tasks is that
filter and the lengths of short items (fewer than `span`), whatever the size of the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, written

#: Bits of the hash filter, as a power of two: 2 MB.
FILTER_BITS = 24
WORDS = bytes(c if chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
ANCHORS = "array<struct<h:bigint,pos:int,left:int,len:int,words:array<string>>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of the text with A-Z lowered: digits, a-z and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive words, from the words' own hashes."""
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(out)]
    return mixed(out + np.uint64(n))


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each `window` hashes, the rightmost on ties."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    at, low, size = np.arange(n), hashes, 1
    while size < window:
        step = min(size, window - size)
        right = low[step:] <= low[:-step]
        at, low = np.where(right, at[step:], at[:-step]), np.minimum(low[step:], low[:-step])
        size += step
    return np.unique(at)


def anchors(words: list[bytes], span: int, k: int, short: tuple[int, ...], wanted=None) -> list[tuple]:
    """(h, pos, left, len, words) of the kept k-grams and of all n-grams for n in short.

    words: the gram with up to span - k words on either side, `left` of them before it. len: k for
    a kept k-gram, and -n, without words around it, for one of the n-grams. wanted(hashes) tells
    which hashes can be of use.
    """
    digest = xxhash.xxh64_intdigest
    own = np.array([digest(w) for w in words], dtype=np.uint64)
    out = []
    for n, kept in ((k, True), *((n, False) for n in short)):
        if len(own) < (span if kept else n):
            continue
        hashes = gram_hashes(own, n)
        at = winnowed(hashes, span - k + 1) if kept else np.arange(len(hashes))
        if wanted is not None:
            at = at[wanted(hashes[at])]
        side = span - k if kept else 0
        for p in at.tolist():
            left = min(p, side)
            some = [w.decode("utf-8", "surrogatepass") for w in words[p - left : p + n + side]]
            out.append((int(hashes[p].view(np.int64)), p, left, n if kept else -n, some))
    return out


def item_anchors(items: DataFrame, span: int, k: int) -> DataFrame:
    """(item_id, n_words, h, pos, left, len, words) of every item that has words."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"], strict=True):
                found = words_of(text)
                short = (len(found),) if 0 < len(found) < span else ()
                rows += [(item, len(found), *a) for a in anchors(found, span, k, short)]
            yield pd.DataFrame(rows, columns=["item_id", "n_words", "h", "pos", "left", "len", "words"])

    schema = "item_id string, n_words int, h long, pos int, left int, len int, words array<string>"
    return items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInPandas(made, schema)


def hash_filter(found: DataFrame) -> np.ndarray:
    """A bitmap of the items' hashes, built by the tasks; 2 ** (FILTER_BITS - 6) longs at most reach the driver."""
    bit = F.expr(f"h & {2**FILTER_BITS - 1}")
    cells = found.select((bit / 64).cast("int").alias("cell"), F.expr(f"shiftleft(1L, CAST((h & {2**FILTER_BITS - 1}) % 64 AS INT))").alias("b"))
    bitmap = np.zeros(2 ** (FILTER_BITS - 6), np.int64)
    held = cells.groupBy("cell").agg(F.bit_or("b").alias("b")).toPandas()
    bitmap[held["cell"]] = held["b"]
    return bitmap.view(np.uint64)


def shared_spans(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(row, n_words) of every row of docs, and (row, item_id, start, end) of shared spans.

    row: (doc_id, text hash). Ends are exclusive, in words. The spans of a row may overlap; each
    occurrence of a window of an item lies in one of them. Rows without words have no spans.
    """
    spark = docs.sparkSession
    held = written(item_anchors(items, span, k), "item-anchors")
    short = tuple(sorted(r["n_words"] for r in held.filter(F.col("n_words") < span).select("n_words").distinct().collect()))
    bits = spark.sparkContext.broadcast(hash_filter(held))
    low = np.uint64(2**FILTER_BITS - 1)

    def wanted(h: np.ndarray) -> np.ndarray:
        bit = h & low
        return (bits.value[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1)).astype(bool)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("h", "pos", "left", "len", "words")
        for b in batches:
            n, found = [], []
            for text in b["text"]:
                words = words_of(text)
                n.append(len(words))
                found.append([dict(zip(names, a, strict=True)) for a in anchors(words, span, k, short, wanted)])
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "row_h": b["row_h"], "n_words": n, "anchors": found})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_h"), "text")
    rows = written(rows.mapInPandas(made, f"doc_id long, row_h long, n_words long, anchors {ANCHORS}"), "doc-anchors")
    ours = rows.select("doc_id", "row_h", F.explode("anchors").alias("d")).select("doc_id", "row_h", F.col("d.h").alias("h"), F.col("d.len").alias("len"), "d")
    theirs = held.select("h", "len", "item_id", F.struct("left", "words").alias("i"))
    # a span that is shared has, left or right of its k-gram, half of its other words: equal there, or no pair
    half = -(-(span - k) // 2)
    sides = F.expr(f"""explode(filter(array(
        IF(len < 0, xxhash64('whole'), NULL),
        IF(len > 0 AND g.left >= {half}, xxhash64('left', slice(g.words, g.left - {half} + 1, len + {half})), NULL),
        IF(len > 0 AND size(g.words) - g.left - len >= {half}, xxhash64('right', slice(g.words, g.left + 1, len + {half})), NULL)
    ), x -> x IS NOT NULL))""").alias("side")
    ours = ours.withColumnRenamed("d", "g").select("*", sides).withColumnRenamed("g", "d")
    # items that hold a gram among the same words are one until the spans are known
    theirs = theirs.groupBy("h", "len", "i").agg(F.collect_set("item_id").alias("ids")).withColumnRenamed("i", "g").select("*", sides).withColumnRenamed("g", "i")
    both = ours.join(theirs, ["h", "len", "side"])
    # extend to both sides of the gram, which must itself be equal
    same = "slice(d.words, d.left + 1, abs(len)) = slice(i.words, i.left + 1, abs(len))"
    back = "least(d.left, i.left)"
    ahead = "least(size(d.words) - d.left, size(i.words) - i.left) - abs(len)"
    both = both.filter(same).withColumns({
        "l": F.expr(f"coalesce(array_min(filter(sequence(0, {back}), x -> x = {back} OR d.words[d.left - 1 - x] <> i.words[i.left - 1 - x])), 0)"),
        "r": F.expr(f"coalesce(array_min(filter(sequence(0, {ahead}), x -> x = {ahead} OR d.words[d.left + abs(len) + x] <> i.words[i.left + abs(len) + x])), 0)"),
    })
    long = (F.col("l") + F.col("len") + F.col("r") >= span) | (F.col("len") < 0)
    start = F.col("d.pos") - F.col("l")
    found = both.filter(long).select("doc_id", "row_h", F.explode("ids").alias("item_id"), start.alias("start"), (F.col("d.pos") + F.abs("len") + F.col("r")).alias("end"))
    return rows.select("doc_id", "row_h", "n_words"), found.distinct()


def decontaminate(docs: DataFrame, items: DataFrame, span: int = 13, k: int = 5, share: int = 20) -> DataFrame:
    """(doc_id, row_h, n_words, n_hit, items, spans, contaminated) of each row of docs.

    docs needs doc_id and text, items item_id and text; other columns are ignored. n_hit: words
    inside a shared span of `span` words, or of a whole item if that is shorter. items: the ids,
    as sorted strings. spans: array<struct<start, end>> in words, merged. contaminated: some word
    is hit and share * n_hit >= n_words. Null or wordless texts have no words and no hits; such
    items, and items with null ids, match nothing. Copies and repeated rows each get their result.
    """
    items = items.filter("item_id IS NOT NULL")
    rows, found = shared_spans(docs, items, span, k)
    found = written(found, "spans")
    by = Window.partitionBy("doc_id", "row_h").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.select("doc_id", "row_h", "start", "end").distinct()
    parts = parts.withColumn("begun", F.greatest("start", F.coalesce(F.max("end").over(by), F.lit(0))))
    hit = parts.groupBy("doc_id", "row_h").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.col("begun"))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_list(F.when(F.col("end") > F.col("begun"), F.struct(F.col("begun").alias("start"), "end")))).alias("spans"),
    )
    ids = found.groupBy("doc_id", "row_h").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    seen = hit.join(ids, ["doc_id", "row_h"]).withColumnsRenamed({"doc_id": "d", "row_h": "h"})
    out = rows.join(seen, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row_h") == F.col("h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select(
        "doc_id", "row_h", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"),
        F.coalesce("spans", F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")).alias("spans"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s
        FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
        FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
