"""Phrase collocations by direct-address tiling.

Phrases of k words are counted as pairs: a phrase of k - 1 words and the word after it. Each task takes a block
of texts and numbers the words and the shorter phrases in it by falling frequency; the plane of pairs of ranks
is cut into square tiles. A tile with many pairs is counted by numpy's bincount at the pairs' own addresses; the
pairs of all sparse tiles are sorted as coordinates and counted by runs. Frequent pairs are ranked again, as the
first parts of phrases that are one word longer, and so on.

Only phrases whose parts are frequent can be: a block skips a pair unless both of its phrases of k - 1 words
are in a bitmap of the frequent ones, which is of bounded size and says yes to some others; what they cost is a
row. Blocks hand on (lang, phrase, n) for Spark to add up, so no task holds the counts of a whole language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import table, written
from docketry.llm.suffix_dedup import Bitmap

BREAKS = re.compile("[.,;:!?\n-\r]+")
MOST, LEAST = 4, 30
#: Side of a tile, how many tiles a side may be addressed directly, and how many pairs make that worth it.
SIDE, DIRECT, DENSE = 1024, 64, 1 << 17
#: Bytes of text in a block, about, and code points of a text that are cut up at once: they bound a task's memory.
BLOCK_BYTES, PART = 16 << 20, 1 << 20
#: Rows of a batch that is handed on, and distinct words that a task counts before it does so.
HANDED, COUNTED = 1 << 16, 500_000
COUNTS = "lang string, phrase string, n long"
#: An end of a piece, and what stands between two blanks.
STOP, NONE = "\n", ""


def parts(text: str) -> Iterator[str]:
    """A text cut at ends of pieces, into parts of about PART code points or one piece."""
    begin = 0
    while begin < len(text):
        cut = BREAKS.search(text, begin + PART)
        end = cut.end() if cut else len(text)
        yield text[begin:end]
        begin = end


def tokens(text: str) -> list[str]:
    """Words of a text, A-Z in lower case, with STOP between pieces and at the end, and NONE here and there."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return [*BREAKS.sub(" \n ", lower).replace("\t", " ").split(" "), STOP]


def ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each by falling frequency, from 0; for each rank where it stands)."""
    _, at, own, n = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    rank = np.empty(len(at), np.int64)
    rank[order] = np.arange(len(at))
    return rank[own], at[order]


def count_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, n) of the distinct pairs of ranks: dense tiles by address, the others as sorted coordinates."""
    direct = (a < DIRECT * SIDE) & (b < DIRECT * SIDE)
    tile = np.where(direct, a // SIDE * DIRECT + b // SIDE, DIRECT * DIRECT)
    held = np.bincount(tile, minlength=DIRECT * DIRECT + 1)
    dense = held >= DENSE
    dense[-1] = False
    found = []
    for t in np.flatnonzero(dense):
        own = tile == t
        n = np.bincount(a[own] % SIDE * SIDE + b[own] % SIDE, minlength=SIDE * SIDE)
        cell = np.flatnonzero(n)
        found.append((cell // SIDE + t // DIRECT * SIDE, cell % SIDE + t % DIRECT * SIDE, n[cell]))
    rest = ~dense[tile]
    width = int(b.max(initial=0)) + 1
    key = np.sort(a[rest] * width + b[rest])
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    found.append((key[first] // width, key[first] % width, np.diff(np.append(first, len(key)))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a phrase from that of its start and that of its last word."""
    with np.errstate(over="ignore"):
        h = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def phrase_hashes(rows: DataFrame) -> DataFrame:
    """(h): a hash of each (lang, phrase), the one that Block makes of its words."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h = word_hashes(b["lang"].tolist())
            split = [p.split(" ") for p in b["phrase"]]
            for k in range(max(map(len, split), default=0)):
                own = np.flatnonzero(np.fromiter((len(s) > k for s in split), bool, len(split)))
                h[own] = mixed(h[own], word_hashes([split[i][k] for i in own]))
            yield pd.DataFrame({"h": h.view(np.int64)})

    return rows.select("lang", "phrase").mapInPandas(made, "h long")


def blocks(batches: Iterator[pd.DataFrame], done: Callable[[str, list[str]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """done(lang, parts of texts) of each language in every BLOCK_BYTES of (lang, text)."""
    held, size = defaultdict(list), 0
    for rows in batches:
        for lang, text in zip(rows["lang"], rows["text"], strict=True):
            for part in parts(text or ""):
                held[lang].append(part)
                size += len(part)
                if size >= BLOCK_BYTES:
                    for own, texts in held.items():
                        yield from done(own, texts)
                    held, size = defaultdict(list), 0
    for own, texts in held.items():
        yield from done(own, texts)


def handed(lang: str, phrases: pa.Array, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    rows = pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), phrases, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])
    for k in range(0, len(n), HANDED):
        yield rows.slice(k, HANDED)


def count_words(lang: str, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """Numbers of the words, and of all of them together beside NONE."""
    n: Counter = Counter()
    for text in texts:
        n.update(tokens(text))
    del n[STOP]
    n[NONE] = 0
    n[NONE] = n.total()
    yield from handed(lang, pa.array(list(n.keys()), pa.string()), np.fromiter(n.values(), np.int64, len(n)))


def count_phrases(lang: str, texts: list[str], size: int, known: list[Bitmap]) -> Iterator[pa.RecordBatch]:
    """Numbers of the phrases of a size whose parts may be frequent; known[k] has the frequent ones of k + 1 words."""
    numbers = defaultdict(count().__next__)
    numbers[NONE], numbers[STOP]
    ids = np.concatenate([np.fromiter(map(numbers.__getitem__, t), np.int64, len(t)) for t in map(tokens, texts)])
    ids = ids[ids > 0]
    names = list(numbers)
    hashes = word_hashes(names)
    seed = word_hashes([lang])
    usual = known[0].has(mixed(seed, hashes).view(np.int64))
    usual[:2] = False
    # at[i]: where a phrase that may be frequent begins; rank[i]: its number; h[i]: its hash
    at = np.flatnonzero(usual[ids])
    last, _ = ranked(ids[at])
    word_rank = np.zeros(len(ids), np.int64)
    word_rank[at] = last
    rank, h = last, mixed(seed, hashes[ids[at]])
    for k in range(2, size + 1):
        # both phrases of k - 1 words begin side by side
        pair = np.flatnonzero(np.diff(at) == 1)
        if not len(pair):
            return
        left, right = rank[pair], word_rank[at[pair] + k - 1]
        at, h = at[pair], h[pair]
        if k == size:
            break
        h = mixed(h, hashes[ids[at + k - 1]])
        own = known[k - 1].has(h.view(np.int64))
        at, h = at[own], h[own]
        rank, _ = ranked(left[own] * (int(right.max()) + 1) + right[own])
    a, b, n = count_pairs(left, right)
    # words by a place of each part
    left_at, right_at = (np.empty(int(x.max()) + 1, np.int64) for x in (left, right))
    left_at[left], right_at[right] = at, at + size - 1
    words = pa.array(names, pa.string())
    spelt = [words.take(pa.array(ids[left_at[a] + k])) for k in range(size - 1)] + [words.take(pa.array(ids[right_at[b]]))]
    yield from handed(lang, pc.binary_join_element_wise(*spelt, " "), n)


def counted(docs: DataFrame, done: Callable[[str, list[str]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(lang, phrase, n) over all documents of what done counts in blocks."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from blocks((b.to_pandas() for b in batches), done)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(made, COUNTS)
    # blocks have added up what is equal in them, so nothing is to be gained ahead of the shuffle
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, most: int = MOST, least: int = LEAST) -> tuple[list[DataFrame], DataFrame]:
    """([(lang, phrase, n) of 1, 2, ... words that occur least times or more], (lang, n) of all word occurrences)."""
    words = written(counted(docs, count_words).filter((F.col("n") >= least) | (F.col("phrase") == NONE)), "words")
    found, known = [words.filter(F.col("phrase") != NONE)], []
    for size in range(2, most + 1):
        known.append(Bitmap(written(phrase_hashes(found[-1]), "phrase-hashes"), "h"))

        def done(lang: str, texts: list[str], size: int = size, known: tuple = tuple(known)) -> Iterator[pa.RecordBatch]:
            yield from count_phrases(lang, texts, size, known)

        found.append(written(counted(docs, done).filter(F.col("n") >= least), f"phrases-{size}"))
    return found, words.filter(F.col("phrase") == NONE).select("lang", "n")


def run_of(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int | None = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of 2 to most words, best first.

    a, l and r are the numbers of a phrase and of its two parts at the cut of the lowest score, floor(2000000 *
    a / (l + r)); of equal scores the first cut counts. A phrase that lies inside of a longer one with four
    fifths of its occurrences or more is left out. Ranks go by score, a and then the phrase in byte order; top is
    how many a language reports, None for all. A null lang is und; null and empty texts have no words, repeated
    rows count each, no rows give none. Other columns are left out.
    """
    found, totals = frequent_phrases(docs, most, least)
    every = reduce(DataFrame.unionByName, found)
    phrases = reduce(DataFrame.unionByName, found[1:]).withColumnRenamed("n", "a").withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    cut = phrases.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"))
    cut = cut.select(
        "lang", "phrase", "a", "cut", run_of(F.col("words"), F.lit(1), F.col("cut")).alias("first"),
        run_of(F.col("words"), F.col("cut") + 1, F.size("words") - F.col("cut")).alias("rest"),
    )
    part = lambda name, n: every.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(20, 0)) * CAST(2000000 AS DECIMAL(7, 0))) div (CAST(l AS DECIMAL(20, 0)) + r)")
    lowest = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.size("words") - k + 1), lambda b: run_of(F.col("words"), b, k),
    )))
    inside = phrases.filter(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(inside, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * CAST(longer AS DECIMAL(20, 0)) < 80 * CAST(a AS DECIMAL(20, 0))")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = kept.select("lang", "phrase", "a", "x.l", "x.r", F.col("x.score").cast("long").alias("score")).withColumn("rank", F.row_number().over(order))
    if top is not None:  # each task keeps its own best ones ahead of the shuffle by language, which Spark does up to this limit
        limit = "spark.sql.optimizer.windowGroupLimitThreshold"
        docs.sparkSession.conf.set(limit, str(max(top, int(docs.sparkSession.conf.get(limit)))))
        rows = rows.filter(F.col("rank") <= top)
    return rows.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT doc_id, coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM worded, range(1, 5) AS s(k))),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k > 1),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * c.a) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counted l ON l.lang = c.lang AND l.phrase = array_to_string(w[1 : cut], ' ')
  JOIN counted r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1 : c.k], ' ')),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM candidates))
  GROUP BY ALL),
kept AS (
  SELECT lowest.* FROM lowest LEFT JOIN inside USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""
