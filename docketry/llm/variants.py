"""Spelling variants: words that differ by one edit, found in dense tiles of padded code-point matrices.

Two words differ by a single insertion, deletion or replacement if their common prefix and suffix together
reach the longer length minus one. The edit then lies at some place of the longer word, and words are grouped
by windows of places: a window fixes what stands before and after it, so its group shares both, and what is
left inside of it is compared. A word comes to the windows of its own length and of the next one.

A group with more than TILE words is never brought together: its window is halved, and again, until groups are
small; a window of one place holds at most as many words as there are letters, and one. What is left of a group
is a tile: two matrices of the inner code points, padded at the right and at the left, compared column by column
in blocks, without a row for any pair. Every pair is counted in one window only, that of the first place at
which its edit can lie.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many words of a document loses a letter in the query.
TYPO = 97
#: Words of a group that are compared as one tile; larger groups are split.
TILE = 1024
#: Words of a panel: small groups are compared together, under a mask.
PANEL = 128
#: Distinct words that a task counts before it hands them on.
COUNTED = 500_000
GROUP = "size int, before int, after int, affix string"


def misspelt(word: str, told: int) -> str:
    """word without the code point at told % length if TYPO divides told."""
    if told % TYPO:
        return word
    at = told % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, typos: bool = False) -> DataFrame:
    """(word, n) of the runs of letters in text, A-Z in lower case, over all documents; null texts have none.

    typos: apply misspelt() by the crc32 of <doc_id>:<word>; a null doc_id is empty there.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n.keys()), pa.string()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

        for rows in batches:
            for did, text in zip(rows.column("did").to_pylist(), rows.column("text").to_pylist(), strict=True):
                if not text:
                    continue
                # bytes.lower() knows A-Z only
                own = Counter(RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if typos:
                    start = zlib.crc32(f"{did}:".encode())
                    for word, k in own.items():
                        n[misspelt(word, zlib.crc32(word.encode(), start))] += k
                else:
                    n.update(own)
                if len(n) > COUNTED:
                    yield flushed()
                    n.clear()
        yield flushed()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), "text")
    return rows.mapInArrow(made, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def window(size: Column, lo: Column, hi: Column, word: Column) -> Column:
    """The group of a word for the places lo to hi of words of a size: what stands before and after them.

    A shorter word has one place less inside.
    """
    after = size - 1 - hi
    affix = F.concat(F.substring(word, F.lit(1), lo), F.lit("\x00"), F.when(after > 0, F.right(word, after)).otherwise(""))
    return F.struct(size.alias("size"), lo.alias("before"), after.alias("after"), affix.alias("affix"))


def halves(size: Column, lo: Column, hi: Column, word: Column) -> Column:
    """A window's two halves; one of a single place stays."""
    mid = F.floor((lo + hi) / 2).cast("int")
    both = F.array(window(size, lo, mid, word), window(size, mid + 1, hi, word))
    return F.when(lo < hi, both).otherwise(F.array(window(size, lo, hi, word)))


def columns(inner: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words as matrices padded at the right and at the left; one row a place."""
    left = np.zeros((len(inner), width), np.uint32)
    right = np.zeros((len(inner), width), np.uint32)
    sizes = np.fromiter(map(len, inner), np.int64, len(inner))
    flat = np.frombuffer("".join(inner).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(inner)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    left[owner, place] = flat
    right[owner, place + width - sizes[owner]] = flat
    return left.T.copy(), right.T.copy()


def tile(words: list[str], n: np.ndarray, groups: np.ndarray, size: int, before: int, after: int) -> pd.DataFrame:
    """(word, n_near, best_n, best) of words that are near another of their group, for one window.

    groups numbers the groups, which may be several of the same window; words are distinct inside of a group.
    """
    width = size - before - after
    order = np.lexsort((np.array(words), -n))  # the best near word is the first one in this order
    words, n, groups = [words[k] for k in order], n[order], groups[order]
    inner = [w[before : len(w) - after] for w in words]
    left, right = columns(inner, width)
    long = np.flatnonzero(np.fromiter(map(len, inner), np.int64, len(inner)) == width)
    # an edit that may as well lie before the window was counted there
    earlier = np.fromiter((0 < before < len(w) and w[before - 1] == w[before] for w in words), bool, len(words))
    short = np.ones(len(words), bool)
    short[long] = False
    count, first = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    everyone = np.arange(len(words))
    for begin in range(0, len(long), PANEL):
        rows = long[begin : begin + PANEL]
        equal = np.ones((len(rows), len(words)), bool)
        prefix, suffix = np.zeros(equal.shape, np.uint8 if width < 255 else np.int64), np.zeros(equal.shape, np.uint8 if width < 255 else np.int64)
        for k in range(width):
            equal &= left[k][rows, None] == left[k][None, :]
            prefix += equal
        equal[:] = True
        for k in range(width - 1, -1, -1):
            equal &= right[k][rows, None] == right[k][None, :]
            suffix += equal
        near = prefix.astype(np.int64) + suffix >= width - 1
        near &= groups[rows, None] == groups[None, :]
        near &= short[None, :] | (everyone[None, :] > rows[:, None])  # two long words meet once
        near &= ~(short[None, :] & (suffix == width - 1) & earlier[rows, None])
        if not near.any():
            continue
        count[rows] += near.sum(axis=1)
        count += near.sum(axis=0)
        first[rows] = np.minimum(first[rows], np.where(near, everyone[None, :], len(words)).min(axis=1))
        first = np.minimum(first, np.where(near, rows[:, None], len(words)).min(axis=0))
    own = np.flatnonzero(count)
    return pd.DataFrame({"word": [words[k] for k in own], "n_near": count[own], "best_n": n[first[own]], "best": [words[k] for k in first[own]]})


def tiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """tile() of sorted rows (GROUP, word, n): whole groups of one window are compared together up to PANEL words."""
    kept = None

    def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        shape = rows[["size", "before", "after"]].to_numpy()
        affix = rows["affix"].to_numpy()
        fresh = np.concatenate(([True], (shape[1:] != shape[:-1]).any(axis=1) | (affix[1:] != affix[:-1])))
        group = np.cumsum(fresh)
        words, n = rows["word"].to_numpy(), rows["n"].to_numpy()
        starts = np.flatnonzero(fresh)
        ends = np.append(starts[1:], len(rows))
        several = ends - starts > 1
        starts, ends, k = starts[several], ends[several], 0
        while k < len(starts):  # groups of one word have no pair
            j, held = k + 1, ends[k] - starts[k]
            while j < len(starts) and held + ends[j] - starts[j] <= PANEL and (shape[starts[j]] == shape[starts[k]]).all():
                held, j = held + ends[j] - starts[j], j + 1
            at = np.concatenate([np.arange(a, b) for a, b in zip(starts[k:j], ends[k:j], strict=True)])
            yield tile(words[at].tolist(), n[at], group[at], *shape[starts[k]].tolist())
            k = j

    def joined(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if found := [x for x in found if len(x)]:
            yield pd.concat(found)

    for rows in batches:
        rows = rows if kept is None else pd.concat((kept, rows), ignore_index=True)
        if not len(rows):
            continue
        last = rows.iloc[-1]
        same = (rows["affix"] == last["affix"]) & (rows["size"] == last["size"]) & (rows["before"] == last["before"]) & (rows["after"] == last["after"])
        kept = rows[same]  # the last group may go on; it has TILE words at most
        yield from joined(done(rows[~same].reset_index(drop=True)) if len(kept) < len(rows) else iter(()))
    if kept is not None and len(kept):
        yield from joined(done(kept.reset_index(drop=True)))


NEAR = "word string, n_near long, best_n long, best string"


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tiles() from and to Arrow: joined columns of texts in pandas may come in chunks, which Spark doesn't take."""
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    for found in tiles(b.to_pandas() for b in batches):
        yield pa.RecordBatch.from_arrays([pa.array(found[c].tolist(), kind) for c, kind in kinds.items()], names=list(kinds))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) from (word, n), words distinct and not empty: how many are one edit away, and the most frequent of these.

    Ties of n go to the smallest word in code-point order. words should be a written table.
    """
    key = ["size", "before", "after", "affix"]
    size = F.explode(F.array(F.char_length("word"), F.char_length("word") + 1)).alias("size")
    rows = words.filter("word <> ''").select("word", "n", size)
    rows = rows.select("word", "n", F.explode(halves(F.col("size"), F.lit(0), F.col("size") - 1, F.col("word"))).alias("g")).select("g.*", "word", "n")
    parts = []
    while True:
        large = written(rows.groupBy(*key).agg(F.count("*").alias("held")).filter((F.col("held") > TILE) & (F.expr("size - before - after") > 1)), "large-groups")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(large, key, "left_anti"))
        finer = rows.join(large, key, "left_semi")
        cut = halves(F.col("size"), F.col("before"), F.expr("size - 1 - after"), F.col("word"))
        rows = written(finer.select("word", "n", F.explode(cut).alias("g")).select("g.*", "word", "n"), "finer-groups")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part.select(every.columns))
    dealt = every.repartition(*key).sortWithinPartitions(*key)
    found = dealt.mapInArrow(tiled, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), "best"))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.n")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form) without nulls: forms followed to the last, by doubling the steps.

    Chains have no circles, for a form is at least twice as frequent as its word; of 2 ** k steps, k rounds are enough.
    """
    at = forms.select("word", F.col("form").alias("root"))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = written(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = ahead.select("word", "root")
        if ahead.filter("moved").isEmpty():
            return at


def group_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) from distinct words and their numbers (word, n).

    form: the most frequent word that is one edit away (ties: the smallest in code-point order), if it is
    at least factor times as frequent, else null. root: the last word of the chain of forms, the word itself
    if it has no form. Null and empty words are left out; no words give no rows. Other columns are left out.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")).filter("word <> ''"), "words")
    near = written(near_words(words), "near-words")
    told = words.join(near, "word", "left")
    better = F.col("best_n") >= factor * F.col("n")
    told = told.select(
        "word", F.when(better, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("best_n")).alias("form_n"),
    )
    told = written(told, "forms")
    ends = roots(told.filter("form IS NOT NULL").select("word", "form"))
    out = told.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(table(spark, sf_dir, "documents"), typos=True)
    return group_variants(counts.filter((F.char_length("word") >= 5) & (F.col("n") >= 3)))
