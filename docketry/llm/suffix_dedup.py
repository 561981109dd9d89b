"""Removal of long repeated byte strings by run-length suffix indexes.

Every byte inside of a string of `span` bytes that also starts elsewhere is removed. No single
index holds the corpus: texts that share a span are first brought together.

1. Of the `GRAM`-byte hashes in each window of `span` bytes the smallest is kept (rightmost on
   ties). Equal windows keep the same gram at the same offset. The windows that keep one gram are
   consecutive; together they are its region. Windows can only be equal if their grams are.
2. Regions that are equal as a whole, byte for byte by hash, repeat: all their windows are marked.
   A region whose gram occurs nowhere else has no repeated window. What is left are regions that
   share their gram with different regions; of each kind of those one copy goes on.
3. These are dealt to shards by gram. A shard builds the suffix array of its regions and their
   Burrows-Wheeler transform, keeps only the ends of the transform's runs, with the text position
   and the common prefix at each, and from these streams the matching statistic of every position:
   inside of a run it falls by one a byte. Positions with `span` or more are marked. A gram with
   more regions than a shard can hold is dealt by longer cores around it, and a core with more than
   that has the hashes of its windows counted, which needs no group in one task.

Bitmaps of bounded size, sent to the tasks, keep rows that cannot matter out of the shuffles; they
only ever let too much through, and joins decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import skew_join, table, written
from docketry.llm.fingerprint import BASE, POWERS

GRAM = 32
#: Bytes of regions in a shard, about.
SHARD_BYTES = 1 << 19
#: Windows that share a core, where a gram is too frequent for a shard.
CELL = 32
#: Bits of a bitmap, as powers of two: eight for each value, but 128 KB at least and 32 MB at most.
MAP_BITS = (20, 28)
#: Bytes of a text that are hashed at a time.
PIECE = 1 << 22
NO_ID = -(2**63)
ROW = "did long, row_h long"


def kept_grams(data: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last window start) of each kept gram of a text of span bytes or more."""
    with np.errstate(over="ignore"):
        h, size = data.astype(np.uint64) + np.uint64(1), 1
        while size < GRAM:
            h = h[: len(h) - size] * POWERS[size] + h[size:]
            size *= 2
        h = (h ^ (h >> np.uint64(30))) * BASE
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    low_bits = np.uint64(0xFFFFFF)
    low = (h & ~low_bits) | (low_bits - np.arange(len(h), dtype=np.uint64))
    size, window = 1, span - GRAM + 1
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    at = (low_bits - (low & low_bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return h[at[first]], at[first], first, np.append(first[1:], len(at)) - 1


def regions(text: str | None, span: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gram hash, region hash, position, first, last) of the regions of a text, piece by piece."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    digest = xxhash.xxh3_64_intdigest
    for begin in range(0, len(raw) - span + 1, PIECE):
        part = raw[begin : begin + PIECE + span - 1]
        h, p, a, b = kept_grams(np.frombuffer(part, np.uint8), span)
        whole = np.array([digest(part[x : y + span]) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.uint64)
        yield h, whole, p + begin, a + begin, b + begin


class Bitmap:
    """A set of longs by their lowest bits, sent to the tasks; says yes to more than it was given.

    values is a written table. Its size is bounded: with more values than bits it says yes to most.
    """

    def __init__(self, values: DataFrame, column: str):
        self.bits = int(np.clip(values.count() * 8, 2 ** MAP_BITS[0], 2 ** MAP_BITS[1])).bit_length() - 1
        low = f"({column} & {2**self.bits - 1})"
        cells = values.select(F.expr(f"CAST({low} div 64 AS INT)").alias("cell"), F.expr(f"shiftleft(1L, CAST({low} % 64 AS INT))").alias("b"))
        held = np.zeros(2 ** (self.bits - 6), np.int64)
        found = cells.groupBy("cell").agg(F.bit_or("b").alias("b")).toPandas()
        held[found["cell"]] = found["b"]
        self.sent = values.sparkSession.sparkContext.broadcast(held.view(np.uint64))

    def has(self, values: np.ndarray) -> np.ndarray:
        bit = values.astype(np.int64).view(np.uint64) & np.uint64(2**self.bits - 1)
        return ((self.sent.value[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)

    def column(self, c: Column) -> Column:
        return F.pandas_udf(lambda x: pd.Series(self.has(x.to_numpy())), "boolean")(c)


def keyed(docs: DataFrame) -> DataFrame:
    """(did, row_h, text): a row is known by its id, or NO_ID, and a hash of its text."""
    did = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(did.alias("did"), F.xxhash64("text").alias("row_h"), "text")


def gram_rows(docs: DataFrame, span: int) -> DataFrame:
    """(h, rh) of every region."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k in range(0, len(b), 512):
                found = [r[:2] for text in b["text"].iloc[k : k + 512] for r in regions(text, span)]
                if found:
                    h, rh = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                    yield pd.DataFrame({"h": h, "rh": rh})

    return docs.select("text").mapInPandas(made, "h long, rh long")


def region_rows(docs: DataFrame, span: int, known: Bitmap) -> DataFrame:
    """(did, row_h, h, rh, p, a, b) of the regions whose gram may be in the bitmap."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for did, row_h, text in rows.itertuples(index=False):
                for h, rh, p, a, b in regions(text, span):
                    if (own := known.has(h)).any():
                        out.append((np.full(own.sum(), did), np.full(own.sum(), row_h), h[own].view(np.int64), rh[own].view(np.int64), p[own], a[own], b[own]))
            if out:
                yield pd.DataFrame(dict(zip(("did", "row_h", "h", "rh", "p", "a", "b"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return keyed(docs).mapInPandas(made, f"{ROW}, h long, rh long, p long, a long, b long")


def suffix_array(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Sorted suffixes of joined texts, by prefix tripling; only what is still tied is sorted again.

    left: bytes from each position to the end of its own text, where a suffix ends; of suffixes
    that are equal up to there the one of the earlier text comes first.
    """
    n, size = len(data), 7
    one = np.concatenate((data.astype(np.int64) + 1, np.zeros(size, np.int64)))
    two = one[:-1] * 257 + one[1:]
    four = two[:-2] * 257**2 + two[2:]
    key = (four[:n] * 257**2 + two[4 : n + 4]) * 257 + one[6 : n + 6]
    short = np.flatnonzero(left < size)
    past = 257 ** (size - left[short])
    key[short] = key[short] // past * past
    key = 2 * key + (left > size)  # of equal prefixes the suffix that ends comes first
    some = np.argsort(key)
    key = key[some]
    # suffixes that have ended are settled here: later ones differ by the rank of their ends
    ended = np.flatnonzero(left[some] <= size)
    at = some[ended]
    some[ended] = at[np.lexsort((at, key[ended]))]
    order, places = some.copy(), np.arange(n)
    rank, start = np.empty(n, np.int64), np.empty(n, np.int64)
    fresh = np.ones(n, bool)
    fresh[1:] = key[1:] != key[:-1]
    fresh[ended] = True
    while True:
        own = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[some], start[places] = own, own
        tied = ~(fresh & np.append(fresh[1:], True))
        if not tied.any():
            return order
        places, some = places[tied], some[tied]
        key = start[places] * n + rank[np.minimum(some + size, n - 1)]
        if n < 1 << 21:  # three ranks fit
            key = key * n + rank[np.minimum(some + 2 * size, n - 1)]
            size *= 3
        else:
            size *= 2
        by = np.argsort(key)
        some, key = some[by], key[by]
        order[places] = some
        fresh = np.ones(len(some), bool)
        fresh[1:] = key[1:] != key[:-1]


def common_prefix(data: np.ndarray, left: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y."""
    most = np.minimum(left[x], left[y])
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(most > 0)
    padded = np.concatenate((data, np.zeros(64, np.uint8)))
    step = np.arange(64)
    while len(live):
        i, j = x[live] + out[live], y[live] + out[live]
        differs = padded[i[:, None] + step] != padded[j[:, None] + step]
        equal = np.where(differs.any(axis=1), differs.argmax(axis=1), 64)
        out[live] = np.minimum(out[live] + equal, most[live])
        live = live[(equal == 64) & (out[live] < most[live])]
    return out


def matching_statistics(data: np.ndarray, left: np.ndarray) -> np.ndarray:
    """For each position, the longest prefix of its suffix that also starts elsewhere in the texts."""
    order = suffix_array(data, left)
    # the transform's runs: a text's first byte has its own, unlike any other, before it
    before = np.where(np.concatenate(([True], left[:-1] == 1)), -1 - np.arange(len(data)), np.concatenate(([0], data[:-1].astype(np.int64))))
    bwt = before[order]
    heads = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
    head, tail = order[heads], order[heads - 1]  # sampled positions at both ends of each border between runs
    prefix = common_prefix(data, left, head, tail)
    reach = np.arange(len(data))
    for at in (head, tail):  # inside of a run the prefix shared with the neighbour falls by one a byte
        ends = np.zeros(len(data), np.int64)
        np.maximum.at(ends, at, at + prefix)
        reach = np.maximum(reach, np.maximum.accumulate(ends))
    return np.minimum(reach - np.arange(len(data)), left)


def marked(rows: pd.DataFrame, span: int) -> pd.DataFrame:
    """(did, row_h, start, end) of repeated strings among the pieces (did, row_h, start, data) of a shard."""
    rows = rows.sort_values(["did", "row_h", "start"])
    texts: list[tuple] = []  # pieces of one text that overlap are one, so no position comes twice
    for did, row_h, start, data in rows[["did", "row_h", "start", "data"]].itertuples(index=False):
        if texts and texts[-1][:2] == (did, row_h) and start <= texts[-1][2] + len(texts[-1][3]):
            texts[-1][3].extend(data[max(0, texts[-1][2] + len(texts[-1][3]) - start) :])
        else:
            texts.append((did, row_h, start, bytearray(data)))
    sizes = np.array([len(t[3]) for t in texts])
    ends = np.repeat(np.cumsum(sizes), sizes)
    data = np.frombuffer(b"".join(t[3] for t in texts), np.uint8)
    hit = matching_statistics(data, ends - np.arange(len(data))) >= span
    out, begin = [], 0
    for (did, row_h, start, _), n in zip(texts, sizes.tolist(), strict=True):
        own = np.flatnonzero(hit[begin : begin + n])
        begin += n
        if len(own):
            edge = np.flatnonzero(np.diff(own) > 1)
            first, last = own[np.concatenate(([0], edge + 1))], own[np.append(edge, len(own) - 1)]
            out += [(did, row_h, start + a, start + b + span) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
    return pd.DataFrame(out, columns=["did", "row_h", "start", "end"])


def pieces(span: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Cuts the wanted regions out of the texts: (key, hot, did, row_h, start, data); equal windows have one key."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out, size = [], 0
            for did, row_h, text, wanted in rows.itertuples(index=False):
                raw = text.encode("utf-8", "surrogatepass")
                for r in wanted:
                    h, p, a, b = r["h"], r["p"], r["a"], r["b"]
                    if not r["hot"]:
                        out.append((h, False, did, row_h, a, raw[a : b + span]))
                    else:
                        for cell in range((p - b) // CELL, (p - a) // CELL + 1):
                            first, last = max(a, p - CELL * cell - CELL + 1), min(b, p - CELL * cell)
                            core = raw[p - CELL * cell : p - CELL * cell - CELL + 1 + span]
                            key = xxhash.xxh3_64_intdigest(core, seed=cell % 2**64) - 2**63
                            out.append((key, True, did, row_h, first, raw[first : last + span]))
                size += len(raw)
                if size > 4 << 20:
                    yield pd.DataFrame(out, columns=["key", "hot", "did", "row_h", "start", "data"])
                    out, size = [], 0
            yield pd.DataFrame(out, columns=["key", "hot", "did", "row_h", "start", "data"])

    return made


def window_rows(cells: DataFrame, span: int) -> DataFrame:
    """(wh, did, row_h, start) of every window of the pieces (did, row_h, start, data); wh is its hash."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            for k in range(0, len(b), 2048):
                some = b.iloc[k : k + 2048]
                n = some["data"].str.len().to_numpy() - span + 1
                wh = np.array([digest(data[x : x + span]) for data in some["data"] for x in range(len(data) - span + 1)], np.uint64).view(np.int64)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                rows = some[["did", "row_h", "start"]].iloc[np.repeat(np.arange(len(some)), n)]
                yield rows.assign(wh=wh, start=rows["start"].to_numpy() + step)[["wh", "did", "row_h", "start"]]

    return cells.select("did", "row_h", "start", "data").mapInPandas(made, f"wh long, {ROW}, start long")


def dealt(cut: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pieces (key, hot, did, row_h, start, data) with their shard, and those whose core alone is more than a shard."""
    size = F.length("data")
    # each of them stands for more than SHARD_BYTES: few enough to be sent
    big = cut.filter("hot").groupBy("key").agg(F.sum(size).alias("bytes")).filter(F.col("bytes") > SHARD_BYTES)
    big = F.broadcast(written(big.select("key", F.lit(True).alias("hot")), "big-cores"))
    small = cut.join(big, ["key", "hot"], "left_anti")
    shards = -(-(small.agg(F.sum(size)).first()[0] or 1) // SHARD_BYTES)
    return small.withColumn("shard", F.pmod("key", F.lit(shards))).drop("key", "hot"), cut.join(big, ["key", "hot"], "left_semi")


def repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """(did, row_h, start, end): strings of span bytes or more that cover all repeated ones, as byte offsets."""
    grams = gram_rows(docs, span).groupBy("h").agg(F.count("*").alias("n"), F.min("rh").alias("low"), F.max("rh").alias("high"))
    grams = written(grams.filter("n > 1").select("h", (F.col("low") == F.col("high")).alias("one_kind")), "grams")
    found = region_rows(docs, span, Bitmap(grams, "h")).join(grams, "h")
    found = written(found, "regions")
    place = F.col("b") + span
    sure = found.filter("one_kind").select("did", "row_h", F.col("a").alias("start"), place.alias("end"))
    mixed = found.filter("NOT one_kind")
    kinds = written(mixed.groupBy("h", "rh").agg(F.count("*").alias("n"), F.min(F.struct("did", "row_h", "p", "a", "b")).alias("r")), "kinds")
    again = skew_join(mixed, kinds.filter("n > 1").select("h", "rh", "n"), ["h", "rh"], "n").select("did", "row_h", F.col("a").alias("start"), place.alias("end"))
    # grams with a single unresolved kind at least
    sizes = kinds.groupBy("h").agg(F.sum(F.col("r.b") - F.col("r.a") + span).alias("bytes"), F.min("n").alias("least")).filter("least = 1")
    sizes = written(sizes.select("h", "bytes", (F.col("bytes") > SHARD_BYTES).alias("hot")), "gram-sizes")
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    if not total:
        return sure.unionByName(again)
    wanted = kinds.join(sizes.select("h", "hot"), "h").select("r.did", "r.row_h", F.struct("h", "r.p", "r.a", "r.b", "hot").alias("w"))
    wanted = wanted.groupBy("did", "row_h").agg(F.collect_list("w").alias("wanted"))
    wanted = written(wanted, "wanted")
    own = Bitmap(wanted, "row_h").column(F.col("row_h"))
    held = keyed(docs).filter("text IS NOT NULL").filter(own)
    held = held.join(wanted, ["did", "row_h"]).select("did", "row_h", "text", "wanted")
    cut = held.mapInPandas(pieces(span), f"key long, hot boolean, {ROW}, start long, data binary")
    small, big = dealt(written(cut, "pieces"))
    index = small.groupBy("shard").applyInPandas(lambda rows: marked(rows, span), f"{ROW}, start long, end long")
    # windows of big cores: a window comes once a kind, so one that comes again is in two kinds
    windows = written(window_rows(big, span), "windows")
    twice = written(windows.groupBy("wh").agg(F.count("*").alias("n")).filter("n > 1").select("wh"), "windows-twice")
    counted = windows.join(twice, "wh").select("did", "row_h", "start", (F.col("start") + span).alias("end"))
    return sure.unionByName(again).unionByName(index).unionByName(counted)


def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for did, row_h, text, spans in rows.itertuples(index=False):
            raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
            merged: list[list[int]] = []
            for s in sorted((s["start"], s["end"]) for s in spans) if spans is not None else ():
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            kept, at = [], 0
            for a, b in merged:
                kept.append(raw[at:a])
                at = b
            kept = b"".join([*kept, raw[at:]])
            out.append((did, len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in merged], kept))
        yield pd.DataFrame(out, columns=["did", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(docs: DataFrame, span: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept) of every row of docs (doc_id, text).

    Each byte that is covered by a string of span bytes which also starts elsewhere, in the same
    text or another, goes; spans are the maximal removed runs as byte offsets, and kept is what is
    left, as bytes: a cut may fall inside of a character. Null text counts as empty. A repeated
    row is another document: both lose what they share. Null ids stay null. Other columns are
    ignored.
    """
    spans = repeats(docs, span).groupBy("did", "row_h").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    spans = written(spans, "repeats")
    rows, touched = keyed(docs), Bitmap(spans, "row_h").column(F.col("row_h"))
    rows = rows.withColumn("touched", touched)
    changed = rows.filter("touched").join(spans, ["did", "row_h"], "left").select("did", "row_h", "text", "spans")
    schema = "did long, n_bytes long, n_removed long, spans array<struct<start:bigint,end:bigint>>, kept binary"
    changed = changed.mapInPandas(removed, schema)
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = rows.filter("NOT touched").select(
        "did", F.length(raw).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>)").alias("spans"), raw.alias("kept"),
    )
    out = changed.unionByName(whole)
    return out.select(F.nullif("did", F.lit(NO_ID)).alias("doc_id"), "n_bytes", "n_removed", "spans", "kept")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
