"""Containment of many values in many texts, by an inverted index of short pieces of the values.

Every value stands under one of its pieces of GRAM code points, the one that fewest other values have (under
itself, if it is shorter). A text is searched once: numpy hashes its pieces at all places and looks them up in a
bitmap of the values' pieces, which is of a fixed size and says yes to some others too. Up to a number of values
the whole index is sent to the texts' tasks, so what passes meets its values there and no text is shuffled. More
values meet the pieces that pass by an equi-join, and containment is tested on what has met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.operators.batches import BATCH_BYTES, small_batches

GRAM = 6
#: Bits of the bitmap, as a power of two: 2 MB.
BITS = 24
#: Pieces met that a task holds before it hands them on, about.
HELD = 20_000
#: Values, and their code points, up to which the index is sent to the tasks: 100 MB there at most, 20 for short words.
SENT_VALUES, SENT_POINTS = 2_000_000, 16_000_000
#: Places of a piece up to which each is compared; in texts with more the value is searched for.
FEW = 64


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def hashed(text: np.ndarray, n: int) -> np.ndarray:
    """32 bits for each piece of n code points, by joining hashes of halves, which may overlap."""
    h, size = (text + np.uint32(n)) * np.uint32(0x9E3779B1), 1
    while size < n and len(h):
        step = min(size, n - size)
        left = h[: max(0, len(h) - step)]
        h = left * np.uint32(0x85EBCA77) ^ h[step:] ^ left >> np.uint32(15)
        size += step
    return (h ^ (h >> np.uint32(16))) * np.uint32(0xC2B2AE3D)


def cells(hashes: np.ndarray) -> np.ndarray:
    """The bit of each piece."""
    return hashes >> np.uint32(32 - BITS)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The places of the pieces whose bit is set."""
    bit = cells(hashes)
    return np.flatnonzero(bitmap[bit >> np.uint32(5)] >> (bit & np.uint32(31)) & np.uint32(1))


class Index:
    """Values by the hash of their piece, in flat arrays: 16 bytes a value besides its text."""

    def __init__(self, grams: list[str], values: list[str]):
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))
        hashes = np.zeros(len(grams), np.uint32)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            hashes[own] = hashed(points("".join([grams[k] for k in own.tolist()])), n)[::n]
        order = np.lexsort((hashes, sizes))
        self.hashes, sizes, order = hashes[order], sizes[order], order.tolist()
        self.sizes = [(n, *np.searchsorted(sizes, [n, n + 1]).tolist()) for n in np.unique(sizes).tolist()]
        self.offsets = np.fromiter((values[k].index(grams[k]) for k in order), np.int32, len(order))
        self.starts = np.cumsum(np.fromiter((len(values[k]) for k in [*order[:1], *order]), np.int64, len(order) + bool(order)))
        self.starts -= self.starts[:1]
        self.pool = "".join([values[k] for k in order])
        self.bitmap = np.zeros(2 ** (BITS - 5), np.uint32)
        bit = cells(self.hashes)
        np.bitwise_or.at(self.bitmap, bit >> np.uint32(5), np.uint32(1) << (bit & np.uint32(31)))

    def found(self, text: str) -> Iterator[tuple[str, int]]:
        """(value, place) of the values in a text, with their first place (from 0)."""
        code = points(text)
        for n, begin, end in self.sizes:
            own, hashes = self.hashes[begin:end], hashed(code, n)
            at = marked(self.bitmap, hashes)
            first = np.searchsorted(own, hashes[at])
            met = own[np.minimum(first, len(own) - 1)] == hashes[at]
            order = np.argsort(first[met], kind="stable")  # a piece's places stay in order
            at, first = at[met][order], first[met][order]
            runs = np.flatnonzero(np.diff(first, prepend=-1))
            last = np.searchsorted(own, own[first[runs]], "right")
            ends = np.append(runs[1:], len(at))[: len(runs)]
            for a, b, k, until in zip(runs.tolist(), ends.tolist(), first[runs].tolist(), last.tolist(), strict=True):
                places = at[a : min(b, a + FEW)].tolist()
                for i in range(begin + k, begin + until):
                    value, offset = self.pool[self.starts[i] : self.starts[i + 1]], int(self.offsets[i])
                    place = next((p - offset for p in places if p >= offset and text.startswith(value, p - offset)), -1)
                    if place < 0 and b - a > FEW:
                        place = text.find(value, max(places[-1] - offset, 0))
                    if place >= 0:
                        yield value, place


def indexed(values: DataFrame) -> DataFrame:
    """(gram, value): each of distinct values, none of them empty, under its rarest piece."""
    last = F.greatest(F.char_length("value") - GRAM + 1, F.lit(1))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(F.col("value"), i, F.lit(GRAM))))
    each = values.select("value", F.explode(grams).alias("gram"))
    held = each.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct("n", F.xxhash64("gram").alias("h"), "gram"))
    return each.join(held, "gram").groupBy("value").agg(rarest.alias("x")).select("x.gram", "value")


def containing(texts: DataFrame, key: list[str], values: DataFrame) -> DataFrame:
    """(key..., value, at): the values that a text contains, with their first place (from 1).

    texts: (key..., text). Null and empty texts and values meet nothing, nor do texts with a null in their key;
    of texts with one key each is searched.
    """
    small_batches(texts.sparkSession)
    values = values.select("value").filter("value <> ''").distinct()
    n, size = values.agg(F.count("*"), F.sum(F.char_length("value").cast("long"))).first()
    texts = texts.select(*key, "text").filter(" AND ".join(f"`{c}` IS NOT NULL" for c in key))
    if n <= SENT_VALUES and (size or 0) <= SENT_POINTS:
        return _searched(texts, key, indexed(values))
    return _joined(texts, key, indexed(values))


def _fields(texts: DataFrame, key: list[str]) -> str:
    return ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key)


def _searched(texts: DataFrame, key: list[str], index: DataFrame) -> DataFrame:
    """Hits by an index that all tasks hold: texts are searched where they lie."""
    rows = index.toArrow()
    sent = texts.sparkSession.sparkContext.broadcast(Index(rows.column("gram").to_pylist(), rows.column("value").to_pylist()))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            keys, own, values, ats, held = b.select(key), [], [], [], 0
            for k, text in enumerate(b.column("__text")):
                for value, place in known.found(text.as_py() or ""):
                    own.append(k)
                    values.append(value)
                    ats.append(place + 1)
                    held += len(value)
                    if len(own) >= HELD or held >= BATCH_BYTES:
                        yield told(keys, own, values, ats)
                        own, values, ats, held = [], [], [], 0
            if own:
                yield told(keys, own, values, ats)

    def told(keys: pa.RecordBatch, own: list[int], values: list[str], ats: list[int]) -> pa.RecordBatch:
        rows = keys.take(pa.array(own))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(values, pa.string()), pa.array(ats, pa.int64())], names=[*key, "value", "at"])

    return texts.select(*key, F.col("text").alias("__text")).mapInArrow(searched, f"{_fields(texts, key)}, value string, at long")


def _joined(texts: DataFrame, key: list[str], index: DataFrame) -> DataFrame:
    """Hits by an index of any size: the pieces that pass the bitmap meet their values, and these their texts."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = b.column("gram").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([int(cells(hashed(points(g), len(g)))[0]) for g in grams], pa.int64()), pa.array(list(map(len, grams)), pa.int32())], names=["bit", "size"])

    at = index.select("gram").distinct().mapInArrow(placed, "bit long, size int")
    # 2 ** (BITS - 5) rows at most
    rows = at.groupBy(F.expr("bit div 32").alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("b"), F.collect_set("size").alias("sizes")).collect()
    bitmap, sizes = np.zeros(2 ** (BITS - 5), np.uint32), sorted({n for r in rows for n in r["sizes"]})
    for r in rows:
        bitmap[r["cell"]] = r["b"]
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            keys, own, grams = b.select(key), [], []
            for k, text in enumerate(b.column("__text")):
                text = text.as_py() or ""  # noqa: PLW2901
                code = points(text)
                met = set()
                for n in sizes:
                    met.update(text[i : i + n] for i in marked(known, hashed(code, n)).tolist())
                own += [k] * len(met)
                grams += met
                if len(own) >= HELD:
                    yield told(keys, own, grams)
                    own, grams = [], []
            if own:
                yield told(keys, own, grams)

    def told(keys: pa.RecordBatch, own: list[int], grams: list[str]) -> pa.RecordBatch:
        """A row a piece that was met: with its text's key, and without the text."""
        rows = keys.take(pa.array(own))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(grams, pa.string())], names=[*key, "gram"])

    searched_in = texts.select(*key, F.col("text").alias("__text"))
    met = searched_in.mapInArrow(searched, f"{_fields(texts, key)}, gram string").join(index, "gram").select(*key, "value")
    met = met.repartition(*key).distinct()  # dealt as the texts are, so what has met is shuffled once
    hits = texts.join(met, key).filter(F.contains("text", F.col("value")))
    return hits.select(*key, "value", F.position(F.col("value"), F.col("text")).cast("long").alias("at"))
