"""Document fingerprints by winnowing.

Every k consecutive code points are hashed; of every `window` consecutive hashes (fewer in short
texts) the smallest is kept, the rightmost one on ties, with its position. Two texts that share window + k - 1 code
points share a kept hash, and matches shorter than k are never kept.

A fingerprint is a string of 10 hexadecimal digits for each kept hash, in order of position: 8 for
the upper half of the hash, 2 for the distance from the kept position before (from -1 for the
first), which is `window` at most. Positions are therefore whole, and equal texts give equal strings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, tasks

K, WINDOW = 10, 23
BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> list[np.uint64]:
    out = [np.uint64(1)]
    for _ in range(n):
        out.append(np.uint64(int(out[-1]) * int(BASE) & 0xFFFFFFFFFFFFFFFF))
    return out


POWERS = powers(256)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of each k consecutive values (k <= 256), by joining hashes of halves."""
    h, size = points.astype(np.uint64) + np.uint64(1), 1
    with np.errstate(over="ignore"):
        while size < k:
            step = min(size, k - size)  # the right half may overlap the left one: the sum stays a function of the gram
            h = h[: len(h) - step] * POWERS[step] + h[step:] * (np.uint64(1) if step == size else BASE)
            size += step
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(32))) & np.uint64(0xFFFFFFFF)


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest of each `window` hashes, the rightmost on ties; of all if they are fewer."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    low = (hashes << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64))
    size, window = 1, min(window, n)
    while size < window:
        step = min(size, window - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    at = np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))
    return at[np.concatenate(([True], at[1:] != at[:-1]))].astype(np.int64)


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) kept of a text. A text shorter than k is one gram; an empty one has none.

    With fewer than 8 * window grams the window is an eighth of their number: what a longer window
    keeps, a shorter one keeps too, so the guarantee stays, and short texts have several hashes.
    """
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    hashes = gram_hashes(points, min(k, len(points)))
    at = kept(hashes, min(window, max(1, len(hashes) // 8)))
    return hashes[at].astype(np.uint32), at


def packed(hashes: np.ndarray, at: np.ndarray) -> str:
    out = np.empty((len(at), 5), np.uint8)
    out[:, :4] = hashes.astype(">u4").view(np.uint8).reshape(-1, 4)
    out[:, 4] = np.diff(at, prepend=-1)
    return out.tobytes().hex()


def unpacked(fingerprint: str) -> list[tuple[int, int]]:
    """(hash, position) of each kept gram of a fingerprint."""
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 5)
    return list(zip(raw[:, :4].copy().view(">u4").ravel().tolist(), (np.cumsum(raw[:, 4], dtype=np.int64) - 1).tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes, as sorted distinct arrays; 1 if both are empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, fingerprint) of each row; null text counts as empty and gives ''."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("")
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"), "n_chars": [len(t) for t in texts],
                "fingerprint": [packed(*winnow(t, k, window)) for t in texts],
            })

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(made, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, rows_per_bucket: int = 4096) -> DataFrame:
    """(bucket, own, doc_id, text): runs of descending doc_id, each followed by the row after it.

    Buckets are ranges of doc_id. A row is in its own bucket (own = true), and the first row of a
    bucket once more at the end of the bucket before it, where it serves as the next document of
    the last row there; the very first one follows the very last. So the texts are shuffled once,
    and neighbours meet without a sort of the whole table in one task. Bounds of buckets: one long
    for each rows_per_bucket documents, from approximate quantiles of the ids alone.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL")
    n = ids.count()
    cuts = max(1, min(10_000, n // rows_per_bucket))
    quantiles = F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)] or [0.5], 10 * cuts)
    bounds = np.array(sorted(set((ids.agg(quantiles.alias("q")).first()["q"] or []) if cuts > 1 else [])), dtype=np.int64)

    # buckets count down, so that ascending buckets hold descending ids; null ids come last, by themselves
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        known = ids.astype("Int64")
        at = len(bounds) - np.searchsorted(bounds, known.fillna(0).to_numpy(np.int64))
        return pd.Series(np.where(known.isna(), len(bounds) + 1, at))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("bucket", bucket("doc_id"))
    # one row for each bucket
    heads = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.max("doc_id")).collect())
    heads = [(at, head, heads[k - 1][0]) for k, (at, head) in enumerate(heads)]
    known = docs.sparkSession.createDataFrame(heads, "bucket int, head long, before int")
    rows = rows.join(F.broadcast(known), "bucket")
    places = F.array(F.struct("bucket", F.lit(True).alias("own")))
    ahead = F.array(F.struct(F.col("before").alias("bucket"), F.lit(False).alias("own")))
    leads = F.col("doc_id").eqNullSafe(F.col("head"))
    dealt = rows.select("doc_id", "text", F.explode(F.when(leads, F.concat(places, ahead)).otherwise(places)).alias("b"))
    dealt = dealt.select("b.bucket", "b.own", "doc_id", "text").repartition(max(tasks(docs.sparkSession), len(heads) // 2), "bucket")
    return dealt.sortWithinPartitions("bucket", F.desc("own"), F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text")))


def edited(text: str, nxt: str) -> str:
    """text with its last third replaced by the first as many code points of the next text, or all of them."""
    n = len(text) // 3
    return text[: len(text) - n] + nxt[:n]


def compared(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Each text's fingerprint against those of its edited text and of the next document.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next). Next: in
    descending doc_id, the first after the last; of rows with one id, in descending text hash. A
    lone row is its own next. Null texts count as empty; rows with null ids come last. Likeness is
    the Jaccard index of the kept hashes, 1 between two empty texts.
    """

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        last = None  # (bucket, id, text, fingerprint, hashes) that waits for its next
        for b in batches:
            out, size = [], 0
            for bucket, own, doc, text in zip(b["bucket"], b["own"], b["doc_id"].astype("Int64"), b["text"], strict=True):
                text = text if isinstance(text, str) else ""
                hashes, at = winnow(text, k, window)
                distinct = np.unique(hashes)
                if last is not None and last[0] == bucket:
                    _, other, before, fp, own_set = last
                    changed = edited(before, text)
                    h, p = winnow(changed, k, window)
                    out.append((other, len(before), changed, fp, packed(h, p), likeness(own_set, np.unique(h)), likeness(own_set, distinct)))
                    size += len(text)
                last = (bucket, doc, text, packed(hashes, at), distinct) if own else None
                if size > 1 << 20:
                    yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})
                    out, size = [], 0
            yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInPandas(made, schema)


def op7_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compared(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )
