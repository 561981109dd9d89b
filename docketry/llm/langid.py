"""Language ID by language-bitmask n-gram filters.

One Bloom filter for each language, all of one size and with the same hash functions, stored bit
by bit side by side: a position holds a mask of the languages whose filter has that bit. The AND of
the masks at an n-gram's positions is the mask of all languages that contain it. A text is scored
by how many of its n-grams each language contains; a filter with a share f of its bits set says
yes by chance to f ** HASHES of the others, and the counts are corrected for that. The largest
corrected count decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import small_batches, table

GRAM = 4
HASHES = 3
#: Positions of the filters, as a power of two.
BITS = 22
#: Positions that one task fills.
PART = 1 << 16
#: Labelled documents of each language that the filters are filled from, at most.
FIT_DOCS = 1500
#: A language contains an n-gram if it uses it at least this often against the language that uses it most.
RELATIVE = 0.25


@lru_cache(1)
def letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """Hashes of the n-grams of the lower-cased letters, runs of others being one space; none without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    if not len(points):
        return np.zeros(0, np.uint64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.uint64)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]  # the first of each run of others
    points = np.where(is_letter, points, 32)[keep].astype(np.uint64)
    pad = np.full(GRAM - 2, 32, np.uint64)
    points = np.concatenate((pad, points, pad))
    h = np.zeros(len(points) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(0x100000001B3) + points[k : k + len(h)] + np.uint64(1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def positions(h: np.ndarray) -> list[np.ndarray]:
    low = np.uint64(2**BITS - 1)
    return [(h >> np.uint64(k * (64 - BITS) // (HASHES - 1))) & low for k in range(HASHES)]


@dataclass
class Filters:
    """masks[word, position]: bit b of word w is language 64 * w + b, in the order of langs.

    With fewer than 64 languages the masks are of the smallest unsigned type that has a bit for each.
    """

    langs: list[str]
    masks: np.ndarray

    def chance(self) -> np.ndarray:
        """For each language, the share of unknown n-grams that its filter says yes to."""
        fill = [np.count_nonzero(self.masks[k // 64] & self.bit(k % 64)) / self.masks.shape[1] for k in range(len(self.langs))]
        return np.array(fill) ** HASHES

    def bit(self, b: int) -> np.unsignedinteger:
        return self.masks.dtype.type(1 << b)

    def counts(self, h: np.ndarray) -> np.ndarray:
        """How many of the n-grams each language contains, as the filters say."""
        at = positions(h)
        out = np.zeros(len(self.langs))
        for w in range(len(self.masks)):
            mask = self.masks[w][at[0]]
            for p in at[1:]:
                mask &= self.masks[w][p]
            for b in range(min(64, len(self.langs) - 64 * w)):
                out[64 * w + b] = np.count_nonzero(mask & self.bit(b))
        return out


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Filters:
    """Filters from the labelled rows of docs (doc_id, text, lang) that aren't held out.

    At most fit_docs whole texts of each language, the ones with the smallest hash of doc_id, so
    what is fitted is bounded and does not depend on the partitions. Languages are ordered by
    their number of labelled rows, which decides ties.
    """
    small_batches(docs.sparkSession)
    own = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    langs = [r["lang"] for r in counts]
    if not langs:
        return Filters([], np.zeros((1, 2**BITS), np.uint64))
    # hashes are even: below this one are about twice as many ids as wanted, so few reach the ranking
    most = {r["lang"]: min(2**63 - 1, -(2**63) + 2**64 * 2 * fit_docs // r["count"]) for r in counts}
    low = F.xxhash64("doc_id") <= F.create_map(*[F.lit(x) for pair in most.items() for x in pair])[F.col("lang")]
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    some = own.select("lang", "doc_id").filter(low).withColumn("rank", rank).filter(F.col("rank") <= fit_docs).select("doc_id").distinct()
    # fit_docs ids for each language at most
    sample = own.select("doc_id", "lang", "text").join(F.broadcast(some), "doc_id", "left_semi")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                gram, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n})

    n = sample.mapInPandas(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = n.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    n = n.join(F.broadcast(total), "lang")
    share = n.withColumn("share", F.col("n") / F.col("total")).withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    known = share.filter(F.col("share") >= RELATIVE * F.col("most")).select("lang", "gram")
    order = {lang: k for k, lang in enumerate(langs)}

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            k = b["lang"].map(order).to_numpy(np.int64)
            at = np.concatenate(positions(b["gram"].to_numpy(np.int64).view(np.uint64))).astype(np.int64)
            yield pd.DataFrame({"word": np.tile(k // 64, HASHES), "part": at // PART, "at": at % PART, "bit": np.tile(np.int64(1) << k % 64, HASHES)})

    kind = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.iinfo(t).bits), np.uint64)

    def filled(rows: pd.DataFrame) -> pd.DataFrame:
        mask = np.zeros(PART, np.int64)
        mask[rows["at"].to_numpy()] = rows["bit"].to_numpy()  # a row for each position
        return pd.DataFrame({"word": [rows["word"][0]], "part": [rows["part"][0]], "mask": [zlib.compress(mask.view(np.uint64).astype(kind).tobytes(), 1)]})

    rows = known.mapInPandas(placed, "word long, part long, at long, bit long").groupBy("word", "part", "at").agg(F.bit_or("bit").alias("bit"))
    masks = np.zeros((-(-len(langs) // 64), 2**BITS), kind)
    # the filters themselves: of fixed size for each 64 languages
    for r in rows.groupBy("word", "part").applyInPandas(filled, "word long, part long, mask binary").collect():
        masks[r["word"], r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(zlib.decompress(r["mask"]), kind)
    return Filters(langs, masks)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score, coverage) of each row, from its whole text alone.

    lang_pred: a language of the filters, or und if the text is null or has no letter (or no
    language was learned). score: the winner's share of all languages' corrected counts.
    coverage: its corrected count against the number of n-grams. Both are 0 for und.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = sent.value
        chance = f.chance()
        for b in batches:
            out = []
            for text in b["text"]:
                h = grams(text) if isinstance(text, str) else ()
                if not len(h) or not f.langs:
                    out.append(("und", 0.0, 0.0))
                    continue
                right = np.clip((f.counts(h) - len(h) * chance) / np.maximum(1 - chance, 1e-9), 0, len(h))
                best = int(right.argmax())
                out.append((f.langs[best], right[best] / max(right.sum(), 1e-9), right[best] / len(h)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "coverage"]).assign(doc_id=b["doc_id"].astype("Int64").array)[
                ["doc_id", "lang_pred", "score", "coverage"]
            ]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(made, "doc_id long, lang_pred string, score double, coverage double")


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, coverage) of every row of docs (doc_id, text, lang).

    Learns from labelled rows whose crc32(doc_id) mod 4 is not 2 and predicts all rows by text.
    Null labels, texts and ids are never learned from. Without labelled rows all is und. Repeated
    rows come out repeated; other columns are ignored.
    """
    out = predict(docs, fit(docs, fit_docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "coverage")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def keep_known(docs: DataFrame, filters: Filters, min_coverage: float = 0.25) -> DataFrame:
    """The rows of docs, all columns, whose text is in one of the languages.

    A row goes if its text is null or has no letter, or if less than min_coverage of its n-grams
    are known to the best language. Without learned languages only the texts without letters go.
    """
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        chance = f.chance()
        for b in batches:
            keep = []
            for text in b.column("text").to_pylist():
                h = grams(text or "")
                right = (f.counts(h) - len(h) * chance) / np.maximum(1 - chance, 1e-9) if len(h) and f.langs else np.array([len(h)])
                keep.append(bool(len(h)) and bool(right.max() >= min_coverage * len(h)))
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
