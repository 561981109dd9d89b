"""SimHash near-dedup with vantage-point trees over the fingerprints.

Fingerprints are made once per text and grouped, so copies are one point with one representative.
A tree of vantage points, grown on a bounded sample, cuts Hamming space into shards: at each node
a point lies inside or outside of the node's median distance. By the triangle inequality a point
within `radius` of p can be on the other side only if p's own distance is within `radius` of the
median; p then visits that side too. Every pair within the radius therefore meets in the shard
that owns one of the two, where distances are computed exactly. Shards that are still large get a
subtree each, grown by tasks on the shard's own sample, so that the depth follows the number of points
while the driver holds the top only. Samples shape the shards, and never what is found.

A shard gives a spanning forest of its links and not all pairs, so the number of links follows the
number of points. Groups are the components of the forests, found by distributed star contraction.

With a similarity wanted, points are distinct word sequences, and links are the pairs whose sets of
word shingles are that similar or more, exactly. The tree finds the closest of them: what it links is
compared by whole sets, and gives the components to begin with. It can't find all: at a similarity of
0.8 a fingerprint differs in 13 of 64 bits, more than any vantage point tells apart. So points of
different components meet once more, where they share a band of min-hashes; so many bands are made that
a pair at the threshold shares none in one case of a million. Of the points that share a band the one that meets most others leads, so a family
of near copies comes together at its base, whatever the number of bands in which it meets. Whole sets
are compared with whole sets: a large group first with its leader, for those alike to it are one
component already; only the others are compared with all of the group, in cells of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import skew_join, table, tasks, written
from docketry.llm.decontam import gram_hashes, mixed
from docketry.llm.suffix_dedup import Bitmap

#: Distinct fingerprints that the top of the tree is grown on, at most; a quarter of them for each subtree.
SAMPLE = 8192
#: Points that a shard owns, about; beyond twice that it is cut into chunks that are queried apart.
SHARD = 4096
#: Levels of the top of the tree, which the driver grows: its size is bounded whatever the number of points.
TOP = 10
#: Levels of the subtrees that tasks grow inside of large shards, round by round until the tree is deep enough.
LEVELS = 8
#: Rows of a large shard that one task deals anew, about.
SALTED = 1 << 16
#: Levels are grown while at most this share of the sample would go to both sides of them.
BOTH_SIDES = 0.5
#: Min-hashes of a band, and the share of pairs at the threshold that may share no band.
BAND, MISSED = 3, 1e-6
#: Points and bytes of sets that a cell owns, at most about.
CELL_POINTS, CELL_BYTES = 1024, 8 << 20


def shingle_hashes(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """XXH64 of the word shingles, repeats included, and the words, lower-cased and joined."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, 42)] if found else [], dtype="<u8"), joined
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1 :], strict=False)], dtype="<u8"), joined


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 without any."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 65536):
        part = hashes[k : k + 65536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int) -> int:
    """The SimHash of the word shingles; 0 for a text without words."""
    return simhash(shingle_hashes(text, words)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row; fp holds the 64 bits of the fingerprint."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "fp": fp})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(made, "doc_id long, fp long")


def shingle_sets(text: str | None, words: int) -> tuple[np.ndarray, bytes]:
    """Sorted distinct hashes of the word shingles, made from the hashes of the words, and the words, lower-cased and joined."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    own = np.array([xxhash.xxh3_64_intdigest(w) for w in found], dtype=np.uint64)
    return np.unique(gram_hashes(own, min(words, len(own)))) if found else own, b" ".join(found)


def band_keys(hashes: np.ndarray, bands: int) -> np.ndarray:
    """A key of each band of min-hashes of a set; none of an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    factors = np.random.default_rng(42).integers(0, 2**63, bands * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(bands * BAND, 2**64 - 1, np.uint64)
    for k in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[k : k + 2048, None] * factors[None, :]).min(axis=0))
    key = np.arange(bands, dtype=np.uint64)
    for part in low.reshape(bands, BAND).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + part)
    return key.view(np.int64)


@dataclass(frozen=True)
class Alike:
    """When two sets are alike: a cosine or a Jaccard index of `least` or more, in whole numbers."""

    least: Fraction
    measure: str = "cosine"

    def __post_init__(self):
        if self.measure not in ("cosine", "jaccard"):
            raise ValueError(f"unknown measure: {self.measure}")

    @property
    def bands(self) -> int:
        """So many that MISSED of the pairs at the threshold share none; a cosine of c has a Jaccard index of c * c or more."""
        index = float(self.least) ** (2 if self.measure == "cosine" else 1)
        return math.ceil(math.log(MISSED) / math.log1p(-(index**BAND))) if index < 1 else 1

    def pairs(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """For sizes n of rows and m of columns, which pairs are alike, by the number of common members."""
        c, t, u = common.astype(np.int64), self.least.numerator, self.least.denominator
        if self.measure == "cosine":
            return (c * u) ** 2 >= t * t * (n[:, None] * m[None, :])
        return c * (t + u) >= t * (n[:, None] + m[None, :])


def profiles(docs: DataFrame, words: int, alike: Alike) -> DataFrame:
    """(doc_id, id, fp, n, keys) of every row; id is a hash of the words, fp and n are of distinct shingles, keys of the bands."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b["text"]:
                hashes, joined = shingle_sets(t, words)
                out.append((name(joined), np.uint64(simhash(hashes)).astype(np.int64), len(hashes), band_keys(hashes, alike.bands)))
            yield pd.DataFrame(out, columns=["id", "fp", "n", "keys"]).assign(doc_id=b["doc_id"].astype("Int64").array)[["doc_id", "id", "fp", "n", "keys"]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(made, "doc_id long, id long, fp long, n long, keys array<long>")


def name(joined: bytes) -> int:
    """The id of a text: a hash of its words."""
    return xxhash.xxh3_64_intdigest(joined) - 2**63


def grow(sample: np.ndarray, depth: int, radius: int) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """Vantage points and median distances of a full tree, children of node k at 2k+1 and 2k+2, and its depth."""
    points, medians = np.zeros(2**depth - 1, np.uint64), np.zeros(2**depth - 1, np.int64)
    rng, held = np.random.default_rng(42), [sample]
    for level in range(depth):
        below, both = [], 0
        for k, own in enumerate(held, 2**level - 1):
            if not len(own):
                below += [own, own]
                continue
            tried = own[rng.integers(0, len(own), 8)]
            d = np.bitwise_count(own[None, :] ^ tried[:, None]).astype(np.int64)
            best = int(d.std(axis=1).argmax())  # the vantage point that spreads the others most
            points[k], medians[k] = tried[best], int(np.median(d[best]))
            inside = d[best] <= medians[k]
            both += int(((d[best] - radius <= medians[k]) & (d[best] + radius > medians[k])).sum())
            below += [own[inside], own[~inside]]
        if both > BOTH_SIDES * len(sample):
            return (points[: 2**level - 1], medians[: 2**level - 1]), level
        held = below
    return (points, medians), depth


def route(fps: np.ndarray, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int) -> tuple[np.ndarray, ...]:
    """Owner shard of each fingerprint, and (row, shard) of all shards within the radius, its own included."""
    points, medians = tree
    owner = np.zeros(len(fps), np.int64)
    row, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for _ in range(depth):
        owner = 2 * owner + 2 - (np.bitwise_count(fps ^ points[owner]) <= medians[owner])
        d = np.bitwise_count(fps[row] ^ points[node]).astype(np.int64)
        inside, outside = d - radius <= medians[node], d + radius > medians[node]
        row, node = np.concatenate((row[inside], row[outside])), np.concatenate((2 * node[inside] + 1, 2 * node[outside] + 2))
    first = 2**depth - 1
    return owner - first, row, node - first


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component under links a-b."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        while not (label[label] == label).all():
            label = label[label]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of links a-b that connect what all of them connect, about one for each node, and the nodes' components."""
    label, left, taken = np.arange(n), np.arange(len(a)), []
    while True:
        x, y = label[a[left]], label[b[left]]
        apart = x != y
        if not apart.any():
            return np.concatenate([np.zeros(0, np.int64), *taken]), label
        left, x, y = left[apart], x[apart], y[apart]
        some = left[np.union1d(np.unique(x, return_index=True)[1], np.unique(y, return_index=True)[1])]  # one for each component
        taken.append(some)
        label = components(n, np.concatenate((np.arange(n), a[some])), np.concatenate((label, b[some])))


def shard_links(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links of each (shard, chunk), whose rows come with the owned points first.

    Held at a time: the owned points of one chunk, their groups so far, and one batch of visitors.
    """
    key, owned, label, kept = None, [], None, None
    for batch in batches:
        for at, rows in batch.groupby(["shard", "chunk"], sort=False):
            if at != key:
                key, owned, label = at, [], None
            own = rows["visits"].to_numpy() == 0
            if own.any():
                owned.append(rows[own])
            guests = rows[~own]
            if not len(guests) or not owned:
                continue
            if label is None:
                kept = pd.concat(owned)
                label, fps, ids = np.arange(len(kept)), kept["fp"].to_numpy().view(np.uint64), kept["id"].to_numpy()
            for k in range(0, len(guests), 256):
                some = guests.iloc[k : k + 256]
                names = some["id"].to_numpy()
                d = np.bitwise_count(some["fp"].to_numpy().view(np.uint64)[:, None] ^ fps[None, :])
                i, j = np.nonzero(d <= radius)
                apart = names[i] != ids[j]
                i, j = i[apart], j[apart]
                if not len(i):
                    continue
                first = np.unique(i * len(kept) + label[j], return_index=True)[1]  # a guest and one point of each group near it
                i, j = i[first], j[first]
                told, joint = forest(len(kept) + len(some), label[j], i + len(kept))
                yield pd.DataFrame({"a": names[i[told]], "b": ids[j[told]]})
                label = joint[: len(kept)][label]


def places(rows: pd.DataFrame, tree: tuple[np.ndarray, np.ndarray], depth: int, radius: int) -> Iterator[pd.DataFrame]:
    """rows (visits, id, fp) with the shard of the tree that owns them, and once more for each that they visit.

    Of two owned points, the one whose shard has the lower number visits the other, so each pair meets
    once; rows that visit the whole tree go to all shards within the radius.
    """
    for k in range(0, len(rows), 4096):
        some = rows.iloc[k : k + 4096]
        owner, row, shard = route(some["fp"].to_numpy(np.int64).view(np.uint64), tree, depth, radius)
        guest = some["visits"].to_numpy() == 1
        later = guest[row] | (shard > owner[row])
        for at, place, visits in ((np.flatnonzero(~guest), owner[~guest], 0), (row[later], shard[later], 1)):
            yield some.iloc[at].assign(place=place, visits=visits)


def regrown(batches: Iterator[pd.DataFrame], levels: int, radius: int) -> Iterator[pd.DataFrame]:
    """Rows of shards dealt anew by a subtree of each, grown on the shard's sample, which comes first.

    Held at a time: one sample, one subtree and one batch.
    """
    key, sample, tree = None, [], None
    for batch in batches:
        for at, rows in batch.groupby(["shard", "salt"], sort=False):
            if at != key:
                key, sample, tree = at, [], None
            sampled = rows["visits"].to_numpy() < 0
            if sampled.any():
                sample.append(rows["fp"].to_numpy(np.int64)[sampled])
            rest = rows[~sampled]
            if not len(rest):
                continue
            if tree is None:
                tree, depth = grow(np.concatenate(sample).view(np.uint64), levels, radius)
            for out in places(rest, tree, depth, radius):
                yield out.assign(shard=out["shard"] * 2**levels + out["place"])[["shard", "visits", "id", "fp"]]


def shard_sizes(rows: DataFrame) -> DataFrame:
    """(shard, own, n): the points that each shard owns, and all of its rows."""
    return written(rows.groupBy("shard").agg(F.count_if(F.col("visits") == 0).alias("own"), F.count("*").alias("n")), "shards")


def split(rows: DataFrame, levels: int, radius: int) -> DataFrame:
    """rows (shard, visits, id, fp) with shards of twice SHARD points and more cut by subtrees of so many levels."""
    spark, out = rows.sparkSession, ["shard", "visits", "id", "fp"]
    sizes = shard_sizes(rows).withColumn("salts", F.when(F.col("own") > 2 * SHARD, F.ceil(F.col("n") / SALTED)))
    rows = written(skew_join(rows, sizes, "shard", "n"), "sized")
    kept = rows.filter("salts IS NULL").withColumn("shard", F.shiftleft("shard", levels)).select(*out)
    rows = rows.filter("salts IS NOT NULL")
    first = Window.partitionBy("shard").orderBy(F.xxhash64("id"), "id")
    sample = rows.filter("visits = 0").withColumn("at", F.row_number().over(first)).filter(F.col("at") <= SAMPLE // 4)
    sample = sample.withColumns({"salt": F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)), "visits": F.lit(-1)})
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts"))).select("salt", *out).unionByName(sample.select("salt", *out))
    dealt = dealt.repartition(tasks(spark), "shard", "salt").sortWithinPartitions("shard", "salt", "visits", "id")
    return kept.unionByName(dealt.mapInPandas(lambda it: regrown(it, levels, radius), kept.schema))


def links(points: DataFrame, radius: int) -> DataFrame:
    """(a, b) links of points (fp, and id where that is not their name) of distinct fp: pairs that link, with the components of all."""
    spark = points.sparkSession
    n = points.count()
    levels = max(0, int(np.log2(max(1, n / SHARD)) + 0.999))
    depth = min(levels, TOP)
    rows = points.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(SAMPLE).collect() if depth else []
    tree, depth = grow(np.array([r["fp"] for r in rows], dtype=np.int64).view(np.uint64), depth, radius)

    def routed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for out in places(b.assign(visits=0), tree, depth, radius):
                yield out.rename(columns={"place": "shard"})[["shard", "visits", "id", "fp"]]

    rows = points.select("id" if "id" in points.columns else F.col("fp").alias("id"), "fp").mapInPandas(routed, "shard long, visits int, id long, fp long")
    rows = written(rows, "routed")
    for _ in range(-(-max(0, levels - TOP) // LEVELS)):
        rows = written(split(rows, LEVELS, radius), "routed")
    # few shards are larger than a task likes, as a rule none: only these are cut
    large = shard_sizes(rows).filter(F.col("own") > 2 * SHARD).select("shard", F.ceil(F.col("own") / (2 * SHARD)).alias("chunks"))
    large = written(large, "large-shards")
    one = F.lit(1).cast("long")
    rows = rows.withColumn("chunks", one) if large.isEmpty() else rows.join(large, "shard", "left").withColumn("chunks", F.coalesce("chunks", one))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), "chunks"))
    # owned points come to their own chunk and, like visitors of all, compare themselves with that and the later ones
    start = F.when(F.col("visits") == 0, F.col("own")).otherwise(F.lit(0).cast("long"))
    met = F.transform(F.sequence(start, F.col("chunks") - 1), lambda c: F.struct(c.alias("chunk"), F.lit(1).alias("visits")))
    held = F.array(F.struct(F.col("own").alias("chunk"), F.lit(0).alias("visits")))
    dealt = rows.select("shard", "id", "fp", F.inline(F.when(F.col("visits") == 0, F.concat(held, met)).otherwise(met)))
    dealt = dealt.repartition(max(tasks(spark), n // (4 * SHARD)), "shard", "chunk").sortWithinPartitions("shard", "chunk", "visits")
    return dealt.mapInPandas(lambda it: shard_links(it, radius), "a long, b long")


class Cell:
    """Points that a cell owns, with their sets by member, and the groups that they form so far."""

    def __init__(self, ids: np.ndarray, sets: list[np.ndarray]):
        self.ids, self.sets, self.sizes = ids, sets, np.array([len(x) for x in sets])
        member, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        by = np.argsort(member, kind="stable")
        self.members, self.start = np.unique(member[by], return_index=True)
        self.start, self.owner = np.append(self.start, len(member)), owner[by]
        self.label = np.arange(len(sets))

    def owners(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in at, owner) of each owner of the members at."""
        n = self.start[at + 1] - self.start[at]
        return np.repeat(np.arange(len(at)), n), self.owner[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def common(self, guests: list[np.ndarray]) -> np.ndarray:
        """How many members each guest's set has in common with each owned one.

        Members of few points are counted one by one, the others as products of small 0-1 matrices.
        """
        member, row = np.concatenate(guests), np.repeat(np.arange(len(guests)), [len(x) for x in guests])
        at = np.minimum(np.searchsorted(self.members, member), len(self.members) - 1)
        held = self.members[at] == member
        at, row = at[held], row[held]
        few = self.start[at + 1] - self.start[at] < 16
        place, owner = self.owners(at[few])
        shape = (len(guests), len(self.sets))
        out = np.bincount(row[few][place] * shape[1] + owner, minlength=shape[0] * shape[1]).reshape(shape).astype(np.float32)
        at, row = at[~few], row[~few]
        shared = np.unique(at)
        for k in range(0, len(shared), 2048):
            part = shared[k : k + 2048]
            ours, theirs = np.zeros((len(part), shape[1]), np.float32), np.zeros((shape[0], len(part)), np.float32)
            ours[self.owners(part)] = 1
            own = (at >= part[0]) & (at <= part[-1])
            theirs[row[own], np.searchsorted(part, at[own])] = 1
            out += theirs @ ours
        return out

    def met(self, ids: np.ndarray, guests: list[np.ndarray], alike: Alike) -> pd.DataFrame:
        """(a, b): links that connect the guests with the groups of owned points in which they have one that is alike."""
        i, j = np.nonzero(alike.pairs(self.common(guests), np.array([len(x) for x in guests]), self.sizes))
        other = ids[i] != self.ids[j]
        i, j = np.unique(np.stack((i[other], self.label[j[other]])), axis=1)
        told, joint = forest(len(self.ids) + len(ids), j, i + len(self.ids))
        self.label = joint[: len(self.ids)][self.label]
        return pd.DataFrame({"a": ids[i[told]], "b": self.ids[j[told]]})


def cell_links(batches: Iterator[pd.DataFrame], alike: Alike) -> Iterator[pd.DataFrame]:
    """Links of each (leader, chunk), whose rows (leader, chunk, visits, id, held) come with the owned points first.

    Held at a time: the owned points of one cell, and one batch of visitors.
    """
    key, owned, cell = None, [], None

    def sets(rows: pd.DataFrame) -> list[np.ndarray]:
        return [np.frombuffer(x, np.uint64) for x in rows["held"]]

    def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k in range(0, len(rows), 256):
            some = rows.iloc[k : k + 256]
            yield cell.met(some["id"].to_numpy(), sets(some), alike)

    def closed() -> Iterator[pd.DataFrame]:  # the owned points among each other
        nonlocal cell
        rows = pd.concat(owned)
        cell = Cell(rows["id"].to_numpy(), sets(rows))
        yield from compared(rows)

    for batch in batches:
        for at, rows in batch.groupby(["leader", "chunk"], sort=False):
            if at != key:
                if owned and cell is None:
                    yield from closed()
                key, owned, cell = at, [], None
            own = rows["visits"].to_numpy() == 0
            if own.any():
                owned.append(rows[own])
            guests = rows[~own]
            if len(guests) and owned:
                if cell is None:
                    yield from closed()
                yield from compared(guests)
    if owned and cell is None:
        yield from closed()


def led(batches: Iterator[pd.DataFrame], alike: Alike) -> Iterator[pd.DataFrame]:
    """(leader, id, alike) of rows (leader, chunk, visits, id, held), where each chunk begins with its leader."""
    key, cell = None, None
    for batch in batches:
        for at, rows in batch.groupby(["leader", "chunk"], sort=False):
            sets = [np.frombuffer(x, np.uint64) for x in rows["held"]]
            ids = rows["id"].to_numpy()
            if at != key:
                key, cell = at, Cell(ids[:1], sets[:1])
            near = np.zeros(len(ids), bool)
            for k in range(0, len(ids), 1024):
                near[k : k + 1024] = alike.pairs(cell.common(sets[k : k + 1024]), np.array([len(x) for x in sets[k : k + 1024]]), cell.sizes)[:, 0]
            member = rows["visits"].to_numpy() == 0
            yield pd.DataFrame({"leader": rows["leader"].to_numpy()[member], "id": ids[member], "alike": near[member]})


def shingled(docs: DataFrame, words: int, wanted: Bitmap) -> DataFrame:
    """(id, held) of the texts whose id may be wanted: their sets of shingles, once each."""

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        told: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"]:
                joined = b" ".join((t or "").encode("utf-8", "surrogatepass").lower().split())
                if (own := name(joined)) not in told and wanted.has(np.array([own]))[0]:
                    told.add(own)
                    out.append((own, shingle_sets(t, words)[0].tobytes()))
            yield pd.DataFrame(out, columns=["id", "held"])

    return docs.select("text").mapInPandas(made, "id long, held binary").groupBy("id").agg(F.first("held").alias("held"))


def near(points: DataFrame, radius: int) -> DataFrame:
    """(leader, id, size): pairs of points (id, fp, n) within the radius, by the tree, and each leader with itself."""
    held = points.filter("n > 0").select("id", "fp", F.col("n").alias("size"))
    shown = written(held.groupBy("fp").agg(F.min("id").alias("leader"), F.count("*").alias("n")), "shown")
    found = links(shown.select(F.col("leader").alias("id"), "fp"), radius).select(F.col("b").alias("leader"), F.col("a").alias("id"))
    # texts of one fingerprint are one point of the tree
    same = skew_join(held.select("id", "fp"), shown.filter("n > 1"), "fp", "n").filter("id <> leader").select("leader", "id")
    pairs = written(found.unionByName(same).distinct(), "near")
    return pairs.unionByName(pairs.select("leader", F.col("leader").alias("id")).distinct()).join(held.select("id", "size"), "id").select("leader", "id", "size")


def in_cells(member: DataFrame) -> DataFrame:
    """member (leader, id, root, size) with its group's chunks, its own chunk and its leader's root; groups of one root go."""
    bounds = F.greatest(F.count("*") / CELL_POINTS, F.sum("size") * 8 / CELL_BYTES)
    sizes = member.groupBy("leader").agg(
        F.count("*").alias("n"), F.ceil(bounds).alias("chunks"), F.max(F.when(F.col("id") == F.col("leader"), F.col("root"))).alias("lead_root"),
        (F.min("root") < F.max("root")).alias("open"),
    )
    sizes = written(sizes, "cells").filter("open").drop("open")
    rows = skew_join(member, sizes, "leader", "n").withColumn("own", F.pmod(F.xxhash64("id"), "chunks"))
    return written(rows.select("leader", "chunks", "own", "id", "root", "lead_root", "size"), "dealt")


def similar(docs: DataFrame, points: DataFrame, words: int, alike: Alike, radius: int) -> DataFrame:
    """(a, b) links of distinct points (id, fp, n, keys): the same components as all pairs that are alike and share a band.

    A pair at the threshold shares none in MISSED of all cases, more alike ones in far fewer. What the tree finds
    within the radius of fingerprints is linked ahead, where it is alike, so that bands only join its components.
    """
    spark = docs.sparkSession
    held = points.select("id", F.col("n").alias("size"), F.explode("keys").alias("key"))
    shared = held.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(skew_join(held, written(shared, "shared-keys"), "key", "n"), "met")
    # the point that meets most others leads those that share a key
    often = met.groupBy("id").agg(F.sum("n").alias("often"))
    lead = met.join(often, "id").groupBy("key").agg(F.max(F.struct("often", "id")).alias("l"), F.first("n").alias("n"))
    lead = written(lead.select("key", "n", F.col("l.id").alias("leader")), "leaders")
    member = written(skew_join(met.drop("n"), lead, "key", "n").select("leader", "id", "size").distinct(), "members")
    by_tree = written(near(points, radius), "by-tree")
    sets = written(shingled(docs, words, Bitmap(member.select("id").union(by_tree.select("id")).distinct(), "id")), "sets")

    def dealt(rows: DataFrame) -> DataFrame:
        """rows (leader, chunk, visits, id, size) with their sets, a chunk's together, sorted by visits."""
        bytes_ = rows.agg(F.sum("size")).first()[0] or 0
        out = rows.join(sets, "id").repartition(max(tasks(spark), 8 * bytes_ >> 25), "leader", "chunk").sortWithinPartitions("leader", "chunk", "visits")
        return out.select("leader", "chunk", "visits", "id", "held")

    def meet_leaders(rows: DataFrame) -> DataFrame:
        """(leader, id, alike) of the points of another root than their leader's."""
        first = rows.filter("id = leader").select("leader", F.explode(chunks).alias("chunk"), F.lit(-1).alias("visits"), "id", "size")
        first = first.unionByName(rows.filter("root <> lead_root").select("leader", F.col("own").alias("chunk"), F.lit(0).alias("visits"), "id", "size"))
        return written(dealt(first).mapInPandas(lambda it: led(it, alike), "leader long, id long, alike boolean"), "led")

    chunks = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    known = meet_leaders(in_cells(by_tree.withColumn("root", F.col("id")))).filter("alike").select(F.col("leader").alias("a"), F.col("id").alias("b"))
    roots = written(connected(known), "roots")
    rows = in_cells(member.join(roots, member["id"] == roots["node"], "left").select("leader", "id", F.coalesce("root", "id").alias("root"), "size"))
    large = rows.filter("chunks > 1")
    # in a large group all points meet the leader first: those alike to it are one component, and need no other comparison
    told = meet_leaders(large)
    # the others are compared with all of their group: they visit the cells of all
    far = told.filter("NOT alike").select("leader", "id")
    rest = large.join(far.select("leader").distinct(), "leader", "left_semi")
    guests = large.join(far, ["leader", "id"], "left_semi").select("leader", F.explode(F.filter(chunks, lambda c: c != F.col("own"))).alias("chunk"), F.lit(1).alias("visits"), "id", "size")
    owned = rows.filter("chunks = 1").unionByName(rest).select("leader", F.col("own").alias("chunk"), F.lit(0).alias("visits"), "id", "size")
    found = dealt(owned.unionByName(guests)).mapInPandas(lambda it: cell_links(it, alike), "a long, b long")
    return found.unionByName(told.filter("alike").select(F.col("leader").alias("a"), F.col("id").alias("b"))).unionByName(known)


def connected(found: DataFrame) -> DataFrame:
    """(node, root) of every node in the links (a, b); the root is the component's smallest node.

    Alternating large-star and small-star rounds, each written, until nothing changes.
    """
    edges = written(found.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        # large star: neighbours above a node move to its smallest neighbour
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: neighbours below a node, and the node, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = written(small.distinct(), "links")
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (mark["n"], mark["s"]) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = (mark["n"], mark["s"])


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, similarity: float | None = None, measure: str = "cosine") -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs, which needs doc_id and text.

    fp: the SimHash of word shingles of the lower-cased text as a long. component_id: the smallest
    doc_id reachable over fingerprints at `radius` or fewer differing bits, itself included. A text
    that is null, empty or blank has fingerprint 0 and links like any other.

    With a similarity, there is no fp, the radius tells what the tree looks for ahead of the bands, and texts link that have the same words
    or whose sets of shingles have that cosine (what a SimHash estimates) or, as the measure says,
    that Jaccard index. A text without words is then like those without words only.

    Repeated rows come out repeated. Null ids have their text linked, but are no candidates for
    component_id, which is null where a component has no other. No rows give no rows. Other columns
    are ignored.
    """
    alike = None if similarity is None else Alike(Fraction(str(similarity)), measure)
    if alike is None:
        rows = fingerprints(docs, words).select("doc_id", F.col("fp").alias("id"))
    else:
        rows = profiles(docs, words, alike)
    rows = written(rows, "fingerprints")
    same = [F.first(c).alias(c) for c in rows.columns if c not in ("doc_id", "id")]
    points = written(rows.groupBy("id").agg(F.min("doc_id").alias("first_id"), *same), "points")
    roots = connected(links(points.select("id", F.col("id").alias("fp")), radius) if alike is None else similar(docs, points, words, alike, radius))
    named = points.join(roots, points["id"] == roots["node"], "left").select("id", "first_id", F.coalesce("root", "id").alias("root"))
    named = written(named, "named")
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    # groups of copies may be large on both sides: what has one member is most of it, and needs no join
    named = skew_join(named, written(smallest.join(named.groupBy("root").agg(F.count("*").alias("n")), "root"), "groups"), "root", "n").select("id", "component_id")
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    out = skew_join(rows.select("doc_id", "id"), written(named.join(counts, "id"), "classes"), "id", "n")
    return out.select("doc_id", *([] if alike else [F.col("id").alias("fp")]), "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
