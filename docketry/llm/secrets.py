"""Secret scans over a ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger holds the (blob, rule, version)
pairs that were scanned and the findings hold the spans by blob, so a batch scans only the pairs
that are new; a version that is already known, under whatever path, costs a hash and a join.
Findings are then joined back to all paths that hold the blob.

Offsets are code points, end exclusive. DataFrame and SQL functions only.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketry.llm.common import listed, scratch, table, without, written


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of pattern whose group is at least `least` code points long.

    pattern uses no look-around, anchor or back-reference: a match may then be found by its text.
    """

    kind: str
    pattern: str
    group: int
    least: int
    version: int = 1


KEYWORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
RULES = (
    Rule("assign", rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # a run shorter than 32 is dropped, and a longer one is one match: the count can be in the pattern
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
LEDGER = "blob binary, kind string, version int"
FINDINGS = "blob binary, kind string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def spans(texts: DataFrame, rule: Rule) -> DataFrame:
    """FINDINGS of one rule in (blob, text).

    The pieces between the matches and the matches alternate, so a running sum of their lengths
    gives the offsets: one pass over a text, however many matches it has.
    """
    found = texts.filter(F.col("text").rlike(rule.pattern)).select(
        "blob",
        F.posexplode(F.arrays_zip(
            F.split("text", rule.pattern, -1).alias("gap"), F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0)).alias("hit"),
        )).alias("i", "m"),
    ).filter(F.col("m.hit").isNotNull())
    size = F.char_length("m.hit")
    upto = F.sum(F.char_length("m.gap") + size).over(Window.partitionBy("blob").orderBy("i"))
    wanted = F.char_length(F.regexp_extract("m.hit", rule.pattern, rule.group)) >= rule.least
    return found.withColumn("end", upto).filter(wanted).select(
        "blob", F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"),
        (F.col("end") - size).cast("long").alias("start"), F.col("end").cast("long").alias("end"),
    )


def addresses(versions: DataFrame, key: str, *more: Column) -> DataFrame:
    """(key, text_h, blob, ...): a version is known by its key and a hash of its text."""
    return versions.select(F.col(key).alias("key"), F.xxhash64("text").alias("text_h"), blob_of(F.col("text")).alias("blob"), *more)


class BlobLedger:
    """What was scanned, and what was found, below a folder that a later session can open again.

    Each call of scan() adds a table of findings and then one of pairs. A crash between the two
    leaves pairs out, never findings; they are then scanned again, and equal findings count once.
    """

    def __init__(self, spark: SparkSession, rules: tuple[Rule, ...] = RULES, folder: str | None = None):
        self.spark, self.rules, self.folder = spark, rules, folder or scratch(spark, "blob-ledger")
        whole = lambda kind: [p for x in listed(spark, f"{self.folder}/{kind}") if "_SUCCESS" in listed(spark, p := f"{self.folder}/{kind}/{x}")]
        self.pairs, self.tables = whole("pairs"), whole("findings")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self) -> DataFrame:
        return self._read(self.pairs, LEDGER)

    def findings(self) -> DataFrame:
        return self._read(self.tables, FINDINGS)

    def with_rules(self, *rules: Rule) -> BlobLedger:
        """The same ledger under other rules or rule versions."""
        return BlobLedger(self.spark, rules, self.folder)

    def scan(self, versions: DataFrame, key: str = "doc_id", addressed: DataFrame | None = None) -> None:
        """Scans the unseen (blob, rule version) pairs of (key, text); addressed: their addresses, where they are known.

        One path stands for each blob, the smallest key that holds it; null if none has a key. Where most texts
        are unseen all are searched where they lie, and only those with a match meet the unseen pairs; where
        few are, these alone are fetched and searched.
        """
        told = versions.select(F.col(key).alias("key"), F.xxhash64("text").alias("text_h"), "text")
        addressed = written(addresses(versions, key), "addressed") if addressed is None else addressed
        one = addressed.groupBy("blob").agg(F.min(F.struct("key", "text_h")).alias("p"))
        wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in self.rules])
        pairs = one.select("p.key", "p.text_h", "blob", F.explode(wanted).alias("r")).select("key", "text_h", "blob", "r.kind", "r.version")
        if self.pairs:
            pairs = pairs.join(self.ledger(), ["blob", "kind", "version"], "left_anti")
        pairs = written(pairs, "unseen")
        todo = pairs.groupBy(F.col("key").alias("k"), F.col("text_h").alias("h"), "blob").agg(F.collect_set("kind").alias("kinds"))
        same = F.col("key").eqNullSafe(F.col("k")) & (F.col("text_h") == F.col("h"))
        hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(r.pattern), F.lit(r.kind)) for r in self.rules]))
        # faster rule by rule than as one alternation, which is tried in full at each place
        any_rule = reduce(or_, [F.col("text").rlike(r.pattern) for r in self.rules])
        first = self.rules[0]
        if 2 * pairs.filter((F.col("kind") == first.kind) & (F.col("version") == first.version)).count() > addressed.count():
            told = told.filter(any_rule).join(todo, same)
        else:
            told = told.join(todo, same).filter(any_rule)
        # most texts have no match at all: only those that do are written for the passes by rule
        texts = told.withColumn("hits", hits).select("blob", "text", F.array_intersect("hits", "kinds").alias("hits")).filter("size(hits) > 0")
        texts = written(texts, "to-scan").dropDuplicates(["blob"])
        found = spans(texts.filter(F.array_contains("hits", first.kind)), first)
        for r in self.rules[1:]:
            found = found.unionByName(spans(texts.filter(F.array_contains("hits", r.kind)), r))
        at = f"{len(self.pairs):06d}-{uuid.uuid4().hex}"
        self.tables.append(f"{self.folder}/findings/{at}")
        found.write.parquet(self.tables[-1])
        self.pairs.append(f"{self.folder}/pairs/{at}")
        pairs.select("blob", "kind", "version").write.parquet(self.pairs[-1])


def scan_secrets(docs: DataFrame, ledger: BlobLedger | None = None, batches: int = 2) -> DataFrame:
    """docs with spans: array<struct<start, end, kind>> of each text, in order, from the ledger.

    The rows come to the ledger in batches, dealt by a hash of doc_id, as new versions come day by day:
    a text that an earlier batch or session has brought is not scanned again. Null ids and null texts,
    which count as empty, are scanned like any other. Copies and repeated rows are scanned once and
    all get the findings. No rows give no rows. A column of docs named spans is replaced.
    """
    ledger = ledger or BlobLedger(docs.sparkSession)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")
    seen = written(addresses(docs, "doc_id", batch.alias("batch")), "addressed", "batch")  # texts are hashed once
    for b in range(batches):
        ledger.scan(docs.filter(batch == b), addressed=seen.filter(F.col("batch") == b))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in ledger.rules]), F.col("kind"))
    now = F.array(*[F.concat_ws(":", F.lit(r.kind), F.lit(str(r.version))) for r in ledger.rules])
    found = ledger.findings().filter(F.array_contains(now, F.concat_ws(":", "kind", F.col("version").cast("string"))))
    by_blob = found.groupBy("blob").agg(
        F.transform(
            F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "end", "kind"))),
            lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")),
        ).alias("spans")
    )
    # findings go back to all paths of their blob, and paths are known by their key and a hash of their text
    paths = seen.join(by_blob, "blob").select(F.col("key").alias("__key"), F.col("text_h").alias("__h"), "spans")
    paths = written(paths.dropDuplicates(["__key", "__h"]), "findings-by-path")
    docs = without(docs, "spans")
    out = docs.join(paths, docs["doc_id"].eqNullSafe(F.col("__key")) & (F.xxhash64(docs["text"]) == F.col("__h")), "left").drop("__key", "__h")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, kind: STRING>>)")
    return out.withColumn("spans", F.coalesce("spans", none))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    told = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return out.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(told, 256).alias("base_sha256"), told.alias("spans"),
    )


def _found(kind: str, rank: int) -> str:
    rule = next(r for r in RULES if r.kind == kind)
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, '{kind}' AS kind, {rank} AS rank, hit,
         sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS "end"
  FROM (SELECT doc_id, unnest(string_split_regex(t, '{p}')) AS gap, unnest(regexp_extract_all(t, '{p}')) AS hit,
               generate_subscripts(string_split_regex(t, '{p}'), 1) AS i
        FROM texts WHERE regexp_matches(t, '{p}'))
  WHERE hit IS NOT NULL"""


ORACLE = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(_found(r.kind, k) for k, r in enumerate(RULES))}),
kept AS (
  SELECT doc_id, kind, rank, CAST("end" - length(hit) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM found
  WHERE kind <> 'assign' AND length(hit) >= 16
     OR kind = 'assign' AND length(regexp_extract(hit, '{RULES[0].pattern.replace("'", "''")}', 2)) >= 8),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts t LEFT JOIN told USING (doc_id)
"""
