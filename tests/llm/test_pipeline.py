"""The pipeline against a brute-force version, stage by stage, and its queries' registration."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import __spark_entry__ as entry
from docketry.llm import simhash
from docketry.llm.common import table, written
from docketry.llm.simhash import near_duplicates


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def key(x):
    return lower(x.strip(" \t\n\x0b\f\r"))


def shingles(t, k=5):
    w = t.encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def with_letters(docs):
    return {d: t for d, t in docs.items() if any(c.isalpha() for c in t or "")}


def without_lines(docs):
    held = defaultdict(set)
    for d, t in docs.items():
        for x in t.split("\n"):
            held[key(x)].add(d)
    return {d: "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == d) for d, t in docs.items()}


def without_near(docs, similarity=0.8, measure="cosine"):
    sets, low = {d: shingles(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(d):
        while low[d] != d:
            d = low[d]
        return d

    for a in docs:
        for b in docs:
            both, n, m = len(sets[a] & sets[b]), len(sets[a]), len(sets[b])
            if a < b and (both**2 >= similarity**2 * n * m if measure == "cosine" else both >= similarity * (n + m - both)):
                x, y = sorted((root(a), root(b)))
                low[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def clean(docs, items):
    windows, kept = set(), {}
    for t in items:
        w = words(t)
        n = min(13, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    for d, t in docs.items():
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        if not hit or 20 * len(hit) < len(w):
            kept[d] = t
    return kept


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, items = docs.columns, [r["text"] for r in table(spark, sf_dir, "benchmark").collect()]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        got = {r["doc_id"]: r["text"] for r in docs.collect()}
        brute = {"language": with_letters, "lines": without_lines, "near_dedup": without_near, "decontaminated": lambda x: clean(x, items), "mixed": dict}
        assert got == brute[name](before), name
        assert docs.columns[:5] == columns and (docs.columns == columns or name == "mixed")
        before = got
    assert docs.filter("n_chars <> char_length(text)").count() == 0


def pairs_at_the_edge(longer):
    """Pairs of texts of n and more shingles, all of the shorter text's among them: at the threshold, and one shingle below it."""
    word, texts, at = [f"w{k}" for k in range(900)], {}, 1
    for n in (16, 32, 48, 240):
        for m in (longer(n), longer(n) + 1):
            texts[at] = " ".join(f"{at}{w}" for w in word[: n + 4])
            texts[at + 1] = " ".join(f"{at}{w}" for w in word[: m + 4])
            at += 2
    return texts


@pytest.mark.parametrize("measure", ["cosine", "jaccard"])
def test_near_duplicates_are_decided_exactly(spark, sf_dir, measure):
    def kept(docs):
        groups = near_duplicates(docs, words=5, similarity=0.8, measure=measure)
        return {r["doc_id"] for r in groups.filter("doc_id = component_id").collect()}

    texts = pairs_at_the_edge((lambda n: n * 25 // 16) if measure == "cosine" else (lambda n: n * 5 // 4))
    assert kept(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")) == set(texts) - {2, 6, 10, 14}
    docs = table(spark, sf_dir, "documents")
    assert kept(docs) == set(without_near({r["doc_id"]: r["text"] for r in docs.collect()}, 0.8, measure))


def test_near_duplicates_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_POINTS", 8)  # a family of near copies is then cut into many cells
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    texts = {k: " ".join(w if rng.random() > 0.03 else f"x{rng.randrange(9999)}" for w in base) for k in range(150)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"] for r in near_duplicates(docs, words=5, similarity=0.8).filter("doc_id = component_id").collect()}
    assert got == set(without_near(texts))


def test_near_duplicates_come_through_the_tree(spark, monkeypatch):
    """Without any band, the tree links what is near in fingerprints and alike, over many shards."""
    profiles = simhash.profiles
    monkeypatch.setattr(simhash, "profiles", lambda *a: profiles(*a).withColumn("keys", F.array().cast("array<long>")))
    monkeypatch.setattr(simhash, "SHARD", 16)
    rng = random.Random(7)
    texts = {k: [f"w{rng.randrange(5000)}" for _ in range(400)] for k in range(150)}
    for k in range(40):  # copies with one word changed
        texts[200 + k] = [*texts[k][:200], "changed", *texts[k][201:]]
    texts = {k: " ".join(t) for k, t in texts.items()}
    fp = {k: simhash.simhash(simhash.shingle_sets(t, 5)[0]) for k, t in texts.items()}
    near = {200 + k for k in range(40) if (fp[k] ^ fp[200 + k]).bit_count() <= 2}
    assert near and all((fp[a] ^ fp[b]).bit_count() > 2 for a in texts for b in texts if a < b and b - a != 200)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = near_duplicates(docs, words=5, similarity=0.8).filter("doc_id <> component_id").collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: k - 200 for k in near}


def test_what_the_tree_finds_is_decided_exactly(spark):
    """With all points near each other in the tree, only alike ones link, and none is lost."""
    texts = pairs_at_the_edge(lambda n: n * 25 // 16) | {90: "", 91: None, 92: " "}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r["doc_id"] for r in near_duplicates(docs, words=5, radius=64, similarity=0.8).filter("doc_id = component_id").collect()}
    assert got == set(texts) - {2, 6, 10, 14, 91, 92}


def test_odd_rows_survive(spark, sf_dir):
    rows = [(None, None, None, None, None), (None, "again and the same text", "en", None, 3), (1, "", "en", "s", 0), (2, "the same text again and again", "en", "s", 1), (2, "the same text again and again", "en", "s", 1), (3, "the same text again and again", None, None, 2), (4, "12 34", "fr", "s", 5)]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, component_id string, h int, d int")
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect()) == [(0, "again and the same text")] + [(2, "the same text again and again")] * 2


def test_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
