"""Chat formatting, spelling variants and phrases against brute force, with nulls, ties, repeats and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docketry.llm import chat, phrases, registry, variants

TURNS = "conv_id long, turn long, role string, text string"
DOC = "doc_id long, text string, lang string"
ODD = ["", "\\", "\\\\", "</turn>", "<turn>", "\\</turn>", "\\\\<turn>\\", "a</tur", "n>b", "<turn", "\n", "é<turn></turn>ü", "### Assistant: ok", "x" * 5000]


def folded(rows):
    """DIGEST by conversation from (conv_id, turn, role, text)."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    told = {}
    for conv, turns in out.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        told[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return told


def read_back(formatted):
    """(role, text) of each turn, one character after the other."""
    turns, k = [], 0
    while k < len(formatted):
        assert formatted.startswith("<turn>", k)
        k, fields, now = k + 6, [], []
        while True:
            if formatted[k] == "\\":
                now.append(formatted[k + 1])
                k += 2
            elif formatted[k] == "\n" and not fields:
                fields.append("".join(now))
                now, k = [], k + 1
            elif formatted.startswith("</turn>", k):
                turns.append((fields[0], "".join(now)))
                assert formatted[k + 7] == "\n"
                k += 8
                break
            else:
                now.append(formatted[k])
                k += 1
    return turns


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(ODD) + rng.choice(ODD)) for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(40, 1, "assistant", "b"), (40, 1, "assistant", "a"), (40, 1, "assistant", "a"), (40, None, "user", None), (40, 2, None, "x"), (40, 3, "us\ner\\", "y")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "z"), (-7, 5, "assistant", "later"), (50, 0, "assistant", "é" * 300_000)]
    return rows


def test_chats(spark, talk):
    turns = spark.createDataFrame(talk, TURNS).withColumns({"formatted": F.lit("x"), "piece": F.lit(1), "loss": F.lit(2)}).repartition(3)
    chats = chat.format_chats(turns)
    rows = chats.collect()
    want = folded(talk)
    assert len(rows) == len(want)
    for r in rows:
        read = read_back(r["formatted"])
        assert hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in read).encode()).hexdigest() == want[r["conv_id"]][1]
        assert (r["n_turns"], r["n_chars"]) == (len(read), len(r["formatted"]))
        raw = r["formatted"].encode()
        assert [re.sub(r"\\(.)", r"\1", raw[s["start"] : s["end"]].decode(), flags=re.S) for s in r["loss"]] == [t for role, t in read if role == "assistant"]
    got = {r["conv_id"]: r for r in chat.digests(chats).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    assert {c: r["formatted_chars"] for c, r in got.items()} == {r["conv_id"]: len(r["formatted"]) for r in rows}


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE_BYTES", 20_000)
    monkeypatch.setattr(chat, "STRETCH", 64)
    rng = random.Random(4)
    rows = [(1, t, "assistant" if t % 2 else "user", rng.choice(ODD[:12]) * 40) for t in range(2000)] + [(c, 0, "user", "hi") for c in range(2, 40)]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "100")
    try:
        chats = chat.format_chats(spark.createDataFrame(rows, TURNS).repartition(5)).cache()
        assert chats.filter("conv_id = 1").count() > 3
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chats).collect()}
        assert got == folded(rows)
    finally:
        spark.conf.unset(limit)


def test_chats_of_nothing(spark):
    none = chat.format_chats(spark.createDataFrame([], TURNS))
    assert none.collect() == [] and chat.digests(none).collect() == []


def test_parsing_rejects_torn_marks():
    with pytest.raises(ValueError, match="alternate"):
        chat.parsed(np.frombuffer(b"<turn>user\nx<turn>", np.uint8))


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def grouped(counts):
    out = {}
    for w, n in counts.items():
        own = sorted((-m, v) for v, m in counts.items() if near(w, v))
        form = own[0] if own and -own[0][0] >= 2 * n else None
        out[w] = (form and form[1], n, len(own), form and -form[0])
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (row[0], root, *row[1:])
    return out


@pytest.mark.parametrize("tile", [1024, 6, 1])
def test_variants(spark, monkeypatch, tile):
    monkeypatch.setattr(variants, "TILE", tile)  # small tiles: large groups are halved down to single places
    monkeypatch.setattr(variants, "PANEL", 16)
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 7))) for _ in range(700)} | {"a" * k for k in range(1, 30)} | {"b" * 300, "b" * 301, "b" * 150 + "a" + "b" * 150}
    counts = {w: rng.choice([1, 2, 3, 4, 8, 16, 100, 10**12]) for w in words}
    rows = [(w, n, "x") for w, n in counts.items()] + [(None, 3, "x"), ("", 9, "x")]
    got = variants.group_variants(spark.createDataFrame(rows, "word string, n long, form string").repartition(3))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got.collect()} == grouped(counts)


def test_no_variants(spark):
    assert variants.group_variants(spark.createDataFrame([], "word string, n long")).collect() == []
    alone = variants.group_variants(spark.createDataFrame([("alone", 1)], "word string, n long")).collect()
    assert [tuple(r) for r in alone] == [("alone", None, "alone", 1, 0, None)]


def test_long_chain_of_forms(spark):
    rows = [("a" * k, 2**k) for k in range(1, 40)]
    got = {r["word"]: r["root"] for r in variants.group_variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert set(got.values()) == {"a" * 39}


def test_variants_query(spark, tmp_path):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdÉéß×") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice([str.upper, str, str.capitalize])(rng.choice(base)) for _ in range(rng.randint(0, 400))) + "1x_Y", "en") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "fr"), (None, "abcde " * 9, None), (102, "ABCDE" * 30_000, "en"), (103, "straße œuvre Łódź", "en")]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for did, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if did is None else did}:{word}".encode())
            at = h % len(word)
            counts[word[:at] + word[at + 1 :] if h % 97 == 0 else word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    got = variants.op12_spelling_variants(spark, str(tmp_path)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == grouped(counts)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def mined(rows, most=4, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, most + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in found.items():
            score, cut = min((2000000 * a // (own[p[:k]] + own[p[k:]]), k) for k in range(1, len(p)))
            inside = any(100 * b >= 80 * a for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)))
            if not inside:
                scored.append((-score, -a, " ".join(p).encode(), own[p[:cut]], own[p[cut:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def told(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    words = ["the", "The", "cat", "sat", "on", "a", "mat", "é", "ü\xa0x", "rare\x1c", "New", "york", "city"]
    fixed = ["New York City hall", "on the mat", "aa aa aa aa aa", "x, y"]
    text = lambda: rng.choice(["", " ", "\t"]).join(rng.choice([*words, *fixed, ". ", "\n", "; "]) + " " for _ in range(rng.randint(1, 80)))
    rows = [(i, text(), rng.choice(["en", "en", "fr", None])) for i in range(150)]
    return [*rows, rows[0], (None, text(), "en"), (900, None, "en"), (901, "", "de"), (902, " \t.\n", "de"), (903, "one " * 40_000, "long")]


def test_phrases(spark, prose, monkeypatch):
    rows = spark.createDataFrame([(*r, 1, 2) for r in prose], DOC + ", rank int, n int").repartition(3)
    want = mined(prose)
    assert len(want) > 15
    assert told(phrases.collocations(rows)) == want
    for name, value in {"SIDE": 2, "DENSE": 3, "DIRECT": 2, "BLOCK_BYTES": 2000, "PART": 100, "HANDED": 7}.items():
        monkeypatch.setattr(phrases, name, value)  # many blocks, dense and sparse tiles
    assert told(phrases.collocations(rows)) == want
    assert told(phrases.collocations(rows, most=3, least=5, top=9)) == mined(prose, 3, 5, 9)


def test_ranks_are_limited_before_the_shuffle(spark, prose):
    plan = phrases.collocations(spark.createDataFrame(prose, DOC))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial and final


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([], DOC)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, "a b c", "en")], DOC)).collect() == []


def test_count_pairs(monkeypatch):
    monkeypatch.setattr(phrases, "DENSE", 50)
    rng = np.random.default_rng(2)
    a, b = (np.minimum(rng.geometric(0.001, 20_000), 90_000) for _ in range(2))
    a[:5], b[:5] = 200_000, 3_000_000
    x, y, n = phrases.count_pairs(a, b)
    assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == Counter(zip(a.tolist(), b.tolist(), strict=True))


@pytest.mark.parametrize("name", ["op11_chat_format", "op13_phrases"])
def test_against_duckdb(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    df = registry.queries()[name](spark, sf_dir)
    want = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(want.fetchall())
