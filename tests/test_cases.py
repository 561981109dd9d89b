"""Properties and edge cases on small hand-written tables."""

import datetime as d
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketry.functions import ids
from docketry.functions.expiry import RULES, alive
from docketry.functions.patterns import running
from docketry.functions.forms import Labels, aligned
from docketry.operators import aggregates, containing, deid, dictionary, joins, parsing, retention, select, sets, windows
from docketry.plans.queries import QUERIES
from docketry.schemas import PIECE_KEY, PRESETS
from docketry.sources import exports, readers
from docketry.sources.manifest import Manifest

TEXTS = [
    (1, 1, "CPF 123.456.789-09, CNPJ 12.345.678/0001-95, OAB/CE 12345, processo 0001234-56.2020.8.06.0001."),
    (1, 2, "RG nº 1234567 e registro geral: 12.345.678-9; protocolo 7654321; CEP 60000-000; NIT 123.45678.90-1."),
    (2, 3, "Fone (85) 99999-1234, e-mail ana@x.com.br, em 01/02/2020, Lei nº 9.099/1995, prazo de 15 dias."),
    (2, 4, ""),
    (3, 5, None),
]


@pytest.fixture
def texts(spark):
    return of_case(spark.createDataFrame(TEXTS, "case_no bigint, piece_id bigint, text string"))


def of_case(df, tenant=1, degree=1):
    """df with a whole case key: the same court and degree for all its numbers."""
    return df.withColumns({"tenant": F.lit(tenant).cast("bigint"), "degree": F.lit(degree).cast("bigint")})


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_patterns_and_offsets(texts):
    by_piece = {p: t for _, p, t in TEXTS}
    found = deid.detect_patterns(texts).collect()
    assert {r["kind"] for r in found} == {"cpf", "cnpj", "oab", "cnj", "cep", "nit", "phone", "email"}
    for r in found:
        assert by_piece[r["piece_id"]][r["start"] : r["end"]] == r["value"]


def test_rg_only_beside_a_label(texts):
    assert rows(deid.detect_rg(texts), "piece_id", "value") == [(2, "12.345.678-9"), (2, "1234567")]


def test_dates_laws_and_deadlines_are_preserved(texts):
    numbers = deid.detect_patterns(texts, {"number": "[0-9]+"})
    kept = deid.drop_preserved(numbers, texts)
    assert not {r["value"] for r in kept.filter("piece_id = 3").collect()} & {"01", "02", "2020", "9", "099", "1995", "15"}


def test_resolve_spans(spark):
    spans = [(1, 1, "a", "v", 0, 10), (1, 1, "b", "v", 2, 5), (1, 1, "c", "v", 9, 20), (1, 1, "d", "v", 20, 22), (1, 2, "a", "v", 0, 4), (1, 2, "a", "v", 0, 4)]
    df = of_case(spark.createDataFrame(spans, "case_no bigint, piece_id bigint, kind string, value string, start bigint, end bigint"))
    assert rows(deid.resolve_spans(df), "piece_id", "start", "end") == [(1, 2, 5), (1, 20, 22), (1, 9, 20), (2, 0, 4)]
    assert deid.resolve_spans(df.limit(0)).count() == 0


LABELS = [(1, "p", "Ana", "[P_1]"), (1, "p", "Anabela", "[P_2]"), (1, "x", "a.b*(c)$", "[X_1]"), (1, "x", "Ana Silva", "[X_10]")]


def test_mask_and_unmask(spark):
    labels = of_case(spark.createDataFrame(LABELS, "case_no bigint, kind string, value string, label string"))
    text = [(1, 1, "Ana e Anabela viram Anabel; Ana Silva disse a.b*(c)$ hoje"), (2, 2, "Ana fica"), (1, 3, None)]
    df = of_case(spark.createDataFrame(text, "case_no bigint, piece_id bigint, text string"))
    masked = deid.mask(df, labels)
    got = {r["piece_id"]: r["masked"] for r in masked.collect()}
    assert got == {1: "[P_1] e [P_2] viram Anabel; [X_10] disse [X_1] hoje", 2: "Ana fica", 3: None}
    back = {r["piece_id"]: r["unmasked"] for r in deid.unmask(masked, labels).collect()}
    assert back == {p: t for _, p, t in text}


def test_barrier_refuses_the_whole_turn(spark):
    out = spark.createDataFrame([(1, 1, "tudo bem"), (1, 2, "fala de Ana Silva aqui"), (2, 3, "Ana Silva")], "case_no bigint, turn bigint, text string")
    out = of_case(out)
    labels = of_case(spark.createDataFrame(LABELS, "case_no bigint, kind string, value string, label string"))
    hits = deid.barrier_hits(out, labels)
    assert rows(hits, "turn", "value", "at") == [(2, "Ana Silva", 9), (2, "Ana", 9)]
    assert rows(deid.barrier(out, hits, ["turn"]), "turn") == [(1,), (3,)]
    free = spark.createDataFrame([(1, "ana silva"), (None, "ana")], "case_no bigint, value_norm string")
    free = of_case(free)
    assert deid.barrier_hits(out, labels, free).count() == 0


def test_global_barrier(spark):
    out = spark.createDataFrame([(1, "x dois três quatro y"), (2, "abc"), (3, "doistrês quatro"), (4, None), (5, "xum dois três")], "turn bigint, text string")
    values = spark.createDataFrame([("dois três quatro",), ("b",), ("um dois trê",), ("",), (None,)], "value string")
    assert rows(deid.global_hits(out, values, ["turn"]), "turn", "value", "at") == [(1, "dois três quatro", 3), (2, "b", 2), (5, "um dois trê", 2)]


def test_model_hook(spark, texts):
    import pandas as pd

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"tenant": b["tenant"], "degree": b["degree"], "case_no": b["case_no"], "piece_id": b["piece_id"], "kind": "org", "value": "X", "start": 0, "end": 1})

    assert deid.detect_model(texts, fn).count() == 5


def test_approval_gate(spark):
    pieces = of_case(spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 2, 3), (1, 3, 4), (2, 1, 1), (2, 3, 4)], "case_no bigint, turn bigint, piece_id bigint"))
    sent, approved = pieces.filter("piece_id = 1 AND case_no = 1"), pieces.filter("piece_id IN (2, 4) AND case_no = 1")
    other = of_case(spark.createDataFrame([(2, 1), (2, 4)], "case_no bigint, piece_id bigint"), tenant=9)  # another account's
    gate = deid.approval_gate(pieces, sent.select(*PIECE_KEY).unionByName(other), approved)
    assert rows(gate, "case_no", "turn", "passes") == [(1, 1, True), (1, 2, False), (1, 3, True), (2, 1, False), (2, 3, False)]
    assert rows(deid.approval_gate(pieces, sent, approved, require=False), "passes") == [(True,)] * 5


def test_cpf(spark):
    df = spark.createDataFrame([("12345678909",), ("123.456.789-09",), ("12345678908",), ("11111111111",), ("123",), (None,), ("x",)], "c string")
    assert [r[0] for r in df.select(ids.cpf_valid(F.col("c"))).collect()] == [True, True, False, False, False, False, False]


def test_name_norm(spark):
    assert spark.range(1).select(ids.name_norm(F.lit("  JOSÉ   da\tConceição "))).first()[0] == "jose da conceicao"


def test_presets_hold_no_document(spark):
    df = spark.createDataFrame([(1, "2020", "c", "n", "q", "cpf")], "case_no int, hour string, type string, name string, qualification string, cpf string")
    for preset in PRESETS:
        assert "cpf" not in select.project_allowed(df, preset).columns
    assert set(select.project_allowed(df, "triage").columns) == {"case_no"}


def test_retention_edges(spark):
    now = d.datetime(2024, 1, 31)
    one = d.timedelta(microseconds=1)
    ttl = [(k, now - d.timedelta(hours=RULES["drafts"].hours) + x) for k, x in (("at", 0 * one), ("inside", one), ("outside", -one))] + [("null", None)]
    df = spark.createDataFrame(ttl, "k string, ts timestamp_ntz")
    assert rows(df.filter(alive(F.col("ts"), "drafts", F.lit(now).cast("timestamp_ntz"))), "k") == [("inside",)]
    ties = spark.createDataFrame([(1, now, i) for i in range(12)], "tenant int, ts timestamp_ntz, id int")
    assert rows(retention.retain(ties, "drafts", F.lit(now).cast("timestamp_ntz")), "id") == sorted([(i,) for i in range(2, 12)], key=repr)
    assert rows(retention.retain(ties, "templates", F.lit(now).cast("timestamp_ntz")), "id") == sorted([(i,) for i in range(12)], key=repr)


def test_tags_apply_then_undo(spark):
    cases = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["x"])], "case_no bigint, tags array<string>")
    cases = of_case(cases)
    changes = spark.createDataFrame([(1, ["b", "c"], ["a"]), (2, ["c"], ["c"]), (3, ["c"], None)], "case_no bigint, add array<string>, remove array<string>")
    changes = of_case(changes)
    done = sets.apply_tags(cases, changes)
    assert rows(done, "case_no", "tags") == [(1, ["b", "c"]), (2, []), (3, ["c"]), (4, ["x"])]
    log = sets.tag_changes(cases, changes, "r")
    assert rows(log, "case_no", "tag", "outcome") == [(1, "a", "removed"), (1, "c", "placed"), (3, "c", "placed")]
    back = sets.undo_tags(done, log, "r")
    assert rows(back, "case_no", "tags") == [(1, ["a", "b"]), (2, []), (3, []), (4, ["x"])]


def test_auto_tag_bounds(spark):
    g = d.datetime(2024, 1, 1)
    h = d.timedelta(hours=48)
    res = [(1, "before", g - d.timedelta(seconds=1)), (1, "in", g + h - d.timedelta(seconds=1)), (1, "at", g + h), (1, "late", g + h + d.timedelta(seconds=1)), (2, "none", g)]
    out = joins.auto_tag(spark.createDataFrame(res, "batch_id int, k string, ts timestamp_ntz"), spark.createDataFrame([(1, g)], "batch_id int, granted_ts timestamp_ntz"))
    assert rows(out, "k") == [("at",), ("in",)]


def test_compare_days_ago(spark):
    day = lambda n: d.date(2024, 1, 1) + d.timedelta(days=n - 1)
    df = spark.createDataFrame([(1, "v", "b", day(n), n) for n in (1, 2, 5, 31, 40, 70)] + [(2, "v", "b", day(9), 9)], "tenant int, view string, board string, day date, n bigint")
    assert rows(windows.compare_days_ago(df, 30, 5), "n", "before") == [(1, None), (2, None), (31, 1), (40, 5), (5, None), (70, 40), (9, None)]


def test_case_list_rejects(spark, tmp_path):
    (tmp_path / "list.csv").write_text("case_no\n0001-23\n12.3\n\nabc\n1,2,3\n0001-23\n")
    good, bad = readers.read_case_list(spark, str(tmp_path))
    assert rows(good, "case_no") == [("000123",), ("123",)]
    assert rows(bad, "line") == [("1,2,3",), ("abc",)]


def test_plain_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("um\ndois")
    (tmp_path / "b.md").write_text("")
    (tmp_path / "c.bin").write_text("x")
    assert rows(readers.read_plain(spark, f"{tmp_path}/*"), "text") == [("um\ndois",)]


def test_html_to_text(spark):
    html = "<html><style>p{}</style><script>var t='</p>'</script><!-- x --><p>a &amp; b&nbsp;c</p>\n<p>d</p></html>"
    assert spark.range(1).select(readers.html_to_text(F.lit(html))).first()[0] == "a & b c d"
    assert spark.range(1).select(readers.html_to_text(F.lit(None).cast("string"))).first()[0] == ""


@pytest.mark.parametrize(("html", "want"), [
    ("caf&#233; caf&#xE9; caf&#Xe9; caf&eacute; a&ccedil;&atilde;o", "café café café café ação"),
    ("&amp;#233; &#38;lt; &#38;amp; &amp;amp;", "&#233; &lt; &amp; &amp;"),
    ("&#128220; &#x1F4DC; &#8212;", "📜 📜 —"),
    ("[&#0;] [&#xD800;] [&#x110000;] [&#99999999999999999999;] [&#00065;]", "[\ufffd] [\ufffd] [\ufffd] [\ufffd] [A]"),
    ("a & b &unknown; &#; &#xg; AT&T; a&nbsp;&nbsp;b", "a & b &unknown; &#; &#xg; AT&T; a b"),
    ("&lt;p&gt;", "<p>"),
])
def test_html_references(spark, html, want):
    assert spark.createDataFrame([(html,)], "html string").select(readers.html_to_text(F.col("html"))).first()[0] == want


def test_notes_files(spark):
    one = {"tenant": 1, "degree": 1, "case_no": 1, "piece_id": 2, "note_id": 3, "text": "a", "sender_code": "s1", "created_ts": "2024-01-01"}
    lines = [json.dumps(one), json.dumps(one | {"sender_name": "Ana"}), json.dumps(one | {"sender_code": None}), "{broken", "", None]
    good, bad = parsing.check_notes(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert good.count() == 2 and bad.count() == 4
    later = good.withColumns({"created_ts": F.lit("2024-02-01"), "text": F.lit("b")})
    other = good.withColumn("sender_code", F.lit("s2"))
    assert rows(retention.merge_notes(good, later.unionByName(other)), "sender_code", "text") == [("s1", "b"), ("s2", "a")]


def test_parse_analysis_broken(spark):
    df = spark.createDataFrame([(1, '{"situation": "x", "alerts": ["a"]}'), (2, "nope"), (3, None)], "case_no int, j string")
    assert rows(parsing.parse_analysis(df, "j"), "case_no", "situation", "alerts") == [(1, "x", ["a"]), (2, None, None), (3, None, None)]


def test_citations(spark):
    folios = of_case(spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 1, 1)], "case_no bigint, piece_id bigint, folio int"))
    cited = of_case(spark.createDataFrame([(1, 1, 1), (1, 1, 9), (1, 2, 0), (1, None, 0), (2, 1, 1)], "case_no bigint, piece_id bigint, folio int"))
    marked = of_case(spark.createDataFrame([(1, 1), (1, 1)], "case_no bigint, piece_id bigint"))
    marked = marked.unionByName(of_case(spark.createDataFrame([(2, 1)], "case_no bigint, piece_id bigint"), tenant=2))  # marked by another account
    out = joins.check_citations(cited, folios, marked)
    assert rows(out, "case_no", "piece_id", "folio", "status") == [
        (1, 1, 1, "ok"), (1, 1, 9, "unresolved"), (1, 2, 0, "unselected"), (1, None, 0, "unresolved"), (2, 1, 1, "unselected"),
    ]


def test_estimate_gate(spark):
    few = spark.createDataFrame([(i, 400) for i in range(10)], "case_no int, n_chars bigint")
    row = aggregates.estimate_work(few).first()
    assert (row["n_cases"], float(row["cost"]), row["confirm"]) == (10, 0.0005, False)
    assert aggregates.estimate_work(few.unionByName(few)).first()["confirm"]
    assert aggregates.estimate_work(few.limit(0)).first()["confirm"] is False


def test_exports_hold_no_party(spark, tmp_path):
    case = spark.createDataFrame([(1, "c", "q", ["t"], "Ana", "1")], "case_no int, class string, queue string, tags array<string>, name string, cpf string")
    assert set(exports.export_list(case).columns) == {"case_no", "class", "queue", "tags"}
    exports.write_list(case, str(tmp_path / "list"))
    assert "Ana" not in "".join(p.read_text() for p in (tmp_path / "list").glob("*.csv"))


def test_snapshot_overwrites_one_tenant(spark, tmp_path):
    table = Manifest(spark, str(tmp_path / "cases"))
    schema = "case_no int, tenant int"
    retention.replace_snapshot(spark.createDataFrame([(1, 1), (2, 2), (9, None)], schema), table)
    retention.replace_snapshot(spark.createDataFrame([(3, 1)], schema), table)
    assert rows(table.read(), "case_no", "tenant") == [(2, 2), (3, 1), (9, None)]
    retention.replace_snapshot(spark.createDataFrame([], schema), table)
    assert table.read().count() == 3


def broken(spark, df):
    """df whose write fails halfway, in some tasks only."""
    fails = F.udf(lambda x: 1 // (x % 5 - 4) if x % 5 == 4 else x, "int")
    return df.repartition(4).withColumn("id", fails("id"))


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    table = Manifest(spark, str(tmp_path / "actions"))
    with pytest.raises(FileNotFoundError):
        table.read()
    ts = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, id)")
    old = spark.range(20).select(F.lit(1).alias("tenant"), F.col("id").cast("int").alias("id"), ts.alias("ts"))
    table.replace(old)
    before = rows(table.read(), "id", "ts")
    with pytest.raises(Exception, match="(?i)zero"):
        table.replace(broken(spark, old))
    with pytest.raises(Exception, match="(?i)zero"):
        retention.replace_snapshot(broken(spark, old), table)
    assert rows(table.read(), "id", "ts") == before and table.version() == 1
    retention.retain_table(table, "drafts", F.lit("2024-01-12").cast("timestamp_ntz"))
    assert rows(table.read(), "id") == sorted([(i,) for i in range(10, 20)], key=repr)  # ten newest of a week
    table.replace(table.read())
    assert len([p for p in (tmp_path / "actions").iterdir() if p.name.startswith("part-")]) == 2  # a reader's, and the newest


def test_a_second_writer_is_refused(spark, tmp_path):
    table = Manifest(spark, str(tmp_path / "t"))
    table.replace(spark.range(3))
    part = table.write(spark.range(5))
    version = table.version
    Manifest(spark, table.path).replace(spark.range(4))
    table.version = lambda: version() - 1  # as it was when this writer began
    with pytest.raises(RuntimeError, match="another writer"):
        table.commit([part], spark.range(1).schema)
    assert Manifest(spark, table.path).read().count() == 4


def test_answers_are_asked_once(spark, tmp_path):
    import pandas as pd

    asked, ledger = tmp_path / "asked", f"file://{tmp_path}/ledger"
    asked.mkdir()

    def fn(batches):
        for b in batches:
            for n, what in zip(b["case_no"], b["what"], strict=True):
                (asked / f"{n}-{what}-{random.random()}").touch()
                if what == "fatal":
                    raise ValueError("the provider is down")
            yield pd.DataFrame({"tenant": b["tenant"], "degree": b["degree"], "case_no": b["case_no"], "answer": "on " + b["what"]})

    def bundles(n, what="a"):
        return of_case(spark.range(n).select(F.col("id").alias("case_no"), F.lit(what).alias("what"))).coalesce(1)

    with pytest.raises(Exception, match="provider is down"):
        parsing.analyse(bundles(30).unionByName(bundles(1, "fatal").withColumn("case_no", F.lit(99).cast("long"))).coalesce(1), fn, ledger=ledger).count()
    first = len(list(asked.iterdir()))
    assert first == 31  # in one task: 28 answers are kept, the last ones are lost with the failure
    assert rows(parsing.analyse(bundles(30), fn, ledger=ledger), "case_no", "answer") == sorted([(n, "on a") for n in range(30)], key=repr)
    assert len(list(asked.iterdir())) == first + 2
    assert parsing.analyse(bundles(30), fn, ledger=ledger).count() == 30
    assert len(list(asked.iterdir())) == first + 2  # nothing new, nothing asked
    changed = parsing.analyse(bundles(3, "b"), fn, ledger=ledger)
    assert rows(changed, "case_no", "answer") == [(0, "on b"), (1, "on b"), (2, "on b")]
    assert len(list(asked.iterdir())) == first + 5
    assert parsing.analyse(bundles(0), fn, ledger=ledger).count() == 0


def test_analyse_hook(spark):
    import pandas as pd

    def fn(batches):
        for b in batches:
            yield pd.DataFrame({"tenant": b["tenant"], "degree": b["degree"], "case_no": b["case_no"], "answer": "{}"})

    out = parsing.analyse(of_case(spark.range(20).withColumnRenamed("id", "case_no")), fn, at_once=99)
    assert out.count() == 20 and out.rdd.getNumPartitions() <= 7


def test_empty_tables(spark):
    none = of_case(spark.createDataFrame([], "case_no bigint, piece_id bigint, text string"))
    assert deid.detect_patterns(none).count() == 0
    cases = spark.createDataFrame([], "tenant bigint, degree bigint, case_no bigint, queue string, tags array<string>, arrival date")
    assert sets.oldest_cases(cases, "x", 5).count() == 0
    assert aggregates.queue_counts(cases).count() == 0


def test_register_finds_all_forms_and_places(spark):
    text = "JOSÉ  da\tConceição (123.456.789-01), 12345678901; jose da conceicao. Josefa da Conceição, x12345678901, 123 456 789 - 01"
    texts = of_case(spark.createDataFrame([(1, 1, text), (2, 2, text)], "case_no bigint, piece_id bigint, text string"))
    parties = spark.createDataFrame([(1, "José da Conceiçao", "12345678901"), (1, None, None), (2, "Ana (*)", "")], "case_no bigint, name string, cpf string")
    parties = of_case(parties)
    got = deid.detect_register(texts, parties).collect()
    assert all(text[r["start"] : r["end"]] == r["value"] for r in got)
    assert sorted((r["case_no"], r["kind"], r["value"]) for r in got) == sorted(
        [(1, "person", v) for v in ("JOSÉ  da\tConceição", "jose da conceicao")] + [(1, "number", v) for v in ("123.456.789-01", "12345678901", "123 456 789 - 01")]
    )


KEY = "tenant bigint, degree bigint, case_no bigint"


def test_cases_of_one_number_stay_apart(spark):
    both = [(1, 1, 7), (2, 1, 7), (1, 2, 7)]
    cases = spark.createDataFrame([(*k, "q", ["a"]) for k in both], f"{KEY}, queue string, tags array<string>")
    texts = spark.createDataFrame([(*k, i, "fala de Ana Silva") for i, k in enumerate(both)], f"{KEY}, piece_id bigint, text string")
    first = cases.filter("tenant = 1 AND degree = 1")
    left = retention.forget_case({"pieces": texts}, first)["pieces"]
    assert rows(left, "tenant", "degree") == [(1, 2), (2, 1)]
    labels = spark.createDataFrame([(1, 1, 7, "Ana Silva", "[P_1]")], f"{KEY}, value string, label string")
    assert {(r["tenant"], r["degree"]): r["masked"] for r in deid.mask(texts, labels).collect()} == {(1, 1): "fala de [P_1]", (2, 1): "fala de Ana Silva", (1, 2): "fala de Ana Silva"}
    assert deid.barrier_hits(texts.withColumnRenamed("piece_id", "turn"), labels).count() == 1
    changes = first.select("tenant", "degree", "case_no", F.array(F.lit("b")).alias("add"), F.array(F.lit("a")).alias("remove"))
    assert {(r["tenant"], r["degree"]): r["tags"] for r in sets.apply_tags(cases, changes).collect()} == {(1, 1): ["b"], (2, 1): ["a"], (1, 2): ["a"]}


def test_two_changes_of_a_case_are_one(spark):
    cases = of_case(spark.createDataFrame([(1, ["a"], "q")], "case_no bigint, tags array<string>, queue string"))
    changes = of_case(spark.createDataFrame([(1, ["b"], None), (1, ["c"], ["a"])], "case_no bigint, add array<string>, remove array<string>"))
    assert rows(sets.apply_tags(cases, changes), "tags") == [(["b", "c"],)]
    assert rows(joins.preview(cases, changes), "before", "after") == [(["a"], ["b", "c"])]
    exits = spark.createDataFrame([("q", "x", True, "to x"), ("q", "x", False, "nowhere"), ("q", "y", True, "to y"), ("q", "z", False, "to z")], "queue string, exit string, batch boolean, to_queue string")
    moves = of_case(spark.createDataFrame([(1, "y"), (1, "x"), (1, "z")], "case_no bigint, exit string"))
    assert rows(sets.move_cases(cases, moves, exits), "queue") == [("to x",)]


def test_only_the_last_analysis_counts(spark):
    day = d.date(2024, 1, 9)
    cases = of_case(spark.createDataFrame([(1, day), (2, None)], "case_no bigint, last_mov date"))
    seen = of_case(spark.createDataFrame([(1, d.date(2024, 1, 1), d.date(2024, 1, 2)), (1, day, d.date(2024, 1, 10)), (2, None, day)], "case_no bigint, last_mov_seen date, analysed date"))
    assert joins.needs_analysis(cases, seen).count() == 0


def test_matches_of_rows_with_one_key(spark):
    df = of_case(spark.createDataFrame([(1, 1, "x 1234 y"), (1, 1, "a longer text with 99")], "case_no bigint, piece_id bigint, text string"))
    assert rows(deid.detect_patterns(df, {"n": "[0-9]+"}), "value", "start", "end") == [("1234", 2, 6), ("99", 19, 21)]


def test_labels_are_not_masked(spark):
    labels = of_case(spark.createDataFrame([(1, "123.456.789-09", "[CPF_1]"), (1, "CPF", "[X_1]"), (1, "", "[Y_1]")], "case_no bigint, value string, label string"))
    df = of_case(spark.createDataFrame([(1, 1, "CPF 123.456.789-09, CPF")], "case_no bigint, piece_id bigint, text string"))
    masked = deid.mask(df, labels)
    assert rows(masked, "masked") == [("[X_1] [CPF_1], [X_1]",)]
    assert rows(deid.unmask(masked, labels), "unmasked") == [("CPF 123.456.789-09, CPF",)]


def test_global_hits_know_the_case(spark):
    out = spark.createDataFrame([(1, 1, 1, 1, "the secret word"), (2, 1, 9, 1, "clean"), (1, 1, 1, 2, "clean"), (1, 1, None, 1, "secret")], f"{KEY}, turn bigint, text string")
    hits = deid.global_hits(out, spark.createDataFrame([("secret",)], "value string"))
    assert rows(hits, "tenant", "turn", "value", "at") == [(1, 1, "secret", 5)]
    assert rows(deid.barrier(out, hits).dropna(), "tenant", "turn") == [(1, 2), (2, 1)]


def test_many_short_values_in_one_pass(spark):
    values = spark.range(100_000).select(F.format_string("v%06d", "id").alias("value"))
    texts = [(k, "x " + " ".join(f"v{i * 7:06d}!" for i in range(k, k + 40)) + " v99 é") for k in range(50)]
    out = of_case(spark.createDataFrame([(1, k, t) for k, t in texts], "case_no bigint, turn bigint, text string"))
    want = sorted((k, f"v{i * 7:06d}", t.index(f"v{i * 7:06d}") + 1) for k, t in texts for i in range(k, k + 40))
    assert sorted((r["turn"], r["value"], r["at"]) for r in deid.global_hits(out, values).collect()) == want


@pytest.mark.parametrize("gram", [1, 2, 6])
def test_containing_by_brute_force(spark, monkeypatch, gram):
    monkeypatch.setattr(containing, "GRAM", gram)
    rng = random.Random(gram)
    word = lambda n: "".join(rng.choice("abé😀 ") for _ in range(rng.randint(0, n)))
    texts = [(k, word(40)) for k in range(60)] + [(60, None), (61, "")]
    values = [word(9) for _ in range(80)] + [None, "a", "a", "a" * 30]
    got = containing.containing(spark.createDataFrame(texts, "k long, text string"), ["k"], spark.createDataFrame([(v,) for v in values], "value string"))
    want = sorted((k, v, t.index(v) + 1) for k, t in texts for v in {v for v in values if v} if t and v in t)
    assert sorted(map(tuple, got.collect())) == want


def test_pieces_marked_before_the_first_turn(spark):
    turns = of_case(spark.createDataFrame([(1, 2), (1, 4)], "case_no bigint, turn bigint"))
    marked = of_case(spark.createDataFrame([(1, 1, 10), (1, 3, 11), (1, 9, 12)], "case_no bigint, turn bigint, piece_id bigint"))
    pieces = of_case(spark.createDataFrame([(1, 10, 5), (1, 11, 7), (1, 12, 100)], "case_no bigint, piece_id bigint, n_bytes bigint"))
    assert rows(windows.resent_bytes(turns, marked, pieces), "turn", "bytes", "total") == [(2, 5, 5), (4, 12, 17)]
    again = marked.unionByName(marked.withColumn("turn", F.col("turn") + 1)).unionByName(marked)
    assert rows(windows.resent_bytes(turns, again, pieces), "turn", "bytes", "total") == [(2, 5, 5), (4, 12, 17)]  # a piece counts once


def test_the_log_has_its_own_fields_only(spark, tmp_path):
    df = of_case(spark.createDataFrame([(1, "t", "placed", "the text", "1")], "case_no bigint, tag string, outcome string, content string, cpf string"))
    log = retention.log_actions(df, "r", F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("clerk"))
    assert set(log.columns) == {"tenant", "degree", "case_no", "tag", "outcome", "run_id", "ts", "profile"}
    exports.write_actions(df.withColumns({"ts": F.lit(1), "action_id": F.lit(1)}), str(tmp_path / "log"))
    assert "the text" not in "".join(p.read_text() for p in (tmp_path / "log").glob("*.csv"))


def test_index_of_a_case_without_pieces(spark):
    cases = of_case(spark.createDataFrame([(1, True, "c", "q")], "case_no bigint, sealed boolean, class string, queue string"))
    pieces = of_case(spark.createDataFrame([], "case_no bigint, piece_id bigint, title string"))
    parties = of_case(spark.createDataFrame([(1, "lawyer", "Ana", None, "OAB/CE 1"), (1, "author", "Bia", "123", None)], "case_no bigint, role string, name string, cpf string, oab string"))
    assert rows(exports.export_index(cases, pieces, parties), "warning", "parties", "index") == [("SEALED", "author, Bia, 123; lawyer, Ana, OAB/CE 1", "")]


def test_a_text_with_80000_matches(spark):
    text = "CEP 60000-000, fone (85) 99999-1234; " * 40_000
    df = of_case(spark.createDataFrame([(1, 1, text)], "case_no bigint, piece_id bigint, text string")).cache()
    df.count()
    deid.detect_patterns(df.limit(0)).count()
    began = time.perf_counter()
    found = deid.detect_patterns(df).agg(F.count("*"), F.sum("start"), F.sum("end"), F.max("end")).first()
    took = time.perf_counter() - began
    step = len(text) // 40_000
    starts = 40_000 * (4 + 20) + 2 * step * sum(range(40_000))
    assert tuple(found) == (80_000, starts, starts + 40_000 * (9 + 15), len(text) - 2)
    assert took < 15  # 70 s where sums copy their array


def test_running_sums(spark):
    cases = [[], [5], [1, 2, 3], list(range(10)), [1] * 1000]
    df = spark.createDataFrame([(c,) for c in cases], "x array<bigint>")
    assert [r[0] for r in df.select(running(F.col("x"))).collect()] == [[sum(c[: k + 1]) for k in range(len(c))] for c in cases]


def test_preserved_spans_by_brute_force(spark):
    rng = random.Random(1)
    bits = ["01/02/2020 ", "15 dias ", "Lei 9.099 ", "12345 ", "x ", "7"]
    texts = [(1, k, "".join(rng.choice(bits) for _ in range(30))) for k in range(20)]
    df = of_case(spark.createDataFrame(texts, "case_no bigint, piece_id bigint, text string"))
    numbers = deid.detect_patterns(df, {"number": "[0-9]+", "wide": "[0-9]+ [0-9x]"})
    kept = deid.matches(df, PIECE_KEY, "text", {k: deid.MENTIONS[k] for k in deid.PRESERVED}).collect()
    want = [r for r in numbers.collect() if not any(k["piece_id"] == r["piece_id"] and r["start"] < k["end"] and k["start"] < r["end"] for k in kept)]
    assert want and sorted(map(tuple, deid.drop_preserved(numbers, df).collect())) == sorted(map(tuple, want))


def test_labels_are_one_to_one(spark):
    labels = of_case(spark.createDataFrame([(1, "Ana", "[P_1]"), (1, "Bia", "[P_1]"), (2, "Ana", "[PERSON_1]"), (2, "Ana", "[ORG_1]")], "case_no bigint, value string, label string"))
    df = of_case(spark.createDataFrame([(1, 1, "Ana, Bia e [P_1]"), (2, 2, "Ana")], "case_no bigint, piece_id bigint, text string"))
    masked = deid.mask(df, labels)
    assert rows(masked, "masked") == [("[ORG_1]",), ("[P_1], [P_1~2] e [\\P_1]",)]
    assert rows(deid.unmask(masked, labels), "unmasked") == [("Ana",), ("Ana, Bia e [P_1]",)]
    sent = of_case(spark.createDataFrame([(2, 2, "[PERSON_1] [ORG_1] [PERSON_10]")], "case_no bigint, piece_id bigint, masked string"))
    assert rows(deid.unmask(sent, labels), "unmasked") == [("Ana Ana [PERSON_10]",)]


PARTS = st.sampled_from(["a", "b", "[", "]", "\\", " ", "_", "1", "P", "é", "[P_1]", "[P_2]", "[P_1~2]", "[\\P_1]"])
VALUE = st.lists(st.sampled_from(["a", "b", " ", "1", "é", ".", "[", "P"]), min_size=1, max_size=4).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=15).map("".join), st.lists(st.tuples(st.sampled_from(["[P_1]", "[P_2]", "[X_1]"]), VALUE), max_size=5), st.booleans())
def test_unmask_undoes_mask(text, entries, bounds):
    labels = Labels(entries, bounds)
    assert labels.unmask(labels.mask(text)) == text


def test_large_cases_are_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "TEXTS_A_TASK", 7)
    many = [(1, k, f"fala de Ana {k}") for k in range(100)] + [(2, 1, "Ana"), (None, 2, "Ana"), (1, 5, "fala de Ana 5")]
    df = of_case(spark.createDataFrame(many, "case_no bigint, piece_id bigint, text string")).withColumn("__n", F.array(F.lit(1)))
    labels = of_case(spark.createDataFrame([(1, "Ana", "[P_1]"), (None, "Ana", "[P_9]"), (3, "x", "[P_1]")], "case_no bigint, value string, label string"))
    got = deid.mask(df, labels)
    assert got.columns == [*df.columns, "masked"]
    assert rows(got, "piece_id", "masked") == sorted(((p, t.replace("Ana", "[P_1]") if c == 1 else t) for c, p, t in many), key=repr)


@pytest.mark.parametrize(("text", "name", "want"), [
    ("Réu Jose\u0301 da Conceic\u0327a\u0303o.", "JOSÉ DA CONCEIÇÃO", "Jose\u0301 da Conceic\u0327a\u0303o"),
    ("Réu José da Conceição.", "Jose\u0301 da Conceica\u0303o", "José da Conceição"),
    ("o\ufb03cial", "Official", "o\ufb03cial"),
    ("a Ana-\n  bela\u0301 disse", "anabela", "Ana-\n  bela\u0301"),
    ("da sil\u00ad\nva.", "Silva", "sil\u00ad\nva"),
    ("Josefa", "José", None),
    ("Weiß &\u00a0\u00a0Söhne", "WEISS & SOHNE", "Weiß &\u00a0\u00a0Söhne"),
])
def test_names_in_any_normal_form(spark, text, name, want):
    df = of_case(spark.createDataFrame([(1, 1, text)], "case_no bigint, piece_id bigint, text string"))
    found = deid.detect_register(df, of_case(spark.createDataFrame([(1, name, None)], "case_no bigint, name string, cpf string"))).collect()
    assert [r["value"] for r in found] == ([] if want is None else [want])
    assert all(text[r["start"] : r["end"]] == want for r in found)


@given(st.text(alphabet="aáA\u0301 \n-ﬁß\u00ad\t", max_size=20))
def test_aligned_positions(text):
    form, starts, ends = aligned(text)
    assert len(form) == len(starts) == len(ends) and starts == sorted(starts) and all(a < b <= len(text) for a, b in zip(starts, ends, strict=True))


def test_presets_keep_the_whole_case_key(spark):
    df = of_case(spark.createDataFrame([(1, "Ana", "author", "active", "1", "x", 8)], "case_no bigint, name string, role string, status string, cpf string, qualification string, hour int"))
    for preset in ("party_register", "hearing"):
        assert set(select.project_allowed(df, preset).columns) >= {"tenant", "degree", "case_no"}
    register = select.project_allowed(df, "party_register")
    assert joins.missing_parties(df.select("tenant", "degree", "case_no", "name"), register).count() == 0


def test_labels_of_kinds_that_differ_by_case(spark):
    found = of_case(spark.createDataFrame([(1, 1, "a", "x", 0), (1, 1, "A", "y", 5)], "case_no bigint, piece_id bigint, kind string, value string, start bigint"))
    assert rows(windows.number_labels(found), "value", "label") == [("x", "[A_1]"), ("y", "[A_2]")]


def test_written_texts_and_notes(spark, tmp_path):
    pieces = of_case(spark.createDataFrame([(1, 1, "a", "text one"), (1, 2, "b", None)], "case_no bigint, piece_id bigint, title string, text string"))
    exports.write_piece_text(pieces, str(tmp_path / "pieces"))
    assert spark.read.parquet(str(tmp_path / "pieces")).count() == exports.export_piece_text(pieces).count()
    note = {"tenant": 1, "degree": 1, "case_no": 1, "piece_id": 2, "note_id": 3, "text": "a", "sender_code": "s1", "sender_name": None, "created_ts": "2024-01-01"}
    notes = spark.createDataFrame([tuple(note.values())], "tenant long, degree long, case_no long, piece_id long, note_id long, text string, sender_code string, sender_name string, created_ts string")
    exports.write_notes(notes, notes, str(tmp_path / "notes"))
    good, bad = parsing.check_notes(spark.read.text(str(tmp_path / "notes")).withColumnRenamed("value", "line"))
    assert rows(good, "note_id", "text") == [(3, "a")] and bad.count() == 0


def test_quick_answers_make_few_files(spark, tmp_path):
    def fn(batches):
        for b in batches:
            yield b[["tenant", "degree", "case_no"]].assign(answer="yes")

    cases = of_case(spark.range(20_000).select(F.col("id").alias("case_no"), F.lit("a").alias("what"))).coalesce(1)
    assert parsing.analyse(cases, fn, ledger=f"file://{tmp_path}/ledger").count() == 20_000
    assert len(list((tmp_path / "ledger").glob("*.parquet"))) < 300  # 2,858 where each call asks for seven


def test_texts_met_are_not_copied_for_each_value(spark, monkeypatch):
    monkeypatch.setattr(containing, "HELD", 10)
    values = spark.range(300).select(F.format_string("v%05d", "id").alias("value"))
    text = " ".join(f"v{i:05d}" for i in range(300)) + "x" * 2_000_000
    texts = spark.range(1, 5).select(F.col("id").alias("k"), F.concat(F.lit(text), F.col("id").cast("string")).alias("text")).coalesce(1)
    taken = containing.containing(texts, ["k"], values)  # 4 GB, and offsets beyond 32 bits, where each hit takes its text along
    assert taken.count() == 1200


def test_few_and_many_entries_find_the_same(monkeypatch):
    from docketry.functions import forms

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("aAbé12 .-/[]\n_\ufb01\u0301") for _ in range(rng.randint(0, n)))
    for _ in range(3000):
        text, names = word(40), [(rng.choice(["person", "number"]), word(5)) for _ in range(6)]
        labels, got = [(rng.choice(["[a]", "[b]", "[a_1]", "L"]), word(4)) for _ in range(6)], []
        for few in (16, 0):
            monkeypatch.setattr(forms, "FEW", few)
            found = sorted(map(tuple, (x.values() for x in forms.Register(names).found(text))))
            got.append((found, forms.Labels(labels).mask(text), forms.Labels(labels, bounds=False).mask(text)))
        assert got[0] == got[1]


def test_a_long_word_is_not_searched_for_addresses(spark):
    df = of_case(spark.createDataFrame([(1, 1, "a" * 200_000 + " 60000-000"), (1, 2, "\x01 60000-000 é 60000-111")], "case_no bigint, piece_id bigint, text string"))
    deid.detect_patterns(df.limit(0)).count()
    began = time.perf_counter()
    assert rows(deid.detect_patterns(df), "value", "start", "end") == [("60000-000", 2, 11), ("60000-000", 200_001, 200_010), ("60000-111", 14, 23)]
    assert time.perf_counter() - began < 20  # a search for @ tries each rest of the word: 20 billion steps


def test_items_of_batches_are_dealt_to_all_tasks(spark, sf_dir):
    # few ids come to one task; their items must not
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup("progress", "progress")
    try:
        QUERIES["st2_batch_progress"](spark, sf_dir).collect()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for j in tracker.getJobIdsForGroup("progress") for s in tracker.getJobInfo(j).stageIds}
    tasks = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
    assert tasks.count(int(spark.conf.get("spark.sql.shuffle.partitions"))) >= 2  # where ids are spread out, and where items meet results


def test_progress_of_odd_batches(spark):
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, None), (2, 1), (None, 1)], "batch_id bigint, item bigint")
    results = spark.createDataFrame([(1, 1), (1, 1), (1, None), (1, 9), (2, 1), (3, 1), (None, 1)], "batch_id bigint, item bigint")
    got = {r["batch_id"]: (r["expected"], r["done"], r["closed"]) for r in aggregates.batch_progress(items, results).collect()}
    assert got == {1: (3, 1, False), 2: (1, 1, True), None: (1, 0, False)}


@pytest.mark.parametrize(("sent", "few"), [(2_000_000, 64), (2_000_000, 1), (0, 64)])
def test_values_that_are_sent_or_joined_find_the_same(spark, monkeypatch, sent, few):
    monkeypatch.setattr(containing, "SENT_VALUES", sent)
    monkeypatch.setattr(containing, "FEW", few)
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("aé😀") for _ in range(rng.randint(0, n)))
    texts = [(k % 30, word(60)) for k in range(60)] + [(None, "aaaaaaa"), (61, "a" * 300 + "é" + "a" * 9), (62, None)]  # keys repeat, one is null
    values = [word(9) for _ in range(60)] + ["a" * 7, "aaaaaaé", "éaaaaaaaaa", "a" * 301, "", None]
    got = containing.containing(spark.createDataFrame(texts, "k long, text string"), ["k"], spark.createDataFrame([(v,) for v in values], "value string"))
    want = sorted((k, v, t.index(v) + 1) for k, t in texts for v in {v for v in values if v} if k is not None and t and v in t)
    assert sorted(map(tuple, got.collect())) == want


def test_an_audit_in_one_pass_tells_what_its_parts_tell(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BATCH_BYTES", 300)
    cpf, cep = "123.456.789-09", "60000-00"
    texts = [(k % 9, k // 9 % 4, f"CPF {cpf}, {cep}{k % 3} e {cep}{k % 4} é [CPF_1]" if k % 5 else "nada") for k in range(80)]  # pieces repeat in a case
    texts += [(1, 99, None), (None, 1, f"CPF {cpf}"), (2, None, f"CPF {cpf}"), (2, None, f"{cep}7"), (77, 1, f"CEP {cep}8")]
    df = of_case(spark.createDataFrame(texts, "case_no bigint, piece_id bigint, text string"))
    df = df.unionByName(df.withColumn("tenant", F.lit(2).cast(df.schema["tenant"].dataType)).filter("case_no < 3"))
    found = deid.detect_patterns(df)
    found = spark.createDataFrame(found.collect(), found.schema)
    found = found.unionByName(found.limit(3).withColumn("piece_id", F.lit(55).cast("long")))  # entities of a piece without a text
    labels = windows.number_labels(found)
    want = deid.mask_audit(aggregates.mask_counts(found), deid.mask(df, labels), labels)
    for got in (deid.audit(df, found), deid.audit(df.repartition(3, "tenant", "degree", "case_no"), found)):
        assert got.columns == want.columns == [*PIECE_KEY, "kind", "n", "masked", "labels"]
        assert got.schema.simpleString() == want.schema.simpleString()
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []
    plain = aggregates.mask_counts(found).join(deid.mask(df, labels).select(*PIECE_KEY, "masked"), PIECE_KEY)
    assert sorted(map(repr, want.drop("labels").collect())) == sorted(map(repr, plain.collect()))
