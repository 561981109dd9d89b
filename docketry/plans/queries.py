"""One query for each operator, over inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions import ids
from docketry.functions.expiry import RULES, expires_at
from docketry.functions.patterns import IDENTIFIERS, MENTIONS, RG
from docketry.operators import aggregates, deid, joins, parsing, retention, select, sets, windows
from docketry.plans.inputs import KEY, NOW_EVENTS, NOW_ORDERS, SQL, Inputs
from docketry.schemas import PIECE_KEY
from docketry.sources import exports, readers
from docketry.sources.manifest import Manifest
from docketry.streaming import triage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def now():
    """The end of the events' time, as a column."""
    return F.lit(NOW_EVENTS).cast("timestamp_ntz")


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Registers a function of Inputs as a query; sql is its DuckDB twin over the inputs' names."""

    def register(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = f"WITH {SQL.strip()}{', ' + ctes if ctes else ''}\n{sql}"
        return fn

    return register


# sources and sinks


@query("s1_read_cases", "SELECT * FROM cases")
def _(t):
    path = t.place("cases")
    t.cases.write.parquet(path)
    return readers.read_cases(t.spark, path)


@query("s2_read_case_list", "SELECT DISTINCT '0' || case_no AS case_no FROM cases WHERE case_no % 3 = 0")
def _(t):
    path = t.place("case-list")
    lines = F.when(F.expr("case_no % 3 = 0"), F.concat(F.lit("0-"), F.col("case_no").cast("string"))).otherwise(F.lit("no number"))
    t.cases.select(lines.alias("case_no")).write.option("header", True).csv(path)
    return readers.read_case_list(t.spark, path)[0]


@query("s4_read_plain", "SELECT title || ' ' || replace(coalesce(text, ''), chr(10), ' ') AS line FROM pieces")
def _(t):
    path = t.place("plain")
    t.pieces.select(F.concat("title", F.lit(" "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))).write.text(path)
    return readers.read_plain(t.spark, f"{path}/*.txt").select(F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")


BARE = "coalesce(html, '')"
for _part in (r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<[^>]*>"):
    BARE = f"regexp_replace({BARE}, '{_part}', ' ', 'g')"
for _name, _text in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("apos", "''"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
    BARE = f"replace({BARE}, '&{_name};', '{_text}')"


@query("s3_html_to_text", f"SELECT page_id, trim(regexp_replace({BARE}, '[ \\t\\n\\r\\f]+', ' ', 'g')) AS text FROM pages")
def _(t):
    return readers.pages_to_text(t.table("pages"))


@query("s5_export_case_text", """
SELECT tenant, degree, case_no, string_agg('## ' || title || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY piece_date, piece_id) AS text
FROM pieces GROUP BY ALL""")
def _(t):
    return exports.export_case_text(t.pieces)


@query("s6_export_piece_text", "SELECT CAST(piece_id % 64 AS INTEGER) AS bucket, piece_id, text FROM pieces")
def _(t):
    return exports.export_piece_text(t.pieces)


@query("s7_export_index", """
SELECT c.tenant, c.degree, c.case_no, CASE WHEN sealed THEN 'SEALED' ELSE '' END AS warning, class, queue, p.parties, coalesce(i."index", '') AS "index"
FROM cases c
LEFT JOIN (SELECT tenant, degree, case_no, string_agg(concat_ws(', ', role, name, cpf, oab), '; ' ORDER BY name) AS parties FROM parties GROUP BY ALL) p USING (tenant, degree, case_no)
LEFT JOIN (SELECT tenant, degree, case_no, string_agg(piece_id || ' - ' || title, chr(10) ORDER BY piece_id) AS "index" FROM pieces GROUP BY ALL) i USING (tenant, degree, case_no)""")
def _(t):
    return exports.export_index(t.cases, t.pieces, t.parties)


@query("s8_export_list", "SELECT tenant, degree, case_no, class, queue, unit, priority, arrival, last_mov, array_to_string(tags, ', ') AS tags FROM cases")
def _(t):
    return exports.export_list(t.cases)


@query("s9_export_actions", "SELECT id AS action_id, ts, profile, tenant, degree, case_no, outcome FROM ev")
def _(t):
    actions = t.events.select(F.col("id").alias("action_id"), "ts", "profile", "tenant", "degree", "case_no", "outcome", F.lit("x").alias("cookie"), F.col("props").alias("content"))
    return exports.export_actions(actions)


@query("s10_export_notes", """
SELECT '{"tenant":' || e.tenant || ',"degree":' || e.degree || ',"case_no":' || case_no || ',"piece_id":' || item || ',"note_id":' || id || ',"text":"' || outcome || '","sender_code":"s' || profile
       || '","created_ts":"d' || batch_id || '","sender_name":"n' || profile || '"}' AS line FROM ev e SEMI JOIN cases c ON c.tenant = e.tenant AND c.degree = e.degree AND c.case_no = e.case_no WHERE case_no % 5 = 0""")
def _(t):
    return exports.export_notes(_notes(t), t.cases.filter("case_no % 5 = 0"))


def _notes(t: Inputs) -> DataFrame:
    return t.events.select(
        *KEY, F.col("item").alias("piece_id"), F.col("id").alias("note_id"), F.col("outcome").alias("text"),
        F.concat(F.lit("s"), F.col("profile").cast("string")).alias("sender_code"), F.concat(F.lit("d"), F.col("batch_id").cast("string")).alias("created_ts"),
        F.concat(F.lit("n"), F.col("profile").cast("string")).alias("sender_name"),
    )


# projections, filters, predicates


@query("p1_project_allowed", "SELECT degree, case_no, class, subject, queue, tags, priority, sealed, unit, arrival, last_mov FROM cases")
def _(t):
    return select.project_allowed(t.cases, "triage")


@query("p1_project_allowed_register", "SELECT tenant, degree, case_no, name, role, status FROM parties")
def _(t):
    return select.project_allowed(t.parties, "party_register")


@query("p2_filter_cases", "SELECT case_no, arrival, tags FROM cases WHERE queue = 'O' AND list_contains(tags, 'RF')")
def _(t):
    return select.filter_cases(t.cases, "O", "RF").select("case_no", "arrival", "tags")


@query("p3_route_sealed", "SELECT case_no, sealed, CASE WHEN sealed THEN 'anonymise' ELSE 'read' END AS route FROM cases")
def _(t):
    return select.route_sealed(t.cases, "anonymise").select("case_no", "sealed", "route")


@query("p4_warn_sealed", "SELECT case_no, sealed AND case_no % 2 <> 0 AS warn FROM cases")
def _(t):
    return select.warn_sealed(t.cases.withColumn("masked", F.expr("case_no % 2 = 0"))).select("case_no", "warn")


def _hearings(t: Inputs) -> DataFrame:
    rows = t.parties.join(t.table("orders"), F.col("sheet_id") == F.col("o_orderkey"))
    return rows.select(
        *KEY, F.col("o_orderdate").cast("date").alias("hearing_date"), F.expr("CAST(8 + case_no % 10 AS INT)").alias("hour"),
        F.col("o_orderpriority").alias("type"), "name", F.col("role").alias("qualification"), "cpf",
    )


HEARINGS = """hearings AS (
  SELECT tenant, degree, case_no, CAST(o_orderdate AS DATE) AS hearing_date, CAST(8 + case_no % 10 AS INTEGER) AS hour, o_orderpriority AS type, name, role AS qualification
  FROM parties JOIN orders ON sheet_id = o_orderkey)"""


@query("p5_hearings_between", "SELECT tenant, degree, case_no, hearing_date, hour, type, name, qualification FROM hearings WHERE hearing_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", HEARINGS)
def _(t):
    import datetime as d

    return select.hearings_between(_hearings(t), d.date(1997, 1, 1), d.date(1997, 12, 31))


@query("p6_pages_needing_image", """
SELECT tenant, degree, case_no, piece_id % 5 AS piece_id, folio, ocr_conf FROM folios
WHERE NOT has_text_layer AND ocr_conf < 0.6 OR (folio = 1 AND piece_id % 10 = 0)""")
def _(t):
    asked = t.folios.filter("folio = 1 AND piece_id % 10 = 0")
    return select.pages_needing_image(_local(t.folios), _local(asked), 0.6).select(*PIECE_KEY, "folio", "ocr_conf")


@query("p7_pages_needing_ocr", "SELECT piece_id, folio FROM folios WHERE NOT has_text_layer")
def _(t):
    return select.pages_needing_ocr(t.folios).select("piece_id", "folio")


@query("p8_draft_allowed", """
SELECT case_no, kind, kind NOT IN ('ruling', 'decision') OR (trim(thesis) <> '' AND trim(disposition) <> '') AS allowed FROM (
  SELECT case_no, CASE case_no % 3 WHEN 0 THEN 'ruling' WHEN 1 THEN 'decision' ELSE 'order' END AS kind,
         CASE WHEN case_no % 5 = 0 THEN ' ' ELSE class END AS thesis, CASE WHEN case_no % 7 = 0 THEN '' ELSE queue END AS disposition FROM cases)""")
def _(t):
    requests = t.cases.select(
        "case_no", F.expr("CASE case_no % 3 WHEN 0 THEN 'ruling' WHEN 1 THEN 'decision' ELSE 'order' END").alias("kind"),
        F.expr("CASE WHEN case_no % 5 = 0 THEN ' ' ELSE class END").alias("thesis"), F.expr("CASE WHEN case_no % 7 = 0 THEN '' ELSE queue END").alias("disposition"),
    )
    return select.draft_allowed(requests).select("case_no", "kind", "allowed")


@query("p9_movements_of", "SELECT case_no, mov_ts, mov_type, mov_id FROM movements WHERE mov_type IN ('AF', 'RF')")
def _(t):
    return select.movements_of(t.movements, ["AF", "RF"]).select("case_no", "mov_ts", "mov_type", "mov_id")


@query("p10_unread_cases", "SELECT case_no FROM cases WHERE case_no % 6 = 0 OR arrival >= DATE '2001-01-01'")
def _(t):
    rows = t.cases.withColumns({"icons": F.expr("CASE WHEN case_no % 6 = 0 THEN array('unread document') ELSE array('star') END"), "distributed": F.col("arrival")})
    return select.unread_cases(rows, "unread document", F.lit("2001-01-01").cast("date")).select("case_no")


@query("p11_drop_attachments", "SELECT piece_id, origin FROM pieces WHERE origin <> 'attachment'")
def _(t):
    return select.drop_attachments(t.pieces).select("piece_id", "origin")


@query("p12_memory_projection", "SELECT piece_id, case_no, title, text FROM pieces WHERE origin <> 'attachment'")
def _(t):
    rows = t.pieces.select("piece_id", "case_no", "title", "text", "origin", F.encode("title", "UTF-8").alias("pdf"))
    return select.memory_projection(rows).drop("origin")


@query("p13_natural_persons", "SELECT case_no, name FROM parties WHERE kind = 'natural'")
def _(t):
    return select.natural_persons(t.parties).select("case_no", "name")


@query("p14_search_party", "SELECT tenant, degree, case_no FROM cases SEMI JOIN (SELECT * FROM parties WHERE contains(lower(name), 'customer#00000012')) USING (tenant, degree, case_no)")
def _(t):
    return select.search_party(t.cases, t.parties, "CUSTOMER#00000012")


@query("p15_main_pieces", "SELECT piece_id, coalesce(doc_type IN ('fr', 'de'), false) AS main FROM pieces")
def _(t):
    return select.main_pieces(t.pieces, ["fr", "de"]).select("piece_id", "main")


# joins


@query("j1_selected_only", "SELECT p.piece_id, p.case_no FROM pieces p SEMI JOIN selection s USING (tenant, degree, case_no, piece_id)")
def _(t):
    return joins.selected_only(t.pieces, t.selection).select("piece_id", "case_no")


@query("j2_attach_children", """
SELECT p.tenant, p.degree, p.case_no, p.piece_id, p.title, coalesce(k.children, CAST([] AS BIGINT[])) AS children FROM pieces p
LEFT JOIN (SELECT parent_id, list_sort(list(piece_id)) AS children FROM pieces WHERE parent_id IS NOT NULL GROUP BY 1) k ON k.parent_id = p.piece_id
WHERE p.parent_id IS NULL""")
def _(t):
    return joins.attach_children(t.pieces)


#: Pieces, pages and marks whose piece ids are numbered inside of each case, so that cases share them.
LOCAL = """own_folios AS (
  SELECT tenant, degree, case_no, piece_id % 5 AS piece_id, folio FROM folios),
own_marks AS (SELECT tenant, degree, case_no, piece_id % 5 AS piece_id FROM selection),
own_cited AS (SELECT tenant, degree, case_no, piece_id % 5 AS piece_id, CAST(piece_id % 4 AS INTEGER) AS folio FROM pieces)"""


def _local(df: DataFrame) -> DataFrame:
    return df.withColumn("piece_id", F.expr("piece_id % 5"))


@query("j3_check_citations", """
SELECT c.*, CASE WHEN f.piece_id IS NULL THEN 'unresolved' WHEN s.piece_id IS NULL THEN 'unselected' ELSE 'ok' END AS status
FROM own_cited c LEFT JOIN own_folios f USING (tenant, degree, case_no, piece_id, folio) LEFT JOIN own_marks s USING (tenant, degree, case_no, piece_id)""", LOCAL)
def _(t):
    cited = t.pieces.select(*PIECE_KEY, F.expr("CAST(piece_id % 4 AS INT)").alias("folio"))
    return joins.check_citations(_local(cited), _local(t.folios), _local(t.selection))


@query("j4_referenced_not_selected", """
SELECT DISTINCT p.tenant, p.degree, p.case_no, p.piece_id FROM pieces p JOIN pieces q ON q.parent_id = p.piece_id
WHERE NOT EXISTS (SELECT 1 FROM selection s WHERE s.tenant = p.tenant AND s.degree = p.degree AND s.case_no = p.case_no AND s.piece_id = p.piece_id)""")
def _(t):
    return joins.referenced_not_selected(t.pieces.filter("parent_id IS NOT NULL").select(*KEY, F.col("parent_id").alias("piece_id")), t.selection)


LAST = "(SELECT * FROM analyses QUALIFY row_number() OVER (PARTITION BY tenant, degree, case_no ORDER BY analysed DESC NULLS LAST) = 1)"


@query("j5_with_last_analysis", f"SELECT tenant, degree, case_no, queue, analysed, situation, next_act FROM cases LEFT JOIN {LAST} USING (tenant, degree, case_no)")
def _(t):
    return joins.with_last_analysis(t.cases, t.analyses).select(*KEY, "queue", "analysed", "situation", "next_act")


@query("j6_needs_analysis", f"""
SELECT c.case_no, c.last_mov FROM cases c LEFT JOIN {LAST} a USING (tenant, degree, case_no)
WHERE a.case_no IS NULL OR c.last_mov IS DISTINCT FROM a.last_mov_seen""")
def _(t):
    return joins.needs_analysis(t.cases, t.analyses).select("case_no", "last_mov")


@query("j7_missing_parties", """
SELECT tenant, degree, case_no, name, name_norm FROM (SELECT tenant, degree, case_no + case_no % 2 AS case_no, name, lower(name) AS name_norm FROM parties) f
WHERE NOT EXISTS (SELECT 1 FROM parties p WHERE p.tenant = f.tenant AND p.degree = f.degree AND p.case_no = f.case_no AND lower(p.name) = f.name_norm)""")
def _(t):
    found = t.parties.select("tenant", "degree", F.expr("case_no + case_no % 2").alias("case_no"), "name")
    return joins.missing_parties(found, t.parties).select(*KEY, "name", "name_norm")


@query("j8_known_persons", """
SELECT q.case_no, q.name, p.person_id FROM (
  SELECT case_no, name, CASE WHEN case_no % 5 = 0 THEN substr(cpf, 1, 10) || (CAST(substr(cpf, 11, 1) AS INTEGER) + 1) % 10 ELSE cpf END AS cpf FROM parties) q
LEFT JOIN persons p ON p.cpf = q.cpf AND q.case_no % 5 <> 0""")
def _(t):
    wrong = F.expr("concat(substr(cpf, 1, 10), CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS STRING))")
    proposed = t.parties.select("case_no", "name", F.when(F.expr("case_no % 5 = 0"), wrong).otherwise(F.col("cpf")).alias("cpf"))
    return joins.known_persons(proposed, t.persons)


def _exits(t: Inputs) -> DataFrame:
    rows = t.cases.select("queue").distinct()
    pairs = rows.select("queue", F.explode(F.expr("array('close', 'review')")).alias("exit"))
    return pairs.select("queue", "exit", (F.col("queue") != "P").alias("batch"), F.concat("queue", F.lit("-"), "exit").alias("to_queue"))


def _moves(t: Inputs) -> DataFrame:
    return t.cases.filter("case_no % 4 = 0").select(*KEY, "queue", F.expr("CASE WHEN case_no % 8 = 0 THEN 'close' ELSE 'archive' END").alias("exit"))


MOVES = """exits AS (SELECT queue, e AS exit, queue <> 'P' AS batch, queue || '-' || e AS to_queue
  FROM (SELECT DISTINCT queue FROM cases), (VALUES ('close'), ('review')) x(e)),
moves AS (SELECT tenant, degree, case_no, queue, CASE WHEN case_no % 8 = 0 THEN 'close' ELSE 'archive' END AS exit FROM cases WHERE case_no % 4 = 0)"""


@query("j9_valid_exits", """
SELECT tenant, degree, case_no, queue, exit, EXISTS (SELECT 1 FROM exits e WHERE e.queue = m.queue AND e.exit = m.exit AND batch) AS valid FROM moves m""", MOVES)
def _(t):
    valid, refused = joins.valid_exits(_moves(t), _exits(t))
    return valid.withColumn("valid", F.lit(True)).unionByName(refused.withColumn("valid", F.lit(False)))


@query("j10_valid_tags", """
SELECT case_no, tag, CASE WHEN tag IN ('AF', 'RF', 'NO') THEN 'exists' WHEN tag = 'AO' THEN 'create' ELSE 'refused' END AS outcome
FROM (SELECT case_no, unnest(tags) AS tag FROM cases)""")
def _(t):
    register = t.movements.filter("mov_type IN ('AF', 'RF', 'NO', 'AO')").select(F.col("mov_type").alias("tag"), (F.col("mov_type") == "AO").alias("configured")).distinct()
    return joins.valid_tags(t.cases.select("case_no", F.explode("tags").alias("tag")), register).select("case_no", "tag", "outcome")


def _changes(t: Inputs) -> DataFrame:
    """Some cases are changed twice in one run."""
    first = t.cases.filter("case_no % 3 = 0").select(*KEY, F.expr("array('urgent', 'AF')").alias("add"), F.expr("array('RF', 'NO')").alias("remove"))
    return first.unionByName(first.filter("case_no % 6 = 0").select(*KEY, F.expr("array('late')").alias("add"), F.expr("array('AF')").alias("remove")))


AFTER = """list_sort(list_filter(list_distinct(list_concat(coalesce(tags, CAST([] AS VARCHAR[])), ['urgent', 'AF'], CASE WHEN case_no % 6 = 0 THEN ['late'] ELSE CAST([] AS VARCHAR[]) END)),
  lambda x: x NOT IN ('RF', 'NO') AND NOT (case_no % 6 = 0 AND x = 'AF')))"""


@query("j11_preview", f"SELECT tenant, degree, case_no, tags AS before, {AFTER} AS after FROM cases WHERE case_no % 3 = 0 AND tags IS NOT NULL")
def _(t):
    return joins.preview(t.cases.filter("tags IS NOT NULL"), _changes(t))


@query("j12_verify", """
SELECT tenant, degree, case_no, CASE WHEN b.case_no IS NULL THEN 'missing' WHEN a.case_no IS NULL THEN 'unexpected'
  WHEN a.queue IS NOT DISTINCT FROM b.queue AND a.tags IS NOT DISTINCT FROM b.tags THEN 'ok' ELSE 'differs' END AS status
FROM (SELECT * FROM cases WHERE case_no % 10 <> 0) a FULL JOIN
     (SELECT tenant, degree, case_no, CASE WHEN case_no % 4 = 0 THEN 'X' ELSE queue END AS queue, tags FROM cases WHERE case_no % 9 <> 0) b USING (tenant, degree, case_no)""")
def _(t):
    actual = t.cases.filter("case_no % 9 <> 0").withColumn("queue", F.expr("CASE WHEN case_no % 4 = 0 THEN 'X' ELSE queue END"))
    return joins.verify(t.cases.filter("case_no % 10 <> 0"), actual)


@query("j13_results_for", """
SELECT tenant, degree, case_no, ts, result_id FROM (
  SELECT tenant, degree, case_no, ts, id AS result_id,
         row_number() OVER (PARTITION BY tenant, degree, case_no ORDER BY ts DESC, id DESC) AS n FROM ev) r
WHERE n = 1 AND EXISTS (SELECT 1 FROM cases c WHERE c.tenant = r.tenant AND c.degree = r.degree AND c.case_no = r.case_no)""")
def _(t):
    results = t.events.select(*KEY, "ts", F.col("id").alias("result_id"))
    return joins.results_for(t.cases, results)


GRANTS = "grants AS (SELECT batch_id, min(ts) - INTERVAL 1 HOUR AS granted_ts FROM ev WHERE batch_id % 3 <> 0 GROUP BY batch_id)"


def _grants(t: Inputs) -> DataFrame:
    return t.events.filter("batch_id % 3 <> 0").groupBy("batch_id").agg((F.min("ts") - F.expr("INTERVAL 1 HOUR")).alias("granted_ts"))


@query("j14_auto_tag", "SELECT ev.batch_id, id, ts, granted_ts FROM ev JOIN grants ON ev.batch_id = grants.batch_id AND ts BETWEEN granted_ts AND granted_ts + INTERVAL 2 HOURS", GRANTS)
def _(t):
    return joins.auto_tag(t.events.select("batch_id", "id", "ts"), _grants(t), hours=2)


@query("j15_usable_uploads", f"""
SELECT id AS file_id, outcome AS provider, ts AS uploaded_ts FROM ev
WHERE profile % 2 = 0 AND (outcome <> 'view' OR ts + INTERVAL 48 HOURS > TIMESTAMP '{NOW_EVENTS}')""")
def _(t):
    files = t.events.select(F.col("id").alias("file_id"), F.col("outcome").alias("provider"), ids.key_fingerprint(F.col("profile").cast("string")).alias("key_fp"), F.col("ts").alias("uploaded_ts"))
    keys = t.events.filter("profile % 2 = 0").select(
        F.col("outcome").alias("provider"), ids.key_fingerprint(F.col("profile").cast("string")).alias("key_fp"), F.expr("CASE WHEN outcome = 'view' THEN 48 END").alias("hours")
    )
    return joins.usable_uploads(files, keys, now()).select("file_id", "provider", "uploaded_ts")


@query("j16_with_reader_marks", """
SELECT piece_id, coalesce(quality = 1, false) AS read, coalesce(toxic = 1, false) AS favourite, coalesce(CAST(doc_id % 9 AS INTEGER), 0) AS last_page
FROM pieces LEFT JOIN labels ON doc_id = piece_id""")
def _(t):
    marks = t.table("labels").join(t.pieces, F.col("doc_id") == F.col("piece_id")).select(*KEY, "piece_id", (F.col("quality") == 1).alias("read"), (F.col("toxic") == 1).alias("favourite"), F.expr("CAST(doc_id % 9 AS INT)").alias("last_page"))
    return joins.with_reader_marks(t.pieces, marks).select("piece_id", "read", "favourite", "last_page")


@query("j17_with_notes", """
SELECT p.piece_id, coalesce(n.notes, CAST([] AS VARCHAR[])) AS notes FROM pieces p
LEFT JOIN (SELECT tenant, degree, case_no, item AS piece_id, list(outcome ORDER BY 'd' || batch_id, id) AS notes FROM ev GROUP BY ALL) n USING (tenant, degree, case_no, piece_id)""")
def _(t):
    return joins.with_notes(t.pieces, _notes(t)).select("piece_id", "notes")


@query("j18_keyed_barrier", """
SELECT s.tenant, s.degree, s.case_no, s.piece_id AS turn, v.value, CAST(strpos(s.text, v.value) AS BIGINT) AS at
FROM sheets s JOIN (SELECT DISTINCT tenant, degree, case_no, name AS value FROM parties) v USING (tenant, degree, case_no) WHERE contains(s.text, v.value)""")
def _(t):
    outgoing = t.sheets.select(*KEY, F.col("piece_id").alias("turn"), "text")
    return deid.barrier_hits(outgoing, t.parties.select(*KEY, F.col("name").alias("value")))


@query("j19_with_favourites", "SELECT case_no, case_no % 13 = 0 AS favourite FROM cases")
def _(t):
    return joins.with_favourites(t.cases, t.cases.filter("case_no % 13 = 0")).select("case_no", "favourite")


@query("j20_egress_check", "SELECT id, outcome AS category, 'p' || (profile % 5) AS destination FROM ev WHERE NOT (profile % 5 < 3 AND outcome <> 'error')")
def _(t):
    rows = t.events.select("id", F.col("outcome").alias("category"), F.concat(F.lit("p"), (F.col("profile") % 5).cast("string")).alias("destination"))
    policy = t.events.filter("profile % 5 < 3 AND outcome <> 'error'").select(F.col("outcome").alias("category"), F.concat(F.lit("p"), (F.col("profile") % 5).cast("string")).alias("destination"))
    return joins.egress_check(rows, policy).select("id", "category", "destination")


# aggregations


@query("a1_queue_counts", "SELECT queue, count(*) AS n FROM cases GROUP BY queue")
def _(t):
    return aggregates.queue_counts(t.cases)


@query("a2_sector_rollup", "SELECT sector, queue, count(*) AS n, CAST(grouping(sector, queue) AS BIGINT) AS level FROM cases GROUP BY ROLLUP (sector, queue)")
def _(t):
    return aggregates.sector_rollup(t.cases)


@query("a3_tag_names", "SELECT tag, max(last_mov) AS seen FROM (SELECT unnest(tags) AS tag, last_mov FROM cases) GROUP BY tag ORDER BY seen DESC NULLS LAST, tag LIMIT 4")
def _(t):
    return aggregates.tag_names(t.cases, cap=4)


DAILY = """daily AS (
  SELECT tenant, CASE WHEN board IN ('sealed', 'free') THEN 'secrecy' ELSE 'unit' END AS view, board, day, CAST(n AS BIGINT) AS n FROM (
    SELECT tenant, arrival AS day, count(*) AS "all", count(*) FILTER (priority) AS urgent, count(*) FILTER (queue = 'O') AS "open",
           count(*) FILTER (sealed) AS sealed, count(*) FILTER (NOT sealed) AS free
    FROM cases GROUP BY ALL) UNPIVOT (n FOR board IN ("all", urgent, "open", sealed, free)))"""


def _daily(t: Inputs) -> DataFrame:
    sealed = F.col("sealed")
    views = {"unit": {"all": F.lit(True), "urgent": F.col("priority"), "open": F.col("queue") == "O"}, "secrecy": {"sealed": sealed, "free": ~sealed}}
    return aggregates.daily_totals(t.cases, views, F.col("arrival"))


@query("a4_daily_totals", "SELECT * FROM daily", DAILY)
def _(t):
    return _daily(t)


@query("a5_board_share", "SELECT *, round(n * 100.0::DOUBLE / nullif(sum(n) OVER (PARTITION BY tenant, view, day), 0), 1) AS share FROM daily", DAILY)
def _(t):
    return aggregates.board_share(_daily(t))


@query("a6_case_bundle", """
SELECT tenant, degree, case_no, class, queue, p.pieces, m.movements FROM cases c
LEFT JOIN (SELECT tenant, degree, case_no, list(piece_id || '|' || title || '|' || text ORDER BY piece_id) AS pieces FROM pieces GROUP BY ALL) p USING (tenant, degree, case_no)
LEFT JOIN (SELECT tenant, degree, case_no, list(strftime(mov_ts, '%Y-%m-%d') || '|' || mov_type ORDER BY mov_ts, mov_type) AS movements FROM movements GROUP BY ALL) m USING (tenant, degree, case_no)""")
def _(t):
    out = aggregates.case_bundle(t.cases, t.pieces, t.movements)
    return out.withColumns({
        "pieces": F.transform("pieces", lambda p: F.concat_ws("|", p["piece_id"], p["title"], p["text"])),
        "movements": F.transform("movements", lambda m: F.concat_ws("|", F.date_format(m["mov_ts"], "yyyy-MM-dd"), m["mov_type"])),
    })


@query("a7_estimate_work", """
SELECT count(*) AS n_cases, CAST(ceil(sum(n_bytes) / 4.0) * 0.0000005 AS DECIMAL(18, 6)) AS cost,
       count(*) > 10 OR CAST(ceil(sum(n_bytes) / 4.0) * 0.0000005 AS DECIMAL(18, 6)) > 0.50 AS confirm
FROM (SELECT tenant, degree, case_no, sum(n_bytes) AS n_bytes FROM pieces GROUP BY ALL)""")
def _(t):
    return aggregates.estimate_work(t.pieces.groupBy(*KEY).agg(F.sum("n_bytes").alias("n_chars")))


def _found_sql(name: str, source: str, patterns: dict[str, str], group: int = 0) -> str:
    """The DuckDB twin of matches(): entities of the patterns in the texts of a source."""
    parts = []
    for kind, p in patterns.items():
        p = p.replace("'", "''")
        parts.append(f"""
  SELECT tenant, degree, case_no, piece_id, '{kind}' AS kind, value, CAST("end" - length(hit) AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end" FROM (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY tenant, degree, case_no, piece_id ORDER BY i) AS "end" FROM (
      SELECT tenant, degree, case_no, piece_id, unnest(string_split_regex(text, '{p}')) AS gap, unnest(regexp_extract_all(text, '{p}')) AS hit,
             unnest(regexp_extract_all(text, '{p}', {group})) AS value, generate_subscripts(string_split_regex(text, '{p}'), 1) AS i
      FROM {source} WHERE regexp_matches(text, '{p}')) WHERE hit IS NOT NULL)""")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SHEET_ENTITIES = _found_sql("found", "sheets", IDENTIFIERS)


@query("a8_mask_counts", "SELECT tenant, degree, case_no, piece_id, kind, count(*) AS n FROM found GROUP BY ALL", SHEET_ENTITIES)
def _(t):
    return aggregates.mask_counts(deid.detect_patterns(t.sheets))


@query("a9_hearing_parties", """
SELECT tenant, degree, case_no, hearing_date, hour, type, list(name || '|' || qualification ORDER BY name) AS parties FROM hearings GROUP BY ALL""", HEARINGS)
def _(t):
    return aggregates.hearing_parties(_hearings(t)).withColumn("parties", F.transform("parties", lambda p: F.concat_ws("|", p["name"], p["qualification"])))


@query("a10_batch_progress", """
SELECT i.batch_id, count(*) AS expected, count(r.item) AS done, count(*) = count(r.item) AS closed
FROM (SELECT DISTINCT batch_id, item FROM ev) i LEFT JOIN (SELECT DISTINCT batch_id, item FROM ev WHERE outcome <> 'error' OR batch_id % 2 = 0) r
  ON r.batch_id = i.batch_id AND r.item = i.item GROUP BY i.batch_id""")
def _(t):
    return aggregates.batch_progress(t.events, t.events.filter("outcome <> 'error' OR batch_id % 2 = 0"))


@query("a11_batch_log", "SELECT batch_id, min(ts) AS submitted, count(DISTINCT item) AS n_cases FROM ev GROUP BY batch_id")
def _(t):
    return aggregates.batch_log(t.events)


# windows


@query("w1_latest", "SELECT case_no, ts, id, outcome FROM (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY ts DESC, id DESC) AS n FROM ev) WHERE n = 1")
def _(t):
    return windows.latest(t.events, ["case_no"], "ts", "id").select("case_no", "ts", "id", "outcome")


LABELS = f"""{SHEET_ENTITIES}, label_map AS (
  SELECT tenant, degree, case_no, kind, value, '[' || upper(kind) || '_' || row_number() OVER (PARTITION BY tenant, degree, case_no, kind ORDER BY at_piece, at_start, value) || ']' AS label
  FROM (SELECT tenant, degree, case_no, kind, value, min(piece_id) AS at_piece, min(start) AS at_start FROM found GROUP BY ALL))"""


@query("w2_number_labels", "SELECT tenant, degree, case_no, kind, value, label FROM label_map", LABELS)
def _(t):
    return windows.number_labels(deid.detect_patterns(t.sheets))


@query("w3_keep_recent", "SELECT profile, ts, id FROM (SELECT *, row_number() OVER (PARTITION BY profile ORDER BY ts DESC, id DESC) AS n FROM ev) WHERE n <= 10")
def _(t):
    return windows.keep_recent(t.events, ["profile"], "ts", "id", 10).select("profile", "ts", "id")


@query("w4_compare_days_ago", """
SELECT *, last_value(n IGNORE NULLS) OVER (PARTITION BY tenant, view, board ORDER BY day RANGE BETWEEN INTERVAL 35 DAYS PRECEDING AND INTERVAL 30 DAYS PRECEDING) AS before FROM daily""", DAILY)
def _(t):
    return windows.compare_days_ago(_daily(t), 30, 5)


@query("w5_pick_templates", """
SELECT * FROM (SELECT doc_id AS template_id, source AS category, n_chars, row_number() OVER w AS rank, CAST(sum(n_chars) OVER w AS BIGINT) AS total_chars
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING)) WHERE rank <= 8 AND total_chars <= 20000""")
def _(t):
    rows = t.table("documents").select(F.col("doc_id").alias("template_id"), F.col("source").alias("category"), "n_chars")
    return windows.pick_templates(rows, None, 8, 20000)


@query("w6_resent_bytes", """
SELECT tenant, degree, case_no, turn, CAST(bytes AS BIGINT) AS bytes, CAST(sum(bytes) OVER (PARTITION BY tenant, degree, case_no ORDER BY turn) AS BIGINT) AS total FROM (
  SELECT t.tenant, t.degree, t.case_no, t.turn, coalesce(sum(m.n_bytes), 0) AS bytes FROM (SELECT DISTINCT tenant, degree, case_no, turn FROM turns) t
  LEFT JOIN pieces m ON m.tenant = t.tenant AND m.degree = t.degree AND m.case_no = t.case_no AND m.piece_id % 4 - 1 <= t.turn GROUP BY ALL)""")
def _(t):
    # some pieces are marked before the first turn, and some once more later on
    marked = t.pieces.select(*KEY, F.expr("piece_id % 4 - 1").alias("turn"), "piece_id")
    again = marked.filter("piece_id % 2 = 0").withColumn("turn", F.expr("turn + 2"))
    return windows.resent_bytes(t.turns, marked.unionByName(again), t.pieces)


# sorts, limits, sets


@query("t1_oldest_cases", "SELECT case_no, arrival FROM cases WHERE queue = 'O' ORDER BY arrival, case_no, tenant, degree LIMIT 5")
def _(t):
    return sets.oldest_cases(t.cases, "O", 5).select("case_no", "arrival")


@query("t2_newest_cases_cap", "SELECT id, case_no, ts FROM ev SEMI JOIN (SELECT tenant, degree, case_no FROM ev GROUP BY ALL ORDER BY max(ts) DESC, case_no DESC, degree DESC, tenant DESC LIMIT 100) USING (tenant, degree, case_no)")
def _(t):
    return sets.newest_cases_cap(t.events, 100).select("id", "case_no", "ts")


TIMELINE = """timeline AS (
  SELECT tenant, degree, case_no, CAST(piece_date AS TIMESTAMP) AS ts, 'piece' AS kind, piece_id AS id, title AS what FROM pieces
  UNION ALL SELECT tenant, degree, case_no, mov_ts, 'movement', mov_id, mov_type FROM movements)"""


@query("t3_order_timeline", "SELECT * FROM timeline ORDER BY tenant, degree, case_no, ts, kind, id", TIMELINE)
def _(t):
    return sets.order_timeline(sets.timeline(t.pieces, t.movements))


@query("u1_scope", "SELECT DISTINCT tenant, degree, case_no FROM cases WHERE queue = 'P' OR list_contains(tags, 'RF') OR (tenant, degree, case_no) IN (SELECT (tenant, degree, case_no) FROM pieces)")
def _(t):
    return sets.scope(t.cases, "P", "RF", t.pieces)


@query("u2_apply_tags", f"SELECT tenant, degree, case_no, CASE WHEN case_no % 3 = 0 THEN {AFTER} ELSE tags END AS tags FROM cases")
def _(t):
    return sets.apply_tags(t.cases, _changes(t)).select(*KEY, "tags")


@query("u3_undo_tags", "SELECT tenant, degree, case_no, tags FROM cases WHERE tags IS NOT NULL")
def _(t):
    cases = t.cases.filter("tags IS NOT NULL")
    done = sets.apply_tags(cases, _changes(t))
    return sets.undo_tags(done, sets.tag_changes(cases, _changes(t), "run 1"), "run 1").select(*KEY, "tags")


@query("u4_exclude_queues", "SELECT case_no, queue FROM cases WHERE queue <> 'F'")
def _(t):
    return sets.exclude_queues(t.cases, t.cases.filter("queue = 'F'").select("queue").distinct()).select("case_no", "queue")


@query("u5_timeline", "SELECT * FROM timeline", TIMELINE)
def _(t):
    return sets.timeline(t.pieces, t.movements)


VISITS = "visits AS (SELECT tenant, max(arrival) - 200 AS last_visit FROM cases GROUP BY tenant)"


@query("u6_changed_since", "SELECT case_no, last_mov FROM cases JOIN visits USING (tenant) WHERE last_mov > last_visit", VISITS)
def _(t):
    visits = t.cases.groupBy("tenant").agg(F.date_sub(F.max("arrival"), 200).alias("last_visit"))
    return sets.changed_since(t.cases, visits).select("case_no", "last_mov")


@query("u7_move_cases", """
SELECT tenant, degree, case_no, coalesce(e.to_queue, c.queue) AS queue FROM cases c LEFT JOIN moves m USING (tenant, degree, case_no)
LEFT JOIN exits e ON e.queue = c.queue AND e.exit = m.exit AND e.batch""", MOVES)
def _(t):
    return sets.move_cases(t.cases, _moves(t).unionByName(_moves(t)), _exits(t)).select(*KEY, "queue")


# de-identification


@query("d1_detect_patterns", "SELECT * FROM found", SHEET_ENTITIES)
def _(t):
    return deid.detect_patterns(t.sheets)


@query("d1_detect_patterns_in_pieces", "SELECT * FROM found", _found_sql("found", "pieces", IDENTIFIERS))
def _(t):
    return deid.detect_patterns(t.pieces)


@query("d2_detect_rg", 'SELECT tenant, degree, case_no, piece_id, kind, value, "end" - length(value) AS start, "end" FROM found', _found_sql("found", "sheets", {"rg": RG}, 1))
def _(t):
    return deid.detect_rg(t.sheets)


REGISTER = """
SELECT s.tenant, s.degree, s.case_no, s.piece_id, 'person' AS kind, name AS value, CAST(strpos(s.text, name) - 1 AS BIGINT) AS start,
       CAST(strpos(s.text, name) - 1 + length(name) AS BIGINT) AS "end" FROM sheets s JOIN parties p USING (tenant, degree, case_no)
UNION ALL
SELECT s.tenant, s.degree, s.case_no, s.piece_id, 'person', name, CAST(length(s.text) - 1 - length(name) AS BIGINT), CAST(length(s.text) - 1 AS BIGINT)
FROM sheets s JOIN parties p USING (tenant, degree, case_no)
UNION ALL
SELECT s.tenant, s.degree, s.case_no, s.piece_id, 'number', substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 2),
       CAST(strpos(s.text, ', CPF ') + 5 AS BIGINT), CAST(strpos(s.text, ', CPF ') + 19 AS BIGINT)
FROM sheets s JOIN parties p USING (tenant, degree, case_no)"""


@query("d3_detect_register", REGISTER)
def _(t):
    return deid.detect_register(t.sheets, t.parties)


@query("d3_detect_register_all", REGISTER)
def _(t):
    return deid.detect_register(t.sheets, t.parties.withColumn("name", F.concat(F.lit(" "), F.upper("name"))))


DECOMPOSED = "A\u0301u\u0303o"


@query("d3_detect_register_decomposed", f"""
SELECT tenant, degree, case_no, sheet_id AS piece_id, 'person' AS kind, '{DECOMPOSED} ' || name AS value, CAST(unnest([4, 15 + length(name)]) AS BIGINT) AS start,
       CAST(unnest([10 + length(name), 21 + 2 * length(name)]) AS BIGINT) AS "end" FROM parties""")
def _(t):
    # accents are marks of their own in the texts, as PDFs have them, and part of the letter in the register
    text = F.concat(F.lit(f"Réu {DECOMPOSED} "), "name", F.lit(f"; c/c {DECOMPOSED} ").substr(F.lit(2), F.lit(99)), "name", F.lit("."))
    texts = t.parties.select(*KEY, F.col("sheet_id").alias("piece_id"), text.alias("text"))
    return deid.detect_register(texts, t.parties.withColumns({"name": F.concat(F.lit("ÁŨO "), "name"), "cpf": F.lit("")}))


KEPT = _found_sql("kept", "sheets", {k: MENTIONS[k] for k in ("date", "law", "deadline")})


@query("d4_detect_model", """
SELECT tenant, degree, case_no, piece_id, 'person' AS kind, regexp_extract(text, 'Autor ([^ ,]+),', 1) AS value, CAST(6 AS BIGINT) AS start,
       CAST(6 + length(regexp_extract(text, 'Autor ([^ ,]+),', 1)) AS BIGINT) AS "end" FROM sheets""")
def _(t):
    return deid.detect_model(t.sheets, _name_after_label)


def _name_after_label(batches):
    """Stands for a user's model: the word after a label, with its place."""
    for b in batches:
        value = b["text"].str.extract("Autor ([^ ,]+),")[0]
        yield b[PIECE_KEY].assign(kind="person", value=value, start=6, end=6 + value.str.len())


@query("d5_drop_preserved", """
SELECT * FROM both_kinds e WHERE NOT EXISTS (
  SELECT 1 FROM kept k WHERE k.piece_id = e.piece_id AND e.start < k."end" AND k.start < e."end")""",
    f"{_found_sql('found', 'sheets', {'cep': IDENTIFIERS['cep'], 'number': '[0-9]+'})}, both_kinds AS (SELECT * FROM found), {KEPT}")
def _(t):
    return deid.drop_preserved(deid.detect_patterns(t.sheets, {"cep": IDENTIFIERS["cep"], "number": "[0-9]+"}), t.sheets)


@query("d6_resolve_spans", """
SELECT e.* FROM found e WHERE kind = 'cep' OR NOT EXISTS (
  SELECT 1 FROM found c WHERE c.kind = 'cep' AND c.piece_id = e.piece_id AND e.start < c."end" AND c.start < e."end")""",
    _found_sql("found", "sheets", {"cep": IDENTIFIERS["cep"], "number": "[0-9]+"}))
def _(t):
    return deid.resolve_spans(deid.detect_patterns(t.sheets, {"cep": IDENTIFIERS["cep"], "number": "[0-9]+"}))


MASKED = LABELS + """, masked AS (
  SELECT tenant, degree, case_no, piece_id, coalesce(list_reduce(list_prepend(text, labels), lambda a, x: replace(a, split_part(x, chr(1), 1), split_part(x, chr(1), 2))), text) AS masked
  FROM sheets LEFT JOIN (SELECT tenant, degree, case_no, list(value || chr(1) || label ORDER BY length(value) DESC, value) AS labels FROM label_map GROUP BY ALL) USING (tenant, degree, case_no))"""


def _masked(t: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    path = t.place("sheets")  # texts lie in a table, as a rule; without one each step would make the sheets again
    t.sheets.write.parquet(path)
    sheets = t.spark.read.schema(t.sheets.schema).parquet(path)
    found = deid.detect_patterns(sheets)
    labels = windows.number_labels(found)
    return found, labels, deid.mask(sheets, labels)


@query("d7_mask", "SELECT tenant, degree, case_no, piece_id, masked FROM masked", MASKED)
def _(t):
    return _masked(t)[2].select(*PIECE_KEY, "masked")


@query("d7_mask_fields", """
SELECT tenant, degree, case_no, sheet_id AS id, 'title' AS field, 'Autor [PERSON_1]' AS masked FROM parties
UNION ALL SELECT tenant, degree, case_no, sheet_id, 'thesis', 'Defende [PERSON_1] em juízo' FROM parties""")
def _(t):
    labels = t.parties.select(*KEY, F.lit("person").alias("kind"), F.col("name").alias("value"), F.lit("[PERSON_1]").alias("label"))
    rows = t.parties.select(*KEY, F.col("sheet_id").alias("id"), F.concat(F.lit("Autor "), "name").alias("title"), F.concat(F.lit("Defende "), "name", F.lit(" em juízo")).alias("thesis"))
    return deid.mask_fields(rows, labels, ["title", "thesis"])


@query("d8_unmask", "SELECT tenant, degree, case_no, piece_id, text AS unmasked FROM sheets")
def _(t):
    _, labels, masked = _masked(t)
    return deid.unmask(masked, labels).select(*PIECE_KEY, "unmasked")


#: Texts whose turns are numbered inside of each case, so that cases share the numbers.
OUTGOING = "outgoing AS (SELECT tenant, degree, case_no, piece_id % 5 AS turn, piece_id, n_bytes, text FROM pieces)"


def _outgoing(t: Inputs) -> DataFrame:
    return t.pieces.select(*KEY, F.expr("piece_id % 5").alias("turn"), "piece_id", "n_bytes", "text")


@query("d9_barrier", """
SELECT tenant, degree, case_no, turn, n_bytes FROM outgoing o WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE item_id % 4 <> 0 AND contains(o.text, b.text))""", OUTGOING)
def _(t):
    outgoing = _outgoing(t)
    return deid.barrier(outgoing, deid.global_hits(outgoing, t.values.filter("NOT released"))).select(*KEY, "turn", "n_bytes")


@query("d9_barrier_hits", "SELECT tenant, degree, case_no, turn, b.text AS value, CAST(strpos(o.text, b.text) AS BIGINT) AS at FROM outgoing o JOIN benchmark b ON contains(o.text, b.text)", OUTGOING)
def _(t):
    return deid.global_hits(_outgoing(t), t.values)


@query("d9_barrier_short_values", """
SELECT DISTINCT tenant, degree, case_no, turn, v.value, CAST(strpos(o.text, v.value) AS BIGINT) AS at
FROM outgoing o JOIN (SELECT DISTINCT substr(props, 1, 4) AS value FROM ev UNION SELECT DISTINCT regexp_extract(text, '[A-Za-z]{6,}') FROM turns) v ON v.value <> '' AND contains(o.text, v.value)""", OUTGOING)
def _(t):
    short = t.events.select(F.substring("props", 1, 4).alias("value"))
    words = t.turns.select(F.regexp_extract("text", "[A-Za-z]{6,}", 0).alias("value"))
    return deid.global_hits(_outgoing(t), short.unionByName(words))


@query("d10_apply_releases", """
SELECT f.tenant, f.degree, f.case_no, f.piece_id, f.kind, f.value FROM once f ANTI JOIN (SELECT DISTINCT value FROM once WHERE kind = 'phone' AND case_no < 50) r ON r.value = f.value
WHERE NOT (f.kind = 'cep' AND f.case_no % 2 = 0)""", f"{SHEET_ENTITIES}, once AS MATERIALIZED (SELECT * FROM found)")
def _(t):
    found = deid.detect_patterns(t.sheets)
    own = found.filter("kind = 'cep' AND case_no % 2 = 0").select(*KEY, ids.name_norm(F.col("value")).alias("value_norm"))
    everywhere = found.filter("kind = 'phone' AND case_no < 50").select(*[F.lit(None).cast("bigint").alias(c) for c in KEY], ids.name_norm(F.col("value")).alias("value_norm"))
    return deid.apply_releases(found, own.unionByName(everywhere)).select(*PIECE_KEY, "kind", "value")


@query("d11_apply_overrides", """
SELECT * FROM (SELECT * FROM found WHERE NOT (kind = 'cep' AND case_no % 3 = 0)
  UNION ALL SELECT tenant, degree, case_no, piece_id, 'manual', 'Autor', CAST(0 AS BIGINT), CAST(5 AS BIGINT) FROM sheets WHERE case_no % 5 = 0) WHERE case_no % 11 <> 0""", SHEET_ENTITIES)
def _(t):
    found = deid.detect_patterns(t.sheets)
    none, manual = F.lit(None), t.sheets.filter("case_no % 5 = 0")
    rows = manual.select(*PIECE_KEY, F.lit("mask").alias("action"), F.lit("manual").alias("kind"), F.lit("Autor").alias("value"), F.lit(0).cast("long").alias("start"), F.lit(5).cast("long").alias("end"))
    rows = rows.unionByName(found.filter("kind = 'cep' AND case_no % 3 = 0").select(*PIECE_KEY, F.lit("release").alias("action"), "kind", "value", "start", "end"))
    drop = t.sheets.filter("case_no % 11 = 0").select(*PIECE_KEY, F.lit("drop").alias("action"), none.cast("string").alias("kind"), none.cast("string").alias("value"), none.cast("long").alias("start"), none.cast("long").alias("end"))
    return deid.apply_overrides(found, rows.unionByName(drop))


@query("d11_edited_texts", "SELECT piece_id, CASE WHEN piece_id % 4 = 0 THEN 'edited ' || title ELSE text END AS text FROM pieces")
def _(t):
    edits = t.pieces.filter("piece_id % 4 = 0").select(*PIECE_KEY, F.concat(F.lit("edited "), "title").alias("edited"))
    return deid.edited_texts(t.pieces, edits).select("piece_id", "text")


@query("d12_mask_audit", """
SELECT tenant, degree, case_no, piece_id, c.kind, c.n, m.masked, l.labels FROM (SELECT tenant, degree, case_no, piece_id, kind, count(*) AS n FROM found GROUP BY ALL) c
JOIN masked m USING (tenant, degree, case_no, piece_id) LEFT JOIN (SELECT tenant, degree, case_no, list(label || '|' || value ORDER BY label) AS labels FROM label_map GROUP BY ALL) l USING (tenant, degree, case_no)""", MASKED)
def _(t):
    # not from a table: the sheets are dealt by case once, and all that the view tells is made where they then lie
    out = deid.audit(t.sheets, deid.detect_patterns(t.sheets))
    return out.withColumn("labels", F.transform("labels", lambda x: F.concat_ws("|", x["label"], x["value"])))


@query("s11_export_mask_report", """
SELECT tenant, degree, case_no, piece_id, c.kind, c.n, m.masked AS text FROM (SELECT tenant, degree, case_no, piece_id, kind, count(*) AS n FROM found GROUP BY ALL) c JOIN masked m USING (tenant, degree, case_no, piece_id)""", MASKED)
def _(t):
    found, _, masked = _masked(t)
    return exports.export_mask_report(masked, aggregates.mask_counts(found))


@query("d13_approval_gate", """
SELECT tenant, degree, case_no, piece_id % 2 AS turn, count(*) FILTER (piece_id % 5 <> 0 AND piece_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)) = 0 AS passes
FROM pieces GROUP BY ALL""")
def _(t):
    # piece ids are numbered inside of each case here: what another case has sent must not count
    approved = t.pieces.join(t.table("labels").filter("quality = 1").select(F.col("doc_id").alias("piece_id")), "piece_id", "left_semi")
    pieces = _local(t.pieces.select(*PIECE_KEY, F.expr("piece_id % 2").alias("turn")))
    return deid.approval_gate(pieces, _local(t.pieces.filter("piece_id % 5 = 0")), _local(approved))


@query("d14_purge_reasoning", """
SELECT tenant, degree, case_no, turn, role FROM turns t WHERE NOT (role = 'assistant' AND EXISTS (
  SELECT 1 FROM (SELECT tenant, degree, case_no, regexp_extract(text, '[A-Za-z]{8,}') AS value FROM turns WHERE role = 'user') v
  WHERE v.tenant = t.tenant AND v.degree = t.degree AND v.case_no = t.case_no AND v.value <> '' AND contains(t.text, v.value)))""")
def _(t):
    values = t.turns.filter("role = 'user'").select(*KEY, F.regexp_extract("text", "[A-Za-z]{8,}", 0).alias("value"))
    return deid.purge_reasoning(t.turns, values).select(*KEY, "turn", "role")


# scalar functions


@query("x1_cpf_valid", "SELECT person_id, cpf, true AS good, false AS bad FROM persons")
def _(t):
    wrong = F.expr("concat(substr(cpf, 1, 10), CAST((CAST(substr(cpf, 11, 1) AS INT) + 1) % 10 AS STRING))")
    return t.persons.select("person_id", "cpf", ids.cpf_valid(F.col("cpf")).alias("good"), ids.cpf_valid(wrong).alias("bad"))


@query("x2_mentions", f"SELECT * FROM found UNION ALL ({REGISTER})", _found_sql("found", "sheets", MENTIONS))
def _(t):
    return deid.mentions(t.sheets, t.parties)


@query("x3_key_fingerprint", "SELECT id, substr(sha256(props), 1, 8) AS key_fp FROM ev")
def _(t):
    return t.events.select("id", ids.key_fingerprint(F.col("props")).alias("key_fp"))


@query("x4_case_no_norm", "SELECT case_no, '0' || case_no AS norm FROM cases")
def _(t):
    return t.cases.select("case_no", ids.case_no_norm(F.concat(F.lit(" 0-"), F.col("case_no").cast("string"), F.lit("."))).alias("norm"))


@query("x5_name_norm", """
SELECT piece_id, trim(regexp_replace(translate(lower(text), 'áàâãäåéèêëíìîïóòôõöúùûüçñý', 'aaaaaaeeeeiiiiooooouuuucny'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS norm FROM pieces""")
def _(t):
    return t.pieces.select("piece_id", ids.name_norm(F.col("text")).alias("norm"))


@query("x6_parse_analysis", """
SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM ev""")
def _(t):
    return parsing.parse_analysis(t.events.select("id", "props"), "props", "k bigint").drop("props")


@query("x6_parse_analysis_record", "SELECT tenant, degree, case_no, situation, next_act, ['tag|' || situation] AS suggestions, CAST(NULL AS VARCHAR) AS answer FROM analyses")
def _(t):
    rows = t.analyses.select(*KEY, F.to_json(F.struct("situation", "next_act", F.array(F.struct(F.lit("tag").alias("kind"), F.col("situation").alias("name"))).alias("suggestions"))).alias("json"))
    told = F.transform("suggestions", lambda x: F.concat_ws("|", x["kind"], x["name"])).alias("suggestions")
    return parsing.parse_analysis(rows, "json").select(*KEY, "situation", "next_act", told, "answer")


@query("x7_check_notes", "SELECT case_no, item AS piece_id, id AS note_id, outcome AS text FROM ev WHERE id % 10 <> 0")
def _(t):
    lines = exports.export_notes(_notes(t), t.events.select(*KEY))
    broken = F.when(F.get_json_object("line", "$.note_id").cast("long") % 10 == 0, F.expr("substr(line, 1, 20)")).otherwise(F.col("line"))
    return parsing.check_notes(lines.select(broken.alias("line")))[0].select("case_no", "piece_id", "note_id", "text")


@query("x8_expires_at", """
SELECT id, kind, CASE kind WHEN 'drafts' THEN ts + INTERVAL 7 DAYS WHEN 'actions' THEN ts + INTERVAL 30 DAYS WHEN 'authorizations' THEN ts + INTERVAL 48 HOURS END AS expires
FROM (SELECT id, ts, CASE id % 4 WHEN 0 THEN 'drafts' WHEN 1 THEN 'actions' WHEN 2 THEN 'authorizations' ELSE 'templates' END AS kind FROM ev)""")
def _(t):
    rows = t.events.select("id", "ts", F.expr("CASE id % 4 WHEN 0 THEN 'drafts' WHEN 1 THEN 'actions' WHEN 2 THEN 'authorizations' ELSE 'templates' END").alias("kind"))
    return rows.select("id", "kind", expires_at(F.col("ts"), F.col("kind")).alias("expires"))


@query("x9_age_bucket", f"""
SELECT case_no, CASE WHEN DATE '{NOW_ORDERS}' - arrival <= 365 THEN 'up to 365' WHEN DATE '{NOW_ORDERS}' - arrival <= 730 THEN 'up to 730' ELSE 'over 730' END AS age FROM cases""")
def _(t):
    return parsing.age_bucket(t.cases, [730, 365], F.lit(NOW_ORDERS).cast("date")).select("case_no", "age")


@query("x10_tag_outcome", """
SELECT case_no, CASE WHEN list_contains(tags, 'AF') THEN 'already had' WHEN case_no % 5 <> 0 THEN 'placed' ELSE 'not recorded' END AS outcome FROM cases WHERE tags IS NOT NULL""")
def _(t):
    after = F.when(F.expr("case_no % 5 <> 0"), F.array_append("tags", F.lit("AF"))).otherwise(F.col("tags"))
    rows = t.cases.filter("tags IS NOT NULL").select("case_no", F.col("tags").alias("before"), F.lit("AF").alias("wanted"), after.alias("after"))
    return parsing.tag_outcome(rows).select("case_no", "outcome")


# table changes


@query("m1_retain_drafts", f"""
SELECT tenant, id, ts FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, id DESC) AS n FROM ev WHERE ts > TIMESTAMP '{NOW_EVENTS}' - INTERVAL 7 DAYS) WHERE n <= 10""")
def _(t):
    return retention.retain(t.events, "drafts", now()).select("tenant", "id", "ts")


def _retained(kind: str) -> str:
    """The DuckDB twin of a retention rule over the events."""
    rule = RULES[kind]
    alive = f"ts > TIMESTAMP '{NOW_EVENTS}' - INTERVAL {rule.hours} HOURS" if rule.hours else "true"
    if rule.per_case:
        return f"""
SELECT e.tenant, e.id, e.case_no FROM ev e JOIN (
  SELECT tenant, degree, case_no, row_number() OVER (PARTITION BY tenant ORDER BY max(ts) DESC, case_no DESC, degree DESC) AS n FROM ev WHERE {alive} GROUP BY tenant, degree, case_no) c
  USING (tenant, degree, case_no) WHERE c.n <= {rule.cap} AND {alive}"""
    return f"""
SELECT tenant, id, case_no FROM (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY ts DESC, id DESC) AS n FROM ev WHERE {alive}) WHERE n <= {rule.cap or 2**31 - 1}"""


def _retain(kind: str):
    return lambda t: retention.retain(t.events, kind, now()).select("tenant", "id", "case_no")


for _kind in RULES:  # the drafts' own query stands above
    if _kind != "drafts":
        query(f"m1_retain_{_kind}", _retained(_kind))(_retain(_kind))


@query("m2_forget_case", "SELECT tenant, degree, case_no, piece_id FROM pieces WHERE NOT (case_no % 10 = 0 AND tenant % 2 = 0)")
def _(t):
    kept = retention.forget_case({"pieces": t.pieces, "turns": t.turns}, t.cases.filter("case_no % 10 = 0 AND tenant % 2 = 0"))
    return kept["pieces"].select(*PIECE_KEY)


@query("m3_forget_all", "SELECT id, tenant FROM ev WHERE tenant <> 3")
def _(t):
    return retention.forget_all({"actions": t.events}, 3)["actions"].select("id", "tenant")


@query("m4_merge_notes", """
SELECT tenant, degree, case_no, piece_id, sender_code, note_id, created_ts, text FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant, degree, case_no, piece_id, sender_code, note_id ORDER BY created_ts DESC, text DESC) AS n FROM (
    SELECT tenant, degree, case_no, item AS piece_id, 's' || profile AS sender_code, id AS note_id, 'd' || batch_id AS created_ts, outcome AS text FROM ev
    UNION ALL SELECT tenant, degree, case_no, item, 's' || profile, id, 'e' || batch_id, 'new ' || outcome FROM ev WHERE id % 4 = 0)) WHERE n = 1""")
def _(t):
    notes = _notes(t)
    newer = notes.filter("note_id % 4 = 0").withColumns({"created_ts": F.expr("concat('e', substr(created_ts, 2))"), "text": F.concat(F.lit("new "), "text")})
    return retention.merge_notes(notes, newer).select(*PIECE_KEY, "sender_code", "note_id", "created_ts", "text")


@query("m5_log_actions", f"SELECT tenant, degree, case_no, 'urgent' AS tag, 'placed' AS outcome, 'run 1' AS run_id, TIMESTAMP '{NOW_EVENTS}' AS ts, 'clerk' AS profile FROM parties WHERE case_no % 3 = 0")
def _(t):
    changes = t.parties.filter("case_no % 3 = 0").select(*KEY, F.lit("urgent").alias("tag"), F.lit("placed").alias("outcome"), "cpf", F.col("name").alias("content"))
    return retention.log_actions(changes, "run 1", now(), F.lit("clerk"))


@query("m6_replace_snapshot", "SELECT tenant, id, batch_id AS read_ts FROM ev WHERE (tenant, batch_id) IN (SELECT tenant, max(batch_id) FROM ev GROUP BY tenant)")
def _(t):
    return retention.snapshot(t.events.select("tenant", "id", F.col("batch_id").alias("read_ts")))


@query("m1_retain_table", _retained("actions"))
def _(t):
    table = Manifest(t.spark, t.place("actions"))
    table.replace(t.events.select("tenant", "id", "ts", "case_no"))
    retention.retain_table(table, "actions", now())
    return table.read().select("tenant", "id", "case_no")


@query("m6_replace_snapshot_table", "SELECT tenant, id, batch_id AS read_ts FROM ev WHERE batch_id % 3 = CASE WHEN tenant % 2 = 0 THEN 1 ELSE 0 END")
def _(t):
    # a reading of all tenants, then one of some of them
    rows = t.events.select("tenant", "id", F.col("batch_id").alias("read_ts"))
    table = Manifest(t.spark, t.place("snapshot"))
    retention.replace_snapshot(rows.filter("read_ts % 3 = 0"), table)
    retention.replace_snapshot(rows.filter("read_ts % 3 = 1 AND tenant % 2 = 0"), table)
    return table.read()


def _answers(batches):
    """Stands for a user's model."""
    for b in batches:
        yield b[list(KEY)].assign(answer="about " + b["situation"])


@query("analyse", "SELECT DISTINCT tenant, degree, case_no, 'about ' || situation AS answer FROM analyses WHERE situation <> 'old'")
def _(t):
    bundles = t.analyses.filter("situation <> 'old'").select(*KEY, "situation").distinct()
    ledger = t.place("answers")
    # a first run answers some cases, the second one asks for the rest only
    parsing.analyse(bundles.filter("tenant % 2 = 0"), _answers, ledger=ledger)
    return parsing.analyse(bundles, _answers, ledger=ledger)


@query("m7_discard", "SELECT id, outcome FROM ev WHERE id % 100 <> 0")
def _(t):
    return retention.discard(t.events, t.events.filter("id % 100 = 0").select("id"), "id").select("id", "outcome")


# streams: from a file source to a sink, to the end; and their batch twins


def _stream(t: Inputs, rows: DataFrame, name: str, per_batch: int = 1) -> DataFrame:
    """rows as a stream of files, some of them a micro-batch."""
    path = t.place(name)
    rows.repartitionByRange(4, "ts").write.parquet(path)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _drained(t: Inputs, writer, name: str) -> None:
    writer.option("checkpointLocation", t.place(f"{name}-checkpoint")).trigger(availableNow=True).start().awaitTermination()


def _sunk(t: Inputs, out: DataFrame, name: str) -> DataFrame:
    path = t.place(f"{name}-sink")
    _drained(t, out.writeStream.format("parquet").option("path", path), name)
    return t.spark.read.schema(out.schema).parquet(path)


def _stream_rows(t: Inputs) -> DataFrame:
    """Events with a time that watermarks take."""
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


#: Later than any row of the events: nothing is dropped.
DELAY = "60 days"


@query("st1_dedupe_submissions", "SELECT DISTINCT id AS submission_id FROM ev")
def _(t):
    rows = _stream_rows(t).select(F.col("id").alias("submission_id"), "ts")
    return _sunk(t, triage.dedupe_submissions(_stream(t, rows.unionByName(rows), "st1"), DELAY).select("submission_id"), "st1")


@query("st1_first_submissions", "SELECT DISTINCT id AS submission_id FROM ev")
def _(t):
    rows = t.events.select(F.col("id").alias("submission_id"), "ts")
    return triage.first_submissions(rows.unionByName(rows)).select("submission_id")


PROGRESS = "SELECT batch_id, count(DISTINCT item) AS done, count(DISTINCT item) = 20 AS closed FROM ev WHERE outcome <> 'error' OR batch_id % 2 = 0 GROUP BY batch_id"


@query("st2_stream_progress", PROGRESS)
def _(t):
    rows = _stream_rows(t).filter("outcome <> 'error' OR batch_id % 2 = 0").select("batch_id", "item", "ts")
    told = _sunk(t, triage.stream_progress(_stream(t, rows.unionByName(rows), "st2"), 20, DELAY), "st2")
    return windows.latest(told, ["batch_id"], "done", "closed")


@query("st2_closing_rows", "SELECT batch_id, count(DISTINCT item) AS done, CAST(1 AS BIGINT) AS n FROM ev GROUP BY batch_id HAVING count(DISTINCT item) = 20")
def _(t):
    # every result comes twice: a batch still closes once
    rows = _stream_rows(t).select("batch_id", "item", "ts")
    told = _sunk(t, triage.stream_progress(_stream(t, rows.unionByName(rows), "st2"), 20, DELAY), "st2")
    return told.filter("closed").groupBy("batch_id", "done").agg(F.count("*").alias("n"))


@query("st2_batch_progress", PROGRESS)
def _(t):
    rows = t.events.filter("outcome <> 'error' OR batch_id % 2 = 0")
    # dealt to all tasks: the ids alone are small enough for one, their items are not
    batches = t.events.select("batch_id").distinct().repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "batch_id")
    items = batches.select("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))).alias("item"))
    return aggregates.batch_progress(items, rows).filter("done > 0").select("batch_id", "done", "closed")


LATEST = """
SELECT tenant, degree, case_no, result_id FROM (
  SELECT tenant, degree, case_no, id AS result_id, row_number() OVER (PARTITION BY tenant, degree, case_no ORDER BY ts DESC, id DESC) AS n FROM ev) WHERE n = 1"""


@query("st3_stream_latest", LATEST)
def _(t):
    rows = _stream_rows(t).select(*KEY, "ts", F.col("id").alias("result_id"))
    table = Manifest(t.spark, t.place("st3"))
    _drained(t, triage.stream_latest(_stream(t, rows, "st3"), table.path, list(KEY)), "st3")
    return triage.read_latest(table, list(KEY)).select(*KEY, "result_id")


@query("st3_batch_latest", LATEST)
def _(t):
    return windows.latest(t.events.select(*KEY, "ts", F.col("id").alias("result_id")), list(KEY), "ts", "result_id").select(*KEY, "result_id")


TAGGED = "SELECT ev.batch_id, id FROM ev JOIN grants ON ev.batch_id = grants.batch_id AND ts BETWEEN granted_ts AND granted_ts + INTERVAL 48 HOURS"


@query("st4_stream_auto_tag", TAGGED, GRANTS)
def _(t):
    grants = _grants(t).withColumn("granted_ts", F.col("granted_ts").cast("timestamp"))
    results = _stream(t, _stream_rows(t).select("batch_id", "id", "ts"), "st4", 4)
    out = triage.stream_auto_tag(results, _stream(t, grants.withColumn("ts", F.col("granted_ts")), "st4-grants", 4).drop("ts"), DELAY)
    return _sunk(t, out.select("batch_id", "id"), "st4")


@query("st4_batch_auto_tag", TAGGED, GRANTS)
def _(t):
    return joins.auto_tag(t.events.select("batch_id", "id", "ts"), _grants(t)).select("batch_id", "id")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The barrier: turns of which no text holds a protected value."""
    return QUERIES["d9_barrier"](spark, folder)
