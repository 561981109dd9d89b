"""The operators' inputs, derived from the given tables: in Spark, and the same in DuckDB.

tenant, degree and case_no are the case key. Numbers repeat: two cases of different tenants share each.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.functions.ids import cpf_of

NOW_EVENTS = "2024-01-31 00:00:00"
NOW_ORDERS = "2001-12-01"


KEY = ("tenant", "degree", "case_no")


def keyed(df: DataFrame, k: str) -> DataFrame:
    """df with the case key of the k-th case."""
    return df.withColumns({"tenant": F.expr(f"({k}) % 7"), "degree": F.expr(f"1 + ({k}) div 7 % 2"), "case_no": F.expr(f"({k}) div 2")})


class Inputs:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def place(self, name: str) -> str:
        """A new path in the shared folder of the cluster, or in a temporary one where none is named."""
        shared = self.spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not self.spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        return f"{shared}/docketry-{self.spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"

    @cached_property
    def cases(self) -> DataFrame:
        items = self.table("lineitem").groupBy("l_orderkey").agg(
            F.max("l_shipdate").cast("date").alias("last_mov"),
            F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("tags"),
        )
        rows = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        rows = rows.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = rows.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        return keyed(rows, "o_orderkey").select(
            "tenant", "degree", "case_no", F.col("o_orderstatus").alias("queue"), F.col("r_name").alias("sector"),
            F.col("n_name").alias("unit"), F.col("c_mktsegment").alias("class"), F.col("o_orderpriority").alias("subject"), (F.col("o_orderpriority") == "1-URGENT").alias("priority"),
            (F.col("o_orderkey") % 17 == 0).alias("sealed"), F.col("o_orderdate").cast("date").alias("arrival"), "last_mov", "tags",
        )

    @cached_property
    def movements(self) -> DataFrame:
        rows = self.table("lineitem").select(
            "l_orderkey", F.col("l_shipdate").alias("mov_ts"), F.concat("l_returnflag", "l_linestatus").alias("mov_type"),
            F.expr("l_linenumber * 1000000 + l_partkey").alias("mov_id"),
        )
        return keyed(rows, "l_orderkey").drop("l_orderkey")

    @cached_property
    def pieces(self) -> DataFrame:
        rows = self.table("documents").select(
            F.col("doc_id").alias("piece_id"), 
            F.expr("CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 5 END").alias("parent_id"), F.col("source").alias("filed_by"),
            F.expr("CASE WHEN doc_id % 11 = 0 THEN 'attachment' ELSE 'court' END").alias("origin"), F.col("n_chars").alias("n_bytes"),
            F.concat(F.lit("piece "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("doc_type"),
            F.expr("date_add(DATE'2024-01-01', CAST(doc_id % 365 AS INT))").alias("piece_date"), "text",
        )
        return keyed(rows, "piece_id div 5")

    @cached_property
    def folios(self) -> DataFrame:
        rows = self.pieces.filter("text <> ''").select(*KEY, "piece_id", "text", F.explode(F.expr("sequence(0, (char_length(text) - 1) div 1500)")).alias("folio"))
        return rows.select(
            *KEY, "piece_id", F.col("folio").cast("int").alias("folio"), F.expr("substring(text, CAST(folio AS INT) * 1500 + 1, 1500)").alias("text"),
            F.expr("((piece_id * 37 + folio * 11) % 100) / 100.0D").alias("ocr_conf"), F.expr("(piece_id + folio) % 4 <> 0").alias("has_text_layer"),
        )

    @cached_property
    def persons(self) -> DataFrame:
        base = F.lpad(F.expr("(c_custkey * 7919 + 123456789) % 1000000000").cast("string"), 9, "0")
        return self.table("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), cpf_of(base).alias("cpf"))

    @cached_property
    def parties(self) -> DataFrame:
        rows = self.table("orders").join(self.persons, F.col("o_custkey") == F.col("person_id"))
        return keyed(rows, "o_orderkey").select(
            *KEY, F.col("o_orderkey").alias("sheet_id"), "name", F.lit("author").alias("role"), F.lit("active").alias("status"), "cpf", "person_id",
            F.expr("CASE WHEN person_id % 4 = 0 THEN 'legal' ELSE 'natural' END").alias("kind"),
            F.expr("CASE WHEN person_id % 5 = 0 THEN concat('OAB/CE ', CAST(1000 + person_id AS STRING)) END").alias("oab"),
        )

    @cached_property
    def sheets(self) -> DataFrame:
        """A case sheet for each case: a text with the identifiers of its party.

        Dealt by the case key, so that what works by case or by piece needs no other shuffle, to a number of
        tasks that the small size of the tables joined can't lower: texts cost more than their bytes tell.
        """
        rows = self.parties.join(self.table("orders"), F.col("sheet_id") == F.col("o_orderkey"))
        rows = rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), *KEY)
        return rows.select(*KEY, F.col("sheet_id").alias("piece_id"), F.expr("""concat(
            'Autor ', name, ', CPF ', substr(cpf, 1, 3), '.', substr(cpf, 4, 3), '.', substr(cpf, 7, 3), '-', substr(cpf, 10, 2),
            ', RG nº ', CAST(1000000 + person_id * 37 AS STRING), ', CEP ', lpad(CAST(person_id % 100000 AS STRING), 5, '0'), '-',
            lpad(CAST(sheet_id % 1000 AS STRING), 3, '0'), ', fone (85) 9', lpad(CAST(person_id % 10000 AS STRING), 4, '0'), '-',
            lpad(CAST(sheet_id % 10000 AS STRING), 4, '0'), ', em ', date_format(o_orderdate, 'dd/MM/yyyy'), ', prazo de ',
            CAST(5 + sheet_id % 20 AS STRING), ' dias, Lei nº 9.099/1995, valor R$ ', CAST(100 + sheet_id % 900 AS STRING),
            ',50, protocolo ', CAST(1000000 + sheet_id AS STRING), ', autor ', name, '.')""").alias("text"))  # fmt: skip

    @cached_property
    def analyses(self) -> DataFrame:
        """Some cases have an older analysis too, which saw an earlier movement."""
        last = self.cases.filter("case_no % 2 = 0").select(
            *KEY, F.expr("CASE WHEN case_no % 3 = 0 THEN date_sub(last_mov, 10) ELSE last_mov END").alias("last_mov_seen"),
            F.expr("date_add(arrival, 30)").alias("analysed"), F.concat(F.lit("in "), "queue").alias("situation"),
            F.concat(F.lit("review "), "class").alias("next_act"),
        )
        older = last.filter("case_no % 4 = 0").withColumns({"last_mov_seen": F.date_sub("last_mov_seen", 20), "analysed": F.date_sub("analysed", 25), "situation": F.lit("old")})
        return last.unionByName(older)

    @cached_property
    def selection(self) -> DataFrame:
        return self.pieces.filter("piece_id % 3 = 0").select(*KEY, "piece_id")

    @cached_property
    def turns(self) -> DataFrame:
        return keyed(self.table("conversations"), "conv_id").select(*KEY, "turn", "role", "text")

    @cached_property
    def values(self) -> DataFrame:
        return self.table("benchmark").select("item_id", F.col("text").alias("value"), F.expr("item_id % 4 = 0").alias("released"))

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_id").alias("id"), "ts", F.col("user_id").alias("profile"), F.expr("user_id % 7").alias("tenant"),
            F.expr("event_id % 500").alias("case_no"), F.expr("1 + event_id % 2").alias("degree"), F.expr("event_id % 20").alias("item"), F.expr("event_id div 20").alias("batch_id"),
            F.col("event_type").alias("outcome"), "props", "value",
        )


#: The same inputs as common table expressions.
SQL = r"""
items AS (
  SELECT l_orderkey, CAST(max(l_shipdate) AS DATE) AS last_mov, list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS tags
  FROM lineitem GROUP BY l_orderkey),
cases AS (
  SELECT o_orderkey % 7 AS tenant, 1 + o_orderkey // 7 % 2 AS degree, o_orderkey // 2 AS case_no, o_orderstatus AS queue, r_name AS sector,
         n_name AS unit, c_mktsegment AS class, o_orderpriority AS subject, o_orderpriority = '1-URGENT' AS priority, o_orderkey % 17 = 0 AS sealed,
         CAST(o_orderdate AS DATE) AS arrival, last_mov, tags
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey LEFT JOIN items ON o_orderkey = l_orderkey),
movements AS (
  SELECT l_orderkey // 2 AS case_no, l_shipdate AS mov_ts, l_returnflag || l_linestatus AS mov_type,
         CAST(l_linenumber * 1000000 + l_partkey AS BIGINT) AS mov_id, l_orderkey % 7 AS tenant, 1 + l_orderkey // 7 % 2 AS degree FROM lineitem),
pieces AS (
  SELECT doc_id AS piece_id, doc_id // 5 // 2 AS case_no, CASE WHEN doc_id % 5 <> 0 THEN doc_id - doc_id % 5 END AS parent_id,
         source AS filed_by, CASE WHEN doc_id % 11 = 0 THEN 'attachment' ELSE 'court' END AS origin, n_chars AS n_bytes,
         'piece ' || doc_id AS title, lang AS doc_type, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS piece_date, text,
         (doc_id // 5) % 7 AS tenant, 1 + doc_id // 5 // 7 % 2 AS degree FROM documents),
folios AS (
  SELECT tenant, degree, case_no, piece_id, CAST(folio AS INTEGER) AS folio, substr(text, folio * 1500 + 1, 1500) AS text,
         ((piece_id * 37 + folio * 11) % 100) / 100.0 AS ocr_conf, (piece_id + folio) % 4 <> 0 AS has_text_layer
  FROM (SELECT tenant, degree, case_no, piece_id, text, unnest(range(0, (length(text) - 1) // 1500 + 1)) AS folio FROM pieces WHERE text <> '')),
nine AS (SELECT c_custkey, c_name, lpad(CAST((c_custkey * 7919 + 123456789) % 1000000000 AS VARCHAR), 9, '0') AS b FROM customer),
ten AS (
  SELECT *, b || CAST((list_sum(list_transform(range(1, 10), lambda i: CAST(substr(b, i, 1) AS INTEGER) * (11 - i))) * 10 % 11) % 10 AS INTEGER) AS b10 FROM nine),
persons AS (
  SELECT c_custkey AS person_id, c_name AS name,
         b10 || CAST((list_sum(list_transform(range(1, 11), lambda i: CAST(substr(b10, i, 1) AS INTEGER) * (12 - i))) * 10 % 11) % 10 AS INTEGER) AS cpf FROM ten),
parties AS (
  SELECT o_orderkey % 7 AS tenant, 1 + o_orderkey // 7 % 2 AS degree, o_orderkey // 2 AS case_no, o_orderkey AS sheet_id, name, 'author' AS role, 'active' AS status, cpf, person_id,
         CASE WHEN person_id % 4 = 0 THEN 'legal' ELSE 'natural' END AS kind,
         CASE WHEN person_id % 5 = 0 THEN 'OAB/CE ' || (1000 + person_id) END AS oab FROM orders JOIN persons ON o_custkey = person_id),
sheets AS (
  SELECT tenant, degree, case_no, sheet_id AS piece_id,
         'Autor ' || name || ', CPF ' || substr(cpf, 1, 3) || '.' || substr(cpf, 4, 3) || '.' || substr(cpf, 7, 3) || '-' || substr(cpf, 10, 2) ||
         ', RG nº ' || (1000000 + person_id * 37) || ', CEP ' || lpad(CAST(person_id % 100000 AS VARCHAR), 5, '0') || '-' ||
         lpad(CAST(sheet_id % 1000 AS VARCHAR), 3, '0') || ', fone (85) 9' || lpad(CAST(person_id % 10000 AS VARCHAR), 4, '0') || '-' ||
         lpad(CAST(sheet_id % 10000 AS VARCHAR), 4, '0') || ', em ' || strftime(o_orderdate, '%d/%m/%Y') || ', prazo de ' ||
         (5 + sheet_id % 20) || ' dias, Lei nº 9.099/1995, valor R$ ' || (100 + sheet_id % 900) || ',50, protocolo ' || (1000000 + sheet_id) ||
         ', autor ' || name || '.' AS text
  FROM parties JOIN orders ON sheet_id = o_orderkey),
last_analyses AS (
  SELECT tenant, degree, case_no, CASE WHEN case_no % 3 = 0 THEN last_mov - 10 ELSE last_mov END AS last_mov_seen, arrival + 30 AS analysed,
         'in ' || queue AS situation, 'review ' || class AS next_act FROM cases WHERE case_no % 2 = 0),
analyses AS (
  SELECT * FROM last_analyses
  UNION ALL SELECT tenant, degree, case_no, last_mov_seen - 20, analysed - 25, 'old', next_act FROM last_analyses WHERE case_no % 4 = 0),
selection AS (SELECT tenant, degree, case_no, piece_id FROM pieces WHERE piece_id % 3 = 0),
turns AS (SELECT conv_id % 7 AS tenant, 1 + conv_id // 7 % 2 AS degree, conv_id // 2 AS case_no, turn, role, text FROM conversations),
vals AS (SELECT item_id, text AS value, item_id % 4 = 0 AS released FROM benchmark),
ev AS (
  SELECT event_id AS id, ts, user_id AS profile, user_id % 7 AS tenant, event_id % 500 AS case_no, 1 + event_id % 2 AS degree, event_id % 20 AS item,
         event_id // 20 AS batch_id, event_type AS outcome, props, value FROM events)
"""
