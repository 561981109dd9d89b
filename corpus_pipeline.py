"""A training corpus from documents, in five stages.

Every stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and all
but the last return the columns of documents. Between stages the rows are written as Parquet and
read again, so a stage that is lost with its executors starts from a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written
from docketry.llm.decontam import decontaminate
from docketry.llm.langid import fit, keep_known
from docketry.llm.line_dedup import dedup_lines
from docketry.llm.mixing import mix
from docketry.llm.simhash import near_duplicates

#: No stage but the first could be put in SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is in one of the languages of the labelled rows; texts without letters go."""
    return keep_known(docs, fit(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without the lines that three documents or more share, but for the one with the largest doc_id.

    n_chars, where there is such a column, follows the text. Null texts come out empty, rows with null
    ids keep their lines, and rows that share an id are one document.
    """
    out = dedup_lines(docs).select(*[f"`{c}`" for c in docs.columns])
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id; rows with null ids stay.

    Near-duplicates: texts of the same words, or whose sets of five-word shingles have a cosine of 0.8
    or more. The vantage-point tree over fingerprints finds the closest, bands of min-hashes all but one in a
    million of those right at 0.8; whole sets decide. Null, empty and blank texts are copies of each other. Rows that share an id go together.
    """
    groups = near_duplicates(docs, words=5, similarity=0.8)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words lies in spans shared with the benchmark.

    Texts without words are clean, null ids are decided like any other, and repeated rows alike.
    """
    told = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    bad = told.filter("contaminated").select(F.col("doc_id").alias("__bad_id"), F.col("row_h").alias("__bad_h")).distinct()
    bad = written(bad, "contaminated")  # a table, so that Spark knows its size and sends it where it is small
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"]) == F.col("__bad_h"))
    return docs.join(bad, same, "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with the slots at which their sources' blocks run; reading by slot mixes.

    A null source counts as one of its own, ties of ids go by a hash of the text, and repeated rows stay.
    """
    return mix(docs)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_dedup", near_dedup),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
