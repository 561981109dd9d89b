"""Exports: texts, indexes, lists, logs, notes and reports, as DataFrames and as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.schemas import CASE_KEY, LOGGED, PIECE_KEY


def export_case_text(pieces: DataFrame) -> DataFrame:
    """(case key, text): one Markdown text a case, its pieces by date and then by id.

    A case's text is one row, so its size is bounded by the case.
    """
    parts = F.array_sort(F.collect_list(F.struct("piece_date", "piece_id", "title", "text")))
    joined = F.array_join(F.transform(parts, lambda p: F.concat(F.lit("## "), p["title"], F.lit("\n\n"), F.coalesce(p["text"], F.lit("")))), "\n\n")
    return pieces.groupBy(*CASE_KEY).agg(joined.alias("text"))


def export_piece_text(pieces: DataFrame, buckets: int = 64) -> DataFrame:
    """(bucket, piece_id, text): rows to write by bucket."""
    return pieces.select(F.pmod("piece_id", F.lit(buckets)).cast("int").alias("bucket"), "piece_id", "text")


def write_piece_text(pieces: DataFrame, path: str, buckets: int = 64) -> None:
    rows = export_piece_text(pieces, buckets)
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def export_index(cases: DataFrame, pieces: DataFrame, parties: DataFrame) -> DataFrame:
    """(case key, warning, class, queue, parties, index): the case sheet and the list of its pieces.

    Sealed cases carry a warning. The numbers of parties and the OAB of lawyers are shown where there are
    any, for this is the user's own copy. Cases without pieces have an empty index.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct("piece_id", "title"))), lambda p: F.concat_ws(" - ", p["piece_id"], p["title"]))
    index = pieces.groupBy(*CASE_KEY).agg(F.array_join(lines, "\n").alias("index"))
    people = parties.groupBy(*CASE_KEY).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(", ", "role", "name", "cpf", "oab"))), "; ").alias("parties"))
    warning = F.when(F.col("sealed"), "SEALED").otherwise("")
    rows = cases.select(*CASE_KEY, warning.alias("warning"), "class", "queue").join(people, CASE_KEY, "left").join(index, CASE_KEY, "left")
    return rows.withColumn("index", F.coalesce("index", F.lit("")))


def export_list(cases: DataFrame) -> DataFrame:
    """A list of cases: allowed columns only, tags joined, no party and no document."""
    kept = [c for c in (*CASE_KEY, "class", "queue", "unit", "priority", "arrival", "last_mov") if c in cases.columns]
    return cases.select(*kept, F.array_join("tags", ", ").alias("tags"))


def write_list(cases: DataFrame, path: str) -> None:
    export_list(cases).write.mode("overwrite").option("header", True).csv(path)


def export_actions(actions: DataFrame) -> DataFrame:
    """The action log in order, in the log's own fields and no others."""
    return actions.select(*[c for c in LOGGED if c in actions.columns]).orderBy("ts", "action_id")


def write_actions(actions: DataFrame, path: str) -> None:
    """The action log as a sheet."""
    export_actions(actions).write.mode("overwrite").option("header", True).csv(path)


def export_notes(notes: DataFrame, marked: DataFrame, names: bool = True) -> DataFrame:
    """(line): the notes of the marked cases as JSON lines, with the sender's code and, if wanted, name."""
    fields = [*PIECE_KEY, "note_id", "text", "sender_code", "created_ts"] + ["sender_name"] * names
    return notes.join(marked.select(*CASE_KEY).distinct(), CASE_KEY, "left_semi").select(F.to_json(F.struct(*fields)).alias("line"))


def write_notes(notes: DataFrame, marked: DataFrame, path: str, names: bool = True) -> None:
    """The notes as a file of JSON lines, which check_notes reads."""
    export_notes(notes, marked, names).write.mode("overwrite").text(path)


def export_mask_report(masked: DataFrame, counts: DataFrame) -> DataFrame:
    """(case key, piece_id, kind, n, text): what was replaced and the text that left, without the label table."""
    return counts.join(masked.select(*PIECE_KEY, F.col("masked").alias("text")), PIECE_KEY).select(
        *PIECE_KEY, "kind", "n", "text"
    )
