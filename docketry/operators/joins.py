"""Joins. Sides are broadcast by Spark where their measured size allows it; nothing is forced."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import cpf_valid, name_norm
from docketry.operators.windows import latest
from docketry.schemas import CASE_KEY, PIECE_KEY


def selected_only(pieces: DataFrame, selection: DataFrame) -> DataFrame:
    """Pieces that were marked in their case."""
    return pieces.join(selection.select(*PIECE_KEY), PIECE_KEY, "left_semi")


def attach_children(pieces: DataFrame) -> DataFrame:
    """(case key, piece_id, title, children): main pieces with the sorted ids of what came with them."""
    kids = pieces.filter("parent_id IS NOT NULL").groupBy(*CASE_KEY, F.col("parent_id").alias("piece_id")).agg(F.array_sort(F.collect_list("piece_id")).alias("children"))
    out = pieces.filter("parent_id IS NULL").select(*PIECE_KEY, "title").join(kids, PIECE_KEY, "left")
    return out.withColumn("children", F.coalesce("children", F.array().cast("array<bigint>")))


def check_citations(citations: DataFrame, folios: DataFrame, selection: DataFrame) -> DataFrame:
    """citations (case key, piece_id, folio, ...) with status: ok, unresolved (no such page) or unselected (the piece wasn't marked in its case)."""
    pages = folios.select(*PIECE_KEY, "folio").distinct().withColumn("__page", F.lit(True))
    marked = selection.select(*PIECE_KEY).distinct().withColumn("__marked", F.lit(True))
    rows = citations.join(pages, [*PIECE_KEY, "folio"], "left").join(marked, PIECE_KEY, "left")
    status = F.when(F.col("__page").isNull(), "unresolved").when(F.col("__marked").isNull(), "unselected").otherwise("ok")
    return rows.withColumn("status", status).drop("__page", "__marked")


def referenced_not_selected(mentions: DataFrame, selection: DataFrame) -> DataFrame:
    """(case key, piece_id) of pieces that are mentioned and weren't marked."""
    return mentions.select(*PIECE_KEY).distinct().join(selection, PIECE_KEY, "left_anti")


def with_last_analysis(cases: DataFrame, analyses: DataFrame) -> DataFrame:
    """cases with the day, situation and next act of their last analysis."""
    last = latest(analyses, CASE_KEY, "analysed", "situation").select(*CASE_KEY, "analysed", "situation", "next_act")
    return cases.join(last, CASE_KEY, "left")


def needs_analysis(cases: DataFrame, analyses: DataFrame) -> DataFrame:
    """Cases without an analysis, or that have moved since their last one.

    Moved: the last movement differs from the one that the analysis saw, nulls alike being equal.
    """
    last = latest(analyses, CASE_KEY, "analysed", "last_mov_seen")
    seen = last.select(*CASE_KEY, F.col("last_mov_seen").alias("__seen"), F.lit(True).alias("__done"))
    rows = cases.join(seen, CASE_KEY, "left")
    return rows.filter(F.col("__done").isNull() | ~F.col("last_mov").eqNullSafe(F.col("__seen"))).drop("__seen", "__done")


def missing_parties(found: DataFrame, register: DataFrame) -> DataFrame:
    """People in the texts that the case's register lacks, by normal name."""
    known = register.select(*CASE_KEY, name_norm(F.col("name")).alias("name_norm")).distinct()
    return found.withColumn("name_norm", name_norm(F.col("name"))).join(known, [*CASE_KEY, "name_norm"], "left_anti")


def known_persons(proposed: DataFrame, persons: DataFrame) -> DataFrame:
    """proposed with the person_id of a valid, known CPF; the CPF itself does not come out."""
    known = persons.filter(cpf_valid(F.col("cpf"))).groupBy("cpf").agg(F.min("person_id").alias("person_id"))
    checked = proposed.withColumn("cpf", F.when(cpf_valid(F.col("cpf")), F.col("cpf")))
    return checked.join(known, "cpf", "left").drop("cpf")


def valid_exits(moves: DataFrame, exits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, refused): moves from queues that move in batch and have the wanted exit, and the rest."""
    open_exits = exits.filter("batch").select("queue", "exit").distinct()
    return moves.join(open_exits, ["queue", "exit"], "left_semi"), moves.join(open_exits, ["queue", "exit"], "left_anti")


def valid_tags(suggestions: DataFrame, register: DataFrame) -> DataFrame:
    """suggestions with outcome: exists, create (configured, may be made) or refused.

    register: (tag, configured). A tag that is in the register in both ways exists.
    """
    known = register.groupBy("tag").agg(F.min("configured").alias("__configured"))
    outcome = F.when(F.col("__configured").isNull(), "refused").when(F.col("__configured"), "create").otherwise("exists")
    return suggestions.join(known, "tag", "left").withColumn("outcome", outcome).drop("__configured")


def gathered(changes: DataFrame) -> DataFrame:
    """(case key, add, remove): all changes of a case in one row, so that none is lost and no case comes twice."""
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return changes.groupBy(*CASE_KEY).agg(every("add").alias("add"), every("remove").alias("remove"))


def preview(cases: DataFrame, changes: DataFrame) -> DataFrame:
    """(case key, before, after) of each case in changes (case key, add, remove); nothing is written."""
    after = F.array_sort(F.array_except(F.array_union("tags", "add"), "remove"))
    rows = cases.select(*CASE_KEY, "tags").join(gathered(changes), CASE_KEY)
    return rows.select(*CASE_KEY, F.array_sort("tags").alias("before"), after.alias("after"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case key, status) of every case in either table: ok, differs, missing or unexpected."""
    a = expected.select(*CASE_KEY, F.col("queue").alias("q1"), F.array_sort("tags").alias("t1"), F.lit(True).alias("in1"))
    b = actual.select(*CASE_KEY, F.col("queue").alias("q2"), F.array_sort("tags").alias("t2"), F.lit(True).alias("in2"))
    same = F.col("q1").eqNullSafe(F.col("q2")) & F.col("t1").eqNullSafe(F.col("t2"))
    status = F.when(F.col("in2").isNull(), "missing").when(F.col("in1").isNull(), "unexpected").when(same, "ok").otherwise("differs")
    return a.join(b, CASE_KEY, "full_outer").select(*CASE_KEY, status.alias("status"))


def results_for(numbers: DataFrame, results: DataFrame) -> DataFrame:
    """The latest result of each listed case of the own account."""
    own = results.join(numbers.select(*CASE_KEY).distinct(), CASE_KEY, "left_semi")
    return latest(own, CASE_KEY, "ts", "result_id")


def auto_tag(results: DataFrame, authorizations: DataFrame, hours: int = 48) -> DataFrame:
    """Results that came within the hours after their batch's authorisation, bounds included."""
    rows = results.join(authorizations, "batch_id")
    return rows.filter(F.col("ts").between(F.col("granted_ts"), F.col("granted_ts") + F.make_dt_interval(hours=F.lit(hours))))


def usable_uploads(files: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Files whose key is still in use and whose provider's hours have not passed; no hours, no limit."""
    rows = files.join(keys.select("provider", "key_fp", "hours").distinct(), ["provider", "key_fp"])
    return rows.filter(F.col("hours").isNull() | (F.col("uploaded_ts") + F.make_dt_interval(hours=F.col("hours")) > now)).drop("hours")


def with_reader_marks(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """pieces with read, favourite (boolean) and last_page (0 where none)."""
    own = marks.select(*PIECE_KEY, "read", "favourite", "last_page")
    return pieces.join(own, PIECE_KEY, "left").withColumns({
        "read": F.coalesce("read", F.lit(False)), "favourite": F.coalesce("favourite", F.lit(False)), "last_page": F.coalesce("last_page", F.lit(0)),
    })


def with_notes(pieces: DataFrame, notes: DataFrame) -> DataFrame:
    """pieces with the texts of their notes, oldest first."""
    told = F.transform(F.array_sort(F.collect_list(F.struct("created_ts", "note_id", "text"))), lambda x: x["text"])
    own = notes.groupBy(*PIECE_KEY).agg(told.alias("notes"))
    return pieces.join(own, PIECE_KEY, "left").withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def with_favourites(cases: DataFrame, favourites: DataFrame) -> DataFrame:
    stars = favourites.select(*CASE_KEY).distinct().withColumn("__star", F.lit(True))
    return cases.join(stars, CASE_KEY, "left").withColumn("favourite", F.col("__star").isNotNull()).drop("__star")


def egress_check(transfers: DataFrame, policy: DataFrame) -> DataFrame:
    """Transfers of a kind of data to a destination that the policy doesn't list."""
    return transfers.join(policy.select("category", "destination").distinct(), ["category", "destination"], "left_anti")
