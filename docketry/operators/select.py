"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.functions.ids import name_norm
from docketry.schemas import CASE_KEY, DENIED, PIECE_KEY, PRESETS


def project_allowed(df: DataFrame, preset: str) -> DataFrame:
    """Only the fields that a destination may get; ValueError if a preset names a denied column."""
    wanted = PRESETS[preset]
    if bad := DENIED & {c.lower() for c in wanted}:
        raise ValueError(f"{preset} names denied columns: {sorted(bad)}")
    return df.select(*[c for c in wanted if c in df.columns])


def filter_cases(cases: DataFrame, queue: str | None = None, tag: str | None = None) -> DataFrame:
    """Cases of a queue, with a tag, or both."""
    if queue is not None:
        cases = cases.filter(F.col("queue") == queue)
    return cases if tag is None else cases.filter(F.array_contains("tags", tag))


def route_sealed(cases: DataFrame, mode: str) -> DataFrame:
    """cases with route: the account's mode (read, block or anonymise) for sealed ones, else read."""
    if mode not in ("read", "block", "anonymise"):
        raise ValueError(f"unknown mode: {mode}")
    return cases.withColumn("route", F.when(F.col("sealed"), mode).otherwise("read"))


def warn_sealed(items: DataFrame) -> DataFrame:
    """items with warn: sealed and going out unmasked. A warning, not a filter."""
    return items.withColumn("warn", F.coalesce(F.col("sealed") & ~F.col("masked"), F.lit(False)))


def hearings_between(hearings: DataFrame, first, last) -> DataFrame:
    """The schedule of a period, both days included, in the fields that are allowed."""
    return project_allowed(hearings.filter(F.col("hearing_date").between(F.lit(first), F.lit(last))), "hearing")


def pages_needing_image(folios: DataFrame, requests: DataFrame, min_conf: float, model_reads_images: bool = True) -> DataFrame:
    """Folios (case key, piece_id, folio, ...) to send as images: read with low confidence or asked for, if the model reads images."""
    asked = requests.select(*PIECE_KEY, "folio").distinct().withColumn("asked", F.lit(True))
    low = ~F.col("has_text_layer") & (F.col("ocr_conf") < min_conf)
    rows = folios.join(asked, [*PIECE_KEY, "folio"], "left").filter(low | F.col("asked"))
    return rows.filter(F.lit(model_reads_images)).drop("asked")


def pages_needing_ocr(folios: DataFrame) -> DataFrame:
    return folios.filter(~F.col("has_text_layer"))


def draft_allowed(requests: DataFrame, guarded: tuple[str, ...] = ("ruling", "decision")) -> DataFrame:
    """requests with allowed: rulings and decisions need a thesis and a disposition that aren't blank."""
    given = (F.trim(F.coalesce("thesis", F.lit(""))) != "") & (F.trim(F.coalesce("disposition", F.lit(""))) != "")
    return requests.withColumn("allowed", F.coalesce(~F.col("kind").isin(*guarded), F.lit(True)) | given)


def movements_of(movements: DataFrame, types: list[str]) -> DataFrame:
    return movements.filter(F.col("mov_type").isin(*types))


def unread_cases(cases: DataFrame, icon: str, since: Column) -> DataFrame:
    """Cases with an icon such as 'unread document', or distributed on or after a day."""
    return cases.filter(F.array_contains("icons", icon) | (F.col("distributed") >= since))


def drop_attachments(rows: DataFrame) -> DataFrame:
    """Rows but the user's attachments, which are never kept; a null origin is kept."""
    return rows.filter(F.coalesce(F.col("origin") != "attachment", F.lit(True)))


def memory_projection(pieces: DataFrame) -> DataFrame:
    """Text and data of pieces that may be remembered: no attachment and no binary column."""
    return drop_attachments(pieces).select(*[f.name for f in pieces.schema if f.dataType.typeName() != "binary"])


def natural_persons(found: DataFrame) -> DataFrame:
    return found.filter(F.col("kind") == "natural")


def search_party(cases: DataFrame, parties: DataFrame, name: str) -> DataFrame:
    """Keys of the cases with a party whose normal name contains the normal form of name."""
    wanted = name_norm(F.lit(name))
    hits = parties.filter(F.contains(name_norm(F.col("name")), wanted)).select(*CASE_KEY)
    return cases.select(*CASE_KEY).join(hits, CASE_KEY, "left_semi")


def main_pieces(pieces: DataFrame, types: list[str]) -> DataFrame:
    """pieces with main: whether their type stands out in the list."""
    return pieces.withColumn("main", F.coalesce(F.col("doc_type").isin(*types), F.lit(False)))
