"""De-identification: detection, labels, masking, and the barrier in front of what goes out.

Work stays by piece; labels and parties are brought to the texts of their case as one dictionary. The barrier and
the releases compare by case with an equi-join and test containment on what has met. Values that hold everywhere
have no case: texts and values meet by a rare piece of the value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, _parse_datatype_string

from docketry.functions.forms import Labels, Register
from docketry.functions.ids import digits, name_norm
from docketry.functions.patterns import IDENTIFIERS, MENTIONS, PRESERVED, RG, matches
from docketry.operators.containing import containing
from docketry.operators.dictionary import audited, looked_up
from docketry.operators.windows import number_labels
from docketry.schemas import CASE_KEY, ENTITY, PIECE_KEY, TURN_KEY

PIECE, TURN = PIECE_KEY, TURN_KEY
SPAN = "kind: string, value: string, start: bigint, `end`: bigint"


def detect_patterns(texts: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Entities (case key, piece_id, kind, value, start, end) of the identifiers' public formats."""
    return matches(texts, PIECE, "text", patterns or IDENTIFIERS)


def detect_rg(texts: DataFrame) -> DataFrame:
    """RG numbers beside a label; the span is the number's. Bare numbers of 7 to 9 digits are left."""
    found = matches(texts, PIECE, "text", {"rg": RG}, group=1)
    return found.withColumn("start", F.col("end") - F.char_length("value"))


def detect_register(texts: DataFrame, parties: DataFrame) -> DataFrame:
    """Names and numbers of the case's known parties, whatever their form: all their places in a piece.

    value is what stands in the text. Names may differ in case, accents (composed or not), ligatures, blanks and
    a cut at the end of a line, numbers in their punctuation; none is part of a longer word or number. A text is
    brought to its normal form once, with the place of every letter, and met with a dictionary of the case.
    """
    entries = parties.select(*CASE_KEY, F.explode(F.array(
        F.struct(F.lit("person").alias("a"), F.col("name").alias("b")), F.struct(F.lit("number").alias("a"), digits(F.col("cpf")).alias("b")),
    )).alias("v")).select(*CASE_KEY, "v.*").filter("b <> ''").distinct()
    rows = looked_up(texts.select(*PIECE, "text"), "text", entries, lambda own: Register(own).found, "found", _parse_datatype_string(f"array<struct<{SPAN}>>"))
    return rows.select(*PIECE, F.inline("found"))


def detect_model(texts: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """Entities that a user's own model finds: fn maps batches of (case key, piece_id, text) to entities."""
    return texts.select(*PIECE, "text").mapInPandas(fn, ENTITY)


def mentions(texts: DataFrame, parties: DataFrame | None = None) -> DataFrame:
    """Values, dates, laws, deadlines and, where given, the case's parties in a piece, as rows."""
    found = matches(texts, PIECE, "text", MENTIONS)
    return found if parties is None else found.unionByName(detect_register(texts, parties))


def drop_preserved(entities: DataFrame, texts: DataFrame) -> DataFrame:
    """Entities that don't overlap a date, a deadline, a law or case law of their piece.

    Of all preserved spans of a piece that begin before an entity ends, the one that ends last tells: so a
    piece is sorted once, whatever the number of its spans.
    """
    kept = matches(texts, PIECE, "text", {k: MENTIONS[k] for k in PRESERVED}).dropna(subset=PIECE)
    kept = kept.select(*PIECE, F.lit(None).alias("__row"), F.col("start").alias("__at"), F.col("end").alias("__until"))
    rows = entities.select(*PIECE, F.struct(*[F.col(f"`{c}`") for c in entities.columns]).alias("__row"), F.col("end").alias("__at"), F.lit(None).cast("long").alias("__until"))
    # at one place entities end before spans begin
    before = Window.partitionBy(*PIECE).orderBy("__at", F.col("__until").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.unionByName(kept.withColumn("__row", F.lit(None).cast(rows.schema["__row"].dataType)))
    both = both.withColumn("__last", F.max("__until").over(before)).filter("__row IS NOT NULL")
    return both.filter("__last IS NULL OR __last <= __row.start").select("__row.*")


def resolve_spans(entities: DataFrame) -> DataFrame:
    """One winner among overlapping spans of a piece: the longest, then the earliest, then by kind and value.

    Spans are first cut into runs that overlap, so that a span is compared with its own run's winners only.
    """
    rows = entities.select(*PIECE, "kind", "value", "start", "end").distinct()
    by = Window.partitionBy(*PIECE).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(before > F.col("start"), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct((F.col("start") - F.col("end")).alias("size"), "start", "kind", "value", "end")
    none = F.slice(F.col("spans"), 1, 0)

    def take(won, x):
        return F.when(F.exists(won, lambda w: (w["start"] < x["end"]) & (x["start"] < w["end"])), won).otherwise(F.array_append(won, x))

    runs = rows.groupBy(*PIECE, "run").agg(F.array_sort(F.collect_list(order)).alias("spans"))
    won = runs.select(*PIECE, F.explode(F.aggregate("spans", none, take)).alias("w"))
    return won.select(*PIECE, "w.kind", "w.value", "w.start", "w.end")


def label_entries(label_map: DataFrame) -> DataFrame:
    return label_map.select(*CASE_KEY, F.col("label").alias("a"), F.col("value").alias("b")).filter("a <> '' AND b <> ''").distinct()


def mask(texts: DataFrame, label_map: DataFrame, bounds: bool = True) -> DataFrame:
    """texts with masked: each value of the case replaced by its label, the longest value at each place.

    With bounds a value inside of a longer word or number stays. Labels are never masked themselves. Labels are
    made one to one: a value with several takes the smallest, and of several values under one label all but the
    first get a new one, [P_1~2]. A label in brackets that a text holds by itself gets a backslash behind its bracket.
    Cases without labels and null texts keep their text.
    """
    return looked_up(texts, "text", label_entries(label_map), lambda own: Labels(own, bounds).mask, "masked", StringType())


def mask_fields(fields: DataFrame, label_map: DataFrame, names: list[str], bounds: bool = True) -> DataFrame:
    """(case key, id, field, masked) of several text columns of (case key, id, ...): title, sheet, thesis, ..."""
    rows = fields.unpivot([*CASE_KEY, "id"], names, "field", "text")
    return mask(rows, label_map, bounds).select(*CASE_KEY, "id", "field", "masked")


def unmask(texts: DataFrame, label_map: DataFrame) -> DataFrame:
    """texts with unmasked: all labels of the case turned back, whichever of a value's they are.

    unmask(mask(texts)) gives the texts, for labels in brackets without brackets inside; brackets keep [X_1] and [X_10] apart.
    """
    return looked_up(texts, "masked", label_entries(label_map), lambda own: Labels(own).unmask, "unmasked", StringType())


def barrier_hits(outgoing: DataFrame, label_map: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """(case key, turn, value, at): protected values of the case in an outgoing text, with their place (from 1)."""
    values = label_map.select(*CASE_KEY, "value").filter("value <> ''").distinct()
    if releases is not None:
        values = apply_releases(values, releases)
    rows = outgoing.select(*CASE_KEY, "turn", "text").join(values, CASE_KEY).filter(F.contains("text", F.col("value")))
    return rows.select(*CASE_KEY, "turn", "value", F.position(F.col("value"), F.col("text")).cast("long").alias("at"))


def global_hits(outgoing: DataFrame, values: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key..., value, at): values that are protected in every case, in an outgoing text of (key..., text).

    key tells the turns apart, (case key, turn) by default. Short values and long ones are met alike, in one
    pass over the texts, whatever their number: see containing().
    """
    return containing(outgoing, key or TURN, values.select("value"))


def barrier(outgoing: DataFrame, hits: DataFrame, key: list[str] | None = None) -> DataFrame:
    """outgoing texts of the turns without any hit: one hit refuses the whole turn of its case."""
    return outgoing.join(hits.select(*(key or TURN)).distinct(), key or TURN, "left_anti")


def apply_releases(entities: DataFrame, releases: DataFrame) -> DataFrame:
    """entities without the values released for their case, or for all cases (case_no null), by normal form."""
    rows = entities.withColumn("value_norm", name_norm(F.col("value")))
    own = releases.filter("case_no IS NOT NULL").select(*CASE_KEY, "value_norm").distinct()
    everywhere = releases.filter("case_no IS NULL").select("value_norm").distinct()
    return rows.join(own, [*CASE_KEY, "value_norm"], "left_anti").join(everywhere, "value_norm", "left_anti").select(*entities.columns)


def apply_overrides(entities: DataFrame, overrides: DataFrame) -> DataFrame:
    """entities with a user's own changes: overrides (case key, piece_id, action, kind, value, start, end).

    mask adds a span, release takes away the spans of a value in the piece, drop takes the whole
    piece out of the conversation.
    """
    added = overrides.filter("action = 'mask'").select(*PIECE, "kind", "value", "start", "end")
    free = overrides.filter("action = 'release'").select(*PIECE, "value").distinct()
    out = overrides.filter("action = 'drop'").select(*PIECE).distinct()
    kept = entities.select(*PIECE, "kind", "value", "start", "end").join(free, [*PIECE, "value"], "left_anti")
    return kept.select(*PIECE, "kind", "value", "start", "end").unionByName(added).distinct().join(out, PIECE, "left_anti")


def edited_texts(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts with the user's edited text where there is one."""
    return texts.join(edits.select(*PIECE, "edited"), PIECE, "left").withColumn("text", F.coalesce("edited", "text")).drop("edited")


def mask_audit(counts: DataFrame, masked: DataFrame, label_map: DataFrame) -> DataFrame:
    """The local view: counts by kind, the exact text of each piece, and the case's label table.

    Counts and labels come together first, a row a piece, so each text is shuffled once whatever its kinds. Where
    the texts lie beside their entities, audit() gives the same without a shuffle.
    """
    labels = label_map.groupBy(*CASE_KEY).agg(F.array_sort(F.collect_set(F.struct("label", "value"))).alias("labels"))
    others = [c for c in counts.columns if c not in PIECE]
    told = counts.groupBy(*PIECE).agg(F.collect_list(F.struct(*others)).alias("__counts")).join(labels, CASE_KEY, "left")
    rows = told.join(masked.select(*PIECE, "masked"), PIECE)
    return rows.select(*PIECE, F.inline("__counts"), "masked", "labels")


def audit(texts: DataFrame, entities: DataFrame, bounds: bool = True) -> DataFrame:
    """(case key, piece_id, kind, n, masked, labels): the local view of texts by their own entities, in one pass.

    What mask_audit() tells of the counts, the numbered labels and the texts masked with them. All of it is made
    inside of a case: texts and entities that come dealt by the case key are not shuffled again, others once.
    """
    labelled = number_labels(entities, pieces=F.collect_list("piece_id"))
    own, at = F.struct(F.lit(None).cast("long").alias("piece_id"), F.lit(0).alias("__level"), F.col("label").alias("__a"), F.col("value").alias("__b")), F.lit(None).cast("string")
    found = F.transform("pieces", lambda p: F.struct(p.cast("long").alias("piece_id"), F.lit(1).alias("__level"), F.col("kind").alias("__a"), at.alias("__b")))
    entries = labelled.select(*CASE_KEY, F.inline(F.concat(F.array(own), found)))
    rows = audited(texts.select(*PIECE, "text"), entries, lambda labels: Labels(labels, bounds).mask)
    rows = rows.withColumn("labels", F.array_sort(F.array_distinct("labels")))
    return rows.select(*PIECE, F.inline("counts"), "masked", "labels")


def approval_gate(pieces: DataFrame, sent: DataFrame, approvals: DataFrame, require: bool = True) -> DataFrame:
    """(case key, turn, passes): a turn passes if each of its pieces was sent before or is approved, or nothing is required.

    pieces: (case key, turn, piece_id); what another case or account has sent or approved counts for nothing.
    """
    known = sent.select(*PIECE).unionByName(approvals.select(*PIECE)).distinct()
    waiting = pieces.join(known, PIECE, "left_anti").select(*TURN).distinct().withColumn("__waits", F.lit(True))
    rows = pieces.select(*TURN).distinct().join(waiting, TURN, "left")
    return rows.select(*TURN, (F.lit(not require) | F.col("__waits").isNull()).alias("passes"))


def purge_reasoning(turns: DataFrame, values: DataFrame, role: str = "assistant") -> DataFrame:
    """turns without the reasoning rows that carry one of their case's values."""
    own = values.select(*CASE_KEY, F.col("value").alias("__value")).filter("__value <> ''").distinct()
    bad = turns.filter(F.col("role") == role).join(own, CASE_KEY).filter(F.contains("text", F.col("__value"))).select(*CASE_KEY, "turn").distinct()
    return turns.join(bad, [*CASE_KEY, "turn"], "left_anti").select(*turns.columns)
