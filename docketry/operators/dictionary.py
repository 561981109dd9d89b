"""Texts beside the entries of their case: one dictionary a case, whatever the number of its texts and entries.

A case's entries come ahead of its texts in a sorted stream, so a task holds one case's dictionary and a batch of
texts. A case with many texts is dealt to several tasks, each of which gets its entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType, _parse_datatype_string

from docketry.operators.batches import BATCH_BYTES, small_batches
from docketry.schemas import CASE_KEY, PIECE_KEY

#: Texts of a case that one task works on, about.
TEXTS_A_TASK = 20_000
#: Bytes of a label in an audited row besides its text, about.
LABEL_BYTES = 50


def looked_up(
    texts: DataFrame, column: str, entries: DataFrame, build: Callable[[list[tuple[str, str]]], Callable[[str | None], Any]], name: str, kind: DataType
) -> DataFrame:
    """texts with a column name: what build(entries of the case) makes of a text column.

    entries: (case key, a, b), two texts each. Texts of cases without entries, or with a null in the key, get
    what build([]) makes of them. Every row stays, repeated ones too.
    """
    small_batches(texts.sparkSession)
    many = texts.groupBy(*CASE_KEY).agg(F.count("*").alias("__n")).filter(F.col("__n") > TEXTS_A_TASK)
    many = many.select(*CASE_KEY, F.ceil(F.col("__n") / TEXTS_A_TASK).cast("int").alias("__tasks"))
    many = F.broadcast(many)  # one row for each TEXTS_A_TASK texts at most, so the texts need no shuffle to meet it
    fields = [F.col(f"`{c}`") for c in texts.columns]
    hashed = [F.col(f"`{f.name}`") for f in texts.schema if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    share = F.when(F.col("__tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64(*hashed), F.col("__tasks")).cast("int"))
    rows = texts.join(many, CASE_KEY, "left").select(*fields, F.lit(None).cast("string").alias("__a"), F.lit(None).cast("string").alias("__b"), F.lit(1).alias("__text"), share.alias("__share"))
    own = entries.dropna(subset=CASE_KEY).join(many, CASE_KEY, "left")
    own = own.select(*CASE_KEY, F.col("a").alias("__a"), F.col("b").alias("__b"), F.lit(0).alias("__text"), F.explode(F.sequence(F.lit(0), F.coalesce("__tasks", F.lit(1)) - 1)).alias("__share"))
    both = rows.unionByName(own, allowMissingColumns=True)
    both = both.repartition(*CASE_KEY, "__share").sortWithinPartitions(*CASE_KEY, "__share", "__text")
    columns, arrow = texts.columns, to_arrow_type(kind)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, held, work = None, [], None
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in CASE_KEY], strict=True)
            out = []
            for key, is_text, a, b, text in zip(keys, *[batch.column(c).to_pylist() for c in ("__text", "__a", "__b", column)], strict=True):
                if key != case:
                    case, held, work = key, [], None
                if not is_text:
                    held.append((a, b))
                    continue
                work = work or build(held)
                out.append(work(text))
            if out:
                rows = batch.filter(batch.column("__text").cast(pa.bool_()))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in columns], pa.array(out, arrow)], names=[*columns, name])

    return both.mapInArrow(made, StructType([*texts.schema.fields, StructField(name, kind)]))


def audited(texts: DataFrame, entries: DataFrame, build: Callable[[list[tuple[str, str]]], Callable[[str | None], str | None]]) -> DataFrame:
    """(case key, piece_id, masked, counts, labels): texts with entities, masked, beside what was found in their piece and their case's labels.

    texts: (case key, piece_id, text); entries: (case key, piece_id, __level, __a, __b), a row a label of a case
    (level 0: label, value) and a row an entity (level 1: its piece and kind). Labels come ahead of all pieces, a piece's
    entities ahead of its texts, so a task holds one case's labels and one piece's counts. Nulls in a key meet nothing.
    """
    small_batches(texts.sparkSession)
    none = F.lit(None).cast("string")
    rows = texts.select(*PIECE_KEY, F.lit(2).alias("__level"), none.alias("__a"), none.alias("__b"), "text")
    both = rows.unionByName(entries.withColumn("text", none)).dropna(subset=CASE_KEY)
    # a window, not a repartition: it takes the rows as they are dealt, if that is by case; its number is a column so that it stays
    order = Window.partitionBy(*CASE_KEY).orderBy(F.col("__level") > 0, "piece_id", "__level")
    both = both.withColumn("__n", F.row_number().over(order))
    kinds, labels = "array<struct<kind: string, n: bigint>>", "array<struct<label: string, value: string>>"
    schema = StructType([*[texts.schema[c] for c in PIECE_KEY], *_parse_datatype_string(f"masked string, counts {kinds}, labels {labels}").fields])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case = piece = work = None
        held, counts, size = [], {}, 0
        for batch in batches:
            keys, own, masked, found, known, out = batch.select(PIECE_KEY), [], [], [], [], 0
            for k, (*key, at, level, a, b, text) in enumerate(zip(*[batch.column(c).to_pylist() for c in (*PIECE_KEY, "__level", "__a", "__b", "text")], strict=True)):
                if key != case:
                    case, piece, held, counts, work, size = key, None, [], {}, None, 0
                if level == 0:
                    held.append((a, b))
                    size += LABEL_BYTES + len(a or "") + len(b or "")
                    continue
                if at != piece:
                    piece, counts = at, {}
                if level == 1:
                    counts[a] = counts.get(a, 0) + 1
                elif counts:
                    work = work or build(held)
                    own.append(k)
                    masked.append(work(text))
                    found.append(list(counts.items()))
                    known.append(held)
                    out += size
                    if out >= BATCH_BYTES:
                        yield told(keys, own, masked, found, known)
                        own, masked, found, known, out = [], [], [], [], 0
            if own:
                yield told(keys, own, masked, found, known)

    def told(keys: pa.RecordBatch, own: list[int], masked: list[str | None], found: list[list], known: list[list]) -> pa.RecordBatch:
        columns = [pa.array(masked, pa.string()), pairs(found, ("kind", pa.string()), ("n", pa.int64())), pairs(known, ("label", pa.string()), ("value", pa.string()))]
        return pa.RecordBatch.from_arrays([*keys.take(pa.array(own)).columns, *columns], names=[*PIECE_KEY, "masked", "counts", "labels"])

    def pairs(lists: list[list], *fields: tuple[str, pa.DataType]) -> pa.ListArray:
        offsets = pa.array([0, *accumulate(map(len, lists))], pa.int32())
        columns = [pa.array([x[i] for each in lists for x in each], kind) for i, (_, kind) in enumerate(fields)]
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, [name for name, _ in fields]))

    return both.mapInArrow(made, schema)
