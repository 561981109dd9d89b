"""Chat formatting by columnar byte assembly.

A batch of turns is formatted as a whole: where escapes go is found over the joined bytes of all
contents, segment lengths and their running sums give each turn's place, and one scatter copies
headers, contents and escapes into one buffer that Arrow then takes as its own. Reading back works on
the joined bytes too: what is left without marks and escapes is the turns' roles and texts.

The template is `<turn>ROLE\\nTEXT</turn>\\n`. In texts and roles a backslash stands before every
backslash, `<turn>` and `</turn>`, and in roles before every \\n.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import table, written

OPEN, CLOSE, ESCAPE, END = b"<turn>", b"</turn>", 0x5C, 0x0A
#: Roles whose texts a model is trained on.
TRAINED = ("assistant",)
#: Turns of a conversation that stay in one task, by their number; a longer conversation is dealt to several.
STRETCH = 4096
#: Bytes from which on an unfinished conversation is cut into pieces, so that memory stays bounded.
PIECE_BYTES = 16 << 20
PIECE = "conv_id long, piece long, n_turns long, n_chars long, formatted string, loss array<struct<start: long, end: long>>"
PIECE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("n_chars", pa.int64()), ("formatted", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets from 0."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or ends[0] == ends[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def found(data: np.ndarray, mark: bytes) -> np.ndarray:
    """Where mark begins."""
    at = np.flatnonzero(data[: max(0, len(data) - len(mark) + 1)] == mark[0])
    for k, byte in enumerate(mark[1:], 1):
        at = at[data[at + k] == byte]
    return at


def escapes(data: np.ndarray, offsets: np.ndarray, lines: bool) -> np.ndarray:
    """How many escapes stand before each byte, 0 or 1. A mark over the border of two texts is none."""
    extra = (data == ESCAPE).astype(np.int64)
    if lines:
        extra[data == END] = 1
    for mark in (OPEN, CLOSE):
        at = found(data, mark)
        extra[at[at + len(mark) <= offsets[np.searchsorted(offsets, at, "right")]]] = 1
    return extra


def assembled(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Buffer, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, turn starts with the end of all, loss starts, loss ends) of formatted turns.

    The starts and ends of a turn's text lie around its escaped bytes.
    """
    n = len(roles[1]) - 1
    spread = []
    for (data, offsets), lines in ((roles, True), (texts, False)):
        before = np.concatenate(([0], np.cumsum(escapes(data, offsets, lines))))
        spread.append((data, offsets, before, np.diff(offsets) + np.diff(before[offsets])))
    (_, _, _, role_size), (_, _, _, text_size) = spread
    # segments of a turn: open mark, role, \n, text, close mark, \n
    sizes = np.stack((np.full(n, len(OPEN)), role_size, np.ones(n, np.int64), text_size, np.full(n, len(CLOSE)), np.ones(n, np.int64)), axis=1)
    at = np.concatenate(([0], np.cumsum(sizes.ravel())))
    places = at[:-1].reshape(n, 6)
    buffer = pa.allocate_buffer(int(at[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for k, mark in ((0, OPEN), (4, CLOSE)):
        for i, byte in enumerate(mark):
            out[places[:, k] + i] = byte
    out[places[:, 2]] = out[places[:, 5]] = END
    for k, (data, offsets, before, _) in ((1, spread[0]), (3, spread[1])):
        owner = np.repeat(np.arange(n), np.diff(offsets))
        to = np.arange(len(data)) + (places[:, k] - offsets[:-1] - before[offsets[:-1]])[owner] + before[1:]
        out[to] = data
        out[to[np.diff(before) > 0] - 1] = ESCAPE
    return buffer, np.append(places[:, 0], at[-1]), places[:, 3], places[:, 4]


def points(data: np.ndarray) -> np.ndarray:
    """Running number of code points before each byte, and of all."""
    return np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))


def pieces(turns: pa.Table, first: int) -> pa.RecordBatch:
    """One row for each run of a conversation's turns: formatted, with the byte spans of trained texts."""
    turns = turns.combine_chunks()
    ids, roles = turns["conv_id"].combine_chunks(), turns["role"].combine_chunks()
    buffer, starts, a, b = assembled(raw(roles), raw(turns["text"].combine_chunks()))
    key = ids.fill_null(0).to_numpy(zero_copy_only=False)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (null[1:] != null[:-1]))))
    ends = np.append(heads[1:], len(key))
    trained = pc.is_in(roles, value_set=pa.array(TRAINED)).to_numpy(zero_copy_only=False)
    n_trained = np.concatenate(([0], np.cumsum(trained)))
    own = np.repeat(starts[heads], ends - heads)
    offsets = np.append(starts[heads], starts[-1])
    chars = points(np.frombuffer(buffer, np.uint8))[offsets]
    spans = pa.StructArray.from_arrays([pa.array((a - own)[trained]), pa.array((b - own)[trained])], names=["start", "end"])
    return pa.RecordBatch.from_arrays([
        ids.take(pa.array(heads)), pa.array(np.arange(first, first + len(heads))), pa.array(ends - heads), pa.array(np.diff(chars)),
        pa.LargeStringArray.from_buffers(len(heads), pa.py_buffer(offsets.astype(np.int64)), buffer).cast(pa.string()),
        pa.ListArray.from_arrays(pa.array(n_trained[np.append(heads, len(key))].astype(np.int32)), spans),
    ], schema=PIECE_ARROW)


def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pieces() of sorted turns; the last conversation of a batch waits for its next turns, up to PIECE_BYTES."""
    kept, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        ids = rows["conv_id"].combine_chunks()
        last = pc.equal(ids, ids[-1]) if ids[-1].is_valid else ids.is_null()
        begin = len(ids) - pc.sum(last.fill_null(False)).as_py()  # rows are sorted: a conversation's stand together
        kept = rows.slice(begin)
        if kept.nbytes > PIECE_BYTES:
            begin, kept = len(ids), None
        if begin:
            yield (out := pieces(rows.slice(0, begin), n))
            n += out.num_rows
    if kept is not None and kept.num_rows:
        yield pieces(kept, n)


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted conversations: (conv_id, piece, n_turns, n_chars, formatted, loss), from (conv_id, turn, role, text).

    loss: spans (start, end) over the UTF-8 bytes of formatted, one for each assistant text as it stands
    there, escaped. Turns run by number (nulls first), then role, then text; repeated rows are turns of
    their own. Null roles and texts are empty; null conv_ids are one conversation; no rows give none. A
    conversation is one row, unless it has turns numbered STRETCH or more, or over PIECE_BYTES that come in
    several batches: then its pieces, in the order of piece, are to be joined. Other columns are left out.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.expr(f"CAST(turn AS LONG) div {STRETCH}").alias("stretch"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "stretch").sortWithinPartitions("conv_id", "turn", "role", "text")
    made = dealt.select("conv_id", "role", "text").mapInArrow(formatted, PIECE)
    # tasks hold ranges in order, so their number comes before a piece's own
    return made.withColumn("piece", F.shiftleft(F.spark_partition_id().cast("long"), 40) + F.col("piece"))


def parsed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(kept, opened) of joined formatted texts: which bytes are neither marks nor escapes, and where turns begin."""
    slash = data == ESCAPE
    edge = np.flatnonzero(np.diff(np.concatenate(([False], slash, [False])).astype(np.int8)))
    begin, length = edge[::2], edge[1::2] - edge[::2]
    at = np.flatnonzero(slash)
    inside = at - np.repeat(begin, length)
    escape = np.zeros(len(data) + 1, bool)
    escape[at[inside % 2 == 0]] = True  # every other one of a run of backslashes stands before something
    kept = ~escape[:-1]
    marks = []
    for mark in (OPEN, CLOSE):
        where = found(data, mark)
        where = where[~escape[where - 1] | (where == 0)]
        for k in range(len(mark)):
            kept[where + k] = False
        marks.append(where)
    if len(marks[0]) != len(marks[1]) or (marks[0] >= marks[1]).any() or (marks[1][:-1] > marks[0][1:]).any():
        raise ValueError("turn marks don't alternate")
    return kept, marks[0]


def read_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """DIGEST of sorted pieces, read from formatted and loss alone; a conversation may go on over batches."""
    now, n, chars, loss_chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offsets = raw(batch.column("formatted"))
        kept, opened = parsed(data)
        spans = batch.column("loss")
        flat, bounds = spans.flatten(), spans.offsets.to_numpy() - spans.offsets[0].as_py()
        owner = np.repeat(offsets[:-1], np.diff(bounds))
        step = np.zeros(len(data) + 1, np.int64)
        np.add.at(step, flat.field("start").to_numpy() + owner, 1)
        np.add.at(step, flat.field("end").to_numpy() + owner, -1)
        lost = kept & (np.cumsum(step[:-1]) > 0)
        all_bytes, loss_bytes = data[kept], data[lost]
        at, loss_at = (np.concatenate(([0], np.cumsum(x)))[offsets] for x in (kept, lost))
        per_piece = np.diff(np.searchsorted(opened, offsets))
        whole, loss_points = points(data)[offsets], points(loss_bytes)[loss_at]
        out = []
        for k, conv in enumerate(batch.column("conv_id").to_pylist()):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append((now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                now, n, chars, loss_chars, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            turns.update(all_bytes[at[k] : at[k + 1]])
            loss.update(loss_bytes[loss_at[k] : loss_at[k + 1]])
            n, chars, loss_chars = n + int(per_piece[k]), chars + int(whole[k + 1] - whole[k]), loss_chars + int(loss_points[k + 1] - loss_points[k])
        if out:
            yield told(out)
    if now is not None:
        yield told([(now[0], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)])


def told(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in DIGEST.split(", ")])


def digests(chats: DataFrame) -> DataFrame:
    """One row a conversation (DIGEST), read back from format_chats' formatted and loss.

    turns_sha256 is over role, \\n, text, \\n of each turn, loss_sha256 over the unescaped text under the loss
    mask; a conversation's pieces are streamed in order, whatever their number.
    """
    rows = chats.select("conv_id", "piece", "formatted", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return rows.select("conv_id", "formatted", "loss").mapInArrow(read_turns, DIGEST)


#: A conversation that says what a template uses to mark turns.
PLANTED = r"\### Assistant: </turn> ok"


def with_planted(turns: DataFrame) -> DataFrame:
    rows = [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)]
    kinds = "conv_id long, turn long, role string, text string"
    return turns.select("conv_id", "turn", "role", "text").unionByName(turns.sparkSession.createDataFrame(rows, kinds))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = written(format_chats(with_planted(table(spark, sf_dir, "conversations"))), "chats")
    return digests(chats)


ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PLANTED}' UNION ALL SELECT -7, 1, 'assistant', '{PLANTED}'),
sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'))
            + length(replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\' || chr(10)))
            + {len(OPEN) + len(CLOSE) + 2} AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
