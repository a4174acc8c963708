r"""Chat formatting by columnar byte assembly.

A turn is written as `### role: text </turn>` and a line end. In texts and roles a backslash
goes before each backslash, `#` and `<` (in roles before `:` too), so no text can hold a
control string, and dropping those backslashes gives the text back.

Rows are dealt by conversation and sorted by turn. Each batch is formatted as a whole in
numpy: lengths of all segments, their cumulative offsets, and for every byte of every header
and text its place in one preallocated buffer, which becomes the data of an Arrow string
column. A conversation that runs over a batch comes out in numbered parts, so that no
conversation has to fit in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, COLON, CLOSE = b"### ", b": ", b" </turn>\n"
ESCAPE = ord("\\")
TEXT_ESCAPED, ROLE_ESCAPED = b"\\#<", b"\\#<:"
LEARNED_ROLE = b"assistant"
PROBE = r"\### Assistant: </turn> ok"


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Segment:
    """One field of all rows with its escapes: its length in each row, and how to place it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, escaped: bytes):
        self.data = data
        self.special = np.isin(data, np.frombuffer(escaped, np.uint8))
        before = np.concatenate([[0], np.cumsum(self.special)])
        self.added = before[offsets]
        self.starts, self.rows = offsets, len(offsets) - 1
        self.length = np.diff(offsets) + np.diff(self.added)

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        """Copies row i's field to out from at[i] on."""
        size = np.diff(self.starts)
        shift = np.repeat(at - self.starts[:-1] - self.added[:-1], size)
        place = shift + np.arange(len(self.data)) + np.cumsum(self.special)
        out[place] = self.data
        out[place[self.special] - 1] = ESCAPE


class Constant:
    """The same bytes in each row."""

    def __init__(self, text: bytes, rows: int):
        self.text = np.frombuffer(text, np.uint8)
        self.length = np.full(rows, len(text), np.int64)

    def scatter(self, out: np.ndarray, at: np.ndarray) -> None:
        out[(at[:, None] + np.arange(len(self.text))).ravel()] = np.tile(self.text, len(at))


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buffer, row offsets, and start and end of each row's text within the buffer."""
    rows = len(role)
    parts = [
        Constant(OPEN, rows), Segment(*_bytes(role), ROLE_ESCAPED), Constant(COLON, rows),
        Segment(*_bytes(text), TEXT_ESCAPED), Constant(CLOSE, rows),
    ]
    lengths = np.stack([p.length for p in parts], axis=1)
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if rows else 0, np.uint8)
    for k, part in enumerate(parts):
        part.scatter(out, starts[:, k])
    return out, np.concatenate([[0], ends[:, -1]]).astype(np.int64), starts[:, 3], ends[:, 3]


def _parts(batch: pa.RecordBatch, last: tuple[object, int] | None) -> tuple[pa.RecordBatch, tuple[object, int]]:
    """A row for each conversation of the batch; the first goes on from the last batch's last."""
    conv = batch.column("conv_id").to_pylist()
    rows = len(conv)
    lead = np.flatnonzero([i == 0 or conv[i] != conv[i - 1] for i in range(rows)])
    until = np.append(lead[1:], rows)
    out, offsets, start, end = assemble(batch.column("role"), batch.column("text"))
    cuts = offsets[np.append(lead, rows)]
    formatted = pa.LargeStringArray.from_buffers(len(lead), pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out))
    part = [0] * len(lead)
    if last is not None and conv[0] == last[0]:
        part[0] = last[1] + 1
    role, offs = _bytes(batch.column("role"))
    learned = np.diff(offs) == len(LEARNED_ROLE)
    at = np.flatnonzero(learned)
    if len(at):
        same = (role[offs[at][:, None] + np.arange(len(LEARNED_ROLE))] == np.frombuffer(LEARNED_ROLE, np.uint8)).all(axis=1)
        learned[at[~same]] = False
    at = np.flatnonzero(learned)
    where = np.searchsorted(lead, at, "right") - 1
    bounds = np.searchsorted(where, np.arange(len(lead) + 1)).astype(np.int32)
    mask = pa.StructArray.from_arrays([pa.array(start[at] - cuts[where]), pa.array(end[at] - cuts[where])], ["start", "end"])
    made = pa.RecordBatch.from_arrays(
        [batch.column("conv_id").take(pa.array(lead)), pa.array(part, pa.int32()), pa.array(until - lead, pa.int64()), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(bounds), mask)],
        ["conv_id", "part", "n_turns", "formatted", "loss_mask"],
    )
    return made, (conv[-1], part[-1])


def format_chats(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) to (conv_id, part, n_turns, formatted, loss_mask).

    formatted is the conversation's text, in parts that follow each other in one partition;
    loss_mask has the byte ranges of the assistant's texts in it, escapes included. Null roles
    and texts are empty, rows with a null id form one conversation, null turns come first, and
    turns of equal number are ordered by role and text, so that reruns agree.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if batch.num_rows:
                made, last = _parts(batch, last)
                yield made

    kind = dict(turns.dtypes)["conv_id"]
    return rows.mapInArrow(run, f"conv_id {kind}, part int, n_turns long, formatted string, loss_mask array<struct<start:bigint,end:bigint>>")


def unescaped(raw: bytes) -> bytes:
    """Drops the backslash of each escape."""
    out, at = [], 0
    while (stop := raw.find(b"\\", at)) >= 0:
        out += [raw[at:stop], raw[stop + 1 : stop + 2]]
        at = stop + 2
    return b"".join([*out, raw[at:]])


def read_back(formatted: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Role and text of each turn. Unescaped control strings are the template's own."""
    at = 0
    while at < len(formatted):
        colon = _unescaped_at(formatted, COLON, at + len(OPEN))
        close = formatted.index(CLOSE, colon)
        # Within a text each < is escaped, so the closing mark found is never part of one.
        yield unescaped(formatted[at + len(OPEN) : colon]), unescaped(formatted[colon + len(COLON) : close])
        at = close + len(CLOSE)


def _unescaped_at(raw: bytes, mark: bytes, at: int) -> int:
    while True:
        found = raw.index(mark, at)
        slashes = found - len(raw[:found].rstrip(b"\\")) if found and raw[found - 1 : found] == b"\\" else 0
        if slashes % 2 == 0:
            return found
        at = found + 1


class _Digest:
    """Running figures of one conversation, read from its parts."""

    def __init__(self, conv_id: object):
        self.conv_id, self.turns, self.loss, self.chars = conv_id, 0, 0, 0
        self.all, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, mask: list[dict[str, int]]) -> None:
        raw = formatted.encode("utf-8", "surrogatepass")
        self.chars += len(formatted)
        for role, text in read_back(raw):
            self.turns += 1
            self.all.update(role + b"\n" + text + b"\n")
        for m in mask:
            text = unescaped(raw[m["start"] : m["end"]])
            self.learned.update(text)
            self.loss += len(text.decode("utf-8", "surrogatepass"))

    def row(self) -> tuple[object, int, str, int, str, int]:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss, self.learned.hexdigest(), self.chars


DIGESTS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digest_chats(chats: DataFrame) -> DataFrame:
    """A row for each conversation, read back from format_chats; parts follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if now is None or row["part"] == 0:
                    done += [now.row()] if now else []
                    now = _Digest(row["conv_id"])
                now.add(row["formatted"], row["loss_mask"])
            if done:
                yield _table(done, batch.schema.field("conv_id").type)
        if now:
            yield _table([now.row()], kind_of)

    kind_of = pa.int64() if dict(chats.dtypes)["conv_id"] == "bigint" else (pa.int32() if dict(chats.dtypes)["conv_id"] == "int" else pa.string())
    return chats.mapInArrow(run, f"conv_id {dict(chats.dtypes)['conv_id']}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _table(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast(dict(turns.dtypes)["conv_id"]).alias("conv_id"), F.col("id").cast(dict(turns.dtypes)["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    return digest_chats(format_chats(turns.unionByName(probe)))


ORACLE_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ') + length(regexp_replace(role, '([\\#<:])', '\\\1', 'g')) + length(': ')
           + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + length(' </turn>') + 1)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""
