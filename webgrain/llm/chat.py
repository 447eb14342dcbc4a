"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn as

    <turn> ### role </role> text </turn>

and a newline. Where a deterministic parser does not give a turn back as it was, control strings inside its text, and then
inside its role too, are escaped until the round trip is identical: a backslash goes before each control string, and
before each run of backslashes that ends at one. Unescaping takes it away again. Rendered conversations are written as
pieces of text, cut anywhere; the parser reads each conversation back from its pieces alone, and finds its turns by
the grammar.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import Stage, clean

OPEN, AFTER, CLOSE = "<turn> ### ", " </role> ", " </turn>\n"
# no control string begins or ends with a blank or a backslash, so none arises where a text meets the template
_CONTROL = re.compile(r"(\\*)(<turn>|</turn>|</role>|###)")
TRAINED = "assistant"
PIECE = 1 << 20  # characters of a written piece, about


def escape(text: str) -> str:
    """A run of k backslashes before a control string becomes 2 k + 1."""
    return _CONTROL.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" * ((len(m[1]) - 1) // 2) + m[2] if m[1] else m[0], text)


def render_turn(role: str, text: str) -> str:
    return f"{OPEN}{role}{AFTER}{text}{CLOSE}"


def parse_turn(rendered: str, at: int) -> tuple[str, str, int, int, int] | None:
    """The turn that begins at a place: role and text, unescaped, the place of the text as rendered, and the turn's end.

    None if no whole turn begins there, as what follows is cut off or not of the grammar.
    """
    marks = (m for m in _CONTROL.finditer(rendered, at) if not len(m[1]) & 1)
    turn, sign, role, close = (next(marks, None) for _ in range(4))
    if not close or (turn[0], sign[0], role[2], close[2]) != ("<turn>", "###", "</role>", "</turn>") or (turn.start(), sign.start()) != (at, at + 7) or role[1] or close[1]:
        return None
    a, b, c, d, end = at + len(OPEN), role.start() - 1, role.end() + 1, close.start() - 1, close.end() + 1
    if b < a or d < c or rendered[at:a] != OPEN or rendered[b:c] != AFTER or rendered[d:end] != CLOSE:
        return None
    return unescape(rendered[a:b]), unescape(rendered[c:d]), c, d, end


def parse_turns(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """All turns of a whole text: role, text and the text's place; None if the grammar does not hold."""
    at, out = 0, []
    while at < len(rendered):
        if (found := parse_turn(rendered, at)) is None:
            return None
        out.append(found[:4])
        at = found[4]
    return out


def format_turn(role: str, text: str) -> str:
    """The turn as it stands, if it comes back as it was; otherwise escaped."""
    for r, t in ((role, text), (role, escape(text)), (escape(role), escape(text))):
        if (found := parse_turns(made := render_turn(r, t))) and len(found) == 1 and found[0][:2] == (role, text):
            return made
    raise AssertionError("the grammar lost a turn")


def loss_spans(rendered: str) -> list[tuple[int, int]]:
    """Places of the assistant's texts, as rendered: the loss mask."""
    return [(a, b) for role, _, a, b in parse_turns(rendered) or [] if role == TRAINED]


class Reader:
    """One conversation's digests, from its written text, which comes in pieces."""

    def __init__(self, conv_id):
        self.conv, self.text, self.wait = conv_id, "", 0
        self.n = self.trained = self.size = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        """Takes the turns that are whole; a turn longer than a piece is tried again when the text has doubled."""
        self.text += piece
        self.size += len(piece)
        if len(self.text) < self.wait:
            return
        at = self._parsed()
        self.text = self.text[at:]
        self.wait = 2 * len(self.text)

    def _parsed(self) -> int:
        at = 0
        while at < len(self.text) and (found := parse_turn(self.text, at)):
            role, text, a, b, at = found
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == TRAINED:
                masked = unescape(self.text[a:b])
                self.trained += len(masked)
                self.loss.update(masked.encode())
        return at

    def done(self, n_turns: int) -> tuple:
        """The row; raises if the text does not end with its last turn, or has other turns than were written."""
        if self._parsed() < len(self.text) or self.n != n_turns:
            raise ValueError(f"conversation {self.conv}: {self.n} of {n_turns} turns came back")
        return self.conv, self.n, self.turns.hexdigest(), self.trained, self.loss.hexdigest(), self.size


def format_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text; others ignored) -> conv_id, turn, formatted.

    Every row is a turn; a null text or role is empty. A conversation's output is its formatted turns joined in the
    order of turn (null first), then of the formatted text; repeated rows are turns of their own. A null conv_id is a
    conversation.
    """
    empty = F.lit("")
    plain = clean(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [format_turn(r, t) for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(made, pa.string())], ["conv_id", "turn", "formatted"])

    return plain.mapInArrow(run, "conv_id long, turn long, formatted string")


_PIECES = "conv_id long, part long, last boolean, n_turns long, text string"


def write_conversations(formatted: DataFrame, stage: Stage, piece: int = PIECE) -> DataFrame:
    """Formatted turns -> written conversations: conv_id, part (from 0), last, n_turns (so far), text.

    Turns come in a stream sorted by conversation, so a task holds a piece and not a conversation.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
        names = ["conv_id", "part", "last", "n_turns", "text"]
        rows: list[tuple] = []
        conv, part, n, held, size, begun = None, 0, 0, [], 0, False

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return made

        waiting = 0
        for batch in batches:
            for now, text in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
                if begun and now != conv:
                    rows.append((conv, part, True, n, "".join(held)))
                    waiting += size
                    part, n, held, size = 0, 0, [], 0
                elif size >= piece:
                    rows.append((conv, part, False, n, "".join(held)))
                    waiting += size
                    part, held, size = part + 1, [], 0
                conv, begun, n = now, True, n + 1
                held.append(text)
                size += len(text)
                if waiting >= piece:
                    yield out()
                    waiting = 0
        if begun:
            rows.append((conv, part, True, n, "".join(held)))
        if rows:
            yield out()

    return stage.put(ordered.mapInArrow(run, _PIECES), "conversations")


def read_conversations(written: DataFrame) -> DataFrame:
    """Written conversations -> a row per conversation, read from the pieces' text alone: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars. A text that does not parse as a whole is an error."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for batch in batches:
            rows = []
            for conv, last, n, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "last", "n_turns", "text")), strict=True):
                reader = reader or Reader(conv)
                reader.feed(text)
                if last:
                    rows.append(reader.done(n))
                    reader = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    one = F.col("last") & (F.col("part") == 0)
    whole = written.where(one).select("conv_id", "last", "n_turns", "text").mapInArrow(run, schema)
    if written.where(~one).isEmpty():
        return whole
    # conversations of several pieces may lie in several splits of a file
    long = written.where(~one).repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "last", "n_turns", "text")
    return whole.union(long.mapInArrow(run, schema))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    written = write_conversations(format_turns(rows.unionByName(extra)), Stage(spark, "chat"))
    return read_conversations(written)


#: Of the columns, those that need no template: turns, their digest, and the assistant's texts.
OP9_TURNS_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256 FROM t GROUP BY conv_id
"""


def chat_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9_chat_format that SQL can express."""
    return op9_chat_format(spark, sf_dir).drop("formatted_chars")
