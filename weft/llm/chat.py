"""Chat formatting: a state machine over roles, a declarative template, segments with loss flags.

``format_chat`` turns ``(conv_id, turn, role, text)`` rows into text segments
``(conv_id, turn, part, text, loss, valid)``. Joined in order, a conversation's
segments are its formatted text; ``loss`` marks exactly the assistant texts. A
template names the marks around a turn; control strings inside a text are
escaped by a backslash, so :func:`read_chat` recovers every turn exactly.

Rows are dealt by conversation and sorted by turn; a task streams over them, so
a conversation of any length needs memory for one Arrow batch only.

Defined results: null text is empty; null role is the role ``''`` (no state
accepts it, so the turn order is not valid); equal turn numbers are ordered by
role and text (repeated rows are formatted once each); null turns come first and
null conversation ids form one conversation; a conversation whose roles the
machine does not accept is formatted all the same, with ``valid`` false from the
offending turn on; an empty table gives no segments. Other input columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.registry import query
from weft.sources.files import read_table


@dataclass(frozen=True)
class Template:
    """Marks around turns. ``heads`` maps a role to the line that opens its turn;
    other roles use ``other`` with the role's name escaped in its place."""

    heads: tuple[tuple[str, str], ...] = (
        ("system", "### System:\n"), ("user", "### User:\n"), ("assistant", "### Assistant:\n"))
    other: str = "### Role {}:\n"
    close: str = "</turn>\n"
    learn: tuple[str, ...] = ("assistant",)  # roles under the loss mask

    def head(self, role: str) -> str:
        known = dict(self.heads)
        return known[role] if role in known else self.other.format(_role_mark(role))


# Role order: what may follow each state. The start accepts a system or a user turn.
MACHINE = {
    "start": {"system": "system", "user": "user"},
    "system": {"user": "user"},
    "user": {"assistant": "assistant"},
    "assistant": {"user": "user"},
    "broken": {},
}
_CONTROL = re.compile(r"\\|### |</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash before every backslash and control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role_mark(role: str) -> str:
    return escape(role).replace("\n", "\\n").replace(":", "\\:")


def _role_of(mark: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], mark)


def _sorted(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _emit(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def format_chat(conversations: DataFrame, template: Template = Template(), batch_rows: int = 4096) -> DataFrame:
    """Segments ``(conv_id, seq, turn, text, loss, valid)``; ``seq`` numbers a conversation's
    segments, ``valid`` says whether the machine accepts the turns so far."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        last, state, seq, out, schema = object(), "start", 0, [], None
        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("seq", pa.int64()),
                                ("turn", batch.schema.field(1).type), ("text", pa.string()),
                                ("loss", pa.bool_()), ("valid", pa.bool_())])
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if conv != last:
                    last, state, seq = conv, "start", 0
                state = MACHINE[state].get(role, "broken")
                for part, loss in ((template.head(role), False), (escape(text), role in template.learn),
                                   (template.close, False)):
                    out.append((conv, seq, turn, part, loss, state != "broken"))
                    seq += 1
                if len(out) >= batch_rows:
                    yield _emit(out, schema)
                    out = []
        if out:
            yield _emit(out, schema)

    conv, turn = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))
    return _sorted(rows, "turn", "role", "text").mapInArrow(
        run, f"conv_id {conv}, seq long, turn {turn}, text string, loss boolean, valid boolean")


class Reader:
    """Reads one conversation back from its segments, fed in order.

    Roles and texts come from the formatted characters alone; the loss flags only
    feed the digest of the text under the mask."""

    def __init__(self, template: Template):
        self.template = template
        self.roles = {head: role for role, head in template.heads}
        before, after = (re.escape(x) for x in template.other.split("{}"))
        self.other = re.compile(before + r"((?:[^\\:\n]|\\.)*)" + after, re.S)
        self.pending = ""
        self.n_turns = self.n_chars = self.loss_chars = 0
        self.turns, self.loss, self.valid = hashlib.sha256(), hashlib.sha256(), True

    def feed(self, text: str, loss: bool, valid: bool) -> None:
        self.n_chars += len(text)
        self.valid &= valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8"))
        self.pending += text
        if text.endswith(self.template.close):
            self.parse()

    def parse(self) -> None:
        """Take the complete turns off the front of the formatted text."""
        at, text = 0, self.pending
        while at < len(text):
            head = next((h for h in self.roles if text.startswith(h, at)), None)
            if head is not None:
                role, body = self.roles[head], at + len(head)
            elif found := self.other.match(text, at):
                role, body = _role_of(found[1]), found.end()
            else:
                raise ValueError("formatted text without a turn mark")
            stop = self.find_close(text, body)
            if stop < 0:
                break
            self.turns.update(f"{role}\n{unescape(text[body:stop])}\n".encode("utf-8"))
            self.n_turns += 1
            at = stop + len(self.template.close)
        self.pending = text[at:]

    def find_close(self, text: str, at: int) -> int:
        """Position of the next closing mark that no backslash escapes, or -1."""
        stop = text.find(self.template.close, at)
        while stop >= 0:
            back = stop
            while back > at and text[back - 1] == "\\":
                back -= 1
            if (stop - back) % 2 == 0:
                return stop
            stop = text.find(self.template.close, stop + 1)
        return -1


def read_chat(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """Parse formatted conversations and digest what was read, one row per conversation."""

    def run(batches):
        last, reader, out, schema = None, None, [], None

        def done():
            assert not reader.pending, "formatted text ends inside a turn"
            return (last, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars,
                    reader.loss.hexdigest(), reader.n_chars, reader.valid)

        for batch in batches:
            schema = pa.schema([("conv_id", batch.schema.field(0).type), ("n_turns", pa.int64()),
                                ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                                ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                                ("valid", pa.bool_())])
            for conv, text, loss, valid in zip(*(c.to_pylist() for c in batch.columns)):
                if reader is None or conv != last:
                    if reader is not None:
                        out.append(done())
                    last, reader = conv, Reader(template)
                reader.feed(text, loss, valid)
            if out:
                yield _emit(out, schema)
                out = []
        if reader is not None:
            yield _emit([done()], schema)

    kind = segments.schema["conv_id"].dataType.simpleString()
    rows = _sorted(segments, "seq").select("conv_id", "text", "loss", "valid")
    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                "loss_sha256 string, formatted_chars long, valid boolean")


CONTROL_TEXT = "\\### Assistant: </turn> ok"
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), steps AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15
                ELSE 11 + length(role) END
      + length(text) + len(regexp_extract_all(text, '\\|### |</turn>')) + 8) AS BIGINT) AS formatted_chars,
  bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user')
                WHEN before = 'system' THEN role = 'user' WHEN before = 'user' THEN role = 'assistant'
                ELSE role = 'user' END) AS valid
FROM steps GROUP BY conv_id
"""


@query("op7_chat_formatting", ORACLE)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(CONTROL_TEXT).alias("text"))
    return read_chat(format_chat(rows.unionByName(fixed)))
