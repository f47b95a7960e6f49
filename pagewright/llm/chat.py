"""Chat formatting: a finite-state machine over roles, a declarative template, reversible escapes and loss flags."""

from __future__ import annotations

import functools
import hashlib
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import in_slices


@dataclass(frozen=True)
class Template:
    """What stands around the turns of each role, and which roles are learned.

    `transitions` is the machine: (state, role) -> state. A conversation is valid if every turn has a transition, and
    complete if it also ends in one of the states `final`.
    """

    headers: dict = field(default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "})
    other: tuple = ("### Role <", ">: ")
    end: str = "</turn>"
    after: str = "\n"
    learned: frozenset = frozenset({"assistant"})
    transitions: dict = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
            ("assistant", "tool"): "tool",
            ("tool", "assistant"): "assistant",
        }
    )
    final: frozenset = frozenset({"assistant"})

    def header(self, role: str) -> str:
        return self.headers.get(role) or self.other[0] + self.escape(role) + self.other[1]

    @functools.cached_property
    def controls(self) -> re.Pattern:
        marks = [*self.headers.values(), self.other[0], self.other[1], self.end]
        stems = sorted({m.strip() for m in marks}, key=len, reverse=True)
        return re.compile("\\\\|" + "|".join(map(re.escape, stems)))

    def escape(self, text: str) -> str:
        """A backslash goes before every backslash and every control string, so no unescaped mark is left inside."""
        out, at = io.StringIO(), 0
        for m in self.controls.finditer(text):
            out.write(text[at : m.start()])
            out.write("\\")
            at = m.start()
        return out.getvalue() + text[at:]

    def unescape(self, text: str) -> str:
        out, at = io.StringIO(), 0
        while (found := text.find("\\", at)) >= 0:
            out.write(text[at:found])
            out.write(text[found + 1 : found + 2])
            at = found + 2
        return out.getvalue() + text[at:] if at else text


SEGMENTS = "conv_id long, turn_no long, state string, valid boolean, segments array<struct<text:string,loss:boolean>>"
_PIECE = pa.struct([("text", pa.string()), ("loss", pa.bool_())])


def format_chat(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per turn, conversations together and turns in order: the segments of text, each with its loss flag.

    Joining the segments' texts gives the formatted conversation. Turns are ordered by (turn, role, text), nulls first,
    so ties and repeated rows have one order; all are kept. Null text counts as empty, null role as the role ''.
    A null conv_id is a conversation of its own. Unknown roles get the generic header and break validity.
    `state` is the machine's state after the turn ('broken' from the first turn without a transition on).
    Rows stream through the task; only the state is held, so a conversation may be of any length. An empty table gives
    no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, number = object(), "start", 0
        for batch in batches:
            for cut in in_slices(batch, "text"):
                keys, numbers, states, texts = cut.column("conv_id").to_pylist(), [], [], []
                roles = cut.column("role").to_pylist()
                for key, role, text in zip(keys, roles, cut.column("text").to_pylist(), strict=True):
                    if key != conv:
                        conv, state, number = key, "start", 0
                    state = template.transitions.get((state, role), "broken")
                    numbers.append(number)
                    states.append(state)
                    number += 1
                    texts += (template.header(role), template.escape(text), template.end + template.after)
                losses = [flag for role in roles for flag in (False, role in template.learned, False)]
                pieces = pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(losses, pa.bool_())], fields=list(_PIECE))
                segments = pa.ListArray.from_arrays(np.arange(0, 3 * len(roles) + 1, 3, dtype=np.int32), pieces)
                columns = [cut.column("conv_id"), pa.array(numbers, pa.int64()), pa.array(states, pa.string()), pa.array([s != "broken" for s in states], pa.bool_()), segments]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn_no", "state", "valid", "segments"])

    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, SEGMENTS)


def find_mark(text: str, mark: str, at: int) -> int:
    """Where the first unescaped `mark` from `at` on stands; -1 without one. A mark is escaped by an odd number of backslashes."""
    begin = at
    while (found := text.find(mark, at)) >= 0:
        before = found
        while before > begin and text[before - 1] == "\\":
            before -= 1
        if (found - before) % 2 == 0:
            return found
        at = found + 1
    return -1


def parse_chunk(chunk: str, template: Template = Template()) -> Iterator[tuple[str, str]]:
    """The (role, text) pairs of a formatted stretch that holds whole turns; only the text itself is looked at."""
    by_header = sorted(((h, r) for r, h in template.headers.items()), key=lambda x: -len(x[0]))
    at = 0
    while at < len(chunk):
        for header, role in by_header:
            if chunk.startswith(header, at):
                at += len(header)
                break
        else:
            begin = at + len(template.other[0])
            if not chunk.startswith(template.other[0], at) or (end := find_mark(chunk, template.other[1], begin)) < 0:
                raise ValueError(f"no header at {at}")
            role, at = template.unescape(chunk[begin:end]), end + len(template.other[1])
        if (end := find_mark(chunk, template.end, at)) < 0 or not chunk.startswith(template.after, end + len(template.end)):
            raise ValueError(f"no end of the turn that starts at {at}")
        yield role, template.unescape(chunk[at:end])
        at = end + len(template.end) + len(template.after)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean, complete boolean"
_DIGEST_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_())


class Digest:
    """What is told of one conversation, turn after turn."""

    def __init__(self, key: int | None):
        self.key, self.n, self.learned, self.chars, self.valid, self.state = key, 0, 0, 0, True, ""
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, pieces: list[str], losses: list[bool], state: str, template: Template) -> None:
        chunk = "".join(pieces)
        self.chars += len(chunk)
        self.state, self.valid = state, self.valid and state != "broken"
        for role, text in parse_chunk(chunk, template):
            for part in (role, "\n", text, "\n"):
                self.turns.update(part.encode())
            self.n += 1
        for piece, loss in zip(pieces, losses, strict=True):
            if loss:
                text = template.unescape(piece)
                self.loss.update(text.encode())
                self.learned += len(text)

    def row(self, template: Template) -> tuple:
        return self.key, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.valid, self.valid and self.state in template.final


def digest_chat(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """A row per conversation of format_chat's output, read back from the formatted text and the loss mask.

    It reads the rows as format_chat leaves them (a conversation's turns together, in order), as a stream; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in DIGESTS.split(", ")]
        last = None

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _DIGEST_KINDS, strict=True)], names=names)

        for batch in batches:
            out, segments = [], batch.column("segments")
            offsets = segments.offsets.to_numpy()
            texts, losses = segments.values.field("text"), segments.values.field("loss")
            for k, (key, state) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("state").to_pylist(), strict=True)):
                if last is None or key != last.key:
                    out += [last.row(template)] if last else []
                    last = Digest(key)
                at, size = offsets[k], offsets[k + 1] - offsets[k]
                last.add(texts.slice(at, size).to_pylist(), losses.slice(at, size).to_pylist(), state, template)
            if out:
                yield made(out)
        if last:
            yield made([last.row(template)])

    return formatted.mapInArrow(run, DIGESTS)


_HEADERS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: ", "tool": "### Tool: "}
_MARKS = r"(\\|### Assistant:|### Role <|### System:|### User:|### Tool:|</turn>|>:)"
_ESCAPED = lambda c: rf"length(regexp_replace({c}, '{_MARKS}', '\\\1', 'g'))"
_LENGTHS = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(h)}" for r, h in _HEADERS.items()) + f" ELSE 13 + {_ESCAPED('role')} END"
_IN_TURN = "ORDER BY turn NULLS FIRST, role, text"
_ROLES = "CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' WHEN 'tool' THEN 't' ELSE 'x' END"

#: DuckDB's answer to the query: escapes are counted by a regular expression, the machine is one over roles' initials.
ORACLE = rf"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
  c AS (SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' {_IN_TURN})) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' {_IN_TURN}), '') AS learned,
    sum({_LENGTHS} + {_ESCAPED('text')} + 8)::BIGINT AS formatted_chars,
    string_agg({_ROLES}, '' {_IN_TURN}) AS path FROM t GROUP BY conv_id)
  SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars,
    regexp_full_match(path, 's?(ua(ta)*)*(u|ua(ta)*t)?') AS valid, regexp_full_match(path, 's?(ua(ta)*)+') AS complete FROM c"""


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digest_chat(format_chat(turns.unionByName(extra)))
