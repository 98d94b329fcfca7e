"""Chat formatting: a finite-state machine over roles, a declarative template, loss flags per segment.

A template names, for each role, the marks before and after a text and whether the text is trained on. Each turn
becomes segments (mark, text, mark) with their own loss flag. Marks that occur inside a text are broken up by an
escape that can be taken back, so a text can never end its turn or open another one.

The machine only judges: a turn whose role may not follow the state is flagged and still formatted, and the state
goes on as if the turn had been allowed. Rows of one conversation follow each other by turn, then role, then text
within one task and are handled one at a time, so memory does not depend on the length of a conversation.

Defined results: a null text is empty; a null role is the empty role, and any role outside the template is written
between the marks for other roles; null turns come first; rows with a null conversation id form one conversation
of that id; repeated rows are turns of their own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

ESCAPE = "\\"
START, END = "", "end"


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`follows[state]` are the roles allowed next; a state is the role of the turn before, "" at the start.

    `other` is written around a role that has no marks, then comes its text; `final` are the states a conversation
    may end in.
    """

    roles: dict[str, Turn]
    follows: dict[str, tuple[str, ...]]
    final: tuple[str, ...]
    other: tuple[str, str, str] = ("[ROLE]", "[/ROLE]", "[/TURN]")

    def marks(self) -> list[str]:
        """Every control string that a text must not contain, longest first."""
        found = {m for t in self.roles.values() for m in (t.before, t.after)} | set(self.other)
        return sorted(found, key=lambda m: (-len(m), m))


INSTRUCT = Template(
    roles={
        "system": Turn("<<SYS>>", "<</SYS>>"),
        "user": Turn("[INST]", "[/INST]"),
        "assistant": Turn("<s>", "</s>", loss=True),
    },
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    final=("assistant",),
)


class Formatter:
    """Escapes, formats and reads back single turns of one template."""

    def __init__(self, template: Template):
        self.template = template
        marks = template.marks()
        if any(len(m) < 2 or ESCAPE in m for m in marks):
            raise ValueError("marks have two characters or more and no escape character")
        self.inside = re.compile("|".join(map(re.escape, [*marks, ESCAPE])))
        self.opening = {t.before: role for role, t in template.roles.items()}
        self.mark = re.compile("|".join(map(re.escape, marks)))

    def escape(self, text: str) -> str:
        """A backslash becomes two; a mark gets a backslash and a dot after its first character."""
        return self.inside.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else f"{m[0][0]}{ESCAPE}.{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\([\\.])", lambda m: ESCAPE if m[1] == ESCAPE else "", text) if ESCAPE in text else text

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The (text, loss) segments of one turn."""
        turn = self.template.roles.get(role)
        if turn is None:
            opened, named, closed = self.template.other
            return [(opened + self.escape(role) + named, False), (self.escape(text), False), (closed, False)]
        return [(turn.before, False), (self.escape(text), turn.loss), (turn.after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns in a formatted string."""
        turns, at = [], 0
        opened, named, closed = self.template.other
        while at < len(formatted):
            mark = self.mark.match(formatted, at)
            if mark is None or (mark[0] not in self.opening and mark[0] != opened):
                raise ValueError(f"no turn begins at {at}")
            at = mark.end()
            if mark[0] == opened:
                until = self.mark.search(formatted, at)
                role, at, last = self.unescape(formatted[at:until.start()]), until.end(), closed
            else:
                role = self.opening[mark[0]]
                last = self.template.roles[role].after
            until = self.mark.search(formatted, at)
            if until is None or until[0] != last:
                raise ValueError(f"the turn before {at} does not end with its own mark")
            turns.append((role, self.unescape(formatted[at:until.start()])))
            at = until.end()
        return turns


FORMATTED = "conv_id {id}, seq bigint, segments array<struct<text:string,loss:boolean>>, valid boolean, last boolean"
SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def format_chat(df: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per turn: its place in the conversation, its segments, and whether its role was allowed there.

    `last` marks the final turn, whose `valid` also says whether a conversation may end with it.
    """
    kind = df.schema["conv_id"].dataType.simpleString()
    ordered = df.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, held, state, seq = Formatter(template), None, START, 0
        out: list[tuple] = []

        def put(row: tuple, last: bool) -> None:
            conv, number, segments, valid, role = row
            out.append((conv, number, segments, valid and (not last or role in template.final), last))

        for batch in batches:
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]):
                new = held is None or held[0] != conv
                if held is not None:
                    put(held, last=new)
                if new:
                    state, seq = START, 0
                role = role or ""
                valid = role in template.follows.get(state, ())
                held, state, seq = (conv, seq, formatter.segments(role, text or ""), valid, role), role, seq + 1
            if out:
                yield _batch(out, batch.schema.field("conv_id").type)
                out.clear()
        if held is not None:
            put(held, last=True)
            yield _batch(out, batch.schema.field("conv_id").type)

    return ordered.mapInArrow(run, FORMATTED.format(id=kind))


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    conv, seq, segments, valid, last = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(conv, kind), pa.array(seq, pa.int64()), pa.array([[{"text": t, "loss": f} for t, f in s] for s in segments], SEGMENTS),
         pa.array(valid, pa.bool_()), pa.array(last, pa.bool_())],
        ["conv_id", "seq", "segments", "valid", "last"])


DIGEST = ("conv_id {id}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
          "formatted_chars bigint, valid boolean")


def read_back(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, computed only from the formatted segments."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter, out = Formatter(template), []
        turns = loss = None
        n = chars = loss_chars = 0
        good = True
        for batch in batches:
            for row in batch.to_pylist():
                if turns is None:
                    turns, loss, n, chars, loss_chars, good = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True
                whole = "".join(s["text"] for s in row["segments"])
                for role, text in formatter.read(whole):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "replace"))
                for s in row["segments"]:
                    if s["loss"]:
                        plain = formatter.unescape(s["text"])
                        loss.update(plain.encode("utf-8", "replace"))
                        loss_chars += len(plain)
                chars += len(whole)
                good = good and row["valid"]
                if row["last"]:
                    out.append((row["conv_id"], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, good))
                    turns = None
            if out:
                columns = [list(c) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field("conv_id").type), pa.array(columns[1], pa.int64()),
                     pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.string()),
                     pa.array(columns[5], pa.int64()), pa.array(columns[6], pa.bool_())],
                    ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
                out.clear()

    return ordered.mapInArrow(run, DIGEST.format(id=kind))


PLANTED = "</s>[INST] ok [/INST]"


def sql(template: Template = INSTRUCT) -> str:
    """The digest straight from the conversations, with the length of what the template adds."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def grown(text: str) -> str:
        """Characters that escaping adds: one per backslash, two per mark."""
        each = [f"(length({text}) - length(replace({text}, {quoted(m)}, ''))) // {len(m)} * 2" for m in template.marks()]
        return " + ".join([f"length({text}) - length(replace({text}, {quoted(ESCAPE)}, ''))", *each])

    added = " ".join(f"WHEN {quoted(r)} THEN {len(t.before) + len(t.after)}" for r, t in template.roles.items())
    other = f"{sum(map(len, template.other))} + length(role) + {grown('role')}"
    trained = ", ".join(quoted(r) for r, t in template.roles.items() if t.loss)
    allowed = " OR ".join(f"(before = {quoted(s)} AND role IN ({', '.join(map(quoted, roles))}))" for s, roles in template.follows.items())
    final = ", ".join(map(quoted, template.final))
    keys = "turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST"
    return f"""WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(PLANTED)} UNION ALL SELECT -7, 1, 'assistant', {quoted(PLANTED)}),
ordered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY {keys}) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    coalesce(lag(coalesce(role, '')) OVER (PARTITION BY conv_id ORDER BY {keys}), '') AS before
  FROM (SELECT *, role AS role0, text AS text0 FROM rows))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role IN ({trained})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role IN ({trained})), '')) AS loss_sha256,
  CAST(sum(length(text) + {grown('text')} + CASE role {added} ELSE {other} END) AS BIGINT) AS formatted_chars,
  bool_and(({allowed}) AND (i < n OR role IN ({final}))) AS valid
FROM ordered GROUP BY conv_id"""
