"""Chat formatting with a grammar round trip.

Grammar (a conversation is the concatenation of its turns in order):

    turn := "[INST]" text "[/INST]"               role "user"
          | "<s>" text "</s>"                     role "assistant"
          | "<<SYS>>" text "<</SYS>>"             role "system"
          | "[ROLE]" role "[TEXT]" text "[/ROLE]" any other role

The parser is deterministic: an opening mark chooses the rule, and a field ends at the first closing mark of its rule.
In every field it reads, a control string with k >= 1 backslashes after its first character stands for one with k - 1. A
turn is rendered raw, parsed again and compared with its source; while they differ, or a bare control string of any role stands
in a field, its fields are escaped once more (one backslash added to every control string, with or without backslashes). One
escape always suffices, because an escaped field holds no bare control string and no control string overlaps itself; more is
an error. Reading back parses the joined text of a conversation, not single turns.

A null role or text is empty. Rows of a conversation are ordered by turn, then role, then text, nulls first; repeated rows
are repeated turns. A null conv_id is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import slices

#: The control strings of the template.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
CONTROLS = sorted({m for pair in MARKS.values() for m in pair} | set(OTHER), key=len, reverse=True)

_STEM = "(?:" + "|".join(re.escape(c[0]) + r"(?=\\*" + re.escape(c[1:]) + ")" for c in CONTROLS) + ")"
_ANY = re.compile(f"({_STEM})")
_ESCAPED = re.compile(f"({_STEM})" + r"\\")
_BARE = re.compile("|".join(map(re.escape, CONTROLS)))


def escape(text: str) -> str:
    return _ANY.sub(lambda m: m[1] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The turn, and where its text lies in it."""
    if role in MARKS:
        before, after = MARKS[role]
    else:
        before, after = OTHER[0] + role + OTHER[1], OTHER[2]
    return before + text + after, len(before), len(before) + len(text)


def parse(block: str, start: int = 0) -> tuple[str, str, int] | None:
    """Role and text of the turn at `start`, and where it ends; None where the grammar does not match."""
    for role, (before, after) in MARKS.items():
        if block.startswith(before, start):
            begin = start + len(before)
            end = block.find(after, begin)
            return None if end < 0 else (role, unescape(block[begin:end]), end + len(after))
    if not block.startswith(OTHER[0], start):
        return None
    begin = start + len(OTHER[0])
    middle = block.find(OTHER[1], begin)
    end = -1 if middle < 0 else block.find(OTHER[2], middle + len(OTHER[1]))
    if end < 0:
        return None
    return unescape(block[begin:middle]), unescape(block[middle + len(OTHER[1]) : end]), end + len(OTHER[2])


def format_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """Rendered turn, span of its text, whether it had to be escaped; parsing it gives role and text back."""
    source = role, text
    for attempt in range(3):
        block, begin, end = render(role, text)
        found = parse(block)
        clean = not _BARE.search(text) and (role in MARKS or not _BARE.search(role))
        if clean and found and found[:2] == source and found[2] == len(block):
            return block, begin, end, attempt > 0
        text = escape(text)
        role = role if role in MARKS else escape(role)
    raise ValueError("a turn cannot be read back")


def format_conversations(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One formatted block per turn; a conversation's text is its blocks in order of turn, role, text.

    Columns: the block, the span of its text that bears loss (nulls unless the role is `trained`), and the source's order
    columns. Every turn is formatted where it is read, so a conversation of any length needs no single task.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    fields = {f.name: f.dataType.simpleString() for f in rows.schema}

    def work(batches):
        for part in slices(batches, 2000):
            roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            bears = [r == trained for r in roles]
            yield pa.RecordBatch.from_arrays(
                [part.column("conv_id"), part.column("turn"), pa.array([m[0] for m in made], pa.string()),
                 pa.array([m[1] if b else None for m, b in zip(made, bears, strict=True)], pa.int32()),
                 pa.array([m[2] if b else None for m, b in zip(made, bears, strict=True)], pa.int32()),
                 pa.array([m[3] for m in made], pa.bool_()), part.column("role"), part.column("text")],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "escaped", "role", "text"],
            )

    return rows.mapInArrow(
        work,
        f"conv_id {fields['conv_id']}, turn {fields['turn']}, formatted string, loss_start int, loss_end int, escaped boolean, "
        "role string, text string",
    )


class Reader:
    """Digests of one conversation, parsed as one text that arrives block by block."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.rest = conv_id, 0, 0, 0, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, block: str, begin: int | None, end: int | None):
        joined, at = self.rest + block, 0
        while at < len(joined):
            found = parse(joined, at)
            if found is None:
                break  # its end may be in a later block
            role, text, at = found
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        self.rest = joined[at:]
        if begin is not None:
            text = unescape(block[begin:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(block)

    def row(self):
        if self.rest:
            raise ValueError("the formatted text does not follow the grammar")
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(blocks: DataFrame) -> DataFrame:
    """Per conversation what a reader of the formatted text recovers: turns, text under the loss mask, their digests.

    A digest runs over a conversation in order, so its blocks are sorted and streamed; memory holds one batch.
    """
    kind = blocks.schema["conv_id"].dataType.simpleString()
    ordered = blocks.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def work(batches):
        reader = None
        for part in slices(batches, 2000):
            done = []
            columns = (part.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))
            for conv_id, block, begin, end in zip(*columns, strict=True):
                if reader is None or reader.conv_id != conv_id:
                    done += [reader.row()] if reader else []
                    reader = Reader(conv_id)
                reader.add(block, begin, end)
            yield table(done, part.schema.field("conv_id").type)
            key_type = part.schema.field("conv_id").type
        if reader:
            yield table([reader.row()], key_type)

    def table(rows, key_type):
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [key_type, *types], strict=True)], names)

    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(
        work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
