"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its rendered turns:

    system     [SYS] text [/SYS]
    user       <s>[INST] text [/INST]
    assistant  ` text</s>`                 (the text is under the loss mask)
    other      [ROLE name] text [/ROLE]

Each turn is rendered, read back by a deterministic parser and compared with its source; while they
differ, control strings inside the text are escaped. An escape puts a backslash after the first
character of a control string; a control string that already holds backslashes there gets one more, and
the parser takes one away, so any text survives. Conversations stream through tasks in sorted order: a
task holds one turn at a time, however long the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The template: role, what opens its turn, what closes it.
TEMPLATE = {"system": ("[SYS] ", " [/SYS]"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", "</s>")}
OTHER = ("[ROLE ", "] ", " [/ROLE]")
_CONTROL = r"(<|\[)(\\*)(?=s>|/s>|INST\]|/INST\]|SYS\]|/SYS\]|ROLE |/ROLE\])"
_RAISE, _LOWER = re.compile(_CONTROL), re.compile(_CONTROL.replace(r"(\\*)", r"\\(\\*)"))
_HEAD = re.compile(r"(?P<system>\[SYS\] )|(?P<user><s>\[INST\] )|(?P<other>\[ROLE (?P<name>(?:[^\]\\]|\\.)*)\] )|(?P<assistant> )", re.S)


def escape(text: str) -> str:
    return _RAISE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _LOWER.sub(r"\1\2", text)


def parse(rendered: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start and end of the raw text) of each turn; None if it isn't in the grammar."""
    out, at = [], 0
    while at < len(rendered):
        head = _HEAD.match(rendered, at)
        if head is None:
            return None
        role = next(r for r in ("system", "user", "other", "assistant") if head[r] is not None)
        close = OTHER[2] if role == "other" else TEMPLATE[role][1]
        end = rendered.find(close, head.end())
        if end < 0:
            return None
        name = re.sub(r"\\(.)", r"\1", head["name"], flags=re.S) if role == "other" else role
        out.append((name, unescape(rendered[head.end() : end]), head.end(), end))
        at = end + len(close)
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's rendering, and where its raw text starts and ends in it."""
    if role in TEMPLATE:
        before, after = TEMPLATE[role]
    else:
        before, after = OTHER[0] + re.sub(r"([\]\\])", r"\\\1", role) + OTHER[1], OTHER[2]
    shown = text
    for _ in range(2):
        whole = before + shown + after
        back = parse(whole)
        if back is not None and [t[:2] for t in back] == [(role, text)]:
            return whole, len(before), len(before) + len(shown)
        shown = escape(text)
    raise ValueError(f"the template can't hold a turn of role {role!r}")


FORMATTED = "conv_id long, turn_no long, role string, rendered string, start long, loss_start long, loss_end long"


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per turn, by conversation and in its order: turn_no from 0, the role, the rendered turn,
    `start`, the code points of the conversation before it, and the loss mask loss_start..loss_end
    inside `rendered` (both null unless the role is assistant).

    Turns are ordered by turn, ties by role and text; null turns come first, repeated rows stay. A null
    text or role is an empty one; rows with a null conv_id are a conversation of their own. Other
    columns are dropped; an empty table gives no rows. Each partition holds whole conversations,
    sorted, so a reader may stream over it."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, no, at = object(), 0, 0
        for b in batches:
            out = []
            for conv, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if conv != now:
                    now, no, at = conv, 0, 0
                whole, s, e = render(role, text)
                out.append((conv, no, role, whole, at, *((s, e) if role == "assistant" else (None, None))))
                no, at = no + 1, at + len(whole)
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r, strict=True)) for r in out], _SCHEMA)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


_NAMES = [x.split(" ")[0] for x in FORMATTED.split(", ")]
_SCHEMA = pa.schema([(x.split(" ")[0], pa.string() if x.endswith("string") else pa.int64()) for x in FORMATTED.split(", ")])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are parsed again, a row per conversation: n_turns,
    the SHA-256 of role, line feed, text, line feed per turn, the code points and the SHA-256 of the
    unescaped text under the loss mask, and the code points of the rendering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = None, True
        state: list = []

        def new() -> list:
            return [0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def row() -> tuple:
            return (now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for b in batches:
            out = []
            for conv, rendered, ls, le in zip(*(b.column(i).to_pylist() for i in (0, 3, 5, 6)), strict=True):
                if first or conv != now:
                    if not first:
                        out.append(row())
                    now, first, state = conv, False, new()
                for role, text, _, _ in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if ls is not None:
                    text = unescape(rendered[ls:le])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(rendered)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _DIGEST.types, strict=True)], schema=_DIGEST)
        if not first:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row(), _DIGEST.types, strict=True)], schema=_DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe_turns(spark: SparkSession) -> DataFrame:
    """A conversation whose texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
