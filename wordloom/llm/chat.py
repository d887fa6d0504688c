r"""Chat formatting with a grammar round trip.

Grammar of a rendered conversation (terminals in quotes):

    conversation = { turn }
    turn         = "### " name ": " text "</turn>" "\n"

``name`` is the role, capitalised for the roles in ``NAMES``.  A deterministic
parser reads the rendered text back: a turn ends at the first "</turn>", and a
control string elsewhere breaks the grammar.  Each turn is rendered as it is,
parsed, and compared with its source; while they differ, the next level escapes
more, until they are identical:

* level 0: nothing is escaped;
* level 1: in the text, "\" becomes "\\", a line feed "\n", "</" becomes "<\/"
  and "##" becomes "#\#", so that no control string is left;
* level 2: the same in the role, which is not capitalised, and ": " becomes ":\ ".

The open mark tells the level: "### ", "###1 ", "###2 ".

Scale: turns are rendered and checked one by one, in parallel; conversations are
put together by a sorted stream that holds one turn at a time, so a conversation
of any length needs little memory.  The contract's digests run over a whole
conversation and so bind it to one task.

Defined results: null text or role is empty; turns are in order of turn (null
first), then role, then text; rows with a null conv_id form one conversation
with a null id; repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings.
OPEN = ("### ", "###1 ", "###2 ")
NAME_END = ": "
CLOSE = "</turn>"
NAMES = {"user": "User", "assistant": "Assistant", "system": "System"}
LEARNED = "assistant"

_ROLES = {v: k for k, v in NAMES.items()}
_MARK = re.compile(r"###([12]?) ")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("</", "<\\/").replace("##", "#\\#")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def oracle(added: str) -> str:
    """``conversation_digests`` in DuckDB's SQL, with the rows of conversation -7 that say ``added``; for known roles."""
    said = added.replace("'", "''")
    name = "CASE role " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items()) + " END"
    return rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, 'assistant', '{said}')),
r AS (SELECT *, {name} AS name, contains(text, '</turn>') OR contains(text, '###') AS escaped,
  replace(replace(replace(replace(text, '\', '\\'), chr(10), '\n'), '</', '<\/'), '##', '#\#') AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LEARNED}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{LEARNED}'), '')) AS loss_sha256,
  sum(CASE WHEN escaped THEN 5 + length(body) ELSE 4 + length(text) END + length(name) + {len(NAME_END) + len(CLOSE) + 1})::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
"""


def parse(rendered: str) -> list[tuple[str, str]] | None:
    """The turns of a rendered conversation; None if it breaks the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not (mark := _MARK.match(rendered, at)):
            return None
        level, begin = int(mark[1] or 0), mark.end()
        middle = rendered.find(NAME_END, begin)
        close = rendered.find(CLOSE, begin)
        if middle < 0 or close < middle + len(NAME_END) or not rendered.startswith("\n", close + len(CLOSE)):
            return None
        name, text = rendered[begin:middle], rendered[middle + len(NAME_END) : close]
        if "###" in name + " " + text or "\n" in name:
            return None
        turns.append((unescape(name) if level > 1 else _ROLES.get(name, name), unescape(text) if level else text))
        at = close + len(CLOSE) + 1
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn under the first level that survives the round trip; where its text begins and ends."""
    for level, mark in enumerate(OPEN):
        name = escape(role).replace(NAME_END, ":\\ ") if level > 1 else NAMES.get(role, role)
        head = f"{mark}{name}{NAME_END}"
        body = escape(text) if level else text
        line = f"{head}{body}{CLOSE}\n"
        if parse(line) == [(role, text)]:
            return line, len(head), len(head) + len(body)
    raise ValueError("no level escapes this turn")


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, rendered, begin, end (the text's place) and learned (under the loss mask)."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = [render(r, t) for r, t in zip(batch["role"], batch["text"], strict=True)]
            out = batch.assign(rendered=[x for x, _, _ in lines], begin=[b for _, b, _ in lines], end=[e for _, _, e in lines])
            yield out.assign(learned=out["role"] == LEARNED)[["conv_id", "turn", "role", "text", "rendered", "begin", "end", "learned"]]

    # Ids may be null, which pandas has no integers for: they travel as strings.
    plain = rows.withColumns({c: F.col(c).cast("string") for c in ("conv_id", "turn")})
    made = plain.mapInPandas(run, "conv_id string, turn string, role string, text string, rendered string, begin int, end int, learned boolean")
    return made.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


class _Conversation:
    """Digests of one conversation, fed turn by turn from the rendered text."""

    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, rendered: str, begin: int, end: int, learned: bool) -> None:
        self.chars += len(rendered)
        turns = parse(rendered)
        if turns is None:
            raise ValueError("a rendered turn breaks the grammar")
        for role, text in turns:
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if learned:
            text = rendered[begin:end] if rendered.startswith(OPEN[0]) else unescape(rendered[begin:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Per conversation, read back from the rendered text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    turns = formatted_turns(conversations)
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "rendered", "begin", "end", "learned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def finished() -> pa.RecordBatch:
            ids, states = [i for i, _ in done], [s for _, s in done]
            columns = [
                pa.array(ids, pa.int64()), pa.array([s.n_turns for s in states], pa.int64()), pa.array([s.turns.hexdigest() for s in states], pa.string()),
                pa.array([s.loss_chars for s in states], pa.int64()), pa.array([s.loss.hexdigest() for s in states], pa.string()), pa.array([s.chars for s in states], pa.int64()),
            ]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            for conv, *turn in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if state is None or conv != current:
                    if state is not None:
                        done.append((current, state))
                    current, state = conv, _Conversation()
                state.add(*turn)
            yield finished()
        if state is not None:
            done.append((current, state))
        yield finished()

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
