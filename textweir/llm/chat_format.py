r"""Operator 8: chat formatting that is proven by a grammar round trip.

A turn is ``### ROLE: TEXT</turn>`` and a line end; a conversation is its turns
by turn number. Grammar, read from left to right: a backslash makes the next
character plain; ``### `` opens a turn, the first plain ``: `` ends the role,
the first plain ``</turn>`` and line end close the turn; a plain ``###`` or
``</turn>`` anywhere else is an error. Each turn is rendered as it stands and
parsed again; where the parse differs from the source, its conflicting content
is escaped, one level at a time, until both are identical. As every turn opens
and closes itself, the parse of a conversation is that of its turns in order;
so turns are formatted in any task, and a conversation of any length is never
held as one value.

Defined cases: a null role or text counts as empty; turns with the same number
follow by role, then text, and repeated rows are kept; a null turn number comes
first; a null conv_id is one conversation; a turn of any length is formatted and
parsed alone, in about ten times its size; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: What each level puts a backslash before: nothing; control strings and backslashes; every character that a control string holds.
LEVELS = (None, re.compile(r"\\|###|</turn>"), re.compile(r"[\\#<:]"))
_token = re.compile(r"\\(.)|(</turn>\n)|(</turn>|###)|(: )|([^\\<#:]+|[<#:])", re.S)


class ParseError(ValueError):
    pass


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; the bounds are those of the escaped text."""
    turns, pos = [], 0
    while pos < len(formatted):
        if not formatted.startswith(OPEN, pos):
            raise ParseError(f"no turn opens at {pos}")
        pos += len(OPEN)
        role: list[str] = []
        text: list[str] = []
        start = end = -1
        while end < 0:
            m = _token.match(formatted, pos)
            if not m:
                raise ParseError(f"the turn is not closed at {pos}")
            plain, close, stray, mid, other = m.groups()
            if stray or (close and start < 0):
                raise ParseError(f"a control string stands at {pos}")
            if close:
                end = pos
            elif mid and start < 0:
                start = m.end()
            else:
                (role if start < 0 else text).append(plain if plain is not None else mid or other)
            pos = m.end()
        turns.append(("".join(role), "".join(text), start, end))
    return turns


def escape(s: str, level: int) -> str:
    return LEVELS[level].sub(lambda m: "\\" + m[0], s) if level else s


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and the bounds of its text, at the first level whose parse gives the source back."""
    for level in range(len(LEVELS)):
        out = OPEN + escape(role, level) + MID + escape(text, level) + CLOSE
        try:
            found = parse(out)
        except ParseError:
            continue
        if len(found) == 1 and found[0][:2] == (role, text):
            return out, found[0][2], found[0][3]
    raise AssertionError("the last level escapes all that the grammar reads")


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_end: one row per turn; no loss bounds but for the assistant's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            roles = pdf["role"].fillna("").tolist()
            made = [format_turn(r, t) for r, t in zip(roles, pdf["text"].fillna("").tolist())]
            own = [r == ASSISTANT for r in roles]
            yield pd.DataFrame({
                "conv_id": pdf["conv_id"], "turn": pdf["turn"], "role": roles, "formatted": [m[0] for m in made],
                "loss_start": pd.array([m[1] if o else None for m, o in zip(made, own)], dtype="Int64"),
                "loss_end": pd.array([m[2] if o else None for m, o in zip(made, own)], dtype="Int64"),
            })

    source = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return source.mapInPandas(run, "conv_id long, turn long, role string, formatted string, loss_start long, loss_end long")


def digests(chats: DataFrame) -> DataFrame:
    """What a reader recovers from formatted chats: one row per conversation.

    Conversations are streamed in order through running digests, so a
    conversation that holds a third of all rows takes no more memory than one
    batch. A digest of an ordered text is sequential; that one task stays.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state, done = object(), None, []

        def close() -> None:
            if state:
                n, turns, chars, loss, size = state
                done.append((key, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def out() -> pd.DataFrame:
            frame = pd.DataFrame(done, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            done.clear()
            return frame.astype({"conv_id": "Int64"})

        for pdf in batches:
            for conv, formatted, start, end in zip(pdf["conv_id"], pdf["formatted"], pdf["loss_start"], pdf["loss_end"]):
                conv = None if pd.isna(conv) else int(conv)
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, a, b in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if not pd.isna(start):
                        if (a, b) != (int(start), int(end)):
                            raise ParseError("the loss mask is not the text that was parsed")
                        state[2] += len(text)
                        state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            if done:
                yield out()
        close()
        if done:
            yield out()

    dealt = chats.select("conv_id", "turn", "role", "formatted", "loss_start", "loss_end").repartition("conv_id")
    # Ties by the text itself: the turn without its close, unescaped; for equal roles what stands before it is equal.
    text = F.regexp_replace(F.expr(f"left(formatted, length(formatted) - {len(CLOSE)})"), r"(?s)\\(.)", "$1")
    dealt = dealt.sortWithinPartitions("conv_id", "turn", "role", text)
    return dealt.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, ASSISTANT, probe)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


# The level of a turn's escapes: none; one before each control string and backslash; one before each character that any holds.
# The second fails where a run of hashes is longer than three and no multiple of three.
_LEVEL = r"""CASE WHEN NOT (contains(role, ': ') OR contains(text, '###') OR contains(text, '</turn>') OR contains(text, '\') OR contains(role, '###') OR contains(role, '</turn>') OR contains(role, '\')) THEN 0
  WHEN contains(role, ': ') OR regexp_matches(role || ': ' || text, '(^|[^#])(###)+#{1,2}([^#]|$)') THEN 2 ELSE 1 END"""
ORACLE_SQL = rf"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, '{ASSISTANT}')) AS v(t, r)),
l AS (SELECT *, {_LEVEL} AS level FROM c),
f AS (SELECT *, length(role) + length(text) + {len(OPEN + MID + CLOSE)} + CASE level WHEN 0 THEN 0 WHEN 1 THEN len(regexp_extract_all(role || chr(0) || text, '\\|###|</turn>')) ELSE len(regexp_extract_all(role || text, '[\\#<:]')) END AS size FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{ASSISTANT}'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = '{ASSISTANT}'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
