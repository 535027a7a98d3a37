"""Chat formatting: a finite-state machine over roles and a declarative template.

Turns are dealt by conversation, sorted, and streamed: one pass per partition keeps only the current turn, the state of
the machine and running digests, so a conversation of any length needs bounded memory. Each turn becomes segments
(header, body, end) with a loss flag taken from the template. Control strings inside texts are escaped: in every
``<\\...\\|`` one backslash is added, so no text can hold ``<|``, and removing one restores it.

Edge cases: null text is empty, a null role is the empty role; turns are ordered by (turn, role, text) with nulls
first, so ties and repeated rows have one order; an invalid turn order is formatted all the same and flagged; an empty
table gives an empty result; columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENTS = "conv_id long, turn_no long, kind string, text string, loss boolean, valid boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, formatted_sha256 string, valid_order boolean"

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text) if "|" in text else text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text) if "|" in text else text


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles carry loss, and which role may follow which (START begins, END ends)."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>\n"
    loss_roles: frozenset = frozenset({"assistant"})
    follows: dict = field(default_factory=lambda: {
        "START": {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user", "tool", "END"}, "tool": {"assistant", "tool"},
    })

    def header(self, role: str) -> str:
        return self.open + escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + self.after_role

    def parse_header(self, text: str) -> str:
        role = unescape(text[len(self.open):len(text) - len(self.after_role)])
        return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


CHATML = Template()


def format_chats(conversations: DataFrame, template: Template = CHATML) -> DataFrame:
    """Segments in order within a partition: header, body and end of each turn, then one row of kind ``done``.

    The valid flag says whether the turn may follow the state before it; on ``done``, whether the conversation may end.
    """
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def segments(frames):
        now, state, n = None, "START", 0
        for frame in frames:
            out = []
            for conv, role, text in zip(frame["conv_id"].astype("Int64").array, frame["role"], frame["text"]):
                conv = None if pd.isna(conv) else int(conv)
                if n and conv != now:
                    out.append((now, n, "done", "", False, "END" in template.follows.get(state, ())))
                    state, n = "START", 0
                now, valid = conv, role in template.follows.get(state, ())
                out += [(conv, n, "header", template.header(role), False, valid), (conv, n, "body", escape(text), role in template.loss_roles, valid), (conv, n, "end", template.close, False, valid)]
                state, n = role, n + 1
            if out:
                yield _frame(out, SEGMENTS)
        if n:
            yield _frame([(now, n, "done", "", False, "END" in template.follows.get(state, ()))], SEGMENTS)

    return turns.mapInPandas(segments, SEGMENTS)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.replace(",", "").split()[0::2]).astype({"conv_id": "Int64"})


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """One row for each conversation, with digests computed only from the formatted segments, which it streams."""

    def digests(frames):
        turns, loss, whole = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        chars = lost = 0
        good = True
        for frame in frames:
            out = []
            for conv, n, kind, text, masked, valid in zip(frame["conv_id"].astype("Int64").array, frame["turn_no"], frame["kind"], frame["text"], frame["loss"], frame["valid"]):
                good &= bool(valid)
                if kind == "done":
                    out.append((conv, n, turns.hexdigest(), lost, loss.hexdigest(), chars, whole.hexdigest(), good))
                    turns, loss, whole = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
                    chars, lost, good = 0, 0, True
                    continue
                whole.update(text.encode("utf-8", "surrogatepass"))
                chars += len(text)
                if kind == "header":
                    turns.update(f"{template.parse_header(text)}\n".encode())
                elif kind == "body":
                    plain = unescape(text)
                    raw = plain.encode("utf-8", "surrogatepass")
                    turns.update(raw + b"\n")
                    if masked:
                        lost += len(plain)
                        loss.update(raw)
            if out:
                yield _frame(out, DIGESTS)

    return segments.mapInPandas(digests, DIGESTS)
