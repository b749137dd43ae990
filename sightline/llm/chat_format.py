"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation, sorted by sequence number and folded into the final
messages, which are rendered with a template.  Events: ``message`` opens a message with a role and a
first text, ``delta`` appends to the newest message, ``edit`` replaces message ``target`` and forgets all
later ones, ``regenerate`` empties message ``target`` (deltas follow) and forgets all later ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
# Control strings begin with "<|".  Texts get a backslash more between the two characters, so no text holds one.
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

_CHAT = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
    T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.LongType()))])


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """Roles stand on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def fold(messages: list[list[str]], kind: str, target: int | None, role: str | None, text: str) -> None:
    """Apply one event to the messages (role, text parts ...) of a conversation; unknown kinds and targets change nothing."""
    if kind == "message":
        messages.append([role or "", text])
    elif kind == "delta":
        if messages:
            messages[-1].append(text)
    elif kind in ("edit", "regenerate") and target is not None and 0 <= target < len(messages):
        del messages[target + 1:]
        messages[target][1:] = [text if kind == "edit" else ""]


def render(messages: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """Formatted conversation and its loss mask: start and end of each learned text, in characters."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body, tail = f"{START}{escape_role(role)}\n", escape(text), f"{END}\n"
        if role == LEARNED_ROLE:
            spans += [at + len(head), at + len(head) + len(body)]
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation, as they were before escaping."""
    out = []
    for part in formatted.split(START)[1:]:
        role, body = part[:part.rindex(END)].split("\n", 1)
        out.append((unescape_role(role), unescape(body)))
    return out


def format_chats(events: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``n_turns``, ``formatted`` and ``loss_spans``.

    ``events`` has conv_id, seq, kind, target, role and text.  Events of equal ``seq`` are ordered by kind,
    role and text.  Null texts are empty, null roles are empty roles, a null conv_id is a conversation of its
    own, events of unknown kind are ignored, repeated events are applied as often as they come.  Texts may
    hold anything, control strings included: escaping is reversible (:func:`parse`).

    A task reads its conversations one after the other and holds one at a time.
    """
    order = ["conv_id", "seq", "kind", "role", "text"]
    log = (
        events.select("conv_id", F.col("seq").cast("long"), "kind", F.col("target").cast("long"), "role", "text")
        .repartition("conv_id").sortWithinPartitions(*order))

    def reconstruct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, messages, begun, done = None, [], False, []

        def close() -> None:
            final = [(m[0], "".join(m[1:])) for m in messages]
            done.append((now, len(final), *render(final)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _CHAT.names)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "kind", "target", "role", "text")]
            for conv, kind, target, role, text in zip(*columns):
                if not begun or conv != now:
                    if begun:
                        close()
                    now, messages, begun = conv, [], True
                fold(messages, kind, target, role, text or "")
            yield flush()
        if begun:
            close()
        yield flush()

    return log.mapInArrow(reconstruct, _CHAT)


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, computed from ``formatted`` and ``loss_spans`` alone."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                turns = parse(text)
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    whole.update(f"{role}\n{body}\n".encode())
                for a, b in zip(spans[::2], spans[1::2]):
                    learned = unescape(text[a:b])
                    chars += len(learned)
                    loss.update(learned.encode())
                out.append((conv, len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(text)))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(names))

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(digest, schema)
