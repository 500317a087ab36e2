"""Chat formatting: conversations folded from event logs, rendered with reversible escapes and a loss mask."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import narrow, table

EVENT_COLUMNS = ("conv_id", "seq", "kind", "message_id", "role", "text")

#: Turn marks of the template.  Inside roles and texts a control string can only begin with one of
#: ``< [ \``, and each of these is followed by a backslash there, so no control string survives.
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>\n"
_ESCAPE = re.compile(r"[<\[\\]")
_UNESCAPE = re.compile(r"([<\[\\])\\")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events: Iterator[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages of one conversation, from its events in order.

    ``message`` starts a message with its whole text; ``delta`` appends to the
    message of its id, starting it if it is new; ``edit`` replaces the text;
    ``regenerate`` empties it and waits for new deltas; ``delete`` removes it.
    A null kind is a message; an unknown kind is ignored; an edit, regeneration
    or deletion of an unknown id is ignored.  A ``message`` without an id, or
    with one already used, is a message of its own.
    """
    out: list[list] = []
    by_id: dict = {}
    for kind, message_id, role, text in events:
        kind, text = kind or "message", text or ""
        known = by_id.get(message_id) if message_id is not None else None
        if kind == "message" or kind == "delta" and known is None:
            row = [role or "", [text]]
            out.append(row)
            if message_id is not None:
                by_id[message_id] = row
        elif known is None:
            continue
        elif kind == "delta":
            known[1].append(text)
        elif kind == "edit":
            known[1][:] = [text]
        elif kind == "regenerate":
            known[1][:] = [text] if text else []
        elif kind == "delete":
            known[0] = None
            by_id.pop(message_id)
    return [(role, "".join(parts)) for role, parts in out if role is not None]


def render(messages: list[tuple[str, str]], loss_roles: tuple[str, ...]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the loss mask as code point ranges in it."""
    parts, mask, at = [], [], 0
    for role, text in messages:
        body = escape(text)
        head = f"{OPEN}{escape(role)}{MIDDLE}"
        if role in loss_roles:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages, read back from the formatted text."""
    turns = formatted.split(OPEN)[1:]
    pairs = (t[: -len(CLOSE)].split(MIDDLE) for t in turns)
    return [(unescape(role), unescape(text)) for role, text in pairs]


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, mask (array of start, end in code points).

    Events (conv_id, seq, kind, message_id, role, text) are dealt by
    conversation, sorted by sequence (ties by message, kind, role, text; nulls
    first), and folded while they stream by: a task holds the messages of one
    conversation at a time, which is the row that it writes.  Null conv_id is a
    conversation of its own; null text or role counts as empty; a conversation
    of which nothing is left has an empty text.  Extra columns are ignored.
    """
    fields = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("formatted", pa.string()),
            ("mask", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ]
    )

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "kind", "message_id", "role", "text")]
                yield from zip(*cols)

        def batch(out):
            ids, texts, masks = zip(*out)
            spans = [[{"start": s, "end": e} for s, e in m] for m in masks]
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip((ids, texts, spans), fields.types)], schema=fields)

        out, size, current, held = [], 0, None, []
        first = True
        for conv, *event in rows():
            if not first and conv != current:
                out.append((current, *render(fold(held), loss_roles)))
                size += len(out[-1][1])
                held = []
                if size > 4_000_000 or len(out) >= 2000:
                    yield batch(out)
                    out, size = [], 0
            first, current = False, conv
            held.append(tuple(event))
        if not first:
            out.append((current, *render(fold(held), loss_roles)))
            yield batch(out)

    log = narrow(events, **{c: c for c in EVENT_COLUMNS}).withColumn("conv_id", F.col("conv_id").cast("long"))
    order = ["conv_id", "seq", "message_id", "kind", "role", "text"]
    return (
        log.repartition("conv_id")
        .sortWithinPartitions(*order)
        .mapInArrow(conversations, "conv_id long, formatted string, mask array<struct<start:long,end:long>>")
    )


def read_back(chats: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, taken from the formatted text and its mask alone."""
    fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    schema = pa.schema(fields)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                turns = parse(row["formatted"])
                all_turns = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode())
                loss = "".join(unescape(row["formatted"][m["start"] : m["end"]]) for m in row["mask"])
                out.append((row["conv_id"], len(turns), all_turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(row["formatted"])))
            cols = list(zip(*out)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(cols, fields)], schema=schema)

    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return chats.mapInArrow(digests, ddl)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    events = log.unionByName(extra).select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("turn").alias("message_id"), "role", "text"
    )
    return read_back(format_chats(events))


QUERIES = {"op6_chat_format": op6_chat_format}

ORACLE = {
    "op6_chat_format": r"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
      UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
      SELECT *, length(text) AS n,
             length(role) + length(regexp_replace(role, '[^<\[\\]', '', 'g'))
             + length(text) + length(regexp_replace(text, '[^<\[\\]', '', 'g')) + 24 AS f
      FROM rows)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(n) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(f) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """
}
