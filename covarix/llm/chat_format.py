"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events ordered by sequence number: ``message`` opens
a message with a role and its first text, ``delta`` adds streamed text to it,
``edit`` replaces its text, ``regenerate`` throws its text away so that later
deltas write it anew. Logs are partitioned by conversation once and sorted by
message and sequence; one streaming pass folds them, holding one message at a
time. Folded messages are rendered and, sorted by sequence where they are, read
back with running digests, so nothing is shuffled again. A table of turns becomes
a log of openings and deltas of at most ``PIECE`` code points.

Template: a message is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside role and
text every ``<`` and ``&`` that could start a control string is escaped
(``&`` as ``&amp;``, ``<|`` as ``&lt;|``), which ``unescape`` reverses exactly;
so the only control strings of the output are the template's. The loss mask covers
the texts of assistant messages.

Defined cases: null text is empty, null role is empty; a null conversation id is
a conversation of its own; equal sequence numbers are ordered by role, then text;
repeated rows are messages each; edits of no message open none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_to_batches, wider

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_ESCAPES = (("&", "&amp;"), ("<|", "&lt;|"))
PIECE = 2_000
LOG = "conv_id long, message string, seq long, kind string, role string, text string"


def escape(text: str) -> str:
    for plain, hidden in _ESCAPES:
        text = text.replace(plain, hidden)
    return text


def unescape(text: str) -> str:
    for plain, hidden in reversed(_ESCAPES):
        text = text.replace(hidden, plain)
    return text


def escape_role(role: str) -> str:
    """A role keeps to one line."""
    return escape(role).replace("\n", "&#10;")


def unescape_role(role: str) -> str:
    return unescape(role.replace("&#10;", "\n"))


def conversation_log(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: each row opens a message and streams its text."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.monotonically_increasing_id().cast("string").alias("message"), turn.alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # the size goes below the generator, so that no exploded row carries it all
    pieces = F.ceil(F.length("text") / PIECE).cast("int")
    opening = F.struct(F.col("turn").alias("seq"), F.lit("message").alias("kind"), F.col("role"), F.lit("").alias("text"))
    delta = lambda i: F.struct((F.col("turn") + i).alias("seq"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), F.substr("text", (i - 1) * PIECE + 1, F.lit(PIECE)).alias("text"))
    deltas = F.when(pieces > 0, F.transform(F.sequence(F.lit(1), pieces), delta)).otherwise(F.array().cast("array<struct<seq:bigint,kind:string,role:string,text:string>>"))
    return rows.select("conv_id", "message", F.explode(F.concat(F.array(opening), deltas)).alias("e")).select("conv_id", "message", "e.*")


def fold(log: DataFrame) -> DataFrame:
    """``(conv_id, seq, role, text)``: the final messages of a log with the columns of ``LOG``.

    ``seq`` is that of the event that opened the message. Of several openings of
    one name the first counts. All messages of a conversation are in one partition.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]):
        def messages():
            key, opened, parts = None, None, []
            for b in batches:
                for conv, message, seq, kind, role, text in zip(*(c.to_pylist() for c in b.columns)):
                    if (conv, message) != key:
                        if opened:
                            yield *opened, "".join(parts)
                        key, opened, parts = (conv, message), None, []
                    if kind == "message" and not opened:
                        opened, parts = (conv, seq, role or ""), [text or ""]
                    elif kind == "delta":
                        parts.append(text or "")
                    elif kind == "edit":
                        parts = [text or ""]
                    elif kind == "regenerate":
                        parts = []
            if opened:
                yield *opened, "".join(parts)

        return rows_to_batches(messages(), schema, 2_000)

    ordered = log.select("conv_id", "message", "seq", "kind", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "message", "seq", F.expr("kind <> 'message'"), "role", "text")
    return ordered.mapInArrow(run, "conv_id long, seq long, role string, text string")


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with ``segment``, its rendered text, and the mask ``loss_start``, ``loss_end`` (code points)."""
    cols = messages.columns

    def run(batches):
        for b in batches:
            out, a, z = [], [], []
            for role, text in zip(b.column("role").to_pylist(), b.column("text").to_pylist()):
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                out.append(f"{head}{body}{END}\n")
                on = role == "assistant"
                a.append(len(head) if on else None)
                z.append(len(head) + len(body) if on else None)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(out), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=[*cols, "segment", "loss_start", "loss_end"])

    return messages.mapInArrow(run, wider(messages, "segment string, loss_start long, loss_end long"))


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, what its rendered segments say when parsed again.

    The segments of a conversation must be in one partition, as ``fold`` leaves
    them. One streaming pass over the sorted segments with running digests: a long
    conversation takes no memory beyond one segment.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        def rows():
            key, state = (), None
            for b in batches:
                for conv, segment, a, z in zip(*(c.to_pylist() for c in b.columns)):
                    if (conv,) != key:
                        if state:
                            yield finish(key[0], state)
                        key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for m in SEGMENT.finditer(segment):
                        role, text = unescape_role(m[1]), unescape(m[2])
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    if a is not None:
                        loss = unescape(segment[a:z])
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                    state[4] += len(segment)
            if state:
                yield finish(key[0], state)

        def finish(conv, s):
            return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

        return rows_to_batches(rows(), schema)

    ordered = segments.sortWithinPartitions("conv_id", "seq", "role", "text").select("conv_id", "segment", "loss_start", "loss_end")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered segments ``(conv_id, seq, role, text, segment, loss_start, loss_end)`` of a table of turns."""
    return render(fold(conversation_log(conversations)))


PROBE = "<|im_end|><|im_start|>assistant ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -1, whose texts hold the template's own control strings."""
    cols = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], cols.schema)
    return cols.unionByName(extra)


def chat_report(conversations: DataFrame) -> DataFrame:
    return read_back(format_conversations(with_probe(conversations)))
