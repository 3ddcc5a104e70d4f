"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, and only its reply trainable. A
conversation that doesn't end with an assistant turn also gives an example without a trainable span, so that no turn is
lost. An example is a text with a mask (a start and an end in code points).

Template: `<|im_start|>role\\ntext<|im_end|>\\n` per turn. In texts and roles, a backslash becomes two and `<|` becomes
`<\\|`; in roles a line feed also becomes `\\n`. So no text can hold a control string, and unescaping gives it back.

Rows go by turn; ties by role, then text, nulls first. The rows of a conversation are streamed in order (a sort by
conversation and turn), and one conversation's text so far is what a task holds, as its last example does.

Defined results: a null text is empty, a null role is the empty role; rows with a null conv_id are one conversation;
repeated rows are turns of their own; an empty table gives no examples; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_batches

START, END = "<|im_start|>", "<|im_end|>"
EXAMPLES = "conv_id long, example long, text string, loss_start long, loss_end long, last boolean"
#: Examples that a batch holds at most, in characters.
BATCH_CHARS = 4 << 20
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:[^<]|<(?!\|))*)<\|im_end\|>\n")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def formatted_turn(role: str, text: str) -> tuple[str, int]:
    """A turn in the template, and where its text starts."""
    head = f"{START}{escape_role(role)}\n"
    return f"{head}{escape(text)}{END}\n", len(head)


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of an example; raises where it isn't in the template."""
    out, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        out.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return out


def examples(conversations: DataFrame) -> DataFrame:
    """The examples of each conversation, in order, next to each other in one partition."""
    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        current: object = batches  # equal to no conversation
        prefix: list[str] = []
        chars = number = 0
        open_turns = False

        def finish() -> None:
            nonlocal size
            if open_turns:
                held.append((current, number, "".join(prefix), None, None, True))
                size += chars
            elif held:
                held[-1] = (*held[-1][:5], True)

        def flush(keep: int) -> pa.RecordBatch:
            nonlocal held, size
            out, held = held[: len(held) - keep], held[len(held) - keep :]
            size = sum(len(r[2]) for r in held)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
            columns = zip(*out, strict=True) if out else ((),) * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "example", "text", "loss_start", "loss_end", "last"])

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if conv != current or current is batches:
                    if current is not batches:
                        finish()
                    current, prefix, chars, number, open_turns = conv, [], 0, 0, False
                turn, at = formatted_turn(role, text)
                if role == "assistant":
                    prefix = ["".join(prefix)]
                    held.append((conv, number, prefix[0] + turn, chars + at, chars + len(turn) - len(END) - 1, False))
                    size += chars + len(turn)
                    number += 1
                prefix.append(turn)
                chars += len(turn)
                open_turns = role != "assistant"
                if size > BATCH_CHARS and len(held) > 1:
                    yield flush(1)
        if current is not batches:
            finish()
        if held:
            yield flush(0)

    return dealt.mapInArrow(run, EXAMPLES)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row per conversation from its examples alone: turns, the text under the mask, and digests of both.

    Streams over the examples as `examples` leaves them: a conversation's examples in order in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, loss_chars, chars = hashlib.sha256(), 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                chars += len(r["text"])
                if r["loss_start"] is not None:
                    reply = unescape(r["text"][r["loss_start"] : r["loss_end"]])
                    loss.update(reply.encode())
                    loss_chars += len(reply)
                if r["last"]:
                    turns, digest = turns_of(r["text"]), hashlib.sha256()
                    for role, text in turns:
                        digest.update(f"{role}\n{text}\n".encode())
                    out.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": digest.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
                    loss, loss_chars, chars = hashlib.sha256(), 0, 0
            schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
