"""Chat formatting with a compiled template, and reading the formatted text back.

Control strings inside texts are escaped reversibly: "<", any backslashes and "|" get one more
backslash before the bar, so "<|" never comes from a text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortweave.llm.template import compile_template

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for turn in turns %}" + START + "{{ turn.role | line | guard }}\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | guard }}{% endgeneration %}"
    "{% else %}{{ turn.text | guard }}{% endif %}" + END + "\n{% endfor %}")
OPEN = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")
CHUNK = 1 << 16


def guard(text: str) -> str:
    return OPEN.sub(r"<\1\\|", text)


def unguard(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def line(role: str) -> str:
    """A role on one line."""
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def unline(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


FILTERS = {"guard": guard, "line": line}
CHUNKS = "conv_id long, chunk long, text string, loss array<struct<start:long,stop:long>>"
DIGESTS = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
           "formatted_chars long")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Formatted conversations as rows conv_id, chunk, text, loss: the chunks of a conversation, in
    order and in one partition, and the spans under the loss mask (code points from the conversation's
    start). A chunk ends after a whole piece, so memory holds one text, not one conversation.

    Turns are taken by (turn, role, text), nulls first; repeated rows are turns of their own. Null role
    or text counts as empty; null conv_id is a conversation like others. An empty table gives no rows.
    Other columns are not read.
    """
    slim = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                        F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = slim.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formatter = compile_template(template, FILTERS)
        for conv, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            chunk, at, held, size, spans = 0, 0, [], 0, []
            for text, generated in formatter({"turns": ({"role": r[2], "text": r[3]} for r in rows)}):
                held.append(text)
                if generated:
                    spans.append({"start": at, "stop": at + len(text)})
                at, size = at + len(text), size + len(text)
                if size >= CHUNK:
                    yield one_chunk(conv, chunk, held, spans)
                    chunk, held, size, spans = chunk + 1, [], 0, []
            if held or not chunk:
                yield one_chunk(conv, chunk, held, spans)

    def one_chunk(conv: int | None, chunk: int, held: list[str], spans: list[dict]) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([chunk], pa.int64()), pa.array(["".join(held)], pa.string()),
             pa.array([spans], kind)], names=["conv_id", "chunk", "text", "loss"])

    return ordered.mapInArrow(gathered(render), CHUNKS)


def gathered(fn):
    """Join the one-row batches that `fn` yields to larger ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in fn(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20 or len(held) >= 5000:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
    return run


def read_back(chunks: DataFrame) -> DataFrame:
    """Parse format_conversations() output: digests of the turns and of the text under the loss mask.

    The chunks must come in order within partitions, as format_conversations() leaves them.
    """
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DIGESTS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for conv, rows in groupby(rows_of(batches), key=lambda r: r[0]):
            turns, loss, n, loss_chars, at, rest = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, ""
            for _, _, text, spans in rows:
                for s in spans:
                    said = unguard(text[s["start"] - at:s["stop"] - at])
                    loss.update(said.encode())
                    loss_chars += len(said)
                at += len(text)
                *done, rest = (rest + text).split(END + "\n")
                for turn in done:
                    if not turn.startswith(START):
                        raise ValueError(f"conversation {conv}: a turn does not begin with {START}")
                    role, _, said = turn[len(START):].partition("\n")
                    turns.update(f"{unline(unguard(role))}\n{unguard(said)}\n".encode())
                    n += 1
            if rest:
                raise ValueError(f"conversation {conv}: the last turn does not end with {END}")
            values = [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), at]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    return chunks.mapInArrow(gathered(parse), DIGESTS)
