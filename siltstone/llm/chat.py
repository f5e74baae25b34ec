"""Chat formatting by event sourcing.

A log of events is partitioned by message, sorted by sequence, and folded: a message event opens a
message, deltas append to it, an edit or a regeneration replaces what it holds. Final messages are
rendered to segments of a template with a loss mask, and a conversation's output is its segments in
order. Reading back is a sorted stream for each partition of conversations, in which digests take
one segment at a time: no conversation is ever held whole, however long it is.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles ``\\`` becomes
``\\\\`` and ``<|`` becomes ``<\\|`` (and a line feed in a role ``\\n``), so that no control string can
occur in them; ``unescape`` is the inverse.

Defined cases: null texts and roles count as empty; rows of one turn are ordered by role and text;
repeated rows are turns each; null turns come first; a null conversation is one of its own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import importable

START, END = "<|im_start|>", "<|im_end|>\n"
#: Characters in a streamed delta when rows are turned into a log.
DELTA_CHARS = 1000
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def render(role: str, text: str) -> tuple[str, int, int]:
    """One segment, and where its text begins and ends."""
    head = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}", len(head), len(head) + len(body)


def parse(output: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a conversation's output."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


def to_events(rows: DataFrame) -> DataFrame:
    """The log (conv_id, turn, nth, seq, kind, role, text) of finished (conv_id, turn, role, text)
    rows: a message event, then the text as deltas. ``nth`` tells rows of one turn apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), text))
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / DELTA_CHARS).cast("int")), lambda i: F.struct(i.alias("seq"), F.when(i == 0, F.lit("message")).otherwise(F.lit("delta")).alias("kind"), F.when(i == 0, F.lit("")).otherwise(F.substring(text, (i - 1) * DELTA_CHARS + 1, F.lit(DELTA_CHARS))).alias("text")))
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("nth", nth)
    return numbered.select("conv_id", "turn", "nth", F.coalesce("role", F.lit("")).alias("role"), F.explode(pieces).alias("e")).select("conv_id", "turn", "nth", "e.seq", "e.kind", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """Segments (conv_id, turn, nth, segment, loss_start, loss_stop), one for each final message.

    Events without a message event before them open the message with their role. Events of equal
    sequence are taken by kind and text. Loss covers the texts of assistants."""
    importable(events.sparkSession)
    key = ("conv_id", "turn", "nth")
    types = {f.name: f.dataType.simpleString() for f in events.schema}
    log = events.select(*key, "seq", "kind", "role", "text").repartition(*key).sortWithinPartitions(*key, "seq", "kind", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, role, parts = None, "", []

        def final() -> tuple:
            segment, a, b = render(role, "".join(parts))
            return (*now, segment, *((a, b) if role == "assistant" else (0, 0)))

        def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
            names = [*key, "segment", "loss_start", "loss_stop"]
            kinds = [*(schema.field(k).type for k in key), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for conv, turn, nth, _, kind, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (conv, turn, nth) != now:
                    if now is not None:
                        done.append(final())
                    now, role, parts = (conv, turn, nth), who or "", []
                if kind == "delta":
                    parts.append(text or "")
                elif kind in ("message", "edit", "regenerate"):
                    parts = [text or ""]
                else:
                    raise ValueError(f"unknown event {kind}")
            if done:
                yield batch_of(done, schema)
        if now is not None:
            yield batch_of([final()], schema)

    return log.mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in key), "segment string", "loss_start long", "loss_stop long"]))


def read_back(segments: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), parsed from the output."""
    conv_type = segments.schema["conv_id"].dataType.simpleString()
    stream = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "nth").select("conv_id", "segment", "loss_start", "loss_stop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, schema = None, False, None
        state: dict = {}

        def start() -> dict:
            return {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        def final() -> tuple:
            return now, state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]

        for batch in batches:
            schema, done = batch.schema, []
            for conv, segment, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != now:
                    if begun:
                        done.append(final())
                    now, begun, state = conv, True, start()
                for role, text in parse(segment):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode())
                loss = unescape(segment[a:b])
                state["chars"] += len(loss)
                state["loss"].update(loss.encode())
                state["size"] += len(segment)
            if done:
                yield batch_of(done)
        if begun:
            yield batch_of([final()])

    return stream.mapInArrow(run, f"conv_id {conv_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
