"""Chat formatting from an event log.

Events (conv_id, seq, kind, turn, copy, role, text) are folded into final messages:

* ``message`` starts a message with its role and first text, ``delta`` appends, ``edit`` replaces the text (later deltas append to it);
* ``regenerate`` empties the message and drops the messages of later turns that were written before it.

An event of turn t is void if a later event regenerates a turn below t. The latest such regeneration is a running maximum over turns, taken
first over blocks of turns and then inside each block, so a conversation with a third of all rows is no single group. A message
is then the texts from its last start on, in order of seq; its role is the last one given.

Rendering gives one segment per message, ``### role: text</turn>`` and a line end, with every backslash, # and < of a text (and : of a role) escaped by a backslash,
so an unescaped mark is always the template's. A conversation is its segments in order of (turn, copy); the loss mask covers
the text of assistant messages, as a start and a length in the segment. ``Reader`` reads the stream of segments back in pieces of any length.

Defined cases: null texts are empty, null roles are ""; a null turn comes first; a null conv_id is a conversation of its own; events of
other kinds are ignored; rows of the same (conv_id, turn, copy, seq) are applied in order of kind, role and text; an empty log gives no rows;
other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

BLOCK = 1024  # turns
OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
LEARN = "assistant"


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text of the final messages."""
    e = events.filter(F.col("kind").isin("message", "delta", "edit", "regenerate")).select(
        "conv_id", "seq", "kind", F.coalesce(F.col("turn").cast("long"), F.lit(-1 << 63)).alias("turn"), F.col("copy").cast("int").alias("copy"), "role",
        F.coalesce("text", F.lit("")).alias("text"))
    turns = e.groupBy("conv_id", "turn").agg(F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("at")) \
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
    blocks = turns.groupBy("conv_id", "block").agg(F.max("at").alias("at")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.max("at").over(Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    inside = F.max("at").over(Window.partitionBy("conv_id", "block").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    bound = turns.withColumn("inside", inside).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b"))) \
        .select("c", F.col("turn").alias("t"), F.greatest("inside", "before").alias("void_until"))
    live = e.join(bound, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("turn") == F.col("t"))) \
        .filter(F.col("void_until").isNull() | (F.col("seq") > F.col("void_until")))
    whole = live.groupBy("conv_id", "turn", "copy").agg(F.array_sort(F.collect_list(F.struct(
        "seq", "kind", "role", "text"))).alias("log"))
    first = F.expr("coalesce(array_max(transform(log, (x, i) -> if(x.kind = 'delta', cast(null as int), i + 1))), 1)")
    return whole.select(
        "conv_id", F.when(F.col("turn") != (-1 << 63), F.col("turn")).alias("turn"), "copy",
        F.coalesce(F.expr("try_element_at(filter(transform(log, x -> x.role), r -> r is not null), -1)"), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("log", first, F.size("log")), lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, turn, copy, segment, loss_start, loss_length."""
    role = F.regexp_replace(F.coalesce("role", F.lit("")), r"([\\#<:])", r"\\$1")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"([\\#<])", r"\\$1")
    return messages.select("conv_id", "turn", "copy", role.alias("r"), text.alias("t"), (F.col("role") == LEARN).alias("learn")).select(
        "conv_id", "turn", "copy", F.concat(F.lit(OPEN), "r", F.lit(SEP), "t", F.lit(CLOSE)).alias("segment"),
        (F.length("r") + len(OPEN) + len(SEP)).cast("long").alias("loss_start"),
        F.when(F.col("learn"), F.length("t")).otherwise(0).cast("long").alias("loss_length"))


ESCAPED = re.compile(r"\\(.)", re.S)
#: Possessive, so that an unfinished turn is given up at once.
TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)</turn>\n", re.S)


class Reader:
    """Reads formatted text in pieces of any length; ``feed`` gives the (role, text) pairs that are complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.rest += piece
        found, at = [], 0
        while m := TURN.match(self.rest, at):
            found.append((ESCAPED.sub(r"\1", m[1]), ESCAPED.sub(r"\1", m[2])))
            at = m.end()
        self.rest = self.rest[at:]
        return found

    def close(self) -> None:
        if self.rest:
            raise ValueError("the end of the text is no whole turn")


def digests(segments: DataFrame) -> DataFrame:
    """What reading the rendered conversations back gives: turns, hashes of turns and of the text under the mask, lengths.

    Conversations are dealt by conv_id and streamed in order; a task holds one segment, not a conversation.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = (), None, []

        def close() -> None:
            if state:
                state["reader"].close()
                rows.append((key[0], state["turns"], state["all"].hexdigest(), state["loss"], state["masked"].hexdigest(), state["chars"]))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(columns, kinds)], names=schema.names)

        for batch in batches:
            for conv, segment, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != key:
                    close()
                    key, state = (conv,), {"reader": Reader(), "turns": 0, "all": hashlib.sha256(), "loss": 0, "masked": hashlib.sha256(), "chars": 0}
                state["chars"] += len(segment)
                for role, text in state["reader"].feed(segment):
                    state["turns"] += 1
                    state["all"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if length:
                    masked = ESCAPED.sub(r"\1", segment[start:start + length])
                    state["loss"] += len(masked)
                    state["masked"].update(masked.encode("utf-8", "surrogatepass"))
            yield out()
        close()
        yield out()

    id_field = segments.schema["conv_id"]
    kinds = [pa.string() if isinstance(id_field.dataType, T.StringType) else pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    schema = T.StructType([id_field, *(T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())))])
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "copy").select(
        "conv_id", "segment", "loss_start", "loss_length").mapInArrow(run, schema)


def as_events(conversations: DataFrame, piece: int = 512) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as the log that wrote it: one message and its deltas per row."""
    rows = conversations.withColumn("copy", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length(F.coalesce("text", F.lit(""))) - 1, F.lit(0)) / piece).cast("int")),
                         lambda k: F.substr(F.coalesce("text", F.lit("")), k * piece + 1, F.lit(piece)))
    return rows.select("conv_id", "turn", "copy", "role", F.posexplode(pieces).alias("k", "text")).select(
        "conv_id", F.struct("turn", "copy", "k").alias("seq"), F.when(F.col("k") == 0, "message").otherwise("delta").alias("kind"),
        "turn", "copy", F.when(F.col("k") == 0, F.col("role")).alias("role"), "text")
