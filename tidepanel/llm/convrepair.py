"""Conversation structure repair by Hirschberg's divide and conquer.

Rows (conv_id, turn, role, text) are taken in order of turn, nulls first, then role, then SHA-256 of the text. ``number_rows`` sorts them over all partitions
and gives each its first fault:

* ``blank``: no character but white space (\\x20, \\x09 to \\x0D); ``duplicate``: role and text stood earlier in the conversation;
* ``truncated``: the last character that is no white space is none of ``.!?``.

``repair`` finds the cheapest edits after which the initials of the roles read ``(s?(ua)+)?``: Keep 0, Rerole to user or assistant 2, Delete 3 (blank and
duplicate rows must go), Insert an empty user or assistant row anywhere 2; a truncated row that stays adds 1. Among cheapest edits the ASCII-least
sequence of initials (D, I, K, R) wins. The grammar has four states: at the start, after s, after u, after a; the role that an edit gives follows from its state.

The method: a forward vector holds for each state the least cost and the rank, among the four, of the least edit sequence that has it; a backward
vector holds the costs to the end. Both meet in the middle, where the state with the least sum, then the least rank, is the crossing; both halves are solved
likewise. Vectors of a part are all that is kept, so memory is linear. Sequences into different states at one row boundary never begin one another
(inserts belong to the row after them), so ranks order whole sequences.

Spread: rows become one byte each and are cut into blocks of ``BLOCK`` rows inside the sorted partitions, so a conversation with a third of all rows is many
blocks. A block gives four forward vectors; the same recursion over blocks gives each its first and last state (blocks are what one task holds of a
conversation), and each block is then recovered by itself. Nothing goes through the driver.

Defined cases: null role and text are one space; a null conv_id is a conversation of its own; an empty role has no initial, so it must be edited;
repeated rows are duplicates; turns more than 2^63 apart count as no gaps; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidepanel.session import materialize

BLOCK = 1 << 16
SPACE = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
FAR = 1 << 50
INITIALS = "sua"
#: Where a role's initial leads from each state: start, after s, after u, after a. Rows of others than s, u, a lead nowhere.
NEXT = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
ROLES = {2: "user", 3: "assistant"}


def insertions(state: int) -> list[tuple[int, int, str]]:
    """(state, cost, edits) reached by inserts; a state is never worth reaching twice."""
    found = [(state, 0, "")]
    for at, cost, word in found:
        for initial in "ua":
            to = NEXT[at].get(initial)
            if to and all(to != f[0] for f in found):
                found.append((to, cost + INSERT, word + "I"))
    return found


def row_steps(symbol: int) -> tuple:
    """(from, to, cost, edits) of the inserts before a row and its own edit, the least for each from and to."""
    initial, must_go, truncated = "sua-"[symbol >> 2], symbol >> 1 & 1, symbol & 1
    best: dict = {}
    for p in range(4):
        for q, cost, word in insertions(p):
            edits = [(q, DELETE, "D")]
            if not must_go:
                if initial in NEXT[q]:
                    edits.append((NEXT[q][initial], TRUNCATED * truncated, "K"))
                edits += [(NEXT[q][i], REROLE + TRUNCATED * truncated, "R") for i in "ua" if i in NEXT[q]]
            for t, more, letter in edits:
                best[p, t] = min(best.get((p, t), (FAR, "")), (cost + more, word + letter))
    return tuple((p, t, *v) for (p, t), v in sorted(best.items()))


STEPS = [row_steps(s) for s in range(16)]
CLOSE = [min((cost, word) for q, cost, word in insertions(s) if q in ((0, 3) if s == 0 else (3,))) for s in range(4)]
CHOICE = [{(p, t): word for p, t, _, word in steps} for steps in STEPS]


def forward(elements: Sequence, vector: list) -> list:
    """(cost, rank) of each state after the elements. An element is its steps (from, to, cost, key); keys order the steps out of one state."""
    for steps in elements:
        best: list = [None] * 4
        for p, t, cost, key in steps:
            if vector[p][0] < FAR:
                found = (vector[p][0] + cost, (vector[p][1], key))
                if best[t] is None or found < best[t]:
                    best[t] = found
        order = sorted(b[1] for b in best if b)
        vector = [(b[0], order.index(b[1])) if b else (FAR, 9) for b in best]
    return vector


def backward(elements: Sequence, vector: list) -> list:
    """Cost from each state before the elements to the end."""
    for steps in reversed(elements):
        best = [FAR] * 4
        for p, t, cost, _ in steps:
            best[p] = min(best[p], cost + vector[t])
        vector = best
    return vector


def from_state(state: int) -> list:
    return [(0, 0) if s == state else (FAR, 9) for s in range(4)]


def crossings(elements: Sequence, start: int, end: int) -> list[int]:
    """The state after each element on the least path from ``start`` to ``end``."""
    found, todo = [], [(0, len(elements), start, end)]
    while todo:
        lo, hi, a, b = todo.pop()
        if hi - lo == 1:
            found.append(b)
            continue
        mid = (lo + hi) // 2
        ahead = forward(elements[lo:mid], from_state(a))
        behind = backward(elements[mid:hi], [0 if s == b else FAR for s in range(4)])
        cross = min(range(4), key=lambda s: (ahead[s][0] + behind[s], ahead[s][1]))
        todo += [(mid, hi, cross, b), (lo, mid, a, cross)]
    return found


def final(vector: list) -> int:
    return min(range(4), key=lambda s: (vector[s][0] + CLOSE[s][0], vector[s][1]))


def edits_of(symbols: bytes, start: int, end: int) -> list[str]:
    """The edits at each row of a block: inserts before it, then its own letter."""
    states = [start, *crossings([STEPS[s] for s in symbols], start, end)]
    return [CHOICE[s][a, b] for s, a, b in zip(symbols, states, states[1:])]


# Most conversations are short and look alike, so both are kept for the commonest ones.
@lru_cache(1 << 14)
def short_edits(symbols: bytes, start: int, end: int) -> list[str]:
    return edits_of(symbols, start, end)


@lru_cache(1 << 14)
def short_vectors(symbols: bytes) -> list:
    return vectors(symbols)


def vectors(symbols: bytes) -> list:
    """The steps of a block as one element: for each state before it the cost and rank of each state after it."""
    found = [forward([STEPS[s] for s in symbols], from_state(p)) for p in range(4)]
    return [(p, t, *found[p][t]) for p in range(4) for t in range(4) if found[p][t][0] < FAR]


def illegal_pairs(symbols: bytes) -> int:
    return sum((a >> 2, b >> 2) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(symbols, symbols[1:]))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows after repeatable damage by crc32(``conv_id:turn``) % 20: 0 drops, 1 empties, 2 removes ``[.!?]``, 3 repeats, 4 makes the role user."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"),
                                (F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.filter("how <> 0").select(
        "conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")).drop("copy")


def number_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, seq (rising over the whole table in order), fault (null where there is none)."""
    space = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    # the last part of the order only spreads equal rows; digests keep long texts out of the sampled range bounds
    made = rows.select("conv_id", "turn", space("role"), space("text")).select("*", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "digest", "tie"]
    ordered = materialize(made.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("seq")))
    first = ordered.groupBy("conv_id", "role", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    left = F.rtrim("text", F.lit(SPACE))
    fault = F.when(left == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.substring(left, -1, 1).isin(*".!?"), "truncated")
    return materialize(ordered.join(first, "seq", "left").select("conv_id", "turn", "role", "text", "seq", fault.alias("fault")))


def symbol(role: Column, fault: Column) -> Column:
    initial = F.substring(role, 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (code * 4 + F.coalesce(F.when(fault == "truncated", 1).when(fault.isNotNull(), 2), F.lit(0))).cast("byte")


def _id_type(rows: DataFrame) -> tuple:
    field = rows.schema["conv_id"]
    return field, pa.string() if isinstance(field.dataType, T.StringType) else pa.int64()


def blocks(numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, seq of the first row, symbols, steps (from, to, cost, rank), number of illegal pairs inside; rows of a block have running seqs."""
    field, kind = _id_type(numbered)
    steps = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at, held, rows = None, 0, bytearray(), []

        def close() -> None:
            if held:
                s = bytes(held)
                v = (short_vectors if len(s) <= 16 else vectors)(s)
                rows.append((conv, at, s, [x for step in v for x in step], illegal_pairs(s)))
                held.clear()

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (kind, pa.int64(), pa.binary(), steps, pa.int64()))],
                                              names=["conv_id", "seq", "symbols", "steps", "illegal"])

        for batch in batches:
            for c, seq, s in zip(*(x.to_pylist() for x in batch.columns)):
                if held and (c != conv or seq != at + len(held) or len(held) == block):
                    close()
                if not held:
                    conv, at = c, seq
                held.append(s)
            yield out()
        close()
        yield out()

    schema = T.StructType([T.StructField("conv_id", field.dataType), *(T.StructField(n, t) for n, t in (
        ("seq", T.LongType()), ("symbols", T.BinaryType()), ("steps", T.ArrayType(T.LongType())), ("illegal", T.LongType())))])
    return numbered.select("conv_id", "seq", symbol(F.col("role"), F.col("fault")).alias("symbol")).repartitionByRange("seq") \
        .sortWithinPartitions("seq").mapInArrow(run, schema)


def chain(made: DataFrame) -> DataFrame:
    """seq, start, end, close of every block; cost and illegal of its conversation at the last block, null at others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, seqs, elements, pairs, edges, rows = (), [], [], 0, [], []

        def close() -> None:
            if not seqs:
                return
            vector = forward(elements, from_state(0))
            end = final(vector)
            states = [0, *crossings(elements, 0, end)]
            joints = sum(illegal_pairs(bytes([a, b])) for (_, a), (b, _) in zip(edges, edges[1:]))
            rows.extend((seq, a, b, "", None, None) for seq, a, b in zip(seqs[:-1], states, states[1:]))
            rows.append((seqs[-1], states[-2], end, CLOSE[end][1], vector[end][0] + CLOSE[end][0], pairs + joints))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 6
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], names=["seq", "start", "end", "close", "cost", "illegal"])

        for batch in batches:
            for c, seq, steps, inside, edge in zip(*(x.to_pylist() for x in batch.columns)):
                if (c,) != conv:
                    close()
                    conv, seqs, elements, pairs, edges = (c,), [], [], 0, []
                seqs.append(seq)
                elements.append([tuple(steps[i:i + 4]) for i in range(0, len(steps), 4)])
                pairs += inside
                edges.append(edge)
            yield out()
        close()
        yield out()

    ends = F.concat(F.substring("symbols", 1, 1), F.substring("symbols", -1, 1)).alias("edge")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "seq", "steps", "illegal", ends).mapInArrow(
        run, "seq long, start int, end int, close string, cost long, illegal long")


def recover(made: DataFrame, chained: DataFrame) -> DataFrame:
    """conv_id, seq, k, edit, initial: the edits in order of (seq, k); initial is the role that an insert or rerole gives."""
    field, kind = _id_type(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, seq, symbols, start, end, closing in zip(*(c.to_pylist() for c in batch.columns)):
                seqs, ks, letters, roles, state = [], [], [], [], start
                words = (short_edits if len(symbols) <= 16 else edits_of)(symbols, start, end)
                for i, (s, word) in enumerate(zip(symbols + b"\0", [*words, closing])):
                    last = i == len(symbols)
                    for k, letter in enumerate(word):
                        state = NEXT[state]["sua-"[s >> 2]] if letter == "K" else state if letter == "D" else 3 if state == 2 else 2
                        seqs.append(seq + i - last)
                        ks.append(k + 10 * last)
                        letters.append(letter)
                        roles.append(ROLES[state] if letter in "IR" else None)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * len(seqs), type=kind), pa.array(seqs, type=pa.int64()), pa.array(ks, type=pa.int32()),
                                                  pa.array(letters, type=pa.string()), pa.array(roles, type=pa.string())], names=["conv_id", "seq", "k", "edit", "new_role"])

    schema = T.StructType([T.StructField("conv_id", field.dataType), *(T.StructField(n, t) for n, t in (
        ("seq", T.LongType()), ("k", T.IntegerType()), ("edit", T.StringType()), ("new_role", T.StringType())))])
    # a byte is a row of work here, so tasks are not merged by their bytes
    tasks = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return made.select("conv_id", "seq", "symbols").join(chained.select("seq", "start", "end", "close"), "seq").select(
        "conv_id", "seq", "symbols", "start", "end", "close").repartition(tasks, "seq").mapInArrow(run, schema)


def repair(numbered: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edits with the rows they leave, and one row of figures per conversation.

    The first holds conv_id, seq, k, edit (K, R, D, I), role and text (null where the row is deleted), in order of (conv_id, seq, k); the second conv_id,
    cost, illegal (neighbouring roles before the repair that are not su, ua, au).
    """
    made = materialize(blocks(numbered, block))
    chained = materialize(chain(made))
    stays, new = F.col("edit").isin("K", "R"), F.col("edit") == "I"
    rows = recover(made, chained).join(numbered.select("seq", "role", "text"), "seq").select(
        "conv_id", "seq", "k", "edit", F.coalesce("new_role", F.when(stays, F.col("role"))).alias("role"), F.when(new, "").when(stays, F.col("text")).alias("text"))
    figures = made.select("conv_id", "seq").join(chained.filter("cost is not null").select("seq", "cost", "illegal"), "seq").drop("seq")
    return rows, figures


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, audit (initials of the edits in order), repaired_sha256 (``role:text`` of the rows that are left, newline-joined).

    A hash needs its input in order, so a conversation streams through one task, row by row; its audit is a value of that length.
    """
    field, kind = _id_type(repaired)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, some, rows = (), [], None, False, []

        def close() -> None:
            if digest:
                rows.append((conv[0], "".join(audit), digest.hexdigest()))

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 3
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (kind, pa.string(), pa.string()))],
                                              names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            for c, edit, role, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (c,) != conv:
                    close()
                    conv, audit, digest, some = (c,), [], hashlib.sha256(), False
                audit.append(edit)
                if edit != "D":
                    digest.update((("\n" if some else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
                    some = True
            yield out()
        close()
        yield out()

    schema = T.StructType([T.StructField("conv_id", field.dataType), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    return repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "k").select("conv_id", "edit", "role", "text").mapInArrow(run, schema)


def summary(originals: DataFrame, numbered: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for every conv_id of ``originals``: gaps, faults, illegal pairs, cost, audit and hash of the repair."""
    repaired, figures = repair(numbered, block)
    count = lambda fault: F.sum((F.col("fault").eqNullSafe(fault)).cast("long"))
    turns = numbered.filter("turn is not null").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id").agg(
        F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), 1 - F.count("turn")).alias("gaps"))
    faults = numbered.groupBy("conv_id").agg(*[count(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    out = originals.select("conv_id").distinct()
    for part in (turns, faults, figures, digests(repaired)):
        part = part.withColumnRenamed("conv_id", "c")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
