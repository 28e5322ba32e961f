"""Conversation structure repair against its SQL, a search over whole edit strings, and awkward rows."""

import random

import pytest

from tests.compare import compare, connect
from tidepanel.llm import convrepair as cr
from tidepanel.llm.queries import OP12_SQL, table
from tidepanel.llm.registry import ship


def by_force(symbols):
    """(cost, edits) of the cheapest repair by keeping the least edit string of every state, row by row."""
    best = {0: (0, "")}
    for s in symbols:
        now = {}
        for p, (cost, word) in best.items():
            for q, more, letters in cr.insertions(p):
                moves = [(q, 3, "D")]
                if not s & 2:
                    initial = "sua-"[s >> 2]
                    if (q, initial) in {(0, "s"), (0, "u"), (1, "u"), (3, "u"), (2, "a")}:
                        moves.append(({"s": 1, "u": 2, "a": 3}[initial], s & 1, "K"))
                    moves.append((3 if q == 2 else 2, 2 + (s & 1), "R"))
                for t, price, letter in moves:
                    now[t] = min(now.get(t, (1 << 40, "")), (cost + more + price, word + letters + letter))
        best = now
    return min((cost + 2 * len(tail), word + tail) for s, (cost, word) in best.items() for tail in ({0: [""], 1: ["II"], 2: ["I"], 3: [""]}[s]))


def test_divide_and_conquer_by_force():
    rng = random.Random(5)
    for n in [*range(1, 9)] * 40 + [60, 61, 64, 200]:
        symbols = bytes(rng.choice([0, 1, 2, 4, 4, 5, 6, 8, 8, 9, 10, 12, 13]) for _ in range(n))
        cost, word = by_force(symbols)
        end = cr.final(cr.forward([cr.STEPS[s] for s in symbols], cr.from_state(0)))
        assert "".join(cr.edits_of(symbols, 0, end)) + cr.CLOSE[end][1] == word
        # the same through blocks of three rows
        parts = [symbols[i:i + 3] for i in range(0, n, 3)]
        elements = [cr.vectors(p) for p in parts]
        vector = cr.forward(elements, cr.from_state(0))
        last = cr.final(vector)
        states = [0, *cr.crossings(elements, 0, last)]
        assert (vector[last][0] + cr.CLOSE[last][0], last) == (cost, end)
        assert "".join(e for p, a, b in zip(parts, states, states[1:]) for e in cr.edits_of(p, a, b)) + cr.CLOSE[last][1] == word


@pytest.fixture(scope="module")
def messy(spark, tmp_path_factory):
    """Ties, repeated rows, holes, odd roles, one conversation of 700 rows."""
    ship(spark)
    rng = random.Random(9)
    texts = ["", " \n", "yes.", "yes.", "no", "why?", "é 日本!", "x" * 50_000, "tail. \t"]
    rows = [(rng.choice([*range(30), *[-1] * 20]), rng.choice([0, 1, 2, 3, 5, 8, 9_000_000_000]) if rng.random() < 0.3 else k,
             rng.choice(["user", "assistant", "system", "tool", "", "ustest"]), rng.choice(texts)) for k in range(1400)]
    folder = str(tmp_path_factory.mktemp("messy"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(3).write.parquet(f"{folder}/conversations.parquet")
    return folder


def test_messy_rows_match_sql(spark, messy):
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{messy}/conversations.parquet/*.parquet'")
    given = table(spark, messy, "conversations")
    numbered = cr.number_rows(cr.damage(given))
    assert compare(cr.summary(given, numbered, block=7), con, OP12_SQL) == []


def test_repaired_rows(spark):
    ship(spark)
    rows = [(1, 0, "assistant", "hello."), (1, 1, "user", "what"), (1, 1, "user", "what"), (1, 2, "tool", "that."), (2, None, None, None), (2, 3, "user", "ok?"),
            (None, 0, "system", "be kind."), (None, 1, "user", "hi."), (3, 0, "user", ""), (4, -9223372036854775808, "user", "a."), (4, 9223372036854775807, "assistant", "b.")]
    given = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, edit string")
    numbered = cr.number_rows(given)
    assert {(r.conv_id, r.role, r.text): r.fault for r in numbered.filter("fault is not null").collect()}.keys() == {
        (1, "user", "what"), (2, " ", " "), (3, "user", "")}
    made, figures = cr.repair(numbered)
    left = {}
    for r in sorted(made.collect(), key=lambda r: (r.conv_id or -1, r.seq, r.k)):
        left.setdefault(r.conv_id, []).append((r.edit, r.role, r.text))
    assert "".join(e for e, *_ in left[1]) == by_force(bytes([8, 5, 6, 12]))[1]
    assert [e for e, *_ in left[2]] == ["D", "K", "I"] and left[2][1:] == [("K", "user", "ok?"), ("I", "assistant", "")]
    assert left[None] == [("K", "system", "be kind."), ("K", "user", "hi."), ("I", "assistant", "")]
    assert left[3] == [("D", None, None)]
    got = {r.conv_id: r for r in cr.summary(given.select("conv_id"), numbered).collect()}
    assert (got[2].blank, got[2].cost, got[2].audit, got[4].gaps) == (1, 5, "DKI", 0)
    assert got[1].audit == by_force(bytes([8, 5, 6, 12]))[1] and got[1].cost == by_force(bytes([8, 5, 6, 12]))[0]
    assert figures.count() == 5


def test_empty(spark):
    ship(spark)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cr.summary(none, cr.number_rows(cr.damage(none))).count() == 0
