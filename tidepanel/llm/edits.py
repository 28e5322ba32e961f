"""Edit-aware token counts.

A document keeps its pre-tokens in leaves of a segment tree; every node has the sums of characters and of tokens below it. An edit replaces
the characters [start, end). The tree finds the leaf by characters; the text is split again from a pre-token that ends a few characters
before the edit (the split looks at most ``CONTEXT`` characters past a pre-token) up to the first old boundary behind the edit that is also a new one, from
where on both splits agree, as the split of a text from a boundary depends on what follows only. Only pre-tokens in between are encoded
again, and only the sums above their leaves change. Merges never cross pre-tokens, so the root holds the exact count.

Defined cases: a null text is empty; positions are code points, cut to the text; edits apply one after another, each to the text as the
edits before left it; repeated rows are counted one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from tidepanel.llm import tokens as K

LEAF = 64  # pre-tokens in a leaf
CONTEXT = 4

#: The vocabulary's split pattern, with white space as the property that the library uses.
ANY = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")


def split(text: str) -> list[str]:
    return K.pre_tokens(text) if K.PLAIN.fullmatch(text) else ANY.findall(text)


class Document:
    def __init__(self, text: str, encode: Callable[[str], bytes]):
        self.encode = encode
        self.encoded = 0  # pre-tokens encoded after the first build
        self.build([[(p, len(encode(p)) // K.WIDTH) for p in part] for part in self.parts(split(text))])

    @staticmethod
    def parts(pieces: list) -> list[list]:
        return [pieces[k:k + LEAF] for k in range(0, len(pieces), LEAF)] or [[]]

    def build(self, leaves: list[list[tuple[str, int]]]) -> None:
        self.leaves = leaves
        self.width = 1 << (len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(leaves):
            self.chars[self.width + k], self.tokens[self.width + k] = sum(len(p) for p, _ in leaf), sum(n for _, n in leaf)
        for k in range(self.width - 1, 0, -1):
            self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def set_leaf(self, k: int, leaf: list[tuple[str, int]]) -> None:
        self.leaves[k] = leaf
        node = self.width + k
        self.chars[node], self.tokens[node] = sum(len(p) for p, _ in leaf), sum(n for _, n in leaf)
        while node > 1:
            node >>= 1
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def find(self, position: int) -> tuple[int, int]:
        """Leaf that holds a character (the last leaf for the end) and the characters before the leaf."""
        node, before = 1, 0
        while node < self.width:
            node *= 2
            if position >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.width, len(self.leaves) - 1), before

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p, _ in leaf)

    def edit(self, start: int, end: int, replacement: str | None) -> None:
        start = min(max(start, 0), self.chars[1])
        end = min(max(end, start), self.chars[1])
        replacement = replacement or ""
        first, before = self.find(max(0, start - CONTEXT))
        # old pre-tokens that stay in front, in the first leaf
        head, at = 0, before
        while head < len(self.leaves[first]) and at + len(self.leaves[first][head][0]) + CONTEXT <= start:
            at += len(self.leaves[first][head][0])
            head += 1
        # old pre-tokens from there, leaf by leaf until the new split meets one of their boundaries behind the edit
        old, last, need = list(self.leaves[first][head:]), first, end + CONTEXT
        while True:
            reach = at + sum(len(p) for p, _ in old)
            while last + 1 < len(self.leaves) and reach < need:
                last += 1
                old += self.leaves[last]
                reach += sum(len(p) for p, _ in self.leaves[last])
            joined = "".join(p for p, _ in old)
            ahead = "" if last + 1 == len(self.leaves) else self.following(last)
            new = split(joined[:start - at] + replacement + joined[end - at:] + ahead)
            moved = len(replacement) - (end - start)
            bounds, position = {}, at
            for k, (piece, _) in enumerate(old):
                if position >= end:
                    bounds[position + moved] = k
                position += len(piece)
            position, met = at, None
            for k, piece in enumerate(new):
                if position in bounds and position >= start + len(replacement):
                    met = (k, bounds[position])
                    break
                position += len(piece)
            if met or last + 1 == len(self.leaves):
                break
            need = reach + 1
        fresh, kept = (new, []) if met is None else (new[:met[0]], old[met[1]:])
        self.encoded += len(fresh)
        leaf = self.leaves[first][:head] + [(p, len(self.encode(p)) // K.WIDTH) for p in fresh] + kept
        for k in range(first + 1, last + 1):
            self.set_leaf(k, [])
        self.set_leaf(first, leaf)
        if len(leaf) > 4 * LEAF:  # keep leaves small; nothing is encoded again
            self.build(self.parts([p for part in self.leaves for p in part]))

    def following(self, leaf: int) -> str:
        """A few characters behind a leaf, for the split's look-ahead at the end of it."""
        out = ""
        for k in range(leaf + 1, len(self.leaves)):
            for piece, _ in self.leaves[k]:
                out += piece
                if len(out) >= CONTEXT:
                    return out
        return out


#: What the cleaning edits look for.
MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
DIGITS = re.compile(r"\d(?:[ .-]?\d){6,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a cleaning pass, from the end of the text to its start: repeated lines go, mail addresses and long numbers are masked."""
    out, seen, at = [], set(), 0
    for line in text.split("\n"):
        if line and line in seen:
            out.append((at, min(at + len(line) + 1, len(text)), ""))
        else:
            out += [(at + m.start(), at + m.end(), "[mail]") for m in MAIL.finditer(line)]
            taken = [(s, e) for s, e, _ in out if s >= at]
            out += [(at + m.start(), at + m.end(), "[number]") for m in DIGITS.finditer(line)
                    if all(at + m.end() <= s or at + m.start() >= e for s, e in taken)]
            seen.add(line)
        at += len(line) + 1
    return sorted(out, reverse=True)


def count_edited(docs: DataFrame, propose: Callable[[str], list[tuple[int, int, str]]] | None = None, edits_col: str = "edits", path: str | None = None,
                 id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """The id column, n_edits, tokens_before, tokens_after, n_pretokens, n_reencoded and, if wanted, the edited text.

    Edits come from ``propose`` or from an array column of (start, end, replacement) structs.
    """
    fields = [("n_edits", T.LongType()), ("tokens_before", T.LongType()), ("tokens_after", T.LongType()), ("n_pretokens", T.LongType()),
              ("n_reencoded", T.LongType()), ("text", T.StringType())]
    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t in fields[:5 + with_text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = K.encoder(path).ids
        piece = K.encoder(path).pieces.__getitem__
        assert encode("a") == piece("a")
        for batch in batches:
            rows = []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                edits = propose(text) if propose else [(e["start"], e["end"], e["replacement"]) for e in batch.column(2)[k].as_py() or []]
                doc = Document(text, piece)
                before, pieces = doc.tokens[1], sum(map(len, doc.leaves))
                for start, end, replacement in edits:
                    doc.edit(start, end, replacement)
                rows.append((len(edits), before, doc.tokens[1], pieces, doc.encoded, *([doc.text()] if with_text else [])))
            columns = zip(*rows) if rows else [[]] * (5 + with_text)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, type=pa.string() if k == 5 else pa.int64()) for k, c in enumerate(columns))], names=schema.names)

    return docs.select(F.col(id_col), F.col(text_col), *([] if propose else [F.col(edits_col)])).mapInArrow(run, schema)
