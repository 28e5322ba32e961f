"""Quality rules with an n-gram language model: plain counts per text, then perplexity bands per language.

The model is modified Kneser-Ney over the characters of the lower-cased texts, one per language: each code point is a symbol of its own, n-grams are
four of them, and no two are ever merged. Spark counts the highest order over whole texts of all documents: an n-gram is the three characters before (21 bits
each, in a long) and the last one. Continuation counts, discounts, probabilities and back-off weights follow from these counts.

Languages of at most ``HELD_GRAMS`` n-grams and ``MOST_POINTS`` characters: the characters of the language are numbered, so an n-gram is one number of 64 bits at most.
Every order is a sorted array of them beside an array of probabilities; a look-up is a binary search, done once per different n-gram of a batch. Models are broadcast in
groups of languages whose arrays keep within ``MODEL_BYTES``; each group scores the texts of its languages.
All other languages: the same orders are tables that Spark groups and joins, and the different n-grams of each text are joined with them. Nothing of such a model is collected.

Bands: perplexities of the texts that pass the base rules are counted per language in steps of 0.1 %; a text is rejected when the log of
its perplexity lies more than ``width`` robust deviations (1.4826 times the median deviation, at least ``least``) above or below the
median of its language.

Defined cases: a null text has no words and fails the base rules; a null language is the language "". Rows with one id are judged
one by one; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from tidepanel.session import materialize

ORDER, BITS = 4, 6
MASK = (1 << BITS * ORDER) - 1
POINT = 21  # bits of a character: its code point and one; 0 starts a text
CHUNK = 1 << 21  # characters counted or scored at once
MODEL_BYTES = 256 << 20
HELD_GRAMS = MODEL_BYTES // (24 * ORDER)  # an n-gram takes 12 bytes an order, and 12 as a context, at most
MOST_POINTS = (1 << 64 // ORDER) - 2  # characters that can be numbered in a quarter of 64 bits, with one number for a text's start and one for strangers
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def alphabet() -> np.ndarray:
    """The 64 groups of a call of ``hashes`` without characters (no model of ``judge`` uses them): 0 starts a text, 1-26 letters, 27 space, 28 line end, 29 digit, 30-37 single marks, 38-41 others of ASCII, 42-63 the rest."""
    points = np.arange(0x110000)
    symbol = (42 + points % 22).astype(np.uint8)
    symbol[:128] = 41
    for marks, value in ((" \t\x0b\x0c\r", 27), ("\n", 28), ("0123456789", 29), (".!?", 38), (",;:", 39), ("'\"()[]{}-", 40)):
        symbol[[ord(c) for c in marks]] = value
    for k, c in enumerate(SYMBOLS):
        symbol[ord(c)] = 30 + k
    for k in range(26):
        symbol[[65 + k, 97 + k]] = 1 + k
    return symbol


_alphabet = None


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashes(text: str, points: np.ndarray | None = None, bits: int = BITS) -> np.ndarray:
    """Number of the four symbols that end at each character. A symbol is the place of a character in the sorted ``points``, from 1; one more for all others."""
    global _alphabet
    found = points_of(text)
    if points is None:
        if _alphabet is None:
            _alphabet = alphabet()
        symbol = _alphabet[found]
    else:
        slot = np.minimum(np.searchsorted(points, found), len(points) - 1)
        symbol = np.where(points[slot] == found, slot, len(points)) + 1
    width = np.uint32 if bits * ORDER <= 32 else np.uint64
    symbol = symbol.astype(width)
    out = symbol.copy()
    for back in range(1, ORDER):
        out[back:] |= symbol[:-back] << width(bits * back)
    return out


def distinct_grams(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different n-grams of texts (code points): the characters before, the last one, and how often each stands."""
    start = np.zeros(ORDER - 1, dtype=np.uint32)
    whole = np.concatenate([part for text in texts for part in (start, text + np.uint32(1))])
    there = np.zeros(0x110001, dtype=bool)
    there[whole] = True
    there[0] = True
    letters = np.flatnonzero(there).astype(np.uint64)
    bits, ends = int(len(letters) - 1).bit_length(), np.flatnonzero(whole)
    if bits * ORDER <= 64:  # numbered among the characters of these texts, so that an n-gram is one number
        number = np.zeros(0x110001, dtype=np.uint64)
        number[letters] = np.arange(len(letters), dtype=np.uint64)
        symbol = number[whole]
        code = symbol[ends]
        for back in range(1, ORDER):
            code |= symbol[ends - back] << np.uint64(bits * back)
        code, times = np.unique(code, return_counts=True)
        parts = [letters[(code >> np.uint64(bits * k)) & np.uint64((1 << bits) - 1)] for k in range(ORDER)]
        return sum(part << np.uint64(POINT * k) for k, part in enumerate(parts[1:])).astype(np.int64), parts[0].astype(np.int32), times
    last = whole[ends].astype(np.int32)
    before = sum(whole[ends - k - 1].astype(np.int64) << POINT * k for k in range(ORDER - 1))
    order = np.lexsort((last, before))
    before, last = before[order], last[order]
    first = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (last[1:] != last[:-1])))
    return before[first], last[first], np.diff(np.append(first, len(last)))


def count_ngrams(texts: DataFrame) -> DataFrame:
    """lang, before, last, n over all rows of (lang, text)."""
    names = ["lang", "before", "last", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}

        def out(lang: str) -> Iterator[pa.RecordBatch]:
            before, last, times = distinct_grams(waiting.pop(lang))
            size[lang] = 0
            for k in range(0, len(last), 1 << 16):
                part = slice(k, k + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(last[part]), pa.string()), pa.array(before[part]), pa.array(last[part]), pa.array(times[part])], names=names)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = points_of(text.as_py())
                waiting.setdefault(lang, []).append(found)
                size[lang] = size.get(lang, 0) + len(found)
                if size[lang] >= CHUNK:
                    yield from out(lang)
        for lang in list(waiting):
            yield from out(lang)

    counted = texts.select("lang", "text").mapInArrow(run, "lang string, before long, last int, n long")
    return counted.groupBy("lang", "before", "last").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per order, from 1: sorted hashes and probabilities; sorted context hashes and back-off weights."""
    grams: list[np.ndarray]
    probability: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    bits: int = BITS
    points: np.ndarray | None = None

    def bytes(self) -> int:
        return sum(a.nbytes for part in (self.grams, self.probability, self.contexts, self.backoff) for a in part)

    def at(self, order: int, wanted: np.ndarray) -> np.ndarray:
        """Probabilities of the last symbols of the hashes, given order - 1 symbols before."""
        if order == 0:
            return np.full(len(wanted), 1.0 / (1 << self.bits))
        wanted = wanted & wanted.dtype.type((1 << self.bits * order) - 1)
        slot = np.minimum(np.searchsorted(self.grams[order - 1], wanted), len(self.grams[order - 1]) - 1)
        out = self.probability[order - 1][slot].astype(np.float64)
        miss = np.flatnonzero(self.grams[order - 1][slot] != wanted)
        if len(miss):
            lower, context = self.at(order - 1, wanted[miss]), wanted[miss] >> wanted.dtype.type(self.bits)
            slot = np.minimum(np.searchsorted(self.contexts[order - 1], context), len(self.contexts[order - 1]) - 1)
            out[miss] = lower * np.where(self.contexts[order - 1][slot] == context, self.backoff[order - 1][slot], 1.0)
        return out

    def log_loss(self, found: np.ndarray) -> np.ndarray:
        different, at = np.unique(found, return_inverse=True)
        return -np.log(self.at(ORDER, different))[at]


def build_model(grams: np.ndarray, counts: np.ndarray, bits: int = BITS, points: np.ndarray | None = None) -> Model:
    """Modified Kneser-Ney from the counts of the highest order: three discounts per order, continuation counts below."""
    order_by, width = np.argsort(grams), np.uint32 if bits * ORDER <= 32 else np.uint64
    levels = [(grams[order_by].astype(width), counts[order_by].astype(np.int64))]
    for order in range(ORDER - 1, 0, -1):
        below, n = np.unique(levels[0][0] & width((1 << bits * order) - 1), return_counts=True)
        levels.insert(0, (below, n))
    model = Model([], [], [], [], bits, points)
    for order, (keys, n) in enumerate(levels, 1):
        of = [int((n == k).sum()) for k in range(1, 5)]
        y = of[0] / max(1, of[0] + 2 * of[1])
        discount = np.array([0.0] + [min(k, max(0.05 * k, k - (k + 1) * y * of[k] / of[k - 1])) if of[k - 1] else 0.5 * k for k in (1, 2, 3)])
        discount = discount[np.minimum(n, 3)]
        contexts, start = np.unique(keys >> width(bits), return_index=True)
        size = np.diff(np.append(start, len(keys)))
        total = np.add.reduceat(n, start).astype(np.float64)
        backoff = np.add.reduceat(discount, start) / total
        lower = model.at(order - 1, keys)
        model.grams.append(keys)
        model.contexts.append(contexts)
        model.backoff.append(backoff.astype(np.float32))
        model.probability.append(((n - discount) / np.repeat(total, size) + np.repeat(backoff, size) * lower).astype(np.float32))
    return model


def model_of(before: np.ndarray, last: np.ndarray, counts: np.ndarray) -> Model:
    """The model of a language from its counted n-grams, its characters numbered."""
    points = np.unique(last)
    bits, slot = int(len(points) + 1).bit_length(), np.append(0, points)
    grams = np.searchsorted(slot, last).astype(np.uint64)
    for k in range(ORDER - 1):
        grams |= np.searchsorted(slot, before >> POINT * k & (1 << POINT) - 1).astype(np.uint64) << np.uint64(bits * (k + 1))
    return build_model(grams, counts, bits, (points - 1).astype(np.uint32))


def fit(counted: DataFrame, langs: list[str]) -> Iterator[dict[str, Model]]:
    """Models of the languages, in groups of at most MODEL_BYTES; each has at most HELD_GRAMS n-grams."""
    group, held = {}, 0
    for lang in langs:
        found = counted.filter(F.col("lang") == lang).select("before", "last", "n").toPandas()
        model = model_of(*(found[c].to_numpy() for c in ("before", "last", "n")))
        if group and held + model.bytes() > MODEL_BYTES:
            yield group
            group, held = {}, 0
        group[lang] = model
        held += model.bytes()
    if group:
        yield group


def probabilities(counted: DataFrame) -> DataFrame:
    """lang, before, last, p of every counted n-gram: the model of ``build_model`` by groups and joins alone."""
    shorter = lambda order: F.col("before").bitwiseAND(F.lit((1 << POINT * (order - 1)) - 1))
    levels = [counted]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, materialize(levels[0].groupBy("lang", shorter(order).alias("before"), "last").agg(F.count("*").alias("n"))))
    lower = levels[0].groupBy("lang").agg((1 / F.pow(F.lit(2.0), F.length(F.bin(F.count("*") + 1)))).alias("lower"))
    at = ["lang"]
    for order, level in enumerate(levels, 1):
        of = level.groupBy("lang").agg(*[F.count(F.when(F.col("n") == k, 1)).cast("double").alias(f"of{k}") for k in range(1, 5)])
        y = F.col("of1") / F.greatest(F.lit(1.0), F.col("of1") + 2 * F.col("of2"))
        of = of.select("lang", *[F.when(F.col(f"of{k}") > 0, F.least(F.lit(float(k)), F.greatest(F.lit(0.05 * k), k - (k + 1) * y * F.col(f"of{k + 1}") / F.col(f"of{k}"))))
                                 .otherwise(0.5 * k).alias(f"d{k}") for k in (1, 2, 3)])
        rows = level.join(F.broadcast(of), "lang").select("lang", "before", "last", "n", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")).alias("d"))
        contexts = rows.groupBy("lang", "before").agg(F.sum("n").alias("total"), F.sum("d").alias("dropped"))
        rows = rows.join(contexts, ["lang", "before"])
        if order > 1:
            rows = rows.withColumn("tail", shorter(order - 1))
            at = ["lang", "tail", "last"]
        p = (F.col("n") - F.col("d") + F.col("dropped") * F.col("lower")) / F.col("total")
        each = materialize(rows.join(lower, at).select("lang", "before", "last", p.alias("p")))
        lower = each.select("lang", F.col("before").alias("tail"), "last", F.col("p").alias("lower"))
    return each


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """Words, code points in words, marks, lines that repeat an earlier one, words in repeated windows of three."""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = text.split("\n")
    repeated_lines = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                repeated_lines += bool(line.strip(SPACES))
            else:
                seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated_words = 0
    if len(set(windows)) < len(windows):
        times: dict[tuple, int] = {}
        for window in windows:
            times[window] = times.get(window, 0) + 1
        reach = 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                repeated_words += at + 3 - max(at, reach)
                reach = at + 3
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), repeated_lines, repeated_words


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


def score(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, lang, the base counts, base_failed and the log of the perplexity (null without a character) of (doc_id, lang, text)."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType())] + [T.StructField(n, T.LongType()) for n in BASE]
                          + [T.StructField("log_perplexity", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs = batch.column(0), batch.column(1).to_pylist()
            counts, loss = [], np.full(len(langs), np.nan)
            waiting: dict[str, list] = {}
            size: dict[str, int] = {}

            def add(lang: str) -> None:
                rows, found = zip(*waiting.pop(lang))
                size[lang] = 0
                each = held.value[lang].log_loss(np.concatenate(found))
                lengths = [len(f) for f in found]
                loss[list(rows)] = np.add.reduceat(each, np.cumsum([0, *lengths[:-1]])) / lengths

            for row, (lang, text) in enumerate(zip(langs, batch.column(2))):
                text = text.as_py() or ""
                counts.append(base_counts(text))
                if text:
                    waiting.setdefault(lang, []).append((row, hashes(text, held.value[lang].points, held.value[lang].bits)))
                    size[lang] = size.get(lang, 0) + len(text)
                    if size[lang] >= CHUNK:
                        add(lang)
            for lang in list(waiting):
                add(lang)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), *(pa.array(c, pa.int64()) for c in (zip(*counts) if counts else [[]] * 5)),
                                              pa.array(loss, from_pandas=True)], names=schema.names)

    return docs.select("doc_id", "lang", "text").mapInArrow(run, schema).withColumn("base_failed", F.expr(FAILED))


def score_by_joins(docs: DataFrame, p: DataFrame) -> DataFrame:
    """``score`` with the probabilities as a table: the different n-grams of each text are joined with it."""
    lists = [T.StructField("before", T.ArrayType(T.LongType())), T.StructField("last", T.ArrayType(T.IntegerType())), T.StructField("times", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("row", T.LongType()), docs.schema["doc_id"], T.StructField("lang", T.StringType()), *[T.StructField(n, T.LongType()) for n in BASE], *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 38
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [text.as_py() or "" for text in part.column(2)]
                grams = [distinct_grams([points_of(text)]) for text in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + len(texts)), pa.int64()), part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in zip(*map(base_counts, texts))),
                     *(pa.array(c, pa.list_(kind)) for c, kind in zip(zip(*grams), (pa.int64(), pa.int32(), pa.int64())))], names=schema.names)
                row += len(texts)

    rows = materialize(docs.select("doc_id", "lang", "text").mapInArrow(run, schema))
    grams = rows.select("row", "lang", F.explode(F.arrays_zip("before", "last", "times")).alias("g")).select("row", "lang", "g.before", "g.last", "g.times")
    loss = grams.join(p, ["lang", "before", "last"]).groupBy("row").agg((-F.sum(F.col("times") * F.log("p")) / F.sum("times")).alias("log_perplexity"))
    return rows.drop("before", "last", "times").join(loss, "row", "left").select("doc_id", "lang", *BASE, "log_perplexity").withColumn("base_failed", F.expr(FAILED))


STEP = 0.001


def middle(counts: list[tuple[int, int]]) -> int:
    """Median of (value, times), the lower one of two."""
    half, seen = (sum(n for _, n in counts) + 1) // 2, 0
    for value, n in sorted(counts):
        seen += n
        if seen >= half:
            return value
    return 0


def bands(scored: DataFrame, width: float, least: float) -> list[tuple[str, float, float]]:
    """Lower and upper bound of the log perplexity per language, from all texts that pass the base rules."""
    found = scored.filter("not base_failed and log_perplexity is not null").groupBy("lang", F.floor(F.col("log_perplexity") / STEP).alias("step")) \
        .agg(F.count("*").alias("n")).collect()  # log perplexities lie below 20: 20,000 steps a language at most
    out = []
    for lang in sorted({r["lang"] for r in found}):
        own = [(r["step"], r["n"]) for r in found if r["lang"] == lang]
        median = middle(own)
        spread = max(least, 1.4826 * STEP * middle([(abs(v - median), n) for v, n in own]))
        out.append((lang, STEP * median - width * spread, STEP * median + width * spread))
    return out


def judge(docs: DataFrame, width: float = 6.0, least: float = 0.02, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang, base counts, base_failed, log_perplexity, kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.col(text_col).alias("text"))
    counted = materialize(count_ngrams(rows.filter("text is not null and text != ''")))
    sizes = counted.groupBy("lang").agg(F.count("*").alias("grams"), F.countDistinct("last").alias("points")).orderBy("lang").collect()
    held = [r["lang"] for r in sizes if r["grams"] <= HELD_GRAMS and r["points"] <= MOST_POINTS]
    written, seen = [], [r["lang"] for r in sizes]
    for models in fit(counted, held):
        own = rows.filter(F.col("lang").isin(list(models)))
        written.append(materialize(score(own, models)))
    large = [lang for lang in seen if lang not in held]
    if large:
        chosen = F.col("lang").isin(large)
        written.append(materialize(score_by_joins(rows.filter(chosen), probabilities(counted.filter(chosen)))))
    written.append(score(rows.filter(~F.col("lang").isin(seen)) if seen else rows, {}))  # languages without any text
    scored = written[0]
    for part in written[1:]:
        scored = scored.unionByName(part)
    inside = F.lit(True)
    for lang, low, high in bands(scored, width, least):
        inside = F.when(F.col("lang") == lang, F.coalesce(F.col("log_perplexity").between(low, high), F.lit(False))).otherwise(inside)
    return scored.withColumn("kept", ~F.col("base_failed") & inside)
