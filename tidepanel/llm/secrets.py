"""Secret scan: fixed patterns, and a battery of randomness tests, with DataFrame functions only.

Base spans come from three patterns (``assign``, ``access``, ``hex``). The battery looks at every other token of 20 or more letters, digits and
base64 marks that has both a letter and a digit. Its encoding is the smallest alphabet that holds it (hex, base32, one-case alphanumeric, alphanumeric,
base64). Under the hypothesis that its characters are drawn from that alphabet at random, three tests give p-values: chi-squared uniformity over as many
equal cells as leave 5 characters in each, runs above and below the middle, and serial correlation of neighbours. The smallest, times three, is
the token's p-value. Tokens that are not random are told apart by the Benjamini-Hochberg rule at ``rate``, within length classes, as longer tokens give stronger
tests; p-values are counted in steps of a hundredth of a power of ten, rounded up, so the rule needs a bounded histogram and no ranks. What is left is
reported as ``random``.

Spans are code points, end exclusive. Defined cases: null and empty texts have no spans; repeated rows are scanned one by one and counted each
time; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidepanel.functions.scalar import norm_cdf
from tidepanel.session import materialize

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters in all; a shorter run has no longer one inside
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
SMALLEST = 30  # p-values below 1e-30 count as 1e-30
CLASSES = (20, 32, 48, 64)  # least lengths of the length classes

#: The alphabets by inferred encoding, in order of trial.
ALPHABETS = (("^[0-9a-f]+$", "0123456789abcdef"), ("^[0-9A-F]+$", "0123456789ABCDEF"), ("^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
             ("^[0-9a-z]+$", string.digits + string.ascii_lowercase), ("^[0-9A-Z]+$", string.digits + string.ascii_uppercase),
             ("^[0-9A-Za-z]+$", string.digits + string.ascii_letters))
BASE64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"


def spans_of(text: Column, pattern: str, present: Column) -> Column:
    """Structs (start, end, found) of all matches, leftmost and without overlap; only texts that pass ``present`` are cut up."""
    gaps = F.split(text, pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("struct(0 as at, cast(array() as array<struct<start:int,end:int,found:string>>) as out)")

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["match"])
        return F.struct(end.alias("at"), F.array_append(state["out"], F.struct(start.alias("start"), end.alias("end"), pair["match"].alias("found"))).alias("out"))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    walked = F.aggregate(pairs, none, step, lambda s: s["out"])
    return F.when(present, walked).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,found:string>>)"))


def kind_spans(text: Column) -> dict[str, Column]:
    assign = F.filter(spans_of(text, ASSIGN, text.rlike(ASSIGN)), lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= 6)
    access = spans_of(text, ACCESS, F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS))
    return {"assign": assign, "access": access, "hex": spans_of(text, HEX, text.rlike(HEX))}


def two_sided(z: Column) -> Column:
    return 2 * (1 - norm_cdf(F.abs(z)))


def p_value(token: Column) -> Column:
    """Three times the smallest p-value of the battery for one token."""
    plain = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    alphabet = F.lit(BASE64)
    for pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(plain.rlike(pattern), F.lit(letters)).otherwise(alphabet)

    def tests(x: Column) -> Column:
        v, k, n = x["v"], x["k"].cast("double"), F.size(x["v"]).cast("double")
        cells = F.least(F.pow(F.lit(2.0), F.floor(F.log2(n / 5))), F.pow(F.lit(2.0), F.floor(F.log2(k))))
        cell = F.transform(v, lambda c: F.floor(c * cells / k))
        expected = n / cells
        chi = F.aggregate(F.sequence(F.lit(0), cells.cast("int") - 1), F.lit(0.0),
                          lambda s, b: s + F.pow(F.size(F.filter(cell, lambda c: c == b)) - expected, 2) / expected)
        df = cells - 1
        uniform = 1 - norm_cdf((F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        high = F.transform(v, lambda c: c * 2 >= k)
        ones = F.size(F.filter(high, lambda h: h)).cast("double")
        zeros = n - ones
        runs = 1 + F.size(F.filter(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: a != b), lambda d: d))
        mean = 2 * ones * zeros / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        by_runs = F.when(spread > 0, two_sided((runs - mean) / F.sqrt(spread))).otherwise(0.0)
        average = F.aggregate(v, F.lit(0.0), lambda s, c: s + c) / n
        square = F.aggregate(v, F.lit(0.0), lambda s, c: s + (c - average) * (c - average))
        lagged = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - average) * (b - average)), F.lit(0.0), lambda s, c: s + c)
        serial = F.when(square > 0, two_sided((lagged / square + 1 / n) * F.sqrt(n))).otherwise(0.0)
        return F.least(F.lit(1.0), 3 * F.least(uniform, by_runs, serial))

    read = F.struct(F.transform(F.split(plain, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")).alias("v"), F.length(alphabet).alias("k"))
    return F.element_at(F.transform(F.array(read), tests), 1)


def length_class(length: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(CLASSES[1:], 1):
        out = F.when(length >= least, F.lit(k)).otherwise(out)
    return out


def scan(docs: DataFrame, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column, assign, access, hex, random: arrays of (start, end)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = kind_spans(text)
    tokens = F.filter(spans_of(text, TOKEN, text.rlike(TOKEN)), lambda s: s["found"].rlike("[0-9]") & s["found"].rlike("[A-Za-z]"))
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = docs.select(F.col(id_col), *[short(c).alias(k) for k, c in base.items()], tokens.alias("tokens"))
    taken = F.concat("assign", "access", "hex")
    free = F.filter("tokens", lambda t: ~F.exists(taken, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    step = lambda t: F.floor(-100 * F.log10(F.greatest(p_value(t["found"]), F.lit(10.0 ** -SMALLEST)))).cast("int")
    scored = materialize(found.select(id_col, *base, F.transform(free, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), length_class(t["end"] - t["start"]).alias("class"), step(t).alias("step"))).alias("tried")))
    # Benjamini-Hochberg per length class: the largest p with p <= rate * (tests with p or less) / tests
    steps = scored.select(F.explode("tried").alias("t")).groupBy("t.class", "t.step").agg(F.count("*").alias("n"))
    rank = F.sum("n").over(Window.partitionBy("class").orderBy(F.desc("step")))
    total = F.sum("n").over(Window.partitionBy("class"))
    least = steps.select("class", "step", (F.pow(F.lit(10.0), -F.col("step") / 100) <= rate * rank / total).alias("below")) \
        .filter("below").groupBy("class").agg(F.min("step").alias("step")).collect()  # a row per class
    of = {r["class"]: r["step"] for r in least}
    result = F.filter("tried", lambda t: ~F.array_contains(F.array([F.lit(-1), *[F.lit(k) for k in of]]), t["class"]) | (t["step"] < bar(t["class"], of)))
    return scored.select(id_col, *base, short(result).alias("random"))


def bar(kind: Column, of: dict[int, int]) -> Column:
    out = F.lit(1 << 30)
    for k, step in of.items():
        out = F.when(kind == k, F.lit(step)).otherwise(out)
    return out


def ordered(kind: str) -> Column:
    """Spans of a kind as structs that sort by start, then kind as listed."""
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                                                       s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(*kinds: str) -> Column:
    """kind:start:end by start, then kind as listed, with commas between."""
    every = F.array_sort(F.concat(*[ordered(k) for k in kinds]))
    return F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
