"""Quality classifier: support vectors on naive Bayes features.

A text is the set of its hashed character n-grams (1 to 4 code points) and of the word bigrams "same word twice", one for each
tenth of the words that they reach. Over all labelled rows Spark counts in how many
texts of each class an n-gram occurs; the smoothed log ratio of the two class shares scales the indicator. A linear hinge-loss model
is fitted to these scaled, unit-length vectors by dual coordinate descent, on at most ``sample_rows`` labelled rows, split evenly over the
classes; a fifth of them sets the sigmoid that turns margins into scores. Counts cover all labelled rows, prediction all rows
and whole texts.

Defined cases: null and empty texts have no n-grams and score the sigmoid of the bias; an id with two different labels is not
learned from; with labels of one class only (or none) every score is the smoothed share of label 1, (n1 + 1) / (n + 2). Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.sampling import bounded_sample

BITS = 17
BINS = 1 << BITS
BROADCAST_LABELS = 2_000_000  # labelled ids, 16 bytes each: below it they are broadcast, above it joined by a shuffle


def grams(text: str | None) -> np.ndarray:
    """Sorted hashes of the n-grams that occur."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    seen, mixed = np.zeros(BINS, dtype=bool), points
    for order in range(1, 5):
        if len(points) < order:
            break
        if order > 1:
            mixed = mixed[:-1] * np.uint32(0x01000193) ^ points[order - 1:]
        seen[(mixed * np.uint32(0x9E3779B1) + np.uint32(order * 0x5BD1)) >> np.uint32(32 - BITS)] = True
    words = (text or "").split()
    doubled = sum(map(str.__eq__, words, words[1:]))
    if doubled:
        seen[BINS - 16:BINS - 16 + 1 + 10 * doubled // len(words)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def count_grams(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Texts of label 1 and of label 0 in which each n-gram occurs. rows: text, label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[label, grams(text.as_py())] += 1
        at = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[1, at]), pa.array(counts[0, at])], names=["gram", "good", "bad"])

    found = rows.select("text", "label").mapInArrow(run, "gram long, good long, bad long") \
        .groupBy("gram").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toPandas()  # BINS rows at most
    good, bad = np.zeros(BINS), np.zeros(BINS)
    good[found["gram"]], bad[found["gram"]] = found["good"], found["bad"]
    return good, bad


def log_ratio(good: np.ndarray, bad: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    p, q = good + smooth, bad + smooth
    return np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)


def scaled(found: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    values = ratio[found]
    return values / max(1e-6, float(np.sqrt((values * values).sum())))


def fit_hinge(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20, seed: int = 1) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the bias is one more feature of value 1."""
    w, bias, alpha = np.zeros(len(ratio), dtype=np.float32), 0.0, np.zeros(len(rows))
    values = [scaled(r, ratio) for r in rows]
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (float(w[rows[i]] @ values[i]) + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            change = (new - alpha[i]) * y[i]
            if change:
                w[rows[i]] += np.float32(change) * values[i]
                bias += change
                moved = max(moved, abs(change))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def fit_sigmoid(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the sigmoid by Newton steps, slope kept positive."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - label), weight * p * (1 - p) + 1e-9
        ga, gb = (g * margin).sum() + 1e-3 * a, g.sum() + 1e-3 * b
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-3
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = max(1e-3, a - da), b - db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(a), float(b)


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found] @ scaled(found, self.ratio)) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(grams(text)) + self.offset, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample_rows: int = 4000, cost: float = 1.0) -> Model:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")) \
        .filter("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("most")) \
        .filter("label = most").select("id", "label")
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")
    good, bad = count_grams(rows)

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: grams(t).astype("<u4").tobytes())

    per_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = per_label.get(1, 0), per_label.get(0, 0)
    ratio = log_ratio(good, bad)
    if not n1 or not n0:
        share = (n1 + 1) / (n1 + n0 + 2)
        return Model(np.zeros(BINS, np.float32), np.zeros(BINS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    sample = bounded_sample(rows, "label", sample_rows, "id", "text").select("label", packed("text").alias("x")).toPandas() \
        .sort_values(["label", "x"]).reset_index(drop=True)
    found = [np.frombuffer(v, dtype="<u4") for v in sample["x"]]
    label = sample["label"].to_numpy()
    weight = np.where(label == 1, n1 / max(1, (label == 1).sum()), n0 / max(1, (label == 0).sum()))
    aside = np.arange(len(found)) % 5 == 4
    if min((label[aside] == 1).sum(), (label[aside] == 0).sum()) < 2 or min((label[~aside] == 1).sum(), (label[~aside] == 0).sum()) < 2:
        learn, tune = np.arange(len(found)), np.arange(len(found))
    else:
        learn, tune = np.flatnonzero(~aside), np.flatnonzero(aside)
    w, bias = fit_hinge([found[i] for i in learn], ratio, 2.0 * label[learn] - 1, np.full(len(learn), cost))
    model = Model(ratio, w, bias, 1.0, 0.0)
    model.slope, model.offset = fit_sigmoid(np.array([model.margin(found[i]) for i in tune]), label[tune], weight[tune] / weight[tune].mean())
    return model


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t if isinstance(t, str) else None) for t in texts], dtype=float)

    return run(text)
