"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary logistic classifier per bit is fitted on hashed character
n-grams (1 to 3 code points, lower-cased, square roots of shares, so a long text weighs as much as a short one).
A text goes to the codeword with the smallest sum of logistic losses over the bits (loss-weighted decoding); its score is the
share of that codeword in exp(-loss). It is ``ambiguous`` when the losses of the two nearest codewords lie closer than
``margin``.

The fit uses at most ``sample_rows`` labelled rows, split evenly over the languages (``sampling.bounded_sample``); the bound
makes the matrix sample_rows x 8,192 floats, 2,000 rows by default. It is fitted in one task, so the driver gets the weights alone. Prediction
reads whole texts.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is ambiguous; without any labelled row all
texts are ``und``; with one language every text with a letter gets it with score 1. Other columns are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidepanel.llm.sampling import bounded_sample

BINS = 1 << 13
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def profile(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-grams: a vector of length 1."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    mixed, counts = points, np.zeros(BINS)
    for order in range(1, 4):
        if order > 1:
            if len(points) < order:
                break
            mixed = mixed[:-1] * np.uint32(0x01000193) ^ points[order - 1:]
        slot = (mixed * np.uint32(0x9E3779B1) + np.uint32(order)) >> np.uint32(19)
        counts += np.bincount(slot, minlength=BINS)
    return np.sqrt(counts / max(1.0, counts.sum()))


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """Codewords as rows: all distinct splits for up to 5 classes, else the best of 100 random codes of 10 log2(classes) bits."""
    if classes <= 5:
        bits = max(1, (1 << (classes - 1)) - 1)
        return np.array([[1 if c == 0 else 1 - 2 * (((b + 1) >> (c - 1)) & 1) for b in range(bits)] for c in range(classes)])
    rng, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(100):
        code = rng.choice([-1, 1], size=(classes, int(np.ceil(10 * np.log2(classes)))))
        code = code[:, np.abs(code.sum(0)) < classes]
        apart = (code.shape[1] - code @ code.T) // 2
        nearest = int((apart + 10**6 * np.eye(classes, dtype=int)).min())
        if nearest > widest:
            best, widest = code, nearest
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # bins x bits
    bias: np.ndarray
    margin: float

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        out = []
        for text in texts:
            if text is None or not self.languages or not LETTER.search(text):
                out.append((UNKNOWN, 0.0, True))
                continue
            bits = profile(text) @ self.weights + self.bias
            loss = np.logaddexp(0.0, -self.code * bits).sum(1)
            best = int(loss.argmin())
            rest = np.delete(loss, best)
            share = 1.0 / np.exp(loss[best] - loss).sum()
            out.append((self.languages[best], float(share), bool(len(rest) and rest.min() - loss[best] < self.margin)))
        return out


def fit_bits(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for all bits at once, by accelerated gradient steps. y: rows x bits of +1 and -1."""
    w, b = np.zeros((x.shape[1], y.shape[1]), dtype=np.float32), np.zeros(y.shape[1], dtype=np.float32)
    vw, vb, step = w.copy(), b.copy(), np.float32(8.0)  # a row has length 1, so 2 / (1/4 * 2) = 4 bounds a plain step; halved below
    step /= 4
    for k in range(rounds):
        g = (-y / (1 + np.exp(np.clip(y * (x @ vw + vb), -30, 30)))).astype(np.float32) / len(x)
        nw, nb = vw - step * (x.T @ g + l2 * vw), vb - step * g.sum(0)
        keep = np.float32(k / (k + 3))
        vw, vb, w, b = nw + keep * (nw - w), nb + keep * (nb - b), nw, nb
    return w, b


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_rows: int = 2000, margin: float = 0.5) -> Model:
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")) \
        .filter("text is not null and lang is not null")

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: profile(t).astype("<f2").tobytes())

    def solved(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values(["lang", "x"])  # the fit doesn't depend on the order rows arrive in
        languages = sorted(sample["lang"].unique())
        code = codebook(len(languages))
        x = np.stack([np.frombuffer(v, dtype="<f2") for v in sample["x"]]).astype(np.float32)
        y = code[sample["lang"].map(languages.index).to_numpy()].astype(np.float32)
        weights, bias = fit_bits(x, y) if len(languages) > 1 else (np.zeros((BINS, code.shape[1])), np.zeros(code.shape[1]))
        return pd.DataFrame({"languages": [languages], "weights": [weights.astype("<f4").tobytes()], "bias": [bias.astype("<f8").tobytes()]})

    sample = bounded_sample(rows, "lang", sample_rows, "id", "text").select("lang", packed("text").alias("x"))
    fitted = sample.groupBy().applyInPandas(solved, "languages array<string>, weights binary, bias binary").first()
    if fitted is None or not fitted["languages"]:
        return Model([], np.zeros((0, 1), dtype=int), np.zeros((BINS, 1), dtype=np.float32), np.zeros(1), margin)
    code = codebook(len(fitted["languages"]))
    weights = np.frombuffer(fitted["weights"], dtype="<f4").reshape(BINS, code.shape[1])
    return Model(list(fitted["languages"]), code, weights, np.frombuffer(fitted["bias"], dtype="<f8"), margin)


def identify(model: Model, text: Column) -> Column:
    """Struct of language, score and ambiguous for a text column."""
    @F.pandas_udf("language string, score double, ambiguous boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        found = model.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame(found, columns=["language", "score", "ambiguous"])

    return run(text)
