"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader updates.

Features of a text: hashed one- and two-word n-grams of its words, and hashed one-, two- and three-word n-grams of the
words' outlines (kinds of characters, length class, equal to the word before). Each family's counts are divided by the
number of words. The model is fitted on a bounded sample of labelled rows of the training folds (SAMPLE_ROWS, chosen
by a hash of the id); the weights are a fixed-size vector (2**BITS floats) that is sent to executors. A score is a
sparse dot product, computed for all n-grams of whole texts in numpy.

Defined cases: null or empty texts have no n-grams and get the score of the bias alone; without training rows all
weights are zero and every score is 0.5; repeated rows repeat; a null id is not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import U64, Words, doc_view, documents, fold, labelled_sample, mix, not_bytes, steps, nonempty
from anvilgrid.session import ship

BITS = 18
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 4000
EPOCHS = 3
#: FTRL-proximal: learning rate, its smoothing, and the two penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 12.0
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.7

IS_WORD = not_bytes((0, 32))
#: The kind of each byte: lower, upper, digit, beyond ASCII, full stop or comma, bar, exclamation mark, other.
KIND = np.array([1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 4 if 48 <= c <= 57 else 8 if c >= 128 else 16 if c in b".," else 32 if c == 124 else 64 if c == 33 else 0 if c <= 32 else 128 for c in range(256)], np.uint8)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of each n-gram, its text, number of words of each text)."""
    w = Words(texts, IS_WORD)
    n = np.diff(w.bounds)
    if not len(w.start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n
    kinds = np.bitwise_or.reduceat(KIND[w.data], w.start)
    same_doc = np.concatenate([[False], w.doc[1:] == w.doc[:-1]])
    repeated = same_doc & np.concatenate([[False], w.hash[1:] == w.hash[:-1]])
    size = np.minimum(w.end - w.start, 40) // 3
    outline = mix(kinds.astype(U64) + (size.astype(U64) << U64(8)) + (repeated.astype(U64) << U64(16)) + U64(1 << 20))
    found, docs = [], []
    for values, longest in ((w.hash, 2), (outline, 3)):
        gram = values
        fits = np.ones(len(values), bool)
        for k in range(1, longest + 1):
            if k > 1:
                shifted = np.concatenate([values[k - 1 :], np.zeros(min(k - 1, len(values)), U64)])
                gram = mix(gram * U64(0xD6E8FEB86659FD93) + shifted + U64(k))
                fits = np.concatenate([w.doc[k - 1 :] == w.doc[: len(w.doc) - k + 1], np.zeros(min(k - 1, len(w.doc)), bool)])
            found.append((gram[fits] >> U64(64 - BITS)).astype(np.int64))
            docs.append(w.doc[fits])
    return np.concatenate(found), np.concatenate(docs), n


class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates; weights exist only where they overcome L1."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        rate = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - rate * w
        self.n[at] += g * g


def train(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights of all n-grams; the last one is the bias."""
    model, bias, examples = Ftrl((1 << BITS) + 1), 1 << BITS, []
    for text, label in rows:
        at, _, n = features([text.encode()])
        at, count = np.unique(at, return_counts=True)
        examples.append((np.append(at, bias), np.append(count * (SCALE / max(1, n[0])), 1.0), label))
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(examples)):
            model.learn(*examples[i])
    return model.weights(slice(None)).astype(np.float32)


def score(texts: list[bytes], weights: np.ndarray) -> np.ndarray:
    at, doc, n = features(texts)
    total = np.bincount(doc, weights[at], minlength=len(texts)) * (SCALE / np.maximum(n, 1)) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> np.ndarray:
    return train(labelled_sample(docs, labels, "quality", fold(F.col("doc_id"), FOLDS) != HELD_OUT, sample_rows))


def score_quality(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b["text"]]
            parts = [score(raw[i:j], sent.value) for i, j in steps(raw)]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": np.concatenate(parts) if parts else np.zeros(0)})

    return doc_view(docs).mapInPandas(nonempty(run), "doc_id long, score double")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_quality(docs, fit_quality(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
