"""What the corpus operators share: the view of a documents table and vectorised hashing of byte buffers.

Everywhere: a null text counts as empty, other columns of the input are ignored (so clashing names do no harm),
rows that repeat another row are worked on and returned like any row.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes of text that one vectorised step works on; longer single texts are a step of their own.
STEP_BYTES = 512 << 10


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def doc_view(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string without nulls); everything else is pruned from the scan."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, bound: int) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts of the training fold, chosen by a hash of the id.

    The bound limits what the driver holds; a classifier is all that is fitted on it. Rows without label are left out.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & keep)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(bound)
    )
    rows = doc_view(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id * BASE % (1 << 64), r.label, r.text))]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: each input bit reaches each output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls up to a few steps' size."""
    have = _POWERS.get("p")
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        inverse = pow(base, -1, 1 << 64)
        up, down = (np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)]), dtype=U64) for b in (U64(base), U64(inverse)))
        if size > 4 * STEP_BYTES:
            return up, down
        _POWERS["p"], _POWERS["q"] = up, down
    return _POWERS["p"], _POWERS["q"]


def steps(texts: list[bytes]):
    """Runs of texts of about STEP_BYTES together: (first, last) indices."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > STEP_BYTES:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if texts:
        yield first, len(texts)


def in_steps(b: pd.DataFrame):
    """Parts of a batch of about STEP_BYTES of text, by characters."""
    first, size = 0, 0
    for i, t in enumerate(b["text"]):
        size += len(t or "") + 1
        if size > STEP_BYTES:
            yield b.iloc[first : i + 1]
            first, size = i + 1, 0
    if first < len(b):
        yield b.iloc[first:]


class Words:
    """The words of several texts (bytes), found and hashed without a Python loop over words.

    start, end: bounds in ``data``; doc: index of the text; hash: 64 bits of each word's bytes.
    """

    def __init__(self, texts: list[bytes], is_word: np.ndarray, table: bytes | None = None):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined.translate(table) if table else joined, np.uint8)
        inside = np.concatenate([[False], is_word[self.data]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(lengths)])
        self.doc = np.searchsorted(self.offset, self.start, "right") - 1
        up, down = powers(len(self.data) + 1)
        total = np.concatenate([[U64(0)], np.cumsum((self.data.astype(U64) + U64(1)) * up[: len(self.data)], dtype=U64)])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(U64))
        #: bounds of each text's words
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))


def not_bytes(*ranges: tuple[int, int]) -> np.ndarray:
    """256 flags: False in the given ranges (both ends in)."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def give_back() -> None:
    """Hands freed memory back to the system: a worker lives on, and other operators' tasks run beside it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):  # only this C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def nonempty(f):
    """f without the empty frames that it yields: Arrow cannot tell the types of their columns. Memory goes back at the end."""

    def run(batches):
        try:
            yield from (frame for frame in f(batches) if len(frame))
        finally:
            give_back()

    return run
