"""Substring dedup by content-defined chunks.

A gear rolling hash runs over a text's bytes; a chunk ends where the hash's top bits are zero, so boundaries move with
the content and an insertion changes only the chunks around it. Chunks have LEAST to MOST bytes. Of the chunks with one
digest the first stays (smallest doc_id, then start); the others are removal spans.

One shuffle deals (digest, doc, start, size) rows; counts and first places are combined before it, so a chunk that a
third of all documents share is a row for each task. Places of repeated chunks meet their digest's first place in a join
that splits hot digests (AQE).

Defined cases: null or empty texts have no chunks; equal chunks within a document count like those of two documents;
rows that repeat a row are copies of one document and keep what it keeps; a null doc_id comes before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import U64, documents, mix, steps, nonempty
from anvilgrid.llm.spans import by_row, cut_spans
from anvilgrid.session import Workspace

#: Bytes of a chunk at least and at most, and hash bits that are zero at a boundary.
LEAST, MOST, ZERO_BITS = 32, 512, 5
GEAR = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The rolling hash at each byte: sum of gear[b] << age over the last 64 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16, 32):
        shifted = np.zeros_like(h)
        shifted[k:] = h[:-k] << U64(k) if k < len(h) else shifted[k:]
        h = h + shifted
    return h


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text."""
    n = len(data)
    cuts = np.flatnonzero(gear_hash(data) >> U64(64 - ZERO_BITS) == 0) + 1
    out, at, i = [], 0, 0
    cut_list = cuts.tolist()
    while at < n:
        while i < len(cut_list) and cut_list[i] < at + LEAST:
            i += 1
        end = min(cut_list[i] if i < len(cut_list) else n, at + MOST, n)
        out.append(end)
        at = end
    return out


def chunk_rows(rows: DataFrame) -> DataFrame:
    """digest (128 bits), key, start, size of each chunk of rows (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode() for t in b["text"]]
            ids = b["key"].tolist()
            for first, last in steps(raw):
                digests, doc, starts, sizes = [], [], [], []
                for k in range(first, last):
                    t, at = raw[k], 0
                    if t:
                        ends = boundaries(np.frombuffer(t, np.uint8))
                        for end in ends:
                            digests.append(hashlib.blake2b(t[at:end], digest_size=16).digest())
                            starts.append(at)
                            sizes.append(end - at)
                            at = end
                        doc += [ids[k]] * len(ends)
                yield pd.DataFrame({"digest": digests, "key": np.array(doc, np.int64), "start": np.array(starts, np.int64), "size": np.array(sizes, np.int32)})

    return rows.select("key", "text").mapInPandas(nonempty(run), "digest binary, key long, start long, size int")


def repeated_chunks(documents: DataFrame, work: Workspace) -> DataFrame:
    """(key, start, end) of chunks that were seen earlier."""
    rows = work.save(chunk_rows(documents), "chunks")
    first = rows.groupBy("digest").agg(F.min(F.struct("key", "start")).alias("first"), F.max(F.struct("key", "start")).alias("last"))
    shared = first.where(F.col("first") != F.col("last")).select("digest", "first")
    place = F.struct(F.col("key"), F.col("start"))
    return rows.join(shared, "digest").where(place > F.col("first")).select("key", "start", (F.col("start") + F.col("size")).alias("end")).distinct()


def dedup_chunks(docs: DataFrame, text: bool = True) -> DataFrame:
    """docs without repeated chunks, as cut_spans returns them."""
    work = Workspace(docs.sparkSession, "chunks")
    rows = by_row(docs, work)
    spans = work.save(repeated_chunks(rows, work), "spans")
    work.drop("chunks")
    return cut_spans(rows, spans, text)


def op6_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_chunks(documents(spark, sf_dir), text=False)
