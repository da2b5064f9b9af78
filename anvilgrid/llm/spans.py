"""Byte spans of documents: merging them and cutting them out of texts. Shared by the two substring dedups."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anvilgrid.llm.common import doc_view, nonempty
from anvilgrid.session import Workspace, ship

#: Stands for a null doc_id while rows are joined.
NO_ID = -(1 << 63)


def keyed(docs: DataFrame) -> DataFrame:
    """doc_view with NO_ID for null ids."""
    return doc_view(docs).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))


def by_row(docs: DataFrame, work: Workspace) -> DataFrame:
    """key, doc_id, text: rows with a number in the order of their ids, without nulls.

    It is the id itself, but where rows share an id (or have none) and differ in text: then a document is a pair of id and
    text, and pairs are numbered in the order of ids, in a written table. Only ids and digests are compared for that.
    """
    rows = keyed(docs)
    pairs = rows.select("doc_id", F.xxhash64("text").alias("h"))
    if pairs.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a != b").limit(1).isEmpty():
        return rows.select(F.col("doc_id").alias("key"), "doc_id", "text")
    numbers = work.save(pairs.distinct().orderBy("doc_id", "h").select("doc_id", "h", F.monotonically_increasing_id().alias("key")), "keys")
    return work.save(rows.withColumn("h", F.xxhash64("text")).join(numbers, ["doc_id", "h"]).select("key", "doc_id", "text"), "by_row")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    first = np.flatnonzero(new)
    return s[first], e[np.concatenate([first[1:] - 1, [len(s) - 1]])]


def cut_spans(rows: DataFrame, spans: DataFrame, text: bool = True) -> DataFrame:
    """by_row() rows without the bytes of spans (key, start, end); the spans of a document are its own size at most.

    doc_id, n_bytes, n_removed, n_spans, kept_sha256, and if ``text`` the removed runs (array<struct<start,end>>) and the
    kept bytes. A span beyond a text's end is clipped. Rows that repeat id and text share their spans.
    """
    ship(rows.sparkSession)
    own = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    joined = rows.join(own, "key", "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, t, starts, ends in zip(b["doc_id"], b["text"], b["starts"], b["ends"], strict=True):
                raw, kept, runs = t.encode(), t.encode(), []
                if starts is not None and len(starts):
                    s, e = merged(np.asarray(starts, np.int64), np.minimum(np.asarray(ends, np.int64), len(raw)))
                    runs = [(x, y) for x, y in zip(s.tolist(), e.tolist(), strict=True) if y > x]
                    at = 0
                    parts = []
                    for x, y in runs:
                        parts.append(raw[at:x])
                        at = y
                    kept = b"".join([*parts, raw[at:]])
                row = [doc_id, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()]
                out.append([*row, [{"start": x, "end": y} for x, y in runs], kept] if text else row)
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["removed", "kept"] if text else [])]).astype({"doc_id": "Int64"})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.mapInPandas(nonempty(run), schema + (", removed array<struct<start:long,end:long>>, kept binary" if text else ""))
