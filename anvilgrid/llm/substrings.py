"""Exact removal of repeated 100-byte strings by bucket-pointer refinement of suffixes.

1. Buckets. Of each window of MATCH bytes the q-gram (Q bytes) with the least hash stands for it, so equal windows stand in
   the same bucket. Neighbouring windows of one bucket form a run; a run is dealt as (bucket, digest of its bytes, place).
   Buckets with one place need no more work, unless a run has its q-gram at several places (inner), so that it may repeat itself.
2. Equal runs. Of the runs with equal bytes only the first can be new; the others are repeated as a whole. Counting and
   taking the first is combined before the shuffle, so groups of thousands of copies are a row for each task.
3. Refinement. The first runs of buckets with several contents are sorted: suffixes begin in buckets by their first
   eight bytes, and each round sorts on the pair of a suffix's bucket and the bucket of the suffix as many bytes further
   on, so that the bucket identifiers found in one round are the keys of the next (8, 16, 32, 64, 100 bytes). Windows left
   in one bucket are equal; all but the first place are repeated. A bucket with more contents than one task sorts
   (TASK_RUNS) is refined by the same rule over all tasks: a window's buckets at the offsets 0, 32, 64 and 68, which cover it,
   are dealt as its key, and the first place of each key is found with counts combined before the shuffle. Which of the two
   ways a bucket takes changes no result.

Texts are read again where bytes are needed; they are never dealt out whole for sorting. The result is exact up to
collisions of 64-bit digests of different strings within one bucket in step 2, and of all four bucket names of a window.

Defined cases: texts under MATCH bytes lose nothing; null = empty; matches do not cross documents; rows that repeat a
doc_id with the same text are one document, with other texts they are others, in the order of the texts' digests; a null
doc_id comes before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import BASE, U64, documents, mix, powers, steps, nonempty
from anvilgrid.llm.spans import by_row, cut_spans
from anvilgrid.session import Workspace

MATCH, Q = 100, 32
#: Windows of a run at most (longer ones are cut), and contents of a bucket that one task sorts.
RUN_WINDOWS, TASK_RUNS = 512, 4000
#: Bytes that one refinement works on.
TASK_BYTES = 4 << 20


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of byte * BASE**i (n + 1 of them), and BASE**-i."""
    up, down = powers(len(data) + 1)
    return np.concatenate([[U64(0)], np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], dtype=U64)]), down


def slide(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """f over each window of so many values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = f(x[:-have], x[have:])
        have *= 2
    return f(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(bucket, digest, text, start, windows, inner) of each run of the texts; inner: it may hold equal windows."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offset = np.concatenate([[0], np.cumsum(lengths)])
    data = np.frombuffer(b"".join(texts), np.uint8)
    n = len(data) - MATCH + 1
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    total, down = prefix_hash(data)
    h = mix((total[Q:] - total[:-Q]) * down[: len(data) - Q + 1])
    width = MATCH - Q + 1  # q-grams of a window
    least = slide(np.minimum, h, width)
    # q-grams that are the least of some window, and of these the ones whose like is at most a window before
    most = slide(np.maximum, np.concatenate([np.zeros(width - 1, U64), least, np.zeros(width - 1, U64)]), width)
    chosen = np.flatnonzero(most == h)
    order = np.argsort(h[chosen], kind="stable")
    like = (h[chosen[order]][1:] == h[chosen[order]][:-1]) & (np.diff(chosen[order]) <= width)
    again = np.zeros(len(h) + 1, np.int64)
    again[chosen[order][1:][like] + 1] = 1
    again = np.cumsum(again)
    text = np.repeat(np.arange(len(texts)), lengths)[:n]
    whole = np.arange(n) + MATCH <= offset[text + 1]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]) & whole
    new |= whole & ~np.concatenate([[False], whole[:-1]])
    begin = np.flatnonzero(new)
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    ends = np.concatenate([begin[1:], [n]])
    # the last run of a text ends where whole windows do
    last = offset[text[begin] + 1] - MATCH + 1
    ends = np.minimum(ends, last)
    count = ends - begin
    if count.max() > RUN_WINDOWS:
        pieces = -(-count // RUN_WINDOWS)
        piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, count = np.repeat(begin, pieces) + piece * RUN_WINDOWS, np.minimum(RUN_WINDOWS, np.repeat(count, pieces) - piece * RUN_WINDOWS)
    size = count + MATCH - 1
    digest = mix((total[begin + size] - total[begin]) * down[begin] + size.astype(U64))
    own = text[begin]
    inner = again[begin + size - Q + 1] > again[begin + 1]
    return least[begin].astype(np.int64), digest.astype(np.int64), own, begin - offset[own], count, inner


def run_rows(rows: DataFrame) -> DataFrame:
    """bucket, digest, key, start, n (windows), inner of every run of rows (key, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw, ids = [t.encode() for t in b["text"]], b["key"].to_numpy(np.int64)
            for first, last in steps(raw):
                bucket, digest, text, start, n, inner = runs_of(raw[first:last])
                yield pd.DataFrame({"bucket": bucket, "digest": digest, "key": ids[first:last][text], "start": start, "n": n.astype(np.int32), "inner": inner.astype(bool)})

    return rows.select("key", "text").mapInPandas(nonempty(run), "bucket long, digest long, key long, start long, n int, inner boolean")


def window_buckets(piece: bytes) -> np.ndarray:
    """For each window of a piece the names of its buckets at the offsets 0, Q, 2Q and the last, which cover it."""
    total, down = prefix_hash(np.frombuffer(piece, np.uint8))
    name = mix((total[Q:] - total[:-Q]) * down[: len(piece) - Q + 1]).astype(np.int64)
    n = len(piece) - MATCH + 1
    return np.stack([name[at : at + n] for at in (0, Q, 2 * Q, MATCH - Q)])


def refine(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket-pointer refinement of the windows of parts.

    (bucket, part, offset) of each window of MATCH bytes, sorted by bucket; equal windows, and only they, share a bucket.
    """
    data = np.frombuffer(b"".join(parts) + b"\0" * 8, np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    n = int(sizes.sum())
    # the first buckets: eight bytes as a number; strings that run over a part's end stay out of the windows below
    value = np.zeros(n, U64)
    for i in range(8):
        value = (value << U64(8)) | data[i : n + i].astype(U64)
    bucket, have = np.unique(value, return_inverse=True)[1].astype(np.int64), 8
    while have < MATCH:
        step = min(have, MATCH - have)
        further = np.zeros(n, np.int64)
        further[: n - step] = bucket[step:]
        key = bucket * (n + 1) + further
        bucket, have = np.unique(key, return_inverse=True)[1].astype(np.int64), have + step
    windows = np.maximum(sizes - MATCH + 1, 0)
    part = np.repeat(np.arange(len(parts)), windows)
    offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    own = bucket[start[part] + offset]
    order = np.argsort(own, kind="stable")
    return own[order], part[order], offset[order]


def repeated_windows(parts: list[bytes], doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of windows that are not the first of their bucket by (doc, start)."""
    bucket, part, offset = refine(parts)
    d, s = doc[part], place[part] + offset
    order = np.lexsort((s, d, bucket))
    bucket, d, s = bucket[order], d[order], s[order]
    same = np.concatenate([[False], bucket[1:] == bucket[:-1]])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(bucket))))
    later = same & ((d != d[first]) | (s != s[first]))
    return d[later], s[later]


def as_spans(doc: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """Windows as merged spans of each document, all documents at once."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + MATCH)]) if len(doc) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(doc)]])[: len(first)] - 1
    return pd.DataFrame({"key": doc[first].astype(np.int64), "start": start[first].astype(np.int64), "end": (start[last] + MATCH).astype(np.int64)})


SPAN = "key long, start long, end long"


def repeated_spans(rows: DataFrame, work: Workspace, task_runs: int = TASK_RUNS) -> DataFrame:
    """(key, start, end) of bytes that a repeated window covers; spans may overlap."""
    spark = rows.sparkSession
    # buckets with at least two runs; a count and a digest range for each task and bucket is all that is dealt
    shared = work.save(
        run_rows(rows).select("bucket", "inner", F.xxhash64("key", "start").alias("place")).groupBy("bucket")
        .agg(F.min("place").alias("a"), F.max("place").alias("b"), F.max("inner").alias("inner")).where("a != b or inner").select("bucket"),
        "shared",
    )
    runs = work.save(run_rows(rows).join(shared, "bucket"), "runs")
    place = F.struct("key", "start", "n")
    contents = work.save(runs.groupBy("bucket", "digest").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.max("inner").alias("inner")), "contents")
    # runs whose bytes were seen earlier
    several = contents.where("first != last").select("bucket", "digest", "first")
    whole = runs.join(several, ["bucket", "digest"]).where(place != F.col("first")).select("key", "start", (F.col("start") + F.col("n") + (MATCH - 1)).cast("long").alias("end"))
    work.save(whole, "whole")
    # first runs of buckets with several contents
    counts = contents.groupBy("bucket").agg(F.count(F.lit(1)).alias("contents"), F.max("inner").alias("inner")).where("contents > 1 or inner").drop("inner")
    todo = work.save(contents.join(counts, "bucket").select("bucket", "contents", "first.*"), "todo")
    asked = lambda some: rows.join(todo.where(some).groupBy("key").agg(F.collect_list(F.struct("bucket", "start", "n")).alias("runs")), "key").select("key", "text", "runs")

    def pieces_of(b: pd.DataFrame) -> Iterator[tuple[int, int, int, bytes]]:
        for key, text, some in zip(b["key"], b["text"], b["runs"], strict=True):
            raw = text.encode()
            for r in some:
                yield r["bucket"], key, r["start"], raw[r["start"] : r["start"] + r["n"] + MATCH - 1]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(pieces_of(b), columns=["bucket", "key", "start", "bytes"])

    def cut_hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            held = [(bucket, key, start, window_buckets(piece)) for bucket, key, start, piece in pieces_of(b)]
            if held:
                n = [names.shape[1] for *_, names in held]
                of = lambda i: np.repeat(np.array([h[i] for h in held], np.int64), n)  # noqa: B023, E731
                place = np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
                yield pd.DataFrame({"bucket": of(0), **dict(zip(("b0", "b1", "b2", "b3"), np.concatenate([h[3] for h in held], 1), strict=True)), "key": of(1), "start": of(2) + place})

    pieces = asked(F.col("contents") <= task_runs).mapInPandas(nonempty(cut), "bucket long, key long, start long, bytes binary")
    work.save(pieces, "pieces")
    pieces = work.load("pieces", pieces.schema)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, last = 0, None

        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            p = pd.concat(parts)
            return as_spans(*repeated_windows(p["bytes"].tolist(), p["key"].to_numpy(np.int64), p["start"].to_numpy(np.int64)))

        for b in batches:  # in order of buckets: what is held back is the bucket that may go on
            bucket = b["bucket"].to_numpy()
            before = np.concatenate([[0], np.cumsum(b["bytes"].map(len).to_numpy(np.int64))])
            edges = np.flatnonzero(np.concatenate([[bucket[0] != last], bucket[1:] != bucket[:-1]])) if len(b) else np.zeros(0, np.int64)
            at = gone = 0
            for edge, upto in zip(edges.tolist(), before[edges].tolist(), strict=True):
                if size + upto - gone >= TASK_BYTES:
                    yield done([*held, b.iloc[at:edge]])
                    held, size, at, gone = [], 0, edge, upto
            if at < len(b):
                held.append(b.iloc[at:])
                size += int(before[-1]) - gone
                last = bucket[-1]
        if held:
            yield done(held)

    cold = pieces.repartition(spark_partitions(spark), "bucket").sortWithinPartitions("bucket").mapInPandas(nonempty(sort), SPAN)
    names, at = ["bucket", "b0", "b1", "b2", "b3"], F.struct("key", "start")
    windows = work.save(asked(F.col("contents") > task_runs).mapInPandas(nonempty(cut_hot), ", ".join(f"{n} long" for n in [*names, "key", "start"])), "windows")
    firsts = windows.groupBy(*names).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first != last").select(*names, "first")
    hot = windows.join(firsts, names).where(at != F.col("first")).select("key", "start", (F.col("start") + MATCH).cast("long").alias("end"))
    edge = work.save(cold.unionByName(hot), "edge")
    whole = work.load("whole", edge.schema)
    for name in ("shared", "runs", "contents", "todo", "pieces", "windows"):
        work.drop(name)
    return whole.unionByName(edge)


def spark_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def dedup_substrings(docs: DataFrame, text: bool = True, task_runs: int = TASK_RUNS) -> DataFrame:
    """docs without repeated strings, as cut_spans returns them."""
    work = Workspace(docs.sparkSession, "substrings")
    rows = by_row(docs, work)
    return cut_spans(rows, repeated_spans(rows, work, task_runs), text)


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(documents(spark, sf_dir), text=False)


assert BASE % 2  # powers have inverses modulo 2**64
