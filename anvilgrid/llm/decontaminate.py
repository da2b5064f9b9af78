"""Benchmark decontamination with an FM-index of each training shard.

A shard is what one step of a task holds. Its words become symbols of the benchmark's vocabulary. A word, or a pair
of neighbours, that no benchmark item has cannot lie in a match, so the index keeps only the runs in between that are
long enough to hold a window; nothing that could match is left out. Over these runs a suffix array, a Burrows-Wheeler
transform and its wavelet matrix are built. All windows of the benchmark are searched backwards at once, their
occurrences are located by walking to sampled suffix positions, and the covered words are merged into spans.

The benchmark is worked on in blocks of bounded size (BLOCK_WORDS), one at a time on the driver and in workers. A benchmark
of one block is searched in place, without a shuffle. Beyond it rows are numbered in a written table, each block is a pass
that writes the rows it hits, and these meet their rows by number.

Defined cases: null or empty text has no words, no hits, and is clean; an item without words matches nothing; equal
windows of several items count for each of them; an empty benchmark or documents table gives no hits or no rows; a
null item id is not listed, but its windows count; rows that repeat an id, or have none, are judged each by its own text,
whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import LOWER, doc_view, documents, steps, nonempty
from anvilgrid.session import Workspace, ship

WINDOW = 13
#: Words of benchmark items that one pass searches for: bounds what is sent to executors.
BLOCK_WORDS = 1_000_000
#: One suffix position in so many is kept for locating.
SAMPLE = 8
#: Lower-cases A-Z and turns what is no letter, digit or non-ASCII byte into a space.
WORDS = bytes(LOWER[c] if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    return [w for w in text.translate(WORDS).split(b" ") if w]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """By prefix doubling: ranks of pairs of ranks until all differ."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 1) + second + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        k *= 2


class WaveletMatrix:
    """rank and access of a sequence of small numbers, vectorised over queries."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels, s = [], s.astype(np.int64)
        for b in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            zeros = len(s) - ones[-1]
            self.levels.append((b, bit, ones, zeros))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c is among the first i."""
        low, high = np.zeros_like(i), i.copy()
        for b, _, ones, zeros in self.levels:
            up = ((c >> b) & 1).astype(bool)
            low, high = (np.where(up, zeros + ones[x], x - ones[x]) for x in (low, high))
        return high - low

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers at i, and how often each is before i."""
        c, low, high = np.zeros_like(i), np.zeros_like(i), i.copy()
        for b, bit, ones, zeros in self.levels:
            up = bit[high].astype(bool)
            c += up.astype(np.int64) << b
            low, high = (np.where(up, zeros + ones[x], x - ones[x]) for x in (low, high))
        return c, high - low


class FMIndex:
    """Over symbols 1..sigma-1 and 0 between runs; inside, all are one higher, as 0 ends the whole and is unique."""

    def __init__(self, s: np.ndarray, sigma: int):
        s, sigma = np.concatenate([s + 1, [0]]).astype(np.int64), sigma + 1
        sa = suffix_array(s)
        self.bwt = WaveletMatrix(s[sa - 1], sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=sigma))])
        self.n = len(s)
        self.sampled = sa % SAMPLE == 0
        self.sampled_at = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of symbols the interval of suffixes that begin with it."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j] + 1
            low[live], high[live] = (self.before[c] + self.bwt.rank(c, x[live]) for x in (low, high))
            live = live[low[live] < high[live]]
        high[low >= high] = low[low >= high]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of suffixes by rows."""
        rows, out, walked = rows.copy(), np.zeros(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            done = self.sampled[rows[live]]
            out[live[done]] = self.samples[self.sampled_at[rows[live[done]]]] + walked
            live = live[~done]
            c, before = self.bwt.access(rows[live])
            rows[live] = self.before[c] + before
            walked += 1
        return out


class Phrases:
    """The windows of benchmark items as symbols, in tables by length; for each window the items that have it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.symbol: dict[bytes, int] = {}
        parts = [np.fromiter((self.symbol.setdefault(w, len(self.symbol) + 1) for w in split_words((text or "").encode())), np.int32) for _, text in items]
        self.names = [None if item is None else str(item) for item, _ in items]
        self.sigma = len(self.symbol) + 1
        size = np.array([len(p) for p in parts], np.int64)
        every = np.concatenate([np.zeros(0, np.int32), *parts])
        start = np.cumsum(size) - size
        self.by_length, self.items, pairs = {}, {}, [np.zeros(0, np.int64)]
        for n in sorted(set(np.minimum(size[size > 0], window).tolist())):
            those = np.flatnonzero((size == n) | ((size > n) if n == window else False))
            count = size[those] - n + 1
            owner = np.repeat(those, count)
            at = np.repeat(start[those], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            rows = np.ascontiguousarray(every[at[:, None] + np.arange(n)])
            _, first, which = np.unique(rows.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
            # (window, item), each once, by window
            both = np.unique(which.astype(np.int64) * len(items) + owner)
            self.by_length[n] = rows[first].astype(np.int64)
            self.items[n] = (np.searchsorted(both, np.arange(len(first) + 1) * len(items)), (both % max(1, len(items))).astype(np.int32))
            if n > 1:
                pairs.append(np.unique(self.by_length[n][:, :-1] * self.sigma + self.by_length[n][:, 1:]))
        self.pairs = np.unique(np.concatenate(pairs))
        self.shortest = min(self.by_length, default=window)

    def items_of(self, n: int, window: int) -> set[str]:
        bounds, owners = self.items[n]
        return {name for i in owners[bounds[window] : bounds[window + 1]].tolist() if (name := self.names[i]) is not None}

    def runs(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the maximal runs whose words and pairs of neighbours all are of the benchmark."""
        known = s > 0
        key = s[:-1] * self.sigma + s[1:]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined &= self.pairs[at] == key
        else:
            joined[:] = False
        first = known & ~np.concatenate([[False], joined])
        last = known & ~np.concatenate([joined, [False]])
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = b - a >= self.shortest
        return a[long], b[long]

    def hits(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[set[str]]]:
        """Per text: number of words, merged spans of hit words, items with occurring windows."""
        get, counts, parts, where, docs = self.symbol.get, [], [], [], []
        for k, t in enumerate(texts):
            ws = split_words(t)
            counts.append(len(ws))
            if len(ws) < self.shortest or not self.by_length:
                continue
            s = np.fromiter([get(w, 0) for w in ws], np.int64, len(ws))
            for a, b in zip(*self.runs(s), strict=True):
                parts += [s[a:b], np.zeros(1, np.int64)]
                where.append(a)
                docs.append(k)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[str]] = [set() for _ in texts]
        if parts:
            index = FMIndex(np.concatenate(parts), self.sigma)
            starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts[::2]])])[:-1]
            for n, phrases in self.by_length.items():
                low, high = index.search(phrases)
                count = high - low
                which = np.repeat(np.arange(len(phrases)), count)
                rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                at = index.locate(rows)
                run = np.searchsorted(starts, at, "right") - 1
                for w, p, r in zip(which.tolist(), at.tolist(), run.tolist(), strict=True):
                    begin = int(where[r] + p - starts[r])
                    spans[docs[r]].append((begin, begin + n))
                    items[docs[r]] |= self.items_of(n, w)
        return counts, [merge_spans(x) for x in spans], items


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in groups of bounded size; one partition of the benchmark is on the driver at a time."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        block.append((r.item_id, r.text))
        size += len(r.text or "") // 4 + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


SPANS = "array<struct<start:long,end:long>>"


def searched(view: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """view (doc_id, text) and n_words, spans, items; each block of the benchmark is a pass over the rows of the one before.

    Rows stay in place and carry what was found so far, so there is no shuffle, and rows that share an id, or have none,
    stay apart. The last pass of a block needs that block alone.
    """
    spark = view.sparkSession
    ship(spark)
    out = view.select("doc_id", "text", F.lit(0).cast("long").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast("array<string>").alias("items"))
    schema = out.schema

    def search(df: DataFrame, block: list[tuple[object, str | None]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phrases = Phrases(sent.value, window)
            for b in batches:
                raw = [t.encode() for t in b["text"]]
                before = b[["spans", "items"]].to_numpy()
                for first, last in steps(raw):
                    counts, spans, found = phrases.hits(raw[first:last])
                    spans = [merge_spans([*s, *((x["start"], x["end"]) for x in had)]) for s, (had, _) in zip(spans, before[first:last], strict=True)]
                    items = [sorted({*f, *had}) for f, (_, had) in zip(found, before[first:last], strict=True)]
                    part = b.iloc[first:last]
                    yield part.assign(doc_id=part["doc_id"].astype("Int64"), n_words=counts, spans=[[{"start": x, "end": y} for x, y in s] for s in spans], items=items)

        return df.mapInPandas(nonempty(run), schema)

    passes = 0
    for block in blocks(benchmark, block_words):
        out, passes = search(out, block), passes + 1
    return out if passes else search(out, [])


SPANS = "array<struct<start:long,end:long>>"


def search_pass(rows: DataFrame, block: list[tuple[object, str | None]], window: int, hits_only: bool) -> DataFrame:
    """key, n_words, spans, items of rows (key, text), for one block of the benchmark."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases = Phrases(sent.value, window)
        for b in batches:
            raw = [t.encode() for t in b["text"]]
            for first, last in steps(raw):
                counts, spans, found = phrases.hits(raw[first:last])
                out = pd.DataFrame({"key": b["key"].iloc[first:last].astype("Int64").array, "n_words": counts, "spans": [[{"start": x, "end": y} for x, y in s] for s in spans], "items": [sorted(f) for f in found]})
                yield out[[len(s) > 0 for s in spans]] if hits_only else out

    return rows.select("key", "text").mapInPandas(nonempty(run), f"key long, n_words long, spans {SPANS}, items array<string>")


def hits_by_key(rows: DataFrame, benchmark: Iterator[list], window: int, work: Workspace) -> DataFrame:
    """(key, spans, items) of the rows (key, text) that any block hits; spans of several blocks may overlap."""
    parts = [work.save(search_pass(rows, block, window, True), f"hits{i}") for i, block in enumerate(benchmark)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))


def numbered(docs: DataFrame, work: Workspace) -> DataFrame:
    """docs as a struct ``row``, its text and a number of its own in a written table."""
    return work.save(docs.select(F.struct("*").alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"), F.monotonically_increasing_id().alias("key")), "rows")


def one_or_more(benchmark: DataFrame, block_words: int) -> tuple[list | None, Iterator[list]]:
    """The only block, or None, and all blocks."""
    every = blocks(benchmark, block_words)
    ahead = list(islice(every, 2))
    return (None if len(ahead) > 1 else ahead[0] if ahead else []), chain(ahead, every)


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (array of word bounds, end exclusive), items (sorted array of item ids as strings) of every row."""
    ship(docs.sparkSession)
    only, every = one_or_more(benchmark, block_words)
    if only is not None:
        return search_pass(doc_view(docs).withColumnRenamed("doc_id", "key"), only, window, False).withColumnRenamed("key", "doc_id")
    work = Workspace(docs.sparkSession, "decontaminate")
    rows = numbered(doc_view(docs), work)
    words_of = search_pass(rows, [], window, False).select("key", "n_words")
    joined = rows.select("key", F.col("row.doc_id").alias("doc_id")).join(words_of, "key").join(hits_by_key(rows, every, window, work), "key", "left")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(doc_id=b["doc_id"].astype("Int64"), spans=[[{"start": x, "end": y} for x, y in merge_spans(as_pairs(ss))] for ss in b["spans"]])

    return joined.select("doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items")).mapInPandas(nonempty(merge), f"doc_id long, n_words long, spans {SPANS}, items array<string>")


def as_pairs(spans) -> list[tuple[int, int]]:
    return [] if spans is None else [(s["start"], s["end"]) for s in spans]


def judged(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (from the first one's first letter to the last one's last)."""
    raw = text.encode()
    kept = np.frombuffer(raw.translate(WORDS), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[False], kept, [False]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*out, raw[at:]]).decode()


def cleaned(b: pd.DataFrame, spans: list[list[tuple[int, int]]], n_words: list[int]) -> pd.DataFrame:
    """Rows without the contaminated ones, and without the words of spans; n_chars, if there, is counted anew."""
    keep, texts = np.ones(len(b), bool), b["text"].tolist()
    for i, (some, n) in enumerate(zip(spans, n_words, strict=True)):
        n_hit = sum(y - x for x, y in some)
        if n_hit:
            keep[i] = 20 * n_hit < n
            texts[i] = cut_words(texts[i], some) if keep[i] else texts[i]
    out = b.assign(text=texts)[keep]
    return out.assign(n_chars=[None if t is None else len(t) for t in out["text"]]) if "n_chars" in b.columns else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs, all columns, without contaminated documents; the others lose the words of benchmark windows."""
    spark = docs.sparkSession
    ship(spark)
    only, every = one_or_more(benchmark, block_words)
    if only is not None:
        sent = spark.sparkContext.broadcast(only)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phrases = Phrases(sent.value, window)
            for b in batches:
                raw = [(t or "").encode() for t in b["text"]]
                for first, last in steps(raw):
                    counts, spans, _ = phrases.hits(raw[first:last])
                    yield cleaned(b.iloc[first:last], spans, counts)

        return docs.mapInPandas(nonempty(run), docs.schema)
    work = Workspace(spark, "decontaminate")
    rows = numbered(docs, work)
    mark = "_".join(["spans", *docs.columns])  # no column of docs has this name
    hits = hits_by_key(rows, every, window, work).select("key", F.col("spans").alias(mark))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["" if t is None else t for t in b["text"]]
            yield cleaned(b.drop(columns=mark), [merge_spans(as_pairs(ss)) for ss in b[mark]], [len(split_words(t.encode())) for t in texts])

    clean = rows.join(hits, "key", "left_anti").select("row.*")
    return clean.unionByName(rows.join(hits, "key").select("row.*", mark).mapInPandas(nonempty(cut), docs.schema))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(find_contamination(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH low AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
bl AS (
  SELECT item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM benchmark),
b AS (SELECT item_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM bl),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, pos.n AS n, item_id FROM pos JOIN win USING (p)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
