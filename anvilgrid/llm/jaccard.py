"""Exact Jaccard self-join of word-shingle sets by T-occurrence search.

A document's set is its distinct five-word shingles (64-bit digests). Equal sets are one node. Two nodes link when their
sets overlap in at least 3/7 of the sum of their sizes (a Jaccard similarity of 0.75).

1. Signatures. In one order of all shingles (those found in many documents last, else by digest), the first l shingles that
   linked nodes have in common are among the first n/4 + l of each. With l = n/16 + 1 and a partner of at least 3/4 of
   the size, a node that links to any other shares 3n/64 + 1 of its first shingles; nodes that share fewer drop out.
   Documents are counted for every shingle whose digest is low enough to come into signatures, so passages that several
   documents share stay out of these; any list of late shingles gives one order, so the list decides speed alone.
2. Neighbourhoods. The nodes that share a signature belong to the neighbourhood of that signature's least node. So all nodes
   of a shared signature are together in one neighbourhood, and a node is in few of them, whatever its size.
3. Stars. Each member is compared with the least node of the neighbourhood that it shares most signatures with; members
   stream by, so a neighbourhood may hold a third of all nodes; it is dealt over many tasks. Their links' components
   are found.
4. T-occurrence search. In a neighbourhood that holds several components, the members outside its largest one are indexed by
   shingle, in blocks; all members search these indexes. A search needs T of the query's inverted lists to name a node:
   the L longest lists are set aside, the others are counted in one pass, nodes that they name at least T - L times are
   probed in the long lists by binary search, all at once (DivideSkip). Nodes that are connected already are not linked again, so a
   group of copies yields a tree of links. Texts are dealt, not sets: they take less room, and sets are made anew.
5. Components of the links, then the least doc_id of each.

No link between different sets is lost: the signatures are exact, blocks cover all pairs of 4, and there is no cap.

Defined cases: null or empty texts and texts without words have an empty set and are their own component; fewer than five
words are one shingle; rows that repeat have equal results; rows that share an id, or have none, and differ in text are
compared each by its own text; a null doc_id counts as the least id and shows as null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import LOWER, U64, Words, documents, mix, not_bytes, steps, nonempty
from anvilgrid.llm.components import components
from anvilgrid.llm.spans import NO_ID, keyed
from anvilgrid.session import Workspace

SHINGLE = 5
#: Members of a neighbourhood that one task compares, and nodes of one index; of long texts fewer, so that their shingles
#: are about BLOCK_SHINGLES at most.
TASK_MEMBERS, BLOCK, BLOCK_SHINGLES = 2000, 2000, 2_000_000
#: A shingle in so large a share of documents goes last in the order (this decides speed alone).
FREQUENT = 0.002
#: So does one in so many rows whose digest is in the lowest part of all; of these the most frequent, LISTED at most.
COMMON, LOWEST, LISTED = 8, 0.4, 2_000_000
#: Weighs a binary probe against a step of the count when the long lists are chosen.
MU = 1.0
#: Ids that are broadcast to pick texts; beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
IS_WORD = not_bytes((9, 13), (32, 32))


def stable_order(key: np.ndarray, below: int) -> np.ndarray:
    """Stable order of small integers; those of 16 bits are sorted by radix."""
    return np.argsort(key.astype(np.uint16 if below <= 1 << 16 else np.int64), kind="stable")


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct digests of all texts one after another, bounds of each text's)."""
    w = Words(texts, IS_WORD, LOWER)
    n = np.diff(w.bounds)
    h = w.hash
    gram, fits = h, np.ones(len(h), bool)
    for k in range(1, SHINGLE):
        gram = mix(gram * U64(0xD6E8FEB86659FD93) + np.concatenate([h[k:], np.zeros(min(k, len(h)), U64)]))
        fits[len(h) - k :] = False
        fits[: len(h) - k] &= w.doc[k:] == w.doc[: len(h) - k]
    docs, grams = [w.doc[fits]], [gram[fits]]
    for k in range(1, SHINGLE):  # a short text is one shingle
        first = w.bounds[:-1][n == k]
        g = h[first]
        for j in range(1, k):
            g = mix(g * U64(0xD6E8FEB86659FD93) + h[first + j])
        docs.append(np.flatnonzero(n == k))
        grams.append(mix(g + U64(k)))
    doc, gram = np.concatenate(docs), np.concatenate(grams)
    order = np.argsort(gram)
    order = order[stable_order(doc[order], len(texts))]
    doc, gram = doc[order], gram[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])]) if len(doc) else np.zeros(0, bool)
    doc, gram = doc[new], gram[new]
    return gram, np.searchsorted(doc, np.arange(len(texts) + 1))


def node_ids(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set."""
    total = np.concatenate([[U64(0)], np.cumsum(mix(gram ^ U64(0xA0761D6478BD642F)), dtype=U64)])
    return mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(U64)).astype(np.int64)


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, h, text: rows that share an id are told apart by a digest of their texts."""
    return keyed(docs).withColumn("h", F.xxhash64("text"))


def read_sets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, node, digests, bounds), some texts at a time."""
    for b in batches:
        raw = [t.encode() for t in b["text"]]
        for first, last in steps(raw):
            gram, bounds = shingle_sets(raw[first:last])
            yield b.iloc[first:last], node_ids(gram, bounds), gram, bounds


def survey(docs: DataFrame, work: Workspace) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, h, n, node) of each row, and the frequent shingles.

    Tasks count shingles over all of their texts and report those frequent among the texts of a step; shares of all
    documents then decide, so the list is bounded by the mean set size / FREQUENT.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[int] = Counter()
        for rows, node, gram, bounds in read_sets(batches):
            yield pd.DataFrame({"doc_id": rows["doc_id"].array, "h": rows["h"].array, "n": np.diff(bounds), "node": node, "shingle": None})
            values, count = np.unique(gram, return_counts=True)
            often = count >= max(3, FREQUENT * len(rows))
            seen.update(dict(zip(values[often].astype(np.int64).tolist(), count[often].tolist(), strict=True)))
        yield pd.DataFrame({"doc_id": None, "h": None, "n": list(seen.values()), "node": None, "shingle": list(seen)})

    every = work.save(rows_of(docs).mapInPandas(nonempty(run), "doc_id long, h long, n long, node long, shingle long"), "survey")
    nodes = every.where("shingle is null").drop("shingle")
    least = max(3, int(FREQUENT * nodes.count()))
    often = every.where("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "shingle").limit(1_000_000).select("shingle")
    return nodes, np.sort(np.array([r.shingle for r in often.collect()], np.int64).astype(U64))


def among(values: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which values are in a sorted list."""
    if not len(listed):
        return np.zeros(len(values), bool)
    return listed[np.minimum(np.searchsorted(listed, values), len(listed) - 1)] == values


def common_shingles(docs: DataFrame, frequent: np.ndarray, work: Workspace) -> np.ndarray:
    """The frequent shingles, and those of low digests that at least COMMON rows hold: the most frequent, up to LISTED."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    top = U64(int(LOWEST * 2**64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, gram, _ in read_sets(batches):
            low = gram[gram < top]
            values, n = np.unique(low[~among(low, sent.value)], return_counts=True)
            yield pd.DataFrame({"shingle": values.astype(np.int64), "n": n})

    counted = keyed(docs).mapInPandas(nonempty(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    counted = work.save(counted.where(F.col("n") >= COMMON), "counted")
    least, total = COMMON, 0
    # few rows: one for each count below 1,000, then one for each power of two
    level = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.pow(2, F.floor(F.log2("n")))).cast("long")
    for r in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += r["count"]
        if total > LISTED:
            least = r.level + 1 if r.level < 1000 else 2 * r.level
            break
    late = counted.where(F.col("n") >= least).select("shingle").toArrow()["shingle"].to_numpy().astype(np.int64).astype(U64)
    work.drop("counted")
    return np.sort(np.concatenate([frequent, late]))


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """node, n and signature shingles (array) of each row with a set."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sent.value
        for _, node, gram, bounds in read_sets(batches):
            late = among(gram, often)
            n = np.diff(bounds)
            owner = np.repeat(np.arange(len(n)), n)
            order = stable_order(2 * owner + late, 2 * len(n))  # digests ascend already
            ranked = gram[order].astype(np.int64)
            some = n > 0
            ends = bounds[:-1] + n // 4 + n // 16 + 1
            yield pd.DataFrame({"node": node[some], "n": n[some], "signature": [ranked[a:z] for a, z in zip(bounds[:-1][some], ends[some], strict=True)]})

    return keyed(docs).mapInPandas(nonempty(run), "node long, n long, signature array<long>")


def in_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of rows that share the keys, of batches sorted by them."""
    held: list[pd.DataFrame] = []
    last = None
    for b in batches:
        values = list(zip(*(b[k].tolist() for k in keys), strict=True))
        at = 0
        for key, rows in groupby(values):
            size = sum(1 for _ in rows)
            if held and key != last:
                yield pd.concat(held)
                held = []
            held.append(b.iloc[at : at + size])
            last = key
            at += size
    if held:
        yield pd.concat(held)


def enough(overlap, n, m):
    """100 * intersection >= 75 * union."""
    return 7 * overlap >= 3 * (n + m)


def with_sets(b: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """Rows with the shingle sets of their texts, some at a time."""
    raw = [t.encode() for t in b["text"]]
    for first, last in steps(raw):
        gram, bounds = shingle_sets(raw[first:last])
        yield b.iloc[first:last], [gram[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]


def compare_with_first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (center, salt, role): the center's set comes first, members stream by."""
    key = center = None
    for b in batches:
        out = []
        for part, sets in with_sets(b):
            for c, salt, role, node, s in zip(part["center"], part["salt"], part["role"], part["node"], sets, strict=True):
                if role == 0:
                    key, center = (c, salt), s
                else:
                    assert key == (c, salt), "a member came without its center"
                    overlap = np.intersect1d(center, s, assume_unique=True).size if 4 * len(s) >= 3 * len(center) and 4 * len(center) >= 3 * len(s) else 0
                    if enough(overlap, len(center), len(s)):
                        out.append((c, node))
        yield pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


class Index:
    """Inverted lists of some nodes' sets, and T-occurrence search in them.

    Sets may come without the shingles that no other node has; sizes are those of the whole sets.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        own = np.array([len(s) for s in sets], np.int64)
        self.sizes = own if sizes is None else np.array(sizes, np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, U64)
        order = np.argsort(flat, kind="stable")  # the nodes of a list ascend
        self.nodes = np.repeat(np.arange(len(sets)), own)[order]
        self.keys, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))

    def lists(self, query: np.ndarray) -> list[np.ndarray]:
        """The lists of a query's shingles, the longest last."""
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        at = at[self.keys[at] == query]
        first, last = self.bounds[at], self.bounds[at + 1]
        order = np.argsort(last - first, kind="stable")
        return [self.nodes[a:z] for a, z in zip(first[order].tolist(), last[order].tolist(), strict=True)]

    def search(self, query: np.ndarray, skip: Callable[[int], bool] = lambda node: False, size: int | None = None) -> Iterator[tuple[int, int]]:
        """(index of a node, overlap) of the nodes that link to the query, without those to skip."""
        n = len(query) if size is None else size
        t = -(-3 * n // 4)
        if len(query) < t:
            return
        found = self.lists(query)
        if not found or len(found) < t:
            return
        longest = len(found[-1])
        aside = min(t - 1, int(t / (MU * np.log2(longest + 1) + 1))) if longest > 1 else 0
        short, long = found[: len(found) - aside], found[len(found) - aside :]
        count = np.bincount(np.concatenate(short), minlength=len(self.sizes))
        m = self.sizes
        need = -(-3 * (n + m) // 7)
        able = (count >= t - aside) & (count + aside >= need) & (4 * m >= 3 * n) & (4 * n >= 3 * m)
        nodes = np.array([x for x in np.flatnonzero(able).tolist() if not skip(x)], np.int64)
        count, need = count[nodes], need[nodes]
        for i, x in enumerate(long):
            if not len(nodes):
                return
            count += x[np.minimum(np.searchsorted(x, nodes), len(x) - 1)] == nodes
            still = count + aside - 1 - i >= need
            if not still.all():
                nodes, count, need = nodes[still], count[still], need[still]
        for node, overlap in zip(nodes.tolist(), count.tolist(), strict=True):
            if not skip(node):  # a link found just now may have joined it
                yield node, overlap


class Components:
    """Components of the nodes that one task compares."""

    def __init__(self, known: dict[int, int]):
        self.known, self.above = known, {}

    def find(self, node: int) -> int:
        x, above = self.known[node], self.above
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    def join(self, a: int, b: int) -> None:
        self.above[a] = b


class OpenIndex:
    """An index of nodes for queries that ask only for nodes of other components than their own.

    Once half of the indexed nodes are in one component, its queries search an index of the other nodes alone. So the
    members of a group of near copies, found one after another, soon have nothing left to search.
    """

    def __init__(self, nodes: list[int], sets: list[np.ndarray], sizes: list[int], parts: Components):
        self.parts, self.sets = parts, dict(zip(nodes, zip(sets, sizes, strict=True), strict=True))
        self.all = self.rest = self.indexed(nodes)
        self.main: int | None = None
        self.count = Counter(map(parts.find, nodes))
        for root in list(self.count):
            self.narrow(root)

    def indexed(self, nodes: list[int]) -> tuple[list[int], Index]:
        return nodes, Index([self.sets[x][0] for x in nodes], [self.sets[x][1] for x in nodes])

    def narrow(self, root: int) -> None:
        find, nodes = self.parts.find, self.rest[0]
        own = self.main is None or self.above_main() == root
        if own and nodes and 2 * self.count[root] >= len(nodes):
            left = [x for x in nodes if find(x) != root]
            self.main = next(x for x in nodes if find(x) == root)
            self.rest = self.indexed(left)
            self.count = Counter(map(find, left))

    def above_main(self) -> int | None:
        return None if self.main is None else self.parts.find(self.main)

    def links(self, node: int, s: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
        """New links of a node, which join its component with others."""
        find = self.parts.find
        nodes, index = self.rest if find(node) == self.above_main() else self.all
        for i, _ in index.search(s, lambda i: find(nodes[i]) == find(node), size):
            a, b = find(node), find(nodes[i])
            self.parts.join(a, b)
            self.count[b] += self.count.pop(a, 0)
            self.narrow(b)
            yield node, nodes[i]


def without_own(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets without the shingles that only one of them has."""
    flat = np.concatenate(sets)
    order = np.argsort(flat)
    same = np.diff(flat[order]) == 0
    shared = np.zeros(len(flat), bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    bounds = np.cumsum([0, *map(len, sets)])
    return [flat[a:z][shared[a:z]] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]


def search_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (center, block, part): links between the block's indexed nodes (role 0 or 2) and the part's members (role 1 or 2)."""
    for g in in_groups(batches, ["center", "block", "part"]):
        sets = [s for _, part in with_sets(g) for s in part]
        roles, names = g["role"].tolist(), g["node"].tolist()
        held = [i for i, r in enumerate(roles) if r != 1]
        sizes, sets = list(map(len, sets)), without_own(sets)
        index = OpenIndex([names[i] for i in held], [sets[i] for i in held], [sizes[i] for i in held], Components(dict(zip(names, g["root"].tolist(), strict=True))))
        out = [link for node, s, size, role in zip(names, sets, sizes, roles, strict=True) if role for link in index.links(node, s, size)]
        yield pd.DataFrame(out, columns=["a", "b"]).astype(np.int64)


def find_links(docs: DataFrame, nodes: DataFrame, frequent: np.ndarray, work: Workspace, block: int = BLOCK) -> DataFrame:
    """(a, b) links of nodes that connect exactly the nodes that similarity connects."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = work.save(signatures(docs, frequent), "signatures")
    each = signed.select("node", "n", F.explode("signature").alias("signature"))
    shared = work.save(each.groupBy("signature").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("signature"), "shared")
    common = work.save(each.join(shared, "signature").distinct(), "common")
    work.drop("signatures")
    work.drop("shared")
    able = common.groupBy("node", "n").agg(F.count(F.lit(1)).alias("shared")).where("shared >= floor(3 * n / 64) + 1").select("node")
    common = work.save(common.join(able, "node", "left_semi").select("signature", "node", "n"), "able")
    work.drop("common")
    centers = common.groupBy("signature").agg(F.min("node").alias("center"), F.max("node").alias("other")).where("center != other").select("signature", "center")
    members = work.save(common.join(centers, "signature").groupBy("center", "node").agg(F.count(F.lit(1)).alias("shared"), F.max("n").alias("n")), "members")
    work.drop("able")
    # a text of each node that has neighbours
    least = nodes.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("least")).select("node", "least.*")  # combined before the shuffle
    asked = least.join(members.select("node").distinct(), "node", "left_semi")
    asked = work.save(asked, "asked")
    few = asked.count() <= BROADCAST_IDS
    texts = work.save(rows_of(docs).join(F.broadcast(asked) if few else asked, ["doc_id", "h"]).select("node", "text"), "texts")
    main = work.save(members.where("node != center").groupBy("node").agg(F.max_by("center", F.struct("shared", "center")).alias("center")), "main")
    sizes = main.groupBy("center").agg(F.count(F.lit(1)).alias("members"))
    salts = F.ceil(F.col("members") / TASK_MEMBERS).cast("int")
    star = (
        main.join(sizes, "center").select("center", F.pmod(F.hash("node"), salts).alias("salt"), F.lit(1).alias("role"), "node")
        .unionByName(sizes.select("center", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), F.col("center").alias("node")))
        .join(texts, "node").repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", "role")
        .mapInPandas(nonempty(compare_with_first), "a long, b long")
    )
    star = work.save(star, "star")
    roots = components(star, work.inner("star_roots"))
    # neighbourhoods of several components: blocks of the members outside the largest one against parts of all members
    placed = work.save(members.join(roots, "node", "left").select("center", "node", "n", F.coalesce("root", "node").alias("root")), "placed")
    by_root = placed.groupBy("center", "root").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("n"))
    largest = by_root.groupBy("center").agg(F.max(F.struct("size", "root", "n")).alias("top"), F.sum("size").alias("all"), F.sum("n").alias("all_n"))
    largest = largest.select("center", F.col("top.root").alias("largest"), F.col("top.size").alias("size"), F.col("top.n").alias("n"), "all", "all_n").where("size < all")
    # two members that the star compared need no second look
    pairs = members.join(main, ["node", "center"], "left_semi").select("center").distinct()
    wide = largest.join(pairs.withColumn("seen", F.lit(True)), "center", "left").where("all > 2 or seen is null")
    in_blocks = lambda nodes, grams: F.ceil(F.greatest(nodes / block, grams / BLOCK_SHINGLES)).cast("int")
    wide = wide.select("center", "largest", in_blocks(F.col("all") - F.col("size"), F.col("all_n") - F.col("n")).alias("blocks"), in_blocks(F.col("all"), F.col("all_n")).alias("parts"))
    todo = work.save(placed.drop("n").join(wide, "center"), "open")
    small, todo = todo.where("parts = 1"), todo.where("parts > 1")
    once = small.select("center", F.lit(0).alias("block"), F.lit(0).alias("part"), F.when(F.col("root") != F.col("largest"), 2).otherwise(1).alias("role"), "node", "root")
    indexed = todo.where("root != largest").select("center", F.pmod(F.hash("node"), "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "node", "root")
    asking = todo.select("center", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.hash("node"), "parts").alias("part"), F.lit(1).alias("role"), "node", "root")
    found = once.unionByName(indexed).unionByName(asking).join(texts, "node").repartition(parts, "center", "block", "part").sortWithinPartitions("center", "block", "part", "role", "node").mapInPandas(nonempty(search_blocks), "a long, b long")
    return work.save(star.unionByName(found), "links")


def classes(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, h, n, node, root of every row; a written table."""
    work = Workspace(docs.sparkSession, "jaccard")
    nodes, frequent = survey(docs, work)
    links = find_links(docs, nodes, common_shingles(docs, frequent, work), work, block)
    roots = components(links, work)
    rooted = work.save(nodes.join(roots, "node", "left").select("doc_id", "h", "n", "node", F.coalesce("root", "node").alias("root")), "rooted")
    for name in ("survey", "members", "asked", "texts", "main", "star", "placed", "open"):
        work.drop(name)
    return rooted


def join_similar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rooted = classes(docs, block)
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    own = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return rooted.join(least, "root", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))).select(own("doc_id"), F.col("n").alias("n_shingles"), own("component_id"))


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs, all columns, with one row of each component: that of its least doc_id (a null one is the least). Rows of one id
    with different texts are documents of their own; rows that repeat id and text are one; so is a text without words."""
    rooted = classes(docs, block)
    kept = rooted.where("n > 0").groupBy("root").agg(F.min(F.struct("doc_id", "h")).alias("least")).select("least.*")
    kept = kept.unionByName(rooted.where("n = 0").select("doc_id", "h")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("_h"))
    return rows.join(kept, ["_id", "_h"], "left_semi").dropDuplicates(["_id", "_h"]).select("row.*")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_similar(documents(spark, sf_dir))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT k, min(doc_id) AS rep FROM k GROUP BY k),
r AS (SELECT s.* FROM s JOIN c ON s.doc_id = c.rep),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * o >= 75 * (na.n + nb.n - o)),
e AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l UNION SELECT rep, rep FROM c),
reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(root.b, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN c USING (k) LEFT JOIN root ON root.a = c.rep
"""
