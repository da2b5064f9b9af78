"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

Frequent words (counted over all texts, and the vocabulary's own words) are encoded once and compiled into an
acyclic automaton whose equal suffixes are shared. Each arc carries a number; the sum along a word's path is the
word's place in a table of token ids, so the automaton is a transducer from bytes to ids. The file is written to the
shared folder, fetched by each executor and memory-mapped by its Python workers. Words outside it are merged exactly
by rank. Every word of every text is encoded; the lexicon only decides which way a word takes.

Defined cases: null text = empty = no tokens (digests of the empty string); very long words merge in O(n log n);
the text of a special token inside a document is that token, as the vocabulary file says; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import doc_view, documents, in_steps, nonempty
from anvilgrid.session import Workspace

#: Splits text before merging (fixed by the vocabulary's format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters, numbers and blanks of the first 256 characters, as that pattern's classes have them.
LATIN_LETTERS, LATIN_NUMBERS, LATIN_BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", r"\t-\r\x20\x85\xa0"
#: Words of the corpus that the lexicon takes at most, and the most a task reports.
LEXICON_WORDS, TASK_WORDS = 100_000, 40_000
#: Characters of words and their ids that a worker remembers in each of two generations (with what Python adds),
#: and the longest word that it remembers.
REMEMBERED, OVERHEAD, REMEMBERED_BYTES = 40 << 20, 190, 64
#: What may stand around a counted word.
AROUND = ".,;:!?()[]{}\"'<>|*_-/\\\r\n\t"
#: Bytes of a word up to which it is merged side by side with others, and words of one such block.
SHORT, ROWS = 64, 8192


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in byte-level vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ranks, token bytes and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(k): v for k, v in spec["model"]["vocab"].items()}
        self.bytes = {v: k for k, v in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        #: rank of a pair (two ids as one number), and the id that the merge of a rank makes
        self.rank, self.made = {}, []
        for i, (a, b) in enumerate(pairs):
            self.rank[self.ids[raw(a)] << 32 | self.ids[raw(b)]] = i
            self.made.append(self.ids[raw(a + b)])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {v: k.encode() for k, v in self.special.items()}
        self.one = [self.ids[bytes([b])] for b in range(256)]
        #: bytes by the written id
        self.named = {str(i): b for i, b in self.bytes.items()}

    @cached_property
    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs, their ranks, and what the merge of each rank makes; one pair more ends the search."""
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        ranks = np.fromiter(self.rank.values(), np.int32, len(self.rank))[order]
        return np.append(keys[order], 1 << 62), np.append(ranks, len(ranks)).astype(np.int32), np.array(self.made, np.int64)

    def merge(self, word: bytes) -> list[int]:
        """Exact merges, lowest rank first and leftmost among equals."""
        return self.merge_all([word])[0]

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """merge() of many words: words of like length are merged side by side, one merge of each in a round."""
        out: list[list[int]] = [[]] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_width.setdefault(max(8, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, those in by_width.items():
            if width > SHORT:
                for i in those:
                    out[i] = self.merge_long([self.one[b] for b in words[i]])
            else:
                for k in range(0, len(those), ROWS):
                    part = those[k : k + ROWS]
                    for i, ids in zip(part, self.merge_block([words[i] for i in part], width), strict=True):
                        out[i] = ids
        return out

    def merge_block(self, words: list[bytes], width: int) -> list[list[int]]:
        keys, ranks, made = self.pairs
        none = len(made)

        def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Of pairs; none where a side is missing (-1) or the pair is never merged."""
            key = a << 32 | b
            at = np.searchsorted(keys, key)
            return np.where((keys[at] == key) & (b >= 0), ranks[at], none)

        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        ids = np.array(self.one, np.int64)[raw]
        column = np.arange(width)
        ids[column >= np.array([len(w) for w in words])[:, None]] = -1
        # the rank of each place with the next one; the last has none
        table = np.full(ids.shape, none, np.int32)
        table[:, :-1] = rank(ids[:, :-1], ids[:, 1:])
        live = np.arange(len(words))
        while True:
            j = table[live].argmin(1)
            least = table[live, j]
            go = least < none
            if not go.any():
                return [[x for x in row if x >= 0] for row in ids.tolist()]
            live, j, least = live[go], j[go], least[go]
            # the right part goes: all behind it moves up by one
            after = np.minimum(column + (column > j[:, None]), width - 1)
            some, its = np.take_along_axis(ids[live], after, 1), np.take_along_axis(table[live], np.minimum(column + (column >= j[:, None]), width - 1), 1)
            some[:, -1], its[:, -1] = -1, none
            row, new = np.arange(len(live)), made[least]
            some[row, j] = new
            its[row, j] = np.where(j + 1 < width, rank(new, some[row, np.minimum(j + 1, width - 1)]), none)
            left = j > 0
            its[row[left], j[left] - 1] = rank(some[row[left], j[left] - 1], new[left])
            ids[live], table[live] = some, its

    def merge_long(self, ids: list[int]) -> list[int]:
        """A heap over a linked list of parts: O(n log n) for words of any length."""
        rank, made, n = self.rank.get, self.made, len(ids)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = (m := made[r]), -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(m << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, m, ids[k]))
            h = before[i]
            if h >= 0 and (r := rank(ids[h] << 32 | m)) is not None:
                heapq.heappush(heap, (r, h, ids[h], m))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def vocabulary_of(path: str) -> Vocabulary:
    """A worker reads a file once for all of its tasks."""
    return Vocabulary(path)


def compile_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The minimal acyclic transducer of the words, as one file image.

    Words are added in order; once a branch can no longer change, each of its states is replaced by an equal state
    if there is one. Layout: 5 counts, then int32 tables (arcs' bounds, targets, numbers; ids' bounds; ids), then labels
    and final flags as bytes.
    """
    states: list[dict[int, int]] = [{}]
    final, known = [False], {}
    path: list[tuple[int, int]] = []  # (state, label) of the last word's open branch

    def close(upto: int) -> None:
        while len(path) > upto:
            state, label = path.pop()
            child = states[state][label]
            same = known.setdefault((final[child], tuple(states[child].items())), child)
            states[state][label] = same

    last = b""
    order = sorted(words)
    for w in order:
        common = len(os.path.commonprefix([w, last]))
        close(common)
        state = states[path[-1][0]][path[-1][1]] if path else 0
        for c in w[common:]:
            states.append({})
            final.append(False)
            states[state][c] = len(states) - 1
            path.append((state, c))
            state = len(states) - 1
        final[state] = True
        last = w
    close(0)
    number, below, seen = {0: 0}, {}, [0]
    for s in seen:
        for t in states[s].values():
            if t not in number:
                number[t] = len(seen)
                seen.append(t)
    stack = [0]
    while stack:
        s = stack[-1]
        todo = [t for t in states[s].values() if t not in below]
        if todo:
            stack += todo
        else:
            below[s] = final[s] + sum(below[t] for t in states[s].values())
            stack.pop()
    bounds, targets, adds, labels, flags = [0], [], [], bytearray(), bytearray()
    for s in seen:
        so_far = int(final[s])
        for c, t in states[s].items():  # in order, as words came in order
            labels.append(c)
            targets.append(number[t])
            adds.append(so_far)
            so_far += below[t]
        bounds.append(len(targets))
        flags.append(final[s])
    id_bounds, ids = [0], []
    for w in order:
        ids += words[w]
        id_bounds.append(len(ids))
    tables = [bounds, targets, adds, id_bounds, ids]
    head = struct.pack("<5i", *map(len, tables))
    return head + b"".join(struct.pack(f"<{len(t)}i", *t) for t in tables) + bytes(labels) + bytes(flags)


class Lexicon:
    """A memory-mapped transducer: bytes of words to their ids, or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = struct.unpack_from("<5i", self.map)
        at, tables = 20, []
        for n in sizes:
            tables.append(np.frombuffer(self.map, np.int32, n, at))
            at += 4 * n
        bounds, self.targets, self.adds, self.id_bounds, self.ids = tables
        self.states = sizes[0] - 1
        labels = np.frombuffer(self.map, np.uint8, sizes[1], at)
        self.final = np.frombuffer(self.map, np.uint8, sizes[0] - 1, at + sizes[1])
        #: state and label of each arc as one ascending number
        self.arcs = np.append(np.repeat(np.arange(sizes[0] - 1), np.diff(bounds)) * 256 + labels, 1 << 62)

    def get(self, word: bytes) -> list[int] | None:
        place = self.places([word])[0]
        return None if place < 0 else self.ids[self.id_bounds[place] : self.id_bounds[place + 1]].tolist()

    def written(self, names: dict[int, str]) -> list[str]:
        """The ids of each place as text."""
        ids, bounds = [names[i] for i in self.ids.tolist()], self.id_bounds.tolist()
        return [",".join(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1. All words walk through the automaton together, a byte in each round."""
        lengths = np.array([len(w) for w in words], np.int64)
        data, start = np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.flatnonzero(lengths > 0)
        known, i = np.ones(len(words), bool), 0
        while len(live):
            key = state[live] * 256 + data[start[live] + i]
            arc = np.searchsorted(self.arcs, key)
            there = self.arcs[arc] == key
            known[live[~there]] = False
            live, arc = live[there], arc[there]
            place[live] += self.adds[arc]
            state[live] = self.targets[arc]
            i += 1
            live = live[lengths[live] > i]
        return np.where(known & (self.final[state] > 0), place, -1)


def latin_pattern() -> str:
    """PATTERN with its classes spelled out: the same for texts of the first 256 characters, and cheaper to match."""
    letter, number, blank = LATIN_LETTERS, LATIN_NUMBERS, LATIN_BLANKS
    return PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"(?!\S)", f"(?![^{blank}])").replace(r"\s", f"[{blank}]")


def splitter(special: dict[str, int]):
    """text -> its words, special tokens whole."""
    import regex

    latin, other = re.compile(latin_pattern()).findall, regex.compile(PATTERN).findall

    def words(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return other(text)
        return latin(text)

    if not special:
        return words
    cut = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words(text)
        return [w for part in cut(text) if part for w in ([part] if part in special else words(part))]

    return split


class Codec:
    """Encodes and decodes with a lexicon file; one for each worker.

    It remembers words with their ids as text (no lists, so that there is little for the garbage collector to walk), up to
    REMEMBERED bytes. Once that is full it becomes the older generation, from which a word that comes again is taken over, so
    frequent words are not forgotten. All words of a step that are not remembered are looked up together.
    """

    def __init__(self, vocabulary: str, lexicon: str):
        self.vocabulary, self.lexicon = vocabulary_of(vocabulary), Lexicon(lexicon)
        self.split = splitter(self.vocabulary.special)
        self.name = {i: str(i) for i in self.vocabulary.bytes}
        self.listed = self.lexicon.written(self.name)
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.size = 0

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of words."""
        known, older, special, name = self.known, self.older, self.vocabulary.special, self.name
        again = words & older.keys()
        fresh = list(words - again - special.keys())
        raw = [w.encode() for w in fresh]
        places = self.lexicon.places(raw)
        listed = self.listed
        found = [listed[p] for p in places.tolist()]  # -1 gives any; those are merged
        unseen = np.flatnonzero(places < 0).tolist()
        for i, ids in zip(unseen, self.vocabulary.merge_all([raw[i] for i in unseen]), strict=True):
            found[i] = ",".join([name[x] for x in ids])
        known.update({w: older[w] for w in again})
        known.update({w: name[special[w]] for w in words & special.keys()})
        known.update(zip(fresh, found, strict=True))
        self.size += OVERHEAD * len(words) + sum(map(len, words)) + sum(map(len, found))

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by commas."""
        split = [*map(self.split, texts)]
        self.learn(set().union(*split).difference(self.known))
        get = self.known.__getitem__
        out = [",".join([*map(get, words)]) for words in split]
        if self.size >= REMEMBERED:
            self.older, self.known, self.size = self.known, {}, 0
        return out

    def decoded(self, listed: str) -> str:
        """The text of ids as encode() gives them."""
        named = self.vocabulary.named
        return b"".join([*map(named.__getitem__, listed.split(","))]).decode("utf-8", "replace") if listed else ""

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.vocabulary.bytes[i] for i in ids]).decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: str, lexicon: str) -> Codec:
    from pyspark import SparkFiles

    key = (vocabulary, lexicon)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(vocabulary, SparkFiles.get(lexicon))
    return _CODECS[key]


def frequent_words(docs: DataFrame, words: int = LEXICON_WORDS) -> list[str]:
    """The corpus's most frequent words: what stands between two blanks, with the blank and without punctuation around it.

    Each task counts all of its texts and reports its own most frequent words (TASK_WORDS), whose counts are summed. So the
    order of rare words is not exact; the lexicon decides which way a word takes and no result.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        for b in batches:
            for t in b["text"]:
                seen.update(t.split(" "))
            if len(seen) > 10 * TASK_WORDS:  # bounded memory: of so many distinct words the rare ones go
                seen = Counter(dict(seen.most_common(5 * TASK_WORDS)))
        top = seen.most_common(TASK_WORDS)
        yield pd.DataFrame({"word": [w.strip(AROUND) for w, _ in top], "n": [n for _, n in top]})

    found = doc_view(docs).select("text").mapInPandas(nonempty(count), "word string, n long").where(F.length("word").between(1, REMEMBERED_BYTES)).groupBy("word").agg(F.sum("n").alias("n"))
    return [" " + r.word for r in found.orderBy(F.desc("n"), "word").limit(words).collect()]


def build_lexicon(docs: DataFrame, vocabulary: str, work: Workspace, words: int = LEXICON_WORDS) -> str:
    """Compiles the lexicon and gives it to all executors; returns its file name."""
    v = vocabulary_of(vocabulary)
    raw = {w.encode() for w in frequent_words(docs, words) if w not in v.special}
    own = [b for b in v.ids if len(b) > 1 and b.strip().isalpha()]
    raw |= {b for b, ids in zip(own, v.merge_all(own), strict=True) if ids == [v.ids[b]]}
    name = f"{work.path.rsplit('/', 1)[-1]}.lexicon"
    raw = sorted(w for w in raw if w) or [b" "]
    image = compile_lexicon(dict(zip(raw, v.merge_all(raw), strict=True)))
    docs.sparkSession.sparkContext.addFile(work.put(name, image))
    return name


def encode_documents(docs: DataFrame, vocabulary: str, words: int = LEXICON_WORDS, ids: bool = True, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>) and decoded (string)."""
    spark = docs.sparkSession
    lexicon = build_lexicon(docs, vocabulary, Workspace(spark, "bpe"), words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = codec(vocabulary, lexicon)
        digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
        for b in batches:
            for part in in_steps(b):
                listed = c.encode(part["text"].tolist())
                texts = [*map(c.decoded, listed)]
                out = {"doc_id": part["doc_id"].astype("Int64").array, "n_tokens": [x.count(",") + 1 if x else 0 for x in listed], "ids_sha256": [*map(digest, listed)], "decoded_sha256": [*map(digest, texts)]}
                out |= {"ids": [np.fromstring(x, np.int32, sep=",") if x else np.zeros(0, np.int32) for x in listed]} if ids else {}
                yield pd.DataFrame(out | ({"decoded": texts} if decoded else {}))

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids + ", decoded string" * decoded
    return doc_view(docs).mapInPandas(nonempty(run), schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), default_vocabulary(), ids=False, decoded=False)
