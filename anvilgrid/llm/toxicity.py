"""Toxicity by a weighted finite-state pattern grammar.

Words become classes (insult, threat, target, negation, reported speech, other). Five weighted transducers rewrite the
class sequence of a clause: one marks insults, one marks threats that meet a target, one marks insults that meet a
target, one turns marks behind a negation, one turns marks in reported speech. Their composition reads a clause twice,
from its end, so that a word meets the target behind it, and from its beginning. What it writes is the clause's reading;
the weights of the arcs that it took add up to the clause's weight, and a document's score is a logistic function of the
sum over its matched clauses.

A weight is a parameter of a kind of arc (WEIGHTS). The weights of all kinds are fitted on labelled rows, within bounds: an
insult that meets no target, or a threat that has a target only before it, stays below the threshold by itself, so an
isolated word decides nothing; negation and reported speech only lower.

The insult lexicon is a small general list plus words and word beginnings learnt from labelled rows of the training
folds (a bounded sample, SAMPLE_ROWS): a beginning is taken if it is far likelier in toxic than in other texts and
accounts for toxic texts that nothing taken before accounts for. A threat word with such a beginning reads as an insult
where it meets no target.
Every whole text is scanned with an Aho-Corasick automaton of the lexicon; a clause without any lexicon entry matches
no pattern of the grammar, so only the others go through the transducers.

Defined cases: null or empty texts match nothing and get the base score; without labels the general list and fixed
weights hold; repeated rows repeat; a null id is not held out.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import U64, Words, doc_view, documents, fold, labelled_sample, mix, not_bytes, nonempty
from anvilgrid.session import ship

#: Labelled rows that lexicon and weights are fitted on at most.
SAMPLE_ROWS = 8000
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.5
#: What a learnt beginning needs: toxic texts with it and texts newly accounted for (each the larger of a count and a
#: share of the toxic texts), and its likelihood against other texts.
LEAST_TEXTS, TEXTS_SHARE, LEAST_NEW, NEW_SHARE, LEAST_LIFT = 3, 0.01, 2, 0.005, 60.0
SHORTEST, LONGEST = 4, 8

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = range(6)
GENERAL = {
    INSULT: "idiot idiots moron morons imbecile stupid pathetic worthless scum loser losers trash disgusting abruti connard salaud crétin dummkopf arschloch trottel abschaum estúpido imbécil basura gilipollas",
    THREAT: "kill hurt destroy beat shoot stab strangle tuer frapper détruire töten schlagen vernichten matar golpear destruir",
    TARGET: "you your yours u this these those they them he she him her all every tu toi vous ton votre du dich dir ihr euch sie usted tú ustedes",
    NEGATION: "not no never without isn't aren't wasn't don't doesn't nicht kein keine nie ne pas jamais sin nunca jamás",
    REPORT: "said says say wrote writes claimed quoted quote reported called sagte schrieb behauptet dit écrit déclaré dijo escribió dicen",
}
CLAUSE = re.compile(r"[.!?;\n]")
IS_WORD = not_bytes((0, 32))
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")

#: Marks that the transducers write beside classes.
ABUSE, AIMED, MENACE, DENIED, QUOTED = range(6, 11)
#: The class of a threat word with a learnt beginning.
LEARNT_THREAT = 11
READINGS = [ABUSE, AIMED, MENACE, DENIED, QUOTED]
#: Kinds of arcs with a weight: an insult, an insult that meets a target, a threat with a target behind it or before it, a mark
#: that a negation or reported speech turns.
WEIGHTS = ["insult", "aimed", "threat_at", "threat_after", "denied", "quoted"]
INSULTED, AIMED_AT, THREAT_AT, THREAT_AFTER, WAS_DENIED, WAS_QUOTED = range(6)
#: Base, then WEIGHTS, before any row is seen.
PRIOR = np.array([-4.5, 3.0, 3.0, 6.0, 3.0, -3.5, -3.5])
#: How far below zero an isolated insult stays, and how often a kind counts in a document.
MARGIN, MOST = 0.5, 3


@dataclass
class Transducer:
    """arcs: (state, symbol) -> (written symbol, kind of weight or None, next state); a symbol without arc is copied to
    ``otherwise``."""

    arcs: dict[tuple[int, int], tuple[int, int | None, int]] = field(default_factory=dict)
    otherwise: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int | None, int]:
        return self.arcs.get((state, symbol)) or (symbol, None, self.otherwise.get(state, state))


@dataclass
class Composition:
    """The composition of transducers, each reading what the one before writes; states are tuples, made as needed."""

    parts: list[Transducer]
    known: dict[tuple[tuple[int, ...], int], tuple[int, tuple[int, ...], tuple[int, ...]]] = field(default_factory=dict)

    def step(self, state: tuple[int, ...], symbol: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
        key = (state, symbol)
        if key not in self.known:
            kinds, after = [], []
            for part, s in zip(self.parts, state, strict=True):
                symbol, kind, s = part.step(s, symbol)
                kinds += [] if kind is None else [kind]
                after.append(s)
            self.known[key] = (symbol, tuple(kinds), tuple(after))
        return self.known[key]

    def read(self, symbols: list[int]) -> tuple[list[int], np.ndarray]:
        """What is written, and how often the path takes an arc of each kind; the path's weight is its product with theirs."""
        state, out, taken = (0,) * len(self.parts), [], np.zeros(len(WEIGHTS))
        for s in symbols:
            o, kinds, state = self.step(state, s)
            out.append(o)
            for k in kinds:
                taken[k] += 1
        return out, taken


def within(opens: list[int], turns: dict[int, int], kind: int, reach: int) -> Transducer:
    """Once a symbol of ``opens`` was read, the symbols of ``turns`` are rewritten for ``reach`` more words."""
    t = Transducer()
    for s in range(reach + 1):
        t.otherwise[s] = max(0, s - 1)
        for o in opens:
            t.arcs[s, o] = (o, None, reach)
        if s:
            for i, o in turns.items():
                t.arcs[s, i] = (o, kind, s if i in opens else s - 1)
    return t


def meetings(threat: int) -> list[Transducer]:
    """Insults, threats at targets, insults of threat words that met none, aimed insults, in this order."""
    insults = Transducer({(0, INSULT): (ABUSE, INSULTED, 0)})
    threats = within([TARGET], {THREAT: MENACE, LEARNT_THREAT: MENACE}, threat, 4)
    learnt = Transducer({(0, LEARNT_THREAT): (ABUSE, INSULTED, 0)})
    aimed = within([TARGET], {ABUSE: AIMED}, AIMED_AT, 3)
    return [insults, threats, learnt, aimed]


def grammar() -> Composition:
    """Meetings with a target before, negation, reported speech, in this order."""
    marks = (ABUSE, AIMED, MENACE)
    denied = within([NEGATION], {m: DENIED for m in marks}, WAS_DENIED, 2)
    quoted = within([REPORT], {m: QUOTED for m in marks}, WAS_QUOTED, 8)
    return Composition([*meetings(THREAT_AFTER), denied, quoted])


def ahead() -> Composition:
    """Meetings with a target behind, for a clause read from its end; learnt threats without one are left to grammar()."""
    insults, threats, _, aimed = meetings(THREAT_AT)
    return Composition([insults, threats, aimed])


class Lexicon:
    """words: whole words by class; stems: beginnings of insults."""

    def __init__(self, stems: list[str]):
        import ahocorasick

        self.stems = stems
        self.classes = {w: c for c, ws in reversed(GENERAL.items()) for w in ws.split()}
        self.scan = ahocorasick.Automaton()
        for w in [*stems, *(w for w, c in self.classes.items() if c in (INSULT, THREAT))]:
            self.scan.add_word(w, len(w))
        self.scan.make_automaton()
        self.lengths = sorted({len(s) for s in stems})
        self.known = set(stems)
        self.grammar, self.ahead = grammar(), ahead()

    def kind(self, word: str) -> int:
        c = self.classes.get(word, OTHER)
        if c in (THREAT, OTHER) and any(word[:n] in self.known for n in self.lengths):
            return LEARNT_THREAT if c == THREAT else INSULT
        return c

    def clauses(self, low: str) -> Iterator[str]:
        """The clauses with an entry at the beginning of a word."""
        upto = 0
        for end, n in self.scan.iter(low):
            start = end - n + 1
            if start < upto or (start and low[start - 1].isalpha()):
                continue
            a = max((m for m in (low.rfind(c, 0, start) for c in ".!?;\n")), default=-1) + 1
            m = CLAUSE.search(low, start)
            upto = m.start() if m else len(low)
            yield low[a:upto]

    def marks(self, clause: str, both: bool = True) -> tuple[list[int], np.ndarray]:
        """A clause's reading and the kinds of arcs taken; targets count that come before a word, and with ``both`` those
        behind it too."""
        kinds, taken = [self.kind(w) for w in WORD.findall(clause)], 0.0
        if both:
            written, taken = self.ahead.read(kinds[::-1])
            kinds = written[::-1]
        written, more = self.grammar.read(kinds)
        return written, taken + more

    def readings(self, text: str, both: bool = False) -> np.ndarray:
        """How many clauses have each reading; a clause counts once, by its strongest mark."""
        out = np.zeros(len(READINGS))
        for clause in self.clauses(text.lower()):
            written, _ = self.marks(clause, both)
            for mark in (MENACE, AIMED, ABUSE, QUOTED, DENIED):
                if mark in written:
                    out[READINGS.index(mark)] += 1
                    break
        return out

    def weigh(self, text: str) -> np.ndarray:
        """Kinds of arcs taken over all matched clauses, each MOST times at most."""
        out = np.zeros(len(WEIGHTS))
        for clause in self.clauses(text.lower()):
            out += self.marks(clause)[1]
        return np.minimum(out, MOST)


def without_copies(rows: list[tuple[str, int]], bands: int = 8) -> list[tuple[str, int]]:
    """One of each group of near copies, found by pairs of minimum hashes of three-word shingles: a group of copies is
    one piece of evidence, whatever its size."""
    seen: set[tuple[int, int, int]] = set()
    out = []
    for text, label in rows:
        h = Words([text.encode()], IS_WORD).hash
        if len(h) >= 3:
            h = mix(h[:-2] * U64(3) + h[1:-1] * U64(5) + h[2:] * U64(7))
        least = [int(mix(h ^ U64(k * 0x9E3779B9 + 1)).min()) if len(h) else 0 for k in range(2 * bands)]
        keys = {(b, least[2 * b], least[2 * b + 1]) for b in range(bands)}
        if not keys & seen:
            out.append((text, label))
        seen |= keys
    return out


def learn_stems(rows: list[tuple[str, int]]) -> list[str]:
    with_it: dict[str, set[int]] = defaultdict(set)
    others: Counter[str] = Counter()
    n_toxic = n_other = 0
    for i, (text, toxic) in enumerate(rows):
        begins = {w[:n] for w in set(WORD.findall(text.lower())) for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
        if toxic:
            n_toxic += 1
            for b in begins:
                with_it[b].add(i)
        else:
            n_other += 1
            others.update(begins)
    lift = {b: (len(t) / max(1, n_toxic)) / ((others[b] + 0.1) / (n_other + 1)) for b, t in with_it.items() if len(t) >= max(LEAST_TEXTS, TEXTS_SHARE * n_toxic)}
    taken, covered = [], set()
    for b in sorted((b for b in lift if lift[b] >= LEAST_LIFT), key=lambda b: (-len(with_it[b]), len(b), b)):
        if len(with_it[b] - covered) >= max(LEAST_NEW, NEW_SHARE * n_toxic):
            taken.append(b)
            covered |= with_it[b]
    # a second look: beginnings as sure as those taken, though their texts are accounted for
    sure = [b for b in lift if lift[b] >= LEAST_LIFT and others[b] == 0 and len(with_it[b]) >= max(8, TEXTS_SHARE * n_toxic)]
    return [b for b in sorted({*taken, *sure}) if not any(b != s and b.startswith(s) for s in {*taken, *sure})]


def bounded(w: np.ndarray) -> np.ndarray:
    """Weights within what the grammar's kinds mean."""
    w = w.copy()
    w[0] = min(w[0], -1.0)
    alone = -w[0] - MARGIN
    for kind, (low, high) in {INSULTED: (0, alone), AIMED_AT: (0, np.inf), THREAT_AT: (0, np.inf), THREAT_AFTER: (0, alone), WAS_DENIED: (-np.inf, 0), WAS_QUOTED: (-np.inf, 0)}.items():
        w[1 + kind] = np.clip(w[1 + kind], low, high)
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression of the kinds' counts drawn to PRIOR, within bounds."""
    w, x = PRIOR.copy(), np.concatenate([np.ones((len(x), 1)), x], 1)
    if not len(x):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (p - y) / len(y) + 1e-3 * (w - PRIOR)
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + 2e-3 * np.eye(len(w))
        w = bounded(w - np.clip(np.linalg.solve(h, g), -0.5, 0.5))
    return w


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(learnt beginnings, weights: base, then WEIGHTS)."""
    rows = labelled_sample(docs, labels, "toxic", fold(F.col("doc_id"), FOLDS) != HELD_OUT, sample_rows)
    stems = learn_stems(without_copies(rows))
    lexicon = Lexicon(stems)
    return stems, fit_weights(np.array([lexicon.weigh(t) for t, _ in rows]).reshape(-1, len(WEIGHTS)), np.array([y for _, y in rows], float))


def rate(lexicon: Lexicon, weights: np.ndarray, text: str) -> float:
    z = weights[0] + weights[1:] @ lexicon.weigh(text)
    return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def score_toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, score of every row."""
    ship(docs.sparkSession)
    stems, weights = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(stems)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "score": [rate(lexicon, weights, t) for t in b["text"]]})

    return doc_view(docs).mapInPandas(nonempty(run), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: tuple[list[str], np.ndarray], threshold: float = THRESHOLD) -> DataFrame:
    """docs, all columns, without the rows that score at least the threshold."""
    ship(docs.sparkSession)
    stems, weights = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon(stems)
        for b in batches:
            yield b[np.array([rate(lexicon, weights, t or "") < threshold for t in b["text"]], bool)]

    return docs.mapInPandas(nonempty(run), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_toxicity(docs, fit_toxicity(docs, documents(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
