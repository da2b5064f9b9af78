"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

Its gates are straight lines with ends, and x / sqrt(1 + x * x) stands for tanh: on CPUs without wide vectors numpy's exp and
tanh took more time than all the rest of the network. It is trained with what it is read with.

The patterns give the base spans. The network tags characters as outside, begin or inside of a kind. It is trained in numpy
on labelled spans: those of the patterns in a bounded sample of texts (SAMPLE_TEXTS), and made-up ones that are put into
these texts, most of them written in ways that the patterns miss (blanks, brackets or words in place of signs, doubled or
other separators, numbers without plus). Where such a span is, and of which kind, is known from its making and not from
the patterns; held_out_quality() measures on others of them what the network finds.

Windows lie over the whole of every text, also where none of the kinds can be: a reported span holds a digit, an at sign or a
spelled-out one by definition (CALLS). Neighbouring windows overlap; the tag scores of a character are averaged
over its windows, and the CRF decodes each text as a whole, so a span is never cut by a window's edge. Where no run of inside
tags, however long, can be worth as much as staying outside, the best path is outside (free()); of the stretches between, which hold all
spans, those that hold a call are worked out. Spans of the method are added if they meet no base span and nothing that a pattern
matched and its check rejected (of digit runs: those with as many digits as a card, 16 to 19).

Defined cases: null or empty texts have no spans; runs of digits of any length are handled in linear time; without
training texts nothing is added to the base spans; repeated rows repeat.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anvilgrid.llm.common import doc_view, documents, nonempty
from anvilgrid.session import ship

KINDS = ["email", "ip", "card", "phone"]
#: Texts with a digit or at sign that the network is fitted on at most, and its training steps.
SAMPLE_TEXTS, STEPS, BATCH = 1500, 260, 64
#: Of the weights and made-up spans: the best of six on made-up spans in 300 texts, which count for nothing else.
SEED = 4
#: Made-up spans that are put into each of these texts at most.
MADE = 3
#: Characters of a sampled text at most: bounds what the driver reads for fitting.
SAMPLE_CHARS = 20_000
#: Characters of a window, and how far windows reach around the characters that call for them.
WINDOW, OVERLAP, REACH, WORD_REACH = 64, 32, 16, 40
#: Characters of a window that is read, and of texts that are tagged at once.
READ, CHARS_AT_ONCE = 256, 1_500_000
HIDDEN, EMBEDDED = 20, 8
N_TAGS = 1 + 2 * len(KINDS)
#: The least mean certainty of an added span.
CERTAIN = 0.5

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CALLS = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]|(?<= )at (?=\S+ (?:dot|\.) )")
DIGIT_OR_AT = re.compile(r"[0-9@]")
BLANKS, RUN = re.compile(r"\s*"), re.compile(r"\S*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches: only a run of local characters that an at sign follows can begin one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def octets(m: re.Match) -> bool:
    return all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split(".")))


def card_digits(text: str) -> str | None:
    digits = text.replace(" ", "").replace("-", "")
    return digits if 16 <= len(digits) <= 19 else None


def card(m: re.Match) -> bool:
    digits = card_digits(m[0])
    return digits is not None and luhn(digits)


def phone(m: re.Match) -> bool:
    return 8 <= sum(c.isdigit() for c in m[0]) <= 15


def called(text: str, start: int, end: int) -> bool:
    """Whether CALLS is found between start and end; its last forms need a bracket or the word itself there."""
    if DIGIT_OR_AT.search(text, start, end):
        return True
    return (any(text.find(c, start, end) >= 0 for c in "[({") or text.find("at ", start, end) >= 0) and CALLS.search(text, start, end) is not None


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans that the patterns match and their checks accept, and those that their checks reject."""
    if not DIGIT_OR_AT.search(text):
        return [], []
    kept, failed = [(0, a, b) for a, b in emails(text)], []
    for k, pattern, check in ((1, IP, octets), (2, CARD, card), (3, PHONE, phone)):
        for m in pattern.finditer(text):
            (kept if check(m) else failed).append((k, m.start(), m.end()))
    return kept, failed


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) by kind, then start."""
    return matches(text)[0]


#: Characters as small numbers: printable ASCII by themselves, blanks, other letters, anything else.
N_CHARS = 100
SYMBOLS = np.array([97] * 32 + list(range(1, 96)) + [98] * (0x250 - 127) + [99], np.uint8)


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return SYMBOLS[np.minimum(c, len(SYMBOLS) - 1)]


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, a, b in spans:
        out[a:b] = 2 + 2 * k
        out[a] = 1 + 2 * k
    return out


def squash(x: np.ndarray, out: np.ndarray | None = None, spare: np.ndarray | None = None) -> np.ndarray:
    """x / sqrt(1 + x * x), between -1 and 1: in the place of tanh, as it takes only operations that every CPU does many at once."""
    root = np.square(x, out=spare)
    root += 1
    return np.divide(x, np.sqrt(root, out=root), out=out)


def squash_slope(y: np.ndarray) -> np.ndarray:
    """Derivative of squash where it is y."""
    return (1 - y * y) ** 1.5


def gate(x: np.ndarray) -> np.ndarray:
    """A straight line from 0 to 1 in the place of a sigmoid, as steep in the middle."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def gate_slope(y: np.ndarray) -> np.ndarray:
    return np.float32(0.25) * ((y > 0) & (y < 1))


class Direction:
    """One LSTM direction over a batch (time first); keeps what its gradient needs."""

    def forward(self, x: np.ndarray, p: dict, name: str) -> np.ndarray:
        t, b = x.shape
        h = c = np.zeros((b, HIDDEN), np.float32)
        inputs = p["E"] @ p[f"W{name}"] + p[f"b{name}"]  # one row for each character
        self.x, self.kept, hs = x, [], []
        for i in range(t):
            z = inputs[x[i]] + h @ p[f"U{name}"]
            g = gate(z[:, : 3 * HIDDEN])
            i_, f_, o_ = g[:, :HIDDEN], g[:, HIDDEN : 2 * HIDDEN], g[:, 2 * HIDDEN :]
            u = squash(z[:, 3 * HIDDEN :])
            before, c = c, f_ * c + i_ * u
            s = squash(c)
            self.kept.append((h, before, i_, f_, o_, u, s))
            h = o_ * s
            hs.append(h)
        return np.stack(hs)

    def backward(self, dh_out: np.ndarray, p: dict, g: dict, name: str) -> None:
        dh = dc = np.zeros_like(dh_out[0])
        dzs: list[np.ndarray] = []
        back = p[f"U{name}"].T
        for i in range(len(dh_out) - 1, -1, -1):
            _, before, i_, f_, o_, u, s = self.kept[i]
            dh = dh + dh_out[i]
            dc = dc + dh * o_ * squash_slope(s)
            dz = np.concatenate([dc * u * gate_slope(i_), dc * before * gate_slope(f_), dh * s * gate_slope(o_), dc * i_ * squash_slope(u)], 1)
            dzs.append(dz)
            dh, dc = dz @ back, dc * f_
        flat = np.stack(dzs[::-1]).reshape(-1, 4 * HIDDEN)
        chars, inputs = self.x.reshape(-1), np.stack([k[0] for k in self.kept]).reshape(-1, HIDDEN)
        g[f"W{name}"] += p["E"][chars].T @ flat
        g[f"b{name}"] += flat.sum(0)
        g[f"U{name}"] += inputs.T @ flat
        of_chars = flat @ p[f"W{name}"].T
        for k in range(EMBEDDED):
            g["E"][:, k] += np.bincount(chars, of_chars[:, k], N_CHARS).astype(np.float32)


def new_parameters(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    r = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"E": r(N_CHARS, EMBEDDED) * 3, "V": r(2 * HIDDEN, N_TAGS), "v": np.zeros(N_TAGS, np.float32), "T": np.zeros((N_TAGS, N_TAGS), np.float32)}
    for name in "fb":
        p |= {f"W{name}": r(EMBEDDED, 4 * HIDDEN), f"U{name}": r(HIDDEN, 4 * HIDDEN), f"b{name}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"b{name}"][HIDDEN : 2 * HIDDEN] = 1
    return p


def emissions(x: np.ndarray, p: dict) -> np.ndarray:
    """Tag scores (time x batch x tags) of windows x (time x batch), as Direction.forward() gives them.

    Both directions go side by side, with gates as rows and windows as columns, so that each step works on whole rows of
    memory. A column holds the state, the character's vector and a one: a product with it is all that the gates need, and
    its last rows are what the state before adds to the scores. The line of a gate is in the weights; its ends are cut here.
    """
    t, b = x.shape
    k, n = HIDDEN + EMBEDDED, 4 * HIDDEN
    weights = np.zeros((2, n + N_TAGS, k + 1), np.float32)
    for own, d, read in zip(weights, "fb", (p["V"][:HIDDEN], p["V"][HIDDEN:]), strict=True):
        own[:n] = np.concatenate([p[f"U{d}"].T, p[f"W{d}"].T, p[f"b{d}"][:, None]], 1)
        own[: 3 * HIDDEN] *= 0.25
        own[: 3 * HIDDEN, k] += 0.5
        own[n:, :HIDDEN] = read.T
    columns = np.zeros((2, k + 1, b), np.float32)
    columns[:, k] = 1
    state, first, second = columns[:, :HIDDEN], *columns[:, HIDDEN:k]
    vectors, x = np.ascontiguousarray(p["E"].T), x.astype(np.intp)
    product = np.empty((2, n + N_TAGS, b), np.float32)
    into, forget, out, update = (product[:, i * HIDDEN : (i + 1) * HIDDEN] for i in range(4))
    gates, forward, backward = product[:, : 3 * HIDDEN], *product[:, n:]
    c, s, spare = np.zeros((2, HIDDEN, b), np.float32), *np.empty((2, 2, HIDDEN, b), np.float32)
    e = np.empty((t, N_TAGS, b), np.float32)
    e[:] = p["v"][:, None]
    for i in range(t + 1):
        if i < t:
            np.take(vectors, x[i], 1, out=first, mode="clip")
            np.take(vectors, x[t - 1 - i], 1, out=second, mode="clip")
        np.matmul(weights, columns, out=product)
        if i:
            e[i - 1] += forward
            e[t - i] += backward
        np.clip(gates, 0, 1, out=gates)
        c *= forget
        into *= squash(update, update, spare)
        c += into
        np.multiply(squash(c, s, spare), out, out=state)
    return e.transpose(0, 2, 1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def crf(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, tag marginals and expected transitions of a batch of chains (time x batch x tags)."""
    t = len(e)
    a, b = np.zeros_like(e), np.zeros_like(e)
    a[0] = e[0]
    for i in range(1, t):
        a[i] = e[i] + logsum(a[i - 1][:, :, None] + trans, 1)
    for i in range(t - 2, -1, -1):
        b[i] = logsum(trans + (e[i + 1] + b[i + 1])[:, None, :], 2)
    z = logsum(a[-1], 1)
    pairs = np.exp(a[:-1, :, :, None] + trans + (e[1:] + b[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
    return z, np.exp(a + b - z[None, :, None]), pairs


#: Parts of made-up spans.
NAMES = "anna ben carla david elena frank greta henri ines jonas karin louis maria nina oskar paula rosa simon tina viktor".split()
HOSTS = "example mail post web office school firm club uni data".split()
ENDINGS = "com org net de fr es info eu".split()
AT, DOT = [" at ", " [at] ", "(at)", " @ ", " (at) ", "[at]"], [" dot ", ".", " . ", " (dot) ", "[dot]"]


def made_up(rng) -> tuple[int, str]:
    """A span of a kind, as people write such things; most escape the patterns."""
    pick = lambda xs: xs[int(rng.integers(0, len(xs)))]
    digits = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))
    kind = int(rng.integers(0, len(KINDS)))
    if kind == 0:
        dot = pick(DOT)
        local = pick([pick(NAMES), pick(NAMES) + pick([dot if dot != " . " else ".", "_", "-", ""]) + pick(NAMES), pick(NAMES) + digits(2)])
        return kind, local + pick(AT) + pick(HOSTS) + dot + pick(ENDINGS)
    if kind == 1:
        return kind, pick([" . ", ". ", "[.]", " dot ", ",", "."]).join(str(int(x)) for x in rng.integers(1, 256, 4))
    if kind == 2:
        return kind, pick([" ", "  ", " - ", ".", "/", "_"]).join(digits(4) for _ in range(4))
    head = pick(["00", "0", "(0", "tel. 0", "+ "])
    tail = pick([" ", "-", " / ", ".", "  "]).join(digits(int(n)) for n in rng.integers(2, 4, 4))
    return kind, head + digits(2) + (")" if head == "(0" else "") + pick([" ", "-", "/"]) + tail


def planted(text: str, spans: list[tuple[int, int, int]], rng, most: int = MADE) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with made-up spans between its words, none inside a labelled one; and all spans."""
    gaps = [i for i, c in enumerate(text) if c == " " and not any(a <= i < b for _, a, b in spans)]
    if not gaps:
        return text, spans
    out, at, size, kept, todo = [], 0, 0, [], sorted(spans, key=lambda s: s[1])
    for gap in sorted({gaps[int(rng.integers(0, len(gaps)))] for _ in range(int(rng.integers(1, most + 1)))}):
        kind, new = made_up(rng)
        while todo and todo[0][2] <= gap:
            k, a, b = todo.pop(0)
            kept.append((k, a + size, b + size))
        out += [text[at:gap], " ", new]
        kept.append((kind, gap + size + 1, gap + size + 1 + len(new)))
        size, at = size + 1 + len(new), gap
    kept += [(k, a + size, b + size) for k, a, b in todo]
    return "".join([*out, text[at:]]), kept


def examples(texts: list[str], rng) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows and their tags: around labelled spans, other calls, and anywhere. A text is read near its calls or beginning."""
    for text in texts:
        for turn in range(2):
            spans = base_spans(text)
            said, known = planted(text, spans, rng) if turn else disguise(text, spans, rng) if rng.random() < 0.3 else (text, spans)
            x, y = symbols(said), tags_of(len(said), known)
            for m in [a for _, a, _ in known] + [m.start() for m in list(CALLS.finditer(said))[:2]] + [int(rng.integers(0, max(1, len(said))))]:
                a = max(0, min(m - int(rng.integers(4, WINDOW - 24)), len(x) - WINDOW))
                wx, wy = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
                n = len(x[a : a + WINDOW])
                wx[:n], wy[:n] = x[a : a + WINDOW], y[a : a + WINDOW]
                if wy[0] and wy[0] % 2 == 0:  # a span that the window's edge cuts
                    wy[0] -= 1
                yield wx, wy


def train(texts: list[str], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray] | None:
    """Adam on the CRF's likelihood of windows around labelled spans and around other calls."""
    rng = np.random.default_rng(seed)
    windows = list(examples(texts, rng))
    if not windows:
        return None
    xs, ys = np.array([w[0] for w in windows]), np.array([w[1] for w in windows])
    p = new_parameters(seed)
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(xs), BATCH)
        x, y = xs[at].T, ys[at].T
        f, b = Direction(), Direction()
        h = np.concatenate([f.forward(x, p, "f"), b.forward(x[::-1], p, "b")[::-1]], 2)
        e = h @ p["V"] + p["v"]
        _, marginal, pairs = crf(e, p["T"])
        g = {k: np.zeros_like(a) for k, a in p.items()}
        de = marginal - np.eye(N_TAGS, dtype=np.float32)[y]
        np.add.at(g["T"], (y[:-1].ravel(), y[1:].ravel()), -1)
        g["T"] += pairs
        g["V"] += np.einsum("tbh,tbk->hk", h, de)
        g["v"] += de.sum((0, 1))
        dh = de @ p["V"].T
        f.backward(dh[:, :, :HIDDEN], p, g, "f")
        b.backward(dh[::-1][:, :, HIDDEN:], p, g, "b")
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for k in p:
            gk = np.clip(g[k] / BATCH, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * gk
            v[k] = 0.99 * v[k] + 0.01 * gk * gk
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def held_out_quality(texts: list[str], p: dict[str, np.ndarray], seed: int) -> dict[str, float]:
    """Recall and precision of added spans on made-up spans that the patterns miss, put into texts of their own: a span is
    found if an added one of its kind covers most of both."""
    rng = np.random.default_rng(seed)
    hit = missed = wrong = 0
    said = [planted(t, base_spans(t), rng) for t in texts]
    for (text, known), (base, every) in zip(said, find([t for t, _ in said], p), strict=True):
        added = [s for s in every if s not in base]
        hidden = [s for s in known if not any(s[1] < y and x < s[2] for _, x, y in base)]
        alike = lambda s, t: s[0] == t[0] and 2 * (min(s[2], t[2]) - max(s[1], t[1])) > max(s[2] - s[1], t[2] - t[1])
        hit += sum(any(alike(s, t) for t in added) for s in hidden)
        missed += sum(not any(alike(s, t) for t in added) for s in hidden)
        wrong += sum(not any(alike(s, t) for s in known) for t in added)
    return {"spans": hit + missed, "recall": hit / max(1, hit + missed), "precision": hit / max(1, hit + wrong)}


def disguise(text: str, spans: list[tuple[int, int, int]], rng) -> tuple[str, list[tuple[int, int, int]]]:
    """Labelled spans written in ways that the patterns miss: doubled separators, blanks around an at sign."""
    out, at, kept = [], 0, []
    size = 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        new = text[a:b]
        if k == 0:
            new = new.replace("@", " @ ")
        elif k == 2 and b - a == 16:
            new = "  ".join(new[i : i + 4] for i in range(0, 16, 4))
        elif k == 1:
            new = new.replace(".", " . ")
        out += [text[at:a], new]
        size += a - at
        kept.append((k, size, size + len(new)))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), kept


def chains(text: str) -> list[tuple[int, int]]:
    """The stretches around each digit or at sign, joined where they meet (windows lie over all of a text, see tag_texts()). They end at blanks or at the
    text's ends; no character is looked at again for each call, so long runs take linear time."""
    out: list[list[int]] = []
    for m in CALLS.finditer(text):
        done = out[-1][1] if out else 0
        a, b = m.start(), m.end()
        if m[0] == "@":
            b = BLANKS.match(text, b).end()
            while a > done and text[a - 1].isspace():
                a -= 1
        reach = REACH if len(m[0]) == 1 else WORD_REACH
        a, b = max(done, min(a, m.start() - reach)), max(b, min(len(text), m.end() + reach))
        while a > done and not text[a - 1].isspace():
            a -= 1
        b = RUN.match(text, b).end() if b >= done else done
        if out and a <= done:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def viterbi(e: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of chains (time x batch x tags); beyond its length a chain has none (0). Long chains come first inside, so
    that each step works on those that are not over; which tag led to a best one is looked up on the way back alone."""
    t, b, n_tags = e.shape
    order = np.argsort(-lengths, kind="stable")
    live = np.searchsorted(-lengths[order], -np.arange(t + 1), "left").tolist()
    best = np.ascontiguousarray(e.transpose(0, 2, 1)[:, :, order])
    sums, to = np.empty((n_tags, n_tags, b), np.result_type(e, trans)), trans[:, :, None]
    for i in range(1, t):
        n = live[i]
        best[i, :, :n] += np.add(best[i - 1, :, None, :n], to, out=sums[:, :, :n]).max(0)
    tags, now = np.zeros((t, b), np.int64), np.zeros(b, np.int64)
    for i in range(t - 1, -1, -1):
        n, more = live[i], live[i + 1]
        if more:
            now[:more] = (best[i, :, :more] + trans[:, now[:more]]).argmax(0)
        if more < n:
            now[more:n] = best[i, :, more:n].argmax(0)
        tags[i, order[:n]] = now[:n]
    return tags


def tag_texts(texts: list[str], p: dict[str, np.ndarray], at_once: int = 256) -> list[list[tuple[int, int, int]]]:
    """Spans of the network in each text, decoded over the whole text."""
    out: list[list[tuple[int, int, int]]] = []
    first = 0
    while first < len(texts):
        last, chars = first + 1, len(texts[first])
        while last < len(texts) and chars + len(texts[last]) <= CHARS_AT_ONCE:
            chars += len(texts[last])
            last += 1
        out += tag_some(texts[first:last], p, at_once)
        first = last
    return out


def text_scores(flat: np.ndarray, bounds: np.ndarray, p: dict[str, np.ndarray], at_once: int) -> np.ndarray:
    """Tag scores of every character of texts (symbols one after another), averaged over its windows."""
    step = READ - OVERLAP
    scores = np.zeros((N_TAGS, len(flat)), np.float32)
    starts = [np.arange(a, max(a + 1, z - OVERLAP), step) for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if z > a]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    size = np.minimum(np.repeat(bounds[1:][np.diff(bounds) > 0], [len(s) for s in starts]) - start, READ)
    padded = -(-size // WINDOW) * WINDOW  # by its own length, so that a window's scores do not depend on others
    flat = np.concatenate([flat, np.zeros(READ, flat.dtype)])
    for width in range(WINDOW, READ + 1, WINDOW):
        those = np.flatnonzero(padded == width)
        for i in range(0, len(those), at_once):
            part = those[i : i + at_once]
            x = flat[start[part] + np.arange(width)[:, None]]
            x[np.arange(width)[:, None] >= size[part]] = 0
            e = np.ascontiguousarray(emissions(x, p).transpose(1, 2, 0))
            for own, a, n in zip(e, start[part].tolist(), size[part].tolist(), strict=True):
                scores[:, a : a + n] += own[:, :n]
    for s in starts:
        for a in s[1:].tolist():  # where two windows lie
            scores[:, a : a + OVERLAP] *= 0.5
    return scores.T


def potentials(trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(worth of being inside each tag, of a step into each, of a step back outside), over staying outside: with them a run of
    inside tags is worth at most the sum of its steps', and that of the step back. Worths of tags cancel between."""
    over = trans.astype(np.float64) - float(trans[0, 0])
    inner, n = over[1:, 1:], len(trans) - 1
    walks, cycle = np.zeros(n), -np.inf
    sums = [walks]
    for _ in range(n):
        walks = (walks[:, None] + inner).max(0)
        sums.append(walks)
    for k in range(n):  # the greatest mean of a cycle (Karp)
        cycle = max(cycle, min((sums[n][k] - sums[i][k]) / (n - i) for i in range(n)))
    each = cycle + 0.1
    worth = over[0, 1:] - each
    for _ in range(n):
        worth = np.maximum(worth, (worth[:, None] + inner).max(0) - each)
    step = np.maximum(over[0, 1:], (worth[:, None] + inner).max(0)) - worth
    return worth, step, float((worth + over[1:, 0]).max())


def free(scores: np.ndarray, trans: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the best path may be inside a span: at the others every run of inside tags over them, of any length, is worth
    less than staying outside. bounds: of the texts, at whose edges a run needs no step in or back."""
    worth, step, back = potentials(trans)
    gain = np.full(len(scores), -np.inf)
    first, last = bounds[:-1][np.diff(bounds) > 0], bounds[1:][np.diff(bounds) > 0] - 1
    for k in range(1, N_TAGS):
        np.maximum(gain, scores[:, k] - scores[:, 0] + step[k - 1], out=gain)
    gain[last] = (scores[last, 1:] - scores[last, :1] + step + np.maximum(0, worth - back)).max(1)
    gain[first] = np.maximum(gain[first], (scores[first, 1:] - scores[first, :1] - worth).max(1))
    gain[np.intersect1d(first, last)] = 1e6  # texts of one character
    total = np.concatenate([[0.0], np.cumsum(gain)])
    least, most = np.minimum.accumulate(total[:-1]), np.maximum.accumulate(total[:0:-1])[::-1]
    return ~(most - least + back < -0.01)


def tag_some(texts: list[str], p: dict[str, np.ndarray], at_once: int) -> list[list[tuple[int, int, int]]]:
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    bounds = np.cumsum([0, *map(len, texts)])
    if not bounds[-1]:
        return out
    scores = text_scores(symbols("".join(texts)), bounds, p, at_once)
    edge = np.zeros(len(scores) + 1, bool)
    edge[bounds] = True
    open_ = free(scores, p["T"], bounds)
    begins = np.flatnonzero(open_ & (edge[:-1] | ~np.concatenate([[False], open_[:-1]])))
    ends = 1 + np.flatnonzero(open_ & (edge[1:] | ~np.concatenate([open_[1:], [False]])))
    of = np.searchsorted(bounds, begins, "right") - 1
    begin, end = begins - bounds[of], ends - bounds[of]
    some = np.array([called(texts[k], a, z) for k, a, z in zip(of.tolist(), begin.tolist(), end.tolist(), strict=True)], bool)
    begins, ends, of, begin = (x[some] for x in (begins, ends, of, begin))
    order, i = np.argsort(ends - begins, kind="stable"), 0
    while i < len(order):
        n = 1
        while i + n < len(order) and (n + 1) * (ends - begins)[order[i + n]] <= 200_000:
            n += 1
        part = order[i : i + n]
        i += n
        lengths = ends[part] - begins[part]
        e = np.zeros((int(lengths.max()), n, N_TAGS), np.float32)
        for c, j in enumerate(part):
            e[: lengths[c], c] = scores[begins[j] : ends[j]]
            if not edge[begins[j]]:
                e[0, c] += p["T"][0]
            if not edge[ends[j]]:
                e[lengths[c] - 1, c] += p["T"][:, 0]
        tags = viterbi(e, p["T"], lengths)
        for c, j in enumerate(part):
            own = scores[begins[j] : ends[j]]
            sure = np.exp(own - logsum(own, 1)[:, None])
            k, a = int(of[j]), int(begin[j])
            out[k] += [(kind, a + s, a + t) for kind, s, t in read_tags(tags[: lengths[c], c], sure)]
    return [sorted(x, key=lambda s: s[1]) for x in out]


def read_tags(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int]]:
    out, i, n = [], 0, len(tags)
    while i < n:
        t = int(tags[i])
        if t and t % 2 == 1:
            j = i + 1
            while j < n and tags[j] == t + 1:
                j += 1
            if j - i > 3 and sure[np.arange(i, j), tags[i:j]].mean() >= CERTAIN:
                out.append(((t - 1) // 2, i, j))
            i = j
        else:
            i += 1
    return out


def find(texts: list[str], p: dict[str, np.ndarray] | None) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text."""
    both = [matches(t) for t in texts]
    more = tag_texts(texts, p) if p else [[] for _ in texts]
    out = []
    for i, (spans, failed) in enumerate(both):
        every = list(spans)
        rejected = [f for f in failed if f[0] != 2 or card_digits(texts[i][f[1] : f[2]])]
        for k, a, b in more[i]:
            while a < b and texts[i][a].isspace():
                a += 1
            while b > a and texts[i][b - 1].isspace():
                b -= 1
            if CALLS.search(texts[i], a, b) and not any(a < y and x < b for _, x, y in every + rejected):
                every.append((k, a, b))
        out.append((spans, sorted(every)))
    return out


def fit_pii(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS) -> dict[str, np.ndarray] | None:
    view = doc_view(docs)
    chosen = view.where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS)).select("doc_id", F.xxhash64("text").alias("h")).orderBy("h", "doc_id").limit(sample_texts)
    rows = view.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "h"]).select("h", "doc_id", "text").collect()
    texts = [r.text for r in sorted(rows, key=lambda r: (r.h, r.doc_id))]
    return train(texts)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points) of every row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = find(b["text"].tolist(), sent.value)
            as_rows = lambda s: [{"kind": KINDS[k], "start": x, "end": y} for k, x, y in s]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "base": [as_rows(x) for x, _ in found], "spans": [as_rows(y) for _, y in found]})

    span = "array<struct<kind:string,start:long,end:long>>"
    return doc_view(docs).mapInPandas(nonempty(run), f"doc_id long, base {span}, spans {span}")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in capitals; spans that meet are masked as one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """docs, all rows and columns, with spans masked in text (and n_chars, where there is one, counted anew)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [t or "" for t in b["text"]]
            new = [None if old is None else mask(t, s) for old, t, (_, s) in zip(b["text"], texts, find(texts, sent.value), strict=True)]
            yield b.assign(text=new, **({"n_chars": [None if t is None else len(t) for t in new]} if counted else {}))

    return docs.mapInPandas(nonempty(run), docs.schema)


def listed(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's output."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))



def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return listed(find_pii(docs, fit_pii(docs)))
