"""Every position of every text is read, and stretches are decoded as whole texts would be."""

import numpy as np
import pytest

from anvilgrid.llm import pii

TEXTS = ["no sign of any kind in this one", "", "a", "x" * 2000 + " 7 " + "y" * 900, "ben at web dot de", "z" * 512, "1 " * 400]


def test_windows_lie_over_every_text_whole(monkeypatch):
    seen = []

    def emissions(x, p):
        seen.append("".join(chr(c + 31) if c else "" for c in x.T.ravel()))
        return np.zeros((*x.shape, pii.N_TAGS), np.float32)

    monkeypatch.setattr(pii, "emissions", emissions)
    pii.tag_texts(TEXTS, {"T": np.zeros((pii.N_TAGS, pii.N_TAGS), np.float32)})
    read = "".join(seen)
    assert all(t[i : i + 32] in read for t in TEXTS for i in range(0, max(1, len(t) - 31)))
    assert len(read) >= sum(map(len, TEXTS))


@pytest.mark.parametrize("seed", range(6))
def test_stretches_are_decoded_as_the_whole(seed, monkeypatch):
    rng = np.random.default_rng(seed)
    texts = ["".join(rng.choice(list("ab 1"), n)) for n in (3, 70, 900, 0, 1, 260)]
    trans = rng.normal(0, 1, (pii.N_TAGS, pii.N_TAGS)).astype(np.float32)
    table = rng.normal(0, 2, (len(texts[2]) + 999, pii.N_TAGS)).astype(np.float32)
    table[:, 0] += 5
    flat = table[: sum(map(len, texts))]
    monkeypatch.setattr(pii, "text_scores", lambda symbols, bounds, p, at_once: flat)
    monkeypatch.setattr(pii, "CERTAIN", 0.0)
    got, at = pii.tag_some(texts, {"T": trans}, 64), 0
    for text, spans in zip(texts, got, strict=True):
        e = flat[at : at + len(text)]
        at += len(text)
        want = pii.read_tags(pii.viterbi(e[:, None], trans, np.array([len(e)]))[:, 0], np.exp(e - pii.logsum(e, 1)[:, None])) if len(e) else []
        assert [s for s in spans if "1" in text[s[1] : s[2]]] == [s for s in want if "1" in text[s[1] : s[2]]]


def test_emissions_are_those_of_training():
    p = pii.new_parameters()
    x = np.random.default_rng(1).integers(0, pii.N_CHARS, (40, 9))
    h = np.concatenate([pii.Direction().forward(x, p, "f"), pii.Direction().forward(x[::-1], p, "b")[::-1]], 2)
    assert np.abs(pii.emissions(x, p) - (h @ p["V"] + p["v"])).max() < 1e-4
