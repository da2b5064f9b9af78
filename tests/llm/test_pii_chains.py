"""Chains hold whole runs, and only numbers as long as a card's are barred from the network."""

import re
import time

import numpy as np
import pytest

from anvilgrid.llm import pii

LONG = "anna-maria.lindqvist @ department.university.edu"
TEXTS = [f"~~~ ~~~~~~~~~ ~~~~~~~~~~~~~~ {LONG} ~~~~ ~~~~~~~~~~ ~~~~~~", f"{LONG}", "x" * 40 + "7" + "y" * 40 + " " + "z" * 30, "a@b  @  c", "", "none at all", "@", "  @  ", "1 " * 50, "ab " * 30 + "@" + " cd" * 30, "1" * 100 + "a" * 50 + " @" * 5, "write to anna dot berg at mail dot example dot org and so on " * 2, "x" * 50 + " ben(at)web.de " + "y z " * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_chains_hold_whole_runs(text):
    need = np.zeros(len(text) + 1, bool)
    for m in pii.CALLS.finditer(text):
        reach = pii.REACH if len(m[0]) == 1 else pii.WORD_REACH
        need[max(0, m.start() - reach) : min(len(text), m.end() + reach)] = True
        if m[0] == "@":
            need[re.search(r"\S*\s*$", text[: m.start()]).start() : m.end() + re.match(r"\s*\S*", text[m.end() :]).end()] = True
    for r in re.finditer(r"\S+", text):
        need[r.start() : r.end()] |= need[r.start() : r.end()].any()
    got = np.zeros(len(text) + 1, bool)
    found = pii.chains(text)
    for a, b in found:
        got[a:b] = True
    assert (got | ~need).all() and all(x[1] < y[0] for x, y in zip(found, found[1:], strict=False))


def test_long_runs_take_linear_time():
    begin = time.time()
    for text in ("@" * 200_000, "1" * 200_000, "@ " * 100_000, "a" * 200_000 + "@", "1a" * 100_000):
        assert pii.chains(text) == [(0, len(text.rstrip() if "@ " not in text else text))]
    assert time.time() - begin < 20


def test_disguised_address_is_masked_whole(monkeypatch):
    def emissions(x, p):
        e = np.zeros((*x.shape, pii.N_TAGS), np.float32)
        e[..., 2] = 20  # inside an address
        e[x == pii.symbols("Z")[0], 1] = 40
        e[x == pii.symbols("~")[0], 0] = 40
        return e

    monkeypatch.setattr(pii, "emissions", emissions)
    text = f"~~~~~~~ ~~~~~~~~~~~ Z{LONG}~ ~~~~~~~~~~~~~"
    (_, spans), *_ = pii.find([text], {"T": np.zeros((pii.N_TAGS, pii.N_TAGS), np.float32)})
    assert [text[a:b] for k, a, b in spans if k == 0] == ["Z" + LONG]


@pytest.mark.parametrize(("number", "barred"), [("41111111111111", False), ("411111111111111", False), ("4111111111111112", True), ("4111 1111 1111 1112", True), ("41111111111111111111", False)])
def test_only_failed_checksums_bar(monkeypatch, number, barred):
    monkeypatch.setattr(pii, "tag_texts", lambda texts, p: [[(3, 5, 5 + len(number))] for _ in texts])
    (base, spans), *_ = pii.find([f"call {number} now"], {"T": None})
    assert base == [] and spans == ([] if barred else [(3, 5, 5 + len(number))])


def test_planted_spans_are_where_they_are_said_to_be():
    rng = np.random.default_rng(3)
    for _ in range(200):
        text = "call +49 30 1234567 now or write to a.b@c.de about nothing much at all"
        said, known = pii.planted(text, pii.base_spans(text), rng)
        assert {"a.b@c.de", "+49 30 1234567"} <= {said[a:b] for _, a, b in known} and len(known) > 2
        bare = said
        for _, a, b in sorted(known, reverse=True, key=lambda s: s[1]):
            bare = bare[:a] + bare[b:]
        assert bare.split() == "call now or write to about nothing much at all".split()


def test_network_finds_held_out_spans_that_patterns_miss():
    rng = np.random.default_rng(8)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, n)) for n in rng.integers(2, 10, 300)]
    texts = [" ".join(words[i] for i in rng.integers(0, 300, 40)) + f" {i}" for i in range(260)]
    quality = pii.held_out_quality(texts[160:], pii.train(texts[:160]), 99)
    assert quality["spans"] > 100 and quality["recall"] > 0.6 and quality["precision"] > 0.6, quality
