"""The network is trained with what it is read with, and a step of it needs no function that is slow on some CPUs."""

import numpy as np
import pytest

from anvilgrid.llm import pii


def test_reading_takes_no_exponentials(monkeypatch):
    p = pii.new_parameters()

    def slow(*args, **named):
        raise AssertionError("exp or tanh in a step")

    for name in ("exp", "tanh"):
        monkeypatch.setattr(np, name, slow)
    assert pii.emissions(np.ones((70, 5), np.uint8), p).shape == (70, 5, pii.N_TAGS)


@pytest.mark.parametrize("scale", [1, 6])
def test_read_as_trained_where_gates_are_shut(scale):
    p = {k: a * np.float32(scale) for k, a in pii.new_parameters(3).items()}
    x = np.random.default_rng(2).integers(0, pii.N_CHARS, (60, 7))
    f = pii.Direction()
    h = np.concatenate([f.forward(x, p, "f"), pii.Direction().forward(x[::-1], p, "b")[::-1]], 2)
    shut = np.concatenate([g for k in f.kept for g in k[2:5]])
    assert scale == 1 or (shut == 0).any() and (shut == 1).any()
    assert np.abs(pii.emissions(x, p) - (h @ p["V"] + p["v"])).max() < 1e-3


def test_slopes_are_those_of_the_functions():
    x = np.linspace(-5, 5, 1000) + 0.001
    for f, slope in ((pii.squash, pii.squash_slope), (pii.gate, pii.gate_slope)):
        inside = np.abs(np.abs(x) - 2) > 0.02  # a gate's ends
        assert np.abs((f(x + 1e-5) - f(x - 1e-5)) / 2e-5 - slope(f(x)))[inside].max() < 1e-5


def test_gradient_is_that_of_the_network():
    p = {k: a.astype(np.float64) for k, a in pii.new_parameters(5).items()}
    x = np.random.default_rng(4).integers(0, pii.N_CHARS, (9, 3))
    to = np.random.default_rng(5).normal(size=(9, 3, pii.HIDDEN))
    d, g = pii.Direction(), {k: np.zeros_like(a) for k, a in p.items()}
    d.forward(x, p, "f")
    d.backward(to, p, g, "f")
    for k in ("Uf", "bf", "Wf"):
        at, step = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape), 1e-5
        worth = []
        for way in (step, -step):
            q = p | {k: p[k].copy()}
            q[k][at] += way
            worth.append((pii.Direction().forward(x, q, "f") * to).sum())
        assert abs((worth[0] - worth[1]) / (2 * step) - g[k][at]) < 1e-3 * abs(g[k][at])
