"""Few characters of plain text are left to the decoder, and none that the best path is inside of is left out."""

import numpy as np
import pytest

from anvilgrid.llm import pii

N = pii.N_TAGS


def spans_favoured() -> np.ndarray:
    """Transitions as training gives them: what begins goes on, and ends before another begins."""
    trans = np.full((N, N), -6, np.float32)
    trans[0, 0], trans[0, 1::2], trans[:, 0] = 1, 0, -1
    for k in range(1, N, 2):
        trans[k, k + 1], trans[k + 1, k + 1] = 3, 2
    return trans


def test_plain_text_is_closed():
    scores = np.zeros((5000, N), np.float32)
    scores[:, 0] = 5
    scores[2000:2020, 0] = -5
    got = pii.free(scores, spans_favoured(), np.array([0, 1500, 5000]))
    assert got[2000:2020].all() and got.sum() < 300


@pytest.mark.parametrize("seed", range(60))
def test_best_path_is_outside_where_closed(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(0, 2 + seed % 12 * 9, 12)
    bounds = np.cumsum([0, *lengths])
    trans = rng.normal(0, 2, (N, N)).astype(np.float32) + (spans_favoured() if seed % 2 else 0)
    scores = rng.normal(0, 2, (bounds[-1], N)).astype(np.float32)
    scores[:, 0] += rng.integers(0, 16)
    closed = ~pii.free(scores, trans, bounds)
    for a, z in zip(bounds[:-1], bounds[1:], strict=True):
        if z > a:
            assert not (pii.viterbi(scores[a:z, None], trans, np.array([z - a]))[:, 0][closed[a:z]]).any()


def test_chains_of_all_lengths_are_decoded_as_alone():
    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 40, 7, 40, 12])
    e, trans = rng.normal(0, 2, (40, 6, N)).astype(np.float32), rng.normal(0, 1, (N, N)).astype(np.float32)
    together = pii.viterbi(e, trans, lengths)
    for c, n in enumerate(lengths):
        assert (together[:n, c] == pii.viterbi(e[:n, c : c + 1], trans, np.array([n]))[:, 0]).all() and not together[n:, c].any()
    for c in (0, 1):  # against all paths
        n = lengths[c]
        paths = np.stack(np.meshgrid(*[range(N)] * n, indexing="ij"), -1).reshape(-1, n)
        worth = e[np.arange(n), c, paths].sum(1) + sum(trans[paths[:, i], paths[:, i + 1]] for i in range(n - 1))
        assert (together[:n, c] == paths[worth.argmax()]).all()


@pytest.mark.parametrize("text", ["", "at", "a [at ]b", "x at y dot z", "x at y . z", "(at)", "no at all", "7", "@", "{ at }", "at y dot z"])
def test_called_is_the_pattern(text):
    for a in range(len(text) + 1):
        for z in range(a, len(text) + 1):
            assert pii.called(text, a, z) == bool(pii.CALLS.search(text, a, z))
