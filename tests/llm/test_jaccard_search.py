"""A neighbourhood whose texts share most of their lines, few of which link: searched in seconds, with no link lost."""

import time

import numpy as np

from anvilgrid.llm import jaccard


def test_crowded_neighbourhood():
    rng = np.random.default_rng(5)
    pool = np.sort(rng.choice(np.arange(1, 10**6), 500, replace=False)).astype(np.uint64)
    sets = [np.sort(rng.choice(pool, 396, replace=False)) for _ in range(600)] + [np.sort(rng.choice(pool[:440], 396, replace=False)) for _ in range(40)]
    begin = time.time()
    index = jaccard.Index(sets)
    got = {(i, j, n) for i, s in enumerate(sets) for j, n in index.search(s)}
    assert time.time() - begin < 8
    member = np.array([np.isin(pool, s) for s in sets]).astype(np.int64)
    overlap = member @ member.T
    assert got == {(i, j, overlap[i, j]) for i, j in zip(*np.nonzero(7 * overlap >= 3 * 2 * 396), strict=True)} and 640 < len(got) < 640**2


def test_nothing_is_yielded_that_a_link_has_joined():
    s = np.arange(8, dtype=np.uint64)
    index, joined = jaccard.Index([s, s, s]), set()
    got = []
    for node, _ in index.search(s, lambda i: i in joined):
        got.append(node)
        joined.update(range(3))
    assert got == [0] and list(jaccard.Index([]).search(s)) == [] and list(index.search(s[:0])) == []
