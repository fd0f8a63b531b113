"""The bound by which the n-gram Jaccard join leaves pairs out, and whole groups of copies through it."""

import random

import numpy as np
import pytest

from quarry.llm.jaccard_join import U64, Threshold, _met_in, band_keys, jaccard_join
from tests.llm.test_documents import brute_links, frame


@pytest.mark.parametrize("t", [Threshold(3, 90, 100), Threshold(5, 80, 100), Threshold(1, 60, 100)])
def test_linked_sets_share_as_many_keys_as_the_bound_says(t):
    r, bands = np.random.default_rng(3), t.bands(4000)
    for _ in range(400):
        n = int(r.integers(2, 1500))
        a = np.unique(r.integers(0, 2**63, n).astype(U64))
        least = t.overlap(2 * n) if r.random() < 0.5 else n
        drop = int(r.integers(0, n - min(n, least) + 1))
        kept = r.permutation(a)[drop:]
        b = np.unique(np.concatenate([kept, r.integers(0, 2**63, int(r.integers(0, n // 6 + 1))).astype(U64)]))
        both = len(np.intersect1d(a, b))
        if not both or t.den * both < t.num * (len(a) + len(b) - both):
            continue
        (x, least_a), (y, least_b) = band_keys(a, t, bands), band_keys(b, t, bands)
        shared = len(np.intersect1d(x, y))
        if np.array_equal(a, b) and not len(x):
            continue
        assert shared >= 1 and shared >= max(least_a, least_b) or min(least_a, least_b) <= 0 < shared


def test_what_keys_give():
    keys = np.array([5, 5, 7, 7, 7, 9, 5, 5, 8, 8, 8], U64)
    nodes = np.array([2, 1, 3, 1, 2, 4, 2, 9, 3, 2, 1], np.int64)
    pairs, warm, hot = _met_in(keys, nodes, few=2)
    assert len(pairs) == 0 and warm.tolist() == [[1, 3], [2, 3], [3, 2], [9, 1]]
    assert [x.tolist() for x in hot] == [[1, 2, 3], [1, 2, 9]]
    pairs, warm, hot = _met_in(keys, nodes, few=3)
    assert pairs.tolist() == [[1, 2, 3], [1, 3, 2], [1, 9, 1], [2, 3, 2], [2, 9, 1]] and not len(warm) and not hot
    assert [len(x) for x in _met_in(keys[:0], nodes[:0])] == [0, 0, 0]


@pytest.mark.parametrize("t", [Threshold(3, 90, 100), Threshold(5, 80, 100)])
def test_hot_groups(spark, t):
    """Many near copies, a passage in most texts, texts of little but that passage, blank texts, repeated ids, very long texts."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(3000)}"
    passage, base = [word() for _ in range(60)], [word() for _ in range(200)]
    texts = []
    for _ in range(60):
        copy = list(base)
        copy[r.randrange(200)] = word()
        texts.append(copy)
    texts += [[word() for _ in range(r.randrange(5, 150))] + passage + [word() for _ in range(r.randrange(5, 150))] for _ in range(60)]
    texts += [passage + [word() for _ in range(r.randrange(0, 9))] for _ in range(30)]
    texts += [[word() for _ in range(r.randrange(1, 9))] for _ in range(20)] + [[]] * 15
    huge = [word() for _ in range(40_000)]
    texts += [huge, huge[:38_000] + [word() for _ in range(1500)], huge[:20_000]]
    rows = [(7 * i - 300, " ".join(x)) for i, x in enumerate(texts)]
    want = brute_links(rows, t)
    given = [(i, x, "s") for i, x in rows] + [(rows[0][0], rows[0][1], "again"), (rows[80][0], rows[80][1], "again")]
    for broadcast_rows in (50_000, 0) if t.words == 5 else (50_000,):
        got = jaccard_join(frame(spark, given), t, broadcast_rows=broadcast_rows).select("doc_id", "n_shingles", "component_id", "n_links").collect()
        assert {tuple(x) for x in got} == set(want.values())
        assert len(got) == len(given)
