from __future__ import annotations

import numpy as np
import pytest

from lanewright.llm.fm_index import FMIndex, WaveletMatrix, suffix_array


def texts(seed, n=8, words=4, longest=25):
    rng = np.random.default_rng(seed)
    out = [rng.integers(1, words + 1, rng.integers(1, longest)) for _ in range(n)]
    return out + [out[0].copy(), np.ones(30, np.int64)]


def occurs(known, p):
    return sum(s[i : i + len(p)].tolist() == list(p) for s in known for i in range(len(s) - len(p) + 1))


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array(seed):
    rng = np.random.default_rng(seed)
    codes = np.append(rng.integers(1, 3, 300), 0)
    want = sorted(range(len(codes)), key=lambda i: codes[i:].tolist())
    assert suffix_array(codes)[0].tolist() == want


def test_rank():
    values = np.random.default_rng(0).integers(0, 11, 500)
    tree = WaveletMatrix(values, 4)
    symbols, places = np.repeat(np.arange(11), 501), np.tile(np.arange(501), 11)
    want = np.array([(values[:i] == s).sum() for s, i in zip(symbols, places)])
    assert (tree.rank(symbols, places) == want).all()


@pytest.mark.parametrize("seed", range(2))
def test_search_and_matching_statistics(seed):
    known = texts(seed)
    index = FMIndex(known, 3)
    for p in [known[3][2:6], known[0], np.array([1, 2, 1]), np.array([9, 9])]:
        a, b = index.intervals(np.asarray(p)[None, :])
        assert b[0] - a[0] == occurs(known, p)
    foreign = texts(seed + 50, 6, 5)
    for depth in (3, 8, 17):
        index = FMIndex(known, depth)
        streamed = [*known, *foreign]
        sizes, runs = index.matching_statistics(np.concatenate(streamed), np.concatenate([np.arange(1, len(q) + 1) for q in streamed]))
        at = 0
        for q in streamed:
            for e in range(1, len(q) + 1):
                best = max(m for m in range(min(depth, e) + 1) if m == 0 or occurs(known, q[e - m : e]))
                assert sizes[at] == best
                if best == depth:
                    who, where = index.place(index.first[runs[at : at + 1]])
                    first = min((k, x) for k, s in enumerate(known) for x in range(len(s) - depth + 1) if s[x : x + depth].tolist() == q[e - depth : e].tolist())
                    assert (who[0], where[0]) == first
                at += 1


def test_empty():
    index = FMIndex([], 2)
    assert index.matching_statistics(np.array([1, 2]), np.array([1, 2]))[0].tolist() == [0, 0]
