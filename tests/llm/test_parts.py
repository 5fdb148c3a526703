"""The operators' small parts against brute force, without Spark."""

import itertools
import random
import re

import numpy as np
import pytest
import zstandard  # noqa: F401  (an operator needs it)
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import arrays, chunk_prints, embeddings, line_dedup, ngram_join, packing, pu_quality, toxicity, url_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.sampled_from("abAB é\u00a0\u2003\n\t\x0b\x1c.0"), max_size=60)


def _chunk(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum([0] + [len(d) for d in data])


@given(st.lists(TEXT, min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_match_the_pattern(texts):
    data, starts = _chunk(texts)
    w = arrays.words(data, starts)
    got = [[data[a:b].tobytes().decode() for a, b in zip(w.start[i:j], w.end[i:j], strict=True)] for i, j in itertools.pairwise(w.at)]
    assert got == [WORD.findall(t) for t in texts]
    flat = list(itertools.chain(*got))
    by_hash = dict(zip(w.hash.tolist(), flat, strict=True))
    assert [by_hash[h] for h in w.hash.tolist()] == flat and len(by_hash) == len(set(flat))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 25, 50])
def test_window_hashes_tell_windows_apart(k):
    rng = np.random.default_rng(k)
    h = rng.integers(0, 3, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    g = arrays.grams(arrays.mix(h), k)
    tuples = [tuple(h[i:i + k].tolist()) for i in range(len(h) - k + 1)]
    assert len(set(tuples)) == len(set(g.tolist())) == len(set(zip(tuples, g.tolist(), strict=True)))
    assert arrays.sliding_min(g, 7).tolist() == [min(g[i:i + 7].tolist()) for i in range(len(g) - 6)]


def test_similar_sets_share_a_block():
    rng = np.random.default_rng(3)
    for n in [*range(1, 80), 120, 400, 2000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = a.copy()
            while True:  # change as much as the threshold allows
                c = np.unique(np.concatenate([b[1:], rng.integers(0, 1 << 63, int(rng.integers(0, 2))).astype(np.uint64)])) if len(b) > 1 else b
                if len(c) == len(b) and (c == b).all() or not ngram_join.similar(a, c):
                    break
                b = c
            b = rng.permutation(b)
            assert np.intersect1d(ngram_join.block_keys(a), ngram_join.block_keys(np.sort(b))).size


def test_coordinate_minima_bound_the_overlap():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 500, 200)).astype(np.uint64) for _ in range(2))
        a, b = arrays.mix(a), arrays.mix(b)
        bound = np.minimum(ngram_join.point(a), ngram_join.point(b)).sum()
        finer = np.minimum(ngram_join._fine(a), ngram_join._fine(b)).sum()
        assert bound >= finer >= len(np.intersect1d(a, b))


def _globbed(pattern):
    out = ""
    for part in re.findall(r"\*\*|\*|\?|.", pattern, re.S):
        out += {"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return re.compile(out.encode(), re.S)


@given(st.lists(st.text(alphabet="ab/.*?", min_size=0, max_size=40), min_size=1, max_size=8), st.lists(st.text(alphabet="ab/.", max_size=50), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_automaton_matches_globs(patterns, texts):
    data, starts = _chunk(texts)
    got = url_rules.Automaton(patterns).match(data, starts)
    want = [[bool(_globbed(p).fullmatch(t.encode())) for p in patterns] for t in texts]
    assert got.tolist() == want


def test_hashing_finds_close_pairs():
    rng = np.random.default_rng(1)
    x = embeddings.unit(rng.normal(size=(1500, 64)))
    z = rng.normal(size=x.shape)
    z = embeddings.unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    y = 0.95 * x + np.sqrt(1 - 0.95 ** 2) * z
    a, b = (embeddings.bucket_keys(v, embeddings.HASHES, embeddings.TABLES, embeddings.PROBES) for v in (x, y))
    hit = ((a == b[:, :, :1]).any(axis=(1, 2))) | ((b == a[:, :, :1]).any(axis=(1, 2)))
    assert hit.mean() >= 0.998
    assert np.allclose(np.linalg.norm(embeddings.hadamard(x), axis=1), 1)


def _least_bins(sizes, capacity):
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            place(i + 1, rooms[:k] + [rooms[k] - sizes[i]] + rooms[k + 1:])
        place(i + 1, [*rooms, capacity - sizes[i]])
    place(0, [])
    return best[0]


@given(st.lists(st.integers(1, 12), min_size=1, max_size=8))
@settings(max_examples=200, deadline=None)
def test_bounds_hold_and_bins_are_filled_right(sizes):
    sizes = np.array(sorted(sizes, reverse=True))
    bins, offsets, free = packing.best_fit(sizes, 12)
    for b in range(len(free)):
        mine = np.argsort(offsets[bins == b])
        s, o = sizes[bins == b][mine], offsets[bins == b][mine]
        assert o.tolist() == [0, *np.cumsum(s)[:-1]] and s.sum() == 12 - free[b]
    assert packing.lower_bound(np.bincount(sizes, minlength=13)) <= _least_bins(sizes.tolist(), 12) <= len(free)


def test_bound_beats_the_mean():
    assert packing.lower_bound(np.bincount([7] * 10, minlength=13)) == 10
    assert packing.lower_bound(np.bincount([5] * 10, minlength=13)) == 5


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_is_in_order_and_common(a, b):
    got = line_dedup.patience(a, b)
    assert all(a[i] == b[j] for i, j in got)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(got))
    if a == b:
        assert got == [(i, i) for i in range(len(a))]


def test_blocks_need_enough_words():
    assert line_dedup.common_blocks([1, 2, 3, 9], [7, 1, 2, 3, 8], [1, 4, 4, 4, 4], 12) == [1, 2, 3]
    assert line_dedup.common_blocks([1, 2, 3, 9], [7, 1, 2, 3, 8], [1, 4, 4, 4, 4], 13) == []


def test_chunks_cover_the_text_and_survive_a_shift():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh éß\n") for _ in range(20_000))
    ends = chunk_prints.cuts(text.encode())
    assert ends[-1] == len(text.encode()) and all(0 < b - a <= chunk_prints.LONGEST for a, b in itertools.pairwise([0, *ends]))
    a, b = chunk_prints.chunk_set(text), chunk_prints.chunk_set("xyz " + text)
    assert chunk_prints.likeness(a, b) > 0.95 and chunk_prints.likeness(a, a) == 1
    assert chunk_prints.likeness({}, {}) == 1 and chunk_prints.likeness(a, {}) == 0


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(7)
    good, bad = rng.normal(1.5, 1, (4000, 3)), rng.normal(-1.5, 1, (4000, 3))
    web = np.concatenate([good[:2100], bad[:900]])
    binned = pu_quality.Binned(web)
    p, u = binned(good[2100:]), binned(web)
    prior = pu_quality.estimated_prior(p, u)
    assert abs(prior - 0.7) < 0.08
    w = pu_quality.fit_pu(p, u, prior)
    right = np.r_[binned(good[:2000]) @ w[:-1] + w[-1] > 0, binned(bad[2000:]) @ w[:-1] + w[-1] < 0].mean()
    assert right > 0.97


def test_toxic_windows_cost_less():
    plain = toxicity.Compressor(b" the house and the garden are green ")
    both = toxicity.Compressor(b" the house and the garden are green  worthless scum pathetic ")
    assert max(toxicity.savings(b"the worthless scum", plain, both)[:1]) >= 3
    assert toxicity.savings(b"the house and garden", plain, both)[0] <= 1
    assert toxicity.savings(b"", plain, both) == [0.0] * 8
