"""The pipeline's near-dedup finds its candidates by SimHash fingerprints and deletion-variant signatures."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from lexiform.llm import near_copies


def _bits(hashes, words):
    mask = 2**64 - 1
    out = []
    for j in range(1, words + 1):
        ones = [0] * 64
        for h in hashes:
            z = (h + j * 0x9E3779B97F4A7C15) & mask
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
            z ^= z >> 31
            ones = [n + (z >> b & 1) for b, n in enumerate(ones)]
        out.append(sum(1 << b for b, n in enumerate(ones) if 2 * n > len(hashes)))
    return out


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 8, 31, 100, 257])
def test_fingerprints_have_the_bits_of_over_half_the_hashes(size, monkeypatch):
    monkeypatch.setattr(near_copies, "STEP", 60)
    rng = random.Random(size)
    hashes = [rng.getrandbits(64) for _ in range(size)]
    assert near_copies.wide_fingerprint(np.array(hashes, np.uint64), 3).tolist() == _bits(hashes, 3)


@pytest.mark.parametrize("paired", [3, 128])
def test_what_meets_is_what_differs_in_one_wild_bit_at_most(paired, monkeypatch):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    rng = np.random.default_rng(5)
    n = 1500
    seg = rng.integers(0, 3, n) << 16 | rng.integers(0, 1 << 11, n)
    code = np.sort(seg.astype(np.uint64) << np.uint64(31))
    check = np.where(rng.random(n) < 0.5, 0, 2**64 - 1).astype(np.uint64)
    root = np.arange(n) // 2
    key = code >> np.uint64(31)
    want = set()
    for a in range(n):
        one = (key >> np.uint64(16) == key[a] >> np.uint64(16)) & (np.bitwise_count(key ^ key[a]) <= 1)
        want |= {(a, int(b)) for b in np.flatnonzero(one & (check == check[a]) & (root != root[a])) if a < b}
    for joined in (False, True):
        band, node, of = near_copies.met(code, np.arange(n), check, root, joined)
        assert (of == root[node]).all()
        found = {}
        for k, x in zip(band.tolist(), node.tolist()):
            found.setdefault(k, set()).add(x)
        together = {(a, b) for x in found.values() for a in x for b in x if a < b}
        assert want <= together and len(want) > 100
        if paired > 3:
            assert set(node.tolist()) == {x for pair in want for x in pair}


def _shingles(text):
    words = text.split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def test_the_stage_loses_no_pair_of_similarity_0_8(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(near_copies, "bands", lambda given, segments, joined, real=near_copies.bands: asked.append(segments) or real(given, segments, joined))
    rng = random.Random(11)
    docs = []
    for words in [8] * 60 + [*range(9, 69)] + [200, 400, 3000] * 10:  # 8 and 9 words: sets of 4 and 5, whose bits differ most
        base = [f"w{rng.randrange(10**9)}" for _ in range(words)]
        tail = [f"x{rng.randrange(10**9)}" for _ in range((words - 4) // 4)]
        assert len(_shingles(" ".join(base))) >= 0.8 * len(_shingles(" ".join(base + tail)))
        docs += [" ".join(base), " ".join(base + tail), " ".join(base + tail + [f"y{rng.randrange(10**9)}" for _ in range(words)])]
    table = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, "").collect())
    assert got == [i for i in range(len(docs)) if i % 3 != 1]
    assert asked[-1].stop is None and min(x.start for x in asked) == 0
